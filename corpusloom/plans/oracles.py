"""For each query the same result as plain DuckDB SQL over the whole tables."""

from __future__ import annotations

from corpusloom.functions.text import WHITESPACE
from corpusloom.operators.metrics import EXACT_MATCH_DATASETS
from corpusloom.plans.queries import DIMS, LISTED_NATIONS, SAMPLE_SIZE, TABLES, VOCABULARY_SIZE
from corpusloom.plans.views import EPOCHS_SQL, view_sql
from corpusloom.sources.catalog import (
    BENCHMARK_ORDER,
    CATALOG,
    EVALUATION_SPLITS,
    JSON_DATASETS,
    PUBLISHED_SCORES,
    ROW_CAPS,
)

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {text(WHITESPACE)})"


def trimmed(x: str) -> str:
    """Strip that keeps null."""
    return f"trim({x}, {text(WHITESPACE)})"


def task(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'code') OR contains(lower({x}), 'programming') THEN 'code' ELSE 'chat' END"


def h(x: str) -> str:
    return f"md5(concat('42:', {x}))"


def split(x: str) -> str:
    return f"CASE WHEN {h(x)} < '33333333' THEN 'test' WHEN {h(x)} < '66666666' THEN 'val' ELSE 'train' END"


def samples(shape: str, context: str, target: str, kind: str = "'chat'", where: str = "true", number: str = "0") -> str:
    return f"""
        SELECT * FROM (
            SELECT source_id, {number} AS sample_no, {context} AS context, {target} AS target, {kind} AS task
            FROM ({view_sql(shape)}) AS v WHERE {where}
        ) AS s WHERE context <> '' AND target <> ''"""


def values(rows: list[tuple], names: str) -> str:
    def cell(v: object) -> str:
        return text(v) if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS t({names})"


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}))"


def tokens_cte() -> str:
    """Common tables: word list per document, vocabulary, ids per document."""
    return f"""
        docs AS (SELECT doc_id, {strip("text")} AS body FROM documents),
        lists AS (
            SELECT doc_id, CASE WHEN body = '' THEN []::VARCHAR[] ELSE string_split_regex(body, '\\s+') END AS ws FROM docs
        ),
        spread AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM lists
        ),
        vocab AS (
            SELECT row_number() OVER (ORDER BY n DESC, word) + 4 AS token_id, word, n
            FROM (SELECT word, count(*) AS n FROM spread GROUP BY word ORDER BY n DESC, word LIMIT {VOCABULARY_SIZE}) AS c
        ),
        enc AS (
            SELECT l.doc_id, coalesce(e.tokens, []::BIGINT[]) AS tokens
            FROM lists AS l LEFT JOIN (
                SELECT s.doc_id, list(coalesce(v.token_id, 4) ORDER BY s.place) AS tokens
                FROM spread AS s LEFT JOIN vocab AS v ON s.word = v.word GROUP BY s.doc_id
            ) AS e ON l.doc_id = e.doc_id
        )"""


def spaced(x: str) -> str:
    return f"array_to_string({x}, ' ')"


TARGET_IDS = (
    "list_concat(list_concat([2], tokens), [3], list_transform(range(greatest(510 - len(tokens), 0)), lambda i: 1))"
)


def with_tokens(body: str) -> str:
    return f"WITH {tokens_cte()} {body}"


def vector_rows(select: str) -> str:
    """(…, dim, x) from a query with a column ``vec``."""
    return f"""
        SELECT * EXCLUDE (vec), generate_subscripts(vec, 1) - 1 AS dim, round(unnest(vec)::DOUBLE, 6) AS x
        FROM ({select}) AS q"""


def thread_cte() -> str:
    return f"""
        msgs AS ({view_sql("v_thread")}),
        idx AS (SELECT * FROM msgs WHERE message_id IS NOT NULL AND text <> ''),
        walk AS (
            SELECT message_id, message_id AS root_id, parent_id AS nxt, NULL::VARCHAR AS above, 0 AS depth FROM idx
            UNION ALL
            SELECT w.message_id, p.message_id, p.parent_id, concat_ws(chr(10), p.text, w.above), w.depth + 1
            FROM walk AS w JOIN idx AS p ON w.nxt = p.message_id
        ),
        paths AS (
            SELECT message_id, arg_max(root_id, depth) AS root_id, max(depth) AS depth,
                   coalesce(arg_max(above, depth), '') AS context
            FROM walk GROUP BY message_id
        )"""


O = ORACLES

# --- sources and sinks ---
O["src_read"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
O["src_reopen"] = "SELECT conv_id, turn, role, text FROM conversations"
_CATALOG_ROWS = [
    (i, n, r, s, c or "", t, "json" if n in JSON_DATASETS else "parquet", ROW_CAPS.get(n, 0))
    for i, (n, r, s, c, t) in enumerate(CATALOG)
]
O["src_catalog"] = f"""
    SELECT t.*, coalesce(d.n_docs, 0) AS n_docs
    FROM {values(_CATALOG_ROWS, "seq, name, repo, split, config, trust_remote_code, format, row_cap")}
    LEFT JOIN (SELECT substr(source, 4)::INT AS seq, count(*) AS n_docs FROM documents GROUP BY 1) AS d ON t.seq = d.seq"""
O["src_multi_config"] = "SELECT lang, doc_id, text FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')"
O["smp_per_group"] = f"""
    SELECT lang, doc_id, text FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {h("doc_id")}, doc_id) AS rn
        FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')
    ) AS r WHERE rn <= 100"""
O["src_json"] = "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events"
O["snk_parquet_roundtrip"] = f"SELECT doc_id, text, source AS dataset, {split('doc_id')} AS split FROM documents"
O["src_page_concat"] = """
    SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"""
O["src_manifest"] = " UNION ALL ".join(
    [f"SELECT '{t}' AS name, 'ok' AS status, count(*) AS n_rows FROM {t}" for t in TABLES]
    + ["SELECT 'absent', 'failed', -1"]
)
O["vocab_topk"] = with_tokens("SELECT token_id, word, n FROM vocab")

_MODELS = [(d, m, s) for d, scores in PUBLISHED_SCORES.items() for m, s in scores.items()]
_SCORED = ", ".join(text(d) for d in EXACT_MATCH_DATASETS)
_OWN = f"""
    own AS (
        SELECT t.name AS dataset,
               round(CASE WHEN t.name IN ({_SCORED}) THEN avg(CASE WHEN toxic = quality THEN 1.0::DOUBLE ELSE 0.0 END)
                     ELSE 0.0 END, 6) AS score
        FROM labels JOIN documents USING (doc_id)
        JOIN {values([(i, n) for i, n in enumerate(BENCHMARK_ORDER)], "pos, name")} ON substr(source, 4)::INT = t.pos
        GROUP BY t.name
    ),
    models AS (SELECT t.dataset, t.model, t.score::DOUBLE AS score FROM {values(_MODELS, "dataset, model, score")})"""
O["jn_scorecard"] = f"""
    WITH {_OWN}
    SELECT dataset, 'own' AS model, score FROM own
    UNION ALL
    SELECT dataset, model, score FROM models WHERE dataset IN (SELECT dataset FROM own)"""
O["snk_scorecard_lines"] = f"""
    WITH {_OWN}
    SELECT concat(o.dataset, ': own: ', o.score, ', Top models: {{"own":', o.score, m.listed, '}}') AS value
    FROM own AS o LEFT JOIN (
        SELECT dataset, string_agg(concat(',"', model, '":', score), '' ORDER BY model) AS listed
        FROM models GROUP BY dataset
    ) AS m ON o.dataset = m.dataset"""

# --- projections and filters ---
O["prj_strip"] = f"SELECT doc_id, {strip('text')} AS text FROM documents"
O["flt_required"] = f"""
    SELECT source_id, {strip("input")} AS input, {strip("target")} AS target FROM ({view_sql("v_pair")}) AS v
    WHERE {strip("input")} <> '' AND {strip("target")} <> ''"""
O["flt_valid"] = f"""
    SELECT source_id, question AS context, support AS target, {task("question")} AS task
    FROM ({view_sql("v_qa")}) AS v WHERE question IS NOT NULL AND support IS NOT NULL"""
O["flt_lang"] = "SELECT doc_id, lang FROM documents WHERE lower(lang) = lower('EN')"
O["flt_role"] = f"""
    SELECT message_id, text FROM ({view_sql("v_thread")}) AS v
    WHERE role = 'assistant' AND message_id IS NOT NULL AND text <> ''"""
O["prj_preview"] = "SELECT doc_id, concat(left(coalesce(text, ''), 200), '...') AS preview FROM documents"
O["prj_task"] = f"SELECT source_id, {task('instruction')} AS task FROM ({view_sql('v_instruction')}) AS v"
_CHOICE = "CASE WHEN answer >= 0 THEN choices[answer + 1] END"
O["rpt_rejects"] = f"""
    SELECT CASE WHEN {strip("question")} = '' THEN 'no question' WHEN len(choices) = 0 THEN 'no choices'
                WHEN answer < 0 THEN 'index below 0' WHEN answer >= len(choices) THEN 'index past the end'
                WHEN {strip(_CHOICE)} = '' THEN 'blank choice' ELSE 'accepted' END AS reason, count(*) AS n_rows
    FROM ({view_sql("v_mcq")}) AS v GROUP BY 1"""
O["flt_finite"] = f"SELECT run, batch_idx, loss FROM ({view_sql('v_loss')}) AS v WHERE {finite('loss')}"
O["cat_ordered"] = f"""
    SELECT t.pos, t.name, count(*) AS n_rows
    FROM {values([(n, i) for i, n in enumerate(LISTED_NATIONS)], "name, pos")}
    JOIN nation ON n_name = t.name JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"""

# --- adapters ---
O["ad_pair"] = samples("v_pair", strip("input"), strip("target"))
O["ad_pair_code"] = samples("v_pair", strip("input"), strip("target"), "'code'")
O["ad_best_answer"] = O["ad_pair"]
for _key in ("ad_docstring", "ad_canonical", "ad_text_code"):
    O[_key] = O["ad_pair_code"]
O["ad_question_answer"] = samples("v_pair", "input", "target")
O["ad_hellaswag"] = samples(
    "v_mcq",
    strip("question"),
    strip("CASE WHEN try_cast(label AS INT) >= 0 THEN choices[try_cast(label AS INT) + 1] END"),
)
O["ad_sciq"] = samples(
    "v_qa",
    f"CASE WHEN {strip('support')} <> '' THEN concat({strip('support')}, ' ', {strip('question')}) ELSE {strip('question')} END",
    strip("correct_answer"),
)
O["ad_gsm8k"] = samples("v_marked", strip("question"), strip("string_split(answer, '#### ')[-1]"))
O["ad_mmlu"] = samples("v_mcq", strip("question"), strip(_CHOICE))
O["ad_arc"] = samples(
    "v_mcq_labeled", strip("question"), strip("choices.text[nullif(list_position(choices.label, answerKey), 0)]")
)
O["ad_stem"] = samples("v_mcq", strip("question"), strip(_CHOICE), where="NOT pic_choice")
_TURNS = f"(SELECT *, unnest(range(1, len(dialog))) AS turn FROM ({view_sql('v_nested_dialog')}) AS d)"
O["ad_dialog"] = f"""
    SELECT * FROM (
        SELECT source_id, turn - 1 AS sample_no, {strip("array_to_string(dialog[1:turn], ' ')")} AS context,
               {strip("dialog[turn + 1]")} AS target, 'chat' AS task FROM {_TURNS} AS v
    ) AS s WHERE context <> '' AND target <> ''"""
O["ad_persona"] = f"""
    SELECT * FROM (
        SELECT source_id, n AS sample_no, {strip("array_to_string(utterances[n + 1].history, ' ')")} AS context,
               {strip("utterances[n + 1].candidates[-1]")} AS target, 'chat' AS task
        FROM (SELECT *, unnest(range(0, len(utterances))) AS n FROM ({view_sql("v_nested_dialog")}) AS d) AS v
    ) AS s WHERE context <> '' AND target <> ''"""
O["ad_thread"] = f"""
    WITH RECURSIVE {thread_cte()}
    SELECT message_id AS source_id, 0 AS sample_no, context, {strip("text")} AS target, 'chat' AS task
    FROM idx JOIN paths USING (message_id) WHERE role = 'assistant' AND context <> '' AND {strip("text")} <> ''"""
O["ad_first_solution"] = samples("v_nested_dialog", strip("problem"), strip("solutions[1]"), "'code'")
O["ad_nested_solution"] = O["ad_first_solution"]
_INSTRUCTION = strip("instruction")
O["ad_instruction"] = samples(
    "v_instruction",
    f"CASE WHEN {strip('input')} <> '' THEN concat({_INSTRUCTION}, ' ', {strip('input')}) ELSE {_INSTRUCTION} END",
    strip("output"),
    task("instruction"),
)
O["ad_instruction_context"] = O["ad_instruction"]
O["ad_dolly"] = samples(
    "v_instruction",
    f"CASE WHEN {strip('input')} <> '' THEN concat({strip('input')}, ' ', {_INSTRUCTION}) ELSE {_INSTRUCTION} END",
    strip("output"),
    task("instruction"),
)
_OPTIONS = "list_filter(list_transform(options, lambda o: trim(o)), lambda o: len(o) > 2 AND lower(o[1]) IN ('a','b','c','d','e'))"
O["ad_mathqa"] = samples(
    "v_options",
    strip("Problem"),
    strip(f"list_filter({_OPTIONS}, lambda o: lower(o[1]) = lower(correct))[-1][3:]"),
)
O["ad_bool"] = f"""
    SELECT doc_id AS source_id, 0 AS sample_no, {strip("text")} AS context,
           CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS target, 'chat' AS task
    FROM labels JOIN documents USING (doc_id) WHERE {strip("text")} <> ''"""
O["ad_first_answer"] = samples(
    "v_union",
    "question",
    "CASE json_type(answer) WHEN 'ARRAY' THEN answer::JSON ->> '$[0]' WHEN 'VARCHAR' THEN answer::JSON ->> '$' END",
)
O["ad_rationale"] = samples(
    "v_qa",
    f"CASE WHEN {strip('support')} <> '' THEN concat({strip('question')}, ' Rationale: ', {strip('support')}) "
    f"ELSE {strip('question')} END",
    strip("correct_answer"),
)
O["ad_last_assistant"] = samples(
    "v_chosen",
    strip("prompt"),
    strip("list_filter(chosen, lambda m: m.role = 'assistant' AND m.content <> '')[-1].content"),
    task("prompt"),
)
O["ad_first_positive"] = samples(
    "v_mcq", strip("question"), "CASE WHEN labels[1] = 1 THEN answers[1] WHEN labels[2] = 1 THEN answers[2] END"
)
O["ad_sliding"] = """
    SELECT conv_id * 1000 + turn AS source_id, 0 AS sample_no, context, target, 'chat' AS task FROM (
        SELECT conv_id, turn, v AS target, row_number() OVER w AS rn,
               array_to_string(list(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' ') AS context
        FROM (SELECT *, {body} AS v FROM conversations) AS c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ) AS s WHERE rn > 3 AND context <> '' AND target <> ''""".format(body=strip("text"))
O["fn_list_normalize"] = f"""
    SELECT source_id,
           CASE json_type(answer) WHEN 'ARRAY' THEN 2 WHEN 'VARCHAR' THEN 1 ELSE 0 END AS n_items,
           CASE json_type(answer) WHEN 'ARRAY' THEN concat(answer::JSON ->> '$[0]', '|', answer::JSON ->> '$[1]')
                WHEN 'VARCHAR' THEN answer::JSON ->> '$' ELSE '' END AS items
    FROM ({view_sql("v_union")}) AS v"""

O["rpt_empty_lists"] = f"""
    SELECT CASE WHEN len(solutions) = 0 THEN 'no solution' WHEN {strip("problem")} = '' THEN 'no problem'
                ELSE 'accepted' END AS reason, count(*) AS n_rows
    FROM ({view_sql("v_nested_dialog")}) AS v GROUP BY 1"""
O["rpt_adapters"] = " UNION ALL ".join(
    f"""
    SELECT '{name}' AS dataset, n_rows, n_accepted, n_rows - n_accepted AS n_rejected, n_samples
    FROM (SELECT count(*) AS n_rows FROM ({view_sql(shape)}) AS v) AS r,
         (SELECT count(DISTINCT source_id) AS n_accepted, count(*) AS n_samples FROM ({O[key]}) AS s) AS a"""
    for name, shape, key in [
        ("hellaswag", "v_mcq", "ad_hellaswag"),
        ("sciq", "v_qa", "ad_sciq"),
        ("gsm8k", "v_marked", "ad_gsm8k"),
        ("daily_dialog", "v_nested_dialog", "ad_dialog"),
    ]
)

# --- joins ---
O["jn_thread_context"] = f"""
    WITH RECURSIVE {thread_cte()}
    SELECT message_id, root_id, depth, context, false AS cyclic FROM paths"""
O["jn_config_lookup"] = """
    SELECT c_custkey, c_nationkey % 7 AS n_regionkey, coalesce(n_name, 'none') AS n_name
    FROM customer LEFT JOIN (
        SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey
    ) AS f ON f.n_regionkey = c_nationkey % 7"""
O["jn_missing_anti"] = """
    SELECT c_custkey, c_nationkey AS nationkey FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 8000)"""
O["jn_semi_supported"] = """
    SELECT c_custkey, c_nationkey AS nationkey FROM customer WHERE c_nationkey IN (
        SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"""
O["jn_eval_split"] = f"""
    SELECT d.name, coalesce(e.eval_split, 'none') AS eval_split, d.n_rows FROM (
        SELECT t.name, count(*) AS n_rows FROM documents
        JOIN {values([(i, n) for i, n in enumerate(BENCHMARK_ORDER)], "pos, name")} ON substr(source, 4)::INT = t.pos
        GROUP BY t.name
    ) AS d LEFT JOIN (SELECT * FROM {values(list(EVALUATION_SPLITS.items()), "name, eval_split")}) AS e ON d.name = e.name"""
_REPOS = [(n, r) for n, r, *_ in CATALOG]
O["jn_evaluation_plan"] = f"""
    SELECT o.pos, o.name, c.repo, coalesce(e.eval_split, 'none') AS eval_split,
           CASE WHEN c.repo IS NULL THEN 'no configuration' WHEN e.eval_split IS NULL THEN 'no evaluation split'
                ELSE 'ok' END AS status, d.n_rows
    FROM (SELECT substr(source, 4)::INT AS pos, count(*) AS n_rows FROM documents GROUP BY 1) AS d
    JOIN (SELECT * FROM {values([(i, n) for i, n in enumerate(BENCHMARK_ORDER)], "pos, name")}) AS o ON o.pos = d.pos
    LEFT JOIN (SELECT * FROM {values(_REPOS, "name, repo")}) AS c ON c.name = o.name
    LEFT JOIN (SELECT * FROM {values(list(EVALUATION_SPLITS.items()), "name, eval_split")}) AS e ON e.name = o.name"""
O["jn_pair_predictions"] = f"""
    SELECT g.source_id, g.sample_no, g.target, coalesce(p.target, '') AS prediction
    FROM ({O["ad_mmlu"]}) AS g LEFT JOIN ({O["ad_first_positive"]}) AS p
    ON g.source_id = p.source_id AND g.sample_no = p.sample_no"""

# --- aggregates ---
O["agg_counts"] = "SELECT source, lang, count(*) AS n_rows FROM documents GROUP BY source, lang"
O["agg_accuracy"] = """
    SELECT lang, round(avg(CASE WHEN toxic = quality THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS score, count(*) AS n_answered
    FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
_LOSSES = f"""(SELECT run, batch_idx, label, CASE WHEN {finite("loss")} THEN loss::DECIMAL(18, 2) END AS loss
    FROM ({view_sql("v_loss")}) AS v)"""
O["agg_masked_mean"] = f"""
    SELECT run, coalesce(sum(loss) FILTER (WHERE m)::DOUBLE / nullif(count(*) FILTER (WHERE m), 0), 0.0) AS mean_value,
           count(*) FILTER (WHERE m) AS n_kept
    FROM (SELECT *, label <> 1 AND loss IS NOT NULL AS m FROM {_LOSSES} AS l) AS k GROUP BY run"""
O["agg_epoch_mean"] = f"""
    SELECT run, sum(loss)::DOUBLE / nullif(count(loss), 0) AS mean_value, count(loss) AS n_batches
    FROM {_LOSSES} AS l GROUP BY run"""
_CELLS = "SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"
O["agg_second_moment"] = f"""
    SELECT label, dim AS idx, round(avg(x * x), 6) AS moment FROM ({_CELLS}) AS c GROUP BY label, dim"""
O["agg_weighted_drift"] = f"""
    SELECT unnest([0, 1]) AS task_no, round(unnest([low, high]), 4) AS penalty FROM (
        SELECT sum(f * (w - lo) * (w - lo)) * 500.0::DOUBLE AS low, sum(f * (w - hi) * (w - hi)) * 500.0::DOUBLE AS high
        FROM (SELECT avg(x) AS w, avg(x * x) AS f, min(x) AS lo, max(x) AS hi FROM ({_CELLS}) AS c GROUP BY label, dim) AS g
    ) AS p"""
O["agg_l2"] = f"SELECT label, round(sum(x * x), 6) AS l2 FROM ({_CELLS}) AS c GROUP BY label"
O["agg_duplicates"] = "SELECT sha256(text) AS text, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1"
O["agg_component_rollup"] = f"""
    SELECT CASE WHEN contains(lower(name), 'chunk_encoder') THEN 'ChunkEncoder'
                WHEN contains(lower(name), 'aggregator') THEN 'Aggregator'
                WHEN contains(lower(name), 'reasoning_module') THEN 'ReasoningModule'
                WHEN contains(lower(name), 'decompressor') THEN 'Decompressor'
                WHEN contains(lower(name), 'compressor') THEN 'Compressor' ELSE 'Other' END AS component,
           count(*) FILTER (WHERE grad_norm IS NULL) AS n_null, count(*) FILTER (WHERE grad_norm = 0) AS n_zero,
           count(*) AS n_total
    FROM ({view_sql("v_names")}) AS v GROUP BY 1"""
O["agg_islands"] = """
    SELECT user_id, island, min(event_type) AS event_type, count(*) AS n_rows, min(event_id) AS first_row,
           max(event_id) AS last_row
    FROM (
        SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island
        FROM (
            SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type
                           THEN 1 ELSE 0 END AS changed FROM events
        ) AS e
    ) AS i GROUP BY user_id, island"""
O["agg_microbatch"] = f"""
    SELECT run, place // 16 AS step, coalesce(sum(loss)::DOUBLE, 0.0) / 16 AS accumulated, count(*) AS n_rows,
           count(*) = 16 AS complete
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY batch_idx) - 1 AS place FROM {_LOSSES} AS l) AS p
    GROUP BY run, place // 16"""

# --- windows ---
O["win_sliding_context"] = """
    SELECT conv_id, turn, context, text FROM (
        SELECT conv_id, turn, text, row_number() OVER w AS rn,
               array_to_string(list(text) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' ') AS context
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ) AS s WHERE rn > 3"""
_PREFIX = f"""(
    SELECT conv_id, turn, text, {strip("array_to_string(before, ' ')")} AS context FROM (
        SELECT conv_id, turn, text, row_number() OVER w AS rn,
               list(text) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ) AS s WHERE rn > 1)"""
O["win_prefix_context"] = f"SELECT conv_id, turn, context, text FROM {_PREFIX} AS p"
O["win_last_assistant"] = """
    SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations
    WHERE role = 'assistant' AND text <> '' GROUP BY conv_id"""
O["win_running_avg"] = f"""
    SELECT run, batch_idx, (sum(loss) OVER w)::DOUBLE / count(*) OVER w AS avg_loss FROM {_LOSSES} AS l
    WHERE loss IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY batch_idx ROWS UNBOUNDED PRECEDING)"""
_STOPS = f"""
    WITH low AS (
        SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_loss
        FROM ({EPOCHS_SQL}) AS e
    ), marked AS (
        SELECT *, best_loss < lag(best_loss, 1, 'inf'::DOUBLE) OVER (PARTITION BY run ORDER BY epoch) AS improved FROM low
    ), waits AS (
        SELECT *, epoch - max(CASE WHEN improved THEN epoch ELSE 0 END)
                  OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS wait FROM marked
    ), stops AS (
        SELECT *, min(CASE WHEN wait >= 10 THEN epoch END) OVER (PARTITION BY run) AS stop FROM waits
    )"""
O["win_early_stop"] = f"""{_STOPS}
    SELECT run, epoch, val_loss, best_loss, wait, improved, coalesce(epoch = stop, false) AS stopped
    FROM stops WHERE stop IS NULL OR epoch <= stop"""
O["win_checkpoints"] = f"""{_STOPS}
    SELECT run, epoch, val_loss FROM stops WHERE improved AND (stop IS NULL OR epoch <= stop)"""
_FAR_APART = """(
    SELECT event_type, event_id * 1000003 + (event_id * 7919) % 1000 AS place, value::DECIMAL(18,2) AS value FROM events
)"""
O["win_running_avg_sparse"] = f"""
    SELECT event_type, place, (sum(value) OVER w)::DOUBLE / count(value) OVER w AS avg_value FROM {_FAR_APART} AS e
    WINDOW w AS (PARTITION BY event_type ORDER BY place ROWS UNBOUNDED PRECEDING)"""
O["agg_islands_sparse"] = f"""
    SELECT island, min(event_type) AS event_type, count(*) AS n_rows, min(place) AS first_row, max(place) AS last_row FROM (
        SELECT event_type, place, sum(changed) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
            SELECT event_type, place, CASE WHEN lag(event_type) OVER (ORDER BY place) <> event_type THEN 1 ELSE 0 END AS changed
            FROM {_FAR_APART} AS e
        ) AS c
    ) AS i GROUP BY island"""
O["win_top3"] = """
    SELECT * FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (
            PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem
    ) AS r WHERE rn <= 3"""

# --- samples, splits, sets ---
O["smp_seeded"] = f"SELECT doc_id, text FROM documents ORDER BY {h('doc_id')}, doc_id LIMIT {SAMPLE_SIZE}"
O["lim_first_n"] = f"SELECT doc_id, text FROM documents WHERE lower(lang) = 'en' ORDER BY doc_id LIMIT {SAMPLE_SIZE}"
O["split_exact"] = f"""
    SELECT doc_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + ceil(0.25::DOUBLE * (n - t)) THEN 'val' ELSE 'train' END AS split
    FROM (
        SELECT doc_id, row_number() OVER (ORDER BY {h("doc_id")}, doc_id) AS rn, count(*) OVER () AS n,
               ceil(0.2::DOUBLE * count(*) OVER ()) AS t FROM documents
    ) AS r"""
O["split_hash_shares"] = f"""
    SELECT v.variant, doc_id,
           CASE v.variant WHEN 0 THEN CASE WHEN {h("doc_id")} < '8' THEN 'val' ELSE 'train' END
                          WHEN 1 THEN CASE WHEN {h("doc_id")} < '8' THEN 'test' ELSE 'val' END
                          WHEN 2 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS split
    FROM documents, (SELECT unnest([0, 1, 2, 3, 4])::INT AS variant) AS v"""
O["split_hash"] = f"SELECT doc_id, {split('doc_id')} AS split FROM documents"
O["split_by_thread"] = f"""
    WITH RECURSIVE {thread_cte()}
    SELECT message_id, root_id, {split("root_id")} AS split FROM idx JOIN paths USING (message_id)
    WHERE role = 'assistant' AND context <> ''"""
O["set_corpus_union"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, {seq} AS seq, source_id::VARCHAR AS source_id, sample_no, context, target, task "
    f"FROM ({O[key]}) AS part_{seq}"
    for seq, (name, key) in enumerate(
        [("alpaca", "ad_instruction"), ("mmlu", "ad_mmlu"), ("gsm8k", "ad_gsm8k"), ("sciq", "ad_sciq"), ("bbh", "ad_pair")]
    )
)
O["set_corpus_all"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, {seq} AS seq, source_id::VARCHAR AS source_id, sample_no, context, target, task "
    f"FROM ({O[key]}) AS part_{seq}"
    for seq, (name, key) in enumerate([
        ("alpaca", "ad_instruction"), ("dolly", "ad_dolly"), ("open_assistant", "ad_thread"), ("code_alpaca", "ad_instruction"),
        ("daily_dialog", "ad_dialog"), ("personachat", "ad_persona"), ("mmlu", "ad_mmlu"), ("code_search_net", "ad_docstring"),
        ("human_eval", "ad_canonical"), ("mbpp", "ad_text_code"), ("apps", "ad_first_solution"),
        ("codecontests", "ad_nested_solution"), ("open_r1_math", "ad_pair_code"), ("mathqa", "ad_mathqa"),
        ("gsm8k", "ad_gsm8k"), ("aqua_rat", "ad_rationale"), ("strategyqa", "ad_bool"), ("sciq", "ad_sciq"),
        ("stem", "ad_stem"), ("arc_easy", "ad_arc"), ("arc_challenge", "ad_arc"), ("nq_open", "ad_first_answer"),
        ("hellaswag", "ad_hellaswag"), ("truthfulqa", "ad_best_answer"), ("ultrafeedback", "ad_last_assistant"),
        ("bbh", "ad_pair"), ("bigbench_hard", "ad_pair"), ("kjv_bible", "ad_sliding"), ("math", "ad_pair_code"),
        ("natural_questions", "ad_first_answer"), ("owasp", "ad_question_answer"), ("wikiqa", "ad_first_positive"),
        ("wizardlm", "ad_instruction_context"),
    ])
)
O["src_json_array"] = r"""
    SELECT event_id, concat('} "\{', event_type, '}]') AS note, event_id AS id, concat(event_type, '|', props) AS words FROM events"""
O["src_read_config"] = f"""
    SELECT doc_id, text, lang AS config, 'train' AS split FROM documents WHERE lang = 'en' AND {split("doc_id")} = 'train'"""
O["snk_json"] = "SELECT doc_id, text, lang FROM documents"
O["src_rebuild"] = """
    SELECT doc_id, lang, 'whole' AS path FROM documents UNION ALL SELECT doc_id, upper(lang), 'broken' FROM documents"""
O["ad_rows"] = f"""
    SELECT source_id, n AS sample_no, concat(question, ' ', n) AS context, choices[n + 1] AS target, 'chat' AS task
    FROM (SELECT *, unnest(range(0, len(choices)))::INT AS n FROM ({view_sql("v_mcq")}) AS v) AS c WHERE choices[n + 1] <> ''"""
O["tok_plugin"] = """
    SELECT doc_id, array_to_string(list_transform(string_split(lang, ''), lambda c: unicode(c)), ' ') AS ids FROM documents"""
O["doc_parse_2023"] = """
    SELECT p_partkey AS source_id, 0 AS section_no, p_name AS title, p_type AS description,
           concat(p_type, ' ', p_size) AS examples, p_brand AS prevention FROM part
    UNION ALL SELECT p_partkey, 1, p_brand, p_name, '', '' FROM part"""
O["corpus_slice"] = f"""
    SELECT {split("conv_id")} AS split, {task("target")} AS task, count(*) AS n_samples,
           count(DISTINCT conv_id) AS n_conversations, round(avg(len(context)), 6) AS mean_context_chars
    FROM (SELECT *, {strip("text")} AS target FROM {_PREFIX} AS p) AS s WHERE context <> '' AND target <> '' GROUP BY 1, 2"""

_BUILT = [("alpaca", "ad_instruction"), ("mmlu", "ad_mmlu"), ("gsm8k", "ad_gsm8k")]
O["corpus_build"] = (
    " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, 'ok' AS status, {split('source_id')} AS split, task, count(*) AS n_rows "
        f"FROM ({O[key]}) AS s GROUP BY ALL"
        for name, key in _BUILT
    )
    + f"""
    UNION ALL
    SELECT 'open_assistant', 'ok', {split("root_id")}, 'chat', count(*) FROM (
        WITH RECURSIVE {thread_cte()}
        SELECT root_id FROM idx JOIN paths USING (message_id)
        WHERE role = 'assistant' AND context <> '' AND {strip("text")} <> ''
    ) AS t GROUP BY ALL
    UNION ALL
    SELECT 'unknown', 'no adapter', 'none', 'none', 0"""
)

# --- tokens ---
O["tok_encode"] = with_tokens(f"SELECT doc_id, len(tokens) AS n_tokens, {spaced('tokens')} AS tokens FROM enc")
O["tok_decode"] = with_tokens("""
    SELECT l.doc_id, coalesce(t.text, '') AS text FROM lists AS l LEFT JOIN (
        SELECT s.doc_id, string_agg(coalesce(v.word, '<unk>'), ' ' ORDER BY s.place) AS text
        FROM spread AS s LEFT JOIN vocab AS v ON s.word = v.word GROUP BY s.doc_id
    ) AS t ON l.doc_id = t.doc_id""")
O["tok_encode_join"] = O["tok_encode"]
O["tok_decode_join"] = O["tok_decode"]
O["tok_target_pad"] = with_tokens(f"SELECT doc_id, {spaced(TARGET_IDS)} AS target_ids FROM enc")
O["tok_mask"] = with_tokens(f"""
    SELECT doc_id, len(list_filter(ids, lambda t: t <> 1)) AS n_filled,
           {spaced("list_transform(ids, lambda t: (t <> 1)::INT)")} AS mask
    FROM (SELECT doc_id, {TARGET_IDS} AS ids FROM enc) AS t""")
O["tok_prepend"] = with_tokens(f"""
    SELECT doc_id, {spaced("list_concat([0], tokens)")} AS tokens,
           {spaced("list_concat([1], list_transform(tokens, lambda t: (t <> 1)::INT))")} AS mask FROM enc""")
O["tok_chunks"] = with_tokens(f"""
    SELECT doc_id, i AS chunk_no,
           {spaced("list_concat(part, list_transform(range(128 - len(part)), lambda p: 1))")} AS tokens
    FROM (
        SELECT doc_id, i, tokens[i * 64 + 1 : i * 64 + 128] AS part FROM (
            SELECT *, unnest(range(0, greatest((greatest(len(tokens), 192) - 128 + 63) // 64 + 1, 2))) AS i FROM enc
        ) AS n
    ) AS c""")
O["tok_blocks"] = with_tokens("""
    SELECT doc_id, (place - 1) // 128 AS block_no, (place - 1) % 128 AS pos, token FROM (
        SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM enc
    ) AS t""")
O["tok_next_pairs"] = with_tokens(f"""
    SELECT doc_id, {spaced("tokens[1:len(tokens) - 1]")} AS inputs, {spaced("tokens[2:]")} AS labels FROM enc""")
O["bat_padded"] = with_tokens(f"""
    SELECT doc_id, shard, batch_no, pos, n_tokens, width,
           {spaced("list_concat(tokens, list_transform(range(width - n_tokens), lambda i: 1))")} AS tokens
    FROM (
        SELECT *, max(n_tokens) OVER (PARTITION BY shard, batch_no) AS width FROM (
            SELECT *, place // 4 AS batch_no, place % 4 AS pos, len(tokens) AS n_tokens FROM (
                SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS place
                FROM (SELECT *, left({h("doc_id")}, 2) AS shard FROM enc) AS a
            ) AS b
        ) AS c
    ) AS d""")

O["bat_consecutive"] = with_tokens(f"""
    SELECT doc_id, batch_no, pos::INT AS pos, n_tokens, width,
           {spaced("list_concat(tokens, list_transform(range(width - n_tokens), lambda i: 1))")} AS tokens
    FROM (
        SELECT *, max(n_tokens) OVER (PARTITION BY batch_no) AS width FROM (
            SELECT *, place // 4 AS batch_no, place % 4 AS pos, len(tokens) AS n_tokens
            FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM enc) AS a
        ) AS b
    ) AS c""")
O["bat_samples"] = with_tokens(f"""
    SELECT shard, batch_no, pos, source_id, task,
           {spaced("list_concat(c, list_transform(range(width - len(c)), lambda i: 1))")} AS context_tokens,
           {spaced("list_concat([2, t, 3], list_transform(range(509), lambda i: 1))")} AS target_tokens
    FROM (
        SELECT *, max(len(c)) OVER (PARTITION BY shard, batch_no) AS width FROM (
            SELECT *, place // 4 AS batch_no, place % 4 AS pos FROM (
                SELECT *, row_number() OVER (PARTITION BY shard ORDER BY source_id) - 1 AS place FROM (
                    SELECT s.source_id, s.task, left({h("s.source_id")}, 2) AS shard, e.tokens AS c,
                           coalesce(v.token_id, 4) AS t
                    FROM ({O["ad_pair"]}) AS s JOIN enc AS e ON e.doc_id = s.source_id
                    LEFT JOIN vocab AS v ON v.word = s.target
                ) AS a
            ) AS b
        ) AS c1
    ) AS d""")

# --- vectors ---
_PLACED = "SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings"
O["emb_tree"] = f"""
    WITH RECURSIVE leaves AS (
        SELECT label, pos, count(*) OVER (PARTITION BY label) AS m, embedding FROM ({_PLACED}) AS p
    ), tree AS (
        SELECT label, 0 AS level, pos, m, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v
        FROM leaves
        UNION ALL
        SELECT label, level + 1, pos // 2, (m + 1) // 2, dim, avg(v) FROM tree WHERE m > 1
        GROUP BY label, level, pos // 2, m, dim
    )
    SELECT label, level, pos, dim, round(v, 6) AS x FROM tree"""
O["emb_pad_nodes"] = vector_rows(f"""
    SELECT label // 4 AS batch_no, label, pos, embedding AS vec FROM ({_PLACED}) AS p
    UNION ALL
    SELECT batch_no, label, unnest(range(n, width)) AS pos, list_transform(range({DIMS}), lambda i: 0::FLOAT)
    FROM (
        SELECT label // 4 AS batch_no, label, count(*) AS n, max(count(*)) OVER (PARTITION BY label // 4) AS width
        FROM embeddings GROUP BY label
    ) AS c""")
O["emb_concat"] = vector_rows(f"""
    SELECT a.label, a.pos // 2 AS pair_no, list_concat(a.embedding, b.embedding) AS vec
    FROM ({_PLACED}) AS a JOIN ({_PLACED}) AS b ON a.label = b.label AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0""")

# --- sections ---
O["doc_sections"] = """
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS section_no, concat(chr(10), unnest(parts)) AS section
    FROM (SELECT doc_id, string_split(text, chr(10))[2:] AS parts FROM documents) AS d"""


def _tag(name: str) -> str:
    return strip(f"regexp_extract(html, '(?s)<{name}>(.+?)(?:</{name}>|$)', 1)")


O["doc_fields"] = f"""
    SELECT page_id, {_tag("title")} AS title, {_tag("article")} AS body, {_tag("blockquote")} AS quoted FROM pages"""
O["doc_parse"] = """
    SELECT p_partkey AS source_id, 0 AS section_no, p_name AS title, p_type AS description, p_brand AS examples,
           p_type AS prevention FROM part
    UNION ALL
    SELECT p_partkey, 1, p_brand, concat('See A03:2021 -'), p_name, '' FROM part"""
O["doc_qa_pairs"] = """
    SELECT * FROM (
        SELECT p_partkey AS source_id, 'description' AS field,
               concat('What is ', p_name, ' according to the 2021 OWASP Top 10?') AS context, p_type AS target, 'chat' AS task
        FROM part
        UNION ALL
        SELECT p_partkey, 'examples', concat('What are some examples of ', p_name, ' in the 2021 OWASP Top 10?'),
               CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, 'chat' FROM part
        UNION ALL
        SELECT p_partkey, 'prevention', concat('How can ', p_name, ' be prevented as per the 2021 OWASP Top 10?'),
               CASE WHEN p_size % 3 = 0 THEN p_type END, 'chat' FROM part
    ) AS q WHERE target <> ''"""

# --- streams ---
O["str_filter_take"] = O["lim_first_n"]
O["str_adapt"] = f"""
    SELECT doc_id AS source_id, 0 AS sample_no, {strip("text")} AS context, {strip("source")} AS target, 'chat' AS task
    FROM documents WHERE {strip("text")} <> '' AND {strip("source")} <> ''"""
O["str_adapt_groups"] = O["ad_thread"]
O["str_running_loss"] = """
    SELECT user_id AS run, sum(value::DECIMAL(18, 2))::DOUBLE / count(value) AS avg_loss, count(value) AS n_batches
    FROM events GROUP BY user_id"""
