"""Secret scan: a pattern finds candidates, a random forest removes the false ones. Expressions and Spark ML only.

Candidates are runs of 16 or more letters, digits and + / _ -, with = behind them where no value follows, and values of
any length and any characters but blanks and quotes behind an assignment (= or :) or a secret word (and "is"). Brackets before and
punctuation after a value are none of it; it ends where '&name=' or the like begins the next one. Runs inside a longer
value are candidates too, and count where the value does not stand itself. Features: length, shares of digits, capitals, vowels and
distinct characters and others than letters and digits, changes of character class per character, share covered by dictionary pieces (the most frequent
letter triples of all texts), path marks, an assignment or quote before it, and words in its neighbourhood
(NEAR characters of the text on either side, other candidates included) that go with secrets or with harmless identifiers.

The forest learns from labelled findings planted into contexts of at most TRAIN_DOCS documents (a seeded choice):
generated keys, passwords and tokens are secrets; the documents' own digitless candidates (as they are and in capitals),
digests, version hashes, UUIDs, paths and numbers are not. Scores are the forest's share of trees for 'secret'; LEAST and above is a finding.

Null texts have no candidates. Repeated rows give repeated findings. Offsets count code points from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import seeded_hash
from corpusloom.llm.common import let, stored

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=\"'-]))?"
NEAR = 48  # characters of neighbourhood on either side
LEAST = 0.5
TRAIN_DOCS = 2000  # bound of the training sample
PIECES = 150  # letter triples in the dictionary
TREES = 20
DEPTH = 8
SEED = 42
MASK = "[secret]"

# Words beside a candidate.
SECRET_WORDS = r"(?i:passw|passwd|password|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer)"
HARMLESS_WORDS = r"(?i)(sha\d|md5|commit|checksum|digest|uuid|guid|etag|revision|hash|href|src=|https?:)"
# What comes before a value: = or :, or a secret word and a blank; what was taken for a value before may end in one itself.
LINK = r"[\"']?[ \t](?:is[ \t])?"
BEHIND = rf"\G(?:(?<=[=:])|(?<={SECRET_WORDS}){LINK}|(?<=(?i:api|access|private))(?i:.?key){LINK})"
TRIGGER = rf"(?:[=:]|(?=[pPsStTaAcCbB]){SECRET_WORDS}{LINK}|{BEHIND})[ \t]{{0,8}}[\"'(\[{{<]?(?![=:(\[{{<])"
# A value: units of closing punctuation and one other character.
VALUE = r"(?:(?![&?;,][\w.-]{1,64}=)[.,;:)\]}>]*+[^\s\"'.,;:)\]}>])++"
CANDIDATE = f"({TRIGGER})({VALUE})|({RUN})"
BEGIN, END, UNKNOWN = "﷐", "﷑", "�"  # two code points that texts do not use mark values
MARKED = f"$1{BEGIN}$2$3{END}"
MARKED_RUN = f"{BEGIN}$0{END}"
STEP = 64  # pieces whose lengths are summed one by one
FEATURES = (
    "length", "digits", "capitals", "vowels", "distinct", "changes", "coverage", "path", "hexadecimal", "assigned",
    "quoted", "secret_words", "harmless_words", "others",
)


def _pieces(text: Column, pattern: str, marked: str) -> Column:
    """The text in pieces: between, found, between, ... One pass of the pattern marks what is found."""
    clean = F.translate(text, BEGIN + END, UNKNOWN * 2)
    return F.split(F.regexp_replace(clean, pattern, marked), f"[{BEGIN}{END}]", -1)


def _joined(pieces: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(pieces, at.cast("int"), n.cast("int")), "")


def _total(sizes: Column, at: Column, n: Column) -> Column:
    return F.aggregate(F.slice(sizes, at.cast("int"), n.cast("int")), F.lit(0), lambda a, b: a + b)


def _starts(sizes: Column) -> Column:
    """Where each piece begins: sums of STEP sizes at a time, then of what is left, so long texts cost no square."""
    parts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(STEP)).cast("int"))
    sums = F.transform(parts, lambda b: _total(sizes, b * STEP + 1, F.lit(STEP)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(
        sums,
        none,
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )
    return let(
        begins,
        lambda begin: F.transform(
            sizes,
            lambda _, i: F.get(begin, F.floor(i / F.lit(STEP)).cast("int")) + _total(sizes, i - i % STEP + 1, i % STEP),
        ),
    )


def _cuts(text: Column, pattern: str, marked: str) -> Column:
    """An array of value, start, before and after, in the order of the text.

    let: Spark would move what a lambda names once into it, and cut the text anew for each candidate.
    """

    def found(pieces: Column, tails: Column, heads: Column, starts: Column) -> Column:
        # two pieces in a row have two characters or more, so NEAR pieces reach far enough
        return F.transform(
            F.filter(pieces, lambda _, i: i % 2 == 1),
            lambda v, i: F.struct(
                v.alias("value"),
                F.get(starts, 2 * i + 1).alias("start"),
                F.right(_joined(tails, F.greatest(F.lit(1), 2 * i + 2 - NEAR), F.least(2 * i + 1, F.lit(NEAR))), F.lit(NEAR)).alias("before"),
                F.left(_joined(heads, 2 * i + 3, F.lit(NEAR)), F.lit(NEAR)).alias("after"),
            ),
        )

    def ends(pieces: Column) -> Column:
        tails = F.transform(pieces, lambda p: F.right(p, F.lit(NEAR)))
        heads = F.transform(pieces, lambda p: F.left(p, F.lit(NEAR)))
        sizes = F.transform(pieces, F.char_length)
        return let(
            tails, lambda t: let(heads, lambda h: let(let(sizes, _starts), lambda s: found(pieces, t, h, s)))
        )

    return let(_pieces(text, pattern, marked), ends)


def candidates(docs: DataFrame, *more: str) -> DataFrame:
    """A row per candidate: value, start, the NEAR characters of the text before and after it, and the value around a run.

    explode_outer: before an explode Spark would put a filter with the whole cutting expression in it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    few = docs.select(*more, F.explode_outer(_cuts(text, CANDIDATE, MARKED)).alias("r")).where("r IS NOT NULL")
    # runs inside a value; one that is nothing but a run has none
    inside = F.when(F.col("r.value").rlike(f"^{RUN}$"), "").otherwise(F.col("r.value"))
    nothing = F.lit(None).cast("struct<value:string,before:string,after:string>").alias("within")

    def with_runs(rows: Column) -> Column:
        whole = F.array(F.struct("r.value", "r.start", "r.before", "r.after", nothing))
        runs = F.transform(
            rows,
            lambda x: F.struct(
                x["value"].alias("value"),
                (F.col("r.start") + x["start"]).alias("start"),
                F.right(F.concat("r.before", x["before"]), F.lit(NEAR)).alias("before"),
                F.left(F.concat(x["after"], "r.after"), F.lit(NEAR)).alias("after"),
                F.struct("r.value", "r.before", "r.after").alias("within"),
            ),
        )
        return F.concat(whole, runs)

    each = F.explode_outer(let(_cuts(inside, RUN, MARKED_RUN), with_runs)).alias("f")
    return few.select(*more, "r", each).select(*more, "f.*")


def dictionary(docs: DataFrame) -> list[str]:
    """The PIECES most frequent letter triples of all texts."""
    lowered = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    word = docs.select(F.explode_outer(F.split(lowered, "[^a-z]+")).alias("w"))
    word = word.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.char_length("w") >= 3)
    triple = F.explode_outer(
        F.transform(F.sequence(F.lit(1), F.char_length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))
    )
    top = word.select("n", triple.alias("t")).groupBy("t").agg(F.sum("n").alias("n"))
    return [r["t"] for r in top.orderBy(F.desc("n"), "t").limit(PIECES).collect()]


def features(pieces: list[str]) -> list[Column]:
    value, size = F.col("value"), F.char_length("value").cast("double")
    lowered = F.lower(value)

    def share(pattern: str) -> Column:
        return (size - F.char_length(F.regexp_replace(value, pattern, ""))) / size

    classes = F.translate(value, "bcdefghijklmnopqrstuvwxyz", "a" * 25)
    classes = F.translate(classes, "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25)
    classes = F.translate(classes, "123456789", "0" * 9)
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    known = "|".join(pieces) or "(?!)"
    coverage = (size - F.char_length(F.regexp_replace(lowered, known, ""))) / size
    around = F.concat_ws(" ", "before", "after")
    return [
        F.least(size, F.lit(128.0)).alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        share("[aeiouAEIOU]").alias("vowels"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0))).alias("distinct"),
        (changes / size).alias("changes"),
        coverage.alias("coverage"),
        (share("[/_-]") + F.when(F.col("before").rlike(r"[/.~]$"), 1.0).otherwise(0.0)).alias("path"),
        F.when(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0).alias("hexadecimal"),
        F.when(F.col("before").rlike(r"[=:]\s*[\"']?$"), 1.0).otherwise(0.0).alias("assigned"),
        F.when(F.col("before").rlike(r"[\"']$"), 1.0).otherwise(0.0).alias("quoted"),
        F.when(F.col("before").rlike(SECRET_WORDS), 1.0).otherwise(0.0).alias("secret_words"),
        F.when(around.rlike(HARMLESS_WORDS), 1.0).otherwise(0.0).alias("harmless_words"),
        share("[^A-Za-z0-9]").alias("others"),
    ]


def _digits_of(seed: Column, letters: str, n: int) -> Column:
    """n characters drawn by hash from the given letters."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(n)),
            lambda i: F.substring(
                F.lit(letters), (F.pmod(F.xxhash64(seed, i), F.lit(len(letters))) + 1).cast("int"), F.lit(1)
            ),
        ),
        "",
    )


def labelled_findings(sample: DataFrame) -> DataFrame:
    """value, before, after, label: planted findings in contexts of the sample, and its own digitless candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seed = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    context = sample.select(
        seed.alias("seed"), F.left(text, F.lit(30)).alias("b"), F.right(text, F.lit(30)).alias("a")
    )
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    base32, mixed, hexa = upper + "234567" + "89", upper + lower + digits, digits + "abcdef"
    signs = "!@#$&*?.~^%"

    def made(label: int, kind: str, before: str, value: Column, after: str = "") -> Column:
        return F.struct(
            F.lit(label).cast("double").alias("label"),
            value.alias("value"),
            F.concat("b", F.lit(" " + before)).alias("before"),
            F.concat(F.lit(after + " "), "a").alias("after"),
        )

    def drawn(kind: str, letters: str, n: int) -> Column:
        return _digits_of(F.concat(F.col("seed"), F.lit(kind)), letters, n)

    dash = F.lit("-")
    uuid = F.concat(
        drawn("u1", hexa, 8), dash, drawn("u2", hexa, 4), dash, drawn("u3", hexa, 4), dash, drawn("u4", hexa, 4), dash,
        drawn("u5", hexa, 12),
    )
    path = F.concat(
        drawn("p1", lower, 5), F.lit("/"), drawn("p2", lower, 7), F.lit("/"), drawn("p3", lower, 6), drawn("p4", digits, 1)
    )
    planted = [
        made(1, "cloud key", "", F.concat(F.lit("AKIA"), drawn("k", base32, 16))),
        made(1, "password", "password=", drawn("w", hexa, 18)),
        made(1, "password", "pwd: ", drawn("x", mixed, 16)),
        made(1, "token", 'token = "', drawn("t", hexa, 40), '"'),
        made(1, "token", "", F.concat(F.lit("ghp_"), drawn("g", mixed, 36))),
        made(1, "secret", "secret_key = '", drawn("s", mixed + "+/", 40), "'"),
        made(1, "bearer", "authorization: bearer ", drawn("r", mixed + "-_", 43)),
        made(1, "secret", "export AWS_SECRET_ACCESS_KEY=", drawn("e", mixed + "+/", 40)),
        made(1, "token", 'GITHUB_ACCESS_TOKEN="', drawn("f", hexa, 40), '"'),
        made(0, "name", "export ", F.lit("AWS_SECRET_ACCESS_KEY"), "="),
        made(0, "commit", "LAST_DEPLOYED_COMMIT_HASH=", drawn("l", hexa, 40)),
        made(1, "password", "password=", drawn("q", mixed + signs, 10)),
        made(1, "password", "DB_PASSWORD: ", drawn("v", mixed + signs, 8)),
        made(1, "password", '"password": "', drawn("y", mixed + signs, 12), '",'),
        made(1, "password", "password ", drawn("z", mixed + signs, 11)),
        made(1, "key", 'api_key = "', F.concat(drawn("j", mixed, 4), dash, drawn("o", mixed, 9)), '"'),
        made(1, "token", "https://example.org/list?page=2&access_token=", drawn("a1", hexa, 32), "&sort=1"),
        made(1, "token", "https://example.org/?q=a&token=", drawn("a2", hexa, 40), "&n=2"),
        made(0, "number", "page=", drawn("n1", digits, 2)),
        made(0, "number", "id: ", drawn("n2", digits, 8)),
        made(0, "number", 'width = "', F.concat(drawn("n3", digits, 3), F.lit("%")), '"'),
        made(0, "time", "time: ", F.concat(drawn("n4", digits, 2), F.lit(":"), drawn("n5", digits, 2))),
        made(0, "date", "date=", F.concat(drawn("n6", digits, 4), F.lit("-0"), drawn("n7", digits, 1), F.lit("-1"))),
        made(0, "version", "version: ", F.concat(drawn("n8", digits, 1), F.lit("."), drawn("n9", digits, 2))),
        made(0, "price", "price: ", F.concat(F.lit("$"), drawn("n0", digits, 3))),
        made(0, "word", "the token ", drawn("l1", lower, 6)),
        made(0, "word", "a password is ", drawn("l2", lower, 7)),
        made(0, "word", "name: ", F.concat(drawn("l3", upper, 1), drawn("l4", lower, 6))),
        made(0, "site", "url: ", F.concat(F.lit("https://"), drawn("l5", lower, 7), F.lit(".org/"), drawn("l6", lower, 5))),
        made(0, "digest", "sha256: ", drawn("d", hexa, 64)),
        made(0, "digest", "md5 ", drawn("m", hexa, 32)),
        made(0, "commit", "commit ", drawn("c", hexa, 40)),
        made(0, "uuid", "id: ", uuid),
        made(0, "path", "/", path),
        made(0, "number", "", drawn("n", digits, 16)),
        made(0, "page", "https://example.org/", F.concat(drawn("h", lower, 9), dash, drawn("i", lower, 8))),
    ]
    rows = context.select(F.explode(F.array(*planted)).alias("f")).select("f.*")
    own = candidates(sample).where(~F.col("value").rlike("[0-9]"))
    own = own.where(~F.col("before").rlike(SECRET_WORDS + r"[\w.-]{0,16}[\"']?\s*[=:]\s*[\"']?$"))  # may be passwords
    own = own.select(F.lit(0.0).alias("label"), "value", "before", "after")
    loud = own.select("label", *(F.upper(c).alias(c) for c in ("value", "before", "after")))  # texts in capitals
    return rows.union(own).union(loud).select("label", "value", "before", "after")


class Forest:
    def __init__(self, model: RandomForestClassificationModel, pieces: list[str]) -> None:
        self.model, self.pieces = model, pieces

    def scored(self, found: DataFrame) -> DataFrame:
        """The candidates with ``score``, the forest's share for 'secret'."""
        kept = found.columns
        wide = found.select(*kept, *features(self.pieces))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(wide)
        done = self.model.transform(vectors.select(*kept, "vector"))
        return done.select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def train(docs: DataFrame) -> Forest:
    order = seeded_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), SEED)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(order, "doc_id").limit(TRAIN_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = stored(sample, "secret-sample")
    pieces = dictionary(docs)
    rows = labelled_findings(sample).select("label", *(c for c in features(pieces)))
    ordered = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).select("label", "vector")
    ordered = stored(ordered, "secret-findings")
    if not ordered.where("label = 1").limit(1).count():  # no documents: one planted row of each kind teaches as well
        made = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit("").alias("text"))
        rows = labelled_findings(made).select("label", *features(pieces))
        ordered = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).select("label", "vector")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64
    )
    return Forest(forest.fit(ordered), pieces)


def standing(found: DataFrame, forest: Forest) -> DataFrame:
    """The candidates that the forest takes for secrets, without runs inside a value that is one; ``score`` is added."""
    kept = found.columns
    stand = forest.scored(found).where(F.col("score") >= LEAST)
    around = [F.coalesce(F.col(f"within.{c}"), F.col(c)).alias(c) for c in ("value", "before", "after")]
    own = F.struct(*kept, "score").alias("own")
    again = forest.scored(stand.select(own, *around))
    return again.where(F.col("own.within").isNull() | (F.col("score") < LEAST)).select("own.*")


def scan(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """Findings that stand: doc_id, start, length, value_sha256, score."""
    forest = forest or train(docs)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return standing(candidates(chosen, "doc_id"), forest).select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.char_length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"),
    )


def _masked(text: Column, secrets: Column, pattern: str, marked: str, rest: Callable[[Column], Column]) -> Column:
    """The text with each match masked that is a secret; the others become ``rest`` of them."""

    def mask(piece: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, piece).when(F.array_contains(secrets, piece), F.lit(MASK)).otherwise(rest(piece))

    return let(_pieces(text, pattern, marked), lambda pieces: F.array_join(F.transform(pieces, mask), ""))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found secret masked and n_chars counted anew where it is present; no row goes.

    Findings are few; they are gathered per text and joined to it on its hash, so rows without an id and repeated rows
    need no care. A value that stands as a secret once is masked wherever it is a candidate in that text. Columns of any
    name pass through: the row travels in a struct. Code points that mark values (U+FDD0, U+FDD1, which no text should
    hold) become U+FFFD in masked texts.
    """
    forest = train(docs)
    text = F.col("text").cast("string")
    found = standing(candidates(docs.select(text.alias("text"), F.xxhash64(text).alias("of")), "of"), forest)
    per_text = found.groupBy("of").agg(F.collect_set("value").alias("secrets"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text).alias("of"))
    joined = rows.join(per_text, "of", "left")
    old, secrets = F.col("row.text").cast("string"), F.col("secrets")

    def runs(value: Column) -> Column:
        return _masked(value, secrets, RUN, MARKED_RUN, lambda run: run)

    masked = F.when(secrets.isNotNull(), _masked(old, secrets, CANDIDATE, MARKED, runs)).otherwise(F.col("row.text"))
    out = joined.select(F.col("row"), masked.alias("text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col(f"row.`{name}`")
        if name != "n_chars":
            return own.alias(name)
        return F.coalesce(F.char_length("text").cast(docs.schema[name].dataType), own).alias(name)

    return out.select(*map(column, docs.columns))
