"""Message threads: the texts above a message, found by pointer doubling and gathered once.

Every message keeps a pointer to the nearest ancestor it has not seen yet and the ids between. One round joins
each unfinished message to the message it points at and takes over its pointer and ids, so the distance seen doubles:
log2(depth) rounds instead of one per level. Rounds move ids only; texts are joined to the ids at the end, for
the messages whose contexts are wanted. Contexts are whole; a caller who names ``max_len`` gets their first
code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import has_text, strip
from corpusloom.operators.lookups import GROUP_ROWS, dealt_lookup
from corpusloom.session import cut_lineage


def thread_nodes(messages: DataFrame, message_id: str, parent: str, text: str, order: str | None = None) -> DataFrame:
    """(id, next, body) of every message that has an id and a text, written once.

    ``order`` decides between rows of one id: the last one counts; without it ids are unique.
    """
    nodes = messages.filter(F.col(message_id).isNotNull() & has_text(text)).select(
        F.col(message_id).alias("id"),
        F.col(parent).cast(messages.schema[message_id].dataType).alias("next"),
        F.col(text).alias("body"),
        *([F.col(order).alias("_order")] if order else []),
    )
    if order:
        nodes = nodes.groupBy("id").agg(F.max_by(F.struct("next", "body"), "_order").alias("_m")).select("id", "_m.*")
    return cut_lineage(nodes, "thread-nodes")


def thread_links(nodes: DataFrame, max_depth: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, root, depth, path, cyclic, too_deep): ``path`` has the ids above a message, the root's first.

    A message that meets itself above itself is on a cycle; it and all below it are ``cyclic`` and have no path. With
    ``max_depth`` the walk ends there and what lies deeper, or on a cycle, is ``too_deep`` instead.
    """
    no_path = F.array().cast(f"array<{nodes.schema['id'].dataType.simpleString()}>")
    pointers = nodes.select("id", "next", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    state = pointers.select("*", no_path.alias("path"), F.lit(False).alias("cyclic"))
    finished: list[DataFrame] = []  # each round rewrites only the messages that still have a way to go
    reach = 1
    while max_depth is None or reach <= max_depth + 1:
        unfinished = state.filter(F.col("next").isNotNull())
        waiting = unfinished.count()
        if not waiting:
            break
        reach *= 2
        whole = reduce(DataFrame.unionByName, finished, state)
        finished.append(state.filter(F.col("next").isNull()))
        hop = whole.select(*[F.col(c).alias(f"_{c}") for c in whole.columns])
        joined = dealt_lookup(unfinished, hop, "next", "_id", spread_by="id", group_rows=group_rows, n_rows=waiting)
        found = F.col("_id").isNotNull()
        taken = F.when(found, F.concat("_path", F.array("_id"), "path")).otherwise(F.col("path"))
        endless = F.coalesce(F.col("_cyclic"), F.lit(False)) | F.array_contains("_taken", F.col("id"))
        step = joined.withColumn("_taken", taken).withColumn("_endless", endless)
        on = ~F.col("_endless")
        state = cut_lineage(
            step.select(
                "id",
                F.when(on, F.col("_next")).alias("next"),
                F.coalesce("_root", "root").alias("root"),
                (F.col("depth") + F.when(found, F.col("_depth") + 1).otherwise(0)).alias("depth"),
                F.when(on, F.col("_taken")).otherwise(no_path).alias("path"),
                F.col("_endless").alias("cyclic"),
            ),
            "thread-links",
        )
    if max_depth is None:
        cyclic, too_deep = F.col("cyclic"), F.lit(False)
    else:
        cyclic, too_deep = F.lit(False), F.col("cyclic") | F.col("next").isNotNull() | (F.col("depth") > max_depth)
    return reduce(DataFrame.unionByName, finished, state).select(
        "id", "root", "depth", "path", cyclic.alias("cyclic"), too_deep.alias("too_deep")
    )


def gather_contexts(
    links: DataFrame, nodes: DataFrame, max_len: int | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(id, context): the texts of each message's path, in its order, joined by line ends; messages without a path are left out."""
    bodies = nodes.select(F.col("id").alias("_above"), (F.substring("body", 1, max_len) if max_len else F.col("body")).alias("_body"))
    steps = links.select("id", F.posexplode("path").alias("_at", "above"))
    # a message is above another once at most, so no key has more rows than there are messages
    texts = dealt_lookup(steps, bodies, "above", "_above", spread_by="id", group_rows=group_rows, n_rows=nodes.count())
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_body")))
    joined = F.array_join(F.transform(ordered, lambda t: t["_body"]), "\n")
    return texts.groupBy("id").agg((F.substring(joined, 1, max_len) if max_len else joined).alias("context"))


def thread_paths(
    messages: DataFrame,
    message_id: str = "message_id",
    parent: str = "parent_id",
    text: str = "text",
    max_len: int | None = None,
    order: str | None = None,
    max_depth: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(message id, root id, depth, context, cyclic, too_deep) of every message that has an id and a text.

    The walk ends at a missing message or an empty text. ``context`` is null for a root. Messages on or below a
    cycle of parents are marked ``cyclic`` and have no context. With ``max_depth`` the messages below that depth are
    marked ``too_deep`` instead, as are all on a cycle, which is deeper than any bound. ``order``: see ``thread_nodes``.
    """
    nodes = thread_nodes(messages, message_id, parent, text, order)
    links = thread_links(nodes, max_depth, group_rows)
    stays = ~F.col("cyclic") & ~F.col("too_deep")
    contexts = gather_contexts(links.filter(stays), nodes, max_len, group_rows)
    return links.join(contexts, "id", "left").select(
        F.col("id").alias(message_id),
        F.when(stays, F.col("root")).alias("root_id"),
        F.when(stays, F.col("depth")).alias("depth"),
        "context",
        "cyclic",
        "too_deep",
    )


def assistant_messages(
    df: DataFrame, message_id: str = "message_id", role: str = "role", text: str = "text"
) -> DataFrame:
    return df.filter((F.col(role) == "assistant") & F.col(message_id).isNotNull() & has_text(text))


def thread_context(
    messages: DataFrame,
    message_id: str = "message_id",
    parent: str = "parent_id",
    text: str = "text",
    max_len: int | None = None,
    order: str | None = None,
    max_depth: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Assistant messages that have a context, with it and the root id. Only their contexts are gathered."""
    nodes = thread_nodes(messages, message_id, parent, text, order)
    links = thread_links(nodes, max_depth, group_rows).filter(~F.col("cyclic") & ~F.col("too_deep") & (F.col("depth") > 0))
    answers = assistant_messages(messages, message_id, text=text)
    asked = answers.select(F.col(message_id).alias("id"))
    contexts = gather_contexts(links.join(asked, "id", "left_semi"), nodes, max_len, group_rows).filter(has_text("context"))
    found = links.join(contexts, "id").select(F.col("id").alias(message_id), F.col("root").alias("root_id"), "depth", "context")
    return answers.join(found, message_id)


def thread_targets(messages: DataFrame, **options) -> DataFrame:
    text = options.get("text", "text")
    return thread_context(messages, **options).withColumn("target", strip(text))
