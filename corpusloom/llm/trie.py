"""Prefix trie of conversations, its nodes and what shared prefixes save, by balanced parentheses.

Conversations are rebuilt (see ``rebuilt``); a node is a distinct sequence of first turns, the root the empty one. Rows
are (conversation, depth) with a 128-bit hash of the prefix (the exclusive or of its turns' hashes, each bound to its
depth), so a node is a group of equal rows; texts are hashed where they are read and go no further.

Spines: nodes of one member set on one path are a chain, known by its smallest member and its number of members. A chain
is one paren pair of the encoding; what differs inside it follows from running sums of bytes. A path holds at most
sqrt(2 * rows) chains, for each one sheds a conversation that is as deep.

Order: chains are range-sorted in preorder. A node's child with the same smallest member comes first, the other children
after that one's subtree, so deeper branches off a path come before shallower ones: the key is the list of
(-depth, smallest member) where the smallest member changes, then the chain's depth.

Shards: each run of SHARD chains is a balanced-parentheses sequence with its excess per place and the least excess per
block of places and per power of two of blocks. findclose delimits a chain's subtree; the rank of leaf pairs "()" before
its two ends gives the leaves, cumulative arrays the savings. Chains that stay open at a shard's end, and the shard's
successive least depths with the sums between them, are all that later shards need: these spines are merged by the same
step over a far shorter sequence, until one shard holds it.

Rows without conv_id belong to no conversation and are left out. A null turn comes first, turns that tie are ordered by
the MD5 of role and text; repeated rows are turns of their own. Null roles and texts are empty. ``c - c % 5`` truncates, so
-7 takes its head from -5. No rows give no nodes, not even a root. Hot conversations, prefixes and end nodes are cut into
blocks or ranges; a node's end list is hashed from pieces in order, as its hash demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.operators.blocks import BLOCK, KEY, fold, join_blocks, summarise, up_to_here, with_block

HEADS = 9
GROUP = 5
BLOCK_ROWS = 4_096
SHARD = 1 << 18  # chains in one parentheses sequence
EXCESS_BLOCK = 64
QUERIES_AT_ONCE = 1 << 14
PIECE = 4_096  # conversation ids in one piece of an end list
FIRST = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()


# Conversations


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, at (the order), mark (MD5 of role and text), bytes (of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        turn.alias("turn"),
        F.coalesce(turn, F.lit(FIRST)).alias("at"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv, depth, mark, bytes: depth 0 for every conversation, then its rebuilt turns.

    Conversation c has the first h turns of c - c % 5, h = crc32(c) % 9, then its own turns after its first h.
    """
    said = stored(turns(conversations), "turns")
    sizes = said.groupBy("conv").agg(F.count(F.lit(1)).alias("n_own"))
    h = F.pmod(F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")), F.lit(HEADS))
    whole = sizes.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    whole = stored(whole.join(bases, "base", "left").select("conv", "h", "base", head.alias("head")), "conversations")

    blocked = with_block(said, ["conv"], "at", BLOCK_ROWS)
    states = fold(summarise(blocked, _n=F.count(F.lit(1))), before={"_start": F.sum("_n")})
    states = states.withColumn("_conv", F.col(f"{KEY}.conv"))
    states = states.join(whole.select(F.col("conv").alias("_conv"), "h", "head"), "_conv").drop("_conv")
    inside = Window.partitionBy(KEY, BLOCK).orderBy("at", F.asc_nulls_first("turn"), "mark")
    rows = join_blocks(blocked.withColumn("_local", F.row_number().over(inside) - 1), states)
    pos = (F.coalesce("_start", F.lit(0)) + F.col("_local")).alias("pos")
    placed = stored(rows.select("conv", pos, "mark", "bytes", "h", "head"), "placed-turns")

    own = placed.where("pos >= h").select("conv", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("depth"), "mark", "bytes")
    first = placed.where((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS - 1))
    first = first.select(F.col("conv").alias("base"), "pos", "mark", "bytes")
    taken = whole.join(first, "base").where("pos < head")
    taken = taken.select("conv", (F.col("pos") + 1).alias("depth"), "mark", "bytes")
    roots = whole.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("mark"), F.lit(0).cast("long").alias("bytes"))
    return roots.unionByName(own).unionByName(taken)


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with k1, k2 (hash of the prefix) and until (bytes of its turns). Depths are dense: blocks are ranges of them."""
    lanes = {f"_x{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "mark")).otherwise(0) for i in (1, 2)}
    blocked = rows.withColumns({**lanes, KEY: F.struct("conv"), BLOCK: F.expr(f"depth div {BLOCK_ROWS}")})
    sums = {"_x1": F.bit_xor("_x1"), "_x2": F.bit_xor("_x2"), "_bytes": F.sum("bytes")}
    states = fold(
        summarise(blocked, **sums),
        before={"_k1": F.bit_xor("_x1"), "_k2": F.bit_xor("_x2"), "_until": F.sum("_bytes")},
    )
    here = up_to_here("depth")
    inner = {"_i1": F.bit_xor("_x1").over(here), "_i2": F.bit_xor("_x2").over(here), "_ib": F.sum("bytes").over(here)}
    joined = join_blocks(blocked.withColumns(inner), states)
    none = F.lit(0).cast("long")
    return joined.select(
        "conv",
        "depth",
        "bytes",
        (F.coalesce("_until", none) + F.col("_ib")).alias("until"),
        F.coalesce("_k1", none).bitwiseXOR(F.col("_i1")).alias("k1"),
        F.coalesce("_k2", none).bitwiseXOR(F.col("_i2")).alias("k2"),
    )


def members(paths: DataFrame) -> DataFrame:
    """conv, depth, bytes, until, and of the node there: low, its smallest member, and n, its number of members."""
    blocked = with_block(paths, ["depth", "k1", "k2"], "conv", BLOCK_ROWS)
    summary = summarise(blocked, _low=F.min("conv"), _n=F.count(F.lit(1)))
    states = fold(summary, overall={"low": F.min("_low"), "n": F.sum("_n")})
    return join_blocks(blocked, states).select("conv", "depth", "bytes", "until", "low", "n")


# Chains


def chain_paths(nodes: DataFrame) -> DataFrame:
    """conv, path: the chains from the root to the conversation's last turn, in order."""
    chains = nodes.groupBy("conv", "low", "n").agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("bottom"),
        F.sum("bytes").alias("bytes"),
        F.min(F.col("until") - F.col("bytes")).alias("before"),
    )
    link = F.struct("top", "bottom", "low", "n", "bytes", "before")
    return chains.groupBy("conv").agg(F.sort_array(F.collect_list(link)).alias("path"))


def chains_of(paths: DataFrame) -> DataFrame:
    """A row per chain, from the path of its smallest member: its place, parent chain, preorder key and children."""
    ending = F.element_at("path", -1)
    own = paths.where(ending["low"] == F.col("conv"))
    changes = F.filter("path", lambda e, i: (i == 0) | (e["low"] != F.get(F.col("path"), i - 1)["low"]))
    labels = F.transform(changes, lambda e: F.struct((-e["top"]).alias("up"), e["low"].alias("low")))
    rows = own.select("conv", "path", labels.alias("labels"), F.posexplode("path").alias("rank", "c")).where("c.low = conv")
    parent = F.get("path", F.col("rank") - 1)
    rows = rows.select("c.*", "rank", "labels", parent["low"].alias("up_low"), parent["n"].alias("up_n"))
    kids = rows.where("up_low IS NOT NULL").groupBy(F.col("up_low").alias("low"), F.col("up_n").alias("n"))
    kids = kids.agg(F.count(F.lit(1)).alias("kids"))
    return rows.join(kids, ["low", "n"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))


# Balanced parentheses


class Parentheses:
    """A shard's parentheses, from the depths of its nodes in preorder, with a range min-max index over the excess."""

    def __init__(self, depth: np.ndarray, last_is_leaf: bool) -> None:
        n = len(depth)
        closes = np.empty(n, np.int64)
        closes[:-1] = np.maximum(depth[:-1] + 1 - depth[1:], 0)
        closes[-1] = 1 if last_is_leaf else 0
        self.at = np.arange(n) + np.concatenate([[0], np.cumsum(closes[:-1])])
        size = int(n + closes.sum())
        self.opens = np.zeros(size, bool)
        self.opens[self.at] = True
        owner = np.cumsum(self.opens) - 1
        self.excess = depth[owner] + 1 - (np.arange(size) - self.at[owner])
        self.depth = depth
        leaf = self.opens[:-1] & ~self.opens[1:]
        self.leaf_pairs = np.concatenate([[0], np.cumsum(leaf), [leaf.sum()]])[: size + 1]  # that begin before a place
        self.opened = np.concatenate([[0], np.cumsum(self.opens)])  # opens before a place
        blocks = -(-size // EXCESS_BLOCK)
        far = np.iinfo(np.int64).max
        padded = np.full(blocks * EXCESS_BLOCK, far)
        padded[:size] = self.excess
        self.blocks = padded.reshape(blocks, EXCESS_BLOCK)
        self.least = [np.append(self.blocks.min(axis=1), far)]
        while 2 ** len(self.least) < 2 * blocks:
            low, reach = self.least[-1], 2 ** (len(self.least) - 1)
            ahead = np.full_like(low, far)
            ahead[: len(low) - reach] = low[reach:]
            self.least.append(np.minimum(low, ahead))

    def find_close(self) -> np.ndarray:
        """Place of each node's closing paren; the sequence's length where the shard does not close it."""
        size = len(self.excess)
        result = np.empty(len(self.depth), np.int64)
        column = np.arange(EXCESS_BLOCK)
        for start in range(0, len(self.depth), QUERIES_AT_ONCE):
            at, goal = self.at[start : start + QUERIES_AT_ONCE], self.depth[start : start + QUERIES_AT_ONCE]
            block, place = at // EXCESS_BLOCK, at % EXCESS_BLOCK
            hit = (self.blocks[block] <= goal[:, None]) & (column > place[:, None])
            near = hit.any(axis=1)
            found = np.where(near, block * EXCESS_BLOCK + hit.argmax(axis=1), size)
            far = np.flatnonzero(~near)
            b, wanted = block[far] + 1, goal[far]
            for k in range(len(self.least) - 1, -1, -1):  # skip runs of blocks whose least excess is too high
                inside = np.minimum(b, len(self.blocks))
                b = np.where(self.least[k][inside] > wanted, b + 2**k, b)
            some = b < len(self.blocks)
            in_block_ = (self.blocks[b[some]] <= wanted[some][:, None]).argmax(axis=1)
            found[far[some]] = b[some] * EXCESS_BLOCK + in_block_
            result[start : start + QUERIES_AT_ONCE] = found
        return result


ITEM = "low long, n long, rank long, leaves long, saved long"
STEP = ITEM + ", done boolean, part long, place long"


def _shard(items: np.ndarray, level: int, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard's items: the rows that are done, those that go on, and the places of these.

    Columns are those of ITEM and 1 for a chain, 0 for a sum of nodes that is no chain of its own.
    """
    rank, own = items[:, 2], items[:, 5] == 1
    parens = Parentheses(rank, bool(level == 0 and items[-1, 3] == 1))
    close = parens.find_close()
    size = len(parens.excess)
    before = np.concatenate([[0], np.cumsum(items[:, 4])])
    stop = parens.opened[close]
    counts = np.concatenate([[0], np.cumsum(items[:, 3])])
    saved = before[stop] - before[:-1]
    if level == 0:  # chains: leaves are the pairs "()" between a chain's ends
        leaves = parens.leaf_pairs[close] - parens.leaf_pairs[parens.at]
    else:  # sums of chains
        leaves = counts[stop] - counts[:-1]
    closed = (close < size) | final
    done = items[own & closed].copy()
    done[:, 3], done[:, 4] = leaves[own & closed], saved[own & closed]
    lowest = np.minimum.accumulate(rank)
    record = np.r_[True, rank[1:] < lowest[:-1]]
    on = np.flatnonzero(record | (own & ~closed))
    if final:
        on = on[:0]
    ends = np.append(on[1:], len(items))
    rest = items[on].copy()
    rest[:, 3], rest[:, 4] = counts[ends] - counts[on], before[ends] - before[on]
    rest[:, 5] = (own & ~closed)[on]
    return done, rest, on


def _merge_step(level: int, final: bool):
    def emit(rows: np.ndarray, done: bool, part: int, place: np.ndarray) -> pa.RecordBatch:
        known = rows[:, 5] == 1
        columns = [pa.array(rows[:, i], mask=~known) for i in (0, 1)] + [pa.array(rows[:, i]) for i in (2, 3, 4)]
        columns += [pa.array(np.full(len(rows), done)), pa.array(np.full(len(rows), part)), pa.array(place)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STEP.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        n = seen = 0

        def out() -> Iterator[pa.RecordBatch]:
            items = np.concatenate(held)
            done, rest, on = _shard(items, level, final)
            yield emit(done, True, part, np.arange(len(done)))
            yield emit(rest, False, part, seen + on)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(5)]
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(np.stack([*columns, known], axis=1))
            n += batch.num_rows
            if n >= SHARD and not final:
                yield from out()
                held, seen, n = [], seen + n, 0
        if held:
            yield from out()

    return run


def subtree_sums(chains: DataFrame) -> DataFrame:
    """low, n, leaves and saved of every chain's subtree, the chain itself included. chains: stored."""
    parts = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    saved = ((F.col("n") - 1) * F.col("bytes")).alias("saved")
    leaf = F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves")
    sorted_ = chains.repartitionByRange(parts, "labels", "top").sortWithinPartitions("labels", "top")
    items = sorted_.select("low", "n", F.col("rank").cast("long").alias("rank"), leaf, saved)
    level, final, left, found = 0, False, None, []
    while True:
        step = stored(items.mapInArrow(_merge_step(level, final), STEP), "spines")
        found.append(step.where("done").select("low", "n", "leaves", "saved"))
        if final:
            break
        rest = step.where("NOT done")
        before, left = left, rest.count()
        # a sequence that one shard holds is the last; so is one that no longer shrinks, as long as its deepest path
        final = left <= SHARD or (before is not None and 2 * left > before)
        pieces = 1 if final else -(-left // SHARD)
        rest = rest.repartitionByRange(pieces, "part", "place").sortWithinPartitions("part", "place")
        items, level = rest.select(*(c.split()[0] for c in ITEM.split(", "))), level + 1
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


# End lists


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (low, n, conv) to texts of up to PIECE ids of one node."""
    for batch in batches:
        low, n, conv = (batch.column(i).to_numpy() for i in range(3))
        if not len(low):
            continue
        run = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (n[1:] != n[:-1])])
        starts = np.unique(np.concatenate([run, *(np.arange(a, b, PIECE) for a, b in zip(run, np.r_[run[1:], len(low)], strict=True) if b - a > PIECE)]))
        ids = conv.tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, np.r_[starts[1:], len(low)], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(low[starts]), pa.array(n[starts]), pa.array(conv[starts]), pa.array(texts, pa.string())],
            ["low", "n", "first", "piece"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash per node; only the running hash is held."""
    node, running = None, None

    def row(done: list) -> pa.RecordBatch:
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["low", "n", "ends"])

    for batch in batches:
        done = []
        for low, n, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (low, n) != node:
                if node:
                    done.append((*node, running.hexdigest()))
                node, running = (low, n), hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        if done:
            yield row(done)
    if node:
        yield row([(*node, running.hexdigest())])


def end_hashes(paths: DataFrame) -> DataFrame:
    """low, n, ends: per node where conversations end, the SHA-256 of their ids."""
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.element_at("path", -1)
    ends = paths.select(last["low"].alias("low"), last["n"].alias("n"), "conv")
    ends = ends.repartitionByRange(parts, "low", "n", "conv").sortWithinPartitions("low", "n", "conv")
    pieces = ends.mapInArrow(_pieces, "low long, n long, first long, piece string")
    pieces = pieces.repartition(parts, "low", "n").sortWithinPartitions("low", "n", "first")
    return pieces.mapInArrow(_hashed, "low long, n long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = stored(members(stored(prefixes(rebuilt(conversations)), "prefixes")), "members")
    paths = stored(chain_paths(nodes), "chain-paths")
    chains = stored(chains_of(paths), "chains")
    whole = chains.drop("labels", "rank").join(subtree_sums(chains), ["low", "n"]).join(end_hashes(paths), ["low", "n"], "left")
    # a chain meets its nodes in ranges of depths, so that one as long as a third of all rows is spread
    band = F.expr(f"depth div {BLOCK_ROWS}")
    bands = F.sequence(F.expr(f"top div {BLOCK_ROWS}"), F.expr(f"bottom div {BLOCK_ROWS}"))
    whole = whole.select("*", F.explode(bands).alias("band")).withColumnRenamed("bytes", "chain_bytes")
    own = nodes.where("conv = low").select("low", "n", "depth", "bytes", "until", band.alias("band"))
    rows = own.join(whole, ["low", "n", "band"])

    def at_bottom(value: Column, otherwise: Column) -> Column:
        return F.when(F.col("depth") == F.col("bottom"), value).otherwise(otherwise)

    above = F.col("until") - F.col("bytes") - F.col("before")  # bytes of the chain's nodes above this one
    return rows.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("up_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        at_bottom(F.col("kids"), F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * above).alias("saved_tokens"),
        at_bottom(F.coalesce("ends", F.lit(EMPTY)), F.lit(EMPTY)).alias("ends_sha256"),
    )


SQL = f"""
    WITH crc_table AS (
        SELECT list(list_reduce(range(8), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
        FROM range(256) AS r(n)
    ), said AS (
        SELECT conv_id AS conv, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
        FROM conversations WHERE conv_id IS NOT NULL
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, mark) - 1 AS pos FROM said
    ), sizes AS (
        SELECT conv, count(*) AS n_own, hex(encode(conv::VARCHAR)) AS x FROM said GROUP BY conv
    ), heads AS (
        SELECT s.conv, s.conv - s.conv % {GROUP} AS base, h, least(h, coalesce(b.n_own, 0)) AS head FROM (
            SELECT conv, xor(4294967295, list_reduce(
                list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::BIGINT),
                lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) % {HEADS} AS h
            FROM sizes, crc_table
        ) AS s LEFT JOIN sizes AS b ON b.conv = s.conv - s.conv % {GROUP}
    ), rebuilt AS (
        SELECT conv, 0 AS depth, '' AS mark, 0 AS bytes FROM heads
        UNION ALL SELECT conv, pos + 1, mark, bytes
            FROM (SELECT h.conv, p.pos, p.mark, p.bytes FROM heads AS h JOIN placed AS p ON p.conv = h.base AND p.pos < h.head)
        UNION ALL SELECT conv, head + pos - h + 1, mark, bytes FROM placed JOIN heads USING (conv) WHERE pos >= h
    ), paths AS (
        SELECT conv, depth, bytes, string_agg(mark, ',') OVER (
            PARTITION BY conv ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM rebuilt
    ), labelled AS (
        SELECT *, min(conv) OVER node AS low, count(*) OVER node AS n FROM paths WINDOW node AS (PARTITION BY depth, prefix)
    ), walked AS (
        SELECT *, lag(low) OVER (PARTITION BY conv ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv) AS deepest
        FROM labelled
    ), nodes AS (
        SELECT low, depth, up, n, (n - 1) * bytes AS saved FROM walked WHERE conv = low
    ), kids AS (
        SELECT up AS low, depth - 1 AS depth, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY ALL
    ), full_nodes AS (
        SELECT n.*, coalesce(kids, 0) AS kids FROM nodes AS n LEFT JOIN kids AS k ON n.low = k.low AND n.depth = k.depth
    ), sums AS (
        SELECT w.low, w.depth, count(*) FILTER (f.kids = 0) AS leaves, sum(f.saved)::BIGINT AS saved
        FROM walked AS w JOIN full_nodes AS f ON f.low = w.conv AND f.depth >= w.depth GROUP BY w.low, w.depth
    ), ends AS (
        SELECT low, depth, sha256(string_agg(conv::VARCHAR, ',' ORDER BY conv)) AS ends FROM walked
        WHERE depth = deepest GROUP BY low, depth
    )
    SELECT f.low AS conv_id, f.depth::BIGINT AS depth, f.up AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
        s.leaves::BIGINT AS n_leaves, s.saved AS saved_tokens, coalesce(e.ends, '{EMPTY}') AS ends_sha256
    FROM full_nodes AS f JOIN sums AS s ON f.low = s.low AND f.depth = s.depth
    LEFT JOIN ends AS e ON f.low = e.low AND f.depth = e.depth"""
