"""SimHash near-duplicates by bit-sliced comparison, and their connected components.

Fingerprints are 64-bit, linked at RADIUS or fewer differing bits. Only distinct fingerprints are compared, so a group
of exact copies costs one row. If two differ in at most two bits, at least two of their four 16-bit blocks are equal:
each fingerprint goes to six buckets (two blocks each), buckets above TILE rows are cut into pairs of tiles, and each
tile is compared in vertical bit planes. A tile gives one link per fingerprint to the smallest one it hangs together
with, never all pairs; components follow from rounds of large-star and small-star, each written to the shared folder.

Null texts and texts without words have fingerprint zero and are linked like any other. Repeated rows give repeated
rows. A null doc_id never names a component unless its component has no other id; then component_id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import byte_texts, per_batch, stored

WORDS = 3
SEED = 42
RADIUS = 2
BITS = 64
TILE = 4096
PAIRS_AT_ONCE = 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def shingle_hashes(text: bytes, n: int = WORDS) -> list[int]:
    words = text.lower().split()  # ASCII blanks and A-Z only: these are bytes
    if not words:
        return []
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(n)), strict=False)]


def simhashes(texts: list[bytes]) -> np.ndarray:
    """Fingerprints as signed 64-bit integers. Bits are counted by the 256 values of each byte, then by a small product."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for start in range(0, len(texts), 512):
        hashes = [np.array(shingle_hashes(t), dtype=np.uint64) for t in texts[start : start + 512]]
        sizes = np.array([len(h) for h in hashes])
        n = len(sizes)
        if not sizes.sum():
            continue
        row = np.repeat(np.arange(n), sizes) * 256
        octets = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
        found = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            seen = np.bincount(row + octets[:, k], minlength=n * 256).reshape(n, 256)
            majority = (2 * (seen @ _BYTE_BITS) > sizes[:, None]).astype(np.uint64)
            found |= (majority << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
        out[start : start + n] = found
    return out.view(np.int64)


def _fingerprint_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = simhashes(byte_texts(batch.column("text")))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) of every row."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(per_batch(_fingerprint_batch), "doc_id long, fp long")


def bucket_keys(fp: Column) -> Column:
    """Six keys: two of four blocks, and which two."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(
        *(
            F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
            for n, (i, j) in enumerate(pairs)
        )
    )


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Blocks of 64 rows stored vertically: plane b of a block holds bit b of each of its lanes."""
    blocks = -(-len(fps) // BITS)
    lanes = np.zeros(blocks * BITS, dtype=np.uint64)
    lanes[: len(fps)] = fps
    lanes = lanes.reshape(blocks, BITS)
    one, place = np.uint64(1), np.arange(BITS, dtype=np.uint64)
    return np.stack([(((lanes >> np.uint64(b)) & one) << place).sum(axis=1, dtype=np.uint64) for b in range(BITS)])


def lanes_below(n: np.ndarray) -> np.ndarray:
    """Bit sets of the first n lanes, n cut to 0..64."""
    n = np.clip(n, 0, BITS)
    return np.where(n == BITS, ALL, (np.uint64(1) << (n % BITS).astype(np.uint64)) - np.uint64(1))


def near_lanes(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """For each (query, block): the wanted lanes within RADIUS bits, as a bit set.

    Carry-save counters take one plane after the other for 64 distances at a time; a count that reaches three sets its
    lane's overflow bit for good. A block whose lanes have all overflowed is abandoned.
    """
    result = np.zeros(len(queries), dtype=np.uint64)
    left = np.arange(len(queries))
    ones, twos = np.zeros_like(result), np.zeros_like(result)
    over = ~lanes
    for b in range(BITS):
        wanted = np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1))
        differs = planes[b][block] ^ wanted
        twos ^= ones & differs
        ones ^= differs
        over |= ones & twos
        if b % 8 == 7:
            open_ = over != ALL
            if not open_.all():
                left, queries, block, ones, twos, over = (x[open_] for x in (left, queries, block, ones, twos, over))
            if not len(left):
                break
    result[left] = ~over
    return result


def tile_roots(fps: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, one it hangs together with) within each group. Rows come sorted by group, then side.

    side 0: rows that are all compared with each other; 1 and 2: two tiles, compared with each other only.
    """
    fps = fps.view(np.uint64)
    n = len(fps)
    run = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[run[1:], n]
    run_of = np.repeat(np.arange(len(run)), ends - run)
    planes = planes_of(fps)
    # a row meets the rows before it in its run (side 0), or all rows of the other tile (side 1)
    after = np.minimum(run_of + 1, len(run) - 1)
    crossing = (side == 1) & (group[run[after]] == group) & (side[run[after]] == 2)
    first = np.where(crossing, run[after], run[run_of])
    last = np.where(crossing, ends[after], np.where(side == 0, np.arange(n), first))  # exclusive
    meets = np.where(last > first, (last - 1) // BITS - first // BITS + 1, 0)
    root = np.arange(n)
    total = np.r_[0, np.cumsum(meets)]
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, total[row] + PAIRS_AT_ONCE, side="right")) - 1)
        rows = np.repeat(np.arange(row, stop), meets[row:stop])
        if len(rows):
            block = first[rows] // BITS + (np.arange(len(rows)) + total[row] - total[rows])
            wanted = lanes_below(last[rows] - block * BITS) & ~lanes_below(first[rows] - block * BITS)
            hits = near_lanes(fps[rows], planes, block, wanted)
            some = np.flatnonzero(hits)
            bits = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(bits)
            root = merged(root, rows[some[pair]], block[some[pair]] * BITS + lane)
        row = stop
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked].view(np.int64), fps[root[linked]].view(np.int64)


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each connected set, after the links (a, b)."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of a partition sorted by (key, tile, side); a tile that spans batches is held until it is whole."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)])
        a, b = tile_roots(np.ascontiguousarray(rows[:, 3]), group, rows[:, 2])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        change = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))
        same = held and (held[-1][-1, :2] == rows[0, :2]).all()
        if held and not same:
            yield out(np.concatenate(held))
            held = []
        if len(change):
            cut = change[-1] + 1
            yield out(np.concatenate([*held, rows[:cut]]))
            held = [rows[cut:]]
        else:
            held.append(rows)
    if held:
        yield out(np.concatenate(held))


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within RADIUS bits; distinct: column fp."""
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    slot = F.pmod(F.xxhash64("fp"), slots).cast("int")
    other = F.sequence(F.lit(0), slots - 1)
    # tile = smaller slot * slots + larger slot; a tile with itself compares all its rows, others compare two sides
    tiles = F.transform(
        other,
        lambda j: F.struct(
            (F.least(slot, j) * slots + F.greatest(slot, j)).cast("long").alias("tile"),
            F.when(slot == j, 0).when(slot < j, 1).otherwise(2).cast("long").alias("side"),
        ),
    )
    dealt = keyed.join(sizes, "key").select("key", "fp", F.explode(tiles).alias("t"))
    dealt = dealt.select("key", F.col("t.tile").alias("tile"), F.col("t.side").alias("side"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile", "side", "fp")
    return sorted_.mapInArrow(_links, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component with a link, by alternating large-star and small-star.

    Each round is a few aggregates and joins on node keys and is written, so a lost executor repeats one round.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        directed = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        around = directed.union(e.select(F.least("u", "v"), F.greatest("u", "v"))) if both else directed
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(low, "u")
        if both:  # larger neighbours go to the smallest one around
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # smaller neighbours, and the node itself
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        return moved.where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    edges = stored(edges.where("u <> v").distinct(), "links")
    before = state(edges)
    while before[0]:
        edges = stored(star(star(edges, True), False), "star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def roots_of(prints: DataFrame, *first: Column) -> DataFrame:
    """fp, root of every fingerprint, and the given aggregates over the rows that have it. prints: stored."""
    distinct = prints.groupBy("fp").agg(*first)
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return joined.select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = stored(fingerprints(docs), "simhash")
    member = roots_of(prints, F.min("doc_id").alias("least"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest doc_id (null last), and of several
    with that id the one with the smallest hash of all its columns.

    So rows that share an id but not a component all have a say, and of rows that are equal throughout one stays.
    """
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), whole.alias("tie"))
    rows = rows.withColumn("id", F.col("row.doc_id").cast("long"))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tie")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(simhashes(byte_texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), found], ["id", "tie", "fp"])

    texts = rows.select("id", "tie", F.col("row.text").cast("string").alias("text"))
    prints = stored(texts.mapInArrow(printed, "id long, tie long, fp long"), "simhash")
    member = roots_of(prints, F.min(place).alias("least"))
    kept = member.groupBy("root").agg(F.min("least").alias("k")).select(
        F.col("k.unnamed").alias("unnamed"), F.coalesce("k.id", F.lit(0)).alias("id"), F.col("k.tie").alias("tie")
    )
    keyed = rows.select("row", F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), "tie")
    survivors = keyed.join(kept, ["unnamed", "id", "tie"], "left_semi").dropDuplicates(["unnamed", "id", "tie"])
    return survivors.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
