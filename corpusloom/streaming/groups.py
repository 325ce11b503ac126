"""Adapters that need whole groups, on streams: each micro-batch works on the groups that it touches.

Rows are kept in buckets of bounded size, and so are the samples made of them. A batch reads the buckets of the groups
that its rows belong to, makes their samples anew and writes these buckets under the batch's number; a manifest, written
last, names the version of every bucket. Readers follow the latest manifest, so they see one batch's state or the
next one's and never none, and a batch that is repeated after a fault starts from its predecessor's manifest and
overwrites its own versions. What a batch costs follows its rows and the groups they touch, not the rows so far.

Two kinds of groups:

- Threads (``open_assistant``). Children may land before their parents, so rows are kept by fragment: the messages that hang
  together so far, named by the topmost. An index, in buckets by key, tells the fragment of a message id and the
  fragments that wait for one. A batch joins the fragments it links and moves them to the bucket of their new top.
  Buckets are prefixes of a hash; one that outgrows ``bucket_rows`` is cut by one more hex digit.
- Runs (``kjv_bible``). A verse's sample depends on the few rows before it in the order of ``source_id``. Buckets
  are ranges of ``source_id``; a batch takes the ranges it lands in and enough neighbours on both sides.

Versions that no kept manifest names are removed by ``vacuum``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.adapters import SOURCE_ID, adapt, thread_samples
from corpusloom.operators.threads import thread_links, thread_nodes
from corpusloom.operators.windows import CONTEXT_ROWS
from corpusloom.session import cut_lineage, local_table

BUCKET_ROWS = 1_000_000
DIGITS = "0123456789abcdef"
MANIFEST = "store string, bucket string, version bigint, n_rows bigint"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def last_batch(spark: SparkSession, out: str, below: int | None = None) -> int | None:
    """The latest batch (before ``below``) whose manifest is complete."""
    for batch in reversed(_children(spark, f"{out}/_manifest", "batch=")):
        if below is None or batch < below:
            path, files = _path(spark, f"{out}/_manifest/batch={batch}/_SUCCESS")
            if files.exists(path):
                return batch
    return None


@dataclass
class Store:
    """Buckets of rows under one folder, as one manifest has them; ``bucket`` is a column of what is written."""

    spark: SparkSession
    out: str
    name: str
    schema: T.StructType
    buckets: dict[str, tuple[int, int]] = field(default_factory=dict)  # bucket: version, rows
    rows_read: int = 0

    def read(self, wanted: set[str]) -> DataFrame:
        there = [b for b in sorted(wanted) if self.buckets.get(b, (0, 0))[1]]
        self.rows_read += sum(self.buckets[b][1] for b in there)
        paths = [f"{self.out}/{self.name}/v={self.buckets[b][0]}/bucket={b}" for b in there]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, buckets: set[str], batch_id: int) -> None:
        """``rows`` are all that the ``buckets`` hold from this batch on."""
        folder = f"{self.out}/{self.name}/v={batch_id}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.StringType())]))
        counts = {r["bucket"]: r["count"] for r in written.parquet(folder).groupBy("bucket").count().collect()}
        for bucket in buckets:
            self.buckets[bucket] = (batch_id, counts.get(bucket, 0))

    def of(self, keys: DataFrame) -> DataFrame:
        """key to (key, bucket) for buckets that are prefixes of the key's hash."""
        lengths = sorted({len(b) for b in self.buckets})
        tried = F.array(*[F.substring(hashed("key"), 1, n) for n in lengths])
        known = local_table(self.spark, [(b,) for b in sorted(self.buckets)], "bucket string")
        return keys.select("key", F.explode(tried).alias("bucket")).join(known, "bucket")

    def touched(self, keys: DataFrame) -> set[str]:
        return {r["bucket"] for r in self.of(keys).select("bucket").distinct().collect()}

    def split(self, sizes: DataFrame, most: int) -> set[str]:
        """Cut buckets that hold more than ``most`` rows of several keys by one more digit; the new buckets."""
        made = set()
        for r in sizes.filter((F.col("n_rows") > most) & (F.col("n_keys") > 1)).collect():
            del self.buckets[r["bucket"]]
            for digit in DIGITS:
                self.buckets[r["bucket"] + digit] = (0, 0)
                made.add(r["bucket"] + digit)
        return made


def hashed(key: Column | str) -> Column:
    return F.md5(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")))


def _load(stores: list[Store], batch: int | None) -> None:
    if batch is None:
        return
    spark, out = stores[0].spark, stores[0].out
    for r in spark.read.schema(MANIFEST).parquet(f"{out}/_manifest/batch={batch}").collect():
        for store in stores:
            if store.name == r["store"]:
                store.buckets[r["bucket"]] = (r["version"], r["n_rows"])


def _commit(stores: list[Store], batch_id: int) -> None:
    """The manifest of the batch; its marker, written last, makes the batch's versions the current ones."""
    rows = [(s.name, b, v, n) for s in stores for b, (v, n) in sorted(s.buckets.items())]
    rows.append(("rows read", "", batch_id, sum(s.rows_read for s in stores)))
    table = local_table(stores[0].spark, rows, MANIFEST)
    table.coalesce(1).write.mode("overwrite").parquet(f"{stores[0].out}/_manifest/batch={batch_id}")


def _with_batch(schema: T.StructType, *more: str) -> T.StructType:
    extra = [T.StructField(name, T.StringType()) for name in more]
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType()), *extra])


def write_threads(batch: DataFrame, batch_id: int, out: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """One micro-batch of messages; see the module."""
    spark = batch.sparkSession
    came = cut_lineage(batch.filter(F.col("message_id").isNotNull()).withColumn("batch", F.lit(batch_id).cast("long")), "arrived")
    sample_schema = thread_samples(spark.createDataFrame([], batch.schema)).drop("root_id").schema
    rows = Store(spark, out, "rows", _with_batch(batch.schema, "fragment"))
    index = Store(spark, out, "index", T.StructType.fromDDL("key string, fragment string"))
    samples = Store(spark, out, "samples", _with_batch(sample_schema, "fragment"))
    stores = [rows, index, samples]
    _load(stores, last_batch(spark, out, batch_id))
    for store in stores[:2]:
        if not store.buckets:
            store.buckets.update({digit: (0, 0) for digit in DIGITS})

    def keys(df: DataFrame) -> DataFrame:
        both = F.array(F.col("message_id").cast("string"), F.col("parent_id").cast("string"))
        return df.select(F.explode(both).alias("key")).filter(F.col("key").isNotNull()).distinct()

    asked = keys(came)
    known = index.read(index.touched(asked)).join(asked, "key", "left_semi")
    old = cut_lineage(known.select("fragment").distinct(), "touched-fragments")
    from_buckets = rows.touched(old.select(F.col("fragment").alias("key")))
    messages = rows.read(from_buckets).join(old, "fragment", "left_semi").drop("fragment").unionByName(came)
    messages = cut_lineage(messages, "touched-messages")

    # the fragments that these messages form now
    nodes = thread_nodes(messages, "message_id", "parent_id", "text", SOURCE_ID if SOURCE_ID in batch.columns else None)
    tops = thread_links(nodes).select(F.col("id").alias("message_id"), F.col("root").cast("string").alias("_top"))
    placed = messages.join(tops, "message_id", "left")
    placed = cut_lineage(placed.withColumn("fragment", F.coalesce("_top", F.col("message_id").cast("string"))).drop("_top"), "placed-messages")

    # rows: the touched buckets without the old fragments, and the new ones in theirs
    to_buckets = from_buckets | rows.touched(placed.select(F.col("fragment").alias("key")).distinct())
    content = rows.read(to_buckets).join(old, "fragment", "left_anti").unionByName(placed)

    def dealt(df: DataFrame, store: Store, key: str) -> DataFrame:
        place = store.of(df.select(F.col(key).alias("key")).distinct()).withColumnRenamed("key", key)
        return df.join(place, key)

    before = samples.read(to_buckets).join(old, "fragment", "left_anti")
    sizes = dealt(content, rows, "fragment").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("fragment").alias("n_keys")
    )
    cut = rows.split(sizes, bucket_rows)
    to_buckets = (to_buckets & set(rows.buckets)) | cut
    made = thread_samples(messages.drop("batch")).withColumnRenamed("root_id", "fragment")
    own = SOURCE_ID if SOURCE_ID in batch.columns else "message_id"
    arrival = messages.groupBy(F.col(own).alias(SOURCE_ID)).agg(F.max("batch").alias("batch"))
    made = made.withColumn("fragment", F.col("fragment").cast("string")).join(arrival, SOURCE_ID)
    rows.replace(dealt(content, rows, "fragment"), to_buckets, batch_id)
    samples.replace(dealt(before.unionByName(made), rows, "fragment"), to_buckets, batch_id)
    samples.buckets = {b: v for b, v in samples.buckets.items() if b in rows.buckets}

    # index: a message's fragment, and by its parent's id each fragment that waits for that parent
    both = F.array_distinct(F.array(F.col("message_id").cast("string"), F.col("parent_id").cast("string")))
    entries = placed.select(F.explode(both).alias("key"), "fragment").filter(F.col("key").isNotNull()).distinct()
    index_buckets = index.touched(entries.select("key").distinct())
    stays = index.read(index_buckets).join(old, "fragment", "left_anti")
    entries = cut_lineage(stays.unionByName(entries), "index-entries")
    sizes = dealt(entries, index, "key").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_keys")
    )
    cut = index.split(sizes, bucket_rows)
    index.replace(dealt(entries, index, "key"), (index_buckets & set(index.buckets)) | cut, batch_id)
    _commit(stores, batch_id)


def write_runs(batch: DataFrame, batch_id: int, out: str, name: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """One micro-batch of rows whose samples depend on the CONTEXT_ROWS rows before them in the order of source_id."""
    spark = batch.sparkSession
    came = cut_lineage(batch.withColumn("batch", F.lit(batch_id).cast("long")), "arrived")
    rows = Store(spark, out, "rows", _with_batch(batch.schema))
    sample_schema = adapt(name, spark.createDataFrame([], batch.schema)).schema
    samples = Store(spark, out, "samples", _with_batch(sample_schema))
    stores = [rows, samples]
    _load(stores, last_batch(spark, out, batch_id))
    range_of = F.expr(f"cast({SOURCE_ID} div {int(bucket_rows)} as string)")
    landed = {int(r[0]) for r in came.select(range_of).distinct().collect()}

    # non-empty ranges in order, with the rows known so far; neighbours until they hold a whole context
    sizes = {int(b): n for b, (_, n) in rows.buckets.items() if n}
    order = sorted(set(sizes) | landed)
    place = {b: i for i, b in enumerate(order)}

    def neighbours(step: int) -> set[int]:
        found: set[int] = set()
        for b in landed:
            i, n = place[b] + step, 0
            while 0 <= i < len(order) and n < CONTEXT_ROWS:
                found.add(order[i])
                n += sizes.get(order[i], 0)
                i += step
        return found

    after = neighbours(1)
    context = landed | after | neighbours(-1)
    for b in list(after):  # what is made anew behind a batch needs its own context, which may begin in another range
        context.add(b)
    near = rows.read({str(b) for b in context}).unionByName(came).withColumn("bucket", range_of)
    near = cut_lineage(near, "touched-rows")
    anew = {str(b) for b in landed | after}
    arrival = near.groupBy(SOURCE_ID).agg(F.max("batch").alias("batch"))
    made = adapt(name, near.drop("batch", "bucket")).join(arrival, SOURCE_ID).withColumn("bucket", range_of)
    landed_rows = near.filter(F.col("bucket").isin(sorted(str(b) for b in landed)))
    rows.replace(landed_rows, {str(b) for b in landed}, batch_id)
    samples.replace(made.filter(F.col("bucket").isin(sorted(anew))), anew, batch_id)
    _commit(stores, batch_id)


def read_samples(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The samples of all rows so far, as the latest complete batch left them, with the batch their own row came in."""
    store = Store(spark, out, "samples", _with_batch(schema))
    _load([store], last_batch(spark, out))
    return store.read(set(store.buckets))


def vacuum(spark: SparkSession, out: str, keep: int = 2) -> int:
    """Remove versions that none of the last ``keep`` manifests names; returns how many bucket folders went."""
    kept = [b for b in _children(spark, f"{out}/_manifest", "batch=") if b <= (last_batch(spark, out) or 0)][-keep:]
    if not kept:
        return 0
    manifests = reduce(DataFrame.unionByName, [spark.read.schema(MANIFEST).parquet(f"{out}/_manifest/batch={b}") for b in kept])
    named = {(r["store"], r["version"], r["bucket"]) for r in manifests.collect()}
    gone = 0
    for store in ("rows", "index", "samples"):
        for version in _children(spark, f"{out}/{store}", "v="):
            folder, files = _path(spark, f"{out}/{store}/v={version}")
            for status in files.listStatus(folder):
                bucket = status.getPath().getName()
                if version <= kept[-1] and bucket.startswith("bucket=") and (store, version, bucket.removeprefix("bucket=")) not in named:
                    files.delete(status.getPath(), True)
                    gone += 1
    return gone
