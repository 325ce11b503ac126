from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.adapters import adapt
from corpusloom.plans.queries import DOCUMENTS_SCHEMA, QUERIES
from corpusloom.session import fresh_path
from corpusloom.streaming import groups, streams
from tests.conftest import rows

EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
SCHEMA = "source_id long, input string, target string, value double"


@pytest.fixture()
def landed(spark, tmp_path):
    """Rows landing in three files, so that a stream of one file per batch runs three batches."""
    rng = random.Random(1)
    folder = tmp_path / "landed"
    for part in range(3):
        data = [(part * 100 + i, f" q{i} ", rng.choice(["a", " ", None]), i / 4) for i in range(30)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, landed):
    return streams.read_stream(spark, landed, SCHEMA, files_per_batch=1)


@pytest.mark.parametrize("n", [5, 40, 1_000])
def test_take(spark, landed, n):
    out = fresh_path(spark, "out")
    streams.stream_take(stream(spark, landed), F.col("source_id") % 2 == 0, "source_id", n, out, fresh_path(spark, "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == min(n, 45)
    assert got.filter("source_id % 2 = 1").count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_queries_read_tables_of_one_file_or_of_several(spark, tmp_path, files):
    docs = [(i, f"text {i}", "en" if i % 2 else "de", "src1", 6) for i in range(30)]
    events = [(i, None, i % 3, "view", i / 4, "{}") for i in range(30)]
    for name, data, ddl in (("documents", docs, DOCUMENTS_SCHEMA), ("events", events, EVENTS_SCHEMA)):
        written = spark.createDataFrame(data, ddl).coalesce(files)
        written.write.parquet(f"{tmp_path}/parts/{name}.parquet")
        if files == 1:
            (part,) = (tmp_path / "parts" / f"{name}.parquet").glob("*.parquet")
            (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    folder = str(tmp_path if files == 1 else tmp_path / "parts")
    assert {r["doc_id"] for r in QUERIES["str_filter_take"](spark, folder).collect()} == set(range(1, 30, 2))
    assert QUERIES["str_adapt"](spark, folder).count() == 30
    assert {(r["run"], r["n_batches"]) for r in QUERIES["str_running_loss"](spark, folder).collect()} == {(0, 10), (1, 10), (2, 10)}


def test_take_does_not_exceed_after_a_restart(spark, landed):
    out, checkpoint = fresh_path(spark, "out"), fresh_path(spark, "cp")
    for _ in range(2):
        streams.stream_take(stream(spark, landed), F.lit(True), "source_id", 35, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 35


def test_adapted_stream_equals_batch(spark, landed):
    out = fresh_path(spark, "out")
    adapted = streams.adapt_stream(stream(spark, landed), "bbh")
    streams.stream_to_table(adapted, out, fresh_path(spark, "cp")).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(adapt("bbh", spark.read.schema(SCHEMA).parquet(landed)))


def test_grouped_adapters_are_refused(spark, landed):
    for name in streams.GROUPED_ADAPTERS:
        with pytest.raises(ValueError):
            streams.adapt_stream(stream(spark, landed), name)


def test_running_loss_equals_batch(spark, landed):
    out = fresh_path(spark, "out")
    runs = stream(spark, landed).withColumn("run", F.col("source_id") % 7)
    streams.running_loss_stream(runs, "run", "value", out, fresh_path(spark, "cp")).awaitTermination()
    batch = spark.read.schema(SCHEMA).parquet(landed).groupBy((F.col("source_id") % 7).alias("run"))
    expected = batch.agg(F.avg("value").alias("a"), F.count("value").alias("n"))
    assert rows(streams.latest_loss(spark, out, "run")) == rows(expected)


def test_group_adapters_run_per_batch(spark, tmp_path):
    folder, out = str(tmp_path / "verses"), fresh_path(spark, "out")
    ddl = "source_id long, Book string, Chapter int, Text string"
    for book in range(2):
        data = [(book * 100 + i, f"b{book}", i // 6, f"v{i}") for i in range(18)]
        spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(folder)
    verses = streams.read_stream(spark, folder, ddl, files_per_batch=1)
    streams.adapt_group_stream(verses, "kjv_bible", out, fresh_path(spark, "cp")).awaitTermination()
    got = groups.read_samples(spark, out, adapt("kjv_bible", spark.createDataFrame([], ddl)).schema)
    assert {r["batch"] for r in got.collect()} == {0, 1}
    assert rows(got.drop("batch")) == rows(adapt("kjv_bible", spark.read.schema(ddl).parquet(folder)))


@pytest.mark.parametrize("files", [1, 2, 3])
def test_groups_cut_over_batches_equal_batch(spark, tmp_path, files):
    """Every chapter and every thread lies in three files; children may land before their parents."""
    verse, message = "source_id long, Book string, Chapter int, Text string", "message_id long, parent_id long, role string, text string"
    verses = [(i, f"b{i // 12}", i // 6 % 2, f"v{i}") for i in range(24)]
    thread = [(t * 10 + i, t * 10 + i - 1 if i else None, ("prompter", "assistant")[i % 2], f"t{t}m{i}") for t in range(4) for i in range(6)]
    for name, ddl, data in (("kjv_bible", verse, verses), ("open_assistant", message, thread)):
        folder, out = str(tmp_path / name), fresh_path(spark, "out")
        for part in (2, 0, 1):
            spark.createDataFrame(data[part::3], ddl).coalesce(1).write.mode("append").parquet(folder)
        landed = streams.read_stream(spark, folder, ddl, files_per_batch=files)
        streams.adapt_group_stream(landed, name, out, fresh_path(spark, "cp"), bucket_rows=5).awaitTermination()
        whole = adapt(name, spark.createDataFrame(data, ddl))
        assert rows(whole) and rows(groups.read_samples(spark, out, whole.schema).drop("batch")) == rows(whole)


MESSAGE = "message_id long, parent_id long, role string, text string"


def _land(spark, out, batches):
    for number, data in enumerate(batches):
        groups.write_threads(spark.createDataFrame(data, MESSAGE), number, out, bucket_rows=8)


def test_threads_that_merge_late_and_turn_in_rings(spark):
    """Tops land last, a fragment waits for two messages, a ring of parents closes, and a batch is repeated."""
    out = fresh_path(spark, "out")
    say = lambda i, up, text="t": (i, up, "assistant" if i % 2 else "prompter", f"{text}{i}")
    batches = [
        [say(3, 2), say(5, 4), say(11, 10)],
        [say(4, 3), say(10, 12), (2, 1, "prompter", "")],
        [say(12, 11), say(1, None), (2, 1, "prompter", "now with a text")],
    ]
    _land(spark, out, batches[:2])
    groups.write_threads(spark.createDataFrame(batches[1], MESSAGE), 1, out, bucket_rows=8)  # repeated
    assert groups.last_batch(spark, out) == 1
    groups.write_threads(spark.createDataFrame(batches[2], MESSAGE), 2, out, bucket_rows=8)
    rows_so_far = [r for b in batches for r in b if r[3]]
    whole = adapt("open_assistant", spark.createDataFrame(rows_so_far, MESSAGE))
    assert rows(whole) and rows(groups.read_samples(spark, out, whole.schema).drop("batch")) == rows(whole)
    assert groups.vacuum(spark, out, keep=1) > 0
    assert rows(groups.read_samples(spark, out, whole.schema).drop("batch")) == rows(whole)


def test_a_batch_costs_what_it_touches(spark):
    """Rows read by a batch stay the same while the rows so far grow; buckets are cut as they fill."""
    out = fresh_path(spark, "out")
    batches = [[(b * 10 + i, b * 10 + i - 1 if i else None, "assistant", f"{b}-{i}") for i in range(4)] for b in range(12)]
    _land(spark, out, batches)
    manifests = spark.read.schema(groups.MANIFEST).parquet(*[f"{out}/_manifest/batch={b}" for b in range(12)])
    read = {r["version"]: r["n_rows"] for r in manifests.filter("store = 'rows read'").collect()}
    last = spark.read.schema(groups.MANIFEST).parquet(f"{out}/_manifest/batch=11").filter("store = 'rows'").collect()
    assert max(read[b] for b in range(8, 12)) <= 5 * 4 * 8 and max(r["n_rows"] for r in last) <= 8 + 4
    assert sum(r["n_rows"] for r in last) == 48
