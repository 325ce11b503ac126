from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators.adapters import ADAPTERS, adapt
from corpusloom.sources import tables
from corpusloom.sources.schemas import RAW
from tests.conftest import rows


def test_save_and_reopen(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "train")], "id int, dataset string, split string")
    path = str(tmp_path / "corpus")
    tables.save(df, path)
    assert rows(tables.open_dataset(spark, path).select("id", "dataset", "split")) == rows(df)
    only = tables.read_source(spark, path, split="train")
    assert rows(only.select("id")) == [(1,), (3,)]
    assert "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().executedPlan().toString()


def test_row_cap(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    assert tables.read_source(spark, path, id_col="id", row_cap=7).count() == 7


def test_json_array(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"q": "é", "e": ["a", "b"]}, {"q": None}, {}]), encoding="utf-8")
    got = tables.read_json_array(spark, str(path), "q string, e array<string>")
    assert sorted(map(str, rows(got))) == sorted(map(str, [("é", ["a", "b"]), (None, None), (None, None)]))
    assert tables.read_source(spark, str(path), "q string", format="json").count() == 3
    with pytest.raises(ValueError):
        tables.read_source(spark, str(path), format="json")


def test_json_and_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "q string, a string")
    tables.save_json(df, str(tmp_path / "j"))
    line = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "j").glob("part-*")).strip()
    assert line == '{"q":"é","a":null}'
    tables.save_text(df.select("q"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "é"


def test_materialize(spark, tmp_path):
    path, built = str(tmp_path / "m"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert tables.materialize(spark, build, path).count() == 3
    assert tables.materialize(spark, build, path).count() == 3
    assert len(built) == 1


def test_unreadable_dataset_is_rebuilt(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet")
    assert tables.materialize(spark, lambda: spark.range(2), str(path)).count() == 2


def test_manifest_isolates_failures(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    got = rows(tables.load_all(spark, {"bad": str(tmp_path / "bad"), "good": str(tmp_path / "good"), "none": str(tmp_path / "none")}))
    assert [(r[0], r[1], r[2]) for r in got] == [("bad", "failed", None), ("good", "ok", 4), ("none", "failed", None)]
    assert got[1][3] is None and got[0][3]


def test_read_multi(spark, tmp_path):
    df = spark.range(300).withColumn("config", F.concat(F.lit("c"), F.col("id") % 4))
    df.write.partitionBy("config").parquet(str(tmp_path / "multi"))
    got = tables.read_multi(spark, str(tmp_path / "multi"), "id", ["c0", "c1", "c9"], 50)
    assert rows(got.groupBy("config").count()) == [("c0", 50), ("c1", 50)]


def test_page_texts(spark):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None), ("e", 1, None)], "doc string, n int, t string")
    assert rows(tables.page_texts(pages, "doc", "n", "t")) == [("d", "ab"), ("e", "")]


def test_to_dataset_takes_a_schema(spark):
    assert tables.to_dataset(spark, [(1, None)], "a long, b array<string>").schema.simpleString() == "struct<a:bigint,b:array<string>>"


def test_cut_lineage_keeps_rows_in_the_named_folder(spark):
    df = session.cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5
    root = session.work_dir(spark)
    assert root == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert all(f.startswith(f"file:{root}") or f.startswith(f"file://{root}") for f in df.inputFiles())


def test_local_table_types(spark):
    df = session.local_table(spark, [(1, "a", None, True), (2, None, 3, False)], "i int, s string, n int, b boolean")
    assert df.schema.simpleString() == "struct<i:int,s:string,n:int,b:boolean>"
    assert rows(df) == [(1, "a", None, True), (2, None, 3, False)]


def test_spread_only_small_scans(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert session.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(1_000, numPartitions=40)
    assert session.spread(large) is large


def test_source_ids_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "raw files")
    for part in range(3):
        spark.range(part * 10, part * 10 + 5).coalesce(1).write.mode("append").parquet(path)
    once, again = (rows(tables.with_source_id(spark.read.parquet(path))) for _ in range(2))
    assert once == again and len(once) == 15 == len({r[1] for r in once})
    by_file = {}
    for value, source_id in once:
        by_file.setdefault(source_id // tables.ROWS_PER_FILE, []).append((source_id % tables.ROWS_PER_FILE, value))
    assert sorted(by_file) == [0, 1, 2]
    assert all([v - min(m)[1] for _, v in sorted(m)] == list(range(5)) for m in by_file.values())


def test_catalogued_json(spark, tmp_path):
    data = [
        {"qid": "a", "question": "q", "answer": True, "evidence": ["x", 1]},
        {"qid": "b", "question": "r", "answer": False, "evidence": None},
        {"qid": "c", "question": "s", "evidence": "one"},
    ]
    (tmp_path / "strategyqa").write_text(json.dumps(data))
    raw = tables.open_catalogued(spark, str(tmp_path), "strategyqa")
    assert rows(raw.select("source_id", "evidence")) == [("a", ["x", "1"]), ("b", []), ("c", ["one"])]
    assert [r[3] for r in rows(adapt("strategyqa", raw))] == ["True", "False"]


def test_catalogued_parquet_is_whole_unless_capped(spark, tmp_path):
    answers = spark.range(5_600).select(F.concat(F.lit("q"), "id").alias("question"), F.array(F.lit("a")).alias("answer"))
    answers.write.parquet(str(tmp_path / "nq_open"))
    raw = tables.open_catalogued(spark, str(tmp_path), "nq_open")
    assert adapt("nq_open", raw).count() == 5_600
    capped = tables.open_catalogued(spark, str(tmp_path), "nq_open", row_cap=50)
    assert capped.count() == 50
    with pytest.raises(ValueError):
        tables.read_source(spark, str(tmp_path / "nq_open"), row_cap=5)


def test_materialize_rebuilds_what_was_not_finished(spark, tmp_path):
    path = str(tmp_path / "half")
    spark.range(10).write.parquet(path)
    (tmp_path / "half" / "_SUCCESS").unlink()
    assert tables.materialize(spark, lambda: spark.range(3), path).count() == 3
    assert tables.materialize(spark, lambda: spark.range(7), path).count() == 3
    nothing = str(tmp_path / "nothing")
    for _ in range(2):
        empty = tables.materialize(spark, lambda: spark.range(4).where("id > 9").withColumn("p", F.lit("x")), nothing, ["p"])
        assert empty.count() == 0 and empty.columns == ["id", "p"]


@pytest.mark.parametrize("name", sorted(RAW))
def test_adapters_accept_their_schema(spark, name):
    ddl = RAW[name] if name == "open_assistant" else f"source_id long, {RAW[name]}"
    got = adapt(name, spark.createDataFrame([], ddl))
    assert got.columns == ["source_id", "sample_no", "context", "target", "task"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_adapter_has_a_schema():
    assert set(RAW) <= set(ADAPTERS) and len(RAW) == 33


def test_json_arrays_are_split(spark, tmp_path):
    """Strings with braces, quotes and escapes, nested objects, blanks and several files; equal to the reader that does not split."""
    rng = random.Random(6)
    bits = ["}", "{", '"', "\\", "]", "[", ",", "é漢", "\n", " ", "a", "\\\"", "x: 1"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    ddl = "id long, s string, n struct<a: string, b: array<struct<c: string>>>"
    for number in range(2):
        data = [{"id": number * 1000 + i, "s": text(), "n": {"a": text(), "b": [{"c": text()} for _ in range(i % 4)]}} for i in range(300)]
        data[5] = {"id": number * 1000 + 5}
        whole = json.dumps(data, indent=number or None, ensure_ascii=bool(number))
        (tmp_path / f"part{number}.json").write_text(whole, encoding="utf-8")
    (tmp_path / "empty.json").write_text("[ ]\n")
    expected = spark.read.schema(ddl).option("multiLine", True).json(str(tmp_path / "part*.json"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.read_json_array(spark, str(tmp_path), ddl)
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert rows(got) == rows(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_pieces_are_not_shuffled(spark, tmp_path, monkeypatch):
    """A record longer than several splits, and pieces that only their split's task walks."""
    written = {}
    keep = tables.cut_lineage
    monkeypatch.setattr(tables, "cut_lineage", lambda df, label: written.setdefault(label, df) is None or keep(df, label))
    data = [{"id": i, "s": "{x} \"}" * (4_000 if i == 3 else i % 5)} for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(data))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = tables.read_json_array(spark, str(tmp_path), "id long, s string")
        assert rows(got) == sorted(((r["id"], r["s"]) for r in data), key=lambda r: [(True, str(v)) for v in r])
        plan = written["json-records"]._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
