import pandas as pd  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files
from tallyforge.streaming import logs


def test_jsonl_scans(spark, tmp_path):
    schema = spark.createDataFrame([(1, "a")], "k int, v string").schema
    good = tmp_path / "good.jsonl"
    good.write_text('{"k": 1, "v": "a"}\n\n{"k": 2, "v": "b"}\n{"k": 3, "v"')
    assert sorted(r.k for r in files.read_jsonl_tolerant(spark, str(good), schema).collect()) == [1, 2]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"k": 1, "v"\n{"k": 2, "v": "b"}\n')
    with pytest.raises(Exception, match="malformed line"):
        files.read_jsonl_tolerant(spark, str(bad), schema).collect()
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(bad), schema).collect()
    out = str(tmp_path / "out")
    assert files.write_jsonl(spark.range(7).withColumnRenamed("id", "k"), out) == 7


def test_reports_and_logs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Prob001,3,4,75.0,.,.,S,.\nProb002,0,1,0.0\n")
    rows = files.read_ragged_csv(spark, str(tmp_path / "s.csv"), ["problem", "npass", "nsamples", "rate"], "markers").orderBy("problem").collect()
    assert [(r.problem, r.markers) for r in rows] == [("Prob001", [".", ".", "S", "."]), ("Prob002", [])]
    assert files.read_ragged_csv(spark, str(tmp_path / "s.csv"), ["problem"], "rest", header=True).count() == 1
    (tmp_path / "r.txt").write_text("Prob1 [03/04](75%) 1.20 ..S.\npass_rate = 75\n")
    assert files.read_report(spark, str(tmp_path / "r.txt"), r"^(Prob\w+)\s+\[(\d+)/(\d+)\]", ["p", "a", "b"]).first()[:] == ("Prob1", "03", "04")
    folder = tmp_path / "logs" / "x"
    folder.mkdir(parents=True)
    (folder / "Prob1_sample02.log").write_text("one\ntwo")
    (folder / "other.txt").write_text("no")
    assert files.read_logs(spark, str(tmp_path / "logs"), r"(\w+)_sample(\d+)\.log", ["p", "k"]).collect()[0][:] == ("Prob1", "02", "one\ntwo")
    assert files.discover(spark, str(tmp_path / "logs"), "*.*", "other.txt").first().n_files == 2


def test_containers(spark):
    rows = [('{"1": [{"c": true}, {"c": false}]}',), ('{"2": {"0": {"c": true}}}',), ('{"3_sample4": {"c": true}}',)]
    got = files.flatten_samples(spark.createDataFrame(rows, "j string"), "j").select("item", "sample").collect()
    assert sorted((r.item, r.sample) for r in got) == [("1", "0"), ("1", "1"), ("2", "0"), ("3", "4")]


def test_registry_and_mapping(spark):
    r = files.Registry("thing")
    r.register("a")(len)
    assert r.get("a") is len
    with pytest.raises(ValueError):
        r.register("a")(len)
    with pytest.raises(KeyError):
        r.get("b")
    df = spark.createDataFrame([("x", True), (None, True), ("y", False), ("z", None)], "p string, ok boolean")
    good, counts = files.mapped_seeds(df, {"prompt": "p"}, [(F.col("p").isNotNull(), "no_prompt"), (F.col("ok"), "unverified")])
    assert [r.prompt for r in good.collect()] == ["x"]
    assert {r.reason: r["count"] for r in counts.collect()} == {"no_prompt": 1, "unverified": 2}


def test_replay_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [("a", 1, "new"), ("a", 2, "run"), ("a", 3, "new"), ("b", 1, "run"), ("b", 2, "new"), ("a", 2, "run")]
    for i in range(2):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], "e string, s long, st string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("e string, s long, st string").option("maxFilesPerTrigger", 1).parquet(str(src))
    state = logs.replayed(stream, "e", "s", "st", {(None, "new"), ("new", "run")})
    q = state.writeStream.outputMode("update").format("memory").queryName("replay").option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.e: (r.status, r.revision, r.violations) for r in spark.sql("select e, max_by(status, revision * 10 + violations) status, max(revision) revision, max(violations) violations from replay group by e").collect()}
    assert last == {"a": ("run", 2, 1), "b": ("new", 1, 1)}


def test_windows_and_monitor(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", 1, 1.0), ("2024-01-01 00:50:00", 1, 2.0), ("2024-01-01 03:00:00", 1, 4.0)], "ts string, u int, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r.total for r in logs.tumbling(e, "ts", "1 hour").collect()) == [3.0, 4.0]
    assert len(logs.sliding(e, "ts", "2 hours", "1 hour").collect()) == 4
    assert sorted(r.n for r in logs.sessions(e, "ts", "1 hour", "u").collect()) == [1, 2]
    assert {r.level for r in logs.monitor(e, "ts", F.col("value") > 1, "1 hour", "1 hour", 0.3, 0.9).collect()} == {"warn", "halt"}


def test_merge_of_deliveries(spark, tmp_path):
    path = str(tmp_path / "merged")
    write = logs.merge_batches(path, ["id"], ["at"])
    write(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, at int, v string"), 0)
    write(spark.createDataFrame([("a", 3, "z"), ("b", 1, "w")], "id string, at int, v string"), 1)
    assert sorted((r.id, r.v) for r in logs.latest(spark.read.parquet(path), ["id"], ["at"]).collect()) == [("a", "z"), ("b", "w")]


def test_objects_at_any_depth_and_seeds_by_role(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": {"compiled": true}, "b": [{"x": {"compiled": false, "y": {"compiled": 1}}}], "c": 3}'), (2, '[{"compiled": null}]'), (3, "no json"), (4, None)], "k int, j string")
    got = {(r.k, r.path) for r in files.collect_objects(rows, "j", "compiled", "k").collect()}
    assert got == {(1, "a"), (1, "b/0/x"), (2, "0")}
    for name, text in {"d/one/prompt.txt": "p", "d/one/one_ref.sv": "module a;", "d/one/longer_ref.sv": "module b;", "d/two/prompt.txt": "q", "d/two/notes.md": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    seeds = files.seeds_by_role(spark, str(tmp_path / "d"), {"prompt": "^prompt", "reference": r"_ref\.sv$"})
    assert sorted(map(tuple, seeds.collect())) == [("one", "p", "module a;"), ("two", "q", None)]


def test_torn_lines_by_file_and_offset(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("a", LongType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\r\n{"a": 3')
    (tmp_path / "y.jsonl").write_text('{"a": 4}\n{"a": 5}')
    (tmp_path / "z.jsonl").write_text("".join(f'{{"a": {i}}}\n' for i in range(100, 3000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted(r.a for r in files.read_jsonl_tolerant(spark, str(tmp_path), schema).collect())
        assert got == [1, 2, 4, 5, *range(100, 3000)]
        (tmp_path / "w.jsonl").write_text('{"a": 1}\n{"a": \n')
        with pytest.raises(Exception, match="malformed"):
            files.read_jsonl_tolerant(spark, str(tmp_path), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_pivot_csv(spark, tmp_path):
    df = spark.createDataFrame([("m", "a", 1.5), ("m", "b", 2.0), ("n", "a", 3.0), ("n", "a", 4.0), ("o", "x", 1.0)], "model string, task string, rate double")
    files.write_pivot_csv(df, "model", "task", "rate", ["a", "b"], str(tmp_path / "p"))
    got = sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect())
    assert got == [("m", "1.5", "2.0"), ("n", "3.0", None), ("o", None, None)]
