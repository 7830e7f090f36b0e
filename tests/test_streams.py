"""The gate's one pass, freshness in a stream, and appends that are whole or nothing."""

import glob
import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.operators import gate
from tallyspark.plans import gates
from tallyspark.sources import appends
from tallyspark.streaming import freshness

SF = "/root/testdata/sf0.001"


def test_gate_counts_beside_its_rows_in_one_scan(spark):
    seen = Observation()
    out = gate.gate(gates.gate_units(spark, SF), seen)
    rows = out.collect()
    got = seen.get
    assert got["problems"] == len(rows) and got["units"] == gates.gate_units(spark, SF).count()
    for kind in ("blocked", "unread", "assembly pending", "survivor missing"):
        assert got[kind] == sum(r["kind"] == kind for r in rows) > 0
    least = min((r["document"], r["unit_no"]) for r in rows)
    assert (got["first"]["document"], got["first"]["unit_no"]) == least
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet") == 1


def test_gate_of_nothing_is_complete(spark):
    none = gates.gate_units(spark, SF).limit(0)
    seen = Observation()
    assert gate.gate(none, seen).collect() == [] and seen.get["problems"] == 0 and seen.get["first"] is None


def test_lineage_names_each_case(spark):
    existing = spark.createDataFrame([("d", "a", ["z"]), ("d", "b", None), ("e", "a", None)], "document string, piece_id string, parents array<string>")
    cases = [
        ("d", 1, "a", ["z"], "kept", None), ("d", 2, "b", None, "kept", None), ("d", 3, "b", None, None, "unknown or repeated id"), ("d", 4, "q", None, None, "unknown or repeated id"),
        ("d", 5, None, ["a", "a"], "split", None), ("d", 6, "", ["a", "b"], "merged", None), ("d", 7, None, ["z"], None, "unknown parent"), ("e", 1, "b", None, None, "unknown or repeated id"), ("e", 2, None, [], "added", None),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "document string, pos int, piece_id string, parents array<string>")
    got = {(r["document"], r["pos"]): (r["lineage"], r["problem"]) for r in gate.submitted_lineage(df, existing).collect()}
    assert got == {c[:2]: c[4:] for c in cases}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_entries_expire_and_late_ones_merge(rocks, tmp_path):
    spark, source = rocks, tmp_path / "in"
    source.mkdir()
    steps = [
        [("a", "r1", "2026-01-01 00:00:00"), ("b", "s1", "2026-01-01 00:00:05")],
        [("a", "r2", "2026-01-01 00:00:30"), ("a", "r1", "2026-01-01 00:00:25"), ("b", "s1", "2026-01-01 00:00:40")],
        [("c", "t1", "2026-01-01 00:01:45")],  # the watermark passes the end of a, not of b
        [("c", "t1", "2026-01-01 00:01:50")],
        [("d", "u1", "2026-01-01 00:01:46")],
    ]
    stream = spark.readStream.schema("key string, revision string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    out = freshness.freshness(stream)
    for k, rows in enumerate(steps):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("key", "revision", "at"), r))) for r in rows))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    q = out.writeStream.format("memory").queryName("freshness").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = sorted((r["key"], r["revision"], r["state"]) for r in spark.table("freshness").collect())
    assert ("a", "r2", "expired") in got and ("a", "r1", "expired") not in got and ("a", "r1", "merged") in got
    assert ("b", "s1", "merged") in got and got.count(("a", "r2", "fresh")) == 1 and ("d", "u1", "fresh") in got
    assert not any(k == "c" and s == "expired" for k, _, s in got)


def lines(path):
    return sorted(json.loads(x)["id"] for f in glob.glob(f"{path}/part-*.jsonl") for x in open(f))


def test_appends_add_up_and_a_failed_one_leaves_nothing(spark, tmp_path):
    name, path = appends.register(spark), str(tmp_path / "log")
    spark.range(20).withColumn("note", F.when(F.col("id") % 2 == 0, "é")).repartition(4).write.format(name).option("stamped", "true").mode("append").save(path)
    spark.range(20, 30).write.format(name).mode("append").save(path)
    assert lines(path) == list(range(30))
    assert all("at" in json.loads(x) for f in glob.glob(f"{path}/part-*.jsonl") for x in open(f) if json.loads(x)["id"] < 20)
    broken = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise("x").alias("note"))
    with pytest.raises(Exception):
        broken.write.format(name).mode("append").save(path)
    assert lines(path) == list(range(30)) and not [f for f in os.listdir(path) if f.startswith(".") and f.endswith(".jsonl")]
    with pytest.raises(Exception):
        spark.range(3).write.format(name).mode("overwrite").save(path)


def test_a_repeated_batch_appends_once(spark, tmp_path):
    name, source, path = appends.register(spark), tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("".join(json.dumps({"id": 10 * k + i}) + "\n" for i in range(5)))

    def run(checkpoint):
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(source)).writeStream.format(name).option("path", path).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run("c")
    want = [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24]
    assert lines(path) == want
    run("c")  # nothing new
    run("another")  # the same batches again, as after a failure between commit and checkpoint
    assert lines(path) == want
