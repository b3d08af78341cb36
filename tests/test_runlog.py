import math

import pytest
from pyspark.sql import functions as F

from garimpo.operators import mixing as M
from garimpo.operators import runlog as R


def log(spark, values, key="lm_loss"):
    return spark.createDataFrame([("r", i, v) for i, v in enumerate(values, 1)], f"run string, line bigint, {key} double")


def test_final_loss(spark):
    got = R.final_loss(log(spark, [None if i in (3, 7, 12, 19) else float(i) for i in range(1, 21)])).first()
    assert got["n"] == 16 and got["final"] == 19.0
    assert R.final_loss(log(spark, [float(i) for i in range(1, 12)])).first()["final"] == 10.5
    assert R.final_loss(log(spark, [float(i) for i in range(1, 12)]), share=1.0).first()["final"] == 6.0
    assert R.final_loss(log(spark, [None, None])).count() == 0


def test_gates(spark):
    d = spark.createDataFrame([(2.0, 2.006, 2.03)], "r double, a double, b double")
    x = d.select(*(R.gate(F.col("r"), F.col(c), e).alias(f"{c}{int(e)}") for c in "ab" for e in (True, False))).first()
    assert x["a1"]["passed"] and x["a0"]["passed"] and not x["b1"]["passed"] and not x["b0"]["passed"]


def test_spikes(spark):
    got = R.spikes(log(spark, [2.0, 1.0, 1.96, 1.94, math.nan], "loss"), threshold=0.3, beta=0.5).orderBy("line").collect()
    assert [r["spike"] for r in got] == [False, False, True, False, False]
    assert [r["ema"] for r in got] == pytest.approx([2, 1.5, 1.5, 1.72, 1.72])


def test_interval_union(spark):
    d = spark.createDataFrame([("k", 0, 5), ("k", 3, 8), ("k", 4, 6), ("k", 10, 12), ("k", 12, 12), ("z", 1, 2)], "key string, s bigint, e bigint")
    assert {tuple(r) for r in R.interval_union(d, "key", "s", "e").collect()} == {("k", 10), ("z", 1)}


def test_schedules(spark):
    d = spark.createDataFrame([(s,) for s in (0, 5, 10, 79, 80, 90, 99, 100, 150)], "step int")
    got = [r[0] for r in d.select(R.wsd(F.col("step"), 10, 100, 0.2)).collect()]
    assert got == pytest.approx([0, 0.5, 1, 1, 1, 1 - math.sqrt(0.5), 1 - math.sqrt(0.95), 0, 0])
    ramp = [r[0] for r in d.select(R.linear_ramp(F.col("step"), 100, 0.3, 0.1)).collect()]
    assert ramp[0] == pytest.approx(0.3) and ramp[-3] == pytest.approx(0.1) and ramp[-1] == pytest.approx(0.1)
    for bad in ((-1, 10, 0.1), (1, 0, 0.1), (1, 10, 1.1), (9, 10, 0.5)):
        with pytest.raises(ValueError):
            R.wsd(F.col("step"), *bad)


def test_breakdown_lists_every_category(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "c string, v double")
    assert {tuple(r) for r in R.breakdown(d, "c", F.col("v"), ["a", "b"]).collect()} == {("a", 3.0), ("b", 0.0)}


def test_repeated_lines_count_once(spark):
    d = spark.createDataFrame([("r", 1, 2.0, 5), ("r", 1, 9.0, 6), ("r", 2, 3.0, 7)], "run string, line bigint, loss double, received_at int")
    assert sorted(tuple(r) for r in R.first_received(d).select("line", "loss").collect()) == [(1, 2.0), (2, 3.0)]


def test_categories(spark):
    names = {"chunk_fwd": "gdn", "flash_fwd": "attention", "nll_loss_x": "loss", "sm80_gemm": "matmul", "triton_poi_1": "elementwise", "memcpy": "other"}
    d = spark.createDataFrame(list(names.items()), "n string, want string")
    assert d.filter(R.categorize(F.col("n")) != F.col("want")).count() == 0


def test_draws_follow_the_generator():
    plan = M.drawn_order({"a": 10, "b": 10}, {"a": 0.7, "b": 0.3}, 42)
    assert [s for _, s, _ in plan[:8]] == list("aaaababa") and len(plan) == 20
    assert sorted((s, i) for _, s, i in M.drawn_order({"x": 2, "y": 10})) == [("x", 0), ("x", 1), *(("y", i) for i in range(10))]
    for bad in (({}, None), ({"a": 1}, {"a": -1}), ({"a": 1, "b": 1}, {"a": 1})):
        with pytest.raises(ValueError):
            M.drawn_order(*bad)


def test_interleaving_keeps_proportions(spark):
    d = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(400)], "k bigint, s string")
    first = M.interleave(d, "s", "k", {"a": 3.0, "b": 1.0}).orderBy("pace", "s").limit(100).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in first} == {"a": 75, "b": 25}


def test_stream_spikes_equal_batch(spark, tmp_path):
    from garimpo.streaming.windows import stream_spikes

    values = [2.0, 1.0, 1.96, 1.94, 5.0, 1.5, 2.5]
    d = log(spark, values, "loss")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("run string, line bigint, loss double").parquet(str(tmp_path / "in"))
    q = stream_spikes(s, 0.3, 0.5).writeStream.format("memory").queryName("spikes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["line"]: r["spike"] for r in spark.sql("select * from spikes").collect()}
    assert got == {r["line"]: r["spike"] for r in R.spikes(d, threshold=0.3, beta=0.5).collect()}
