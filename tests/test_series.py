"""Scans, ranks and hulls over series that are cut into many tasks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators import correlate, ranks, scan, series

RNG = np.random.default_rng(3)


@pytest.fixture()
def cut(spark):
    """Partitions stay as small as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def many(spark, n=4000, hot=0.8, values=None):
    """One path with most samples, short ones, times that repeat."""
    path = np.where(RNG.random(n) < hot, "hot", np.char.add("p", RNG.integers(0, 9, n).astype(str)))
    ts = RNG.integers(0, n, n)
    value = RNG.integers(-5, 40, n).astype(float) if values is None else values
    return spark.createDataFrame([(str(p), int(t), float(v), i) for i, (p, t, v) in enumerate(zip(path, ts, value, strict=True))], "path string, ts_ms long, value double, seq int").repartition(7)


def test_previous_is_that_of_a_window(cut):
    df = many(cut).unionByName(cut.createDataFrame([(None, 5, 1.0, -1), (None, 4, 2.0, -2)], "path string, ts_ms long, value double, seq int"))
    w = Window.partitionBy("path").orderBy("ts_ms", "seq")
    want = df.withColumn("prev", F.lag(F.struct("ts_ms", "value")).over(w)).withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    got = scan.with_previous(df, "path", ["ts_ms", "seq"], ["ts_ms", "value"])
    assert df.repartitionByRange("path", "ts_ms").rdd.getNumPartitions() == 13
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert scan.with_previous(df.where("false"), "path", ["ts_ms"], ["value"]).count() == 0


def test_no_task_holds_a_series(cut):
    df = cut.range(20_000).select(F.lit("hot").alias("path"), F.col("id").alias("ts_ms"), F.col("id").cast("double").alias("value"))
    sizes = [r["count"] for r in scan.in_order(df, "path", ["ts_ms"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 13 and max(sizes) < 4000


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.98, 1.0])
def test_runs_above_over_borders(cut, share):
    n = 3000
    above = RNG.random(n) < share
    df = many(cut, n, 0.7, np.where(above, 10.0 + np.arange(n), 1.0)).withColumn("threshold", F.when(F.col("path") != "p3", 5.0))
    got = sorted(tuple(r) for r in series.exceedances(df, ["seq"]).collect())
    want, held = [], None
    for r in sorted(df.where("threshold is not null").collect(), key=lambda r: (r["path"], r["ts_ms"], r["seq"])):
        if held and (held[0] != r["path"] or r["value"] <= 5):
            want.append(tuple(held))
            held = None
        if r["value"] > 5:
            held = [r["path"], held[1] if held else r["ts_ms"], r["ts_ms"], (held[3] if held else 0) + 1, max(held[4] if held else 0, r["value"])]
    want += [tuple(held)] if held else []
    assert got == sorted(want)


def test_missing_values_are_left_out(spark):
    s = spark.createDataFrame([("p", 1000 * i, v) for i, v in enumerate([10.0, 20.0, None, 40.0, float("nan"), 70.0])] + [("q", 0, None)], "path string, ts_ms long, value double")
    assert [(r["ts_ms"], r["value"]) for r in series.rates(s).orderBy("ts_ms").collect()] == [(1000, 10.0), (3000, 10.0), (5000, 15.0)]
    assert [tuple(r) for r in series.window_stats(s, 0, 9000).collect()] == [("p", 4, 10.0, 70.0, 35.0, 40.0)]
    assert [tuple(r) for r in series.last_values(s.where("ts_ms <= 4000")).collect()] == [("p", 40.0, 3000)]
    runs = series.exceedances(s.withColumn("threshold", F.lit(15.0)))
    assert [tuple(r) for r in runs.collect()] == [("p", 1000, 5000, 3, 70.0)]
    near = correlate.nearest_samples(spark.createDataFrame([("p", 2000), ("p", 4100), ("q", 0)], "path string, at_ms long"), s, tie=())
    assert sorted((r["path"], r["at_ms"], r["ts_ms"], r["value"]) for r in near.where("path = 'p'").collect()) == [("p", 2000, 1000, 20.0), ("p", 4100, 5000, 70.0)]
    assert near.where("path = 'q'").first()["value"] is None


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "infinite"])
def test_ranks_by_refinement(cut, kind):
    values = {"uniform": RNG.random(3000), "heavy": np.exp(RNG.normal(0, 60, 3000)), "ties": RNG.integers(0, 3, 3000).astype(float), "infinite": RNG.choice([-np.inf, -1e308, 0, 1e308, np.inf], 3000)}[kind]
    df = many(cut, 3000, 0.8, values)
    wanted = {"median": lambda n: F.floor(n / 2), "p99": lambda n: F.floor(0.99 * (n - 1)), "least": lambda n: F.lit(0), "most": lambda n: n - 1}
    want = {}
    for r in df.collect():
        want.setdefault(r["path"], []).append(r["value"])
    want = {k: (v[len(v) // 2], v[int(0.99 * (len(v) - 1))], v[0], v[-1]) for k, v in ((k, sorted(v)) for k, v in want.items())}
    for how in ({}, {"cuts": 7, "few": 20}):
        got = ranks.at_ranks(df, "path", "value", wanted, **how)
        assert {r["path"]: (r["median"], r["p99"], r["least"], r["most"]) for r in got.collect()} == want


@pytest.mark.parametrize("most", [2, 3, 4, 17, 100, 5000])
def test_lttb_by_hulls(cut, most):
    n = 2500
    cases = {"walk": np.cumsum(RNG.integers(-3, 4, n)), "ties": RNG.integers(0, 2, n), "flat": np.zeros(n), "parabola": (np.arange(n) - 900) ** 2, "spikes": np.where(RNG.random(n) < 0.01, 1000, 0), "short": np.arange(5)}
    rows = [(k, i, float(x)) for k, v in cases.items() for i, x in enumerate(v)]
    got = {}
    for r in series.lttb(cut.createDataFrame(rows, "path string, ts_ms long, value double").repartition(5), most).collect():
        assert r["ts_ms"] == r["place"] and r["value"] == cases[r["path"]][r["place"]]
        got.setdefault(r["path"], []).append(r["place"])
    for k, v in cases.items():
        assert sorted(got[k]) == list(series.lttb_places(v.astype(float), most)), k


def test_hulls_are_small():
    x = np.arange(100_000.0)
    assert len(series.hull(x, RNG.normal(size=100_000))) < 100
    assert list(series.hull(x[:5], np.array([0.0, 1, 2, 3, 4]))) == [0, 4]


def test_long_windows_are_few_rows(spark):
    year = 365 * 86_400_000
    windows = spark.createDataFrame([(5, 3 * year, 1), (10, 10, 2), (1000, 60_000, 3), (7, 3, 4), (-year, year // 7, 5), (None, 5, 6)], "start_ms long, end_ms long, w int")
    cells = correlate.window_cells(windows)
    assert max(r["count"] for r in cells.groupBy("w").count().collect()) < 100
    entries = spark.createDataFrame([(int(t),) for t in RNG.integers(-year, 4 * year, 3000)] + [(10,), (60_000,), (1000,), (5,), (None,)], "ts_ms long")
    got = sorted((r["w"], r["ts_ms"]) for r in correlate.events_in_windows(entries, windows).collect())
    spans = windows.collect()
    want = sorted((w, t) for (t,) in entries.collect() for a, b, w in spans if None not in (a, t) and a <= t <= b)
    assert got == want and len({w for w, _ in want}) == 4
    assert correlate.events_in_windows(entries, windows.where("false")).count() == 0


def test_nearest_samples_of_one_dense_span(spark):
    """30,000 samples and probes in one span; no frame may be read again for each row, nor samples of other paths be dealt out."""
    n = 30_000
    s = spark.range(n).selectExpr("'p' AS path", "id * 100 AS ts_ms", "double(id) AS value").union(spark.range(n).selectExpr("'other' AS path", "id * 100 AS ts_ms", "-1D AS value"))
    probes = spark.range(n).selectExpr("'p' AS path", "id * 100 + id % 100 AS at_ms")
    got = correlate.nearest_samples(probes, s)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
    off = got.where("value <> at_ms div 100 + int(at_ms % 100 > 50 and at_ms div 100 < 29999)")
    assert got.count() == n and off.count() == 0
    wide = correlate.nearest_samples(spark.range(1500).selectExpr("concat('q', id) AS path", "5 AS at_ms").union(probes.limit(1)), s)
    assert {(r.path, r.value) for r in wide.where("value is not null").collect()} == {("p", 0.0)} and wide.count() == 1501
