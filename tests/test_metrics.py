import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import correlate, series
from logloom.sources import captures


def make(spark, values, ts=None, path="p"):
    ts = ts or [1000 * i for i in range(len(values))]
    return spark.createDataFrame([(path, t, float(v), i) for i, (t, v) in enumerate(zip(ts, values, strict=True))], "path string, ts_ms long, value double, seq int")


@pytest.mark.parametrize(("ts", "v", "want"), [([0, 1000, 2000, 3000], [100, 200, 350, 500], [100, 150, 150]), ([0, 1000, 2000, 3000], [100, 200, 50, 100], [100, 0, 50]), ([0, 0, 1000], [100, 200, 300], [0, 100]), ([0], [1], [])])
def test_rates(spark, ts, v, want):
    assert [r.value for r in series.rates(make(spark, v, ts), ["seq"]).orderBy("ts_ms", "value").collect()] == want


def test_cumulative_and_definitions(spark):
    s = make(spark, [10, 20, 40], path="serverStatus.opcounters.insert").union(make(spark, [5, 10, 15], path="serverStatus.connections.current")).union(make(spark, [1, 2], path="systemMetrics.disks.nvme0.io_queued_ms")).union(make(spark, [1], path="a.b.c"))
    defs = series.definitions(spark)
    assert defs.count() == 134 and defs.where("is_cumulative").count() == 84 and series.dashboards(spark).where("path <> ''").count() == 146
    got = {r.path: (r.display_name, r.unit, r.is_cumulative, r.threshold) for r in series.with_definitions(s, defs).collect()}
    assert got["serverStatus.opcounters.insert"] == ("Inserts", "ops/s", True, None) and got["serverStatus.connections.current"] == ("Conns Current", "count", False, 5000.0)
    assert got["systemMetrics.disks.nvme0.io_queued_ms"] == ("Disk I/O Queue", "ms/s", True, 500.0) and got["a.b.c"] == ("b.c", "count", False, None)
    rates = series.cumulative_rates(s, defs)
    assert sorted((r.path, r.value) for r in rates.collect()) == [("serverStatus.opcounters.insert", 10.0), ("serverStatus.opcounters.insert", 20.0), ("systemMetrics.disks.nvme0.io_queued_ms", 1.0)]
    assert "systemMetrics.disks.nvme0.io_queued_ms" in {r.path for r in series.dashboard_paths(s, series.dashboards(spark)).where("dashboard = 'Disk I/O'").collect()}


def test_window_stats(spark):
    s = make(spark, [10, 20, 30, 40, 50], [1000, 2000, 3000, 4000, 5000])
    assert tuple(series.window_stats(s, 1000, 5000).select("n", "min", "max", "avg", "p99").first()) == (5, 10, 50, 30, 40)
    assert tuple(series.window_stats(s, 2000, 4000).select("n", "min", "max", "avg").first()) == (3, 20, 40, 30)
    assert series.window_stats(s, 6000, 7000).count() == 0


def test_anomalies_ranges_and_runs(spark):
    s = make(spark, [1, 9000], path="serverStatus.connections.current").union(make(spark, [0.001, 5000, 1], path="serverStatus.opLatencies.reads.latency"))
    defs = series.definitions(spark)
    flagged = {r.dashboard: r.anomaly for r in series.anomalies(s, defs, series.dashboards(spark)).collect()}
    assert flagged["Overview"] is True and not all(flagged.values())
    prof = {r.path: r.log_scale for r in series.range_profile(series.with_definitions(s, defs)).collect()}
    assert prof == {"serverStatus.connections.current": False, "serverStatus.opLatencies.reads.latency": True}
    runs = make(spark, [1, 6000, 7000, 1, 8000], path="serverStatus.connections.current")
    assert sorted(tuple(r)[1:] for r in series.exceedances(series.with_definitions(runs, defs)).collect()) == [(1000, 2000, 2, 7000.0), (4000, 4000, 1, 8000.0)]


def test_lttb(spark):
    assert list(series.lttb_places(np.arange(5.0), 10)) == [0, 1, 2, 3, 4]
    assert len(series.lttb_places(np.arange(1000.0), 50)) == 50
    at = series.lttb_places(np.sin(0.02 * np.arange(500)), 30)
    assert len(at) == 30 and at[0] == 0 and at[-1] == 499
    wave = np.abs((np.arange(1000) % 500) - 250.0)
    at = series.lttb_places(wave, 50)
    assert all(np.min(np.abs(at - x)) <= 15 for x in (250, 500, 750))
    assert series.lttb(make(spark, list(range(300))), 20).count() == 20


def test_lttb_after_a_missing_value(spark):
    values = [float((i * 37) % 101) for i in range(1000)]
    gap = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)] + [("p", 10_000, None), ("q", 1, None)], "path string, ts_ms long, value double")
    gap = gap.union(spark.createDataFrame([("p", -1, None)], gap.schema))
    assert [r.ts_ms for r in series.lttb(gap, 100).orderBy("ts_ms").collect()] == list(series.lttb_places(np.array(values), 100))


def test_nearest(spark):
    s = make(spark, [1, 2, 3, 4, 5], [1000, 2000, 3000, 4000, 5000])
    at = [3000, 2200, 2800, 2500, 0, 9000]
    for span in (500, 3_600_000):
        got = {r.at_ms: r.value for r in correlate.nearest_samples(spark.createDataFrame([("p", t) for t in at], "path string, at_ms long"), s, span_ms=span).collect()}
        assert got == {3000: 3, 2200: 2, 2800: 3, 2500: 2, 0: 1, 9000: 5}
    none = correlate.nearest_samples(spark.createDataFrame([("q", 1)], "path string, at_ms long"), s).first()
    assert none.value is None


def test_intervals(spark):
    e = spark.createDataFrame([(t,) for t in range(0, 200_000, 1000)], "ts_ms long")
    w = spark.createDataFrame([(5000, 70_000, 1), (100_000, 100_000, 2), (9, 3, 3)], "start_ms long, end_ms long, w int")
    assert sorted((r.w, r["count"]) for r in correlate.events_in_windows(e, w).groupBy("w").count().collect()) == [(1, 66), (2, 1)]
    assert correlate.events_near(e, spark.createDataFrame([(60_000,)], "at_ms long")).count() == 61


def element(kind, key, body):
    return bytes([kind]) + key.encode() + b"\0" + body


def document(*parts):
    body = b"".join(parts) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def capture(columns, start):
    """One data document: columns of (path, values)."""
    ref = document(element(9, "start", struct.pack("<q", columns["start"][0])), element(3, "s", document(element(16, "n", struct.pack("<i", columns["s.n"][0])), element(2, "text", struct.pack("<i", 2) + b"x\0"), element(1, "d", struct.pack("<d", columns["s.d"][0] + 0.5)), element(8, "b", b"\1"))))
    count = len(columns["start"]) - 1
    body = b""
    for values in columns.values():
        deltas = [b - a for a, b in zip(values, values[1:], strict=False)]
        zeros = next((i for i, d in enumerate(deltas) if d), count)
        body += varint(zeros) + b"".join(varint((d << 1) ^ (d >> 63)) for d in deltas[zeros:])
    block = ref + struct.pack("<ii", len(columns), count) + body
    payload = struct.pack("<i", len(block)) + zlib.compress(block)
    return document(element(9, "_id", struct.pack("<q", start)), element(16, "type", struct.pack("<i", 1)), element(5, "data", struct.pack("<i", len(payload)) + b"\0" + payload))


def test_capture_round_trip(spark, tmp_path):
    one = {"start": [1000, 2000, 3000, 4000], "s.n": [5, 5, 9, -3], "s.d": [7, 7, 7, 7], "s.b": [1, 1, 1, 0]}
    two = {k: [v + 4000 if k == "start" else v for v in vs] for k, vs in one.items()}
    folder = tmp_path / "diagnostic.data"
    folder.mkdir()
    (folder / "metrics.1").write_bytes(capture(one, 1000) + capture(two, 5000))
    (folder / "metrics.2").write_bytes(capture(one, 1000)[:-20])
    rows = captures.chunks(spark, str(folder))
    assert rows.where("error is not null").count() == 1
    s = series.ordered(captures.samples(rows))
    got = [(r.ts_ms, r.value) for r in s.where("path = 's.n'").orderBy("seq").collect()]
    assert got == [(1000, 5), (2000, 5), (3000, 9), (4000, -3), (5000, 5), (6000, 5), (7000, 9), (8000, -3)]
    assert s.select("path").distinct().count() == 3 and s.where(F.col("schema_mismatch")).count() == 0
    assert tuple(series.time_range(s).first()) == (1000, 8000)
