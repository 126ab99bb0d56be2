"""Stacking in a stream against stacking the whole."""

import json
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from logloom.operators import nodes
from logloom.streaming import stacking

SCHEMA = "ts_ms long, file_idx int, node_idx int, node_set array<int>, line_no long, msg string, severity string, component string, ns string, raw string"
RNG = np.random.default_rng(8)


def make(spark, items):
    return spark.createDataFrame([(t, f, f, [f], n, k, "INFO", "C", None, f"raw{n}") for t, f, n, k in items], SCHEMA)


def told(df):
    return sorted((r["file_idx"], r["line_no"], r["ts_ms"], r["msg"], tuple(r["node_set"]), json.dumps([tuple(a) for a in r["alts"] or []])) for r in df.collect())


def test_settling_in_steps_is_stacking_at_once():
    rows = [{"ts_ms": int(t), "file_idx": int(f), "line_no": i, "node_idx": int(f), "nodes": f"[{f}]", "alts": None, "entry": "{}", "leads": False} for i, (t, f) in enumerate(zip(RNG.integers(0, 90, 200), RNG.integers(0, 4, 200), strict=True))]
    copy = lambda: [dict(r) for r in rows]
    for window in (0, 1, 5):
        whole, left = stacking.settle(copy(), 10_000, window)
        assert not left and len(whole) < 200
        done, held, at = [], [], -1
        for until in range(0, 200, 7):
            held += [r for r in copy() if at < r["ts_ms"] <= until + 3]
            out, held = stacking.settle(held, until, window)
            done, at = done + out, until + 3
        key = lambda r: r["line_no"]
        assert sorted(done, key=key) == sorted(whole, key=key)


def test_stream_of_batches_equals_the_whole(spark, tmp_path):
    """Three batches, a late entry among them, and one that moves the watermark past them."""
    items = [(int(t), i % 3, i, None if i % 5 == 0 else "km"[i % 2]) for i, t in enumerate(np.sort(RNG.integers(1_000_000, 1_030_000, 150)) // 10 * 10)]
    items += [(t + 1, (f + 1) % 3, 1000 + n, k) for t, f, n, k in items[::2]]
    items.sort()
    late = items.pop(len(items) // 2 - 3)
    batches = [items[: len(items) // 3], items[len(items) // 3 : len(items) // 2], [*items[len(items) // 2 :], late, (-1, 0, 9999, "m")], [(9_000_000, 0, 10_000, "end")], [(9_900_000, 0, 10_001, "end")]]
    source, out, states = tmp_path / "in", str(tmp_path / "out"), []
    for i, b in enumerate(batches):
        make(spark, b).coalesce(1).write.mode("append").parquet(str(source))
        stream = stacking.stack_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), 1, "20 seconds")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        progress = [p for p in q.recentProgress if p["numInputRows"]]
        assert sum(p["numInputRows"] for p in progress) <= 2 * len(b), i  # timed and untimed entries; no old ones
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = told(spark.read.parquet(out).where("ts_ms < 9000000"))
    assert got == told(nodes.stacked(make(spark, [x for b in batches[:3] for x in b])))
    assert any(len(json.loads(r[5])) for r in got) and states[-1] < 10 < len(items)


def test_one_long_island(spark):
    """Entries a millisecond apart for long are one island; only open leaders are held."""
    items = [(t, t % 2, t, "m") for t in range(6000)]
    got = nodes.stacked(make(spark, items)).agg(F.count("*"), F.sum(F.size("node_set"))).first()
    assert tuple(got) == (3000, 6000)
    files = spark.createDataFrame([("a", 0, 5, "h", 1), ("b", 1, 5, "h", 1)], "file_path string, file_idx int, node_idx int, hostname string, port int")
    both = nodes.with_nodes(nodes.stacked(make(spark, items[:4] + [(9000, 7, 1, "x")])), files)
    assert [(r["node_idx"], r["node_set"]) for r in both.collect()] == [(5, [5])] * 2


def test_stacking_over_borders_of_batches(spark):
    """Every entry once: leaders with nodes, alternatives in order and columns of their own, against a plain search."""
    schema = SCHEMA + ", more struct<a:int,b:array<string>>"
    items = [(int(t), int(f), i, "km"[i % 2], None if i % 3 else "n") for i, (t, f) in enumerate(zip(RNG.integers(0, 150, 400), RNG.integers(0, 4, 400), strict=True))] + [(-1, 0, 999, "m", None)]
    df = spark.createDataFrame([(t, f, f, [f, f + 1][:: 1 - 2 * (n % 2)], n, k, "INFO", "C", ns, f"raw{n}", (n, [k])) for t, f, n, k, ns in items], schema)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        for window in (0, 1, 5):
            want, leaders = {}, {}
            for t, f, n, k, ns in sorted(items):
                to = next((x for x in leaders.get((k, ns), []) if 0 <= t - x[0] <= window and x[1] != f), None) if t >= 0 else None
                if to is None:
                    leaders.setdefault((k, ns) if t >= 0 else None, []).append((t, f, n))
                    want[n] = ([f, f + 1][:: 1 - 2 * (n % 2)], [])
                else:
                    nodes_, alts = want[to[2]]
                    want[to[2]] = (sorted({*nodes_, f, f + 1}), [*alts, (f, f, n, f"raw{n}")])
            got = nodes.stacked(df, window).collect()
            assert {r.line_no: (r.node_set, [tuple(a) for a in r.alts or []]) for r in got} == want and len(got) == len(want)
            assert all(tuple(r.more) == (r.line_no, [r.msg]) and (r.alts is None or r.alts) for r in got)
    finally:
        spark.conf.set(size, before)


def test_crowded_instant_is_not_quadratic(spark):
    """60,000 equal entries of either file at one instant: the first takes all of the other file."""
    df = spark.range(120_000).selectExpr("1000L AS ts_ms", "int(id % 2) AS file_idx", "int(id % 2) AS node_idx", "array(int(id % 2)) AS node_set", "id AS line_no", "'m' AS msg", "'I' AS severity", "'C' AS component", "CAST(NULL AS string) AS ns", "'r' AS raw")
    began = time.monotonic()
    got = nodes.stacked(df).agg(F.count("*"), F.max(F.size("alts")), F.sum(F.size("node_set"))).first()
    assert tuple(got) == (60_000, 60_000, 60_001) and time.monotonic() - began < 60


def test_kept_tables_are_deleted(spark):
    from logloom import store

    a = store.keep(spark.range(5), "five")
    path = a.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert a.count() == 5 and Path(path).exists()
    assert store.clear(spark) >= 1 and not Path(path).exists() and store.clear(spark) == 0
