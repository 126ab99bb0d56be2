"""A cluster's table: loading in parts gives what loading at once gives."""

import json

import numpy as np
from pyspark.sql import functions as F

from logloom.operators import breakdowns as b
from logloom.operators import nodes
from logloom.sources import cluster, logs

RNG = np.random.default_rng(2)


def line(ms, msg="Slow query", severity="I", **attr):
    iso = str(np.datetime64(ms, "ms")) + "+00:00"
    return json.dumps({"t": {"$date": iso}, "s": severity, "c": "COMMAND", "id": 1, "ctx": "conn1", "msg": msg, "attr": attr})


def lines_of(spark, files):
    return spark.createDataFrame([(path, i + 1, raw) for path, own in files.items() for i, raw in enumerate(own)], "file_path string, line_no long, raw string")


def told(df):
    return sorted((r["ts_ms"], r["msg"] or "", r["file_idx"], r["line_no"], tuple(r["node_set"]), json.dumps([tuple(a) for a in r["alts"] or []])) for r in df.collect())


def counts(df):
    return sorted(tuple(r) for r in df.select("dimension", "label", "count").collect())


def test_append_equals_one_load(spark, tmp_path):
    day = cluster.DAY_MS
    files = {}
    for k in range(4):
        times = np.sort(RNG.integers(19_000 * day, 19_006 * day, 60) // 7_200_000 * 7_200_000 + RNG.integers(0, 3, 60))
        times = np.concatenate([times, [19_003 * day - 1 + k, 19_004 * day - 1 + k % 2]])  # chains over midnight
        files[f"/l/n{k}/m.log"] = [line(int(t), "km"[i % 2], "IWE"[i % 3], ns="a.b") for i, t in enumerate(times)] + ["broken", json.dumps({"t": "x", "s": "I", "msg": "no time"})]
    names = sorted(files)
    at_once, in_parts = str(tmp_path / "once"), str(tmp_path / "parts")
    everything = lines_of(spark, files)
    assert cluster.append_lines(spark, at_once, everything) == 1
    for i, upto in enumerate(([0], [0, 1, 2], [0, 1, 2, 3])):
        assert cluster.append_lines(spark, in_parts, lines_of(spark, {names[k]: files[names[k]] for k in upto})) == i + 1
    assert cluster.append_lines(spark, in_parts, everything) == 3  # nothing new
    whole = told(cluster.cluster_entries(spark, at_once))
    assert told(cluster.cluster_entries(spark, in_parts)) == whole and any(json.loads(r[5]) for r in whole)
    assert counts(cluster.cluster_breakdowns(spark, in_parts)) == counts(cluster.cluster_breakdowns(spark, at_once)) == counts(b.breakdowns(cluster.cluster_entries(spark, at_once)))
    plain = logs.parse_log_lines(everything.join(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file_path string, file_idx int"), "file_path"))
    assert whole == told(nodes.stacked(plain.withColumn("node_idx", F.col("file_idx")).withColumn("node_set", F.array("node_idx"))))
    assert cluster.cluster_nodes(spark, in_parts).count() == 4


def test_append_reads_touched_days_only(spark, tmp_path):
    day, folder = cluster.DAY_MS, str(tmp_path / "t")
    cluster.append_lines(spark, folder, lines_of(spark, {"/l/a": [line(d * day + 5, "m") for d in range(100, 130)]}))
    cluster.append_lines(spark, folder, lines_of(spark, {"/l/b": [line(110 * day + 6, "m"), line(200 * day, "m", "E")]}))
    made = spark.read.parquet(f"{folder}/stacked")
    assert {(r["version"], r["day"]) for r in made.select("version", "day").distinct().collect()} == {(1, d) for d in range(100, 130)} | {(2, 110), (2, 200)}
    got = cluster.cluster_entries(spark, folder)
    assert got.count() == 31 and [r["node_set"] for r in got.where("alts is not null").collect()] == [[0, 1]]
    assert {r["severity"] for r in got.collect()} == {"INFO", "ERROR"}
    # a run that was cut short before its number is not seen, and is made again
    spark.range(3).write.parquet(f"{folder}/files/version=3")
    assert cluster.cluster_entries(spark, folder).count() == 31
    assert cluster.append_lines(spark, folder, lines_of(spark, {"/l/c": [line(300 * day)]})) == 3 and cluster.cluster_entries(spark, folder).count() == 32


def test_files_of_one_host_are_one_node(spark, tmp_path):
    host = json.dumps({"t": {"$date": "2024-01-01T00:00:00.000+00:00"}, "s": "I", "msg": "Process Details", "attr": {"host": "h.example.com:27017"}})
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text(host + "\n" + line(1_700_000_000_000) + "\n")
    folder = str(tmp_path / "t")
    for name in ("a", "b"):
        cluster.append_files(spark, folder, str(tmp_path / f"{name}.log"), stack=False)
    found = cluster.cluster_nodes(spark, folder).collect()
    assert len(found) == 1 and found[0]["hostname"] == "h.example.com" and len(found[0]["merged_paths"]) == 2
    assert {(r["file_idx"], r["node_idx"]) for r in cluster.cluster_entries(spark, folder).collect()} == {(0, 0), (1, 0)}


def test_places_of_equal_times(spark):
    rows = [(int(t), int(f), i) for i, (t, f) in enumerate(zip(RNG.integers(0, 20, 500), RNG.integers(0, 3, 500), strict=True))]
    df = spark.createDataFrame(rows, "ts_ms long, file_idx int, line_no long").repartition(6)
    want = {r: i for i, r in enumerate(sorted(rows))}
    got = logs.places(df, df.where("line_no % 7 = 0"))
    assert {tuple(r)[:3]: r["idx"] for r in got.collect()} == {r: i for r, i in want.items() if r[2] % 7 == 0}
    assert logs.places(df, df.where("false")).count() == 0


def test_files_of_a_folder(spark, tmp_path):
    for name in ("b.log", "a.log", ".hidden", "_odd", "metrics.1"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    found = [(r["path"].rsplit("/", 1)[1], r["kind"]) for r in logs.folder_files(spark, str(tmp_path)).collect()]
    assert found == [("_odd", "log"), ("a.log", "log"), ("b.log", "log"), ("metrics.1", "capture")]
    many = spark.createDataFrame([(d, f"l{i:02}", 100 - i % 9) for d in ("severity", "ns") for i in range(60)], "dimension string, label string, count int")
    got = b.reports(many).groupBy("dimension").agg(F.count("*").alias("n"), F.min_by("label", "pos").alias("first")).collect()
    assert sorted(map(tuple, got)) == [("ns", 50, "l00"), ("severity", 12, "l00")]
