import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import logtext as lt
from logloom.functions.flatten import flatten_json, key_rules, with_key_labels
from logloom.functions.shapes import query_shape
from logloom.operators import breakdowns as b
from logloom.operators import filters, nodes
from logloom.operators.filters import EntryFilter
from logloom.plans import analyses
from logloom.sources import logs
from logloom.streaming import ingest


def line(i, s="I", c="COMMAND", ctx="main", msg="m", ts=None, **attr):
    return json.dumps({"t": {"$date": ts or f"2024-01-15T10:00:{i:02d}.000+00:00"}, "s": s, "c": c, "id": 1, "ctx": ctx, "msg": msg, "attr": attr})


TEN = [
    line(0, "I", "STORAGE", "main", "opening data files"),
    line(1, "I", "NETWORK", "conn31", "client arrived", ns="crm.people", client={"driver": {"name": "d", "version": "1"}}),
    line(2, "W", "INDEX", "conn31", "no usable index", ns="crm.people", durationMillis=120),
    line(3, "I", "QUERY", "conn31", "Slow query", ns="crm.people", durationMillis=800, command={"$db": "crm", "find": "people", "filter": {"age": 3}}),
    line(4, "E", "QUERY", "conn58", "cursor lost", ns="crm.invoices", durationMillis=7),
    line(5, "I", "QUERY", "conn58", "Slow query", ns="crm.invoices", durationMillis=200, command={"$db": "crm", "findandmodify": "invoices", "query": {"age": 9}}),
    line(6, "E", "QUERY", "conn58", "cursor lost", ns="crm.invoices", durationMillis=9),
    line(7, "F", "STORAGE", "main", "disk is full"),
    line(8, "D", "NETWORK", "conn77", "bytes on the wire"),
    line(9, "W", "INDEX", "conn31", "no usable index", ns="crm.people", durationMillis=130),
]


def entries_of(spark, rows):
    df = spark.createDataFrame([("/f/a.log", 0, 0, i, r) for i, r in enumerate(rows)], "file_path string, file_idx int, node_idx int, line_no long, raw string")
    return logs.with_index(logs.parse_log_lines(df).withColumn("node_set", F.array("node_idx")))


@pytest.fixture(scope="module")
def ten(spark):
    return entries_of(spark, TEN).cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_timestamps(spark):
    texts = ["2024-01-15T10:30:45.123+00:00", "2024-01-01T00:00:00.000+00:00", "2024-01-15T10:30", "", None, "2024-01-01T00:00:00.000+02:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lt.epoch_ms(F.col("t"))).collect()] == [1705314645123, 1704067200000, -1, -1, -1, 1704067200000]
    assert df.select(lt.epoch_ms(F.col("t"), True)).collect()[5][0] == 1704067200000 - 7200_000


def test_scalar_functions(spark):
    df = spark.createDataFrame([("conn12x conn3", "h.x:27017", "/a/b/mongod.log.2024-01-15T00-00-00"), ("xconn", "h:p", "/a/metrics.1"), (None, "plain", "x.log")], "ctx string, host string, path string")
    got = df.select(lt.connection_id(F.col("ctx")).alias("c"), lt.host_and_port(F.col("host")).alias("h"), lt.file_group(F.col("path")).alias("g"), lt.is_capture_path(F.col("path")).alias("m"), lt.file_stem(F.col("path")).alias("s")).collect()
    assert [r.c for r in got] == [12, 0, 0]
    assert [tuple(r.h) for r in got] == [("h.x", 27017), ("h:p", 0), ("plain", 0)]
    assert tuple(got[0].g) == ("/a/b", "mongod.log") and got[1].m and not got[0].m and got[2].s == "x"


def test_threshold_bands(spark):
    df = spark.createDataFrame([(1.0, None), (7.0, 10.0), (7.5, 10.0), (10.0, 10.0), (11.0, 10.0), (0.0, 0.0), (1.0, 0.0)], "v double, t double")
    assert [r[0] for r in df.select(lt.threshold_band(F.col("v"), F.col("t"))).collect()] == ["none", "green", "yellow", "yellow", "red", "green", "red"]


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("", ""), ('"hello"', "{str}"), ("42", "{int}"), ("3.14", "{num}"), ("true", "{bool}"), ("null", "{null}"), ('{"b":1,"a":2}', "{a:{int},b:{int}}"), ('{"a":{"b":1}}', "{a:{b:{int}}}"),
        ("[1,2,3]", "[{int},{int},{int}]"), ("{}", "{}"), ("[]", "[]"), ('{"$oid":"x"}', "{oid}"), ('{"$regex":"^a","$options":"i"}', "{regex}"), ('{"$options":"i","$regex":"x"}', "{$options:{str},$regex:{str}}"),
        ("not json at all", "not json at all"), ('{"status":"active","age":{"$gt":25},"_id":{"$oid":"1"}}', "{_id:{oid},age:{$gt:{int}},status:{str}}"),
    ],
)
def test_query_shapes(text, shape):
    assert query_shape(text) == shape


def test_parse(ten, spark):
    got = {r.idx: r for r in ten.collect()}
    assert (got[3].severity, got[3].ns, got[3].duration_ms, got[3].conn_id, got[3].op_type, got[3].shape) == ("INFO", "crm.people", 800, 31, "find", "{age:{int}}")
    assert got[0].duration_ms == -1 and got[1].driver == "d 1" and got[7].conn_id == 0 and (got[5].op_type, got[5].shape) == ("findAndModify", "{age:{int}}")
    bad = spark.createDataFrame([("f", TEN[0]), ("f", "NOT VALID JSON"), ("f", '{"msg":"no time"}'), ("f", TEN[1]), ("g", "x")], "file_path string, raw string")
    assert rows(logs.parse_health(logs.with_fields(bad))) == [("f", 2, 2, False), ("g", 0, 1, True)]
    assert entries_of(spark, []).count() == 0


def test_summary_and_breakdowns(ten):
    s = b.summary(ten).first()
    assert (s.total, s.with_ns, s.slow, s.latest_ms - s.earliest_ms) == (10, 7, 2, 9000)
    counts = {(r.dimension, r.label): r["count"] for r in b.breakdowns(ten).collect()}
    assert counts["severity", "INFO"] == 4 and counts["component", "QUERY"] == 4 and counts["ns", "crm.people"] == 4 and ("op_type", None) not in counts
    assert rows(b.by_connection(ten)) == [(31, 4), (58, 3), (77, 1)] and b.distinct_connections(ten).first()[0] == 3


@pytest.mark.parametrize("indexed", [True, False])
def test_analyses(ten, indexed):
    e = ten if indexed else ten.drop("idx")
    idx = lambda **p: [r.idx for r in analyses.analyse("search_logs", e, **p)["entries"].collect()]
    assert idx(severity="ERROR") == [4, 6] and idx(component="QUERY") == [3, 4, 5, 6] and idx(text="Slow") == [3, 5] and idx(limit=2) == [0, 1] and idx(component="") == []
    slow = analyses.analyse("slow_queries", e)
    assert tuple(slow["totals"].first()) == (2, 1000, 800, 500)
    r = slow["shapes"].first()
    assert (r["shape"], r["count"], r.min_ms, r.max_ms, r.p50, r.p99) == ("{age:{int}}", 2, 200, 800, 800, 800)
    errors = analyses.analyse("error_details", e)
    assert [(r.msg, r["count"], r.severity, r.first_idx, r.samples) for r in errors["groups"].collect()] == [("cursor lost", 2, "ERROR", 4, [4, 6]), ("no usable index", 2, "WARN", 2, [2, 9])]
    assert tuple(errors["totals"].first()) == (2, 2)
    assert analyses.analyse("error_details", e, severity="nothing")["groups"].count() == 0
    assert [r.node_idx for r in analyses.analyse("analysis_summary", e)["nodes"].collect()] == [0]
    assert analyses.analyse("entry_detail", ten, entry_index=3)["entry"].first().raw == TEN[3]
    for error, call in ((IndexError, ("entry_detail", ten, 999999)), (KeyError, ("nope", ten, None)), (ValueError, ("search_logs", None, None))):
        with pytest.raises(error):
            analyses.analyse(call[0], call[1], **({"entry_index": call[2]} if call[2] else {}))
    assert json.loads(analyses.as_json(slow)["totals"].first()[0])["count"] == 2


def test_filters(ten):
    got = lambda **f: sorted(r.idx for r in EntryFilter(**f).apply(ten).collect())
    assert got(severity="error", components=["QUERY"]) == [4, 6] and got(slow_only=True) == [3, 5] and got(conn_ids=[58]) == [4, 5, 6] and got(nodes=[1]) == []
    assert got(drivers=["zz"], driver="d 1") == [1] and got(min_duration_ms=0) == [2, 3, 4, 5, 6, 9] and got() == list(range(10)) and not EntryFilter().active
    index = filters.trigram_index(ten)
    for q in ("CURSOR", "ble ind", "zzz", "re"):
        assert sorted(r.idx for r in filters.indexed_search(ten, index, q).collect()) == got(text=q)
    assert sorted(r.idx for r in ten.where(filters.error_selection("BOTH")).collect()) == [2, 4, 6, 9] and ten.where(filters.error_selection("x")).count() == 0


def test_percentiles_follow_sorted_ranks(spark):
    e = entries_of(spark, [line(i % 60, msg="Slow query", durationMillis=(i * 37) % 211, command={"find": "x", "filter": {"a": 1}}) for i in range(150)])
    d = sorted((i * 37) % 211 for i in range(150))
    r = b.slow_by_shape(e, first=None).first()
    assert (r.p50, r.p99, r.avg_ms) == (d[75], d[148], sum(d) // 150)


def brute_stack(items, window=1):
    """items: (ts, file, line, key); the surviving (file, line) with their node sets."""
    items = sorted(items)
    taken, out = set(), {}
    for i, (t, f, n, k) in enumerate(items):
        if i in taken:
            continue
        nodes_ = {f}
        for j in range(i + 1, len(items)):
            if items[j][0] - t > window:
                break
            if j not in taken and items[j][1] != f and items[j][3] == k:
                taken.add(j)
                nodes_.add(items[j][1])
        out[f, n] = sorted(nodes_)
    return out


def test_stacking(spark):
    items = [(1000 + (i * 7) % 40, i % 3, i, "k" if i % 4 else None) for i in range(120)]
    df = spark.createDataFrame([(t, f, f, [f], n, k, "INFO", "C", None, f"raw{n}") for t, f, n, k in items], "ts_ms long, file_idx int, node_idx int, node_set array<int>, line_no long, msg string, severity string, component string, ns string, raw string")
    got = nodes.stacked(df)
    assert {(r.file_idx, r.line_no): sorted(r.node_set) for r in got.collect()} == brute_stack(items)
    assert got.agg(F.sum(F.size("node_set"))).first()[0] <= 120
    chain = spark.createDataFrame([(t, f, f, [f], t, "m", "I", "C", "n", "r") for t, f in ((0, 0), (1, 1), (2, 2))], df.schema)
    assert {(r.file_idx, tuple(r.node_set)) for r in nodes.stacked(chain).collect()} == {(0, (0, 1)), (2, (2,))}
    one = logs.with_index(nodes.stacked(chain))
    assert {r.raw for r in nodes.raw_of_node(one, 0, 1).collect()} == {"r"}
    half = ingest.restack(chain.where("ts_ms < 1"), chain.where("ts_ms >= 1"))
    assert {(r.file_idx, tuple(r.node_set)) for r in half.collect()} == {(0, (0, 1)), (2, (2,))}


def test_restacking_equals_stacking_the_whole(spark):
    schema = "ts_ms long, file_idx int, node_idx int, node_set array<int>, line_no long, msg string, severity string, component string, ns string, raw string"
    make = lambda items: spark.createDataFrame([(t, f, f, [f], n, k, "INFO", "C", None, f"raw{n}") for t, f, n, k in items], schema)
    cases = [([(999, 0, 1, "m"), (1000, 1, 2, "m")], [(2500, 0, 3, "m")], 1), ([((i * 37) % 900, i % 3, i, "km"[i % 2]) for i in range(150)], [((i * 53) % 900, i % 3, 1000 + i, "km"[i % 2]) for i in range(12)], 3)]
    cases.append(([(5, 0, 1, "m"), (-1, 0, 2, "m")], [(-1, 1, 3, "m")], 1))
    told = lambda df: sorted((r.file_idx, r.line_no, tuple(r.node_set)) for r in df.collect())
    for old, new, window in cases:
        want = told(nodes.stacked(make(old + new), window))
        assert told(ingest.restack(make(old), make(new), window)) == want
        assert told(ingest.restack(make(old), make(new), window, nodes.stacked(make(old), window))) == want


def test_identity_and_merge(spark):
    detail = json.dumps({"t": {"$date": "x"}, "msg": "Process Details", "attr": {"host": "myhost.example.com:27017"}})
    rows_ = [("/a/x.log", 1, '{"host":"mongod"}'), ("/a/x.log", 2, detail), ("/tmp/test_node_alpha.log", 1, "{}"), ("/b/y.log", 1, '{"host":"other"}')]
    got = {r.file_path: (r.hostname, r.port) for r in nodes.file_identity(spark.createDataFrame(rows_, "file_path string, line_no long, raw string")).collect()}
    assert got == {"/a/x.log": ("myhost.example.com", 27017), "/tmp/test_node_alpha.log": ("test_node_alpha", 0), "/b/y.log": ("other", 0)}
    files = spark.createDataFrame([("/l/m.log", 0, "m", 0), ("/l/m.log.2024-01-15T00-00-00", 1, "m", 0), ("/k/m.log", 2, "m", 0), ("/k/z", 3, "h.x", 1), ("/q/z", 4, "h.x", 1)], "file_path string, file_idx int, hostname string, port int")
    merged = nodes.merged_nodes(files)
    assert [(r.file_idx, r.node_idx) for r in merged.orderBy("file_idx").collect()] == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)]
    assert nodes.node_table(merged).count() == 3
    e = spark.createDataFrame([(1, 1, [1, 4])], "file_idx int, node_idx int, node_set array<int>")
    assert tuple(nodes.with_nodes(e, merged).select("node_idx", "node_set").first()) == (0, [0, 2])


def test_files_append_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(TEN[:5]) + "\n")
    first = logs.load_cluster(spark, [str(folder / "a.log")])
    (tmp_path / "b.log").write_text("\n".join(TEN[5:]) + "\nbroken\n")
    both = logs.append_entries(logs.with_index(first), logs.load_cluster(spark, [str(tmp_path / "b.log")]))
    assert [(r.idx, r.file_idx) for r in both.orderBy("idx").collect()] == [(i, i // 5) for i in range(10)]
    for _ in range(2):
        ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        (folder / "b.log").write_text("\n".join(TEN[5:]) + "\n")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    live, ck = str(tmp_path / "live"), str(tmp_path / "ck2")
    ingest.live_breakdowns(logs.parse_log_lines(ingest.stream_lines(spark, str(folder))), live, ck).awaitTermination()
    assert ingest.live_counts(spark, live).where("dimension = 'severity' and label = 'INFO'").first()["count"] == 4


def test_live_counts_over_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails after writing its counts is run again, and counts once; merged batches count once too."""
    folder, live, ck = tmp_path / "in", str(tmp_path / "live"), str(tmp_path / "ck")
    folder.mkdir()
    stream = lambda: logs.parse_log_lines(ingest.stream_lines(spark, str(folder), maxFilesPerTrigger="1"))
    for i in range(3):
        (folder / f"{i}.log").write_text("\n".join(TEN[3 * i : 3 * i + 3]) + "\n")
    real = ingest.b.breakdowns

    def broken(batch):
        return real(batch).withColumn("count", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("count")))

    calls = []
    monkeypatch.setattr(ingest.b, "breakdowns", lambda batch: (calls.append(1), broken(batch) if len(calls) == 2 else real(batch))[1])
    with pytest.raises(Exception, match="lost"):
        ingest.live_breakdowns(stream(), live, ck).awaitTermination()
    told = lambda: sorted(tuple(r) for r in ingest.live_counts(spark, live).collect())
    half = told()
    ingest.live_breakdowns(stream(), live, ck).awaitTermination()
    entries = entries_of(spark, TEN[:9])
    want = sorted(tuple(r) for r in real(entries).collect())
    assert told() == want != half
    found = ingest.live_connections(spark, live).first()[0]
    assert found == entries.where("conn_id > 0").select("conn_id").distinct().count()
    ingest.merge_live(spark, live)
    (folder / "9.log").write_text(TEN[9] + "\n")
    ingest.live_breakdowns(stream(), live, ck).awaitTermination()
    whole = sorted(tuple(r) for r in real(entries_of(spark, TEN)).collect())
    assert told() == whole
    ingest.merge_live(spark, live)
    assert told() == whole and ingest.live_connections(spark, live).first()[0] >= found


def test_sampling_and_flatten(ten, spark):
    assert sorted(r.idx for r in logs.sampled(ten, 0.5).collect()) == [0, 2, 4, 6, 8] and logs.sampled(ten, 1).count() == 10
    flat = {(r.idx, r.path): (r.type, r.value) for r in flatten_json(ten).collect()}
    assert flat[3, "attr.durationMillis"] == ("int", "800") and flat[3, "attr.command.filter.age"] == ("int", "3")
    paths = spark.createDataFrame([("attr.locks.Global.acquireCount.r",), ("attr.locks.Global",), ("attr.zz",), ("ctx",), ("x.ctx",), ("attr.unlocks.Global",), ("attr.locks.x.acquireCount",), ("attr.locks.acquireCount",), ("locks[].x.acquireCount",)], "path string")
    labels = {r.path: r.label for r in with_key_labels(paths, key_rules(spark)).collect()}
    assert labels["attr.locks.Global"] == "Global lock" and labels["attr.locks.Global.acquireCount.r"] == "IS - Intent Shared" and labels["attr.zz"] == "zz"
    # contexts are whole keys, and the ancestor of top-level keys is the document
    assert labels["ctx"] == "thread context" and labels["x.ctx"] == "ctx" and labels["attr.unlocks.Global"] == "Global"
    assert labels["attr.locks.x.acquireCount"] == labels["locks[].x.acquireCount"] == "times acquired" and labels["attr.locks.acquireCount"] == "acquireCount"
