"""Every registered query by name, and the SQL that must give the same rows.

Log lines and metric samples are derived from ``events``; the queries parse them
back, while the SQL works on ``events`` directly and never sees the JSON.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import logtext as lt
from .functions.flatten import data_rows, key_rules, with_key_labels
from .operators import breakdowns as b
from .operators import correlate, filters, nodes, series
from .operators.filters import EntryFilter
from .plans import analyses
from .session import ship
from .sources import captures, cluster, derived, logs
from .store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Entries as SQL over events.
ENTRIES = """
SELECT row_number() OVER (ORDER BY epoch_us(ts) // 1000, user_id % 3, event_id) - 1 AS idx, event_id, epoch_us(ts) // 1000 AS ts_ms,
  CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 ELSE 3 END AS severity_rank,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END AS severity,
  upper(event_type) AS component, CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END AS conn_id,
  CASE WHEN value >= 100 THEN 'Slow query' ELSE event_type || ' handled' END AS msg, value >= 100 AS slow,
  CASE WHEN event_id % 5 <> 0 THEN 'shop.' || event_type END AS ns,
  CASE event_type WHEN 'click' THEN 'find' WHEN 'error' THEN 'hello' WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'findAndModify' ELSE 'aggregate' END AS op_type,
  CASE event_id % 4 WHEN 0 THEN '{a:{int}}' WHEN 1 THEN '{b:{str},user:{$gt:{int}}}' WHEN 2 THEN '{_id:{oid}}' ELSE '{tags:[{int},{str}]}' END AS shape,
  'drv' || CAST(user_id % 3 AS VARCHAR) || ' ' || CAST(user_id % 2 AS VARCHAR) || '.0' AS driver,
  CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(floor(value) AS INTEGER) END AS duration_ms, CAST(user_id % 3 AS INTEGER) AS node_idx
FROM events
"""
#: Metric samples as SQL over events.
SAMPLES = """
SELECT 'serverStatus.opcounters.' || CASE event_type WHEN 'click' THEN 'query' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'update' ELSE 'command' END AS path,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS path_ord,
  epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, CAST(event_id + floor(value) AS DOUBLE) AS value, true AS cum, CAST(NULL AS DOUBLE) AS threshold, 'ops/s' AS unit FROM events
UNION ALL SELECT 'serverStatus.connections.current', 5, epoch_us(ts) // 1000, event_id, value * 20, false, 5000.0, 'count' FROM events
UNION ALL SELECT 'systemMetrics.disks.dev' || CAST(user_id % 2 AS VARCHAR) || '.io_queued_ms', 6, epoch_us(ts) // 1000, event_id, CAST(floor(value) AS DOUBLE), true, 500.0, 'ms/s' FROM events WHERE event_id % 2 = 0
"""
RATES = """
SELECT path, ts_ms, seq, unit, threshold, CASE WHEN dt > 0 AND dv > 0 THEN dv * 1000.0 / dt ELSE 0.0 END AS value FROM (
  SELECT *, value - lag(value) OVER w AS dv, ts_ms - lag(ts_ms) OVER w AS dt FROM s WINDOW w AS (PARTITION BY path ORDER BY ts_ms, seq)
) WHERE dt IS NOT NULL
"""
START, DAY = 1704067200000, 86_400_000  # 2024-01-01


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/events.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is a small table of fewer blocks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.entries(spread(events(spark, sf_dir)))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.entries(spread(events(spark, sf_dir)), indexed=True)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.metric_samples(events(spark, sf_dir))


def register(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def over_entries(select: str) -> str:
    return f"WITH e AS ({ENTRIES}) {select}"


def over_samples(select: str, rates: bool = False) -> str:
    return f"WITH s AS ({SAMPLES})" + (f", r AS ({RATES})" if rates else "") + f" {select}"


# ---- scans and breakdowns -------------------------------------------------------

LABELS = "SELECT '{0}' AS dimension, {0} AS label, count(*) AS count FROM e WHERE {0} IS NOT NULL GROUP BY {0}"


@register("log_entries", over_entries("SELECT event_id AS line_no, ts_ms, severity_rank, severity, component, conn_id, msg, ns, op_type, shape, driver, duration_ms, node_idx FROM e"))
def log_entries(spark, d):
    return entries(spark, d).select("line_no", "ts_ms", "severity_rank", "severity", "component", "conn_id", "msg", "ns", "op_type", "shape", "driver", "duration_ms", "node_idx")


@register("log_index", over_entries("SELECT idx, event_id AS line_no FROM e"))
def log_index(spark, d):
    return indexed(spark, d).select("idx", "line_no")


@register("log_summary", over_entries("SELECT count(*) AS total, count(ns) AS with_ns, count_if(slow)::BIGINT AS slow, min(ts_ms) AS earliest_ms, max(ts_ms) AS latest_ms FROM e"))
def log_summary(spark, d):
    return b.summary(entries(spark, d))


@register("log_breakdowns", over_entries(" UNION ALL ".join(LABELS.format(x) for x in b.DIMENSIONS)))
def log_breakdowns(spark, d):
    return b.breakdowns(entries(spark, d))


@register("log_by_connection", over_entries("SELECT conn_id, count(*) AS count FROM e WHERE conn_id > 0 GROUP BY conn_id"))
def log_by_connection(spark, d):
    return b.by_connection(entries(spark, d))


@register("log_distinct_connections", over_entries("SELECT count(DISTINCT conn_id) FILTER (conn_id > 0) AS connections FROM e"))
def log_distinct_connections(spark, d):
    return b.distinct_connections(entries(spark, d))


@register("log_top_components", over_entries("SELECT component AS label, count(*) AS count FROM e GROUP BY 1 ORDER BY count DESC, label LIMIT 3"))
def log_top_components(spark, d):
    return b.top(b.breakdowns(entries(spark, d), ("component",)).select("label", "count"), 3)


REPORTS = f"SELECT dimension, label, count, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, label) AS pos FROM ({' UNION ALL '.join(LABELS.format(x) for x in b.DIMENSIONS)} UNION ALL SELECT 'conn', 'conn' || conn_id, count(*) FROM e WHERE conn_id > 0 GROUP BY conn_id)) WHERE pos <= CASE WHEN dimension IN ('severity', 'op_type') THEN 12 ELSE 50 END"


@register("breakdown_reports", over_entries(REPORTS))
def breakdown_reports(spark, d):
    e = entries(spark, d).withColumn("conn", F.when(F.col("conn_id") > 0, F.concat(F.lit("conn"), F.col("conn_id").cast("string"))))
    return b.reports(b.breakdowns(e, (*b.DIMENSIONS, "conn")))


@register("log_latest", over_entries("SELECT event_id AS line_no, ts_ms FROM e ORDER BY idx DESC LIMIT 20"))
def log_latest(spark, d):
    return b.in_time_order(entries(spark, d), descending=True).select("line_no", "ts_ms").limit(20)


@register("log_sampled", over_entries("SELECT event_id AS line_no, node_idx FROM (SELECT *, row_number() OVER (PARTITION BY node_idx ORDER BY event_id) AS n FROM e) WHERE (n - 1) % 10 = 0"))
def log_sampled(spark, d):
    return logs.sampled(entries(spark, d), 0.1).select("line_no", "node_idx")


@register("log_parse_health", "SELECT '/logs/node' || CAST(user_id % 3 AS VARCHAR) || '/mongod.log' AS file_path, count(*) FILTER (event_id % 11 <> 0 AND user_id % 3 <> 2) AS n_ok, count(*) FILTER (event_id % 11 = 0 OR user_id % 3 = 2) AS n_failed, count(*) FILTER (event_id % 11 <> 0 AND user_id % 3 <> 2) = 0 AS no_entry FROM events GROUP BY 1")
def log_parse_health(spark, d):
    lines = derived.log_lines(events(spark, d))
    cut = F.when((F.col("line_no") % 11 == 0) | (F.col("file_idx") == 2), F.substring("raw", 1, 40)).otherwise(F.col("raw"))
    return logs.parse_health(logs.with_fields(lines.withColumn("raw", cut)))


@register("log_paths", "SELECT DISTINCT path, CASE WHEN contains(path, 'diagnostic.data') OR regexp_extract(path, '[^/]*$') LIKE 'metrics%' THEN 'capture' ELSE 'log' END AS kind FROM (SELECT CASE user_id % 4 WHEN 0 THEN '/d/metrics.' || event_type WHEN 1 THEN '/diagnostic.data/x.' || event_type WHEN 2 THEN '/logs/' || event_type || '.log' ELSE '/logs/.' || event_type END AS path FROM events) WHERE path NOT LIKE '%/.%'")
def log_paths(spark, d):
    kind = F.col("user_id") % 4
    name = F.col("event_type")
    path = F.when(kind == 0, F.concat(F.lit("/d/metrics."), name)).when(kind == 1, F.concat(F.lit("/diagnostic.data/x."), name)).when(kind == 2, F.concat(F.lit("/logs/"), name, F.lit(".log"))).otherwise(F.concat(F.lit("/logs/."), name))
    return logs.classify_paths(events(spark, d).select(path.alias("path")))


#: Every leaf of the derived log lines.
LEAVES = """
SELECT 't.$date' AS path, 'string' AS type, count(*) AS count, count(DISTINCT ts_ms) AS distinct_values FROM e
UNION ALL SELECT 's', 'string', count(*), count(DISTINCT severity) FROM e
UNION ALL SELECT 'c', 'string', count(*), count(DISTINCT component) FROM e
UNION ALL SELECT 'id', 'int', count(*), 1 FROM e
UNION ALL SELECT 'ctx', 'string', count(*), count(DISTINCT CASE WHEN event_id % 7 = 0 THEN 'main' ELSE 'conn' || user_id END) FROM events
UNION ALL SELECT 'msg', 'string', count(*), count(DISTINCT msg) FROM e
UNION ALL SELECT 'attr.ns', 'string', count(*), count(DISTINCT ns) FROM e WHERE ns IS NOT NULL
UNION ALL SELECT 'attr.durationMillis', 'int', count(*), count(DISTINCT duration_ms) FROM e WHERE duration_ms >= 0
UNION ALL SELECT 'attr.command.$db', 'string', count(*), 1 FROM e
UNION ALL SELECT 'attr.command.' || CASE op_type WHEN 'hello' THEN 'isMaster' WHEN 'findAndModify' THEN 'findandmodify' ELSE op_type END, 'string', count(*), 1 FROM e GROUP BY op_type
UNION ALL SELECT 'attr.command.filter.a', 'int', count(*), 1 FROM e WHERE event_id % 4 = 0
UNION ALL SELECT p, t, count(*), 1 FROM e, (VALUES ('user.$gt', 'int'), ('b', 'string')) v(k, t), LATERAL (SELECT 'attr.command.filter.' || k AS p) WHERE event_id % 4 = 1 GROUP BY p, t
UNION ALL SELECT 'attr.command.filter._id.$oid', 'string', count(*), 1 FROM e WHERE event_id % 4 = 2
UNION ALL SELECT 'attr.command.filter.tags[]', t, count(*), 1 FROM e, (VALUES ('int'), ('string')) v(t) WHERE event_id % 4 = 3 GROUP BY t
UNION ALL SELECT 'attr.client.driver.name', 'string', count(*), count(DISTINCT user_id % 3) FROM events
UNION ALL SELECT 'attr.client.driver.version', 'string', count(*), count(DISTINCT user_id % 2) FROM events
"""


@register("attribute_profile", over_entries(LEAVES))
def attribute_profile(spark, d):
    return b.attribute_profile(derived.log_lines(events(spark, d)), id_col="line_no")


def labelled(leaves: str) -> str:
    """The leaves with the label of the first rule that fits; the rules are the package's table, written out."""
    quoted = lambda x: "'" + (x or "").replace("'", "''") + "'"
    rules = ", ".join(f"({int(r['priority'])}, {quoted(r['rule'])}, {quoted(r['context'])}, {quoted(r['key'])}, {quoted(r['label'])})" for r in data_rows("key_labels.csv"))
    return f"""
SELECT path, type, count, distinct_values, coalesce((SELECT arg_min(label, priority) FROM (VALUES {rules}) r(priority, rule, context, k, label) WHERE k = key AND CASE rule
  WHEN 'any' THEN true WHEN 'ends' THEN above[-1] = context WHEN 'contains' THEN list_contains(above, context) ELSE list_contains(above, context) AND above[-1] <> context END), key) AS label
FROM (SELECT path, type, count, distinct_values FROM ({leaves})) p,
  LATERAL (SELECT string_split('document.' || replace(path, '[]', ''), '.') AS parts), LATERAL (SELECT parts[-1] AS key, parts[:-2] AS above)"""


@register("attribute_labels", over_entries(labelled(LEAVES)))
def attribute_labels(spark, d):
    return with_key_labels(b.attribute_profile(derived.log_lines(events(spark, d)), id_col="line_no"), key_rules(spark))


# ---- filters --------------------------------------------------------------------

FILTERS: dict[str, tuple[EntryFilter, str]] = {
    "severity": (EntryFilter(severity="error"), "severity_rank = 1"),
    "components": (EntryFilter(components=["CLICK", "VIEW"]), "component IN ('CLICK', 'VIEW')"),
    "op_type": (EntryFilter(op_type="findAndModify"), "op_type = 'findAndModify'"),
    "namespace": (EntryFilter(ns="shop.view"), "ns = 'shop.view'"),
    "shape": (EntryFilter(shape="{_id:{oid}}"), "shape = '{_id:{oid}}'"),
    "slow": (EntryFilter(slow_only=True), "slow"),
    "connections": (EntryFilter(conn_ids=[3, 5, 8]), "conn_id IN (3, 5, 8)"),
    "drivers": (EntryFilter(drivers=["drv0 0.0"], driver="drv1 1.0"), "driver IN ('drv0 0.0', 'drv1 1.0')"),
    "min_duration": (EntryFilter(min_duration_ms=50), "duration_ms >= 50"),
    "nodes": (EntryFilter(nodes=[0, 2]), "node_idx IN (0, 2)"),
    "time_window": (EntryFilter(time_start_ms=START + 5 * DAY, time_end_ms=START + 9 * DAY), f"ts_ms BETWEEN {START + 5 * DAY} AND {START + 9 * DAY}"),
    "text": (EntryFilter(text="QUERY"), "contains(lower(msg), 'query')"),
    "composite": (EntryFilter(severity="WARN", text="slow", nodes=[1], min_duration_ms=100, time_start_ms=START, conn_ids=list(range(1, 60))), f"severity_rank = 2 AND contains(lower(msg), 'slow') AND node_idx = 1 AND duration_ms >= 100 AND ts_ms >= {START} AND conn_id BETWEEN 1 AND 59"),
}
for _name, (_filter, _sql) in FILTERS.items():
    register(f"filter_{_name}", over_entries(f"SELECT event_id AS line_no FROM e WHERE {_sql}"))(lambda spark, d, f=_filter: f.apply(entries(spark, d)).select("line_no"))


@register("filter_errors_only", over_entries("SELECT event_id AS line_no, severity FROM e WHERE severity IN ('ERROR', 'WARN')"))
def filter_errors_only(spark, d):
    return entries(spark, d).where(filters.error_selection("BOTH")).select("line_no", "severity")


@register("annotations", over_entries("SELECT event_id AS line_no, CASE WHEN severity_rank <= 1 THEN 'err' ELSE 'warn' END AS annotation FROM e WHERE severity_rank <= 2"))
def annotations(spark, d):
    return filters.annotations(entries(spark, d)).select("line_no", "annotation")


@register("connection_search", over_entries("SELECT DISTINCT conn_id FROM e WHERE conn_id > 0 AND contains('conn' || conn_id, 'onn1')"))
def connection_search(spark, d):
    return b.by_connection(entries(spark, d)).where(filters.connection_matches("ONN1")).select("conn_id")


@register("driver_search", over_entries("SELECT driver AS label, count(*) AS count FROM e WHERE contains(lower(driver), 'v1') GROUP BY 1"))
def driver_search(spark, d):
    return b.breakdowns(entries(spark, d), ("driver",)).where(filters.label_matches("label", "V1")).select("label", "count")


@register("trigram_search", over_entries("SELECT event_id AS line_no FROM e WHERE contains(lower(msg), 'ase handled')"))
def trigram_search(spark, d):
    e = entries(spark, d)
    return filters.indexed_search(e, filters.trigram_index(e), "ASE Handled").select("line_no")


@register("document_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def document_search(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs.where(filters.text_contains("text", "Apache License")).select("doc_id")


# ---- named analyses -------------------------------------------------------------

TOP = " UNION ALL ".join(f"SELECT * FROM (SELECT '{x}' AS dimension, {x} AS label, count(*) AS count FROM e WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count DESC, label LIMIT {20 if x == 'shape' else 30})" for x in b.DIMENSIONS)
SLOW = "FROM e WHERE slow AND duration_ms >= 0"


@register("q1_analysis_summary", over_entries(TOP))
def q1_analysis_summary(spark, d):
    return analyses.analyse("analysis_summary", entries(spark, d))["top"]


@register("q1_analysis_totals", over_entries("SELECT count(*) AS total, count(ns) AS with_ns, count_if(slow)::BIGINT AS slow, min(ts_ms) AS earliest_ms, max(ts_ms) AS latest_ms, count(DISTINCT node_idx) AS nodes FROM e"))
def q1_analysis_totals(spark, d):
    made = analyses.analyse("analysis_summary", entries(spark, d))
    return made["totals"].join(made["nodes"].agg(F.count("*").alias("nodes")), F.lit(True))


@register("q2_search_logs", over_entries("SELECT idx, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, severity, component, ns, msg, conn_id, duration_ms, node_idx FROM e WHERE severity_rank = 1 AND ns = 'shop.error' AND contains(lower(msg), 'slow') AND duration_ms >= 100 ORDER BY idx LIMIT 25"))
def q2_search_logs(spark, d):
    return analyses.analyse("search_logs", entries(spark, d), severity="E", namespace="shop.error", text="slow", min_duration_ms=100, limit=25)["entries"]


@register("q2_search_counts", over_entries("SELECT count(*) AS total, least(count(*), 50) AS returned FROM e WHERE component = 'SIGNUP'"))
def q2_search_counts(spark, d):
    return analyses.analyse("search_logs", entries(spark, d).withColumn("idx", F.col("line_no")), component="SIGNUP")["counts"]


@register("q3_entry_detail", over_entries("SELECT 1234 % (SELECT count(*) FROM events) AS idx, event_id AS line_no, component FROM e WHERE idx = 1234 % (SELECT count(*) FROM events)"))
def q3_entry_detail(spark, d):
    rows = indexed(spark, d)
    found = analyses.analyse("entry_detail", rows, entry_index=1234 % events(spark, d).count())["entry"]
    return logs.with_fields(found).join(rows.select("idx", "line_no"), "idx").select("idx", "line_no", "component")


@register("q4_slow_totals", over_entries(f"SELECT count(*) AS count, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS max_ms, (sum(duration_ms) // count(*))::BIGINT AS avg_ms {SLOW}"))
def q4_slow_totals(spark, d):
    return analyses.analyse("slow_queries", entries(spark, d).withColumn("idx", F.col("line_no")))["totals"]


@register("q4_slow_shapes", over_entries(f", f AS (SELECT shape, duration_ms, row_number() OVER (PARTITION BY shape ORDER BY idx) AS r {SLOW}), p AS (SELECT shape, list_sort(list(duration_ms)) AS l FROM f WHERE r <= 1000 GROUP BY shape) SELECT e.shape, count(*) AS count, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms, any_value(l[len(l) // 2 + 1]) AS p50, any_value(l[least(len(l) - 1, CAST(floor(0.99 * len(l)) AS BIGINT)) + 1]) AS p99, (sum(duration_ms) // count(*))::BIGINT AS avg_ms FROM e JOIN p USING (shape) WHERE slow AND duration_ms >= 0 GROUP BY e.shape"))
def q4_slow_shapes(spark, d):
    return analyses.analyse("slow_queries", entries(spark, d))["shapes"]


@register("q4_slow_namespaces", over_entries(f"SELECT ns, count(*) AS count {SLOW} AND ns IS NOT NULL GROUP BY ns"))
def q4_slow_namespaces(spark, d):
    return analyses.analyse("slow_queries", entries(spark, d).withColumn("idx", F.col("line_no")))["namespaces"]


@register("q5_connections", over_entries("SELECT conn_id, count(*) AS count FROM e WHERE conn_id > 0 GROUP BY 1 ORDER BY count DESC, conn_id LIMIT 20"))
def q5_connections(spark, d):
    return analyses.analyse("connections", entries(spark, d))["connections"]


@register("q5_drivers", over_entries("SELECT driver AS label, count(*) AS count FROM e GROUP BY 1"))
def q5_drivers(spark, d):
    return analyses.analyse("connections", entries(spark, d))["drivers"]


@register("q6_error_groups", over_entries("SELECT msg, count(*) AS count, arg_min(severity, idx) AS severity, min(idx) AS first_idx, CAST(list_sort(list(idx))[1:3] AS VARCHAR) AS samples FROM e WHERE severity IN ('ERROR', 'WARN') GROUP BY msg"))
def q6_error_groups(spark, d):
    made = analyses.analyse("error_details", entries(spark, d))["groups"]
    return made.withColumn("samples", F.concat(F.lit("["), F.array_join("samples", ", "), F.lit("]")))


@register("q6_error_totals", over_entries("SELECT count_if(severity = 'ERROR')::BIGINT AS errors, count_if(severity = 'WARN')::BIGINT AS warnings FROM e"))
def q6_error_totals(spark, d):
    return analyses.analyse("error_details", entries(spark, d).withColumn("idx", F.col("line_no")), severity="ERROR")["totals"]


# ---- nodes ----------------------------------------------------------------------


@register("node_merge", "WITH f AS (SELECT DISTINCT user_id AS file_idx, CASE WHEN user_id % 5 = 0 THEN 'host' || CAST(user_id % 3 AS VARCHAR) || '.example.com' ELSE 'mongod' END AS hostname, CASE WHEN user_id % 5 = 0 THEN 27017 ELSE 0 END AS port, '/logs/n' || CAST(user_id % 4 AS VARCHAR) || '/mongod.log.2024-01-' || lpad(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00-00-00' AS file_path FROM events), k AS (SELECT *, CASE WHEN port > 0 THEN hostname || port ELSE '/logs/n' || CAST(file_idx % 4 AS VARCHAR) END AS key FROM f), g AS (SELECT key, row_number() OVER (ORDER BY min(file_idx)) - 1 AS node_idx FROM k GROUP BY key) SELECT file_path, file_idx, CAST(node_idx AS INTEGER) AS node_idx, hostname, port FROM k JOIN g USING (key)")
def node_merge(spark, d):
    real = F.col("user_id") % 5 == 0
    day = F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0")
    files = events(spark, d).select(
        F.col("user_id").alias("file_idx"),
        F.when(real, F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string"), F.lit(".example.com"))).otherwise("mongod").alias("hostname"),
        F.when(real, 27017).otherwise(0).alias("port"),
        F.concat(F.lit("/logs/n"), (F.col("user_id") % 4).cast("string"), F.lit("/mongod.log.2024-01-"), day, F.lit("T00-00-00")).alias("file_path"),
    )
    return nodes.merged_nodes(files.distinct())


@register("node_identity", "SELECT '/logs/node' || CAST(user_id % 3 AS VARCHAR) || '/mongod.log' AS file_path, 'mongod' AS hostname, 0 AS port, 'file' AS identity_source FROM events GROUP BY user_id % 3")
def node_identity(spark, d):
    return nodes.file_identity(derived.log_lines(events(spark, d)))


@register("entry_hosts", over_entries("SELECT node_idx, 'mongod' AS hostname, count(*) AS n FROM e GROUP BY node_idx"))
def entry_hosts(spark, d):
    lines = derived.log_lines(events(spark, d))
    files = nodes.file_identity(lines).join(lines.select("file_path", "file_idx").distinct(), "file_path")
    merged = nodes.merged_nodes(files)
    found = nodes.with_hostname(nodes.with_nodes(entries(spark, d), merged), nodes.node_table(merged))
    return found.groupBy("node_idx", "hostname").agg(F.count("*").alias("n"))


def _cluster(spark, d, stack=False):
    """The derived lines as a cluster's table, loaded in two parts, the second given twice."""
    folder = f"{shared_folder(spark)}/cluster-{uuid.uuid4().hex}"
    lines = spread(derived.log_lines(events(spark, d)).select("file_path", "line_no", "raw"))
    first = lines.where(~F.col("file_path").contains("node1"))
    for part in (first, lines, lines):
        cluster.append_lines(spark, folder, part, stack)
    return folder


@register("cluster_breakdowns", over_entries(" UNION ALL ".join(LABELS.format(x) for x in b.DIMENSIONS)))
def cluster_breakdowns(spark, d):
    return cluster.cluster_breakdowns(spark, _cluster(spark, d))


@register("cluster_entries", over_entries("SELECT event_id AS line_no, ts_ms, msg, ns, duration_ms, CASE node_idx WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS node FROM e"))
def cluster_entries(spark, d):
    found = cluster.cluster_entries(spark, _cluster(spark, d))
    return found.select("line_no", "ts_ms", "msg", "ns", "duration_ms", F.col("node_set")[0].alias("node"))


@register("stacked_entries")
def stacked_entries(spark, d):
    """Entries with times cut to hours, so that nodes have equal ones."""
    e = entries(spark, d).select("file_idx", "node_idx", "node_set", "line_no", F.expr("ts_ms div 3600000 * 3600000").alias("ts_ms"), *nodes.KEY, F.lit(None).cast("string").alias("raw"))  # only the number of raw lines is shown
    return nodes.stacked(e).select("file_idx", "line_no", "ts_ms", "msg", "node_set", F.coalesce(F.size("alts"), F.lit(0)).alias("n_alts"))


# ---- metrics --------------------------------------------------------------------


@register("metric_definitions", over_samples("SELECT path, count(*) AS n, any_value(cum) AS is_cumulative, any_value(threshold) AS threshold, any_value(unit) AS unit FROM s GROUP BY path"))
def metric_definitions(spark, d):
    s = series.with_definitions(samples(spark, d), series.definitions(spark))
    return s.groupBy("path").agg(F.count("*").alias("n"), F.bool_and("is_cumulative").alias("is_cumulative"), F.max("threshold").alias("threshold"), F.max("unit").alias("unit"))


@register("metric_rates", over_samples("SELECT path, ts_ms, round(value, 6) AS value FROM r JOIN (SELECT DISTINCT path, cum FROM s) USING (path) WHERE cum", True))
def metric_rates(spark, d):
    return series.cumulative_rates(samples(spark, d), series.definitions(spark), ["seq"]).withColumn("value", F.round("value", 6))


@register("metric_time_range", over_samples("SELECT min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM s"))
def metric_time_range(spark, d):
    return series.time_range(samples(spark, d))


@register("metric_window_stats", over_samples(f"SELECT path, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, list_sort(list(value))[CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) + 1] AS p99 FROM s WHERE ts_ms BETWEEN {START + 3 * DAY} AND {START + 20 * DAY} GROUP BY path"))
def metric_window_stats(spark, d):
    return series.window_stats(samples(spark, d), START + 3 * DAY, START + 20 * DAY).withColumn("avg", F.round("avg", 6))


@register("metric_range_profile", over_samples("SELECT path, unit, min(value) AS min, max(value) AS max, min(value) FILTER (value > 0) AS least_positive, max(value) FILTER (value > 0) AS largest_positive, coalesce(max(value) FILTER (value > 0) / min(value) FILTER (value > 0) > 1000 AND unit <> 'count', false) AS log_scale FROM s GROUP BY path, unit"))
def metric_range_profile(spark, d):
    return series.range_profile(series.with_definitions(samples(spark, d), series.definitions(spark)))


@register("metric_bands", over_samples("SELECT path, CASE WHEN threshold IS NULL THEN 'none' WHEN value / threshold > 1 THEN 'red' WHEN value / threshold >= 0.75 THEN 'yellow' ELSE 'green' END AS band, count(*) AS n FROM s GROUP BY 1, 2"))
def metric_bands(spark, d):
    made = series.banded(series.with_definitions(samples(spark, d), series.definitions(spark)))
    return made.groupBy("path", "band").agg(F.count("*").alias("n"))


@register("metric_last_values", over_samples("SELECT path, arg_max(value, row(ts_ms, seq)) AS last_value, max(ts_ms) AS last_ms FROM s GROUP BY path"))
def metric_last_values(spark, d):
    return series.last_values(samples(spark, d), ["seq"])


#: Values on the scale of thresholds: gauges, and rates of the other series.
MEASURED = ", v AS (SELECT path, ts_ms, seq, value, threshold FROM s WHERE NOT cum UNION ALL SELECT path, ts_ms, seq, value, threshold FROM r WHERE path NOT IN (SELECT path FROM s WHERE NOT cum))"
#: The members of each dashboard that are present.
MEMBERS = ", d(dashboard, path) AS (VALUES " + ", ".join(f"('{r['dashboard']}', '{r['path'] or ''}')" for r in data_rows("dashboards.csv")) + "), m AS (SELECT DISTINCT dashboard, s.path FROM d JOIN s ON s.path = d.path OR d.path = '' AND s.path LIKE 'systemMetrics.disks.%')"


@register("metric_exceedances", over_samples(MEASURED + ", a AS (SELECT *, value > threshold AS above, lag(value > threshold) OVER w AS was FROM v WHERE threshold IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY ts_ms, seq)), g AS (SELECT *, sum(CASE WHEN above AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts_ms, seq) AS run FROM a) SELECT path, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS samples, round(max(value), 6) AS peak FROM g WHERE above GROUP BY path, run", True))
def metric_exceedances(spark, d):
    defs = series.definitions(spark)
    s = series.with_definitions(series.measured(samples(spark, d), defs, ["seq"]), defs)
    return series.exceedances(s, ["seq"]).withColumn("peak", F.round("peak", 6))


@register("dashboard_members", over_samples(MEMBERS + " SELECT dashboard, path FROM m"))
def dashboard_members(spark, d):
    return series.dashboard_paths(samples(spark, d), series.dashboards(spark))


@register("dashboard_anomalies", over_samples(MEASURED + MEMBERS + ", l AS (SELECT path, arg_max(value, row(ts_ms, seq)) > any_value(threshold) AS above FROM v GROUP BY path) SELECT dashboard, coalesce(bool_or(above), false) AS anomaly FROM m LEFT JOIN l USING (path) GROUP BY dashboard", True))
def dashboard_anomalies(spark, d):
    return series.anomalies(samples(spark, d), series.definitions(spark), series.dashboards(spark), ["seq"])


@register("metric_selection", over_samples("SELECT path, count(*) AS n FROM s WHERE path LIKE 'systemMetrics.disks.%' OR path = 'serverStatus.connections.current' GROUP BY path"))
def metric_selection(spark, d):
    return series.selected(samples(spark, d), series.dashboards(spark), ["Disk I/O"], ["serverStatus.connections.current"]).groupBy("path").agg(F.count("*").alias("n"))


@register("metric_search", over_samples("SELECT path, min(path_ord) AS path_ord FROM s WHERE contains(path, 'opcounters') GROUP BY path"))
def metric_search(spark, d):
    return series.search_metrics(series.with_definitions(samples(spark, d), series.definitions(spark)), "OPCOUNTERS").select("path", "path_ord")


@register("disk_metrics", over_samples("SELECT DISTINCT path FROM s WHERE path LIKE 'systemMetrics.disks.%'"))
def disk_metrics(spark, d):
    return series.disk_metrics(samples(spark, d))


@register("metric_first_definitions", "SELECT 'm.' || event_type AS path, arg_min('Name ' || event_id, row(user_id % 3, event_id)) FILTER (event_id % 2 = 1) AS display_name, arg_min('unit' || user_id, row(user_id % 3, event_id)) FILTER (event_id % 2 = 1) AS unit, arg_min(user_id % 2 = 0, row(user_id % 3, event_id)) FILTER (event_id % 2 = 1) AS is_cumulative FROM events GROUP BY 1")
def metric_first_definitions(spark, d):
    """Definitions of three captures, half of them without a name."""
    e, text = events(spark, d), lambda c: F.col(c).cast("string")
    name = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("Name "), text("event_id"))).otherwise("")
    return series.first_definitions(e.select(F.concat(F.lit("m."), "event_type").alias("path"), name.alias("display_name"), F.concat(F.lit("unit"), text("user_id")).alias("unit"), (F.col("user_id") % 2 == 0).alias("is_cumulative"), (F.col("user_id") % 3).alias("source"), F.col("event_id").alias("chunk_no")))


@register("capture_samples", "SELECT event_type AS source, m AS path, epoch_us(ts) // 1000 AS ts_ms, CAST(CASE m WHEN 'value' THEN floor(value) ELSE user_id END AS DOUBLE) AS value FROM events, (VALUES ('value'), ('user')) v(m)")
def capture_samples(spark, d):
    return captures.samples(derived.capture_chunks(events(spark, d))).select("source", "path", "ts_ms", "value")


@register("metric_lttb")
def metric_lttb(spark, d):
    return series.lttb(samples(spark, d), 200, ["seq"])


# ---- correlation ----------------------------------------------------------------


@register("events_in_windows", over_entries(f", w AS (SELECT {START} + user_id * 3600000 AS start_ms, {START} + user_id * 3600000 + 1800000 AS end_ms, user_id AS window_id FROM (SELECT DISTINCT user_id FROM events)) SELECT window_id, event_id AS line_no FROM e JOIN w ON ts_ms BETWEEN start_ms AND end_ms WHERE severity_rank <= 2"))
def events_in_windows(spark, d):
    start = START + F.col("user_id") * 3_600_000
    windows = events(spark, d).select("user_id").distinct().select(start.alias("start_ms"), (start + 1_800_000).alias("end_ms"), F.col("user_id").alias("window_id"))
    return correlate.events_in_windows(filters.annotations(entries(spark, d)), windows).select("window_id", "line_no")


@register("events_near_instants", over_entries(", p AS (SELECT event_id AS probe, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type = 'purchase' AND value >= 100) SELECT probe, event_id AS line_no FROM e JOIN p ON ts_ms BETWEEN at_ms - 30000 AND at_ms + 30000"))
def events_near_instants(spark, d):
    probes = events(spark, d).where("event_type = 'purchase' AND value >= 100").select(F.col("event_id").alias("probe"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return correlate.events_near(entries(spark, d), probes).select("probe", "line_no")


@register("nearest_samples", over_samples(", p AS (SELECT DISTINCT 'serverStatus.opcounters.query' AS path, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type = 'error'), b AS (SELECT p.path, at_ms, arg_max(struct_pack(ts_ms := s.ts_ms, value := s.value), s.ts_ms) FILTER (s.ts_ms < at_ms) AS back, arg_min(struct_pack(ts_ms := s.ts_ms, value := s.value), s.ts_ms) FILTER (s.ts_ms >= at_ms) AS ahead FROM p JOIN s ON s.path = p.path GROUP BY 1, 2), c AS (SELECT *, CASE WHEN back IS NULL OR ahead.ts_ms - at_ms < at_ms - back.ts_ms THEN ahead ELSE back END AS x FROM b) SELECT path, at_ms, x.ts_ms AS ts_ms, x.value AS value FROM c"))
def nearest_samples(spark, d):
    probes = events(spark, d).where("event_type = 'error'").select(F.lit("serverStatus.opcounters.query").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return correlate.nearest_samples(probes, samples(spark, d), tie=("seq",))


@register("name_fallbacks", "SELECT event_id, 'h' || user_id || '.x' AS hostname, CAST(user_id + 1 AS INTEGER) AS port, 'b' || user_id || '.' || event_type AS short FROM events")
def name_fallbacks(spark, d):
    """Host and port of an address, and the name of a metric without a definition."""
    user = F.col("user_id").cast("string")
    where = lt.host_and_port(F.concat(F.lit("h"), user, F.lit(".x:"), (F.col("user_id") + 1).cast("string")))
    return events(spark, d).select("event_id", where["hostname"].alias("hostname"), where["port"].cast("int").alias("port"), lt.short_metric_name(F.concat(F.lit("a.b"), user, F.lit("."), "event_type")).alias("short"))


@register("log_text_functions", over_entries("SELECT event_id AS line_no, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, CASE WHEN length(msg) > 10 THEN substr(msg, 1, 10) || '...' ELSE msg END AS short FROM e"))
def log_text_functions(spark, d):
    return entries(spark, d).select("line_no", lt.iso_text(F.col("ts_ms")).alias("iso"), lt.shortened(F.col("msg"), 10).alias("short"))
