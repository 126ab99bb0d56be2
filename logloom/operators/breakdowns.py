"""Counts, groups and reports over log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logtext as lt
from ..functions.flatten import flatten_json
from .filters import error_selection
from .ranks import at_ranks

DIMENSIONS = ("severity", "component", "op_type", "driver", "ns", "shape")


def summary(entries: DataFrame) -> DataFrame:
    """One row: total, with_ns, slow, earliest_ms, latest_ms (times that could be read)."""
    time = F.when(F.col("ts_ms") >= 0, F.col("ts_ms"))
    return entries.agg(F.count("*").alias("total"), F.count("ns").alias("with_ns"), F.count_if(lt.is_slow(F.col("msg"))).alias("slow"), F.min(time).alias("earliest_ms"), F.max(time).alias("latest_ms"))


def breakdowns(entries: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, label, count) of every dimension in one pass; blanks are left out."""
    pair = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dimensions]))
    return entries.select(pair.alias("p")).where(F.col("p.label").isNotNull() & (F.col("p.label") != "")).groupBy("p.dimension", "p.label").agg(F.count("*").alias("count"))


def by_connection(entries: DataFrame) -> DataFrame:
    return entries.where("conn_id > 0").groupBy("conn_id").agg(F.count("*").alias("count"))


def distinct_connections(entries: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return entries.agg(count(F.when(F.col("conn_id") > 0, F.col("conn_id"))).alias("connections"))


def top(counts: DataFrame, k: int, by: str | None = None, label: str = "label") -> DataFrame:
    """The ``k`` largest counts, of equals the first label; for each ``by`` if given."""
    order = [F.desc("count"), F.col(label)]
    if by is None:
        return counts.orderBy(*order).limit(k)
    ranked = counts.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_k") <= k).drop("_k")


#: Labels that a report shows: bars of the small dimensions, rows of the other tables (fixed values).
BARS, ROWS = 12, 50


def reports(counts: DataFrame, bars: tuple[str, ...] = ("severity", "op_type")) -> DataFrame:
    """(dimension, label, count, pos) of the labels that the report of each dimension shows, the largest first."""
    ranked = counts.withColumn("pos", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("count"), "label")))
    return ranked.where(F.col("pos") <= F.when(F.col("dimension").isin(*bars), BARS).otherwise(ROWS))


def in_time_order(entries: DataFrame, descending: bool = False) -> DataFrame:
    """Entries by time, then file and line."""
    names = ("ts_ms", "file_idx", "line_no")
    return entries.orderBy(*[F.desc(c) if descending else F.asc(c) for c in names])


def time_order(entries: DataFrame):
    """What orders entries: idx if they have it, else time, file and line."""
    return F.col("idx") if "idx" in entries.columns else F.struct("ts_ms", "file_idx", "line_no")


def _slow(entries: DataFrame, min_duration_ms: int) -> DataFrame:
    return entries.where(lt.is_slow(F.col("msg")) & (F.col("duration_ms") >= min_duration_ms))


def slow_totals(entries: DataFrame, min_duration_ms: int = 0) -> DataFrame:
    """One row: count, total_ms, max_ms, avg_ms (integer division)."""
    d = F.greatest(F.col("duration_ms"), F.lit(0))
    made = _slow(entries, min_duration_ms).agg(F.count("*").alias("count"), F.coalesce(F.sum(d), F.lit(0)).cast("long").alias("total_ms"), F.coalesce(F.max(d), F.lit(0)).alias("max_ms"))
    return made.withColumn("avg_ms", F.when(F.col("count") > 0, F.expr("total_ms div count")).otherwise(F.lit(0)).cast("long"))


def slow_by_shape(entries: DataFrame, min_duration_ms: int = 0, first: int | None = 1000) -> DataFrame:
    """(shape, count, total_ms, avg_ms, max_ms, min_ms, p50, p99) of slow entries with a shape.

    Percentiles are those of the ``first`` durations in time order, place n/2 and
    floor(0.99 n) of the sorted list, or of all durations when ``first`` is None.
    No list of durations is ever held; over all of them they are exact ranks by
    refinement, and no window sees a shape's entries.
    """
    slow = _slow(entries, min_duration_ms).where("shape is not null").select("shape", F.greatest("duration_ms", F.lit(0)).alias("d"), *([time_order(entries).alias("_o")] if first else []))
    whole = slow.groupBy("shape").agg(F.count("*").alias("count"), F.sum("d").cast("long").alias("total_ms"), F.max("d").alias("max_ms"), F.min("d").alias("min_ms"))
    if first is None:
        ranks = at_ranks(slow, "shape", "d", {"p50": lambda n: F.floor(n / 2), "p99": lambda n: F.least(n - 1, F.floor(n * 99 / 100))})
    else:
        used = slow.withColumn("_r", F.row_number().over(Window.partitionBy("shape").orderBy("_o"))).where(F.col("_r") <= first)
        # distinct durations among the first few
        each = used.groupBy("shape", "d").agg(F.count("*").alias("n"))
        run = Window.partitionBy("shape").orderBy("d")
        each = each.withColumn("upto", F.sum("n").over(run)).withColumn("of", F.sum("n").over(Window.partitionBy("shape")))
        at = lambda place: F.min(F.when(F.col("upto") > place, F.col("d")))
        ranks = each.groupBy("shape").agg(at(F.floor(F.col("of") / 2)).alias("p50"), at(F.least(F.col("of") - 1, F.floor(F.col("of") * 99 / 100))).alias("p99"))
    return whole.join(ranks, "shape").withColumn("avg_ms", F.expr("total_ms div count"))


def slow_by_namespace(entries: DataFrame, min_duration_ms: int = 0) -> DataFrame:
    return _slow(entries, min_duration_ms).where("ns is not null").groupBy("ns").agg(F.count("*").alias("count"))


def error_groups(entries: DataFrame, which: str = "BOTH") -> DataFrame:
    """(msg, count, severity of the first entry, its idx, the first three idx) of the selected entries.

    Entries without an idx are named by (ts_ms, file_idx, line_no).  Entries without a
    message form one group with a blank message.
    """
    chosen = entries.where(error_selection(which)).select(F.coalesce("msg", F.lit("")).alias("msg"), "severity", time_order(entries).alias("_o"))
    counts = chosen.groupBy("msg").agg(F.count("*").alias("count"), F.min_by("severity", "_o").alias("severity"), F.min("_o").alias("first_idx"))
    firsts = chosen.withColumn("_r", F.row_number().over(Window.partitionBy("msg").orderBy("_o"))).where("_r <= 3")
    samples = firsts.groupBy("msg").agg(F.array_sort(F.collect_list("_o")).alias("samples"))
    return counts.join(samples, "msg")


def error_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))


def attribute_profile(entries: DataFrame, raw_col: str = "raw", id_col: str = "idx") -> DataFrame:
    """(path, type, count, distinct_values) over the flattened documents of all entries."""
    return flatten_json(entries, raw_col, id_col).groupBy("path", "type").agg(F.count("*").alias("count"), F.count_distinct("value").alias("distinct_values"))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def shorten(df: DataFrame, most: int, column: str = "msg") -> DataFrame:
    return df.withColumn(column, lt.shortened(F.col(column), most))
