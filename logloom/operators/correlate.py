"""Joins of metrics and log entries in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import valued

HALF_WIDTH_MS = 30_000
#: Paths of probes up to which samples are filtered by their list; beyond, by a join.
FEW_PATHS = 1_000
#: Cells of a window, about, and the power of two of the shortest cell in milliseconds.
CELLS = 64
LEAST_CELL = 15


def window_cells(windows: DataFrame) -> DataFrame:
    """``windows`` with _span and _cell: each in the cells it touches, all of one length, a power of two.

    A cell is at least a 64th of its window long, so that a window of any length is
    65 rows at most, and a long one still many groups.
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)) / CELLS
    span = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(length)), F.lit(LEAST_CELL))).cast("long")
    sized = windows.where("start_ms <= end_ms").withColumn("_span", span)
    return sized.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_ms") / F.col("_span")), F.floor(F.col("end_ms") / F.col("_span")))))


def events_in_windows(entries: DataFrame, windows: DataFrame) -> DataFrame:
    """Entries joined with every closed window [start_ms, end_ms] that holds their time.

    Both sides meet on cells of time, an equi-join that shuffles and splits like any
    other.  A window stands in some cells of the length that suits it; an entry is
    one row for each length in use (at most 50, as they double).  Columns of both
    are kept.
    """
    cells = window_cells(windows)
    spans = [r["_span"] for r in cells.select("_span").distinct().collect()]
    if not spans:
        return entries.join(cells.drop("_span", "_cell"), F.lit(False))
    at = entries.withColumn("_span", F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(spans)]))).withColumn("_cell", F.floor(F.col("ts_ms") / F.col("_span")))
    near = at.join(cells, ["_span", "_cell"])
    return near.where(F.col("ts_ms").between(F.col("start_ms"), F.col("end_ms"))).drop("_span", "_cell")


def events_near(entries: DataFrame, instants: DataFrame, half_ms: int = HALF_WIDTH_MS, at: str = "at_ms") -> DataFrame:
    """Entries within ``half_ms`` of each instant, both ends included."""
    windows = instants.withColumn("start_ms", F.col(at) - half_ms).withColumn("end_ms", F.col(at) + half_ms)
    return events_in_windows(entries, windows).drop("start_ms", "end_ms")


def nearest_samples(probes: DataFrame, samples: DataFrame, at: str = "at_ms", span_ms: int = 3_600_000, tie: Sequence[str] = ("value",)) -> DataFrame:
    """(path, at, ts_ms, value): for each probe (path, at) the sample of its path closest in time.

    Of two as close the earlier counts; before the first and after the last sample
    those; among samples of equal time the first ahead and the last behind.  Probes
    of a path without samples have nulls; samples without a value are none.  ``tie``
    orders samples of equal time.

    A path is cut into spans of time, so that a long series is many groups; each
    span knows the last sample before it and the first after it.  What lies ahead is
    what came before in descending order: a frame that ends with the partition would be
    read again for each row.  Samples of paths without probes are left out at once.
    """
    key = lambda t: F.floor(F.col(t) / span_ms)
    paths = probes.select("path").where("path is not null").distinct()
    few = [r["path"] for r in paths.limit(FEW_PATHS + 1).collect()]
    probed = samples.join(paths, "path", "left_semi") if len(few) > FEW_PATHS else samples.where(F.col("path").isin(few))
    s = valued(probed).select("path", "ts_ms", "value", (F.struct(*tie) if tie else F.lit(0)).alias("_seq")).withColumn("_span", key("ts_ms"))
    p = probes.select("path", F.col(at)).distinct().withColumn("_span", key(at))
    point = F.struct("ts_ms", "_seq", "value")
    edges = s.groupBy("path", "_span").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    spans = edges.select("path", "_span").union(p.select("path", "_span")).distinct().join(edges, ["path", "_span"], "left")
    # one row for each path and span
    earlier = lambda by, column, *order: F.last(column, True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("path", "_span", earlier(["path"], "last", "_span").alias("before"), earlier(["path"], "first", F.desc("_span")).alias("after"))
    null = F.lit(None)
    both = s.select("path", "_span", F.col("ts_ms").alias("t"), F.lit(1).alias("kind"), "_seq", point.alias("sample")).union(
        p.select("path", "_span", F.col(at).alias("t"), F.lit(0).alias("kind"), null.cast(s.schema["_seq"].dataType).alias("_seq"), null.cast(s.select(point.alias("x")).schema["x"].dataType).alias("sample"))
    )
    order = ["t", "kind", "_seq"]
    both = both.withColumn("back", earlier(["path", "_span"], "sample", *order)).withColumn("ahead", earlier(["path", "_span"], "sample", *map(F.desc, order)))
    hits = both.where("kind = 0").join(spans, ["path", "_span"])
    back, ahead = F.coalesce("back", "before"), F.coalesce("ahead", "after")
    forward = ahead.isNotNull() & (back.isNull() | (ahead["ts_ms"] - F.col("t") < F.col("t") - back["ts_ms"]))
    chosen: Column = F.when(forward, ahead).otherwise(back)
    return hits.withColumn("_c", chosen).select("path", F.col("t").alias(at), F.col("_c.ts_ms").alias("ts_ms"), F.col("_c.value").alias("value"))
