"""Metric series: definitions, rates, statistics, anomalies, down-sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logtext as lt
from ..functions.flatten import data_rows
from .ranks import at_ranks
from .scan import changes, runs_above, with_previous

#: Definitions of disk metrics by suffix, for any device (fixed values).
DISK_DEFS = (
    ("reads", "Disk Reads", "ops/s", None), ("writes", "Disk Writes", "ops/s", None), ("read_time_ms", "Disk Read Time", "ms/s", None), ("write_time_ms", "Disk Write Time", "ms/s", None),
    ("io_queued_ms", "Disk I/O Queue", "ms/s", 500.0), ("io_time_ms", "Disk I/O Time", "ms/s", None), ("sectors_read", "Disk Sectors Read", "sectors/s", None), ("sectors_written", "Disk Sectors Written", "sectors/s", None),
)
#: Units that are never drawn on a logarithmic scale (fixed values).
LINEAR_UNITS = ("bytes", "bytes/s", "KB", "MB", "s", "%", "count")


def definitions(spark: SparkSession) -> DataFrame:
    """(path, display_name, unit, is_cumulative, threshold): the fixed table of known metrics."""
    rows = [(r["path"], r["display_name"], r["unit"], r["is_cumulative"] == "true", float(r["threshold"]) if r["threshold"] else None) for r in data_rows("metric_defs.csv")]
    return spark.createDataFrame(rows, "path string, display_name string, unit string, is_cumulative boolean, threshold double")


def dashboards(spark: SparkSession) -> DataFrame:
    """(dashboard, pos, path): the fixed dashboards; an empty path stands for every disk metric present."""
    return spark.createDataFrame([(r["dashboard"], int(r["pos"]), r["path"] or "") for r in data_rows("dashboards.csv")], "dashboard string, pos int, path string")


def with_definitions(samples: DataFrame, defs: DataFrame) -> DataFrame:
    """``samples`` with display_name, unit, is_cumulative and threshold.

    Paths without a definition take that of their suffix if they are disk metrics,
    else their last two parts, ``count`` and not cumulative.  Both tables are fixed
    and of a few hundred rows.
    """
    disk = samples.sparkSession.createDataFrame([(s, n, u, True, t) for s, n, u, t in DISK_DEFS], "_suffix string, _name string, _unit string, _cum boolean, _limit double")
    df = samples.join(F.broadcast(defs), "path", "left").withColumn("_suffix", F.when(lt.is_disk_metric(F.col("path")), F.substring_index("path", ".", -1)))
    df = df.join(F.broadcast(disk), "_suffix", "left")
    known = F.col("display_name").isNotNull()
    return df.select(
        *samples.columns,
        F.coalesce("display_name", "_name", lt.short_metric_name(F.col("path"))).alias("display_name"),
        F.coalesce("unit", "_unit", F.lit("count")).alias("unit"),
        F.coalesce("is_cumulative", "_cum", F.lit(False)).alias("is_cumulative"),
        F.when(known, F.col("threshold")).otherwise(F.col("_limit")).alias("threshold"),
    )


def dashboard_paths(paths: DataFrame, boards: DataFrame) -> DataFrame:
    """(dashboard, path) of the paths that are present; the disk dashboard takes all disk metrics."""
    here = paths.select("path").distinct()
    listed = here.join(F.broadcast(boards.where("path <> ''")), "path").select("dashboard", "path")
    disk = boards.where("path = ''").select("dashboard").withColumn("_disk", F.lit(True))
    found = here.withColumn("_disk", lt.is_disk_metric(F.col("path"))).where("_disk").join(F.broadcast(disk), "_disk").select("dashboard", "path")
    return listed.union(found).distinct()


def disk_metrics(paths: DataFrame) -> DataFrame:
    """(path) of the disk metrics among ``paths``, by name."""
    return paths.select("path").distinct().where(lt.is_disk_metric(F.col("path"))).orderBy("path")


def first_definitions(defined: DataFrame, order: Sequence[str] = ("source", "chunk_no")) -> DataFrame:
    """(path, display_name, unit, is_cumulative): of captures read together, the first that names a metric defines it.

    A path that none of them names has nulls.
    """
    named = F.col("display_name").isNotNull() & (F.col("display_name") != "")
    fields = F.when(named, F.struct("display_name", "unit", "is_cumulative"))
    return defined.groupBy("path").agg(F.min_by(fields, F.when(named, F.struct(*order))).alias("d")).select("path", "d.display_name", "d.unit", "d.is_cumulative")


def search_metrics(defined: DataFrame, query: str, k: int = 15) -> DataFrame:
    """The first ``k`` paths in decode order with ``query`` in their path or name."""
    found = defined.where(F.contains(F.lower("path"), F.lit(query.lower())) | F.contains(F.lower("display_name"), F.lit(query.lower())))
    return found.groupBy("path", "display_name").agg(F.min("path_ord").alias("path_ord")).orderBy("path_ord", "path").limit(k)


def selected(samples: DataFrame, boards: DataFrame, active: Sequence[str], custom: Sequence[str] = ()) -> DataFrame:
    """Samples of the active dashboards' paths and of custom paths."""
    paths = dashboard_paths(samples, boards.where(F.col("dashboard").isin(list(active)))).select("path")
    if custom:
        paths = paths.union(samples.sparkSession.createDataFrame([(p,) for p in custom], "path string")).distinct()
    return samples.join(paths.distinct(), "path", "left_semi")


def valued(samples: DataFrame) -> DataFrame:
    """Samples that have a value; a null and a NaN are none."""
    return samples.where(F.col("value").isNotNull() & ~F.isnan("value"))


def rates(samples: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """(path, ts_ms, value): change for each second at every sample but a path's first.

    A falling value and equal times give 0; samples without a value are left out.
    ``tie`` orders samples of equal time.
    """
    return _steps(samples, tie).select("path", "ts_ms", "value")


def _steps(samples: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Rates with the columns of ``tie``, so that what follows can put equal times in order."""
    steps = with_previous(valued(samples).select("path", "ts_ms", *tie, "value"), "path", ["ts_ms", *tie], ["ts_ms", "value"]).where("prev is not null")
    dv, dt = F.col("value") - F.col("prev.value"), F.col("ts_ms") - F.col("prev.ts_ms")
    return steps.select("path", "ts_ms", *tie, F.when((dt > 0) & (dv > 0), dv * 1000.0 / dt).otherwise(F.lit(0.0)).alias("value"))


def cumulative_rates(samples: DataFrame, defs: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Rates of the cumulative series; gauges give none."""
    return rates(with_definitions(samples, defs).where("is_cumulative").select(*samples.columns), tie)


def measured(samples: DataFrame, defs: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """(path, ts_ms, *tie, value) on the scale of thresholds: gauges as they are, rates of cumulative series."""
    defined = with_definitions(samples, defs)
    columns = ["path", "ts_ms", *tie, "value"]
    return defined.where("not is_cumulative").select(*columns).union(_steps(defined.where("is_cumulative").select(*columns), tie))


def ordered(samples: DataFrame) -> DataFrame:
    """Samples of each path with seq, their number in time order, of equal times by file, chunk and place."""
    return with_previous(samples, "path", ["ts_ms", "source", "chunk_no", "sample_no"], ["ts_ms"]).drop("prev").withColumnRenamed("place", "seq")


def time_range(samples: DataFrame) -> DataFrame:
    return samples.agg(F.coalesce(F.min("ts_ms"), F.lit(0)).alias("start_ms"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("end_ms"))


def window_stats(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """(path, n, min, max, avg, p99) over the closed window; p99 is the sorted value at floor(0.99 (n - 1)).

    Samples without a value don't count.
    """
    inside = valued(samples.where(F.col("ts_ms").between(start_ms, end_ms)))
    plain = inside.groupBy("path").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))
    ranks = at_ranks(inside, "path", "value", {"p99": lambda n: F.floor(0.99 * (n - 1))})
    return plain.join(ranks, "path")


def range_profile(defined: DataFrame) -> DataFrame:
    """(path, min, max, least_positive, largest_positive, log_scale): a wide positive range of an eligible unit is logarithmic."""
    pos = F.when(F.col("value") > 0, F.col("value"))
    out = defined.groupBy("path", "unit").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.min(pos).alias("least_positive"), F.max(pos).alias("largest_positive"))
    wide = F.col("largest_positive") / F.col("least_positive") > 1000
    return out.withColumn("log_scale", F.coalesce(wide & ~F.col("unit").isin(list(LINEAR_UNITS)), F.lit(False)))


def last_values(samples: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """(path, last_value, last_ms) of each path's last sample with a value."""
    key = F.struct("ts_ms", *tie)
    return valued(samples).groupBy("path").agg(F.max_by("value", key).alias("last_value"), F.max("ts_ms").alias("last_ms"))


def anomalies(samples: DataFrame, defs: DataFrame, boards: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """(dashboard, anomaly): whether a member's last value, or last rate if cumulative, is above its threshold."""
    judged = with_definitions(last_values(measured(samples, defs, tie), tie), defs).withColumn("above", F.coalesce(F.col("last_value") > F.col("threshold"), F.lit(False)))
    return dashboard_paths(samples, boards).join(judged.select("path", "above"), "path", "left").groupBy("dashboard").agg(F.coalesce(F.bool_or("above"), F.lit(False)).alias("anomaly"))


def exceedances(defined: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """(path, start_ms, end_ms, samples, peak): runs of samples above the threshold; ``tie`` orders samples of equal time.

    Samples without a value, and paths without a threshold, are left out.
    """
    marked = valued(defined).where("threshold is not null").select("path", "ts_ms", "value", (F.col("value") > F.col("threshold")).alias("above"), *[c for c in tie if c != "value"])
    return runs_above(marked, ["ts_ms", *tie])


def lttb_places(values: np.ndarray, most: int) -> np.ndarray:
    """Places kept by largest-triangle-three-buckets over sample numbers; the first and last always are.

    The bucket ahead includes the first place of the one after it.
    """
    n = len(values)
    if n <= most or most < 3:
        return np.arange(n)
    width = (n - 2) / (most - 2)
    kept = [0]
    for i in range(most - 2):
        start, end = int(i * width) + 1, min(int((i + 1) * width) + 1, n - 1)
        far = min(int((i + 2) * width) + 1, n - 1)
        x, y = (end + far) / 2, values[end : far + 1].mean()
        at = np.arange(start, end)
        a = kept[-1]
        if len(at) == 0:
            kept.append(start)
            continue
        area = np.abs((a - x) * (values[at] - values[a]) - (a - at) * (y - values[a]))
        kept.append(start + int(np.argmax(area)))
    return np.array([*kept, n - 1])


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the vertices of the convex hull of points sorted by x, the first and last among them."""
    if len(x) < 4:
        return np.arange(len(x))
    sides = []
    for sign in (1.0, -1.0):
        stack: list[int] = []
        for i in range(len(x)):
            while len(stack) > 1:
                a, b = stack[-2], stack[-1]
                if sign * ((x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a])) < 0:
                    break
                stack.pop()
            stack.append(i)
        sides.append(stack)
    return np.unique(np.concatenate(sides))


def _edges(n: int, most: int) -> np.ndarray:
    """First places of the buckets of a series of n, and of its last sample."""
    return np.concatenate([np.floor(np.arange(most - 2) * ((n - 2) / (most - 2))).astype(np.int64) + 1, [n - 1]])


def _pieces(most: int):
    """Task: hulls and sums of the parts of buckets in a batch; a series of few samples is kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            place, size = batch.column("place").to_numpy(), batch.column("n").to_numpy()
            value, ts = batch.column("value").to_numpy(), batch.column("ts_ms").to_numpy()
            new = np.flatnonzero(changes(batch.column("path"), None))
            out = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(batch)], strict=True):
                n = int(size[a])
                if n <= most or most < 3:
                    out.append((batch.column("path")[a].as_py(), n, -1, 0.0, 0, np.arange(a, b)))
                    continue
                bucket = np.searchsorted(_edges(n, most), place[a:b], side="right")
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for c, d in zip((a + cuts).tolist(), [*(a + cuts[1:]).tolist(), b], strict=True):
                    out.append((batch.column("path")[a].as_py(), n, int(bucket[c - a]), float(value[c:d].sum()), d - c, c + hull(place[c:d].astype(float), value[c:d])))
            path, n, bucket, total, count, at = zip(*out, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
            at = np.concatenate(at)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[at])) for c in (place, ts, value)]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(n), pa.array(bucket), pa.array(total), pa.array(count), *lists], names=["path", "n", "bucket", "total", "count", "places", "times", "values"])

    return run


def _triangles(most: int):
    """The kept points of one path, from the hulls of its buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place, ts, value = (np.concatenate(pdf[c].to_list()) for c in ("places", "times", "values"))
        order = np.argsort(place, kind="stable")
        place, ts, value = place[order], ts[order], value[order]
        n = int(pdf["n"].iloc[0])
        if n <= most or most < 3:
            return pd.DataFrame({"path": pdf["path"].iloc[0], "ts_ms": ts, "value": value, "place": place})
        edges = _edges(n, most)
        total, count = (np.bincount(pdf["bucket"], pdf[c], most) for c in ("total", "count"))
        first = np.searchsorted(place, edges)  # the first sample of a bucket is on its hull
        kept = [0]
        for i in range(most - 2):
            end, far = edges[i + 1], edges[min(i + 2, most - 2)]
            ahead = value[first[min(i + 2, most - 2)]]
            x, y = (end + far) / 2, (total[i + 2] * (far > end) + ahead) / (far - end + 1)
            at = slice(first[i], first[i + 1])
            a = kept[-1]
            area = np.abs((place[a] - x) * (value[at] - value[a]) - (place[a] - place[at]) * (y - value[a]))
            kept.append(int(first[i]) + int(np.argmax(area)))
        kept.append(len(place) - 1)
        return pd.DataFrame({"path": pdf["path"].iloc[0], "ts_ms": ts[kept], "value": value[kept], "place": place[kept]})

    return run


def lttb(samples: DataFrame, most: int = 2000, tie: Sequence[str] = ()) -> DataFrame:
    """(path, ts_ms, value, place) of at most ``most`` points of each path, those of ``lttb_places``.

    Samples without a value are left out.  The largest triangle on two given points
    has its third on the convex hull of a bucket, so tasks reduce their parts of the
    buckets to hulls and sums, and the sequential pass over a path sees these alone
    (a bucket whose samples all lie on its hull stays whole).  Means are sums of
    parts, so that triangles which differ by rounding alone may be chosen otherwise.
    """
    placed = with_previous(valued(samples).select("path", "ts_ms", "value", *[c for c in tie if c != "value"]), "path", ["ts_ms", *tie], ["ts_ms"]).select("path", "ts_ms", "value", "place")
    sizes = placed.groupBy("path").agg(F.count("*").alias("n"))
    pieces = placed.join(sizes, "path").mapInArrow(_pieces(most), "path string, n long, bucket long, total double, count long, places array<long>, times array<long>, values array<double>")
    return pieces.groupBy("path").applyInPandas(_triangles(most), "path string, ts_ms long, value double, place long")


def banded(defined: DataFrame) -> DataFrame:
    return defined.withColumn("band", lt.threshold_band(F.col("value"), F.col("threshold")))
