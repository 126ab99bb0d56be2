"""Log files of a cluster as one table that grows: load, append, and what is kept up to date with it.

A folder holds versions.  A version has the new files' entries, the stacked entries and
the counts of the days they touch, the list of all files with their nodes, and which
version of each day is current.  Its number is written last, so that a run that was
cut short leaves nothing that a reader sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import breakdowns as b
from ..operators import nodes
from ..store import keep
from . import logs

DAY_MS = 86_400_000
_FILES = "file_path string, file_idx int, hostname string, port int, identity_source string"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def version(spark: SparkSession, folder: str) -> int:
    """The last version that was completed; 0 before the first."""
    found = _read(spark, folder, "versions")
    return 0 if found is None else found.agg(F.max("version")).first()[0]


def _files(spark: SparkSession, folder: str, last: int) -> DataFrame:
    if not last:
        return spark.createDataFrame([], _FILES)
    return spark.read.parquet(f"{folder}/files/version={last}")


def _current(df: DataFrame, spark: SparkSession, folder: str, last: int) -> DataFrame:
    """Rows of the current version of each day; one row a day decides."""
    days = spark.read.parquet(f"{folder}/days/version={last}")
    return df.join(days, ["version", "day"], "left_semi").drop("version", "day")


def cluster_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(node_idx, hostname, port, path, merged_paths) of all files loaded."""
    return nodes.node_table(nodes.merged_nodes(_files(spark, folder, version(spark, folder))))


def cluster_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The stacked entries of all files loaded."""
    return _current(spark.read.parquet(f"{folder}/stacked"), spark, folder, version(spark, folder))


def cluster_breakdowns(spark: SparkSession, folder: str) -> DataFrame:
    """(dimension, label, count) over all entries, from the counts of days."""
    counts = _current(spark.read.parquet(f"{folder}/counts"), spark, folder, version(spark, folder))
    return counts.groupBy("dimension", "label").agg(F.sum("count").alias("count"))


def _day(ms: str):
    return F.floor(F.greatest(F.col(ms), F.lit(-1)) / DAY_MS).cast("long")


def _touched(base: DataFrame, fresh: DataFrame, window_ms: int) -> DataFrame:
    """(day) of the new entries, and of days that equal entries link to them over midnight, however many.

    Only entries within ``window_ms`` of a midnight can link two days.
    """
    days = fresh.select("day").distinct()
    near = base.where(f"ts_ms >= 0 and (ts_ms % {DAY_MS} < {window_ms} or ts_ms % {DAY_MS} >= {DAY_MS - window_ms})").select(*nodes.KEY, "ts_ms", "day")
    before = F.lag(F.struct("ts_ms", "day")).over(Window.partitionBy(*nodes.KEY).orderBy("ts_ms"))
    links = near.withColumn("_b", before).where((F.col("_b.day") < F.col("day")) & (F.col("ts_ms") - F.col("_b.ts_ms") <= window_ms)).select(F.col("_b.day").alias("a"), F.col("day").alias("b")).distinct()
    links = keep(links.union(links.select("b", "a")), "midnights")
    days = keep(days, "days")
    while True:  # a chain of midnights is followed day by day
        more = days.join(links, days["day"] == links["a"]).select(F.col("b").alias("day")).distinct().join(days, "day", "left_anti")
        more = keep(more, "days")
        if more.isEmpty():
            return days
        days = keep(days.union(more), "days")


def append_lines(spark: SparkSession, folder: str, lines: DataFrame, stack: bool = True, window_ms: int = 1) -> int:
    """Load (file_path, line_no, raw) of files that ``folder`` doesn't hold yet; the version that then holds them.

    Files are numbered on in the order of their paths, nodes by the identity of all
    files; a file whose path is known is left out, so that a repeated call changes
    nothing.  Of the entries loaded before, only those of days that the new ones
    touch are read and stacked again, and only these days are counted again.
    """
    last = version(spark, folder)
    known = _files(spark, folder, last)
    fresh = lines.join(known.select("file_path"), "file_path", "left_anti")
    found = keep(nodes.file_identity(fresh.select("file_path", "line_no", "raw")), "identity")
    if found.isEmpty():
        return last
    new = last + 1
    shift = (known.agg(F.max("file_idx")).first()[0] if last else None)
    place = F.row_number().over(Window.orderBy("file_path")) + F.lit(-1 if shift is None else shift)  # one row a file
    files = known.unionByName(found.withColumn("file_idx", place.cast("int")))
    files.write.mode("overwrite").parquet(f"{folder}/files/version={new}")
    files = spark.read.parquet(f"{folder}/files/version={new}")
    owner = nodes.merged_nodes(files).select("file_path", "file_idx", "node_idx")
    entries = logs.parse_log_lines(fresh.drop("file_idx", "node_idx", "node_set").join(owner, "file_path")).withColumn("node_set", F.array("node_idx"))
    entries.withColumn("day", _day("ts_ms")).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/base/version={new}")
    base = spark.read.parquet(f"{folder}/base").where(F.col("version") <= new)
    days = _touched(base, base.where(F.col("version") == new), window_ms if stack else 0)
    again = base.join(days, "day", "left_semi").drop("version")
    alone = again.drop("day")
    made = (nodes.stacked(alone, window_ms) if stack else alone.withColumn("alts", F.lit(None).cast(nodes.ALT))).withColumn("day", _day("ts_ms"))
    made.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/stacked/version={new}")
    made = spark.read.parquet(f"{folder}/stacked/version={new}")
    pair = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in b.DIMENSIONS])).alias("p")
    counts = made.select("day", pair).where("p.label is not null and p.label <> ''").groupBy("day", "p.dimension", "p.label").agg(F.count("*").alias("count"))
    counts.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/counts/version={new}")
    ours = days.select("day", F.lit(new).alias("version"))
    if last:
        ours = ours.union(spark.read.parquet(f"{folder}/days/version={last}").select("day", "version").join(days, "day", "left_anti"))
    ours.write.mode("overwrite").parquet(f"{folder}/days/version={new}")
    spark.range(1).select(F.lit(new).alias("version")).write.mode("append").parquet(f"{folder}/versions")
    return new


def append_files(spark: SparkSession, folder: str, paths: str | Sequence[str], **how) -> int:
    """``append_lines`` of whole files."""
    return append_lines(spark, folder, logs.scan(spark, paths), **how)
