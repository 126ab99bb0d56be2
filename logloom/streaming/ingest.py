"""Incremental ingest of log files, and results kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import breakdowns as b
from ..operators.nodes import KEY, stacked
from ..sources.logs import parse_log_lines
from ..store import keep


def stream_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(file_path, raw) of every new file in ``folder``."""
    lines = spark.readStream.options(**options).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Entries of new files appended to the Parquet table ``out``; the checkpoint knows the files seen."""
    made = parse_log_lines(stream_lines(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (made.trigger(availableNow=True) if available_now else made).start()


def live_breakdowns(entries: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps counts of every breakdown dimension, and a sketch of the connections, of a stream of entries in ``folder``.

    Each batch writes its own counts under its number and reads nothing older; a batch
    that is run again after a failure takes the place of its former counts, so that
    every entry counts once.  ``live_counts`` and ``live_connections`` add them up.
    """

    def add(batch: DataFrame, number: int) -> None:
        counts = b.breakdowns(batch)
        seen = batch.where("conn_id > 0").agg(F.hll_sketch_agg("conn_id").alias("sketch"), F.count("*").alias("n")).where("n > 0").select("sketch")
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        seen.write.mode("overwrite").parquet(f"{folder}/connections/batch={number}")

    made = entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if available_now else made).start()


def _parts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What is merged up to some batch, and the batches after it."""
    schema = {"counts": "dimension string, label string, count long", "connections": "sketch binary"}[name]
    batches = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}")
    merged = batches.where("batch < 0").agg(F.max(-F.col("batch"))).first()[0]
    if merged is None:
        return batches
    return batches.where((F.col("batch") == -merged) | (F.col("batch") >= merged))


def live_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(dimension, label, count) of all entries that ``live_breakdowns`` has seen."""
    return _parts(spark, folder, "counts").groupBy("dimension", "label").agg(F.sum("count").alias("count"))


def live_connections(spark: SparkSession, folder: str) -> DataFrame:
    """One row: about how many connections they are of (a sketch, some 2 per cent off)."""
    return _parts(spark, folder, "connections").agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("connections"))


def merge_live(spark: SparkSession, folder: str) -> None:
    """Merge the batches of ``folder`` into one part, so that reading it does not grow with their number.

    The part of batches 0 to k - 1 is stored as batch -k; they are not read from then on.
    """
    batches = spark.read.schema("batch long").parquet(f"{folder}/counts")
    last = batches.agg(F.max("batch")).first()[0]
    if last is None or last < 0:
        return
    upto = last + 1
    for name, made in (("connections", _parts(spark, folder, "connections").agg(F.hll_union_agg("sketch").alias("sketch")).where("sketch is not null")), ("counts", live_counts(spark, folder))):
        made.write.mode("overwrite").parquet(f"{folder}/{name}/batch={-upto}")


def restack(old: DataFrame, new: DataFrame, window_ms: int = 1, old_stacked: DataFrame | None = None) -> DataFrame:
    """Stacked entries of ``old`` and ``new`` together, redoing only what new entries touch.

    Both tables are unstacked; ``old_stacked`` is what an earlier call gave for ``old``.
    Entries of equal key no more than ``window_ms`` apart form islands, which no leader
    reaches across: those without a new entry pass through as they were stacked, the
    others are stacked again as a whole.  For use inside ``foreachBatch``.
    """
    place = ["file_idx", "line_no"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in KEY]
    line = Window.partitionBy(*names).orderBy("ts_ms", *place)
    starts = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(line) > window_ms, F.lit(True)).cast("int")
    both = both.withColumn("_starts", starts).withColumn("_island", F.sum("_starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    touched = F.max("_new").over(Window.partitionBy(*names, "_island"))
    both = keep(both.withColumn("_redo", (F.col("ts_ms") >= 0) & (touched == 1)), "islands")
    redo = stacked(both.where("_redo").drop("_new", "_starts", "_island", "_redo"), window_ms)
    rest = both.where("not _redo")
    if old_stacked is None:
        return redo.unionByName(stacked(rest.drop("_new", "_starts", "_island", "_redo"), window_ms))
    untimed = stacked(rest.where("_new = 1").drop("_new", "_starts", "_island", "_redo"), window_ms)
    return redo.unionByName(untimed).unionByName(old_stacked.join(rest.where("_new = 0").select(*place), place, "left_semi").select(*redo.columns))
