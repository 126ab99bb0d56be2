"""Structured logs: scan, parse, order, sample and report."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import logtext as lt
from ..functions.shapes import with_shape
from ..session import ship
from ..store import keep

ENVELOPE = "t string, s string, c string, id bigint, ctx string, msg string, host string, attr string, _corrupt string"
FIELDS = ("ts_ms", "severity_rank", "severity", "component", "ctx", "conn_id", "msg", "ns", "op_type", "shape", "driver", "duration_ms")


def scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file_path, line_no, raw): every line of every file, numbered from 1 in file order.

    A line's number is the count of lines in the blocks of its file before its own,
    plus its place there, so a long file is many tasks and no window sees lines.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    placed = lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    blocks = placed.groupBy("file_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_before", before)  # one row a block
    numbered = placed.join(blocks, ["file_path", "_block"])
    return numbered.select("file_path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias("line_no"), "raw")


def _text(value):
    return F.nullif(value, F.lit(""))


def with_fields(lines: DataFrame, honour_offset: bool = False) -> DataFrame:
    """``lines`` (any DataFrame with ``raw``) with ``ok`` and FIELDS added; fields of bad lines are null.

    A line is bad if it is not a JSON object or has no ``t``.  Of repeated keys the
    last counts.  Numbers in text fields are taken as text; ``duration_ms`` takes
    JSON integers only and is -1 without one.
    """
    j = F.from_json("raw", ENVELOPE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    df = lines.withColumn("_j", j)
    df = df.withColumn("ok", F.coalesce(F.col("_j._corrupt").isNull() & F.col("_j.t").isNotNull(), F.lit(False)))
    attr = F.col("_j.attr")
    command = F.get_json_object(attr, "$.command")
    time = F.coalesce(F.get_json_object("raw", "$.t.$date"), F.when(~F.col("_j.t").startswith("{"), F.col("_j.t")), F.lit(""))
    duration = F.when(attr.rlike(r'"durationMillis"\s*:\s*-?\d+\s*[,}]'), F.get_json_object(attr, "$.durationMillis").try_cast("int"))
    rank = lt.severity_rank(F.col("_j.s"))
    made = {
        "ts_ms": lt.epoch_ms(time, honour_offset), "severity_rank": rank, "severity": lt.severity_label(rank), "component": _text(F.col("_j.c")), "ctx": F.col("_j.ctx"),
        "conn_id": lt.connection_id(F.col("_j.ctx")), "msg": _text(F.col("_j.msg")), "ns": _text(F.get_json_object(attr, "$.ns")),
        "op_type": F.when(command.startswith("{"), lt.op_type(command)), "_filter": F.coalesce(F.get_json_object(command, "$.filter"), F.get_json_object(command, "$.query")),
        "driver": lt.driver_label(F.get_json_object(attr, "$.client.driver.name"), F.get_json_object(attr, "$.client.driver.version")), "duration_ms": F.coalesce(duration, F.lit(-1)),
    }
    kept = [c for c in lines.columns if c not in (*FIELDS, "ok")]
    df = df.select(*kept, "ok", *[F.when(F.col("ok"), v).alias(k) for k, v in made.items()])
    return with_shape(df, "_filter").select(*kept, "ok", *FIELDS)


def parse_log_lines(lines: DataFrame, honour_offset: bool = False) -> DataFrame:
    """The entries among ``lines``: ``with_fields`` without the bad ones."""
    return with_fields(lines, honour_offset).where("ok").drop("ok")


def load_cluster(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Entries of several files with file_idx (place of the path in the sorted list), one node a file."""
    lines = scan(spark, paths)
    files = lines.select("file_path").distinct()
    numbered = files.withColumn("file_idx", (F.row_number().over(Window.orderBy("file_path")) - 1).cast("int"))  # one row a file
    entries = parse_log_lines(lines.join(numbered, "file_path"))
    return entries.withColumn("node_idx", F.col("file_idx")).withColumn("node_set", F.array("node_idx"))


def with_index(entries: DataFrame, order: Sequence[str] = ("ts_ms", "file_idx", "line_no")) -> DataFrame:
    """``entries`` with ``idx``, their place in time order from 0, without a window over all rows.

    Rows are range-partitioned, sorted and written to the shared folder, so that
    every reader sees the same partitions; a row's place is its partition's offset
    (one number a partition) plus its place there.
    """
    ranked = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranked = keep(ranked.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1)), "indexed")
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))  # one row a partition
    return ranked.join(F.broadcast(offsets), "_part").withColumn("idx", F.col("_off") + F.col("_row")).drop("_at", "_part", "_row", "_off")


def _slots(keys: list[tuple]):
    """Task: how many entries have so many of the sorted ``keys`` at or before them."""
    firsts = np.array([k[0] for k in keys], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            first = batch.column(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(firsts, first, "left"), np.searchsorted(firsts, first, "right")
            for i in np.flatnonzero(low < high).tolist():  # as early as a key: the other columns decide
                low[i] = bisect_right(keys, tuple(c[i].as_py() for c in batch.columns), int(low[i]), int(high[i]))
            seen += np.bincount(low, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["n", "count"])

    return run


def places(entries: DataFrame, wanted: DataFrame, order: Sequence[str] = ("ts_ms", "file_idx", "line_no")) -> DataFrame:
    """(order..., idx) of the few rows ``wanted``: how many entries stand before each, in one pass over ``entries``.

    ``wanted`` is what a report shows, some hundred rows; they come to the driver.
    Tasks search their entries' places among them, and give one count for each.
    """
    keys = sorted(tuple(r) for r in wanted.select(*order).distinct().collect())
    types = {f.name: f.dataType for f in wanted.schema.fields}
    schema = ", ".join(f"{c} {types[c].simpleString()}" for c in order)
    if not keys:
        return entries.sparkSession.createDataFrame([], f"{schema}, idx long")
    ship(entries.sparkSession)
    upto = entries.select(*order).mapInArrow(_slots(keys), "n long, count long").groupBy("n").agg(F.sum("count").alias("count")).collect()
    before = [sum(r["count"] for r in upto if r["n"] <= i) for i in range(len(keys))]
    return entries.sparkSession.createDataFrame([(*k, n) for k, n in zip(keys, before, strict=True)], f"{schema}, idx long")


def sampled(entries: DataFrame, ratio: float, by: Sequence[str] = ("file_path",), order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Every k-th valid line of each file, the first included, k being 1 / ratio rounded.

    A line's number in its file is its place among all lines less that of the file's first.
    """
    if ratio >= 1:
        return entries
    k = max(1, int(1 / ratio + 0.5))
    own = "idx" in entries.columns
    placed = with_index(entries.withColumnRenamed("idx", "_idx") if own else entries, [*by, *order])
    firsts = placed.groupBy(*by).agg(F.min("idx").alias("_from"))  # one row a file
    chosen = placed.join(firsts, [*by]).where((F.col("idx") - F.col("_from")) % k == 0).drop("idx", "_from")
    return (chosen.withColumnRenamed("_idx", "idx") if own else chosen).select(*entries.columns)


def parse_health(fields: DataFrame, by: str = "file_path") -> DataFrame:
    """(by, n_ok, n_failed, no_entry) of ``with_fields`` rows; ``no_entry`` marks files with lines but no entry."""
    counts = fields.where(F.length(F.trim("raw")) > 0).groupBy(by).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    return counts.withColumn("no_entry", F.col("n_ok") == 0)


def classify_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, kind) with kind ``capture`` or ``log``; each path once, hidden files left out, by name."""
    shown = paths.dropDuplicates([path_col]).where(~lt.base_name(F.col(path_col)).startswith("."))
    return shown.select(F.col(path_col).alias("path"), F.when(lt.is_capture_path(F.col(path_col)), "capture").otherwise("log").alias("kind")).orderBy("path")


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind) of the files of a folder in any store that Spark reads, by name; hidden files and folders are left out.

    The listing is the driver's, as Spark's own are.  Files named ``_*`` are listed, but
    Spark's readers skip them.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return classify_paths(spark.createDataFrame([(f.getPath().toString(),) for f in found if not f.isDirectory()], "path string"))


def append_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new entries as one table in time order, indexed anew; new files number on from the old ones."""
    shift = old.agg(F.max("file_idx")).first()[0]
    moved = new.withColumn("file_idx", (F.col("file_idx") + F.lit(0 if shift is None else shift + 1)).cast("int"))
    moved = moved.withColumn("node_idx", F.col("file_idx")).withColumn("node_set", F.array("node_idx"))
    return with_index(old.drop("idx").unionByName(moved.drop("idx"), allowMissingColumns=True))
