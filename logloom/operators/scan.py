"""Scans of sorted series that are cut into many tasks.

Rows are range-partitioned by series and order, so that a long series is many tasks
and a task holds runs of whole or cut series.  What crosses a border is one row a
partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..store import keep


def changes(key: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Where a sorted column differs from the row before; ``last`` is the value before the first row, if there was one."""
    same = pc.equal(key[1:], key[:-1])
    both = pc.and_(pc.is_null(key[1:]), pc.is_null(key[:-1]))
    inner = pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
    return np.concatenate([[last is None or last.as_py() != key[0].as_py()], ~inner])


def in_order(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """``df`` dealt by ranges of (by, order) and sorted within them."""
    return df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)


def with_previous(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``prev``, the ``columns`` of the row before in its series (null at the first), and ``place``, its number there from 0.

    Tasks look back within their partition and write their rows; a partition's last
    row and the length of its last series then reach the next one through the driver,
    one row a partition.
    """
    spark = ship(df.sparkSession)
    names = df.columns
    fields = [df.schema[c] for c in columns]
    prev = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    schema = T.StructType([*df.schema.fields, T.StructField("_prev", prev), T.StructField("_place", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, row, place = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            key = batch.column(names.index(by))
            new = changes(key, last and last[0])
            back = []
            for i, c in enumerate(columns):
                column = batch.column(names.index(c))
                before = pa.array([last[1][i].as_py() if last else None], column.type)
                back.append(pa.concat_arrays([before, column[:-1]]))
            struct = pa.StructArray.from_arrays(back, names=list(columns), mask=pa.array(new))
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            places = np.where(start < 0, place + at, at - start)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct, pa.array(places), pa.array(row + at), pa.array(np.full(n, part, np.int32))], names=[*names, "_prev", "_place", "_row", "_part"])
            last = key[n - 1], [batch.column(names.index(c))[n - 1] for c in columns]
            row, place = row + n, int(places[-1]) + 1

    scanned = keep(in_order(df, by, order).mapInArrow(run, schema), "scanned")
    ends = scanned.groupBy("_part").agg(F.min_by(by, "_row").alias("first"), F.max_by(F.struct(F.col(by).alias("key"), F.struct(*columns).alias("row"), F.col("_place").alias("place"), F.col("_row").alias("at")), "_row").alias("last"))
    carried, before, length = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = before is not None and before["key"] == r["first"]
        if goes_on:
            carried.append((r["_part"], tuple(before["row"]), length))
        before = r["last"]
        length = before["place"] + 1 + (length if goes_on and before["place"] == before["at"] else 0)
    carry = spark.createDataFrame(carried, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_carry", prev), T.StructField("_before", T.LongType())]))
    joined = scanned.join(F.broadcast(carry), "_part", "left")
    return joined.select(
        *names, F.when(F.col("_row") == 0, F.col("_carry")).otherwise(F.col("_prev")).alias("prev"), (F.col("_place") + F.when(F.col("_row") == F.col("_place"), F.coalesce("_before", F.lit(0))).otherwise(0)).alias("place")
    )


_RUN = "start_ms long, end_ms long, samples long, peak double, opens boolean, closes boolean, part int, at int"


def runs_above(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(path, start_ms, end_ms, samples, peak): runs of rows with ``above`` of (path, ts_ms, value, above, *order), in order.

    Tasks fold their rows into runs; those at the border of a partition, two a
    partition at most, then join their neighbours on the driver.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made: list[list] = []
        open_, last, first, at = None, None, True, 0

        def rows(found: list[list]) -> pa.RecordBatch:
            nonlocal at
            columns = list(zip(*found, strict=True))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_())
            at += len(found)
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array([part] * len(found), pa.int32()), pa.array(range(at - len(found), at), pa.int32())],
                names=["path", "start_ms", "end_ms", "samples", "peak", "opens", "closes", "part", "at"],
            )

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            key, above = batch.column("path"), batch.column("above").to_numpy(zero_copy_only=False)
            ts, value = batch.column("ts_ms").to_numpy(), batch.column("value").to_numpy(zero_copy_only=False)
            new = changes(key, last)
            was = np.concatenate([[open_ is not None], above[:-1]])
            if open_ is not None and (new[0] or not above[0]):
                made.append(open_)
                open_ = None
            starts = np.flatnonzero(above & (new | ~was))
            ends = np.flatnonzero(above & np.concatenate([new[1:] | ~above[1:], [True]])) + 1
            if above[0] and not new[0] and was[0]:
                starts = np.concatenate([[0], starts])
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                found = [key[a].as_py(), int(ts[a]), int(ts[b - 1]), b - a, float(value[a:b].max()), first and a == 0, False]
                if a == 0 and open_ is not None:
                    found = [open_[0], open_[1], found[2], open_[3] + found[3], max(open_[4], found[4]), open_[5], False]
                    open_ = None
                if b == n:
                    open_ = found
                else:
                    made.append(found)
            last, first = key[n - 1], False
            if len(made) > 10_000:
                yield rows(made)
                made = []
        if open_ is not None:
            made.append([*open_[:6], True])
        if not first:  # so that every partition with rows is known
            yield rows([*made, [None, None, None, 0, None, False, False]])

    runs = keep(in_order(df, "path", order).mapInArrow(run, "path string, " + _RUN), "runs")
    whole = runs.where("not opens and not closes and samples > 0").select("path", "start_ms", "end_ms", "samples", "peak")
    borders: dict[int, list] = {}
    for r in runs.where("opens or closes or samples = 0").collect():
        borders.setdefault(r["part"], []).append(r)
    edge, held = [], None
    for part in sorted(borders):
        rows_ = sorted((r for r in borders[part] if r["samples"]), key=lambda r: r["at"])
        opening = rows_[0] if rows_ and rows_[0]["opens"] else None
        closing = rows_[-1] if rows_ and rows_[-1]["closes"] else None
        if opening is not None and held is not None and held[0] == opening["path"]:
            held = (held[0], held[1], opening["end_ms"], held[3] + opening["samples"], max(held[4], opening["peak"]))
        else:
            edge += [held] if held is not None else []
            held = tuple(opening)[:5] if opening is not None else None
        if held is not None and closing is not opening:
            edge, held = [*edge, held], None
        if closing is not None and closing is not opening:
            held = tuple(closing)[:5]
    edge += [held] if held is not None else []
    return whole.unionByName(df.sparkSession.createDataFrame(edge, whole.schema))
