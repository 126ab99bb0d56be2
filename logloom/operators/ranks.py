"""Exact order statistics of many groups at once, without sorting a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep

#: Approximate quantiles that a group is cut at, their accuracy, and how many rows are told apart by value at once.
CUTS, ACCURACY, FEW = 500, 10_000, 100_000


def at_ranks(df: DataFrame, by: str, value: str, wanted: Mapping[str, Callable[[Column], Column]], cuts: int = CUTS, few: int = FEW) -> DataFrame:
    """(by, *wanted): of each group the value at a place of its sorted values, from 0; a function makes the place of the group's size.

    A round takes the approximate quantiles on either side of a place and counts the
    rows below, at, between, at and above them, exactly; it goes on where the place
    is, which leaves some three of ``cuts`` parts, until that has ``few`` rows or one
    value.  Then distinct values are counted.  So a window sees ``few`` rows of a group
    at most, whatever its size.  Values are numbers other than null and NaN.
    """
    v, low, high = F.col("_v"), F.col("low"), F.col("high")
    rows = df.select(by, F.col(value).cast("double").alias("_v"), F.col(value).alias("_value"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("rank")) for name, place in wanted.items()])).alias("r")
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    key = [by, "name", "rank", "below"]
    open_ = keep(sizes.select(by, ranks, "low", "high", "n").select(by, "r.name", "r.rank", F.lit(0).cast("long").alias("below"), "low", "high", "n"), "ranks")
    inside = lambda bounds: rows.join(bounds, by).where(v.between(low, high))
    more = (F.col("n") > few) & (low < high)
    while open_.where(more).limit(1).count():
        quantiles = inside(open_.where(more)).groupBy(*key, "low", "high", "n").agg(F.percentile_approx("_v", [i / cuts for i in range(cuts + 1)], ACCURACY).alias("q"))
        near = F.floor((F.col("rank") - F.col("below") + 0.5) / F.col("n") * cuts).cast("int")
        bracket = keep(quantiles.select(*key, "low", "high", F.get("q", F.greatest(near - 1, F.lit(0))).alias("a"), F.get("q", F.least(near + 2, F.lit(cuts))).alias("b")), "bracket")
        part = F.when(v < F.col("a"), 0).when(v == F.col("a"), 1).when(v < F.col("b"), 2).when(v == F.col("b"), 3).otherwise(4)
        counted = inside(bracket).groupBy(*key, part.alias("part")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(by, "name").orderBy("part"))  # five rows
        found = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        found = found.select(by, "name", "rank", (F.col("upto") - F.col("n")).alias("below"), "low", "high", "n")
        open_ = keep(found.unionByName(open_.where(~more)), "ranks")
    each = inside(open_).groupBy(*key, "_value").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(by, "name").orderBy("_value"))
    hit = each.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    return hit.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in wanted])
