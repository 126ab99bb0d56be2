"""Shards of equal document counts that keep linked documents together.

Documents are linked by the lines they share: each distinct line that two or more hold is
a hyperedge, and groups of equal texts are one node.  Nodes start in equal runs of the
order by their rarest shared line.  Balanced label propagation then moves them towards
the shards of what they are linked with while that pays, never beyond a shard's quota.
What a shard holds beyond its exact share at the end, the least attached, goes to the
shards that have less.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep

#: By how much a shard may exceed the mean while documents move.
SLACK = 0.03
#: Rounds at most, and the share of documents that a round must move for another one.
ROUNDS, LEAST_MOVED = 10, 0.005
#: Classes of gain by which moves into a shard are let in, and parts of each class.
GAINS, PARTS = 8, 8


def _let_in(flow: list, load: dict[int, int], limit: float) -> list[tuple[int, int, int, int]]:
    """The cells (label, best, gain, part) of wishes that may move, so that no shard that grows exceeds ``limit``.

    The least gains into a shard are turned down first; what then stays counts against
    its own shard again, until all fit.
    """
    into = defaultdict(list)
    load = defaultdict(int, load)
    for r in sorted(flow, key=lambda r: (-r["gain"], r["part"], r["label"])):
        into[r["best"]].append(r)
        load[r["best"]] += r["n"]
        load[r["label"]] -= r["n"]
    while over := [s for s in into if into[s] and load[s] > limit]:
        for s in over:
            while into[s] and load[s] > limit:
                r = into[s].pop()
                load[s] -= r["n"]
                load[r["label"]] += r["n"]
    return [(r["label"], r["best"], r["gain"], r["part"]) for cells in into.values() for r in cells]


def _ranked(rows: DataFrame, order: list, n: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``n`` over all rows before each in the order; no task holds more than its partition."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = keep(placed.withColumn("part", F.shiftright("at", 33)), "placed")
    parts = placed.groupBy("part").agg(F.sum(n).alias("all"))  # one row a partition
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier"))
    within = F.sum(n).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
    return placed.join(F.broadcast(parts), "part").withColumn("before", F.col("earlier") + within).drop("at", "part", "earlier")


def _pulls(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, label, pull): how strongly the other holders of a group's lines in a shard draw it there."""
    here = links.join(labels.select("group", "label"), "group")
    mass = here.groupBy("token", "label").agg(F.sum("n").alias("there"))
    both = here.withColumnRenamed("label", "own").join(keep(mass, "mass"), "token")
    others = F.col("there") - F.when(F.col("own") == F.col("label"), F.col("n")).otherwise(0)
    return both.groupBy("group", "label").agg(F.sum(F.col("weight") * others / F.sqrt("mass")).alias("pull"))


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, wanted, shard, slot) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8, a null text having none; ``wanted`` is
    the shard that propagation chose, ``shard`` the one in which counts are at most
    one apart, ``slot`` the place in it, from 0 without gaps.  Groups of equal texts
    (null and empty are equal) move as one, but for those larger than a quarter of a
    shard, which are split by row.  Empty lines link nothing.  Repeated rows are rows
    like others, in any order among themselves.  Other columns are ignored; an empty
    table gives an empty result.  Propagation ends when a round moves fewer than
    LEAST_MOVED of all rows, and after ``rounds`` rounds at the latest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    rows = rows.select("id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").cast("long").alias("crc"), F.xxhash64("text").alias("hash"), lines.alias("tokens"))
    rows = keep(rows.select("id", "size", "crc", F.xxhash64("hash", "crc", "size").alias("same"), "tokens"), "sizes")
    total = rows.count()
    mean = total / shards
    # at most 4 * shards groups are that large
    large = keep(rows.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > max(mean / 4, 1)).select("same", F.ceil(4 * F.col("n") / max(mean, 4)).alias("pieces")), "large")
    rows = rows.join(F.broadcast(large), "same", "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id", "same"), F.col("pieces"))).otherwise(0)
    rows = keep(rows.select("id", "size", "crc", F.xxhash64("same", piece).alias("group"), "tokens"), "grouped")
    members = rows.groupBy("group").agg(F.count("*").alias("n"))
    held = rows.select("group", F.explode("tokens").alias("token")).distinct()
    links = keep(held.join(members, "group").select("group", "n", "token"), "holders")
    shared = links.groupBy("token").agg(F.count("*").alias("holders"), F.sum("n").alias("mass"), F.bit_xor(F.xxhash64("group")).alias("who")).where("holders > 1")
    # lines of the very same groups are one link of their number's weight
    shared = keep(shared.groupBy("who", "holders", "mass").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "mass", "weight"), "shared")
    links = keep(links.join(shared, "token").select("group", "n", "token", "mass", "weight"), "links")
    rarest = links.groupBy("group").agg(F.min(F.struct("mass", "token")).alias("r")).select("group", F.col("r.token").alias("rarest"))
    start = _ranked(members.join(rarest, "group", "left").select("group", "n", F.coalesce("rarest", "group").alias("rarest")), ["rarest", "group"], F.col("n"))
    labels = keep(start.select("group", "n", F.least(F.floor(F.col("before") * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("label")), "labels")
    for turn in range(rounds):
        pull = keep(_pulls(links, labels), "pulls")
        best = pull.groupBy("group").agg(F.max(F.struct(F.round("pull", 9).alias("pull"), (-F.col("label")).alias("label"))).alias("b"))
        best = best.select("group", (-F.col("b.label")).alias("best"), F.col("b.pull").alias("pull"))
        own = labels.join(best, "group", "left").join(pull.select("group", "label", F.col("pull").alias("stay")), ["group", "label"], "left")
        gain = F.col("pull") - F.coalesce("stay", F.lit(0.0))
        # half of the groups at a time, so that two do not change places forever
        wish = (gain > 1e-6) & (F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(2)) == 0)
        cell = [F.least(F.floor(4 * gain), F.lit(GAINS - 1)).cast("int").alias("gain"), F.pmod(F.xxhash64("group", F.lit(-1)), F.lit(PARTS)).cast("int").alias("part")]
        own = keep(own.select("group", "n", "label", F.when(F.coalesce(wish, F.lit(False)), F.col("best")).alias("best"), *cell), "wishes")
        load = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        flow = own.where("best is not null").groupBy("label", "best", "gain", "part").agg(F.sum("n").alias("n")).collect()  # shards ** 2 * GAINS * PARTS rows at most
        moves = docs.sparkSession.createDataFrame(_let_in(flow, load, (1 + SLACK) * mean), "label int, best int, gain int, part int")
        moved = own.join(F.broadcast(moves.withColumn("go", F.lit(True))), ["label", "best", "gain", "part"], "left")
        labels = keep(moved.select("group", "n", F.when(F.col("go"), F.col("best")).otherwise(F.col("label")).alias("label"), "go"), "labels")
        if (labels.where("go").agg(F.sum("n")).first()[0] or 0) < LEAST_MOVED * max(total, 1):
            break
    stay = _pulls(links, labels).join(labels.select("group", "label"), ["group", "label"]).select("group", F.round("pull", 9).alias("stay"))
    placed = rows.select("id", "size", "crc", "group").join(labels.select("group", "label"), "group").join(stay, "group", "left")
    placed = placed.select("id", "size", "crc", "label", (-F.coalesce("stay", F.lit(0.0))).alias("loose"), "group")
    load = {r["label"]: r["count"] for r in placed.groupBy("label").count().collect()}  # one row a shard
    quota = dict.fromkeys(range(shards), total // shards)
    for s in sorted(range(shards), key=lambda s: (-load.get(s, 0), s))[: total % shards]:
        quota[s] += 1
    table, before, surplus, room = [], 0, 0, 0
    for s in range(shards):
        n = load.get(s, 0)
        table.append((s, before, n, quota[s], surplus, room, max(0, quota[s] - n)))
        before, surplus, room = before + n, surplus + max(0, n - quota[s]), room + max(0, quota[s] - n)
    table = docs.sparkSession.createDataFrame(table, "label int, first long, load long, quota long, surplus long, room long, free long")
    order = ["label", "loose", "group", "id"]
    ranked = _ranked(placed, order, F.lit(1)).join(F.broadcast(table), "label").withColumn("rank", F.col("before") - F.col("first"))
    ranked = ranked.withColumn("spare", F.when(F.expr("rank >= quota"), F.expr("surplus + rank - quota")))
    there = table.where("free > 0").select(F.col("label").alias("to"), F.col("room").alias("opens"), F.col("free").alias("seats"), F.col("load").alias("taken"))
    ranked = ranked.join(F.broadcast(there), F.expr("spare >= opens and spare < opens + seats"), "left")
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("label").alias("wanted"), F.coalesce("to", "label").alias("shard"),
        F.coalesce(F.expr("taken + spare - opens"), F.col("rank")).cast("long").alias("slot"),
    )
