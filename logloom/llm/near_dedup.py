"""MinHash near-duplicates by an LSH forest.

Every text becomes its set of word shingles, and every set a MinHash signature
that is cut into several labels.  Each label gives one order of all sets: a
sorted run over range partitions, with no key that could hold a hot group.  In
each order a set's candidates are the neighbours with the longest common prefix,
so that the depth needed adapts to how dense its region is: a lonely pair meets
at depth two, members of a crowd only at the depth of their nearest neighbours.
Candidates that a sketch of all hashes cannot rule out are confirmed on the full
sets, and confirmed links are closed to components.  Members of regions with more
rows than the neighbours looked at then meet by their rarest shingles, on full sets,
wherever a link could still join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as tk
from .graph import components
from .store import keep

TREES, DEPTH = 16, 8  # 128 hashes
NEAREST = 8  # neighbours on either side in each order
LEAST_DEPTH = 2  # hashes that candidates share at least
#: Sets of a shingle that one task compares at once, with another such block or among themselves, and shingles in them.
BLOCK, BLOCK_SHINGLES = 1_000, 4_000_000
#: Rows of crowded regions that frequent shingles are counted in, and frequent shingles told apart: any order gives the same links.
COUNTED_ROWS, FREQUENT = 20_000, 100_000
#: Standard deviations by which a sketch may fall short of the threshold.
SLACK = 4.5
#: The same before full sets are compared: a set at the threshold falls as short in one of 10 ** 11 cases.
WIDE_SLACK = 8


def _sketcher(size: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in tk.slices(batch.column(1)):
                sets, first = tk.distinct(*tk.shingles(tk.Words(data, offsets, lower), size))
                n = np.diff(first)
                sig = tk.minhash(sets, first, TREES * DEPTH)
                total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([sets, tk.mix(sets)]), axis=1, dtype=np.uint64)], axis=1)
                mark = tk.mix(total[:, first[1:]] - total[:, first[:-1]]).view(np.int64)
                # minima of long texts are all small: their own high bits would be equal
                high = np.ascontiguousarray((sig * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")).reshape(b - a, -1).view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(mark[0]), pa.array(mark[1]), _rows(high), _rows(_low(sig))],
                    names=["id", "n", "mark1", "mark2", "labels", "sketch"],
                )
        tk.give_back()

    return run


def _low(sig: np.ndarray) -> np.ndarray:
    """Four bits of each hash, two in a byte."""
    low = (sig & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def _rows(table: np.ndarray) -> pa.Array:
    """A binary value for each row of a uint8 matrix."""
    table = np.ascontiguousarray(table)
    n, width = table.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(table)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(column), width)


_BITS = np.array([[(x >> 4 == y >> 4) + (x & 15 == y & 15) for y in range(256)] for x in range(256)], np.uint8)


def _neighbours(share: float, borders: bool):
    """Over rows (tree, label, id, n, sketch) in order: pairs, and a partition's first and last rows.

    A pair of an id with itself says that its region has more rows than were looked at.
    """
    floor = share - SLACK * (share * (1 - share) / (TREES * DEPTH)) ** 0.5
    least = floor + (1 - floor) / 16  # unequal hashes agree in four bits by chance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(0)
        held: pa.Table | None = None
        head = 0
        schema = None

        def out(pairs, rows=None):
            k, m = len(pairs[0]), 0 if rows is None else len(rows)
            cols = [pa.concat_arrays([pa.array(p, pa.int64()), pa.nulls(m, pa.int64())]) for p in pairs]
            for i, kind in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())):
                cols.append(pa.concat_arrays([pa.nulls(k, kind), pa.nulls(0, kind) if rows is None else rows.column(i).cast(kind)]))
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "tree", "label", "id", "n", "sketch"])

        for batch in batches:
            if not len(batch):
                continue
            fresh = pa.Table.from_batches([batch])
            old = 0 if held is None else len(held)
            table = fresh if held is None else pa.concat_tables([held, fresh])
            rows = table.combine_chunks().to_batches()[0]
            if borders and head < NEAREST:
                take = min(NEAREST - head, len(batch))
                yield out(([], []), batch.slice(0, take))
                head += take
            tree = rows.column(0).to_numpy()
            label, sketch = _matrix(rows.column(1), 2 * DEPTH).view(">u2"), _matrix(rows.column(4), TREES * DEPTH // 2)
            ids, n = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            for j in range(1, NEAREST + 1):
                lo = max(0, old - j)
                if len(rows) - j <= lo:
                    continue
                x, y = np.arange(lo, len(rows) - j), np.arange(lo + j, len(rows))
                near = (tree[x] == tree[y]) & (label[x, :LEAST_DEPTH] == label[y, :LEAST_DEPTH]).all(1)
                if j == NEAREST and near.any():  # a region that goes on beyond the neighbours looked at
                    crowd = np.unique(np.concatenate([ids[x[near]], ids[y[near]]]))
                    yield out((crowd, crowd))
                near &= (np.minimum(n[x], n[y]) >= share * np.maximum(n[x], n[y]) - 1e-9) & (ids[x] != ids[y])
                x, y = x[near], y[near]
                same = _BITS[sketch[x], sketch[y]].sum(1, dtype=np.int64)
                x, y = x[same >= least * TREES * DEPTH], y[same >= least * TREES * DEPTH]
                if len(x):
                    yield out((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
            held = table.slice(max(0, len(table) - NEAREST))
        if borders and held is not None:
            yield out(([], []), held.combine_chunks().to_batches()[0])

    return run


def _confirm(size: int, lower: bool, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(len(batch), bool)
            at = 0
            while at < len(batch):  # pairs of about one slice at a time
                to = at
                room = 2 * tk.SLICE_BYTES
                while to < len(batch) and (to == at or room > 0):
                    room -= left[to].as_buffer().size + right[to].as_buffer().size
                    to += 1
                both = pa.concat_arrays([left.slice(at, to - at), right.slice(at, to - at)])
                sets: list[np.ndarray] = []
                for _, _, data, offsets in tk.slices(both):
                    s, first = tk.distinct(*tk.shingles(tk.Words(data, offsets, lower), size))
                    sets += [s[p:q] for p, q in zip(first[:-1], first[1:], strict=True)]
                k = to - at
                for i in range(k):
                    common = tk.intersection(sets[i], sets[k + i])
                    good[at + i] = share[1] * common >= share[0] * (len(sets[i]) + len(sets[k + i]) - common) and common > 0
                at = to
            keepers = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keepers), batch.column(1).filter(keepers)], names=["a", "b"])
        tk.give_back()

    return run


def _candidates(sets: DataFrame, share: float) -> DataFrame:
    """Distinct pairs (a, b) of neighbours in all orders, and (a, a) for members of crowded regions."""
    tree = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("labels", 2 * DEPTH * t + 1, 2 * DEPTH).alias("label")) for t in range(TREES)]))
    rows = sets.select(tree.alias("t"), "id", "n", "sketch").select("t.tree", "t.label", "id", "n", "sketch")
    order = ["tree", "label", "id"]
    schema = "a long, b long, tree int, label binary, id long, n long, sketch binary"
    found = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(share, True), schema), "neighbours")
    # first and last rows of the partitions: as many as there are partitions, times a constant
    border = found.where("tree is not null").select("tree", "label", "id", "n", "sketch").distinct().repartition(1).sortWithinPartitions(*order)
    return keep(found.where("a is not null").select("a", "b").union(border.mapInArrow(_neighbours(share, False), schema).select("a", "b")).distinct(), "pairs")


def _links(pairs: DataFrame, source: DataFrame, shingle: int, lower: bool, share: tuple[int, int]) -> DataFrame:
    """The pairs that the full sets of both texts confirm."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    # merge joins at every size, so that a small run shows what a large one moves
    texts = keep(source.join(ends.hint("merge"), "id", "left_semi"), "texts")
    held = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    held = held.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return keep(held.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, lower, share), "a long, b long").distinct(), "links")


def _full_sets(size: int, lower: bool):
    """Rows (id, shingles, sketch) with the distinct shingles of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(1)):
                sets, first = tk.distinct(*tk.shingles(tk.Words(data, offsets, lower), size))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sets.view(np.int64)))
                sketch = _rows(_low(tk.minhash(sets, first, TREES * DEPTH)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, sketch], names=["id", "shingles", "sketch"])
        tk.give_back()

    return run


def _prefixes(frequent: np.ndarray, share: tuple[int, int]):
    """Rows (id, mark, component, n, shingle, sketch, rank) for the first of each set's shingles in an order common to all sets.

    Two sets that reach ``share`` have one of the first n - ceil(share * n) + 1 in common,
    whatever the order.  ``frequent`` shingles come last, the most frequent of all at the end.
    """
    at = np.argsort(frequent)
    known = frequent[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            place = np.zeros(len(values), np.int64)
            if len(known):
                near = np.minimum(np.searchsorted(known, values), len(known) - 1)
                place = np.where(known[near] == values, len(known) - at[near], 0)
            order = np.lexsort((values, place, np.repeat(np.arange(len(n)), n)))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            length = n + (-share[0] * n) // share[1] + 1
            first = order[rank < np.repeat(length, n)]
            rows = [batch.column(c).take(pa.array(np.repeat(np.arange(len(n)), length))) for c in range(3)]
            sketch = batch.column(4).take(pa.array(np.repeat(np.arange(len(n)), length)))
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.repeat(n, length)), pa.array(values[first]), sketch, pa.array(rank[rank < np.repeat(length, n)])], names=["id", "mark", "component", "n", "shingle", "sketch", "rank"])

    return run


def _joined(ids: list[int], sides: list[int], roots: list[int], sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join all members of a group which ``share`` links, at most one fewer than members.

    Members of one root are joined already; those of one side are compared with the
    other side only, if there are two.
    """
    root = np.unique(np.array(roots), return_inverse=True)[1]
    if (root == 0).all():
        return []
    side = np.array(sides)
    left = np.flatnonzero(side == side[0])
    right = np.flatnonzero(side != side[0]) if (side != side[0]).any() else left
    size = np.array([len(s) for s in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[value] > 1
    column = (np.cumsum(times > 1) - 1)[value[shared]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], np.repeat(np.arange(len(sets)), size)[shared][order]
    common = np.zeros((len(left), len(right)), np.int64)
    width = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    good = share[1] * common >= share[0] * (size[left][:, None] + size[right] - common)
    out = []
    for x, linked in zip(left, good, strict=True):
        linked &= root[right] != root[x]
        while linked.any():
            y = right[np.argmax(linked)]
            out.append((int(ids[x]), int(ids[y])))
            root[root == root[y]] = root[x]
            linked &= root[right] != root[x]
    return out


def _possible(share: tuple[int, int]):
    """Rows (key, i, j, side, id, mark) with a possible partner, of rows (.., component, n, sketch, rank) in the order of (key, i, j).

    A partner is of another component and of the other side, if there are two; sizes must
    allow the link, so must what follows the shingle, as if it were the first in common,
    and the sketches, by WIDE_SLACK.
    """
    ratio = share[0] / share[1]
    hashes = TREES * DEPTH
    least = hashes * (ratio - WIDE_SLACK * (ratio * (1 - ratio) / hashes) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            key, i, j, side, component, n, rank = (rows.column(c).to_numpy() for c in (0, 1, 2, 3, 6, 7, 9))
            left = n - rank
            sketch = _matrix(rows.column(8), hashes // 2)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            good = np.zeros(len(rows), bool)
            for a, b in zip([0, *edges], [*edges, len(rows)], strict=True):
                two = (side[a:b] != side[a]).any()
                for x in range(a, b):
                    if good[x]:
                        continue
                    fits = (component[a:b] != component[x]) & (share[1] * np.minimum(n[a:b], n[x]) >= share[0] * np.maximum(n[a:b], n[x]))
                    fits &= (share[0] + share[1]) * np.minimum(left[a:b], left[x]) >= share[0] * (n[a:b] + n[x])
                    if two:
                        fits &= side[a:b] != side[x]
                    y = a + np.flatnonzero(fits)
                    y = y[_BITS[sketch[x], sketch[y]].sum(1, dtype=np.int64) >= least] if len(y) else y
                    good[y] = True
                    good[x] = len(y) > 0
            return pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(good)) for c in range(6)], names=["key", "i", "j", "side", "id", "mark"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = [batch.column(c)[len(batch) - 1] for c in range(3)]
            if [batch.column(c)[0] for c in range(3)] == last:
                continue  # one group alone, which may go on
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == last[c].as_py() for c in range(3)])
            to = int(np.argmax(same))
            yield done(rows.slice(0, to))
            held = [rows.slice(to)]
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _meeting(share: tuple[int, int]):
    """Links (a, b) over rows (key, i, j, side, id, component, shingles) in the order of (key, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, ([], [], [], [])
        links: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])
            links.clear()
            return made

        for batch in batches:
            lists = batch.column(6)
            values, first = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for at, (key, i, j, side, id, component) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(6)], strict=True)):
                if now != (key, i, j):
                    links += _joined(*group, share) if len(group[0]) > 1 else []
                    now, group = (key, i, j), ([], [], [], [])
                for of, value in zip(group, (id, side, component, values[first[at] : first[at + 1]]), strict=True):
                    of.append(value)
            yield out()
        links += _joined(*group, share) if len(group[0]) > 1 else []
        yield out()

    return run


def _crowd_links(crowd: DataFrame, member: DataFrame, source: DataFrame, shingle: int, lower: bool, share: tuple[int, int], block: int) -> DataFrame:
    """Links among the ids ``crowd`` that join all components which a link joins, by full sets.

    Sets meet by their rarest shingles, in blocks; a shingle that one component alone has
    drops out, and of shingles of the very same sets all but the first.
    """
    texts = source.join(crowd.hint("merge"), "id", "left_semi").distinct().mapInArrow(_full_sets(shingle, lower), "id long, shingles array<long>, sketch binary")
    known = texts.where(F.size("shingles") > 0).join(member.select(F.col("node").alias("id"), "component"), "id", "left")
    sets = keep(known.select("id", F.xxhash64("shingles").alias("mark"), F.coalesce("component", "id").alias("component"), "shingles", "sketch"), "crowd_sets")
    part = max(1, sets.count() // COUNTED_ROWS)
    counted = sets.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 1")
    frequent = np.array([r.shingle for r in counted.orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").collect()], np.int64)
    prefix = keep(sets.mapInArrow(_prefixes(frequent, share), "id long, mark long, component long, n long, shingle long, sketch binary, rank long"), "prefixes")
    several = prefix.groupBy("shingle").agg(
        F.count("*").alias("m"), F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum("rank").alias("rank"),
        F.bit_xor(F.xxhash64("id", "mark")).alias("one"), F.bit_xor(F.xxhash64("mark", "id")).alias("two"),
    ).where("low < high")
    several = several.groupBy("m", "one", "two").agg(F.min_by("shingle", F.struct("rank", "shingle")).alias("shingle"), F.first("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    several = keep(several.select("shingle", blocks.alias("blocks")), "several")
    rows = prefix.join(several, "shingle").withColumn("side", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int"))
    # a block with itself, and with each other one
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(F.col("shingle").alias("key"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "mark", "component", "n", "sketch", "rank")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rows = keep(rows.mapInArrow(_possible(share), "key long, i int, j int, side int, id long, mark long"), "blocks")
    met = rows.join(sets.drop("sketch"), ["id", "mark"]).select("key", "i", "j", "side", "id", "component", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return keep(met.mapInArrow(_meeting(share), "a long, b long").distinct(), "crowd_links")


def near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), lower: bool = True, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked when ``share[1] * |A & B| >= share[0] * |A | B|`` over their
    distinct ``shingle``-word shingles; fewer words are one shingle, and no words
    (or a null text) an empty set that is linked with nothing.  ``component_id``
    is the least id reachable, ``kept`` says it is the row's own.

    Equal sets are one class from the start, whatever their number, and take part
    with the least of their ids.  Members of regions with more rows than the neighbours
    looked at meet once more by their rarest shingles, at most ``block`` with ``block``
    in one place, so that all their links between different components are found.

    Rows that share an id are linked by it.  A null id gives a null
    ``component_id`` and is kept.  Other columns are ignored; an empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = keep(source.mapInArrow(_sketcher(shingle, lower), "id long, n long, mark1 long, mark2 long, labels binary, sketch binary"), "sets")
    marks = ["n", "mark1", "mark2"]
    classes = sets.where("n > 0 and id is not null").groupBy(*marks).agg(F.min("id").alias("first_id"))
    chosen = sets.join(classes.select(F.col("first_id").alias("id"), *marks), ["id", *marks], "left_semi")
    ratio = share[0] / share[1]
    pairs = _candidates(chosen, ratio)
    links = _links(pairs.where("a < b"), source, shingle, lower, share)
    member = components(links)
    crowd = keep(pairs.where("a = b").select(F.col("a").alias("id")), "crowd")
    if crowd.count():
        member = components(links.union(_crowd_links(crowd, keep(member, "member"), source, shingle, lower, share, block)))
    known = classes.join(member.select(F.col("node").alias("first_id"), "component"), "first_id", "left").select(*marks, F.coalesce("component", "first_id").alias("reached"))
    return sets.select("id", *marks).join(known, marks, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("reached", "id")).alias("component_id"),
        F.coalesce(F.coalesce("reached", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the least id.

    Rows with a null id stay; of rows that share an id the one of the least text
    stays (no text first), and of those of equal text too the one whose other
    columns hash lowest (maps aside, which can't be hashed).
    """
    kept = near_duplicates(docs, shingle, share, id_col=id_col, text_col=text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    rank = "_" * (1 + max(map(len, docs.columns)))  # no column's name
    rest = [F.xxhash64(f"`{c}`") for c in docs.columns if c not in (id_col, text_col) and "map<" not in docs.schema[c].dataType.simpleString()]
    of = Window.partitionBy(id_col).orderBy(F.asc_nulls_first(text_col), *rest)
    stay = docs.join(kept, id_col, "left_semi").select("*", F.row_number().over(of).alias(rank)).where(F.col(rank) == 1).select(*docs.columns)
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
