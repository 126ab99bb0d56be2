"""Hard negatives of anchors, from exact integer scores by table lookups.

Components become integers, and eight of them at a time one byte for each of their
bits.  The index holds a row's bytes, plane by plane.  For an anchor, the sums of all
256 subsets of its components in a group of eight are laid out once; a row's score is
then one lookup for each byte, added up within a plane and shifted between planes
(the method of the Four Russians).  Every anchor is scored against every row, anchors
in blocks: a block's tables fit in a task, and a task keeps the best rows of its
share alone, so that what is shuffled grows with anchors and tasks, not with scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..store import keep

#: Components of the anchors of one block; its tables take 128 to 256 times as many bytes.
BLOCK = 1 << 18
#: Scores worked out at once.
STEP = 1 << 20

_LEAST = np.iinfo(np.int64).min


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes of (rows, 8 * groups) integers, in two's complement."""
    return np.stack([np.packbits((values >> b) & 1, axis=1, bitorder="little") for b in range(bits)], axis=1)


def unpack(planes: np.ndarray) -> np.ndarray:
    bits = planes.shape[1]
    weight = [(1 << b) if b < bits - 1 else -(1 << b) for b in range(bits)]
    return sum(w * np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(np.int64) for b, w in enumerate(weight))


def tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each group of eight components."""
    n, width = anchors.shape
    parts = anchors.reshape(n, width // 8, 8).astype(kind)
    out = np.zeros((width // 8, 256, n), kind)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, :, j].T[:, None, :]
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products, the highest plane first, doubled from plane to plane."""
    rows, bits, groups = planes.shape
    out = np.zeros((rows, sums.shape[2]), sums.dtype)
    found = np.empty_like(out)
    for b in reversed(range(bits)):
        out <<= 1
        for g in range(groups):
            np.take(sums[g], planes[:, b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                out -= found
            else:
                out += found
    return out


class Best:
    """The first ``most`` rows of each of several lists, by higher score, then smaller id."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(lists, _LEAST)  # score and id of the last row of a full list
        self.last = np.zeros(lists, np.int64)

    def add(self, of: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(of):
            return
        of, score, id = (np.concatenate(x) for x in ((self.of, of), (self.score, score.astype(np.int64)), (self.id, id)))
        order = np.lexsort((id, -score, of))
        of, score, id = of[order], score[order], id[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        kept = rank < self.most
        self.of, self.score, self.id, rank = of[kept], score[kept], id[kept], rank[kept]
        full = rank == self.most - 1
        self.least[self.of[full]], self.last[self.of[full]] = self.score[full], self.id[full]

    def better(self, got: np.ndarray, ids: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which of (rows, lists) scores could enter their list."""
        least = self.least[lists]
        return (got > least) | ((got == least) & (ids[:, None] < self.last[lists]))


def _steps(n: int, anchors: int) -> Iterator[slice]:
    """Slices of a batch; a short one first, so that lists are full early."""
    at, size = 0, 256
    while at < n:
        yield slice(at, min(at + size, n))
        at, size = at + size, max(64, STEP // max(anchors, 1))


def _read(batch: pa.RecordBatch, bits: int, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels as places in ``known`` (-1: none of them), and planes of an index batch."""
    column = batch.column("planes")
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    planes = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]].reshape(len(column), bits, -1)
    label = pc.fill_null(pc.index_in(batch.column("label"), value_set=known), -1).to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(), label, planes


_FOUND = "anchor int, place int, score long, id long"


def _emit(best: Best, places: int) -> pa.RecordBatch:
    of = best.of
    return pa.RecordBatch.from_arrays([pa.array(of // places, pa.int32()), pa.array(of % places, pa.int32()), pa.array(best.score), pa.array(best.id)], names=["anchor", "place", "score", "id"])


def _same_label(block, most: int):
    """Task: the best other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, planes, known, kind = block.value
        values = unpack(planes)
        own = [np.flatnonzero(label == k) for k in range(len(known))]
        sums = [tables(values[a], kind) for a in own]
        best = Best(len(ids), most)
        for batch in batches:
            if not len(batch):
                continue
            row_id, row_label, row_planes = _read(batch, planes.shape[1], known)
            for k in np.unique(row_label[row_label >= 0]):
                mine = np.flatnonzero(row_label == k)
                for s in _steps(len(mine), len(own[k])):
                    at = mine[s]
                    got = scores(row_planes[at], sums[k])
                    r, a = np.nonzero(best.better(got, row_id[at], own[k]) & (row_id[at][:, None] != ids[own[k]]))
                    best.add(own[k][a], got[r, a], row_id[at][r])
        yield _emit(best, 1)

    return run


def _other_label(block, lists, most: int):
    """Task: the best rows of other labels whose scores lie in the window of an (anchor, positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, planes, known, kind = block.value
        low, high = lists.value  # (anchors, places)
        places = low.shape[1]
        sums = tables(unpack(planes), kind)
        best = Best(low.size, most)
        every = np.arange(len(ids)) * places
        for batch in batches:
            if not len(batch):
                continue
            row_id, row_label, row_planes = _read(batch, planes.shape[1], known)
            for s in _steps(len(batch), len(ids)):
                got = scores(row_planes[s], sums)
                other = row_label[s][:, None] != label
                for p in range(places):
                    r, a = np.nonzero(other & (got >= low[:, p]) & (got <= high[:, p]) & best.better(got, row_id[s], every + p))
                    best.add(every[a] + p, got[r, a], row_id[s][r])
        yield _emit(best, places)

    return run


def _index(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchor: Column, scale: int) -> tuple[DataFrame, int, int, type] | None:
    """The packed rows that take part, written, with the planes and groups of eight of each, and the integers scores need."""
    x = F.col("vector")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    clean = clean.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite).withColumn("vector", F.transform(x, lambda v: F.floor(scale * v)))
    seen = clean.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", lambda v: F.greatest(v, -v - 1)))).alias("most")).first()
    if seen["width"] is None:
        return None
    most = (seen["most"] or 0) + 1
    if seen["width"] * most * most >= 1 << 56:
        raise ValueError("components are too large for scores of 64 bits")
    bits, groups = (most - 1).bit_length() + 1, max(1, -(-seen["width"] // 8))
    kind = np.int32 if seen["width"] * most * most < 1 << 30 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column("vector")
            flat, size = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
            values = np.zeros((len(batch), groups * 8), np.int64)
            values[np.arange(groups * 8) < size[:, None]] = flat
            planes = pack(values, bits).reshape(len(batch), -1)
            made = pa.array([p.tobytes() for p in planes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("is_anchor"), made], names=["id", "label", "is_anchor", "planes"])

    packed = clean.select("id", "label", "is_anchor", "vector").mapInArrow(run, "id long, label string, is_anchor boolean, planes binary")
    return keep(packed.repartition("id").sortWithinPartitions("id"), "bit-planes"), bits, groups, kind


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchor`` holds.

    Components x become floor(scale * x) and scores are their integer inner products;
    higher ones come first, ties by smaller id.  An anchor's positives are its first
    ``positives`` other rows of the same label.  For each, the first ``negatives`` rows
    of another label with low * positive <= 100 * negative <= high * positive are
    returned, ranked from 1.  Every anchor meets every row.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part.  A shorter vector is filled up with zeros; an empty one
    scores 0.  Rows with one id are each a row of their own as positives and
    negatives, never those of their own id, and one of them is the anchor (the least by
    label, then bytes).  An anchor without positives, or without a negative in the
    window, has no rows.  Other columns are ignored, whatever their names.  Scores
    that could pass 56 bits raise ValueError.
    """
    spark = ship(rows.sparkSession)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    made = _index(rows, id_col, label_col, vector_col, anchor, scale)
    if made is None:
        return empty
    index, bits, groups, kind = made
    anchors = index.filter("is_anchor").groupBy("id").agg(F.min(F.struct("label", "planes")).alias("x")).select("id", "x.label", "x.planes")
    blocks = -(-anchors.count() * groups * 8 // BLOCK)
    out = []
    for b in range(blocks):
        own = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        batch = own.to_batches()[0]
        known = pc.unique(batch.column("label"))
        ids, label, planes = _read(batch, bits, known)
        block = spark.sparkContext.broadcast((ids, label, planes, known, kind))
        best = _first(index.mapInArrow(_same_label(block, positives), _FOUND), positives)
        found = best.select("anchor", (F.col("rank") - 1).alias("place"), "score", "id").toPandas()
        lists = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), -1, np.int64)
        at, score = (found["anchor"].to_numpy(), found["place"].to_numpy()), found["score"].to_numpy()
        lists[0][at], lists[1][at] = -((-low * score) // 100), (high * score) // 100
        window = spark.sparkContext.broadcast(lists)
        chosen = spark.createDataFrame(found.assign(anchor_id=ids[found["anchor"]]), "anchor int, place int, positive_score long, positive_id long, anchor_id long")
        mined = _first(index.mapInArrow(_other_label(block, window, negatives), _FOUND), negatives)
        part = mined.join(chosen, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(keep(part, "negatives") if blocks > 1 else part)
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) & ~1 :]
    return out[0] if out else empty


#: DuckDB SQL of the query; inner products of these integers are exact as doubles.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
