"""Passages that repeat across documents, by banded MinHash of their paragraphs.

Texts are cut where a word's hash is the least of those around it, ends of sentences
and lines before other words.  A cut depends on the few words next to it alone, so that
the same passage is cut alike wherever it is pasted.  Paragraphs of equal words
are one class.  A bitmap of bounded size says which buckets may hold two classes; the
others are never dealt out with their words.  Classes that collide in a band are compared with each other by exact
Jaccard similarity inside the task that holds their bucket, which gives out the links
of a spanning forest only.  Classes of the largest buckets meet by their rarest
shingles instead, which misses none.  Linked classes form components.  Neighbouring
repeated paragraphs of a document are then joined into passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..store import drop, keep, shuffles_removed
from . import textkit as tk
from .graph import components

SHINGLE = 5
#: Words on either side that a cut must undercut; two cuts are further apart, but for the ends of texts.
UNDERCUT = 5
LEAST_WORDS = UNDERCUT + 1  # of a paragraph
#: Classes on one side of a comparison in one task.
BLOCK = 1000
#: Words between repeated paragraphs that belong to one passage.
GAP = 16
#: Most bits of the map of buckets; 32 MB.
MAP_BITS = 1 << 28
#: Codes of buckets that a task packs at once, and that a part of the map is made from, about.
CODES, PART_CODES = 1 << 21, 1 << 19
#: Linked classes up to which their components are broadcast.
BROADCAST_CLASSES = 1_000_000


def bands(recall: float = 0.995, share: float = 0.8, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): as few bands of ``rows`` hashes as find a pair at ``share`` with probability ``recall``."""
    count = 1
    while 1 - (1 - share**rows) ** count < recall:
        count += 1
    return count, rows


def paragraphs(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of every paragraph; places count from the start of the slice.

    A paragraph is what lies between two cuts, LEAST_WORDS words or more.  Whether a
    word is a cut depends on UNDERCUT words on either side.
    """
    n = len(words.hash)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    line_ends = np.concatenate([[0], np.cumsum(words.data == 10)])
    last = words.data[words.end - 1]
    stop = (last == 46) | (last == 33) | (last == 63)  # after this word
    stop[:-1] |= line_ends[words.start[1:]] > line_ends[words.end[:-1]]
    final = np.append(owner[1:] != owner[:-1], True)
    order = (words.hash >> np.uint64(1)) | (~stop).astype(np.uint64) << np.uint64(63)
    order[final] = 0
    cut = np.ones(n, bool)
    cut[:UNDERCUT] = False  # as after the end of another text
    for d in range(1, UNDERCUT + 1):
        cut[d:] &= order[d:] < order[:-d]
        cut[:-d] &= order[:-d] <= order[d:]
    ends = np.flatnonzero(cut | final) + 1
    start = np.concatenate([[0], ends[:-1]])
    long = ends - start >= LEAST_WORDS
    return owner[start[long]], start[long], ends[long]


def _cut_words(words: tk.Words, start: np.ndarray, end: np.ndarray) -> tk.Words:
    """The same words, with paragraphs in the place of texts."""
    out = object.__new__(tk.Words)
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out.hash, out.first = words.hash[at], np.concatenate([[0], np.cumsum(size)])
    return out


def _cut(batch: pa.RecordBatch):
    for a, b, data, offsets in tk.slices(batch.column(1)):
        words = tk.Words(data, offsets, lower=True)
        yield batch.column(0).slice(a, b - a), words, *paragraphs(words)


def _mark(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's whole sequence of words."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(hashes + tk.mix(place.astype(np.uint64))), dtype=np.uint64)])
    return tk.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, words, text, start, end in _cut(batch):
            part = _cut_words(words, start, end)
            short = (part.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(part.first, pa.int32()), pa.array(short))
            head = words.first[text]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text)).cast(pa.int64()), pa.array(start - head, pa.int32()), pa.array(end - head, pa.int32()), pa.array(_mark(part.hash, part.first)), lists],
                names=["id", "start", "end", "mark", "words"],
            )


def _shingles(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of paragraphs from the short hashes of their words, with repeats."""
    part = object.__new__(tk.Words)
    part.hash = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
    part.first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return tk.shingles(part, SHINGLE)


def _bands(lists: pa.ListArray, count: int, rows: int) -> np.ndarray:
    """(paragraphs, count) keys of the buckets of each paragraph."""
    sig = tk.minhash(*_shingles(lists), count * rows).astype(np.uint64)  # repeats don't change minima
    keys = [tk.mix(sum((tk.mix(sig[:, b * rows + r] + np.uint64((r + 1) << 32)) for r in range(rows)), np.full(len(sig), b, np.uint64))) for b in range(count)]
    return np.stack(keys, axis=1)


def _part(band: np.ndarray, parts: int) -> np.ndarray:
    return ((band >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _packed(codes: np.ndarray) -> bytes:
    """Sorted codes of seven bytes by place of byte, as the first ones of many codes are alike."""
    return codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(data, np.uint8).reshape(7, -1).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _coded(count: int, rows: int, parts: int):
    """Packed codes by part of the map, of rows (mark, words): four bytes of the bucket's key and three of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            part, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(part, kind="stable")
            part, code = part[order], code[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            made = [_packed(np.unique(x)) for x in np.split(code, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(made, pa.binary())], names=["part", "codes"])

        for batch in batches:
            if len(batch):
                band = _bands(batch.column(1), count, rows)
                mark = batch.column(0).to_numpy().view(np.uint64) & np.uint64(0xFFFFFF)  # tells classes of a bucket apart
                code = (band & np.uint64(0xFFFFFFFF)) << np.uint64(24) | mark[:, None]
                held.append((_part(band, parts).reshape(-1), code.reshape(-1)))
            if sum(len(x) for x, _ in held) >= CODES:
                yield batch_of()
        if held:
            yield batch_of()

    return run


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a part of the map for each four-byte key."""
    return (key % np.uint64(bits)).astype(np.int64), (tk.mix(key) % np.uint64(bits)).astype(np.int64)


def _mapped(bits: int):
    """(part, bits): the map's part, from rows (part, codes) in the order of parts, with the buckets of two classes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for part, own in groupby(rows, lambda row: row[0]):
            key = np.unique(np.concatenate([_unpacked(codes.as_py()) for _, codes in own])) >> np.uint64(24)
            several = key[1:][key[1:] == key[:-1]]
            if len(several):
                at = np.zeros(bits, bool)
                for place in _places(several, bits):
                    at[place] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(at, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    return run


def _bucket_map(units: DataFrame, count: int, rows: int, most: int) -> tuple[np.ndarray, int, int]:
    """(map, parts, bits of a part): a superset of the buckets of ``units`` (mark, words) with two classes or more."""
    codes = units.count() * count
    parts = max(1, -(-codes // PART_CODES))
    bits = -(-max(min(codes // 2, most), 1 << 16) // parts // 8) * 8
    coded = units.select("mark", "words").mapInArrow(_coded(count, rows, parts), "part int, codes binary")
    with shuffles_removed(units.sparkSession):
        found = coded.repartition("part").sortWithinPartitions("part").mapInArrow(_mapped(bits), "part int, bits binary").collect()
    out = np.zeros((parts, bits // 8), np.uint8)
    for part, own in found:
        out[part] = np.frombuffer(own, np.uint8)
    return out.reshape(-1), parts, bits


def _members(count: int, rows: int, shared, parts: int, bits: int):
    """Rows (band, mark, words) for the buckets of rows (mark, words) that the map ``shared`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not len(batch):
                continue
            band = _bands(batch.column(1), count, rows)
            first = _part(band, parts).astype(np.int64) * bits
            held = np.ones(band.shape, bool)
            for place in _places(band & np.uint64(0xFFFFFFFF), bits):
                held &= known[first + place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
            row, at = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(band[row, at].view(np.int64)), *(c.take(pa.array(row)) for c in batch.columns)], names=["band", "mark", "words"])

    return run


def _forest(marks: list[int], sides: list[int], roots: list[int], sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join all members of a group which ``share`` links, at most one fewer than members.

    Members of one root are joined already; those of one side are compared with the
    other side only, if there are two.
    """
    k = len(marks)
    root = np.unique(np.array(roots), return_inverse=True)[1]
    side = np.array(sides)
    two = bool((side != side[0]).any())
    size = np.array([len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), size)
    order = np.argsort(value, kind="stable")
    holders = owner[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(value))])
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for a in range(k - 1):
        other = root != root[a]
        other[: a + 1] = False
        if two:
            other &= side != side[a]
        if not other.any():
            continue
        own = value[first[a] : first[a + 1]]
        common = np.bincount(np.concatenate([holders[ends[v] : ends[v + 1]] for v in own]), minlength=k)
        good = other & (share[1] * common >= share[0] * (size[a] + size - common))
        while good.any():
            b = int(np.argmax(good))
            out.append((marks[a], marks[b]))
            root[root == root[b]] = root[a]
            good &= root != root[a]
    return out


def _linked(share: tuple[int, int]):
    """Links (a, b) over rows (key, i, j, side, mark, component, words) in the order of (key, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, ([], [], [], [])
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(group[0]) > 1:
                for x, y in _forest(*group, share):
                    a.append(min(x, y))
                    b.append(max(x, y))

        for batch in batches:
            values, first = tk.distinct(*_shingles(batch.column(6)))
            rows = zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True)
            for at, (key, i, j, side, mark, component) in enumerate(rows):
                if now != (key, i, j):
                    close()
                    now, group = (key, i, j), ([], [], [], [])
                group[0].append(mark)
                group[1].append(side)
                group[2].append(component)
                group[3].append(values[first[at] : first[at + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(rows: DataFrame, share: tuple[int, int], label: str) -> DataFrame:
    """Links inside each (key, i, j) of rows (key, i, j, side, mark, component, words)."""
    dealt = rows.select("key", "i", "j", "side", "mark", "component", "words").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mark")
    return keep(dealt.mapInArrow(_linked(share), "a long, b long"), label)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mark, n, shingle) for the distinct shingles of rows (mark, words)."""
    for batch in batches:
        values, first = tk.distinct(*_shingles(batch.column(1)))
        n = np.diff(first)
        marks = np.repeat(batch.column(0).to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(np.repeat(n, n), pa.int32()), pa.array(values.view(np.int64))], names=["mark", "n", "shingle"])


def _crowd_links(crowd: DataFrame, reached: DataFrame, share: tuple[int, int], block: int) -> DataFrame:
    """Links among the classes ``crowd`` (mark, words) that join all components which a link joins.

    Two sets that reach ``share`` have one of their rarest shingles in common: of n
    all but the most frequent ceil(share * n) - 1.  Those that one component alone
    has drop out; the holders of the others meet in blocks.
    """
    sets = keep(crowd.mapInArrow(_exploded, "mark long, n int, shingle long"), "shingles")
    held = keep(sets.groupBy("shingle").agg(F.count("*").alias("holders")), "holders")
    # one class's own shingles
    rare = F.row_number().over(Window.partitionBy("mark").orderBy("holders", "shingle"))
    prefix = sets.join(held, "shingle").withColumn("rank", rare).where(F.expr(f"rank <= n - ({share[0]} * n + {share[1] - 1}) div {share[1]} + 1")).where("holders > 1")
    known = reached.select(F.col("node").alias("mark"), "component")
    prefix = keep(prefix.join(known, "mark", "left").select("mark", "shingle", F.coalesce("component", "mark").alias("component")), "prefixes")
    drop(sets, held)
    several = prefix.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    several = keep(several.select("shingle", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "several")
    rows = prefix.join(several, "shingle").withColumn("side", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    # a block with itself, and with each other one
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = keep(rows.select(F.col("shingle").alias("key"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "mark", "component"), "blocks")
    links = _links(rows.join(crowd, "mark"), share, "crowd_links")
    drop(prefix, several, rows)
    return links


def _classed(units: DataFrame, members: DataFrame, share: tuple[int, int], block: int) -> DataFrame:
    """``units`` (id, start, end) with their component, from the ``members`` (band, mark, words) of buckets; both are deleted."""
    large = keep(members.groupBy("band").agg(F.count("*").alias("m")).where(F.col("m") > block).select("band"), "large")
    small = members.join(large, "band", "left_anti") if large.count() else members
    zero = F.lit(0)
    links = _links(small.select(F.col("band").alias("key"), zero.alias("i"), zero.alias("j"), zero.alias("side"), "mark", F.col("mark").alias("component"), "words"), share, "links")
    reached = first = keep(components(links), "reached")
    if large.count():
        crowd = keep(members.join(large, "band", "left_semi").groupBy("mark").agg(F.first("words").alias("words")), "crowd")
        more = _crowd_links(crowd, reached, share, block)
        reached = components(links.union(more))
        drop(crowd, more)
    drop(members, large, links)
    known = reached.select(F.col("node").alias("mark"), "component")
    known = F.broadcast(known) if known.count() <= BROADCAST_CLASSES else known
    out = keep(units.select("id", "start", "end", "mark").join(known, "mark", "left").select("id", "start", "end", F.coalesce("component", "mark").alias("component")), "classed")
    drop(units, first)
    return out


def repeated_passages(docs: DataFrame, least_words: int = 20, share: tuple[int, int] = (80, 100), recall: float = 0.995, block: int = BLOCK, map_bits: int = MAP_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, end, n_words, n_repeated, component, first_id, copies, kept) for each passage that another document has too.

    ``start`` and ``end`` are places of words in the row's text, the end exclusive.
    A passage is a run of repeated paragraphs with at most GAP other words between
    two and ``least_words`` words in them (``n_repeated``) at least; at its borders up to
    a sentence on either side may belong to the copied text too.  ``component`` is
    that of its longest paragraph, ``first_id`` the least id with a paragraph of that
    component, ``copies`` the number of documents with one; ``kept`` marks the passage
    of the least id, which stays when the others are removed.

    Classes of a bucket of at most ``block`` are all compared; those of larger ones
    meet by their rarest shingles, in blocks of that size.  ``map_bits`` bounds the map
    of buckets; a fuller map lets more classes through that meet no other, and loses none.

    Repeats inside one document alone don't count, nor do null and empty texts and
    paragraphs of fewer than LEAST_WORDS words.  Rows with a null id are left out,
    rows that share an id are one document; other columns are ignored.
    """
    ship(docs.sparkSession)
    count, rows = bands(recall, share[0] / share[1])
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    units = keep(source.mapInArrow(_units, "id long, start int, end int, mark long, words array<int>"), "paragraphs")
    known, parts, bits = _bucket_map(units, count, rows, map_bits)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    members = units.select("mark", "words").mapInArrow(_members(count, rows, shared, parts, bits), "band long, mark long, words array<int>")
    with shuffles_removed(docs.sparkSession):
        members = keep(members.groupBy("band", "mark").agg(F.first("words").alias("words")), "members")
        units = _classed(units, members, share, block)
    spread = units.select("component", "id").distinct().groupBy("component").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")
    with shuffles_removed(docs.sparkSession):
        spread = keep(spread, "spread")  # a table of its own, so that Spark can split the large partitions of the join
    twice = units.join(spread, "component")
    # a document's own paragraphs; no key holds more than one document's
    line = Window.partitionBy("id").orderBy("start", "end", "component")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    twice = twice.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("fresh", F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0)))
    runs = twice.withColumn("run", F.sum(((F.col("before") == 0) | (F.col("start") - F.col("before") > GAP)).cast("int")).over(line))
    longest = F.max_by(F.struct("component", "first_id", "copies"), F.struct(F.col("end") - F.col("start"), -F.col("start")))
    passages = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("fresh").cast("int").alias("n_repeated"), longest.alias("of"))
    passages = passages.where(F.col("n_repeated") >= least_words)
    return passages.select(
        F.col("id").alias(id_col), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "n_repeated", "of.component", "of.first_id", "of.copies",
        (F.col("of.first_id") == F.col("id")).alias("kept"),
    )
