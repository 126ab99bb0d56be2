"""Phrase collocations of each language, mined with stripes.

A stripe belongs to a prefix: an associative counter of the words that come next,
with one more entry for all other ends.  Tasks count the stripes of their texts,
equal stripes are merged entry by entry, and everything is read from them: a phrase's
count is an entry, a prefix's count is the total of its stripe, its best extension to
the right the largest entry, and the same entries keyed by their last words are the
extensions to the left.

Prefixes of no, one, two, and three or four words are counted in four passes.  A
phrase can be frequent only if its words, then its pairs, then its triples are; a
bitmap of fixed size says which may be (a superset, so that no phrase is lost).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..store import keep
from . import textkit as tk

#: Bytes of text whose stripes are counted at once.
SLICE = 6_000_000
#: Bits of the maps of frequent words, pairs and triples.
BITS = 1 << 25
#: A stripe of a prefix with more than one of so many words is split into PARTS by next word; the empty prefix always.
HOT = 1000
PARTS = 32
#: Stripes that a task holds, and bytes of their entries, before it hands them on.
HELD, HELD_BYTES = 300_000, 48_000_000
#: Stripes travel in so many blocks a language, by their prefix and part.
BLOCKS = 2048
#: Words of the longest phrase.
LONGEST = 5

_APART = re.compile(rb"[.,;:!?\x0a-\x0d]+")
_CUT = re.compile(rb"[ \t.,;:!?\x0a-\x0d]")
#: Ends a piece, and stands for all next words that are not counted; no word contains it.
END = b"."

_BLOCK = "lang string, words int, block int, prefixes array<binary>, parts array<int>, nexts array<binary>, counts array<binary>"


def tokens(text: bytes) -> list[bytes]:
    """Words in order, END between pieces; A-Z lower-cased."""
    return _APART.sub(b" . ", text.lower()).split()


def _pieces(texts: pa.Array) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, how many of them were there before): runs of whole texts, or parts of a long one with the words before them."""
    for a, b, data, offsets in tk.slices(texts, SLICE):
        if b - a > 1 or len(data) <= SLICE:
            whole = data.tobytes()
            yield tokens(END.join(whole[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)) + END), 0
            continue
        at, before = 0, []
        while at < len(data):
            end = at + SLICE
            part = data[at:end].tobytes()
            while end < len(data) and not (found := _CUT.search(more := data[end : end + SLICE].tobytes())):
                part, end = part + more, end + len(more)
            if end < len(data):
                part, end = part + more[: found.end()], end + found.end()
            own = tokens(part + END * (end >= len(data)))
            yield before + own, len(before)
            at, before = end, (before + own)[1 - LONGEST :]


def _bit(lang: bytes, first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Places in the map of words, pairs or triples, given the crc32 of each word."""
    x = first.astype(np.uint64) | np.uint64(crc32(lang) << 32)
    for word in more:
        x = tk.mix(x) + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (tk.mix(x) % np.uint64(BITS)).astype(np.int64)


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class _Held:
    """A task's stripes: entries of one prefix and part stand together, whatever slice they are from."""

    def __init__(self):
        self.rows: dict[tuple, tuple[list[bytes], list[bytes]]] = {}
        self.bytes = 0

    def full(self) -> bool:
        return len(self.rows) > HELD or self.bytes > HELD_BYTES

    def batch(self) -> pa.RecordBatch:
        rows = sorted(((lang, size, (crc32(prefix) + part) % BLOCKS, prefix, part, b" ".join(x), b" ".join(n)) for (lang, size, prefix, part), (x, n) in self.rows.items()), key=itemgetter(0, 1, 2))
        self.rows, self.bytes = {}, 0
        starts = [i for i in range(len(rows)) if not i or rows[i][:3] != rows[i - 1][:3]]
        offsets = pa.array([*starts, len(rows)], pa.int32())
        own = [pa.array([rows[i][j] for i in starts], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        lists = [pa.ListArray.from_arrays(offsets, pa.array([r[j] for r in rows], t)) for j, t in ((3, pa.binary()), (4, pa.int32()), (5, pa.binary()), (6, pa.binary()))]
        return pa.RecordBatch.from_arrays([*own, *lists], names=["lang", "words", "block", "prefixes", "parts", "nexts", "counts"])


class _Counted:
    """Stripes of one run of tokens."""

    def __init__(self, lang: str, words: list[bytes], held: _Held):
        self.lang, self.words, self.held = lang, words, held
        self.part_of = np.fromiter((1 + crc32(w) % PARTS for w in words), np.int64, len(words))  # part 0 is a whole stripe
        self.small = [b"%d" % i for i in range(1000)]

    def add(self, size: int, prefixes: list[bytes], prefix: np.ndarray, following: np.ndarray, split: np.ndarray) -> None:
        """Count the next words of each prefix; ``split``: which prefixes have their stripe in parts."""
        if not len(prefix):
            return
        v = len(self.words)
        keys, n = np.unique(prefix * v + following, return_counts=True)
        prefix, following = keys // v, keys % v
        part = np.where(split[prefix], self.part_of[following], 0)
        order = np.lexsort((part, prefix))
        prefix, part = prefix[order], part[order]
        cuts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        names = [self.words[i] for i in following[order].tolist()]
        counts = [self.small[i] if i < 1000 else b"%d" % i for i in n[order].tolist()]
        rows = self.held.rows
        for a, b, p, k in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)], prefix[cuts].tolist(), part[cuts].tolist(), strict=True):
            key = self.lang, size, prefixes[p], k
            row = rows.get(key)
            if row is None:
                row = rows[key] = [], []
            row[0].append(made := b" ".join(names[a:b]))
            row[1].append(b" ".join(counts[a:b]))
            self.held.bytes += len(made)


def _stripes(level: int, frequent, hot: frozenset[tuple[str, bytes]]):
    """Task: stripes of the empty prefix (level 0), of words (1), pairs (2), triples and what is longer (3)."""

    def one(name: str, toks: list[bytes], before: int, held: _Held) -> None:
        place = defaultdict(count().__next__)
        place[END]
        ids = np.fromiter(map(place.__getitem__, toks), np.int64, len(toks))
        words, lang = list(place), name.encode()
        made = _Counted(name, words, held)
        if level == 0:
            own = ids[before:]
            own = own[own > 0]
            made.add(0, [b""], np.zeros(len(own), np.int64), own, np.ones(1, bool))
        else:
            crc = np.fromiter(map(crc32, words), np.int64, len(words))
        if level == 1:
            good = _held(frequent.value, _bit(lang, crc))
            good[0] = False
            at = np.flatnonzero(good[ids[:-1]])
            at = at[at + 1 >= before]
            following = ids[at + 1]
            made.add(1, words, ids[at], np.where(good[following], following, 0), np.fromiter(((name, w) in hot for w in words), bool, len(words)))
        if level > 1:
            n = len(ids) - level + 1
            inner = np.flatnonzero(np.logical_and.reduce([ids[j : j + n] > 0 for j in range(level)])) if n > 0 else np.zeros(0, np.int64)
            good = np.zeros(len(ids), bool)  # the pair or triple from here on may be frequent
            good[inner[_held(frequent.value, _bit(lang, *[crc[ids[inner + j]] for j in range(level)]))]] = True
            at = np.flatnonzero(good)
            prefixes, prefix = words, ids[at]
            split = None
            for size in range(2, LONGEST):
                # prefixes of so many words, numbered anew
                longer, prefix = np.unique(prefix * len(words) + ids[at + size - 1], return_inverse=True)
                prefixes = [prefixes[p // len(words)] + b" " + words[p % len(words)] for p in longer.tolist()]
                split = np.fromiter(((name, p) in hot for p in prefixes), bool, len(prefixes)) if size == 2 else split[longer // len(words)]
                if size < level:
                    continue
                inside = at + size < len(ids)
                at, prefix = at[inside], prefix[inside]
                following = np.where(good[at + size - level + 1], ids[at + size], 0)
                counted = at + size >= before
                made.add(size, prefixes, prefix[counted], following[counted], split)
                if level == 2:
                    break
                at, prefix = at[following > 0], prefix[following > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            lang, text = batch.column(0), batch.column(1)
            for value in lang.unique():
                own = text.filter(pc.equal(lang, value))
                for toks, before in _pieces(own):
                    one(value.as_py(), toks, before, held)
                    if held.full():
                        yield held.batch()
        if held.rows:
            yield held.batch()
        tk.give_back()

    return run


def _merged(raw: DataFrame, least: int) -> DataFrame:
    """Stripes merged entry by entry, in the partition of their block: total, largest entry, and entries of ``least`` or more."""
    key = ["lang", "block", "words", "prefix", "part"]
    cut = lambda c: F.split(c.cast("string"), " ")
    stripe = lambda s: F.zip_with(cut(s["nexts"]), cut(s["counts"]), lambda w, n: F.struct(s["prefixes"].alias("prefix"), s["parts"].alias("part"), w.alias("word"), n.alias("n")))
    entry = F.explode(F.flatten(F.transform(F.arrays_zip("prefixes", "parts", "nexts", "counts"), stripe))).alias("entry")
    entries = raw.repartition("lang", "block").select("lang", "block", "words", entry).select("lang", "block", "words", "entry.prefix", "entry.part", "entry.word", F.col("entry.n").cast("long").alias("n"))
    merged = entries.groupBy(*key, "word").agg(F.sum("n").alias("n"))
    inner = F.col("word") != END.decode()
    stripes = merged.groupBy(*key).agg(
        F.sum("n").alias("total"), F.max(F.when(inner, F.col("n"))).alias("best"), F.collect_list(F.when(inner & (F.col("n") >= least), F.struct("word", "n"))).alias("next")
    )
    return stripes.filter((F.col("total") >= least) | (F.col("part") > 0) | (F.col("words") == 0)).withColumn("prefix", F.col("prefix").cast("string")).drop("block")


def _bitmap(phrases: DataFrame, size: int) -> np.ndarray:
    """The places of phrases of ``size`` words (lang, phrase) in a map of BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 64, np.uint64)
        for batch in batches:
            for lang in batch.column(0).unique():
                own = batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist()
                crc = np.array([[crc32(w) for w in p.encode().split(b" ")] for p in own], np.int64)
                at = _bit(lang.as_py().encode(), *crc.T)
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _entries(stripes: DataFrame) -> DataFrame:
    return stripes.select("lang", "words", "prefix", F.explode("next").alias("entry")).select("lang", "words", "prefix", "entry.word", F.col("entry.n").alias("n"))


def _counted(docs: DataFrame, least: int) -> DataFrame:
    """All stripes that hold a phrase of ``least`` or a part of one, written."""
    spark: SparkSession = ship(docs.sparkSession)
    kept, frequent, hot = [], None, frozenset()
    for level in range(4):
        stripes = keep(_merged(docs.mapInArrow(_stripes(level, frequent, hot), _BLOCK), least), f"stripes-{level}")
        kept.append(stripes)
        if level == 3:
            break
        found = _entries(stripes).select("lang", F.concat_ws(" ", F.nullif("prefix", F.lit("")), "word").alias("phrase"), "n")
        if level == 0:
            total = stripes.agg(F.sum("total")).first()[0] or 0
        if level < 2:  # no more than HOT words or pairs; a longer prefix is split as its pair is
            hot = frozenset((r["lang"], r["phrase"].encode()) for r in found.filter(F.col("n") * HOT > total).select("lang", "phrase").collect())
        frequent = spark.sparkContext.broadcast(_bitmap(found, level + 1))
    return reduce(DataFrame.unionByName, kept)


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"1000BD * ({wide(a)} * {wide(n)}) DIV ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = 100, subsumed: int = 100, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases of 2 to 5 words.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these
    into words ``[^\\x20\\x09]+``.  ``a`` counts a phrase within pieces, ``n`` all
    words of the language; candidates have a >= ``least``.  Of the cuts into two parts
    with counts l and r, the one of least floor(1000 * a * n / (l * r)) counts, the
    first among equals.  A candidate is dropped if a longer candidate contains it and
    has ``subsumed`` per cent of its count or more (one more word is enough to look
    at: counts do not grow with length).  Ranks go by score, then ``a``, both
    descending, then the phrase by bytes.

    A null language is ``und``, a null text empty; every row counts, repeated ones
    too.  Texts of any length are read whole, in parts.  Without a candidate the
    result is empty.  Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    stripes = _counted(rows, least)
    sizes = stripes.filter("words = 0").groupBy("lang").agg(F.sum("total").alias("n"))
    phrases = _entries(stripes.filter("words > 0")).select("lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), (F.col("words") + 1).alias("size"), F.col("n").alias("a"))
    tail = F.expr("substring_index(phrase, ' ', 1 - size)")
    right = stripes.filter("words > 0").select("lang", F.col("prefix").alias("phrase"), "total", F.col("best").alias("longer"))
    left = phrases.filter("size > 2").select("lang", tail.alias("phrase"), F.lit(0).cast("long").alias("total"), F.col("a").alias("longer"))
    known = keep(right.unionByName(left).groupBy("lang", "phrase").agg(F.sum("total").alias("total"), F.max("longer").alias("longer")), "phrases")

    inside = (F.col("longer") >= least) & (100 * F.col("longer") >= subsumed * F.col("a"))
    kept = phrases.join(known.select("lang", "phrase", "longer"), ["lang", "phrase"], "left").filter(~F.coalesce(inside, F.lit(False)))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("total").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    lowest = cuts.withColumn("score", _score("a", "n", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the query.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4), (5)) AS t(m) WHERE len(w) >= m
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT * FROM f s WHERE m > 1 AND NOT EXISTS (
    SELECT 1 FROM f x WHERE x.lang = s.lang AND x.m > s.m AND x.a >= s.a AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))
), cut AS (
  SELECT lang, m, phrase, a, unnest(range(1, m)) AS k FROM c
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n.n, CAST(CAST(1000 AS HUGEINT) * cut.a * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cut JOIN n ON n.lang = cut.lang
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(string_split(cut.phrase, ' ')[1 : k], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(string_split(cut.phrase, ' ')[k + 1 : cut.m], ' ')
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM s
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY row_number() OVER w <= 2000
"""
