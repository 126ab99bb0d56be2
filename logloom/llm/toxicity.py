"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words, and beginnings of words, of the labelled examples that two rows or
more hold; document frequencies are counted over all rows.  The examples form an inverted index in blocks
of alike examples, with the largest weight of each term in each block.  A query adds
these up to an upper bound of each block, visits the best blocks first and then each
one whose bound is not below the k-th best example found, so the neighbours are exact.

Labels have no part in the choice of neighbours.  A neighbour's vote weighs as much as
the terms that it shares with the query: each term's part of the cosine, times its gain,
which says how well the term tells the labels apart.  The share of the votes for label 1
is calibrated on the examples, each scored by the others.  The neighbours' ids are the
evidence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as tk
from .sampling import SAMPLE_BYTES, labelled

#: Bytes of a longer word's beginning, which is a term too, so that forms of a word meet.
BEGINNING = 5
BLOCK = 32
#: Blocks visited first, to find how similar the nearest examples are at least.
BEST_BLOCKS = 4
NEIGHBOURS = 50
#: Weight of the share of toxic examples among the votes; the average example's vote for itself weighs 1.
PRIOR_WEIGHT = 0.3
#: A term of at least one in so many examples has a row of weights, not a list of postings.
DENSE_SHARE = 16
#: Common terms by which examples are put in order, so that blocks are of one language and kind.
ORDER_TERMS = 48
#: Queries whose common terms are multiplied at once.
TOGETHER = 128
#: Rows of the whole table that hold a term, at least.
LEAST_ROWS = 2
#: Words of a shingle, and the part of all shingles in common (in hundredths) that makes examples near copies.
SHINGLE, NEAR_COPY = 5, 80
#: Answers that a worker remembers for copies.
REMEMBERED = 20_000

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of all terms of all texts: lower-case words, and the beginnings of longer ones."""
    words = tk.Words(data, offsets, lower=True, apart=_APART)
    owner = np.repeat(np.arange(len(offsets) - 1), words.counts)
    long = words.end - words.start > BEGINNING
    start = words.start[long]
    part = np.zeros(len(start), np.uint64)
    for j in range(BEGINNING):
        part = tk.mix(part + tk.byte_values(data[start + j]))
    return np.concatenate([words.hash, part]), np.concatenate([owner, owner[long]])


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list of values for each of n owners, which come in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's distinct terms with their counts, and its distinct word shingles."""
    for batch in batches:
        for a, b, data, offsets in tk.slices(batch.column(2)):
            values, owner = terms(data, offsets)
            order = np.lexsort([values, owner])
            values, owner = values[order], owner[order]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(fresh)
            count = np.diff(np.append(at, len(values)))
            sets, first = tk.distinct(*tk.shingles(tk.Words(data, offsets, lower=True), SHINGLE))
            some = batch.slice(a, b - a)
            lists = [_lists(values[at].view(np.int64), owner[at], b - a, pa.int64()), _lists(count, owner[at], b - a, pa.int32())]
            lists.append(_lists(sets.view(np.int64), np.repeat(np.arange(b - a), np.diff(first)), b - a, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists], names=["id", "label", "terms", "counts", "shingles"])


def without_near_copies(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Places of the examples that are no near copy of an earlier one that stays, of the same label.

    Near copies share NEAR_COPY hundredths of all their shingles or more, counted on the full sets.
    """
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([np.zeros(0, np.int64), *sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort([owner, values])
    values, owner = values[order], owner[order]
    stays = np.ones(len(sets), bool)
    for i, s in enumerate(sets):
        start, end = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
        shared = np.bincount(owner[_ranges(start, end)], minlength=len(sets))[:i]
        alike = (100 * shared >= NEAR_COPY * (size[i] + size[:i] - shared)) & (shared > 0)
        stays[i] = not (alike & stays[:i] & (labels[:i] == labels[i])).any()
    return np.flatnonzero(stays)


class Vocabulary:
    """Sorted hashes of terms, with a small table that rules most other words out."""

    def __init__(self, hashes: np.ndarray):
        self.ranked = np.unique(hashes)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.ranked & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) in order, for the terms of each text; terms are places in the vocabulary."""
        values, owner = terms(data, offsets)
        maybe = self.hint[(values & np.uint64((1 << 20) - 1)).astype(np.int64)]
        values, owner = values[maybe], owner[maybe]
        size = max(len(self.ranked), 1)
        at = np.minimum(np.searchsorted(self.ranked, values), size - 1)
        real = self.ranked[at] == values if len(self.ranked) else np.zeros(len(values), bool)
        key, count = np.unique(owner[real] * size + at[real], return_counts=True)
        return *np.divmod(key, size), count


def _holders(vocabulary):
    """(term, n): in how many rows of a partition each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held = np.zeros(len(known.ranked), np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.slices(batch.column(0)):
                held += np.bincount(known.counts(data, offsets)[1], minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["term", "n"])

    return run


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of several ranges, one range after the other."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def gains(owner: np.ndarray, term: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """For each term: rows with it times the divergence of their (smoothed) share of label 1 from that of all rows."""
    p = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
    held = np.bincount(term, minlength=size)
    share = (np.bincount(term, labels[owner], minlength=size) + p) / (held + 1)
    return np.maximum(held * (share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p))), 1e-9)


class Index:
    """Examples by term, in blocks of examples with each term's largest weight.

    Rows (owner, term, count) are in order; ``term_weight`` is what one occurrence weighs
    in a cosine, ``gain`` what a shared term weighs in a vote.
    """

    def __init__(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, labels: np.ndarray, ids: np.ndarray, term_weight: np.ndarray, gain: np.ndarray, prior: float):
        self.term_weight, self.labels, self.ids, self.prior = term_weight, labels.astype(np.float64), ids, prior
        n = len(labels)
        weight = (1 + np.log(count)) * term_weight[term]
        weight = weight / np.sqrt(np.bincount(owner, weight**2, minlength=n))[owner]
        own_vote = float((weight**2 * gain[term]).sum()) / max(n, 1)
        self.gain = gain / own_vote if own_vote > 0 else gain
        held = np.bincount(term, minlength=len(term_weight))
        #: Example of each place; examples that hold the same common terms stand together, so that bounds are tight.
        bits = np.zeros((ORDER_TERMS, n), bool)
        for j, common in enumerate(np.argsort(-held, kind="stable")[:ORDER_TERMS]):
            bits[j, owner[term == common]] = True
        self.at_place = np.lexsort([np.arange(n), *bits[::-1]])
        place = np.empty(n, np.int64)
        place[self.at_place] = np.arange(n)
        self.blocks = max(1, -(-n // BLOCK))
        self.dense = np.full(len(term_weight), -1)
        common = np.flatnonzero(held * DENSE_SHARE >= max(n, 1))
        self.dense[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks * BLOCK))
        of_row = self.dense[term] >= 0
        self.rows[self.dense[term[of_row]], place[owner[of_row]]] = weight[of_row]
        self.row_gain, self.vote_rows = self.gain[common], self.rows.astype(np.float32)
        # the other terms have postings; an entry is a term's postings in one block
        term, spot, weight = term[~of_row], place[owner[~of_row]], weight[~of_row]
        order = np.lexsort([spot, term])
        term, self.spot, self.weight = term[order], spot[order], weight[order]
        block = self.spot // BLOCK
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(fresh)
        self.begin = np.append(at, len(term))
        self.block = block[at]
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else self.weight
        self.entries = np.searchsorted(term[at], np.arange(len(term_weight) + 1))
        self.calibration = np.array([[0.0, 1.0], [0.0, 1.0]])
        self.answers: dict[bytes, tuple[float, list[int]]] = {}

    def weights(self, terms_: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.term_weight[terms_]
        return w / np.sqrt((w**2).sum())

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(similarities, examples, votes) for each query of (terms, counts): the k examples of largest cosine above 0, of equals the first."""
        for a in range(0, len(queries), TOGETHER):
            some = queries[a : a + TOGETHER]
            common, rare = np.zeros((len(some), len(self.rows))), []
            for i, (terms_, counts) in enumerate(some):
                q = self.weights(terms_, counts)
                row = self.dense[terms_]
                common[i, row[row >= 0]] = q[row >= 0]
                rare.append((terms_[row < 0], q[row < 0]))
            # the common terms' parts, exact for all examples
            cosines, votes = common @ self.rows, ((common * self.row_gain).astype(np.float32) @ self.vote_rows).astype(np.float64)
            for i, (terms_, q) in enumerate(rare):
                yield self._nearest(terms_, q, cosines[i], votes[i], k)

    def _nearest(self, terms_: np.ndarray, q: np.ndarray, cosine: np.ndarray, vote: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end = self.entries[terms_], self.entries[terms_ + 1]
        entry, q, vq = _ranges(start, end), np.repeat(q, end - start), np.repeat(q * self.gain[terms_], end - start)
        block = self.block[entry]
        bound = np.bincount(block, q * self.most[entry], minlength=self.blocks) + cosine.reshape(self.blocks, BLOCK).max(axis=1)
        seen = np.zeros(self.blocks, bool)

        def visit(blocks: np.ndarray) -> float:
            """Adds the postings of some blocks; the k-th best similarity so far."""
            wanted = np.flatnonzero(blocks[block])
            start, end = self.begin[entry[wanted]], self.begin[entry[wanted] + 1]
            at = _ranges(start, end)
            spot, weight = self.spot[at], self.weight[at]
            cosine[:] += np.bincount(spot, np.repeat(q[wanted], end - start) * weight, minlength=len(cosine))
            vote[:] += np.bincount(spot, np.repeat(vq[wanted], end - start) * weight, minlength=len(cosine))
            seen[blocks] = True
            whole = cosine * np.repeat(seen, BLOCK)
            return float(np.partition(whole, -k)[-k]) if k < len(whole) else 0.0

        best = np.zeros(self.blocks, bool)
        best[np.argsort(-bound, kind="stable")[:BEST_BLOCKS]] = True
        least = visit(best)
        least = visit(~best & (bound > 0) & (bound >= least - 1e-9))
        found = np.flatnonzero(np.repeat(seen, BLOCK) & (cosine > 0) & (cosine >= least - 1e-9))
        similar, example = cosine[found].round(12), self.at_place[found]
        first = np.lexsort([example, -similar])[:k]
        return similar[first], example[first], vote[found[first]]

    def share(self, examples: np.ndarray, votes: np.ndarray) -> float:
        """The share of label 1 in votes, to six places, as sums depend a little on what is added up together."""
        return round(float((votes @ self.labels[examples] + PRIOR_WEIGHT * self.prior) / (votes.sum() + PRIOR_WEIGHT)), 6)

    def calibrate(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """Fits scores to the examples' labels: the others vote on each, and shares are pooled until their labels rise with them."""
        held = np.unique(owner)
        if not len(held):
            return
        first = np.searchsorted(owner, np.append(held, len(self.labels)))
        queries = [(term[a:b], count[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        shares = []
        for i, (_, examples, votes) in zip(held, self.nearest(queries, NEIGHBOURS + 1), strict=True):
            others = np.flatnonzero(examples != i)[:NEIGHBOURS]
            shares.append(self.share(examples[others], votes[others]))
        self.calibration = rising(np.array(shares), self.labels[held])

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each query; equal queries are answered once."""
        keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in queries]
        if len(self.answers) >= REMEMBERED:
            self.answers.clear()
        fresh = {k: q for k, q in zip(keys, queries, strict=True) if k not in self.answers}
        for k in [k for k, q in fresh.items() if not len(q[0]) or not len(self.labels)]:
            self.answers[k] = self.prior, []
            del fresh[k]
        for k, (_, examples, votes) in zip(fresh, self.nearest(list(fresh.values())), strict=True):
            self.answers[k] = float(np.interp(self.share(examples, votes), *self.calibration)), self.ids[examples].tolist()
        return [self.answers[k] for k in keys]


def rising(share: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(shares, probabilities), both rising, between which one interpolates: neighbours in order are pooled
    while a later pool has no larger part of label 1, and each pool stands at its mean share.

    A pool's part of label 1 is drawn a little to one half, so that few rows make no certainty.
    """
    pools: list[list[float]] = []
    order = np.argsort(share, kind="stable")
    for x, y in zip(share[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([1.0, x, y])
        while len(pools) > 1 and pools[-1][2] * pools[-2][0] <= pools[-2][2] * pools[-1][0]:
            n, x, y = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + x, pools[-1][2] + y]
    made = np.array(pools)
    shares, parts = made[:, 1] / made[:, 0], (made[:, 2] + 0.5) / (made[:, 0] + 1)
    return np.stack([shares, np.maximum.accumulate(parts)])


def _scorer(vocabulary, index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, examples = vocabulary.value, index.value
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(1)):
                text, term, count = known.counts(data, offsets)
                first = np.searchsorted(text, np.arange(b - a + 1))
                found = examples.scores([(term[i:j], count[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["id", "score", "evidence"]
                )

    return run


def scored(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", sample: int = 2500, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, evidence) for every row of ``docs``.

    At most ``sample`` labelled rows for which ``may_learn`` holds are taken, of at most
    ``sample_bytes`` together; of near copies among them (exact Jaccard of word shingles)
    with one label the first stays, since words that only copies share would look like
    words of their label.  All their words are terms, with the beginnings of longer ones,
    but for those that one row alone holds, and every text that has one is scored by its nearest examples.  Document frequencies
    are counted over all rows.  ``evidence`` has the ids of the nearest examples.  Null
    and empty texts, and texts without a word of the examples, score the share of label 1.
    Repeated rows stay and count as often; without labels every score is the same; other
    columns are ignored.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    examples = labelled(docs, labels, may_learn, label_col, sample, sample_bytes, id_col, text_col).select("id", "label", "text")
    # at most `sample` rows, of values in proportion to `sample_bytes`
    learned = examples.mapInArrow(_example_terms, "id long, label int, terms array<long>, counts array<int>, shingles array<long>").orderBy("id").toArrow().combine_chunks()
    marks = learned["label"].to_numpy().astype(np.int64)
    parts = {c: _split(learned[c]) for c in ("terms", "counts", "shingles")}
    seen = (marks.sum() + 0.5) / (len(marks) + 5)  # with near copies
    stays = without_near_copies(parts["shingles"], marks)
    ids, marks = learned["id"].to_numpy()[stays], marks[stays]
    joined = lambda c: np.concatenate([np.zeros(0, np.int64), *[parts[c][i] for i in stays]])
    hashes, count = joined("terms").view(np.uint64), joined("counts")
    owner = np.repeat(np.arange(len(stays)), np.array([len(parts["terms"][i]) for i in stays], np.int64))
    vocabulary = Vocabulary(hashes)
    term = np.searchsorted(vocabulary.ranked, hashes)
    shared = spark.sparkContext.broadcast(vocabulary)  # the examples' words
    held = np.zeros(len(vocabulary.ranked))
    counted = rows.select("text").mapInArrow(_holders(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held[counted["term"].to_numpy()] = counted["n"].to_numpy()  # at most a row for each word of the examples
    # a term of one row alone brings no neighbour, and would make its row less like all others
    found = held >= LEAST_ROWS
    vocabulary, real = Vocabulary(vocabulary.ranked[found]), found[term]
    shared.unpersist()
    shared = spark.sparkContext.broadcast(vocabulary)
    owner, term, count, held = owner[real], (np.cumsum(found) - 1)[term[real]], count[real], held[found]
    idf = np.log((rows.count() + 1) / (held + 1)) + 1
    index = Index(owner, term, count, marks, ids, idf, gains(owner, term, marks, len(held)), float(seen))
    index.calibrate(owner, term, count)
    made = rows.mapInArrow(_scorer(shared, spark.sparkContext.broadcast(index)), "id long, score double, evidence array<long>")
    return made.withColumnRenamed("id", id_col)


def _split(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's values, as a view of all."""
    lists = column.combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
