"""Quality rules that vote or abstain, weighed by expectation-maximisation.

One pass counts what the rules look at.  Votes of all documents are then counted by
pattern (at most three to the power of the rules), which is all that estimating
each rule's accuracy needs, so the estimate covers every document whatever their
number.  A document's verdict is the posterior probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as tk
from .store import keep

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True  # of other alphabets, by their bytes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_plain_words", "n_echo_words")


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text, over its whole length."""
    n = len(offsets) - 1
    words, lines = tk.Words(data, offsets), tk.Words(data, offsets, apart=tk.LINE_END)

    def total(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[first[1:]] - run[first[:-1]]

    blank = tk.space(data)
    out = {
        "n_words": words.counts,
        "word_chars": total(~blank & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": total(_SYMBOL[data], offsets),
        "n_upper": total(_UPPER[data], offsets),
        "n_letters": total(_LETTER[data] & ((data & 0xC0) != 0x80), offsets),
    }
    # lines with a word, and those that were there before
    shown = np.concatenate([[0], np.cumsum(~blank, dtype=np.int64)])
    worded = shown[lines.end] > shown[lines.start]
    owner = np.repeat(np.arange(n), lines.counts)[worded]
    out["n_lines"] = np.bincount(owner, minlength=n)
    keys = tk.mix(lines.hash[worded] + tk.mix(owner.astype(np.uint64)))
    _, place = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[place], minlength=n)
    # words of windows that occur again in the text
    windows, first = tk.shingles(words, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(first))
    full = words.counts[owner] >= WINDOW
    windows, owner = windows[full], owner[full]
    begin = (words.first[:-1][owner] + np.arange(len(full))[full] - first[:-1][owner])[tk.again(tk.mix(windows + tk.mix(owner.astype(np.uint64))))]
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    out["n_repeat_words"] = total(np.cumsum(edge)[:-1] > 0, words.first)
    lettered = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    out["n_plain_words"] = total(lettered[words.end] > lettered[words.start], words.first)
    echo = np.zeros(len(words.hash), bool)
    echo[1:] = words.hash[1:] == words.hash[:-1]
    echo[words.first[:-1][words.counts > 0]] = False
    out["n_echo_words"] = total(echo, words.first)
    return out


def _counter():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in tk.slices(batch.column(1)):
                found = counts(data, offsets)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), *[pa.array(found[k], pa.int64()) for k in COUNTS]], names=["id", *COUNTS])

    return run


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts of COUNTS) for every row; a null text has none of anything."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(), "id long, " + ", ".join(f"{k} long" for k in COUNTS))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    """2 for good, 1 for bad, 0 to abstain."""
    return F.when(value.isNull(), 0).when(bad, 1).when(good, 2).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the counts, in the order of their digits in a pattern."""
    c = {k: F.col(k) for k in COUNTS}
    per_word = lambda k: c[k] / F.nullif(c["n_words"], F.lit(0))
    length = per_word("word_chars")
    upper = c["n_upper"] / F.nullif(c["n_letters"], F.lit(0))
    lines = c["n_dup_lines"] / F.nullif(c["n_lines"], F.lit(0))

    def share(x: Column, bad: float, good: float) -> Column:
        return _vote(x, x > bad, x < good)

    return {
        "enough_words": _vote(c["n_words"], c["n_words"] < 20, c["n_words"] >= 50),
        "word_length": _vote(length, (length < 2) | (length > 15), length.between(3, 12)),
        "few_symbols": share(per_word("n_symbols"), 0.3, 0.05),
        "mostly_text": share(c["n_symbols"] / F.nullif(c["word_chars"], F.lit(0)), 0.1, 0.02),
        "few_repeated_windows": share(per_word("n_repeat_words"), 0.3, 0.05),
        "few_repeated_lines": share(lines, 0.5, 0.1),
        "few_capitals": share(upper, 0.4, 0.15),
        "words_have_letters": _vote(c["n_words"], per_word("n_plain_words") < 0.7, per_word("n_plain_words") > 0.9),
        "few_echoes": share(per_word("n_echo_words"), 0.2, 0.02),
    }


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good quality for each pattern of votes.

    A rule that votes is right with one probability on good and another on bad
    documents; abstaining says nothing.  Both are estimated together with the share
    of good documents, from a start in which a rule seldom speaks against a good
    document and notices a quarter of the bad ones.
    """
    good, bad = patterns == 2, patterns == 1
    right_good, right_bad = np.full(patterns.shape[1], 0.995), np.full(patterns.shape[1], 0.25)
    prior = 0.8
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        up = np.log(prior) + good @ np.log(right_good) + bad @ np.log(1 - right_good)
        down = np.log(1 - prior) + good @ np.log(1 - right_bad) + bad @ np.log(right_bad)
        new = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        w, v = weights * post, weights * (1 - post)
        # a few imagined votes keep small inputs from certainty
        right_good = np.clip((w @ good + 9.95) / (w @ (good | bad) + 10), 0.55, 0.999)
        right_bad = np.clip((v @ bad + 2.5) / (v @ (good | bad) + 10), 0.05, 0.999)
        prior = float(np.clip((w.sum() + 8) / (weights.sum() + 10), 0.01, 0.99))
        if done:
            break
    return post


def judged(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, COUNTS, votes by rule, quality, good) for every row.

    ``quality`` is the posterior probability, ``good`` whether it is at least
    ``least``.  Null and empty texts have counts of nought and are judged by the
    rules that still vote.  Repeated rows stay and count as often; other columns are
    ignored; an empty table gives an empty result.
    """
    votes = rules()
    code = sum((F.lit(3**i) * v for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    seen = keep(text_counts(docs, id_col, text_col).select("*", code.alias("pattern")), "counts")
    tally = seen.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** 9 rows
    patterns = np.array([[r["pattern"] // 3**i % 3 for i in range(len(votes))] for r in tally], np.int64).reshape(len(tally), len(votes))
    post = estimate(patterns, np.array([r["count"] for r in tally], float))
    known = docs.sparkSession.createDataFrame([(r["pattern"], float(p)) for r, p in zip(tally, post, strict=True)], "pattern int, quality double")
    shown = [(F.floor(F.col("pattern") / 3**i) % 3).cast("int").alias(f"vote_{name}") for i, name in enumerate(votes)]
    return seen.join(F.broadcast(known), "pattern").select(F.col("id").alias(id_col), *COUNTS, *shown, "quality", (F.col("quality") >= least).alias("good"))
