"""Quality from a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered by overlapping chunks.  In each chunk learned
filters run over embedded bytes and are max-pooled.  Each chunk's pooled values are then
averaged and max-pooled over all chunks of the document and combined into one
probability.

The network is fitted on whole texts of a bounded sample of labelled rows; scoring
covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as tk
from .sampling import SAMPLE_BYTES, labelled

CHUNK, STEP = 256, 224  # bytes in a chunk, and from one chunk's start to the next
WIDTH, STRIDE, EMBED, FILTERS = 32, 4, 8, 16
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
PIECE = 128  # chunks handled at once


@dataclass(frozen=True)
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS,): weights of means, then of maxima
    base: float


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks of CHUNK bytes, true length of each, first chunk of each text).

    Every byte is in a chunk; an empty text has one empty chunk.  Short chunks are
    filled up with zero bytes.
    """
    size = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(size - (CHUNK - STEP), 1) // STEP))
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    begin = offsets[:-1][owner] + (np.arange(first[-1]) - first[owner]) * STEP
    length = np.clip(offsets[1:][owner] - begin, 0, CHUNK)
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    out = padded[begin[:, None] + np.arange(CHUNK)]
    out[np.arange(CHUNK) >= length[:, None]] = 0
    return out, length, first


def _windows(net_embed: np.ndarray, block: np.ndarray) -> np.ndarray:
    x = net_embed[block].reshape(len(block), CHUNK * EMBED)
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
    return np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED)


def pooled(net: Network, block: np.ndarray, want_places: bool = False):
    """(chunks, FILTERS) max-pooled responses, and where each filter's maximum lies."""
    z = (_windows(net.embed, block) @ net.filters).reshape(len(block), POSITIONS, FILTERS)
    top = z.max(axis=1)
    out = np.maximum(top + net.bias, 0)
    return (out, z.argmax(axis=1), top) if want_places else out


def combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * FILTERS): mean and maximum over each text's chunks."""
    n = np.diff(first)[:, None]
    return np.concatenate([np.add.reduceat(values, first[:-1], axis=0) / n, np.maximum.reduceat(values, first[:-1], axis=0)], axis=1)


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    block, _, first = chunks(data, offsets)
    values = np.concatenate([pooled(net, block[i : i + PIECE]) for i in range(0, len(block), PIECE)])
    return 1 / (1 + np.exp(-np.clip(combine(values, first) @ net.top + net.base, -30, 30).astype(np.float64)))


def gradients(net: Network, block: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over the texts, for each part of the network; PIECE chunks at a time."""
    made = [pooled(net, block[i : i + PIECE], True) for i in range(0, len(block), PIECE)]
    values, place, raw_top = (np.concatenate(part) for part in zip(*made, strict=True))
    x = combine(values, first)
    d = ((1 / (1 + np.exp(-np.clip(x @ net.top + net.base, -30, 30))) - y) / len(y)).astype(np.float32)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(y)), n)
    back = d[:, None] * net.top[None]  # (texts, 2 * FILTERS)
    dv = (back[:, :FILTERS] / n[:, None])[owner]
    best = values == x[:, FILTERS:][owner]
    ties = np.add.reduceat(best, first[:-1], axis=0, dtype=np.float32)  # equal chunks share the gradient
    dv += back[:, FILTERS:][owner] * best / ties[owner]
    dz = dv * (raw_top + net.bias > 0)
    g = {"top": x.T @ d, "base": np.array([d.sum()], np.float32), "bias": dz.sum(axis=0), "filters": np.zeros_like(net.filters), "embed": np.zeros_like(net.embed)}
    for i in range(0, len(block), PIECE):
        # only the window under each maximum has a gradient
        some, dp, at = block[i : i + PIECE], dz[i : i + PIECE], place[i : i + PIECE] * STRIDE
        windows = some[np.arange(len(some))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # (chunks, FILTERS, WIDTH)
        seen = net.embed[windows].reshape(len(some), FILTERS, WIDTH * EMBED)
        g["filters"] += np.einsum("cfk,cf->kf", seen, dp)
        de = (dp[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        for e in range(EMBED):
            g["embed"][:, e] += np.bincount(windows.ravel(), de[:, e], minlength=256)
    g["embed"][0] = 0  # the filling
    return g


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 12, batch: int = 64, seed: int = 11) -> Network:
    """Adam on the log loss over batches of whole texts.

    Without both labels the network answers the share of label 1 for every text.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "top": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "base": np.zeros(1, np.float32),
    }
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Network(p["embed"], p["filters"], p["bias"], np.zeros(2 * FILTERS, np.float32), float(np.log((share + 0.01) / (1.01 - share))))
    p["base"][0] = np.log(share / (1 - share))
    p["embed"][0] = 0  # the filling
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        rate = 0.01 * 0.5 ** (turn / 2)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            size = np.array([len(texts[r]) for r in rows])
            data = np.frombuffer(b"".join([texts[r] for r in rows]), np.uint8)
            net = Network(p["embed"], p["filters"], p["bias"], p["top"], float(p["base"][0]))
            block, _, first = chunks(data, np.concatenate([[0], np.cumsum(size)]))
            g = gradients(net, block, first, y[rows])
            step += 1
            for k in p:
                m, v = moment[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Network(p["embed"], p["filters"], p["bias"], p["top"], float(p["base"][0]))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", sample: int = 2000, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network fitted on at most ``sample`` labelled rows for which ``may_learn`` holds.

    The fit reads these rows' whole texts, at most ``sample_bytes`` together, on the
    driver, in pieces of bounded size.
    """
    rows = labelled(docs, labels, may_learn, label_col, sample, sample_bytes, id_col, text_col)
    got = rows.select("id", F.encode("text", "UTF-8").alias("raw"), "label").collect()  # at most `sample` rows of `sample_bytes`
    got.sort(key=lambda r: r.id)
    return fit([bytes(r.raw) for r in got], np.array([r.label for r in got]))


def _scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in tk.slices(batch.column(1), 1_000_000):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(probabilities(net, data, offsets), pa.float64())], names=["id", "score"])
        tk.give_back()

    return run


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row, over all bytes of its text; null and empty texts have the score of no bytes.

    Equal texts have equal scores.  Repeated rows stay, other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(net), "id long, score double").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text scores at least ``least``."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(place), 1_000_000):
                yield batch.slice(a, b - a).filter(pa.array(probabilities(net, data, offsets) >= least))
        tk.give_back()

    return docs.mapInArrow(run, docs.schema)
