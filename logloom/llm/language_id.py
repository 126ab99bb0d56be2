"""Language of a text: the dictionary under which it compresses best.

Each language has a raw-content zstandard dictionary, made of windows of its learned
texts.  A text is cut into blocks, all of them are compressed with every dictionary,
and the smallest sum wins; a narrow margin rejects the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as tk

#: Bytes of a dictionary, and characters of the windows it is made of.
DICTIONARY = 32 << 10
WINDOW = 400
#: At most so many windows, each of another text, are looked at for a language.
WINDOWS = 400
#: Bytes compressed at once: no block leans on much of its own text in place of the dictionary.
BLOCK = 8_000
LEVEL = 6
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


class Languages:
    """Languages in the order that breaks ties, and their dictionaries; compressors are made where they are used."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self._made: list | None = None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_made": None}

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of a whole text under each dictionary."""
        if self._made is None:
            params = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=DICTIONARY, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = []
            for content in self.dictionaries.values():
                known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(compression_params=params)
                self._made.append(zstd.ZstdCompressor(compression_params=params, dict_data=known))
        data = memoryview(text.lower().encode())
        blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self._made]

    def best(self, text: str | None) -> tuple[str, int, float]:
        """(language, bytes to the next smallest, score) of a text."""
        if not text or not self.dictionaries or not _LETTER.search(text):
            return UNKNOWN, 0, 0.0
        sizes = self.sizes(text)
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        least = sizes[ranked[0]]
        margin = sizes[ranked[1]] - least if len(ranked) > 1 else least
        return list(self.dictionaries)[ranked[0]], margin, 1 / sum(0.5 ** min(s - least, 1000) for s in sizes)


def train(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Dictionaries of the languages named by rows where ``learnable`` holds, for rows with a letter in their text.

    For a language, up to ``WINDOWS`` distinct texts, those of least hash, give one
    window each, at a place that the hash chooses, until the dictionary is full.  So
    many copies of a text count once, and the driver gets ``WINDOWS`` windows a
    language at most.  Rows with a null language or text are not learned from.
    """
    rows = docs.filter(learnable).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    start = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    windows = hashed.select("lang", "hash", F.substring("text", start, F.lit(WINDOW)).alias("window"))
    windows = windows.groupBy("lang", "hash").agg(F.min("window").alias("window"), F.count(F.lit(1)).alias("n"))
    least = Window.partitionBy("lang").orderBy("hash")
    found = windows.withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= WINDOWS).select("lang", "rank", "window").toPandas()
    share = {r["lang"]: r["n"] for r in windows.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
    made = {}
    for lang in sorted(share, key=lambda k: (-share[k], k)):
        own = found[found["lang"] == lang].sort_values("rank")["window"]
        made[lang] = " ".join(own).lower().encode()[:DICTIONARY]
    return Languages(made)


def identified(docs: DataFrame, languages: Languages, least_margin: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, margin, accepted) of every row, over its whole text.

    ``lang_pred`` is the language of the smallest compressed size, the one of more
    learned texts among equals; ``und`` for a null text, one without a letter, or if
    nothing was learned (score and margin 0).  ``margin`` is how many bytes the next
    one takes more, ``score`` 1 over the sum of 2 to the power of minus each
    language's excess bytes (0.5 for two equals).  ``accepted`` is false for ``und``
    and for margins under ``least_margin``.  Repeated rows stay, other columns are
    ignored; a text of any length costs time in proportion.
    """
    spark = ship(docs.sparkSession)
    known = spark.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, _, _ in tk.slices(texts):
                made = [known.value.best(t) for t in texts.slice(a, b - a).to_pylist()]
                lang, margin, score = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64())], names=["id", "lang_pred", "score", "margin"])
        tk.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "id long, lang_pred string, score double, margin long")
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= least_margin)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", "margin", accepted.alias("accepted"))
