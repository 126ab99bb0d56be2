"""Secrets in texts: three fixed patterns, and random-looking strings by two Markov models.

All work is in DataFrame expressions, and linear in the text.  A match's place is the
length of all matches and of all text between matches before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order of kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6
#: What the models look at: unbroken runs of these characters, 20 or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Imagined transitions after each character, dealt out as single characters are.
BACKED = 8.0
#: Log-likelihood ratio of a whole run from which it is a secret.
LEAST_RATIO = 15.0


#: Matches whose places are added up in one array; a step through a long array would copy all of it.
RUN_OF = 64
#: Stands for a character of a base span; it is in no text that ``_outside`` looks at.
COVER = "\u0001"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(text: Column, pattern: str, found: Column, kind: str, value: Column | None = None) -> Column:
    """array<struct<start, rank, end, value>> of the matches ``found`` of ``pattern``, in order; places from 0, in code points."""
    rank = KINDS.index(kind)
    gaps = F.split(text, pattern, -1)  # one more than matches
    items = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), (found if value is None else value).alias("value"))
    schema = "array<struct<start:int,rank:int,end:int,value:string>>"
    empty = F.from_json(F.lit("[]"), schema)

    def one(acc: Column, item: Column) -> Column:
        start = acc["next"] + F.length(item["gap"])
        end = start + F.length(item["match"])
        return F.struct(end.alias("next"), F.array_append(acc["spans"], F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), item["value"].alias("value"))).alias("spans"))

    def begin(acc: Column, part: Column) -> Column:
        size = F.aggregate(part, F.lit(0), lambda n, item: n + F.length(item["gap"]) + F.length(item["match"]))
        return F.struct((acc["next"] + size).alias("next"), F.array_append(acc["begins"], acc["next"]).alias("begins"))

    cut = lambda every, size: F.transform(F.sequence(F.lit(1), F.size(every), F.lit(size)), lambda first: F.slice(every, first, F.lit(size)))
    parts = lambda every: F.flatten(F.transform(cut(every, RUN_OF * RUN_OF), lambda part: cut(part, RUN_OF)))
    begins = lambda every: F.aggregate(every, F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("begins")), begin, lambda acc: acc["begins"])
    spans = lambda part, at: F.aggregate(part, F.struct(at.alias("next"), empty.alias("spans")), one, lambda acc: acc["spans"])
    walk = _let(_let(items, parts), lambda every: F.flatten(F.zip_with(every, begins(every), spans)))
    return F.when(F.size(found) > 0, walk).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, leftmost and non-overlapping in each kind.

    Matches of ``assign`` are found first and those with a short value dropped then.
    For the other two a run's length decides, so the least length is in the pattern.
    """
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(_placed(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), "assign", values), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    access = _placed(text, ACCESS, F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), "access")
    return F.concat(assign, access, _placed(text, HEX, F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), "hex"))


def _outside(text: Column) -> Column:
    """The text with COVER for each character of a base span; all places stay as they are.

    A run that touches a base span then has a COVER in it.
    """

    def covered(text: Column, pattern: str, value: int) -> Column:
        items = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"))
        cover = lambda i: F.when(F.length(i["value"]) >= LEAST_VALUE, F.repeat(F.lit(COVER), F.length(i["match"]))).otherwise(F.coalesce(i["match"], F.lit("")))
        return F.when(text.rlike(pattern), F.array_join(F.transform(items, lambda i: F.concat(i["gap"], cover(i))), "")).otherwise(text)

    plain = F.translate(text, COVER, " ")
    return _let(_let(covered(plain, ASSIGN, 2), lambda t: covered(t, ACCESS, 0)), lambda t: covered(t, HEX, 0))


def _pairs(run: Column) -> Column:
    """Each character of a run with the next one."""
    return _let(F.split(run, ""), lambda c: F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c) - 1).alias("b")))


def _clean(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def train(docs: DataFrame, sample: int = 3000, made: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The ratio log P(next | char, random) - log P(next | char, ordinary) for each pair of characters.

    Labelled samples: random are the values of the fixed patterns in the sampled
    rows, and ``made`` digests in base 64 and base 16; ordinary are the runs of
    twelve and more characters of the same rows that touch none.  At most ``sample``
    rows are used, first in the order of a hash of their id; what comes back has a
    row for each pair of characters.
    """
    chosen = docs.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), _clean(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` ids
    rows = rows.select("text", base_spans(F.col("text")).alias("base"))
    secret = rows.select(F.explode("base.value").alias("run"), F.lit(1).alias("random"))
    runs = F.regexp_extract_all(_outside(F.col("text")), F.lit(f"[A-Za-z0-9+/_{COVER}-]{{12,}}"), F.lit(0))
    ordinary = rows.select(F.explode(F.filter(runs, lambda r: ~F.contains(r, F.lit(COVER)))).alias("run"), F.lit(0).alias("random"))
    digest = docs.sparkSession.range(made).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    digests = digest.select(F.explode(F.array(F.base64(F.unhex("d")), F.substring("d", 1, 40), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex("d")), "[^A-Za-z0-9]", ""), 1, 32)))).alias("run"), F.lit(1).alias("random"))
    every = secret.union(ordinary).union(digests).where(F.length("run") > 1)
    pairs = every.select("random", F.explode(F.transform(_pairs(F.col("run")), lambda p: F.concat(p["a"], p["b"]))).alias("pair"))
    size = len(ALPHABET)
    count = [[0.0] * (size * size) for _ in range(2)]
    for r in pairs.groupBy("random", "pair").count().collect():  # at most two rows a pair
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            count[r["random"]][a * size + b] += r["count"]
    single = [[sum(c[a * size + b] for a in range(size)) + 0.5 for b in range(size)] for c in count]
    ratio = []
    for a in range(size):
        row = []
        for c, one in zip(count, single, strict=True):
            seen, every = sum(c[a * size : a * size + size]), sum(one)
            row.append([(c[a * size + b] + BACKED * one[b] / every) / (seen + BACKED) for b in range(size)])
        ratio += [math.log(row[1][b] / row[0][b]) for b in range(size)]
    return ratio


def _ratio(run: Column, ratio: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratio)), ",").cast("array<double>")
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    return F.aggregate(_pairs(run), F.lit(0.0), lambda acc, p: acc + F.element_at(table, (code(p["a"]) - 1) * len(ALPHABET) + code(p["b"])))


def find(docs: DataFrame, ratio: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) for every row: arrays of (start, rank, end, value), by start and then by kind.

    ``rank`` is the kind's place in KINDS; places are in code points, from 0, the
    end exclusive.  ``spans`` has the base spans, and runs that touch none of them
    and that the models call random.  Null and empty texts have no spans; repeated
    rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), _clean(text_col).alias("text"))
    run = f"[A-Za-z0-9+/_{COVER}-]{{20,}}"
    rows = rows.select(id_col, F.array_sort(base_spans(F.col("text"))).alias("base"), _outside(F.col("text")).alias("outside"))
    rows = rows.select(id_col, "base", "outside", F.regexp_extract_all("outside", F.lit(run), F.lit(0)).alias("runs"))
    likely = lambda s: ~F.contains(s["value"], F.lit(COVER)) & (_ratio(s["value"], ratio) >= LEAST_RATIO)
    odd = F.filter(_placed(F.col("outside"), run, F.col("runs"), "random"), likely)
    return rows.select(id_col, "base", F.array_sort(F.concat("base", odd)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")
