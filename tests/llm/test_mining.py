"""Hard negatives, collocations and languages against brute force."""

import collections
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import collocations, hard_negatives, language_id, queries

RNG = np.random.default_rng(11)

# hard negatives


def brute_negatives(rows, every, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, integer vector)."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in (r for r in rows if r[0] % every == 0):
        scored = sorted(((-dot(v, w), j, k) for j, k, w in rows if j != i))
        for s, j, k in [x for x in scored if x[2] == label][:positives]:
            found = [(n, m) for n, m, other in scored if other != label and low * -s <= 100 * -n <= high * -s]
            out += [(i, j, rank, m, -s, -n) for rank, (n, m) in enumerate(found[:negatives], 1)]
    return sorted(out)


def taken(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("width, scale", [(13, 1), (8, 256), (1, 100000), (30, 3)])
def test_hard_negatives_against_brute_force(spark, width, scale):
    vectors = RNG.normal(0.3, 1, (260, width)).astype(np.float32)
    vectors[40:120] = vectors[3]  # a third are one vector: ties everywhere
    labels = RNG.integers(0, 4, 260)
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, vectors, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = taken(hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, scale=scale))
    whole = [(i, k, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, k, v in rows]
    assert got == brute_negatives(whole, 20) and got


def test_anchors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rows = [(i, i % 3, RNG.normal(0.2, 1, 8).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert taken(hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, scale=10)) == brute_negatives([(i, k, np.floor(10 * np.array(v))) for i, k, v in rows], 5)


def test_hard_negatives_of_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<double>, id string, anchor int, planes string, rank int"
    nan, inf = float("nan"), float("inf")
    good = [(100, 1, [1.0, 2.0]), (101, 1, [2.0, 2.0]), (102, 2, [1.0, 1.0]), (103, 2, [1.0]), (104, 2, []), (200, 7, [1.0, 1.0])]
    bad = [(1, 2, None), (2, None, [1.0, 1.0]), (3, 2, [1.0, None]), (4, 2, [nan, 1.0]), (5, 2, [1.0, inf]), (None, 2, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 0, "p", 9) for r in good + bad + [good[2]]], schema)
    got = taken(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, scale=1))
    # 101 scores 6; 102, there twice, and 200 score 3, 103 scores 1; the anchor 200 has no positive
    assert got == [(100, 101, 1, 102, 6, 3), (100, 101, 2, 102, 6, 3), (100, 101, 3, 200, 6, 3)]
    assert hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.filter("vec_id < 100"), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(df.withColumn("embedding", F.array(F.lit(1e12))), F.col("vec_id") % 100 == 0)


def test_planes_and_tables():
    values = RNG.integers(-300, 300, (50, 16))
    planes = hard_negatives.pack(values, 10)
    assert (hard_negatives.unpack(planes) == values).all()
    anchors = RNG.integers(-300, 300, (9, 16))
    assert (hard_negatives.scores(planes, hard_negatives.tables(anchors, np.int64)) == values @ anchors.T).all()


# collocations


def brute_phrases(rows, least=100, subsumed=100, most=2000):
    n, f = collections.Counter(), collections.Counter()
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            covered.update((lang, q) for i in range(len(p) - m + 1) if (q := p[i : i + m]) and 100 * a >= subsumed * f[lang, q])
    ranked = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            ranked[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, own in ranked.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:most], 1))


def phrases(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_against_brute_force(spark):
    words = ["The", "of", "née", "x\x00y", "A", "ab-c", "ÄB", "w v", "zz"]
    rows = []
    for i in range(400):
        w = RNG.choice(words, RNG.integers(0, 30), p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]).tolist()
        seps = RNG.choice([" ", "  ", "\t", ". ", "\n", ",", "!? ", "\r\n"], len(w), p=[0.7, 0.05, 0.05, 0.1, 0.03, 0.03, 0.02, 0.02])
        rows.append((["en", "de", None, ""][i % 4], "".join(a + b for a, b in zip(w, seps, strict=True))))
    rows += [("en", "common phrase of five words")] * 150 + [("en", None), (None, None), ("fr", " .. ")]
    df = spark.createDataFrame([(a, b, 1, "s", 2) for a, b in rows], "lang string, text string, n int, phrase string, words int").repartition(5)
    for how in ({"least": 10}, {"least": 25, "subsumed": 60}, {"least": 5, "most": 40}):
        got = phrases(df, **how)
        assert got == brute_phrases(rows, **how) and len({r[0] for r in got}) >= 3
    assert phrases(df.filter("false")) == [] == phrases(df.limit(1))


def test_long_texts_in_parts(monkeypatch):
    """Stripes of a text read in parts are those of the whole text."""
    text = " ".join(RNG.choice(["aa", "b", "c.", "dd,", "e\tf", "g" * 40], 3000))

    def stripes(limit, level, frequent):
        monkeypatch.setattr(collocations, "SLICE", limit)
        out = collections.Counter()
        batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "b aa"])], names=["lang", "text"])
        for rows in collocations._stripes(level, frequent, frozenset())([batch]):
            for r in rows.to_pylist():
                for prefix, words, counts in zip(r["prefixes"], r["nexts"], r["counts"], strict=True):
                    for w, n in zip(words.split(b" "), counts.split(b" "), strict=True):
                        out[r["words"], prefix, w] += int(n)
        return out

    class Every:
        value = np.full(collocations.BITS // 64, 0xFFFFFFFFFFFFFFFF, np.uint64)

    for level in range(4):
        whole = stripes(1 << 20, level, Every)
        assert whole == stripes(500, level, Every) == stripes(37, level, Every)
        if level:
            of = [k for k in whole if k[0] == level]
            assert sum(whole[k] for k in of) == sum(n for k, n in stripes(1 << 20, level - 1, Every).items() if k[0] == level - 1 and k[2] != b".")


def test_exact_scores_past_64_bits(spark):
    cases = [(10**12, 10**15, 10**12, 10**13), (123456789012, 987654321098765, 223456789013, 323456789017), (100, 10**14, 100, 100)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").select("a", "n", "l", "r", collocations._score("a", "n", "l", "r").alias("s"))
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in df.collect())


# languages


def test_languages_of_held_out_texts(spark, sf_dir):
    docs = queries.table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    got = queries.op13_language_id(spark, sf_dir.replace("0.001", "0.01")).toPandas().set_index("doc_id")
    want = docs.toPandas().set_index("doc_id")
    assert len(got) == len(want) and got["score"].between(0, 1).all()
    assert all(got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    held = got[got["held_out"] & got["accepted"]]
    assert (held["lang_pred"] == want["lang"].reindex(held.index)).mean() > 0.98
    assert got["accepted"].mean() > 0.95


def test_language_is_the_smallest_of_all(spark):
    en, de = "the house and the garden of the king " * 30, "das haus und der garten des königs " * 30
    rows = [(1, en, "en"), (2, de, "de"), (3, en, "en"), (4, "The garden and the king", None), (5, "Der Garten und das Haus", "xx"), (6, None, "de"), (7, "", "de"), (8, "123 -- 45", "de"), (9, "ж" * 20_000, None), (9, "q", None)]
    df = spark.createDataFrame([(*r, 1, "m", False) for r in rows], "doc_id long, text string, lang string, margin int, id string, accepted boolean")
    made = language_id.train(df, F.col("doc_id") <= 3)
    assert list(made.dictionaries) == ["en", "de"]
    got = [tuple(r) for r in language_id.identified(df, made).select("doc_id", "lang_pred", "accepted", "margin", "score").collect()]
    assert len(got) == len(rows)
    for i, lang, accepted, margin, score in got:
        text = next(t for k, t, _ in rows if k == i)
        if i in (6, 7, 8):
            assert (lang, accepted, margin, score) == ("und", False, 0, 0.0)
        elif i != 9:
            sizes = made.sizes(text)
            assert lang == list(made.dictionaries)[int(np.argmin(sizes))] and margin == max(sizes) - min(sizes) and accepted == (margin >= 3)
    assert {i: k for i, k, *_ in got if i < 6} == {1: "en", 2: "de", 3: "en", 4: "en", 5: "de"}
    none = language_id.train(df, F.lit(False))
    assert {r["lang_pred"] for r in language_id.identified(df, none).collect()} == {"und"}
    assert language_id.identified(df.filter("false"), made).count() == 0
    # copies of one text fill no dictionary
    many = df.filter("doc_id = 1").unionByName(df.filter("doc_id = 1")).unionByName(df.filter("doc_id = 2"))
    assert len(language_id.train(many, F.lit(True)).dictionaries["en"]) <= language_id.WINDOW
