"""Operators on single texts: pieces, secrets, rules, classifiers, lines."""

import collections
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import byte_cnn, line_dedup, pieces, quality_rules, sampling, secrets, toxicity
from logloom.llm import textkit as tk
from logloom.llm.queries import piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string, id int, base string"


def frame(spark, texts):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", 1, "b") for i, t in texts], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t漢.", max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_words_and_shingles(texts, size):
    import pyarrow as pa

    for a, b, data, offsets in tk.slices(pa.array(texts), 20):
        words = tk.Words(data, offsets, lower=True)
        sets, first = tk.distinct(*tk.shingles(words, size))
        for i, t in enumerate(texts[a:b]):
            w = WORD.findall(lower(t))
            assert words.counts[i] == len(w)
            want = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
            assert first[i + 1] - first[i] == len(want)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeéthingsr  \n\t▁_01(=.漢😀ß\0")), max_size=40))
def test_pieces_equal_the_library(library, text):
    ids = library.encode(text, add_eos=True)
    assert pieces.load(piece_model()).encode(text) == (" ".join(map(str, ids)), library.decode(ids))


def test_pieces_of_long_runs(library):
    made = pieces.load(piece_model())
    for text in (" " * 100_000, "x" + " " * 100_000 + "y", " " * 99_999 + "\n" + " " * 33 + "漢", ("a" + " " * 15) * 3000, "\t" * 50_000, "ab" * 50_000, "-" * 50_000):
        ids = library.encode(text, add_eos=True)
        start = time.perf_counter()
        assert made.encode(text) == (" ".join(map(str, ids)), library.decode(ids))
        assert time.perf_counter() - start < 5
    for n in range(1, 200):
        for end in ("", "x", "the", "漢", "😀", "\n", "=="):
            ids = library.encode(" " * n + end, add_eos=True)
            assert made.encode(" " * n + end)[0] == " ".join(map(str, ids))


def test_pieces_job(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in docs] + [(-1, None), (-2, ""), (-3, "a" * 9000), (-4, " " * 50 + "x"), (-5, "twice"), (-5, "twice")]
    got = pieces.encode_texts(frame(spark, texts), piece_model()).withColumn("array", pieces.id_array(F.col("ids"))).collect()
    assert len(got) == len(texts)
    want = dict(texts)
    for r in got:
        ids = library.encode(want[r.doc_id] or "", add_eos=True)
        assert (r.array, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids))
    assert pieces.encode_texts(frame(spark, []), piece_model()).count() == 0


def invented(seed, n):
    rng = np.random.default_rng(seed)
    syllables = np.array(["th", "er", "an", "ein", "sch", "ung", "tion", "ñ", "ou", "ly", "ed", "es", "%%", "ä", ".", "漢", "q", "ing"])
    return ["".join(w) for w in rng.choice(syllables, (n, 5))]


def test_pieces_step_together():
    """Invented words cost clearly less in a text than one by one (CPU time, after other words have filled what is remembered)."""
    made, ratios = pieces.Pieces(piece_model()), []
    for seed in range(5):
        words = invented(seed, 40_000)
        start = time.process_time()
        alone = [made.ids(pieces.SPACE + w) for w in dict.fromkeys(words)]
        between = time.process_time()
        made.encode(" ".join(words))
        ratios.append((time.process_time() - between) / (between - start))
        assert len(alone) > 30_000
    assert min(ratios[1:]) < 0.8, ratios


def test_pieces_of_many_texts_equal_the_library(library, monkeypatch):
    """One slice of odd texts, with few pairs remembered and few units together."""
    import pyarrow as pa

    monkeypatch.setattr(pieces, "PAIRS", 64)
    monkeypatch.setattr(pieces, "TOGETHER", 100)
    words, rng = invented(3, 3_000), np.random.default_rng(4)
    gaps = np.array([" ", " ", " ", "  ", "\n", "\n ", " " * 20, "▁", "\t", "", "\r\n"])
    texts = ["".join(g + w for g, w in zip(rng.choice(gaps, 60), rng.choice(words, 60), strict=True)) for _ in range(200)]
    texts += [None, "", " ", "\n", "▁", "▁▁ x", "\0", "😀" * 40, " 😀  é\u0301", "漢字" * 60 + "  the", "a" * 47, " " + "a" * 48, "ab" * 80, "  " + "the" * 30, "x  ", "", None]
    made = pieces.Pieces(piece_model())
    for column in (pa.array(texts), pa.array(["cut off", *texts]).slice(1), pa.array([None, ""]), pa.array(texts[:1])):
        counts, ids, decoded = made.encode_all(column)
        want = [library.encode(t or "", add_eos=True) for t in column.to_pylist()]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.to_pylist() == [" ".join(map(str, w)) for w in want]
        assert decoded.to_pylist() == [library.decode(w) for w in want]


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))


def test_secrets(spark, sf_dir):
    hard = [
        None, "", "secret=token:abcdefg", "token=secret=abcdefgh", "token = abc token = abcdef", "😀é PassWord: 'hunter2hunter2'", "AKIA" * 6 + "x", "AKIA12 AKIA" + "A1" * 9, "ab" * 12 + "g" + "0f" * 11,
        "api_key==abcdef apikey: \"a.b-c/d\"", "secret:abc\nsecret: abcdef", "token='abcdef' token='abcdef'", "x" * 5000 + " passwd=abcdefg", "key Zq8vT1xLw0Rk7YbN3mHs5JcPf9DgUa2E end",
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    texts = [(r.doc_id, r.text) for r in docs] + [(-i - 1, t) for i, t in enumerate(hard)]
    df = frame(spark, texts)
    ratio = secrets.train(frame(spark, texts[:60]))
    found = secrets.find(df, ratio).select("doc_id", secrets.listed(F.col("base")).alias("base"), secrets.listed(F.col("spans")).alias("spans"))
    want = {i: base(t or "") for i, t in texts}
    assert {r.doc_id: r.base for r in found.collect()} == want
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert spans[-14] == "random:4:36"
    assert all(set(want[i].split(",")) - {""} <= set(spans[i].split(",")) for i in want)
    assert not any("random" in s for i, s in spans.items() if i >= 0)
    assert secrets.find(frame(spark, []), secrets.train(frame(spark, []))).count() == 0


def test_secrets_of_very_long_texts(spark):
    """Matches by the hundred thousand, and runs of a hundred thousand characters, in linear time."""
    rng = np.random.default_rng(7)
    tokens = ["".join(rng.choice(list("0123456789abcdef"), 26)) for _ in range(1000)]
    texts = [(1, "é " + " ".join(tokens * 100)), (2, "é token=abcdef1 " * 50_000), (3, "aB3x" * 50_000), (4, ("é" * 30 + " word ") * 20_000)]
    ratio = secrets.train(frame(spark, texts))
    start = time.perf_counter()
    got = secrets.find(frame(spark, texts), ratio).select("doc_id", secrets.listed(F.col("base")).alias("base"), F.size("spans").alias("n")).collect()
    assert time.perf_counter() - start < 60
    assert {r.doc_id: r.base for r in got} == {i: base(t) for i, t in texts}
    assert {r.doc_id: r.n for r in got if r.doc_id != 3} == {1: 100_000, 2: 50_000, 4: 0}


def test_added_spans_against_plain_code(spark, sf_dir):
    """All spans, restated: runs of 20 and more that touch no base span and whose ratio is high; random strings are found, identifiers are not."""
    rng = np.random.default_rng(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    ratio = secrets.train(frame(spark, docs))
    alphabet = list(secrets.ALPHABET)
    strange = ["".join(rng.choice(alphabet[:62], n)) for n in rng.integers(24, 44, 300)]
    names = [w for _, t in docs for w in re.findall("[A-Za-z]{3,9}", t or "")][:4000]
    plain = [rng.choice(["_", "-", "/", ""]).join(rng.choice(names, 6)) for _ in range(300)]
    plain = [p for p in plain if len(p) >= 20]
    texts = [(i, f"é {t} end") for i, t in enumerate([*strange, *plain])]
    texts += [(-1, "x token=" + strange[0]), (-2, strange[1] + " " + "0f" * 14 + strange[2]), (-3, f"\u0001 {strange[3]}\u0001{strange[4]}"), (-4, strange[5] + "api_key='abcdef'" + strange[6]), (-5, f"token=a1 {strange[7]}")]
    got = {r.doc_id: r.spans for r in secrets.find(frame(spark, texts), ratio).select("doc_id", secrets.listed(F.col("spans")).alias("spans")).collect()}

    def spans(text):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            at = [alphabet.index(c) for c in m[0]]
            score = sum(ratio[a * len(alphabet) + b] for a, b in zip(at[:-1], at[1:], strict=True))
            if score >= secrets.LEAST_RATIO and not any(s < m.end() and m.start() < e for s, _, e in found if _ < 3):
                found.append((m.start(), 3, m.end()))
        return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))

    assert got == {i: spans(t) for i, t in texts}
    assert sum("random" in got[i] for i in range(300)) >= 285
    assert sum("random" in got[300 + i] for i in range(len(plain))) <= 0.06 * len(plain)


def rule_counts(t):
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in docs] + [(-1, None), (-2, ""), (-3, " \n\t\n"), (-4, "a b c d e f g h " * 400), (-5, "é line\nx\né line\n x"), (-5, "é line\nx\né line\n x")]
    got = quality_rules.judged(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    want = {i: rule_counts(t or "") for i, t in texts}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    assert all(0 <= r.quality <= 1 for r in got) and next(r for r in got if r.doc_id == -4).good is False
    assert quality_rules.judged(frame(spark, [])).count() == 0


def test_votes_of_independent_rules_recover_the_truth():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.85
    votes = np.zeros((20_000, 6), int)
    for j in range(6):
        right = rng.random(20_000) < np.where(truth, 0.99, 0.5)
        votes[:, j] = np.where(rng.random(20_000) < 0.1, 0, np.where(truth == right, 2, 1))
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = quality_rules.estimate(patterns, n.astype(float))[inverse.ravel()] >= 0.5
    assert (good == truth).mean() > 0.95


def test_byte_network(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    crc = F.crc32(F.col("doc_id").cast("string"))
    net = byte_cnn.train(docs, labels, crc % 5 != 0)
    data = np.frombuffer("naïve text".encode() * 900, np.uint8)
    block, length, first = byte_cnn.chunks(data, np.array([0, 0, 10, len(data)]))
    seen = np.zeros(len(data), bool)
    for c, n in enumerate(length):
        text = np.searchsorted(first, c, side="right") - 1
        at = [0, 0, 10][text] + (c - first[text]) * byte_cnn.STEP
        seen[at : at + n] = True
        assert (block[c, :n] == data[at : at + n]).all()
    assert seen.all()
    extra = frame(spark, [(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)])
    got = [(r.doc_id, r.score) for r in byte_cnn.score(extra, net).collect()]
    assert len(got) == 4 and all(0 <= s <= 1 for _, s in got) and len({s for _, s in got}) == 2
    assert byte_cnn.good_documents(extra, net, 0.0).columns == extra.columns and byte_cnn.good_documents(extra, net, 0.0).count() == 4
    alone = byte_cnn.train(docs, labels.limit(0), crc % 5 != 0)
    assert byte_cnn.score(docs.limit(3), alone).count() == 3
    assert byte_cnn.score(frame(spark, []), net).count() == 0


def random_network(rng):
    embed = rng.normal(0, 0.5, (256, byte_cnn.EMBED))
    embed[0] = 0
    shape = (byte_cnn.WIDTH * byte_cnn.EMBED, byte_cnn.FILTERS)
    return byte_cnn.Network(embed, rng.normal(0, 0.2, shape), rng.normal(0, 0.3, byte_cnn.FILTERS), rng.normal(0, 0.5, 2 * byte_cnn.FILTERS), 0.1)


def plain_probability(net, raw):
    """The network's answer for one text, one window at a time."""
    pooled, at = [], 0
    while True:
        part = np.frombuffer(raw[at : at + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0"), np.uint8)
        seen = [net.embed[part[i : i + byte_cnn.WIDTH]].ravel() @ net.filters + net.bias for i in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)]
        pooled.append(np.maximum(np.max(seen, axis=0), 0))
        if at + byte_cnn.CHUNK >= len(raw):
            break
        at += byte_cnn.STEP
    x = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(x @ net.top + net.base)))


def packed(raw):
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_byte_network_equals_a_plain_convolution(spark):
    rng = np.random.default_rng(4)
    net = random_network(rng)
    raw = [b"", b"a", b"short text", *[bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (255, 256, 257, 480, 481, 5000)]]
    assert np.allclose(byte_cnn.probabilities(net, *packed(raw)), [plain_probability(net, r) for r in raw])
    texts = [(i, "é漢 text" * i) for i in range(90)] + [(90, None)]
    got = {r.doc_id: r.score for r in byte_cnn.score(frame(spark, texts), net).collect()}
    assert np.allclose([got[i] for i, _ in texts], [plain_probability(net, (t or "").encode()) for _, t in texts])


def test_byte_network_gradients_equal_differences():
    rng = np.random.default_rng(5)
    net = random_network(rng)
    raw = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (40, 300, 900, 2000)]
    y = np.array([0, 1, 1, 0], np.float32)
    block, _, first = byte_cnn.chunks(*packed(raw))
    got = byte_cnn.gradients(net, block, first, y)

    def loss(**change):
        p = byte_cnn.probabilities(byte_cnn.Network(**(net.__dict__ | change)), *packed(raw))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in ("filters", "bias", "top", "embed"):
        value = getattr(net, name)
        for at in rng.choice(value.size, 12, replace=False):
            if name == "embed" and at < byte_cnn.EMBED:
                continue  # the filling stays
            up, down = value.copy(), value.copy()
            up.ravel()[at] += 1e-5
            down.ravel()[at] -= 1e-5
            want = (loss(**{name: up}) - loss(**{name: down})) / 2e-5
            assert abs(got[name].ravel()[at] - want) < 1e-4 + 1e-3 * abs(want)


def test_byte_network_learns():
    rng = np.random.default_rng(1)
    plain = [" ".join("".join(rng.choice(list("etaoin"), 5)) for _ in range(60)) for _ in range(240)]
    texts = [t if i % 4 else re.sub(" ", "### ", t) for i, t in enumerate(plain)]
    net = byte_cnn.fit([t.encode() for t in texts[:180]], np.array([int(bool(i % 4)) for i in range(180)]), rounds=30)
    raw = [t.encode() for t in texts[180:]]
    score = byte_cnn.probabilities(net, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert ((score >= 0.5) == np.array([bool(i % 4) for i in range(180, 240)])).mean() >= 0.9


def dense_scores(texts, labels, chosen):
    """(scores, neighbours) by dense cosine over all words of the examples, restated plainly."""
    words = [collections.Counter(re.findall("[0-9a-z\x80-\U0010ffff]+", lower(t or ""))) for t in texts]
    vocabulary = sorted(w for w in {w for e in chosen for w in words[e]} if sum(w in c for c in words) >= 2)
    share = np.mean([labels[e] for e in chosen])
    idf, gain = [], []
    for w in vocabulary:
        have = [labels[e] for e in chosen if w in words[e]]
        s = (sum(have) + share) / (len(have) + 1)
        gain.append(max(len(have) * (s * np.log(s / share) + (1 - s) * np.log((1 - s) / (1 - share))), 1e-9))
        idf.append(np.log((len(texts) + 1) / (sum(w in c for c in words) + 1)) + 1)
    table = np.array([[(1 + np.log(c[w])) * idf[j] if w in c else 0.0 for j, w in enumerate(vocabulary)] for c in words])
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
    gain = np.array(gain) / np.mean((table[chosen] ** 2 * gain).sum(axis=1))
    similar, weight = (table @ table[chosen].T).round(12), (table * gain) @ table[chosen].T
    prior = (sum(labels[e] for e in chosen) + 0.5) / (len(chosen) + 5)

    def voted(i, but):
        near = [k for s, k in sorted((-s, k) for k, s in enumerate(similar[i]) if s > 0) if chosen[k] != but][: toxicity.NEIGHBOURS]
        ones = sum(weight[i, k] * labels[chosen[k]] for k in near) + toxicity.PRIOR_WEIGHT * prior
        return ones / (sum(weight[i, k] for k in near) + toxicity.PRIOR_WEIGHT), [chosen[k] for k in near]

    scale = toxicity.rising(np.array([voted(e, e)[0] for e in chosen]), np.array([labels[e] for e in chosen], float))
    all_ = [voted(i, None) for i in range(len(texts))]
    return np.interp([s for s, _ in all_], *scale), [near for _, near in all_]


def test_neighbours_and_scores_equal_a_dense_cosine(spark):
    rng = np.random.default_rng(2)
    words = ["w" + str(i) for i in range(300)]
    often = np.array([1 / (1 + i) for i in range(300)])
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=often / often.sum())) + (" É!" if i % 7 == 0 else "") for i in range(600)]
    labels = {i: int("w9" in texts[i].split() or rng.random() < 0.1) for i in range(0, 600, 2)}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(frame(spark, list(enumerate(texts))), table, F.lit(True)).collect()}
    sets = [np.array(sorted(hash(x) for x in {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}), np.int64) for w in (lower(texts[i]).split() for i in sorted(labels))]
    chosen = [sorted(labels)[k] for k in toxicity.without_near_copies(sets, np.array([labels[i] for i in sorted(labels)]))]
    assert len(chosen) > 6 * toxicity.BLOCK
    scores, near = dense_scores(texts, labels, chosen)
    assert [got[i].evidence for i in range(600)] == near
    assert np.allclose([got[i].score for i in range(600)], scores, atol=1e-4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1)), min_size=1, max_size=40))
def test_pooled_shares_rise_as_they_must(rows):
    """Against the max-min form of a rising fit."""
    share, labels = (np.array(v, float) for v in zip(*sorted(rows), strict=True))
    shares, parts = toxicity.rising(share, labels)
    n = len(share)
    want = [max(min(labels[a:b].mean() for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
    pools = [np.flatnonzero(np.array(want) == w) for w in sorted(set(want))]
    assert np.allclose(shares, [share[p].mean() for p in pools])
    assert np.allclose(parts, np.maximum.accumulate([(labels[p].sum() + 0.5) / (len(p) + 1) for p in pools]))


def test_near_copies_of_examples_by_full_sets():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 400, 60)) for _ in range(12)]
    sets = [np.unique(np.concatenate([rng.choice(b, int(len(b) * rng.uniform(0.86, 1)), replace=False), rng.integers(0, 400, rng.integers(0, 9))])) for b in base for _ in range(12)]
    sets += [np.zeros(0, np.int64)] * 2
    labels = rng.integers(0, 2, len(sets))
    want = []
    for i, s in enumerate(sets):
        alike = lambda j: labels[i] == labels[j] and len(s) and 100 * len(np.intersect1d(s, sets[j])) >= 80 * len(np.union1d(s, sets[j]))  # noqa: B023, E731
        if not any(alike(j) for j in want):
            want.append(i)
    assert toxicity.without_near_copies(sets, labels).tolist() == want and len(sets) // 4 < len(want) < len(sets) - 20


def test_samples_are_bounded_in_bytes(spark):
    docs = frame(spark, [(i, "é" * (1 + i % 7)) for i in range(60)] + [(60, None), (61, "x" * 10_000), (5, "é"), (None, "n")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(5, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    every = {r.id: (r.label, r.text) for r in sampling.labelled(docs, labels, F.lit(True), "toxic", 100).collect()}
    assert len(every) == 62 and every[5] == (1, "é" * 6) and every[60] == (0, "") and len(every[61][1]) == 10_000
    small = {r.id: (r.label, r.text) for r in sampling.labelled(docs, labels, F.lit(True), "toxic", 100, 300).collect()}
    assert sum(len(t.encode()) for _, t in small.values()) <= 300 < sum(len(t.encode()) for _, t in small.values()) + 15
    assert all(every[i] == r for i, r in small.items()) and 61 not in small
    assert sampling.labelled(docs, labels, F.lit(True), "toxic", 7).count() == 7
    net = byte_cnn.train(docs.withColumn("text", F.repeat("text", 50)), labels, F.lit(True), "toxic", sample_bytes=5_000)
    assert byte_cnn.score(docs, net).count() == 64


def test_toxicity(spark):
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "table"]
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(words, 40)) + (" nastyword" + str(i) if i % 4 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    df = frame(spark, texts + [(-1, None), (-2, ""), (-3, "nastyword nastyother"), (-3, "nastyword nastyother")])
    got = {r.doc_id: r.score for r in toxicity.scored(df, labels, F.lit(True)).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(240)) and got[-1] == got[-2] < 0.3 <= got[-3]
    prior = toxicity.scored(df, labels.limit(0), F.lit(True))
    assert prior.count() == 244 and prior.select("score").distinct().count() == 1
    assert toxicity.scored(frame(spark, []), labels, F.lit(True)).count() == 0


def test_lines(spark):
    menu = "Home | About"
    rows = [(i, f"site{i % 2}", f"{menu}\nown text {i}\n \n" if i % 2 else f"own text {i}\n{menu if i < 4 else ''}") for i in range(60)]
    rows += [(100, None, "a"), (101, "site1", None), (102, "site1", ""), (103, "site1", rows[1][2]), (103, "site1", rows[1][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, host string, pages int")
    got = collections.Counter((r.doc_id, r.text, r.n_dropped) for r in line_dedup.without_boilerplate(df).collect())
    want = collections.Counter()
    for i, s, t in rows:
        drop = s == "site1" and t is not None
        want[i, "\n".join(x for x in t.split("\n") if not drop or x != menu) if t is not None else None, t.split("\n").count(menu) if drop else 0] += 1
    assert got == want
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0
    clash = ["row", "bad", "here", "clean", "lines", "_bad", "_host", "_clean", "line_hash"]
    odd = df.select("*", *[F.lit(c).alias(c) for c in clash], F.lit("x").alias("n_lines"), F.lit("x").alias("n_dropped"), F.lit(2).alias("a.b"))
    made = line_dedup.without_boilerplate(odd)
    assert made.columns == [*df.columns, *clash, "a.b", "n_lines", "n_dropped"]
    assert collections.Counter((r.doc_id, r.text, r.n_dropped) for r in made.collect()) == want and {tuple(r[c] for c in clash) for r in made.collect()} == {tuple(clash)}
