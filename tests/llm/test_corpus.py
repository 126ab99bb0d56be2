"""Operators across documents: near-duplicates, shards, passages, leaks, and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from logloom.llm import byte_cnn, decontamination, graph, line_dedup, near_dedup, queries, sharding, substring_dedup
from logloom.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id int, n string, label int, mark long, part string"
RNG = np.random.default_rng(5)
VOCABULARY = ["w" + "".join(RNG.choice(list("bcdfgh"), 5)) for _ in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", 2, 3, "p") for i, t in rows], SCHEMA)


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def edited(text, n):
    w = text.split()
    for at in RNG.choice(len(w), n, replace=False):
        w[at] = "edit" + str(RNG.integers(1 << 30))
    return " ".join(w)


def shingle_set(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, size, share=(80, 100)):
    sets = [shingle_set(t, size) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if share[1] * common >= share[0] * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 3)] + [(500, 501 + i) for i in range(30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100} | {500 + i: 500 for i in range(31)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = []
    for g in range(12):
        base = prose(int(RNG.integers(20, 120)))
        rows += [(len(rows), base)] + [(len(rows) + 1 + k, edited(base, int(RNG.integers(0, 3)))) for k in range(g % 5)]
    rows += [(len(rows) + k, prose(60)) for k in range(40)]
    crowd = prose(200)
    rows += [(1000 + k, edited(crowd, 3)) for k in range(60)] + [(2000 + k, crowd) for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "One TWO"), (3005, "one"), (3006, prose(20_000)), (None, crowd), (3007, crowd.upper()), (2000, crowd)]
    got = near_dedup.near_duplicates(frame(spark, rows), size).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, size)
    sizes = {i: len(shingle_set(t, size)) for i, t in rows}
    for r in got:
        assert r.n_shingles == sizes[r.doc_id]
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    stay = near_dedup.without_near_duplicates(frame(spark, rows), size)
    assert collections.Counter(r.doc_id for r in stay.collect()) == collections.Counter({*[i for i, c in want.items() if i == c], None})
    assert near_dedup.near_duplicates(frame(spark, []), size).count() == 0


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 150])
def test_links_hidden_in_a_crowd(spark, block):
    """Edits of one text at a Jaccard similarity of 0.7, too many to be all neighbours, among them copies above 0.8: no link may be lost."""
    crowd = prose(200)
    rows = [(i, edited(crowd, 5)) for i in range(900)]
    rows += [(1000 + i, edited(t, 5)) for i, t in rows[:300]]
    got = near_dedup.near_duplicates(frame(spark, rows), 4, block=block).collect()
    want = brute_components(rows, 4)
    assert len(set(want.values())) > 500 and all(want[1000 + i] < 1000 for i in range(300))
    assert {r.doc_id: r.component_id for r in got} == want


def test_rows_of_one_id(spark):
    """Of rows that share an id the least text stays, then the lowest hash of the rest, in whatever order they come."""
    a, b = prose(40), prose(40)
    rows = [(1, max(a, b), "x", {"k": 1}), (1, min(a, b), "y", {"k": 2}), (1, min(a, b), "z", {"k": 2}), (2, None, "x", None), (2, a, "x", None), (3, a, "v", None), (None, a, "x", None), (None, b, "x", None)]
    schema = "doc_id long, text string, rank string, row map<string,int>"
    kept = []
    for order in (rows, rows[::-1]):
        stay = near_dedup.without_near_duplicates(spark.createDataFrame(order, schema).repartition(3, "rank"))
        assert stay.columns == ["doc_id", "text", "rank", "row"]
        kept.append(sorted(((r.doc_id or 0, r.text, r["rank"]) for r in stay.collect()), key=str))
    assert kept[0] == kept[1]
    assert [(i, t) for i, t, _ in kept[0] if i == 1] == [(1, min(a, b))] and kept[0].count((0, a, "x")) == kept[0].count((0, b, "x")) == 1


def test_near_copies_of_very_long_texts(spark):
    def text(i):
        words = np.random.default_rng(i % 30).integers(0, 1 << 20, 300_000)
        if i >= 30:
            words[np.random.default_rng(i).choice(300_000, 4000, replace=False)] = (1 << 20) + i
        return " ".join(map(str, words.tolist()))

    made = spark.range(0, 60, 1, 8).mapInPandas(lambda frames: (f.assign(doc_id=f["id"], text=f["id"].map(text))[["doc_id", "text"]] for f in frames), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(made).collect()}
    assert got == {i: i % 30 for i in range(60)}


def test_shards(spark):
    copy = prose(30)
    rows = [(i, copy if i % 3 == 0 else prose(20) + "\n" + VOCABULARY[i % 7] * 3 if i % 5 else None) for i in range(500)] + [(7, "twice"), (7, "twice"), (None, "é")]
    got = sharding.balanced_shards(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    assert sharding.balanced_shards(frame(spark, [])).count() == 0
    assert sharding.balanced_shards(frame(spark, rows[:3])).select("shard").distinct().count() == 3


def cut_share(texts, shard):
    """The share of pairs of documents with a line in common (held by 2 to 200 texts) that are in different shards."""
    holders = collections.defaultdict(set)
    for i, t in texts:
        for line in set((t or "").split("\n")) - {""}:
            holders[line].add(i)
    pairs = {(a, b) for h in holders.values() if 2 <= len(h) <= 200 for a in h for b in h if a < b}
    return sum(shard[a] != shard[b] for a, b in pairs) / max(len(pairs), 1)


def test_linked_documents_meet(spark):
    lines = [prose(12) for _ in range(480)]
    rows = [(i, "\n".join(lines[i // 10 * 4 : i // 10 * 4 + 4]) + f"\nown {i}") for i in range(1200)]
    order = RNG.permutation(1200).tolist()
    got = {r.doc_id: r.shard for r in sharding.balanced_shards(frame(spark, [rows[i] for i in order]), 12).collect()}
    assert cut_share(rows, got) < 0.05


def test_shards_cut_few_links(spark):
    """Of documents that share one line each with four neighbours, and one that all have, most links stay whole; few rows leave the shard they want."""
    line = [prose(8) for _ in range(3000)]
    rows = [(i, "\n".join(["all have this", *[line[(i + k) % 3000] for k in (0, 1, 2)], *[prose(6) for _ in range(12)]])) for i in range(3000)]
    start = {r.doc_id: r.shard for r in sharding.balanced_shards(frame(spark, rows), 12, rounds=0).collect()}
    got = sharding.balanced_shards(frame(spark, rows), 12).collect()
    after = cut_share(rows, {r.doc_id: r.shard for r in got})
    assert after < 0.8 * cut_share(rows, start) and cut_share(rows, {i: i * 7919 % 12 for i, _ in rows}) > 0.85
    assert sum(r.wanted != r.shard for r in got) < 0.05 * len(got)
    by = collections.Counter(r.shard for r in got)
    assert max(by.values()) - min(by.values()) <= 1


def test_passages(spark):
    def text(n):
        return " ".join(prose(int(RNG.integers(6, 14))).capitalize() + "." for _ in range(n))

    passage, near = text(9), text(9)
    rows = [(i, text(30)) for i in range(60)]
    rows += [(100 + k, f"{text(5)} cut {passage} tail {text(6)}") for k in range(5)]
    rows += [(200 + k, text(4) + " " + edited(near, 1) + " " + text(4)) for k in range(3)]
    rows += [(300, None), (301, ""), (302, "short."), (None, passage), (303, prose(3000)), (304, text(3) + text(12) * 2), (400, rows[0][1]), (401, rows[1][1]), (401, rows[1][1])]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    flagged = {r.doc_id for r in got}
    assert {100, 101, 102, 103, 104, 200, 201, 202, 0, 400, 1, 401} == flagged
    inside = [r for r in got if r.doc_id in range(100, 105)]
    assert all(r.first_id == 100 and r.copies == 5 and r.kept == (r.doc_id == 100) for r in inside)
    for r in inside:
        w = WORD.findall(dict(rows)[r.doc_id])
        assert len(set(w[r.start : r.end]) & set(passage.split())) >= 0.6 * len(set(passage.split()))
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0
    bands, hashes = substring_dedup.bands(0.99, 0.8, 2)
    assert 1 - (1 - 0.8**hashes) ** bands >= 0.99 > 1 - (1 - 0.8**hashes) ** (bands - 1)


@pytest.mark.parametrize("block", [1000, 40])
def test_near_paragraphs_in_a_crowd(spark, block):
    """Sentences at a Jaccard similarity of 0.5, among them pairs at 0.8: buckets are crowded, and no pair may be lost to it."""
    rng = np.random.default_rng(block)
    notice = rng.choice(VOCABULARY, 10).tolist()
    rows = []
    for k in range(900):
        own = notice + rng.choice(VOCABULARY, 3).tolist()
        rows.append((k, " ".join(own) + "."))
        if k % 3 == 0:  # the last word differs
            rows.append((1000 + k, " ".join(own[:12] + rng.choice(VOCABULARY, 1).tolist()) + "."))
    got = substring_dedup.repeated_passages(frame(spark, rows), least_words=8, block=block).collect()
    of = {r.doc_id: r.component for r in got}
    want = brute_components(rows, 5)
    assert all(want[1000 + k] == want[k] for k in range(0, 900, 3))
    assert sum(1000 + k in of and of.get(k) == of[1000 + k] for k in range(0, 900, 3)) >= 0.99 * 300
    assert all(len({want[i] for i in of if of[i] == c}) == 1 for c in set(of.values()))


def shuffled_bytes(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("map_bits", [substring_dedup.MAP_BITS, 1])
def test_disk_of_passages(spark, map_bits):
    """Paragraphs that meet no other are not dealt out with their words, and tables that the result doesn't read are deleted."""
    from logloom import store

    rng = np.random.default_rng(11)
    rows = [(k, " ".join(rng.choice(VOCABULARY, 1500))) for k in range(200)]
    rows += [(1000 + k, " ".join(rng.choice(VOCABULARY, 50).tolist() + rows[k][1].split()[300:400])) for k in range(20)]
    before, tables = shuffled_bytes(spark), len(store._written.get(spark.sparkContext.applicationId, []))
    docs = frame(spark, rows).repartition(4)
    got = substring_dedup.repeated_passages(docs, map_bits=map_bits).collect()
    assert {r.first_id for r in got} == set(range(20)) == {r.doc_id for r in got if r.kept} and len(got) == 40
    grown = shuffled_bytes(spark) - before - sum(len(t) for _, t in rows)  # as the texts are dealt out
    assert map_bits == 1 or grown < 0.5 * sum(len(t) for _, t in rows)
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in store._written[spark.sparkContext.applicationId][tables:]}
    assert left == {"edges", "classed", "spread"}


def test_packed_codes():
    codes = np.unique(RNG.integers(0, 1 << 56, 5000, dtype=np.uint64))
    packed = substring_dedup._packed(codes)
    assert len(packed) == 7 * len(codes) and (substring_dedup._unpacked(packed) == codes).all()


@pytest.mark.parametrize("stops", [True, False])
def test_passages_pasted_anywhere(spark, stops):
    """Passages of 52 words cut out of prose at any word and pasted at any word of two texts."""
    rng = np.random.default_rng(6)

    def text(n):
        w = rng.choice(VOCABULARY, n).tolist()
        at = 0
        while stops and (at := at + int(rng.integers(4, 20))) < n:
            w[at - 1] += "."
        return w

    rows = []
    for k in range(200):
        passage = text(150)[40:92]
        for copy in (0, 1000):
            host, at = text(120), int(rng.integers(10, 100))
            rows.append((copy + k, " ".join(host[:at] + passage + host[at:])))
    first = {r.doc_id: r.first_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert sum(first.get(1000 + k) == k for k in range(200)) >= 190
    assert all(first[i] == i % 1000 for i in first)


def test_passages_against_brute_force(spark, sf_dir):
    """Links, components and passages of the whole query, restated plainly."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    import pyarrow as pa

    ids, units = [i for i, _ in docs], []
    for a, _, data, offsets in tk.slices(pa.array([t for _, t in docs])):
        words = tk.Words(data, offsets, lower=True)
        for t, s, e in zip(*substring_dedup.paragraphs(words), strict=True):
            w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), docs[a + t][1]))
            units.append((ids[a + t], int(s - words.first[t]), int(e - words.first[t]), tuple(w[s - words.first[t] : e - words.first[t]])))
    classes = sorted({u[3] for u in units})
    of = brute_components([(i, " ".join(c)) for i, c in enumerate(classes)], 5)
    of = {c: of[i] for i, c in enumerate(classes)}
    holders = collections.defaultdict(set)
    for i, _, _, c in units:
        holders[of[c]].add(i)
    want = set()
    for doc in ids:
        mine = sorted((s, e) for i, s, e, c in units if i == doc and len(holders[of[c]]) > 1)
        run = []
        for s, e in [*mine, (1 << 40, 0)]:
            if run and s - max(x for _, x in run) > substring_dedup.GAP:
                covered = {p for x, y in run for p in range(x, y)}
                if len(covered) >= 20:
                    want.add((doc, run[0][0], max(x for _, x in run), len(covered)))
                run = []
            run.append((s, e))
    assert {(r.doc_id, r.start, r.end, r.n_repeated) for r in queries.op7_substring_dedup(spark, sf_dir).collect()} == want


ITEMS = [(1, "If Mary has 12 apples and Mary eats 5 of them how many are left"), (2, "short one"), (3, "Tiny item here now"), (4, "The train needs 3 hours for 240 km so how fast does the train go"), (5, None), (6, "")]


def test_leaks(spark):
    docs = [
        (1, "So, if Anna has 30 apples and Anna eats 7 of them how many are left? Bye"), (2, "Well if Anna has 30 apples and Bob eats 7 of them how many are left"), (3, "Well if Mary has 12 apples and Mary eats 5 of them how many are left"),
        (4, "big tiny item here now x"), (5, None), (6, ""), (7, "The train needs 7 hours for 560 miles so how fast does the train go"), (8, "the train needs rest and the train does go so fast"), (None, "tiny item here now"),
        (9, prose(20_000) + " The train needs 3 hours for 240 km so how fast does the train go " + prose(20)), (9, "x"), (10, "12 5 30 7 12 5 30 7 12 5 30 7 12 5"),
    ]
    items = spark.createDataFrame([(i, t, "w", "s") for i, t in ITEMS], "item_id long, text string, window string, shape string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.leaks(frame(spark, docs), items).collect()}
    assert got == {(1, 1): "template", (3, 1): "verbatim", (4, 3): "verbatim", (7, 4): "template", (9, 4): "verbatim", (None, 3): "verbatim"}
    clean = decontamination.without_leaks(frame(spark, docs), items)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2, 5, 6, 8, 10] and clean.columns == frame(spark, docs).columns
    assert decontamination.leaks(frame(spark, docs), items.limit(0)).count() == 0
    assert decontamination.leaks(frame(spark, []), items).count() == 0


def test_changed_questions(spark):
    """Other numbers, names (also at the start of a sentence) and units are found, by either join; other questions are not."""
    rng = np.random.default_rng(9)
    people = ["Tom", "Anna", "Bob", "Mary", "Igor", "Lena"]
    asks = ["{a} has {x} pens. {a} buys {y} pens. {a} sells {z} pens. {a} wants how many?", "The shop of {a} sold {x} kg of rice and {y} kg of corn to {b}. How much is left if {b} brings {z} kg back?", "{a} runs {x} km in {y} hours and then {b} walks {z} km. How long does {b} need?"]

    def asked(i, unit="km"):
        a, b = rng.choice(people, 2, replace=False)
        x, y, z = rng.choice(900, 3, replace=False) + 10
        return asks[i].format(a=a, b=b, x=x, y=y, z=z).replace("km", unit)

    items = [(i, asked(i)) for i in range(3)]
    docs = [(k, f"{prose(30)}. {asked(k % 3, ['km', 'miles'][k % 2])} {prose(30)}") for k in range(90)]
    docs += [(500 + k, prose(40) + ". " + rng.choice(people) + " has many pens and " + rng.choice(people) + " buys none.") for k in range(30)]
    docs += [(600, "Tom has 5 pens. Anna buys 3 pens. Bob sells 2 pens. Mary wants how many?")]  # names that one name stands for
    inserted = items[1][1].split()
    docs += [(601, " ".join([*inserted[:9], "really", *inserted[9:]]))]
    table = spark.createDataFrame([*items, (7, items[0][1])], "item_id long, text string")
    for limit in (10_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), table, broadcast_windows=limit).collect()}
        assert got == {(k, k % 3) for k in range(90)} | {(k, 7) for k in range(0, 90, 3)} | {(601, 1)}


def test_a_sentence_of_many_items_in_many_documents(spark):
    """Items of a class are listed once, whichever join is used; rows and ids are those of all pairs."""
    rng = np.random.default_rng(4)
    shared = "the committee found that green copper pipes under old harbours rarely bend when frozen twice"
    noise = lambda n: " ".join("".join(rng.choice(list("bcdfgklmnprst"), 6)) for _ in range(n))
    items = spark.createDataFrame([(i, f"{noise(9)} {shared} {noise(int(rng.integers(3, 12)))}") for i in range(300)], "item_id long, text string")
    docs = [(k, f"{noise(30)} {shared} {noise(30)}") for k in range(2, 202)] + [(0, f"{noise(9)} {shared.replace('frozen', 'heated')} {noise(9)}"), (1, shared + " x " + shared), (202, noise(60)), (None, shared), (None, f"{noise(3)} {shared}")]
    pairs = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), items).collect()}
    assert pairs == {(d, i) for d, t in docs if d != 202 for i in range(300)}
    for limit in (10_000, 0):
        rows = decontamination.leaks_by_class(frame(spark, docs), items, broadcast_windows=limit).collect()
        listed = {}
        for r in rows:
            listed.setdefault(r["class"], set()).add(r.item_id)
        assert {(r.doc_id, i) for r in rows for i in listed[r["class"]]} == pairs
        assert {r.n_passages for r in rows} == {300} and len(rows) < 300 * 5 + len(docs)
        assert all((r["rank"] == 1) or r.doc_id == r.same_as for r in rows) and {r.same_as for r in rows} == {0, 1, 2}
    small = [(k, t) for k, t in docs if k is None or k < 9]
    want = {r.doc_id for r in decontamination.leaks(frame(spark, small), items).collect()} - {None}
    left = [r.doc_id for r in decontamination.without_leaks(frame(spark, [*small, (202, docs[-3][1])]), items).collect()]
    assert want == {0, 1, *range(2, 9)} and sorted(x or -1 for x in left) == [-1, -1, 202]


def test_names_of_a_text_by_plain_code(spark):
    """First words of sentences are settled as said, in a text of some thousand names too."""
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("abcdefgh"), 4)).capitalize() for _ in range(6_000)]
    text = "\n".join(f"{a} meets {b} and {c.lower()}." for a, b, c in zip(made[:2_000], made[2_000:4_000], made[4_000:], strict=True))
    tokens, got = spark.createDataFrame([(text,)], "text string").select(decontamination.words(F.col("text")).alias("t")).select("t", decontamination.named(F.col("t"))).first()
    firsts, inside, plain = ([t[2:] for t in tokens if t.startswith("0q")], {t[2:] for t in tokens if t.startswith("0p")}, set(tokens))
    often = {t for t in firsts if firsts.count(t) > 1} - plain
    names = (set(firsts) & inside) | often
    assert got == [t if not t.startswith("0q") else ("0p" + t[2:] if t[2:] in names else t[2:]) for t in tokens]
    assert names and often and len(names) < len(set(firsts))


def test_leaks_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    windows = {tuple(w[k : k + 8]) for w in (words(r.text) for r in items) for k in range(len(w) - 7)}
    want = {r.doc_id for r in docs for w in [words(r.text)] if sum(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7)) >= 3}
    assert {r.doc_id for r in queries.op8_decontamination(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    cell = lambda r: tuple(str(x) for x in r)
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(cell, got[columns].values.tolist())) == sorted(map(cell, want[columns].values.tolist()))


def test_every_operator_is_registered(spark, sf_dir):
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert [k for k in names if k.startswith(f"op{n}_")]
    assert "pipeline" in names
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_sharding", "op6_toxicity", "op10_quality_classifier"):
        assert names[name](spark, sf_dir).count() == total


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on what the stage before kept."""
    import sentencepiece

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.keep(stage(spark, docs, sf_dir), name)
        rows = after.collect()
        if name == "quality_classifier":
            net = byte_cnn.train(docs, queries.table(spark, sf_dir, "labels"), queries.remainder(5) != 0)
            good = {r.doc_id for r in byte_cnn.score(docs, net).where("score >= 0.3").collect()}
            assert {r.doc_id for r in rows} == good
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in line_dedup.without_boilerplate(docs).collect()}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "minhash_near_dedup":
            want = brute_components([(r.doc_id, r.text) for r in before], 5)
            assert {r.doc_id for r in rows} == {i for i, c in want.items() if i == c}
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontamination.leaks(docs, queries.table(spark, sf_dir, "benchmark")).collect()}
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} - bad
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
            assert {r.doc_id: r.ids for r in rows} == {r.doc_id: " ".join(map(str, library.encode(r.text or "", add_eos=True))) for r in before}
        if name != "sentencepiece":
            assert after.columns == columns
        docs, before = after, rows
