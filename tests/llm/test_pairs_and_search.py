"""Jaccard join, decontamination and top-k search against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, jaccard_join, topk
from quarryline.llm.graph import components


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, percent=75):
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Copies, edited copies of all degrees, chains of edits, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 500}"
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 140))]
        docs += [base] * rng.randrange(1, 4)
        docs += [edited(rng, base, rng.randrange(0, 9)) for _ in range(rng.randrange(0, 9))]
        chain = base
        for _ in range(3):
            chain = edited(rng, chain, 2)
            docs.append(chain)
        docs.append(base[:20] + passage + base[40:])
        docs.append(base + [word() for _ in range(rng.randrange(40))])
    docs += [passage, passage[:4], passage[:4], passage[:5], ["A"], ["a"], []]
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(len(docs), None)]


@pytest.mark.parametrize("seed, list_bits", [(1, 20), (2, 1)])
def test_components_by_brute_force(spark, seed, list_bits):
    docs = corpus(seed)
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, cls int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, sketch_bits=10, list_bits=list_bits).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("list_bits, percent", [(20, 75), (2, 75), (3, 50), (20, 100)])
def test_lists_of_many_components(spark, monkeypatch, list_bits, percent):
    """Short texts that share a passage with strangers, and copies beside them: lists are dealt into blocks, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "_LIST_BLOCK", 3)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(9)]
    docs = [passage + [f"u{i}a", f"u{i}b"] for i in range(40)] + [passage + [f"u{i}a"] for i in range(20)] + [passage] * 2
    docs += [edited(rng, [f"z{i}" for i in range(80)], n) + passage for n in (0, 1, 1, 2, 3)]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), sketch_bits=6, list_bits=list_bits, percent=percent).collect()}
    assert got == brute(docs, percent)


def test_real_documents_by_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == brute(docs)


def test_join_of_odd_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 0, None), (9, 0, 9)], key=repr)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def weighted(doc, item, items):
    """Similarity of the best window, the slow way."""
    sets = [shingle_set(t) for t in items if (t or "").split()]
    df = defaultdict(int)
    for s in sets:
        for x in s:
            df[x] += 1
    weight = lambda x: decontaminate.weigh(len(sets), df.get(x, 1))
    w, v = doc.encode().lower().split(), item.encode().lower().split()
    k = min(5, len(v))

    def bag(words):
        out = defaultdict(int)
        for i in range(len(words) - k + 1):
            s = tuple(words[i : i + k])
            out[s] += weight(s)
        return out

    b, best = bag(v), 0.0
    for s in range(len(w) - len(v) + 1):
        a = bag(w[s : s + len(v)])
        both = sum(min(x, b[h]) for h, x in a.items() if h in b)
        best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
    return best


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    items = [" ".join(word() for _ in range(n)) for n in (3, 12, 20, 20, 35)] + ["", "  "]
    docs = []
    for i, t in enumerate(items[:5]):
        filler = [word() for _ in range(30)]
        docs.append(" ".join(filler[:10] + t.upper().split() + filler[10:]))
        docs.append(" ".join(filler[:7] + edited(rng, t.split(), 1 + i % 2) + filler[7:]))
    docs += ["", " ".join(word() for _ in range(80)), items[3]]
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)] + [(99, None, 5)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(d, b).collect()}
    want = {(i, j): round(s, 9) for i, t in enumerate(docs) for j, q in enumerate(items[:5]) if (s := weighted(t, q, items)) >= 0.75}
    assert got == want
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0


def test_leaks_do_not_depend_on_waves(spark):
    """Items that share shingles, so that weights over one wave's items would differ from those over all."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(12)]
    items = [" ".join([f"w{rng.randrange(200)}" for _ in range(rng.randrange(8, 30))] + passage[: rng.randrange(13)]) for _ in range(40)]
    docs = [" ".join(["x"] * 5 + edited(rng, t.split(), n) + ["y"] * 5) for t in items for n in (0, 1, 2)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [sorted(map(tuple, decontaminate.find_leaks(d, b, wave_items=n).collect())) for n in (4096, 20, 5, 1)]
    assert len(got[0]) >= 40 and all(x == got[0] for x in got[1:])


def test_rare_shingles_weigh_alike():
    assert decontaminate.weigh(10**6, 1) == decontaminate.weigh(10**6, 1000) > decontaminate.weigh(10**6, 1200)


def test_recall_of_the_radius():
    """Of planted windows between 0.75 and 0.85, at most 1 in 100 lies beyond the radius; in a very long text too."""
    rng = np.random.default_rng(17)
    n, near, beyond, worst = 59, 0, 0, 0
    for _ in range(3000):
        base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        k = int(rng.integers(1, 5))
        other = base.copy()
        at = int(rng.integers(0, n - 5 * 1))
        other[at : at + 2 * k] = rng.integers(0, 1 << 62, len(other[at : at + 2 * k]), dtype=np.uint64)
        both = len(np.intersect1d(base, other))
        if not 0.75 <= both / (2 * n - both) <= 0.85:
            continue
        weights = np.full(n, 16)
        distance = (decontaminate.simhash(base, weights) ^ decontaminate.simhash(other, weights)).bit_count()
        near, beyond, worst = near + 1, beyond + (distance > 19), max(worst, distance)
    assert near > 500 and beyond <= near / 100, (near, beyond, worst)


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(9)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (15, 30, 59, 4)]
    docs = [" ".join(t.split()[a : len(t.split()) - z]) for t in items for a, z in ((0, 1), (1, 0), (1, 2), (9, 4))] + ["", "w1"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in decontaminate.find_leaks(d, b).collect()}
    want = {}
    for i, t in enumerate(docs):
        for j, q in enumerate(items):
            s, k = shingle_set(t, min(5, len(q.split()))), shingle_set(q, min(5, len(q.split())))
            # all shingles are in one item, so they weigh the same
            if s and 100 * len(s & k) >= 75 * len(s | k):
                want[i, j] = (round(len(s & k) / len(s | k), 9), 0, len(t.split()))
    assert got == want and {(0, 0), (1, 0), (4, 1), (8, 2), (10, 2)} <= set(got)


def test_very_long_texts(spark):
    """Megabytes in one word, and in many: leaks at the very end are found, and copies meet."""
    rng = random.Random(3)
    item = " ".join(f"item{i}" for i in range(20))
    many = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    docs = [("x" * 3_000_000 + " " + item), (many + " " + item), "x" * 3_000_000, many + " " + item]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.start_word, r.similarity) for r in decontaminate.find_leaks(d, b).collect()) == [(0, 1, 1.0), (1, 400_000, 1.0), (3, 400_000, 1.0)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(d).collect()}
    assert got == {0: (17, 0), 1: (400_016, 1), 2: (1, 2), 3: (400_016, 1)}


@pytest.mark.parametrize("wave_bytes", [1 << 20, 200, 1])
def test_repeated_queries(spark, wave_bytes):
    """Rows of one id: each distinct vector is a query, in whatever waves; a repeated candidate counts as often as it appears."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [-1.0, -1.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [2.0, 2.5]), (3, [-4.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, k=4, scale=1, wave_bytes=wave_bytes).collect())
    scores = sorted((-(int(np.floor(a)) * int(np.floor(x)) + int(np.floor(b)) * int(np.floor(y))), i) for a, b in {(1.0, 0.0), (0.0, 1.0), (-1.0, -1.0)} for i, (x, y) in rows if i)[:4]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_multi_index_misses_nothing():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flip = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 25), replace=False)) for _ in range(400)], dtype=np.uint64)
    asked = base[rng.integers(0, 40, 400)] ^ flip
    got = set(zip(*(x.tolist() for x in decontaminate.MultiIndex(base, 19).find(asked)), strict=True))
    assert got == {(i, j, d) for i, q in enumerate(asked.tolist()) for j, b in enumerate(base.tolist()) if (d := (q ^ b).bit_count()) <= 19}


@pytest.mark.parametrize("big", [1.0, 1e9])
def test_top_k_by_brute_force(spark, big):
    rng = np.random.default_rng(1)
    vecs = {i: (rng.integers(-3, 4, 6) * 0.3 * big).astype(np.float32).tolist() for i in range(240)}
    vecs[7], vecs[8], vecs[9], vecs[10], vecs[200] = None, [1.0] * 5 + [None], [float("nan")] * 6, [1.0, 2.0], [float("inf")] * 6
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs.items()] + [(None, [1.0] * 6, 1)], "vec_id long, embedding array<float>, score int").repartition(7)
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=5, wave_bytes=40, tile_rows=16, fan_in=2).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in vecs.items() if v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)}
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    for q in (0, 100):
        scores = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert set(got) == {0, 100}
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
