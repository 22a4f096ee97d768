"""Odd sketches, lexical search and vector codes against brute force, and on awkward and empty tables."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import jaccard_join, norm_search, odd_minhash, vector_codes

BASE = " ".join(f"tok{i}" for i in range(120))
BIG = 2**53 + 1


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def roots(sets, least):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("options", [{}, {"most": 6, "block": 2, "weight": 900}])
def test_odd_minhash(spark, options):
    """Chains of near copies of several texts, similarities on both sides of the bound, exact copies and short texts."""
    rng = np.random.default_rng(1)
    texts = [None, "", " \n ", "one two", "ONE  two", "one two three", BASE, BASE.upper(), "x" * 200_000]
    for k in range(4):
        words = [f"w{k}x{i}" for i in range(90)]
        for _ in range(25):
            texts.append(" ".join(w if rng.random() > 0.012 else f"x{rng.integers(999)}" for w in words))
        for cut in range(8):  # one end grows: similarities near 0.85
            texts.append(" ".join(words[: 90 - 2 * cut]))
    sets = sets_of(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in odd_minhash.near_duplicates(d, **options).collect()}
    want = roots(sets, 85)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(s), r, r == i) for i, (s, r) in enumerate(zip(sets, want, strict=True))]
    assert 20 < len(set(want)) < len(texts)


def test_odd_minhash_exact_bound(spark):
    """85 of 100 links, 84 of 100 doesn't."""
    words = [f"a{i}" for i in range(104)]
    texts = [" ".join(words), " ".join(words[:89]), " ".join(words[15:]), " ".join(words[:88])]
    sets = sets_of(texts)
    assert len(sets[0]) == 100 and len(sets[1]) == 85 and len(sets[3]) == 84
    got = {r["doc_id"]: r["component_id"] for r in odd_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts[:3])), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    got = odd_minhash.near_duplicates(spark.createDataFrame([(0, texts[0]), (3, texts[3])], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 3: 3}


def test_odd_sketches():
    """Counts never pass twice the differing places; estimates come near the similarity; the bound lets pairs at 0.85 pass."""
    rng, bound = np.random.default_rng(2), odd_minhash.most_odd(0.85)
    errors = []
    for similarity in (0.95, 0.85, 0.7, 0.3):
        for _ in range(60):
            n = 400
            both = int(round(2 * n * similarity / (1 + similarity)))
            x = jaccard_join.mixed(rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64))
            a, b = odd_minhash.sample(x[:n]), odd_minhash.sample(x[n - both :])
            s, t = (np.frombuffer(odd_minhash.odd_sketch(v), "<u8") for v in (a, b))
            count = int(np.bitwise_count(s ^ t).sum())
            assert count <= 2 * (a != b).sum()
            assert similarity < 0.85 or count <= bound
            assert similarity > 0.3 or count > bound
            if similarity >= 0.85:
                errors.append(odd_minhash.estimate(count) - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def best(rows, items, k=10):
    docs = [(i, Counter(words_of(t)), len(words_of(t))) for i, t in rows if words_of(t)]
    n, total, df = len(docs), sum(x[2] for x in docs), Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in items:
        scored = []
        for i, tf, length in docs:
            m = 100 - 90 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(words_of(text)) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "pilot": 2, "per_bucket": 7, "postings": 60}])
def test_norm_search(spark, options):
    """Common and rare terms, ties, repeated rows, terms beyond ASCII, items without terms or without finds."""
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(60)] + ["éa", "Éa", "日本", "x_y", "A-b"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60), p=p / p.sum()))) for i in range(150)]
    rows += [(500, "t1 t2 t3"), (400, "t1 t2 t3"), (300, "T1, t2; t3"), (None, "t1 t2 t3"), (300, "t1 t2 t3"), (600, None), (601, ""), (602, "... \n"), (BIG, "rare " * 5000), (604, "the only one: rare")]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for i in range(20)] + [(50, "t1 t2 t3"), (51, ""), (52, None), (53, "unheard of"), (54, "RARE"), (55, "t0 t0 t0"), (None, "t5 t9")]
    d = spark.createDataFrame([(*r, 1, None) for r in rows], "doc_id long, text string, row long, length long").repartition(4)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank long")
    got = [tuple(r) for r in norm_search.search(d, b, **options).select("item_id", "rank", "doc_id", "score").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(best(rows, items), key=key)


def test_norm_search_prunes():
    """A bucket keeps ties with the threshold and skips what can't reach it."""
    one = lambda x, kind: np.array(x, kind).tobytes()
    bucket = norm_search.Bucket([10, 11, 12], one([9.0, 5.0, 3.0], "<f8"), one([1, 1, 2, 3], "<u4"), one([0, 1, 1, 2], "<u4"), one([9, 4, 3, 3], "<i8"))
    assert [x.tolist() for x in bucket.search(np.array([1, 2]), 7)] == [[0, 1], [9, 7]]
    assert [x.tolist() for x in bucket.search(np.array([1, 2]), 10)] == [[], []]
    assert [x.tolist() for x in bucket.search(np.array([4, 9]), 1)] == [[], []]


def codes(rows, parts=8, entries=16, rounds=6):
    """Plain rounds with Python's whole numbers."""
    kept = sorted((i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    q = [[math.floor(4096 * x) for x in v] for _, v in kept]
    w = len(q[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for v in q]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]
        if r == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)}, sha


@pytest.mark.parametrize("scale", [0.2, 3e4])
def test_vector_codes(spark, scale):
    """Clusters, copies, small and very large values, values at whole numbers, vectors that take no part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10, 16))[rng.integers(10, size=300)] * scale + rng.normal(size=(300, 16)) * 0.05
    x[40:90], x[90:95] = x[40], 0.0
    x[95] = np.round(x[95] * 4096) / 4096
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(400, None), (401, [None] + [0.0] * 15), (402, [float("nan")] * 16), (403, [float("inf")] * 16)]
    labels = {i: None if i % 5 == 0 else i % 3 for i, _ in rows}
    d = spark.createDataFrame([(i, v, labels[i], 7) for i, v in rows], "vec_id long, embedding array<double>, label int, row int").repartition(3)
    got = vector_codes.digest(*vector_codes.encode(d, block=8)).collect()
    want, sha = codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {sha}
    total = Counter()
    for i, (_, e) in want.items():
        total[labels[i]] += e
    assert all(r["label_error"] == total[labels[r["vec_id"]]] for r in got)


def test_vector_codes_of_awkward_rows(spark):
    """Null and repeated ids, vectors of another length, fewer vectors than entries, a length that can't be cut, none at all."""
    schema = "vec_id long, embedding array<float>, label string"
    v = [float(i) for i in range(16)]
    got = vector_codes.digest(*vector_codes.encode(spark.createDataFrame([(None, v, "a"), (3, v, None), (3, v, None), (BIG, v[:4], "a"), (5, [x + 1 for x in v], "b")], schema))).collect()
    assert sorted(map(str, ((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got))) == sorted(map(str, [(None, "00" * 8, 0, 0), (3, "00" * 8, 0, 0), (3, "00" * 8, 0, 0), (BIG, None, None, 0), (5, "02" * 8, 0, 0)]))
    uneven = vector_codes.digest(*vector_codes.encode(spark.createDataFrame([(1, v[:9], "a")], schema))).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in uneven] == [(1, None, None, None)]
    assert vector_codes.digest(*vector_codes.encode(spark.createDataFrame([], schema))).count() == 0


def test_shortlists():
    """No entry that is nearest to a point of the box is left out, ties included."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        points, entries = rng.integers(-6, 7, (6, 2)), rng.integers(-9, 10, (8, 2))
        few = set(vector_codes.shortlist(points.min(0), points.max(0), entries).tolist())
        assert set(vector_codes.nearest(points, entries)[0].tolist()) <= few


def test_awkward_and_empty(spark):
    d = spark.createDataFrame([(None, BASE, 1), (BIG, BASE, 2), (BIG, BASE, 2), (None, None, 3), (7, "", 4), (BIG + 2, BASE.replace("tok3 ", "x "), 5)], "doc_id long, text string, cid long")
    got = odd_minhash.near_duplicates(d).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 116, BIG, False), (BIG, 116, BIG, True), (BIG, 116, BIG, True), (None, 0, None, True), (7, 0, 7, True), (BIG + 2, 116, BIG, False)]))
    items = spark.createDataFrame([(1, "tok1")], "item_id long, text string")
    assert odd_minhash.near_duplicates(d.limit(0)).count() == 0
    assert norm_search.search(d.limit(0), items).count() == 0 and norm_search.search(d, items.limit(0)).count() == 0
