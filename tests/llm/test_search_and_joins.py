"""Lexical search, hard negatives and the Jaccard join against brute force, and their defined results of odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import ODD_TEXTS, empty_docs, odd_docs

from signalloom.llm import hard_negatives, jaccard_join, lexical_search

SPLIT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(docs, items, top=20):
    split = [(i, SPLIT.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, Counter(own), len(own)) for i, own in split if own]
    total, words = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, own, _ in held for w in own)
    out = []
    for item, text in items:
        scored = []
        for doc, own, n in held:
            m = 75 + 25 * n * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * own[w] // (1000 * own[w] + 12 * m)) for w in SPLIT.findall((text or "").translate(LOWER)) if w in own)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def some_docs(rng, n=150):
    words = [rng.choice(["Ab", "c", "é", "ß", "x1", "日本"]) + str(rng.randrange(25)) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "-", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(500 + k, t) for k, t in enumerate(ODD_TEXTS)] + [docs[3], docs[3], (7, "other text of one id c1 c2"), (None, docs[4][1])]


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    docs = some_docs(rng)
    items = [(k, " ".join(rng.choice(docs)[1].split()[:12]) if k % 3 else "ab1 AB1 c7 c7 c7 x11 nowhere") for k in range(30)]
    items = [(k, t) for k, t in items] + [(30, None), (31, ""), (32, "unknown words only"), (None, "one two"), (3, "word word")]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    got = lexical_search.search(frame, spark.createDataFrame(items, "item_id int, text string"))
    key = lambda r: (str(r[0]), r[1], r[3], str(r[2]))
    # two items of one id and rows of one score and a null id may come in any order
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_search(docs, items), key=key)


def test_search_in_item_groups_and_of_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(some_docs(random.Random(1), 40), "doc_id long, text string")
    items = spark.createDataFrame([(k, f"ab{k} c{k} x1{k}") for k in range(20)], "item_id long, text string")
    whole = sorted(map(tuple, lexical_search.search(docs, items).collect()))
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 60)
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == whole
    assert lexical_search.search(docs, items.limit(0)).count() == lexical_search.search(empty_docs(spark), items).count() == 0
    assert lexical_search.search(odd_docs(spark), items).count() == 0


@pytest.mark.parametrize("window", [1, 3, 64, 4096])
def test_windows_change_no_result(window, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 30, rng.integers(1, 12))).astype(np.int32), int(rng.integers(20, 90))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([n for _, n in rows], pa.int64()), pa.array([t.tobytes() for t, _ in rows]), pa.array([(t % 3 + 1).astype(np.int32).tobytes() for t, _ in rows])], names=["doc_id", "n", "term", "tf"])
    items = [(np.arange(k, k + 6), np.asarray([1, 2, 1, 1, 3, 1])) for k in range(20)]
    weight = rng.integers(0, 900, 30)
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    (out,) = lexical_search._scored(items, weight, 300, 9000, 20)(iter([batch]))
    want = []
    for k, (own, times) in enumerate(items):
        scores = [(-sum(int(weight[t]) * int(m) * (10**9 * (int(t) % 3 + 1) // (1000 * (int(t) % 3 + 1) + 12 * (75 + 25 * n * 300 // 9000))) for t, m in zip(own, times, strict=True) if t in held), doc) for doc, (held, n) in enumerate(rows)]
        want += [(k, doc, -s) for s, doc in sorted(x for x in scores if x[0] < 0)[:20]]
    assert sorted(zip(*(c.to_pylist() for c in out.columns), strict=True)) == sorted(want)


def brute_negatives(rows):
    named = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own = [math.floor(256 * float(np.float32(c))) for c in x]
        if sum(c * c for c in own) < 2**62:
            named[i] = min(named.get(i, (99, [])), ((label + 1) % 10 if i % 7 == 0 else label, own))
    product = lambda a, b: sum(p * q for p, q in zip(named[a][1], named[b][1], strict=False))
    out = []
    for a in (i for i in named if i % 50 == 0):
        ranked = sorted((-product(a, b), b) for b in named if b != a)
        for score, p in [x for x in ranked if named[x[1]][0] == named[a][0]][:5]:
            band = [(s, b) for s, b in ranked if named[b][0] != named[a][0] and -50 * score <= -100 * s <= -95 * score][:3]
            out += [(a, p, k + 1, b, -score, -s) for k, (s, b) in enumerate(band)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, rank string"


@pytest.mark.parametrize("width", [1, 5, 30])
def test_hard_negatives_equal_brute_force(spark, width):
    rng = random.Random(width)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(4), None) for i in range(700)]
    rows += [(i, [round(c) + 0.0 for c in rng.choice(centres)], rng.randrange(3), "tie") for i in range(700, 1000)]
    rows += [(3, rows[3][1], 1, "again"), (50, rows[50][1], 9, "again"), (1001, None, 1, ""), (1002, [1.0] * width, None, ""), (None, [1.0] * width, 1, ""), (1003, [None] * width, 1, ""), (1004, [math.nan] * width, 1, ""), (1050, [math.inf] * width, 1, ""), (1005, [], 1, ""), (1006, [1.0], 2, ""), (1007, [3e30] * width, 1, ""), (1100, [1e6] * width, 1, "")]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives([r[:3] for r in rows])


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, [], 1, "")], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1, ""), (2, [1.0], 2, "")], VECTORS)).count() == 0


def test_bounds_drop_pairs_early_and_none_that_matters():
    rng = np.random.default_rng(3)
    shape = rng.normal(size=(40, 40)) * (0.8 ** np.arange(40)) * 500
    own = np.floor(rng.normal(size=(900, 40)) @ shape.T).astype(np.int64)
    turn = np.linalg.eigh(own.T @ own.astype(float))[1][:, ::-1].copy()
    a, b = hard_negatives.Turned(own[:60], turn), hard_negatives.Turned(own, turn)
    exact = own[:60] @ own.T
    least, most = np.sort(exact, axis=1)[:, -30].astype(float), np.sort(exact, axis=1)[:, -3].astype(float)
    seen = []
    i, j, score = hard_negatives.survivors(a, b, least, most, lambda rows: np.ones((len(rows), len(own)), dtype=bool))
    seen = set(zip(i.tolist(), j.tolist(), strict=True))
    assert all((p, q) in seen for p, q in np.argwhere((exact >= least[:, None]) & (exact <= most[:, None])).tolist())
    assert (score == exact[i, j]).all() and len(i) < 60 * 60


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, own in enumerate(sets):
        common = Counter(x for t in own for x in by[t])
        for x, n in common.items():
            if 100 * n >= 90 * (len(own) + len(sets[x]) - n):
                parent[find(k)] = find(x)
        for t in own:
            by[t].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_copies(rng):
    words = [f"w{k}" for k in range(4000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = fresh(80), []
    for _ in range(60):
        rows.append(fresh(rng.randint(1, 300)))
    for size in (9, 10, 11, 30, 64, 128, 129, 400, 1500):
        base = fresh(size)
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 50))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(own[: len(own) - rng.randint(0, max(1, size // 25))])
    rows += [passage + fresh(rng.randint(2, 120)) for _ in range(60)]  # a passage that many share
    chain = fresh(120)
    for _ in range(70):  # a long list: each is near to its neighbours, the ends are far apart
        chain = chain[:-2] + fresh(2) if rng.random() < 0.5 else fresh(1) + chain[1:]
        rows.append(list(chain))
    rows = [" ".join(r) for r in rows]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(900 + i, t.upper()) for i, t in enumerate(rows[:5])] + [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(4, rows[1]), (4, rows[2]), (None, rows[70]), (None, "null id alone")]


def test_jaccard_components_equal_brute_force(spark):
    rows = near_copies(random.Random(8))
    frame = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, digest string, node int, n int").repartition(6)
    key = lambda r: tuple(map(str, r))
    got = jaccard_join.components(frame)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute_components(rows), key=key)


def test_jaccard_of_odd_and_no_rows(spark):
    assert jaccard_join.components(empty_docs(spark)).count() == 0
    docs = odd_docs(spark)
    assert Counter(r.doc_id for r in jaccard_join.components(docs).collect()) == Counter(r.doc_id for r in docs.collect())


def test_linked_sets_share_a_signature_whatever_the_classes():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        n = int(rng.integers(9, 500))
        own = np.unique(rng.integers(0, 2**62, n) & ~np.int64(3))
        lost, new = rng.integers(0, len(own) // 10 + 1), rng.integers(0, len(own) // 10 + 1)
        other = np.union1d(rng.permutation(own)[lost:], rng.integers(0, 2**62, new) & ~np.int64(3))
        common = len(np.intersect1d(own, other))
        if 100 * common < 90 * (len(own) + len(other) - common):
            continue
        seed, weights = int(rng.integers(1 << 40)), rng.dirichlet([0.4, 0.4, 0.4])
        kind = lambda t: 1 + np.searchsorted(np.cumsum(weights)[:2], (jaccard_join.mix(t.view(np.uint64) + np.uint64(seed)) >> np.uint64(40)) / 2**24)  # noqa: B023, E731
        # tokens of one set only leave it, unless a third set holds them
        held = lambda s: s[np.isin(s, own) & np.isin(s, other) | (jaccard_join.mix(s.view(np.uint64)) % np.uint64(3) == 0)]  # noqa: B023, E731
        x, y = (jaccard_join.signatures(len(s), held(s) | kind(held(s))) for s in (own, other))
        assert len(np.intersect1d(x, y)), (len(own), len(other), common)
        assert len(x) < 6 * len(own)
