"""The pipeline stage by stage against brute force, and on empty and odd tables."""

from collections import Counter, defaultdict

import corpus_pipeline

from signalloom.llm import mixing, quality_classifier
from signalloom.llm.common import materialise, table


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def run_stages(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf_dir), name)
        out.append((name, before, docs))
    return out


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = run_stages(spark, docs, sf_dir)
    assert [n for n, _, _ in stages] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    _, before, after = stages[0]
    verdict = {r.doc_id: r.predicted for r in quality_classifier.classify(before, table(spark, sf_dir, "labels")).collect()}
    assert set(rows(after)) == {i for i, p in verdict.items() if p}
    known = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [i for i in verdict if known.get(i) == 1]
    assert sum(i in rows(after) for i in good) >= 0.97 * len(good)

    _, before, after = stages[1]
    last = {}
    for i, r in sorted(rows(before).items()):
        last[r.text] = i
    assert set(rows(after)) == set(last.values())

    _, before, after = stages[2]
    texts = {i: shingles(r.text) for i, r in rows(before).items()}
    stay = set(rows(after))
    for i, own in texts.items():
        partners = {k: similarity(own, other) for k, other in texts.items() if k != i}
        if i not in stay:  # dropped: a copy of a kind with a smaller id, directly or by way of others
            assert max(partners.values()) >= 0.5
        elif max(partners.values()) < 0.3:
            assert i in stay
    missed = [(i, k) for i in stay for k in stay if i < k and similarity(texts[i], texts[k]) >= 0.9]
    assert not missed

    _, before, after = stages[3]
    taken = Counter()
    for r in after.collect():
        taken[r.doc_id] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == {r.doc_id: r.taken for r in mixing.taken_words(before).collect() if r.taken}

    _, before, after = stages[4]
    pieces = defaultdict(int)
    for r in after.collect():
        pieces[r.sequence_id] += r.length
    assert max(pieces.values()) <= 1024
    assert Counter(r.doc_id for r in after.collect() if r.start == 0) == Counter(r.doc_id for r in before.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == after.count()


def test_empty_and_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, __doc string"
    empty = spark.createDataFrame([], schema)
    for _, _, after in run_stages(spark, empty, sf_dir):
        assert after.count() == 0
    rows = [(1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, True, "x", "y"), (3, "word " * 20_000, "en", "a", 1, False, "x", "y"), (4, "one two three", None, "b", 2, None, None, None)]
    rows += [rows[3], (None, "no id at all", "en", "b", 3, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, before, after in run_stages(spark, docs, sf_dir):
        if name != "packing":
            assert after.columns == before.columns, name
