"""Each operator against brute force on small documents, and the defined results of odd input."""

import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from signalloom.llm import exact_dedup, html_extract, language_model, mixing, packing, quality_classifier, quality_rules, registry, simhash, token_files, tokenise, toxicity
from signalloom.llm.common import fold_of
from signalloom.llm.components import connected_components
from signalloom.llm.tokenise import Encoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, fp string, part string"
ODD_TEXTS = ["", None, "   \n\t", "one", "one two", "é ß Ω x <|endoftext|>", "a\x00b", "word " * 30_000, "x" * 200_000, "same text here", "same text here", "\n\n\n", "🙂 日本語 テスト"]


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "1", "no", "x", "y", "z") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[9], rows[9], (None, "null id", "en", "s1", 3, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "quality_rules": lambda s, d: quality_rules.judge(d),
    "mixing": lambda s, d: mixing.taken_words(d),
    "packing": lambda s, d: packing.pack(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality_classifier": lambda s, d: quality_classifier.classify(d, labels(s)),
    "token_files": lambda s, d: token_files.token_digest(d),
    "exact_dedup": lambda s, d: exact_dedup.deduplicate(d),
    "language_model": lambda s, d: language_model.score_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty_docs(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_are_all_answered(spark, name):
    docs = odd_docs(spark)
    out = OPERATORS[name](spark, docs).collect()
    ids = Counter(r["doc_id"] for r in out) if name != "packing" else Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert ids == Counter(r["doc_id"] for r in docs.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += [texts[5], texts[5], texts[6].upper(), texts[7] + " end", *ODD_TEXTS]
    return spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").cache()


def plain(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_quality_base_counts(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    space = " \t\n\x0b\x0c\r"
    for i, text in plain(docs).items():
        words, at = [], ""
        for c in text + " ":
            if c in space:
                if at:
                    words.append(at)
                at = ""
            else:
                at += c
        lines = [x for x in text.split("\n") if x.strip(space)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        repeated = len({k + s for k, w in enumerate(windows) if seen[w] > 1 for s in range(3)})
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_references_count_every_row_at_any_size(spark):
    rows = [(i, "same text", "en") for i in range(30)] + [(100 + i, f"other{i}", "en") for i in range(10)]
    got = quality_rules.references(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("word is not null").collect()
    counts = {bytes(r.word): r.n for r in got}
    assert counts[b"same"] == counts[b"text"] == 30 and {r.total for r in got} == {70}


def brute_references(rows):
    """Shares of character classes and of the common words and the rest, by language."""
    kinds = lambda c: (
        "letter_beyond_ascii" if ord(c) >= 0xC0 or ord(c) >= 0x80 else "upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z" else "digit" if "0" <= c <= "9" else "newline" if c == "\n"
        else "blank" if c in " \t" else "stop" if c in ".," else "mark" if c in "!?;:'\"-()" else "symbol" if ord(c) > 32 else "control"
    )
    out = {}
    for lang in {r[2] for r in rows}:
        text = [r[1] or "" for r in rows if r[2] == lang]
        chars, words = Counter(kinds(c) for t in text for c in t), Counter(w for t in text for w in t.encode().split())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON]
        out[lang] = (chars, dict(top), sum(words.values()))
    return kinds, out


def entropy_distance(p, q):
    h = lambda d: -sum(x * math.log2(x) for x in d if x > 0)
    return math.sqrt(max(0.0, h([(a + b) / 2 for a, b in zip(p, q, strict=True)]) - (h(p) + h(q)) / 2))


def test_verdicts_equal_brute_force(spark, docs):
    rng = random.Random(2)
    rows = [(r["doc_id"], r["text"], ["en", "fr", None][r["doc_id"] % 3]) for r in docs.collect()]
    rows += [(900 + i, " ".join(rng.choice(["#$%|", "<<>>", "zq" * 9]) + str(rng.randrange(9)) for _ in range(90)), "en") for i in range(4)]
    kinds, known = brute_references(rows)
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        text = text or ""
        r, words = got[i], text.encode().split()
        chars, far = Counter(map(kinds, text)), (0.0, 0.0)
        if text:
            options = []
            for lang in sorted(known, key=lambda x: (x is None, x or "")):
                all_chars, common, total = known[lang]
                left = [chars[c] / len(text) for c in quality_rules.CLASSES]
                right = [all_chars[c] / sum(all_chars.values()) for c in quality_rules.CLASSES]
                own = [sum(w == x for x in words) for w in common]
                mine = [x / max(len(words), 1) for x in [*own, len(words) - sum(own)]]
                theirs = [x / total for x in [*common.values(), total - sum(common.values())]]
                options.append((entropy_distance(left, right), entropy_distance(mine, theirs) if words else 0.0))
            far = min(options, key=sum)
        assert (r.char_distance, r.word_distance) == pytest.approx(far, abs=1e-6), i
        kept = not r.base_failed
        kept &= r.word_chars < quality_rules.MIN_CHARS or far[0] <= quality_rules.MAX_CHAR_DISTANCE + quality_rules.SCATTER / math.sqrt(r.word_chars)
        kept &= r.n_words < quality_rules.MIN_WORDS or far[1] <= quality_rules.MAX_WORD_DISTANCE + quality_rules.WORD_SCATTER / math.sqrt(r.n_words)
        assert r.kept == kept


def test_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0]), np.array([[0.5, 0.5, 0], [0, 0, 1]])
    assert np.allclose(quality_rules.jensen_shannon(p, q), [0, 1])


def test_mixing_targets_and_cuts(spark, docs):
    rows = mixing.taken_words(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.taken_words(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = (r.target, r.source_size)
    sizes = [s for _, s in target.values()]
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(sizes))
    for name, (t, size) in target.items():
        assert t <= 2 * size + 1e-9 and taken[name] == math.floor(t)
    sequence = mixing.mix(mixing.sizes_of(docs)).orderBy(*mixing.ORDER).collect()
    assert [r.place for r in sequence] == sorted(r.place for r in sequence) and max(r.virtual_finish for r in sequence) == 1
    assert sum(r.words for r in sequence) == sum(taken.values())
    mixed = mixing.mixed_documents(docs).collect()
    per = Counter()
    for r in mixed:
        per[r.doc_id] += len((r.text or "").encode().split())
    assert {k: v for k, v in per.items() if v} == {r.doc_id: r.taken for r in rows if r.taken}


def queue_simulation(sizes, weights=(3, 1, 2)):
    """Words of each (doc_id, copy) by serving all queues word for word at rates of their targets until the budget is used up."""
    source_size = Counter()
    for _, source, size in sizes:
        source_size[source] += size
    names = sorted(source_size, key=lambda x: (x is None, (x or "").encode()))
    weight, budget, target, level_open = {n: weights[i % 3] for i, n in enumerate(names)}, 1.5 * sum(source_size.values()), {}, set(names)
    while level_open:
        level = (budget - sum(target.values())) / sum(weight[n] for n in level_open)
        full = {n for n in level_open if level * weight[n] > 2 * source_size[n]}
        target |= {n: 2.0 * source_size[n] for n in full} if full else {n: level * weight[n] for n in level_open}
        level_open -= full or level_open
    taken = Counter()
    for name in names:
        key = lambda r: (hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])
        left = math.floor(target[name])
        for doc, _, size in sorted((r for r in sizes if r[1] == name), key=key) * 2:
            taken[doc, size] += min(left, size)
            left -= min(left, size)
    return taken


def test_mixing_equals_a_simulated_queue_with_repeated_rows(spark, docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    rng = random.Random(4)
    rows += [rows[rng.randrange(len(rows))] for _ in range(40)] + [(7, "s2", "other words under a known id"), (None, None, "no id and no source"), (None, None, "no id and no source")]
    odd = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")
    want = queue_simulation([(i, s, len((t or "").encode().split())) for i, s, t in rows])
    got = Counter()
    for r in mixing.taken_words(odd).collect():
        got[r.doc_id, r.size] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    words = Counter()
    for r in mixing.mixed_documents(odd).collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    per = Counter()
    for (i, _), v in want.items():
        per[i] += v
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in per.items() if v}


def test_mixing_sorts_by_range_and_cuts(spark, docs, monkeypatch):
    plans = []
    write = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    sizes = mixing.sizes_of(docs)
    copies = mixing.schedule(sizes).filter("words > 0").count()
    kept = mixing.mix(sizes)
    assert any("rangepartitioning(virtual_finish" in p for p in plans)
    assert 0 < kept.count() < copies


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(7)
    parts = ["foo", " ", "\n", "é", "ß", "Ω", "Σ", "'s", "'", " 12", "9", ".", ",", "!", "<|endoftext|>", "…", "\t", "\xa0", "日本", "Ａ", "́", "##", "don't", "ABC", "_", "(", "÷", "\x00", "🙂", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    encoder = Encoder(tokenizer_path(name))
    ids, counts = [], []
    for _, i, c in encoder.encode(pa.array(texts)):
        ids.append(i)
        counts.append(c)
    mine = np.split(np.concatenate(ids), np.cumsum(np.concatenate(counts))[:-1])
    theirs = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(mine, theirs, strict=True))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_have_the_ids_that_a_fresh_library_tokenizer_gives(name):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path(name))
    rng = random.Random(11)
    parts = ["foo", " ", "\n", "é", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "0", "Bar"]
    texts = ["end <|endoftext|> next", "x<|endoftext|>y", "plain words here.", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000))]
    mine = []
    for _, ids, counts in Encoder(tokenizer_path(name)).encode(pa.array(texts)):
        mine += np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in mine] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert fresh.token_to_id("<|endoftext|>") in mine[0].tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_sizes_of_rounds_and_memo_change_no_id(name, monkeypatch):
    rng = random.Random(3)
    parts = ["foo", " ", "\n", "é", ".", "Bar", "0", "a9", "x", "  ", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    for constant, value in (("UNITS_AT_ONCE", 5), ("MEMO_UNITS", 40), ("ROUND_BYTES", 500)):
        monkeypatch.setattr(tokenise, constant, value)
    encoder, mine = Encoder(tokenizer_path(name)), []
    for _, ids, counts in encoder.encode(pa.array(texts)):
        mine += np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in mine] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark, docs):
    encoder = Encoder(tokenizer_path(packing.VOCABULARY))
    ids = {i: np.asarray([*e.ids, 0], dtype="<u4") for (i, _), e in zip(plain(docs).items(), encoder.tokenizer.encode_batch(list(plain(docs).values()), add_special_tokens=False), strict=True)}
    covered, windows = defaultdict(int), defaultdict(list)
    for r in packing.pack(docs).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(covered.values())
    assert len(windows) <= total / packing.WINDOW * 1.1 + 2


def test_minimum_slack_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(50):
        counts = {rng.randint(1, 60): rng.randint(1, 3) for _ in range(8)}
        seed = max(counts)
        used = packing.fill(counts, seed, 100)
        assert all(n <= counts[k] for k, n in used.items()) and used[seed] >= 1
        pool = [k for k, n in counts.items() for _ in range(n)]
        pool.remove(seed)
        sums = {seed}
        for x in pool:
            sums |= {s + x for s in sums if s + x <= 100}
        assert sum(k * n for k, n in used.items()) == max(sums)


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    values = np.asarray(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    root = np.arange(len(values))
    while True:
        new = np.asarray([root[near[i]].min() for i in range(len(values))])
        if (new == root).all():
            return root
        root = new


def test_simhash_equals_brute_force(spark, docs):
    texts = plain(docs)
    prints = [brute_fingerprint(t) for t in texts.values()]
    ids = list(texts)
    want = {i: (p, ids[c]) for i, p, c in zip(ids, prints, components(prints), strict=True)}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_in_dense_and_sparse_buckets(spark, bucket):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(100)}
    for c in centres:
        for _ in range(120):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    roots = {r.node % 2**64: r.root for r in connected_components(simhash.links(frame, bucket)).collect()}
    groups = defaultdict(set)
    for p, c in zip(prints, components(prints), strict=True):
        groups[c].add(p)
    mine = defaultdict(set)
    for p in prints:
        mine[roots.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_large_group_tree_equals_pairwise(monkeypatch):
    rng = np.random.default_rng(0)
    mask = simhash.masks()[-1]
    free = [b for b in range(64) if mask >> b & 1]
    values = np.unique([sum(1 << b for b in free if rng.random() < 0.15) for _ in range(300)]).astype(np.uint64)
    pairwise = simhash._tree(values, mask)
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    hashed = simhash._tree(values, mask)
    assert (pairwise == hashed).all()


def edited(rng, words, share):
    return [rng.choice(["edit", "other", "word"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def five_word_similarity(a, b):
    left, right = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split()))
    return len(left & right) / len(left | right)


def test_keep_one_of_near_copies(spark):
    """One of each group of copies of similarity 0.8 or more stays, the one with the smallest id; unrelated texts all stay."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, close = [], []
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = " ".join(edited(rng, words, 0.015))
            if five_word_similarity(texts[4 * g if len(texts) > 4 * g else -1], copy) >= 0.8:
                close.append((4 * g, len(texts)))
            texts.append(copy)
    texts += ["", None, "one", "one", "x " * 40_000]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(0, texts[4], "a", "b"), (0, texts[0], "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, node string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    stay = Counter((r.doc_id, r.text or "") for r in kept.collect())
    ids = {i for i, _ in stay}
    assert max(stay.values()) == 1 and {4 * g for g in range(40)} <= ids | {4}
    caught = [b not in ids for a, b in close]
    assert len(close) > 60 and sum(caught) >= 0.95 * len(caught)
    # of an id that two texts share only the row that stands for its group stays
    assert [t for i, t in stay if i == 0] in ([texts[0]], [texts[4]], [texts[0], texts[4]], [texts[4], texts[0]])


@pytest.mark.parametrize("shifts", [2, 32])
def test_bucket_links_connect_as_all_pairs_do(monkeypatch, shifts):
    monkeypatch.setattr(simhash, "SHIFTS", shifts)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, (12, simhash.LONG_WORDS), dtype=np.uint64)
    prints = centres[rng.integers(0, 12, 300)].copy()
    for row in prints:
        for bit in rng.integers(0, 192, rng.integers(0, 30)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    key = np.sort(rng.integers(0, 25, 300)).astype(np.int32)
    order = np.lexsort((*prints.T[::-1], key))
    key, prints = key[order], prints[order]
    i, j = simhash.bucket_links(key, prints)
    assert all(np.sum(key[i] == k) < np.sum(key == k) for k in np.unique(key))  # fewer links than members

    def roots(pairs):
        at = list(range(300))
        find = lambda x: x if at[x] == x else find(at[x])
        for a, b in pairs:
            at[find(int(a))] = find(int(b))
        return [min(k for k in range(300) if find(k) == find(x)) for x in range(300)]

    every = [(a, b) for a in range(300) for b in range(a) if key[a] == key[b] and np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.LONG_DISTANCE]
    assert roots(zip(i, j, strict=True)) == roots(every)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    encoder = Encoder(tokenizer_path(token_files.VOCABULARY))
    got = sorted(token_files.token_digest(docs, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (i, t) in zip(got, sorted(plain(docs).items()), strict=True):
        ids = np.asarray([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    part = next(p for p in sorted(tmp_path.rglob("*.parquet")))
    meta = pq.ParquetFile(part).metadata.row_group(0)
    encodings = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in encodings["tokens.list.element"]) and meta.column(0).has_offset_index
    plan = token_files.read_tokens(spark, path).filter("doc_id = 3").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "array<int>" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,3)" in plan


def test_exact_dedup_over_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = docs.filter("doc_id < 60")
    one = {r.doc_id: r for r in exact_dedup.deduplicate(first, index).collect()}
    assert all(r.kept == (r.keep_id == i) for i, r in one.items())
    two = exact_dedup.deduplicate(docs, index).collect()
    kept_texts = Counter(r.text_sha256 for r in two if r.kept)
    assert set(kept_texts.values()) == {1}
    assert {r.text_sha256 for r in two} == set(kept_texts)
    assert index.rows().count() == len(kept_texts)
    stays = exact_dedup.keep_distinct(odd_docs(spark))
    assert Counter(r.text or "" for r in stays.collect()) == {t: 1 for t in {x or "" for x in [*ODD_TEXTS, "null id"]}}


def test_language_model_equals_brute_force(spark, docs):
    tokens = {i: [*t.encode().lower().split(), None] for i, t in plain(docs).items()}
    fold = {i: fold_of(i, 10) for i in tokens}

    def counted(inside):
        words, pairs, starts = Counter(), Counter(), 0
        for i, t in tokens.items():
            if inside(fold[i]):
                words.update(t)
                pairs.update(zip([0, *t], t, strict=False))
                starts += 1
        return words, pairs, starts

    bucket = lambda n: 0 if n == 0 else int(math.log2(n)) + 1
    words, pairs, starts = counted(lambda x: x > 1)
    n, v = sum(words.values()), len(words)
    held = [(h, w) for i, t in tokens.items() if fold[i] == 1 for h, w in zip([0, *t], t, strict=False)]
    mu, lam = 0.5, np.full(64, 0.5)
    for _ in range(200):
        share = [mu * words[w] / n / (mu * words[w] / n + (1 - mu) / (v + 1)) for _, w in held]
        mu = min(max(sum(share) / len(share), 1e-6), 1 - 1e-6)
    low = lambda w: mu * words[w] / n + (1 - mu) / (v + 1)
    seen = lambda h: starts if h == 0 else words[h]
    cells = [(bucket(seen(h)), pairs[h, w] / seen(h), low(w)) for h, w in held if seen(h)]
    for _ in range(200):
        total, part = np.zeros(64), np.zeros(64)
        for b, hi, lo in cells:
            part[b] += lam[b] * hi / (lam[b] * hi + (1 - lam[b]) * lo)
            total[b] += 1
        lam = np.where(total > 0, np.clip(part / np.maximum(total, 1), 1e-6, 1 - 1e-6), lam)
    words, pairs, starts = counted(lambda x: x > 0)
    n, v = sum(words.values()), len(words)
    for r in language_model.score_documents(docs).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (fold[r.doc_id] == 0, len(t), n)
        assert r.n_known == sum(words[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        score = sum(math.log10(lam[bucket(seen(h))] * pairs[h, w] / seen(h) + (1 - lam[bucket(seen(h))]) * low(w) if seen(h) else low(w)) for h, w in zip([0, *t], t, strict=False))
        assert r.score == pytest.approx(score, rel=5e-3)


def test_block_and_part_sizes_change_no_score(spark, docs, monkeypatch):
    one = {r.doc_id: (r.base_score, r.score) for r in language_model.score_documents(docs).collect()}
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(language_model, "PART_ENTRIES", 900)
    monkeypatch.setattr(language_model, "SIZED_TOKENS", 5_000)
    two = {r.doc_id: (r.base_score, r.score) for r in language_model.score_documents(docs.repartition(3)).collect()}
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i]) for i in one)
    messages = [(t / (1e6 * language_model.growth(t))) * (t / (2e6 * language_model.growth(t))) for t in (1e10, 1e12)]
    assert messages[1] / messages[0] <= 100**1.5 * 1.01


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (language_model.unsqueeze(language_model.squeeze(values)) == values).all()
    for top in (3, 300, 70_000, 2**40):
        counts = rng.integers(0, top, 50)
        assert (language_model.unpack_counts(language_model.pack_counts(counts)) == counts).all()


def synthetic(spark, kind):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, marks = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        bad = rng.random() < 0.3
        if kind == "quality" and bad:
            text = [w.upper() + "***" for w in text]
        if kind == "toxic" and bad:
            text = [rng.choice(["idiot", "zzork" + w]) if rng.random() < 0.1 else w for w in text] + ["idiot", "zzorka"]
        rows.append((i, " ".join(text)))
        marks.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    docs, known = synthetic(spark, kind)
    out = (quality_classifier if kind == "quality" else toxicity).classify(docs, known)
    rows = out.join(known, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (fold_of(r.doc_id, 5) == 0) for r in rows)
    assert np.mean([r.predicted == r[kind] for r in held]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, known = synthetic(spark, "toxic")
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda k: {r.doc_id: r.score for r in toxicity.classify(docs, k).collect()}
    a, b = score(known), score(flipped)
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_label_model_equals_enumeration():
    """Posteriors of the fitted tree by summing its joint distribution out, for a few voters."""
    rng = random.Random(5)
    patterns = Counter()
    for _ in range(4000):
        toxic = rng.random() < 0.2
        votes = [rng.random() < (0.8 if toxic else 0.03) for _ in range(3)]
        votes.append(votes[0] if rng.random() < 0.9 else not votes[0])
        patterns[sum(1 << i for i, v in enumerate(votes) if v)] += 1
    model = toxicity.LabelModel(dict(patterns), voters=4)
    for key, post in zip(model.keys, model.post, strict=True):
        joint = []
        for y in range(2):
            p = model.prior if y else 1 - model.prior
            for j, parent in enumerate(model.parents):
                yes = model.tables[j, key >> parent & 1 if parent >= 0 else 0, y]
                p *= yes if key >> j & 1 else 1 - yes
            joint.append(p)
        assert post == pytest.approx(joint[1] / sum(joint), abs=1e-4)
    assert 0.1 < model.prior < 0.3


def test_newton_equals_gradient_of_zero(spark):
    """At the fitted weights the gradient of the penalised likelihood vanishes, computed densely."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(toxicity.FEATURES)))
    keys = rng.integers(0, 4, 300)
    model = toxicity.LabelModel({0: 200, 1: 50, 2: 40, 3: 10}, voters=2)
    frame = spark.createDataFrame([(int(k), row.tolist()) for k, row in zip(keys, x, strict=True)], "votes int, features array<double>")
    w = toxicity.fit_logistic(frame, model)
    design = np.hstack([np.ones((300, 1)), x])
    p = 1 / (1 + np.exp(-design @ w))
    penalty = np.full(len(w), 1.0)
    penalty[0] = 1e-6
    assert np.abs(design.T @ (model.posteriors(keys) - p) - penalty * w).max() < 1e-2


def test_ridge_equals_least_squares_on_all_rows(spark):
    rng = np.random.default_rng(7)
    d = len(quality_classifier.STATISTICS)
    x = rng.normal(size=(200, d))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    frame = spark.createDataFrame([(row.tolist(), float(v)) for row, v in zip(x, y, strict=True)], "features array<double>, label double").repartition(5)
    model = quality_classifier.fit(frame, features=40)
    z = model.design(x)
    penalty = np.sqrt(np.full(z.shape[1], quality_classifier.RIDGE * 200))
    penalty[0] = np.sqrt(1e-9 * 200)
    want = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.abs(model.design(x) @ (model.weights - want)).max() < 1e-6


def test_isotonic_is_the_best_monotone_fit():
    """Pooled shares equal the max-min formula of isotonic regression."""
    rng = np.random.default_rng(2)
    totals = rng.integers(1, 9, 30).astype(float)
    positives = np.minimum(totals, rng.integers(0, 9, 30)).astype(float)
    at, shares = quality_classifier.isotonic(np.arange(30.0), positives, totals)
    mean = lambda a, b: positives[a : b + 1].sum() / totals[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert sorted(set(np.round(want, 12))) == pytest.approx(sorted(set(np.round(shares, 12))))
    assert (np.diff(at) > 0).all()


def test_isotonic_is_monotone():
    _, y = quality_classifier.isotonic(np.arange(5.0), np.array([1, 0, 3, 1, 4.0]), np.array([2, 2, 4, 4, 4.0]))
    assert (np.diff(y) >= 0).all()


PAGE = """<!doctype html><html><head><title>t</title><style>p{x:y}</style><script>var a="</p>";</script></head><body class="page-body">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout with-sidebar"><article><h2>Title %(n)d &amp; more</h2><p>First  paragraph\n %(n)d <b>bold</b> caf&eacute;.<p>Second one<br>here &lt;tag&gt; %(n)d
<div class="share">Share this</div><p class="tagline">Read us daily</p><ul><li>item %(n)d<li>two %(n)d</ul><form><input><label>Mail</label></form><section id="comments"><p>reader %(n)d says</p></section></article>
<aside>Side %(n)d</aside></div><div class="ad">Buy %(n)d</div><footer>&copy; x</footer></body></html>"""


def pages(spark, n=8):
    rows = [(i, f"https://host.example/{i}", PAGE % {"n": i}, "x") for i in range(n)]
    rows += [(100, None, None, "x"), (101, "https://host.example/e", "", "x"), (102, "weird", "plain text only", None), (103, "https://one.example/", "<div><p>Alone " + "word " * 40 + "</p></div><div class=footer>f</div>", "y"), (104, "https://host.example/b", "<<<p>>broken <b", "z"), (None, "https://h", "<p>" * 5000 + "deep", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_main_texts(spark):
    got = {r.page_id: r for r in html_extract.main_texts(pages(spark)).collect()}
    assert len(got) == 14
    for i in range(8):
        assert got[i].text == f"Title {i} & more\nFirst paragraph {i} bold café.\nSecond one here <tag> {i}\nitem {i}\ntwo {i}"
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == "" and got[102].text == "plain text only"
    assert got[103].text.startswith("Alone word") and "f" not in got[103].text.split("\n")[-1].split() and got[None].text == "deep"
    assert html_extract.main_texts(pages(spark).limit(0)).count() == 0


def test_an_article_posted_many_times_is_no_template(spark):
    rows = [(i, "https://h.example/x", PAGE % {"n": 1}) for i in range(30)] + [(100 + i, "https://h.example/y", PAGE % {"n": 2 + i}) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == "Title 1 & more\nFirst paragraph 1 bold café.\nSecond one here <tag> 1\nitem 1\ntwo 1" for i in range(30))


LAYOUTS = {
    '<div id="header">Site</div><div id="menu"><a href=x>one</a></div><div id="main-content"><h1>T</h1><p>Body one.</p><p>Two <a href=y>link</a>.</p></div><div id="sidebar">side</div>': "T\nBody one.\nTwo link.",
    "<TABLE><TR><TD class=nav>menu</TD><TD><P>Long text in a cell goes on.<P>More of it</TD></TR></TABLE>": "Long text in a cell goes on.\nMore of it",
    '<article><h1>T</h1><div class="notice">N!</div><p>A</p><aside>x</aside><p>B</p></article><div class="comments"><article class="comment"><p>hi there reader</p></article></div>': "T\nA\nB",
    '<main><section><h2>One</h2><p>aa</p></section><section class="comments"><p>zz</p></section></main>': "One\naa",
    "<body><nav>n</nav><p>First.</p><p>Second &amp; &#8212; &nbsp;x&hellip;</p><footer>f</footer></body>": "First.\nSecond & — x…",
    '<div class="ads"><p>x</p></div><h1>Title</h1><div class="text"><p>long long long long text</p><p>second long para</p></div>': "Title\nlong long long long text\nsecond long para",
    "<article>A<!-- c -->B <b>c</b>d<i>e</i><p hidden>no</p><template>t</template></article>": "AB cde",
}


@pytest.mark.parametrize("html", LAYOUTS)
def test_layouts_without_a_wrapper(html):
    assert html_extract.extract(html) == LAYOUTS[html]


def tree(key, *children, digest=0):
    return html_extract.Wrapper(key, 1, {digest: 1}, list(children))


def test_tree_matching_aligns_most_nodes():
    left = tree("x", tree("p"), tree("div", tree("a"), tree("b")), tree("ul"))
    right = tree("x", tree("ul"), tree("div", tree("b")), tree("p"))
    assert html_extract.Matching().children(left, right)[1] == [(1, 1)]


def brute_matching(a, b):
    """Simple tree matching by its textbook recursion."""
    if a.key != b.key:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matching(x, y))
    return best[-1][-1] + 1


def test_matching_of_distinct_runs_is_the_textbook_one():
    rng = random.Random(6)

    def random_tree(depth):
        keys = rng.sample("abcdef", rng.randint(0, 4)) if depth else []
        return tree("r" if depth == 3 else rng.choice("uv"), *[html_extract.Wrapper(k, 1, {rng.random(): 1}, random_tree(depth - 1).children) for k in keys])

    for _ in range(200):
        a, b = random_tree(3), random_tree(3)
        assert html_extract.Matching().worth(a, b) - (1 if a.seen.keys() & b.seen.keys() else 0) == brute_matching(a, b)


def test_summaries_lose_no_frequent_content():
    rng = random.Random(1)
    total = {}
    for _ in range(400):
        digest = 7 if rng.random() < 0.6 else rng.randrange(1000, 9000)
        total = html_extract.summary({**total, digest: total.get(digest, 0) + 1})
    assert 7 in total and len(total) <= html_extract.SUMMARY


def nameless(i, rng):
    """A page whose parts carry no telling tags or names: menu, notice, advert, article, footer are plain divs."""
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    body = [f"<p>{say(rng.randint(20, 60))}</p>" for _ in range(rng.randint(2, 6))]
    want = [f"Title {i}", *(x[3:-4] for x in body)]
    if i % 4 == 0:  # a passage that a quarter of the articles share is no template
        body.append("<p>" + " ".join(f"shared{k}" for k in range(55)) + "</p>")
        want.append(body[-1][3:-4])
    advert = f"<div>{say(8)}</div>"
    html = (
        "<html><body><div><div><a href=/a>Home page</a> <a href=/b>News of the day</a></div></div><div>We keep your settings on this machine. Read on if you agree.</div>"
        f"{advert}<div><h1>Title {i}</h1>{''.join(body)}<p>Read us again tomorrow.</p></div><div>All rights reserved by the house</div></body></html>"
    )
    return html, "\n".join(want)


def test_the_wrapper_alone_finds_the_article(spark):
    """Adverts, menus and notices without telling names vanish only by the wrapper."""
    rng = random.Random(12)
    pages_, want = [], {}
    for i in range(60):
        html, want[i] = nameless(i, rng)
        pages_.append((i, f"http://plain.example/{i}", html))
    rare = [(100 + k, f"http://few.example/{k}", nameless(k, rng)[0]) for k in range(2)]
    frame = spark.createDataFrame(pages_ + rare, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(frame.repartition(5)).collect()}
    assert {i: got[i] for i in want} == want
    assert html_extract.extract(pages_[0][2]) != want[0]  # without the wrapper notices and adverts stay


def test_a_wrapper_does_not_depend_on_the_number_of_rare_variants(spark):
    """A notice on nine of ten pages is template however many different ones the other pages have."""
    rng = random.Random(3)
    rows = [(i, "http://h.example/", f"<body><div><p>notice {'of the house' if i % 10 else rng.random()}</p></div><div><p>text {rng.random()} of page {i} " + "and more words " * 9 + "</p><p>second</p></div></body>") for i in range(80)]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert all("of the house" not in t and t.startswith("text") for t in got.values())


def test_very_long_pages_are_aligned_in_time():
    import time

    def page(n, salt):
        return html_extract.tree_of(html_extract.parse("<body>" + "".join(f"<{t}><{u}>{salt} {k}</{u}></{t}>" for k in range(n) for t, u in [(("div", "p"), ("section", "ul"), ("div", "ol"))[(k * k + salt) % 3]]) + "</body>"))

    began = time.time()
    merged = html_extract.merge(page(20_000, 1), page(20_000, 2))
    merged = html_extract.merge(merged, page(30, 3))
    assert merged.pages == 3 and time.time() - began < 30


def test_registry_matches_its_twins(spark, sf_dir, duck):
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf_dir)
        columns = sorted(df.columns)
        mine = sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())))
        got = duck.execute(sql)
        order = [[d[0] for d in got.description].index(c) for c in columns]
        assert mine == sorted(str(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in got.fetchall())


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{root}/signalloom"):
        for name in names:
            if name.endswith(".py") and "/llm" not in folder:
                with open(f"{folder}/{name}") as f:
                    assert "signalloom.llm" not in f.read(), name
    assert json.dumps(sorted(registry.queries())) and len(registry.queries()) == 13
