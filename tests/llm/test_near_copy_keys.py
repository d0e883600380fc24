"""Keys of the near-copy stage that are too large for one task give the same groups as small ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import simhash


def copies(rng):
    words = [f"w{k}" for k in range(900)]
    rows = [[rng.choice(words) for _ in range(rng.randint(5, 200))] for _ in range(40)]
    for size in (40, 150, 400):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(45):
            own = list(base)
            for _ in range(rng.randint(0, 1 + size // 60)):
                own[rng.randrange(size)] = rng.choice(words)
            rows.append(own)
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(500, None), (501, ""), (502, "one two")]


@pytest.mark.parametrize("full", [1, 5, 30])
def test_chunks_of_a_full_key_connect_what_the_key_does(spark, full):
    docs = spark.createDataFrame(copies(random.Random(4)), "doc_id long, text string").repartition(5)
    groups = lambda df: sorted((r.doc_id, r.component.doc_id) for r in df.collect())
    whole = groups(simhash.similar_groups(docs))
    assert groups(simhash.similar_groups(docs, full)) == whole
    assert 3 <= len({c for _, c in whole}) < 150


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_rows_of_full_keys_are_handed_on_whatever_the_batches(size):
    rng = np.random.default_rng(0)
    key = np.sort(rng.integers(0, 40, 600)).astype(np.int32)
    key[100:250] = key[100]  # one key of many batches
    key = np.sort(key)
    prints = rng.integers(0, 2**63, (600, simhash.LONG_WORDS), dtype=np.uint64)
    names = ["key", *simhash.PRINT]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + size]), *(pa.array(np.ascontiguousarray(prints[a : a + size, k]).view(np.int64)) for k in range(simhash.LONG_WORDS))], names=names) for a in range(0, 600, size)]
    out = pa.Table.from_batches(list(simhash._meeting_links(20)(iter(batches))))
    handed = out.filter(out["full"])
    counts = np.bincount(key, minlength=40)
    got = np.bincount(handed[f"v{simhash.PRINT[0]}"].to_numpy(), minlength=40)
    assert (got[counts > 20] == counts[counts > 20]).all() and got[counts <= 20].sum() == 0
