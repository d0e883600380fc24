"""Ranked lexical search: the highest-scoring documents of every item, by windowed bucket scoring.

One pass over the texts keeps, for each document, its number of terms and the occurrences of the items' terms; the totals N, L
and each term's df are sums over these rows. The rows are then range-sorted by doc_id and cut into windows of WINDOW documents.
In a window the rows become postings lists by term. For each item the lists of its terms are traversed one by one: every list
scatter-adds its scores into an array of one bucket a document, small enough for a core's cache, and the union of the lists'
bitsets says which buckets are occupied. Occupied buckets are harvested into a heap of the item's best `top` documents, which lives through
all windows of a task; what a window's item can add at most is compared with the heap first. The tasks' heaps meet in a
partial top-k for each item.

Items are few beside documents, but not bounded: their terms travel to the tasks in groups of at most about GROUP_BYTES of
item text, each group in a pass of its own.

Cases: a null text has no terms; a document without terms counts for nothing; an item without known terms has no rows; very long
texts are counted whole; rows that repeat a doc_id are documents of their own, and equal scores keep the order of doc_id, null
ids last (such rows may come in any order among themselves); rows that repeat an item_id are items of their own; empty tables
give an empty result; columns besides doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, materialise, text_bytes, text_rows

TOP = 20
#: Documents of a window: its buckets are 32 KB of longs.
WINDOW = 4096
#: Item text whose terms travel to the tasks together.
GROUP_BYTES = 4 << 20
SCALE = 1_000_000_000
LAST = np.iinfo(np.int64).max

#: Bytes of a term: digits, letters and every byte beyond ASCII. A-Z become a-z, any other byte parts terms.
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_groups(spark: SparkSession, items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Groups of (item_id, terms) whose texts take about GROUP_BYTES together."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(size // GROUP_BYTES) + 1
    for g in range(groups):
        own = texts if groups == 1 else texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        found = [(r["item_id"], terms(r["text"].encode())) for r in own.collect()]
        if found:
            yield found


def _counted(vocabulary: dict[bytes, int]):
    """Per document: doc_id, its number of terms, and packed numbers and occurrences of the terms in `vocabulary`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, term, tf = [], [], []
            for text in text_bytes(batch.column(1)):
                own = terms(text)
                size.append(len(own))
                found = np.fromiter(map(vocabulary.get, own, repeat(-1)), dtype=np.int32, count=len(own))
                number, times = np.unique(found[found >= 0], return_counts=True)
                term.append(number.tobytes())
                tf.append(times.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "term", "tf"])

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df): documents that hold each term, summed within the task."""
    df = np.zeros(0, dtype=np.int64)
    for batch in batches:
        numbers = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32)
        if len(numbers):
            counts = np.bincount(numbers, minlength=len(df))
            counts[: len(df)] += df
            df = counts
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])


class Heap:
    """The best `top` of (score, doc_id), higher scores first, then smaller ids; repeats are kept."""

    def __init__(self, top: int):
        self.top, self.held = top, []

    def floor(self) -> int:
        """A score below this cannot enter."""
        return self.held[0][0] if len(self.held) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.top:  # the best of a window, all ties at its edge included
            edge = np.partition(scores, len(scores) - self.top)[-self.top]
            keep = scores >= edge
            scores, ids = scores[keep], ids[keep]
        for score, doc in zip(scores.tolist(), ids.tolist(), strict=True):
            entry = (score, -doc)
            if len(self.held) < self.top:
                heapq.heappush(self.held, entry)
            elif entry > self.held[0]:
                heapq.heapreplace(self.held, entry)


def score_window(items: list[tuple[np.ndarray, np.ndarray]], heaps: list[Heap], ids, n, term, tf, weight, total_docs: int, total_terms: int) -> None:
    """Score one window of documents for every item. `term` and `tf` are one array a document; an item is (terms, occurrences)."""
    slots = len(ids)
    m = 75 + (25 * n * total_docs) // total_terms
    lengths = np.fromiter(map(len, term), dtype=np.int64, count=slots)
    slot = np.repeat(np.arange(slots), lengths)
    number, times = np.concatenate(term), np.concatenate(tf).astype(np.int64)
    order = np.argsort(number, kind="stable")
    number, slot, times = number[order], slot[order], times[order]
    gain = weight[number] * ((SCALE * times) // (1000 * times + 12 * m[slot]))
    there, starts = np.unique(number, return_index=True)
    ends = np.append(starts[1:], len(number))
    place = np.full(len(weight), -1, dtype=np.int64)
    place[there] = np.arange(len(there))
    bits = np.zeros((len(there), (slots + 7) // 8), dtype=np.uint8)
    most = np.zeros(len(there), dtype=np.int64)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        row = np.zeros(slots, dtype=bool)
        row[slot[a:b]] = True
        bits[k] = np.packbits(row)
        most[k] = gain[a:b].max()
    bucket = np.zeros(slots, dtype=np.int64)
    for (own, repeats), heap in zip(items, heaps, strict=True):
        at = place[own]
        at, repeats = at[at >= 0], repeats[at >= 0]
        if not len(at) or int((most[at] * repeats).sum()) < heap.floor():
            continue
        for k, times_in_item in zip(at.tolist(), repeats.tolist(), strict=True):
            span = slice(starts[k], ends[k])
            bucket[slot[span]] += gain[span] * times_in_item
        occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[at], axis=0), count=slots))
        scores = bucket[occupied]
        good = scores >= heap.floor()
        heap.add(scores[good], ids[occupied[good]])
        bucket[occupied] = 0


def _scored(items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, total_docs: int, total_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in items]
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy()
            n = batch.column(1).to_numpy()
            term, tf = ([np.frombuffer(x, dtype=np.int32) for x in batch.column(k).to_pylist()] for k in (2, 3))
            for a in range(0, batch.num_rows, WINDOW):
                b = a + WINDOW
                score_window(items, heaps, ids[a:b], n[a:b], term[a:b], tf[a:b], weight, total_docs, total_terms)
        rows = [(k, score, None if doc == -LAST else -doc) for k, heap in enumerate(heaps) for score, doc in heap.held]
        item, score, doc = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _search_group(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, own in items for w in own))}
    counted = materialise(text_rows(docs).mapInArrow(_counted(vocabulary), "doc_id long, n long, term binary, tf binary"), "postings")
    total_docs, total_terms = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counted.select("term").mapInArrow(_document_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2 * total_docs + 2) / (2 * df + 1))).astype(np.int64)
    asked = []
    for _, own in items:
        times = Counter(vocabulary[w] for w in own)
        asked.append((np.fromiter(times.keys(), dtype=np.int64, count=len(times)), np.fromiter(times.values(), dtype=np.int64, count=len(times))))
    # a doc_id of many rows is spread over ranges by its postings
    dealt = counted.filter(F.octet_length("term") > 0).repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("term", "tf")).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    found = dealt.mapInArrow(_scored(asked, weight, total_docs, max(1, total_terms), top), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` best documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in item_groups(spark, items):
        out = out.unionByName(_search_group(docs, group, top))
    return out
