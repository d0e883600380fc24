"""Packing documents into fixed windows by minimum bin slack.

A document's ids, closed by an end id, are cut into full windows and one remainder. Full windows are sequences as they are.
Remainders are packed by their lengths alone: there are fewer lengths than the window has places, so the number of
remainders of each length is a small histogram however large the corpus. For each window the plan starts from the longest
length left, lets a bitset dynamic programme find the sums that the multiset of other lengths can reach, takes the one
closest to capacity, backtracks how many of each length it needs, and uses that pattern as often as the counts allow.
Every use leaves some length with less than the pattern needs, so the plan has a few rows per length, not per document.

Pieces then find their place by rank among pieces of their length: a distributed running count, and a binary search in the
plan, whose size is bounded by the window (it is what the tasks carry along, whatever the input).

Cases: null and empty texts are the end id alone; very long texts are cut into as many windows as they fill; rows that repeat an id are packed as documents of their own; an empty
table gives an empty result; ties of length are ordered by (hash, id, start); columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import TOTAL_BUCKETS, materialise, running_total, text_rows
from signalloom.llm.tokenise import encoder, tokenizer_path, with_end

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
RANK_BITS = 44


def _cut(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for first, ids, counts in encode(batch.column(1)):
                ids, at = with_end(ids, counts, end_id)
                total = np.diff(at)
                pieces = -(-total // window)
                doc = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(total[doc] - start, window)
                begin = at[:-1][doc] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(first, len(total)).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = text_rows(docs)
    return rows.mapInArrow(_cut(tokenizer or tokenizer_path(VOCABULARY), end_id, window), PIECES)


def fill(counts: dict[int, int], seed: int, window: int) -> dict[int, int]:
    """How many of each length make the window with `seed` in it as full as it can be."""
    room = window - seed
    if room == 0:
        return {seed: 1}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = counts[length] - (length == seed)
        left = min(left, room // length)
        part = 1
        while left > 0:  # binary splitting: 1, 2, 4, … pieces of this length as one item
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {seed: 1}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, uses, pieces per use, first sequence, offset of its first piece in the window)."""
    left, ranks, rows, sequence = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while left:
        pattern = fill(left, max(left), window)
        uses = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, ranks[length], uses, n, sequence, offset))
            ranks[length] += uses * n
            offset += length * n
            left[length] -= uses * n
            if not left[length]:
                del left[length]
        sequence += uses
    return rows


def _place(rows: list[tuple[int, ...]]):
    table = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 6)
    keys = (table[:, 0] << RANK_BITS) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1]
            since = rank - row[:, 1]
            sequence, offset = row[:, 4] + since // row[:, 3], row[:, 5] + since % row[:, 3] * length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the place of every piece."""
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, window), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length, at most `window`
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(TOTAL_BUCKETS))).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(dealt, ["length"], "bucket", ["doc_id", "start", "ids_crc32"], "one", "nth")
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place(plan(counts, window)), f"{PIECES}, sequence_id long, offset long")
