"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

Model. P(w | h) = a(h) c(h, w) / c(h) + (1 - a(h)) (b c(w) / N + (1 - b) / (V + 1)): maximum-likelihood estimates of falling
order, mixed by weights that depend on how often the context h was seen (buckets of powers of two). The weights are learned
by expectation-maximisation on deleted counts: the training texts of one fold are held out, counts are taken from the other
training texts, and the held-out words say how far each order can be trusted. Scores then use the counts of all training texts.

Exchange. Words and bigrams outnumber what a row each could carry, so documents travel in blocks. A block holds its words as
local numbers, and sends to each part of the hash space one packed message: the sorted hashes of its distinct words or bigrams
and their counts. A part adds up the counts of all blocks and answers each message with the totals in the same order. A block
scores its documents with the answers. Counts of a hot word are summed within each block first: it costs its part one entry
for each block. All rows of all texts are counted. Blocks and parts hold BLOCK_TOKENS and PART_ENTRIES up to SIZED_TOKENS tokens,
and grow with the fourth root of the corpus beyond, so that the number of messages, blocks times parts, grows with its power
1.5 (at 10^12 tokens a block holds 8 million tokens, and 120,000 blocks meet 60,000 parts). Sizes change no result.

A text's tokens are its words, lower-cased in A-Z, and one end; its first context is a start that is no token.

Cases: null and empty texts are the end alone; a null doc_id is folded as the empty text; repeated rows are documents of
their own; without training texts every score falls back to the uniform estimate; an empty table gives an empty result;
very long texts are scored whole, and a block passes its size by the end of one document at most; equal counts weigh equally,
there is no order among ties; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import fold_of, materialise, text_bytes, text_rows

FOLDS = 10
BLOCK_TOKENS = 1_000_000
PART_ENTRIES = 2_000_000
CONTEXT_BUCKETS = 64  # powers of two of a 64-bit count: no context shares a bucket for want of one
SIZED_TOKENS = 200_000_000
RATIO_BINS = 512
RATIO_SPAN = 64.0  # binary orders of magnitude that the bins of a ratio cover
EM_ROUNDS = 200
TEST, HELD, REST = 0, 1, 2
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
BLOCKS = "block string, role int, doc_ids binary, lengths binary, tokens binary, words binary, n_tokens long"
MESSAGES = "part int, block string, role int, kind int, at int, hashes binary, counts binary"


def role_of(doc_id: int | None) -> int:
    return {0: TEST, 1: HELD}.get(fold_of(doc_id, FOLDS), REST)


def mix_hash(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix_hash(mix_hash(left) + np.uint64(0x9E3779B97F4A7C15) * right)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned longs as differences, byte planes apart, so that the shuffle's compression finds the zeros."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int64)


class BlockBuilder:
    """Documents of one role, with their words numbered as they come."""

    def __init__(self, role: int, name: str):
        self.role, self.name, self.n = role, name, 0
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict = defaultdict(itertools.count(1).__next__)  # 0 is the end
        self.doc_ids, self.lengths, self.tokens, self.size = [], [], [], 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        ids = np.zeros(len(words) + 1, dtype="<u4")
        ids[:-1] = np.fromiter(map(self.numbers.__getitem__, words), dtype="<u4", count=len(words))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.tokens.append(ids)
        self.size += len(ids)

    def row(self) -> tuple:
        from xxhash import xxh64_intdigest

        self.n += 1
        hashes = np.empty(len(self.numbers) + 1, dtype="<u8")
        hashes[0] = END
        hashes[1:] = np.fromiter(map(xxh64_intdigest, self.numbers), dtype=np.uint64, count=len(self.numbers))
        known = pa.array(self.doc_ids, pa.int64())
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([known], names=["doc_id"]))
            ids = sink.getvalue().to_pybytes()
        tokens = np.concatenate(self.tokens)
        planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes()
        out = (f"{self.name}-{self.n}", self.role, ids, np.asarray(self.lengths, dtype="<u4").tobytes(), planes, hashes.tobytes(), len(tokens))
        self.clear()
        return out


def growth(tokens: float) -> float:
    """How much larger than their least sizes blocks and parts are."""
    return max(1.0, tokens / SIZED_TOKENS) ** 0.25


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _into_blocks(batches, block_tokens)

    return run


def _into_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    building = [BlockBuilder(role, f"{part}-{role}") for role in (TEST, HELD, REST)]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    wrap = lambda row: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            block = building[role_of(doc_id)]
            block.add(doc_id, text.lower().split())
            if block.size >= block_tokens:
                yield wrap(block.row())
    for block in building:
        if block.size:
            yield wrap(block.row())


class Block:
    """A block read back: token numbers, word hashes, and the distinct words and bigrams in message order."""

    def __init__(self, row: dict):
        self.role, self.name = row["role"], row["block"]
        self.doc_ids = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
        self.lengths = np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)
        self.tokens = np.ascontiguousarray(np.frombuffer(row["tokens"], dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        self.hashes = np.frombuffer(row["words"], dtype="<u8")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes and counts of the distinct words, and each token's place among them."""
        scrambled = mix_hash(self.hashes)
        order = np.argsort(scrambled)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return scrambled[order], np.bincount(self.tokens, minlength=len(order))[order], place[self.tokens]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for bigrams; the context of a document's first token is the start."""
        width = len(self.hashes)
        left = np.empty_like(self.tokens)
        left[1:] = self.tokens[:-1]
        left[self.starts] = width
        keys, where, counts = np.unique(left * width + self.tokens, return_inverse=True, return_counts=True)
        hashed = pair_hash(np.append(self.hashes, START)[keys // width], self.hashes[keys % width])
        order = np.argsort(hashed)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return hashed[order], counts[order], place[where]


def part_bounds(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's hashes begin in a sorted array."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _messages(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MESSAGES.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for kind, (hashes, counts, _) in enumerate((block.words(), block.bigrams())):
                    bounds = part_bounds(hashes, parts)
                    rows = [
                        (p, block.name, block.role, kind, int(a), squeeze(hashes[a:b]), pack_counts(counts[a:b]))
                        for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
                        if b > a
                    ]
                    for at in range(0, len(rows), 64):
                        columns = zip(*rows[at : at + 64], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


ANSWERS = "block string, role int, kind int, at int, train binary, rest binary, n_entries long, n_types long, n_tokens long, n_rest long, rest_types long"


def _answer(group: pa.Table) -> pa.Table:
    """All messages of one part and kind: the training count (and for held-out blocks the rest's count) of every entry."""
    rows = group.to_pylist()
    hashes = [unsqueeze(r["hashes"]) for r in rows]
    counts = [unpack_counts(r["counts"]) for r in rows]
    sizes = np.asarray([len(h) for h in hashes])
    keys, where = np.unique(np.concatenate(hashes), return_inverse=True)
    roles = np.repeat([r["role"] for r in rows], sizes)
    every = np.concatenate(counts)
    rest = np.bincount(where, np.where(roles == REST, every, 0), minlength=len(keys)).astype(np.int64)
    train = rest + np.bincount(where, np.where(roles == HELD, every, 0), minlength=len(keys)).astype(np.int64)
    out, at = [], 0
    for i, (r, n) in enumerate(zip(rows, sizes, strict=True)):
        own = where[at : at + n]
        at += n
        totals = (len(keys), int((train > 0).sum()), int(train.sum()), int(rest.sum()), int((rest > 0).sum())) if i == 0 else (0, 0, 0, 0, 0)
        out.append((r["block"], r["role"], r["kind"], r["at"], pack_counts(train[own]), pack_counts(rest[own]) if r["role"] == HELD else None, *totals))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _gather(answers: list[dict], kind: int, field: str) -> np.ndarray:
    own = sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["at"])
    return np.concatenate([unpack_counts(r[field]) for r in own])


class Counts:
    """Per token of a block: counts of the word, the context and the bigram."""

    def __init__(self, block: Block, answers: list[dict], field: str, documents: int):
        _, _, word = block.words()
        _, _, pair = block.bigrams()
        self.word = _gather(answers, 0, field)[word]
        self.pair = _gather(answers, 1, field)[pair]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[block.starts] = documents  # the start was seen once in each training document


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), CONTEXT_BUCKETS - 1).astype(np.int64)


def ratio_bin(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bin of log2(high / low); bin 0 is high = 0."""
    with np.errstate(divide="ignore"):
        order = np.log2(np.maximum(high, 1e-300) / low)
    return np.where(high > 0, np.clip((order + RATIO_SPAN / 2) * (RATIO_BINS - 2) / RATIO_SPAN, 0, RATIO_BINS - 2).astype(np.int64) + 1, 0)


def bin_ratio() -> np.ndarray:
    middle = 2.0 ** ((np.arange(RATIO_BINS - 1) + 0.5) * RATIO_SPAN / (RATIO_BINS - 2) - RATIO_SPAN / 2)
    return np.concatenate([[0.0], middle])


def em_weight(counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """For each row of a histogram of high / low ratios, the weight of the higher estimate."""
    ratio, weight = bin_ratio(), np.full(len(counts), 0.5)
    totals = counts.sum(1)
    for _ in range(rounds):
        share = weight[:, None] * ratio / (weight[:, None] * ratio + 1 - weight[:, None])
        weight = np.clip(np.where(totals > 0, (counts * share).sum(1) / np.maximum(totals, 1), weight), 1e-6, 1 - 1e-6)
    return weight


class Interpolation:
    """The learned weights and the corpus totals; `lower` and `probability` give the estimates."""

    def __init__(self, n_tokens: int, n_types: int):
        self.n, self.v = n_tokens, n_types
        self.unigram_weight = 0.5
        self.bigram_weights = np.full(CONTEXT_BUCKETS, 0.5)

    def lower(self, word: np.ndarray) -> np.ndarray:
        uniform = (1 - self.unigram_weight) / (self.v + 1)
        return uniform + (self.unigram_weight * word / self.n if self.n else uniform * 0)

    def probability(self, counts: Counts) -> np.ndarray:
        weight = np.where(counts.context > 0, self.bigram_weights[bucket_of(counts.context)], 0.0)
        return weight * counts.pair / np.maximum(counts.context, 1) + (1 - weight) * self.lower(counts.word)


def _histogram(totals: Interpolation, documents: int, second: bool):
    """Held-out words by bucket and by ratio of the higher to the lower estimate."""

    def run(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        out = np.zeros((CONTEXT_BUCKETS, RATIO_BINS))
        for row in block_rows.to_pylist():
            counts = Counts(Block(row), answer_rows.to_pylist(), "rest", documents)
            if second:
                at = counts.context > 0
                high = counts.pair[at] / counts.context[at]
                np.add.at(out, (bucket_of(counts.context[at]), ratio_bin(high, totals.lower(counts.word[at]))), 1)
            else:
                uniform = np.full(len(counts.word), 1 / (totals.v + 1))
                out[0] += np.bincount(ratio_bin(counts.word / max(totals.n, 1), uniform), minlength=RATIO_BINS)
        bucket, bin_ = np.nonzero(out)
        return pa.table([pa.array(bucket), pa.array(bin_), pa.array(out[bucket, bin_])], names=["bucket", "bin", "n"])

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Interpolation, documents: int):
    def run(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        tables = []
        for row in block_rows.to_pylist():
            block = Block(row)
            counts = Counts(block, answer_rows.to_pylist(), "train", documents)
            known = np.add.reduceat((counts.word > 0).astype(np.int64), block.starts)
            base = np.add.reduceat(np.log10((counts.word + 0.1) / (model.n + 0.1 * (model.v + 1))), block.starts)
            score = np.add.reduceat(np.log10(model.probability(counts)), block.starts)
            n = len(block.lengths)
            columns = [block.doc_ids, np.full(n, block.role == TEST), block.lengths, known, np.full(n, model.n), base, score]
            tables.append(pa.table([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds, strict=True)], names=names))
        return pa.concat_tables(tables) if tables else pa.schema(list(zip(names, kinds, strict=True))).empty_table()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = text_rows(docs)
    # a token takes five bytes or more with its blank; the sum only sets sizes
    large = growth((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 5)
    blocks = materialise(rows.mapInArrow(_blocks(int(BLOCK_TOKENS * large)), BLOCKS), "blocks")
    sizes = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(8, int(-(-sizes // (PART_ENTRIES * large))))
    messages = blocks.mapInArrow(_messages(parts), MESSAGES)
    answers = materialise(messages.groupBy("part", "kind").applyInArrow(_answer, ANSWERS), "answers")
    told = answers.filter("kind = 0").agg(F.sum("n_tokens"), F.sum("n_types"), F.sum("n_rest"), F.sum("rest_types")).first()
    n, v, n_rest, v_rest = (int(x or 0) for x in told)
    by_role = {r["role"]: r["n"] for r in blocks.groupBy("role").agg(F.sum(F.length("lengths") / 4).cast("long").alias("n")).collect()}
    documents = by_role.get(REST, 0) + by_role.get(HELD, 0)
    own = ["block", "role", "kind", "at"]

    learned = Interpolation(n_rest, v_rest)
    for second in (False, True):
        held = blocks.filter(F.col("role") == HELD).groupBy("block").cogroup(answers.filter(F.col("role") == HELD).select(*own, "rest").groupBy("block"))
        counted = held.applyInArrow(_histogram(learned, by_role.get(REST, 0), second), "bucket long, bin long, n double")
        cells = counted.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect()  # at most CONTEXT_BUCKETS x RATIO_BINS cells
        histogram = np.zeros((CONTEXT_BUCKETS, RATIO_BINS))
        for c in cells:
            histogram[c["bucket"], c["bin"]] = c["n"]
        if second:
            learned.bigram_weights = em_weight(histogram)
        else:
            learned.unigram_weight = float(em_weight(histogram)[0])
    model = Interpolation(n, v)
    model.unigram_weight, model.bigram_weights = learned.unigram_weight, learned.bigram_weights
    paired = blocks.groupBy("block").cogroup(answers.select(*own, "train").groupBy("block"))
    return paired.applyInArrow(_scores(model, documents), RESULT)
