"""SimHash near-duplicates found by multi-index hashing.

Fingerprint. The text is lower-cased in A-Z, its word shingles (repeats included) are hashed with XXH64, and a bit is 1 when
more than half the hashes have it.

Links. A 64-bit fingerprint is cut into two segments. Two fingerprints that differ in at most three bits differ in at most
one bit in one of the segments. Each distinct fingerprint is stored under both of its segment values; each enumerates the
ball of radius 1 around them and fetches the table's matches, which are verified over all 64 bits. Of two values that
differ in one bit exactly one has it set, so a probe only clears set bits, and equal values are compared in one direction.

Dense buckets. A segment value held by more than BUCKET fingerprints (a large group of near copies) is taken out of the
table, with a marker left in its place; its members, and whoever probes it, are linked by another exact way. The 64 bits are
cut into ten blocks; three differing bits lie in at most three of them, so two linked fingerprints agree on the other
blocks for one of 120 choices. Rows are dealt by (choice, kept bits); what agrees differs in at most 21 bits, so a group is
bounded whatever the input, and a group yields a spanning tree of its links, never its pairs.

Near copies. The stage that drops near copies (`keep_one`) asks for a similarity of 0.8 of five-word shingles, at which 64 bits
differ in some ten places. It takes fingerprints of 192 bits in eight segments of 24. Every fingerprint stands under the 25
values of the ball of radius 1 around each segment, so that segments at distance two or less meet half-way; what meets is
verified over all 192 bits. Texts of similarity 0.8 differ in 29 bits on average and pass up to 34.

Cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle make one shingle
of all words; equal texts and repeated rows share a fingerprint; rows with null ids are kept, and count for a component's id
only if it has no other; very long texts are hashed whole, in bounded parts; ties in a vote are zeros; an empty table gives
an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, free_names, join_groups, materialise, text_bytes, text_rows
from signalloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BUCKET = 64
BLOCKS = (6, 6, 6, 6, 6, 6, 7, 7, 7, 7)
PAIRWISE = 1024
HELD_HASHES = 1 << 17
#: Near copies (`keep_one`): shingles, fingerprint, segments, and the largest complete distance.
LONG_SHINGLE = 5
LONG_WORDS = 3
PRINT = tuple(f"p{k}" for k in range(LONG_WORDS))
SEGMENT_BITS = 24
LONG_SEGMENTS = LONG_WORDS * 64 // SEGMENT_BITS
LONG_DISTANCE = 34
SHIFTS = 32
#: Fingerprints of one key that a task links at once; a larger key is dealt into chunks of that many.
FULL = 4096


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= size:
        return np.asarray([xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    stops = (ends - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops[size - 1 :], strict=False)), dtype=np.uint64, count=len(words) - size + 1)


def vote(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes."""
    lengths = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        every = np.concatenate([hashes[i] for i in full])
        bits = np.unpackbits(every.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        ones = counts * 2 > lengths[full][:, None]
        out[full] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, held, n = [], [], 0
            for text in text_bytes(batch.column(1)):
                held.append(shingle_hashes(text, size))
                n += len(held[-1])
                if n > HELD_HASHES:
                    prints.append(vote(held))
                    held, n = [], 0
            prints.append(vote(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text as a long."""
    rows = text_rows(docs)
    return rows.mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _segments(prints: DataFrame) -> DataFrame:
    return prints.select("fp", F.expr("inline(array(struct(0 as seg, fp & 4294967295 as val), struct(1 as seg, shiftrightunsigned(fp, 32) as val)))"))


def _balls(table: DataFrame) -> DataFrame:
    """Each segment value with itself and every value that lacks one of its set bits."""
    cleared = "filter(transform(sequence(0, 31), i -> val & ~shiftleft(1L, i)), v -> v != val)"
    return table.selectExpr("fp as a", "seg", "val as own", f"explode(concat(array(val), {cleared})) as val")


def meet(stored: DataFrame, index: DataFrame) -> DataFrame:
    """Each fingerprint with the rows of the index under the values of its balls. Always by sort and merge: Spark takes a side's size from
    the files it came from, but a ball has some 17 values, so a broadcast thought small would fill the driver."""
    return _balls(stored).join(index.hint("merge"), ["seg", "val"])


def _tree(values: np.ndarray, mask: int) -> np.ndarray:
    """For each value (all alike outside `mask`), the position of the root of its component at DISTANCE or less."""
    n = len(values)
    root = np.full(n, -1, dtype=np.int64)
    if n <= PAIRWISE:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= DISTANCE
        for i in range(n):
            if root[i] < 0:
                front = np.asarray([i])
                root[i] = i
                while len(front):
                    front = np.flatnonzero(near[front].any(0) & (root < 0))
                    root[front] = i
        return root
    free = [b for b in range(64) if mask >> b & 1]
    small = np.zeros(n, dtype=np.int64)
    for to, b in enumerate(free):
        small |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << to
    place = np.full(1 << len(free), -1, dtype=np.int64)
    place[small] = np.arange(n)
    steps = np.asarray([sum(1 << b for b in c) for r in range(1, DISTANCE + 1) for c in combinations(range(len(free)), r)])
    for i in range(n):
        if root[i] < 0:
            front = np.asarray([i])
            root[i] = i
            while len(front):
                found = []
                for part in np.array_split(front, len(front) // 512 + 1):
                    at = place[(small[part][:, None] ^ steps).ravel()]
                    at = np.unique(at[at >= 0])
                    at = at[root[at] < 0]
                    root[at] = i
                    found.append(at)
                front = np.concatenate(found)
    return root


def masks() -> list[int]:
    """The bits of each choice of three blocks."""
    ends = np.cumsum(BLOCKS)
    bits = [((1 << w) - 1) << int(e - w) for w, e in zip(BLOCKS, ends, strict=True)]
    return [a | b | c for a, b, c in combinations(bits, DISTANCE)]


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free = np.asarray(masks(), dtype=np.uint64)
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for part in np.array_split(prints, len(prints) // 4096 + 1):
            kept = part[:, None] & ~free
            choice = np.tile(np.arange(len(free), dtype=np.int32), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(choice), pa.array(kept.ravel().view(np.int64)), pa.array(np.repeat(part, len(free)).view(np.int64))], names=["choice", "kept", "fp"])


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (choice, kept); the last group of a batch may go on in the next."""
    free = masks()
    rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, dtype=t) for t in (np.int32, np.int64, np.int64))

    def links(choice, kept, fp):
        if not len(fp):
            return None
        new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (kept[1:] != kept[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        u, v = [], []
        for at, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            own = fp[at : at + n]
            if n == 2:
                root = np.asarray([0, 0 if int(own[0] ^ own[1]).bit_count() <= DISTANCE or np.bitwise_count(own[:1].view(np.uint64) ^ own[1:].view(np.uint64))[0] <= DISTANCE else 1])
            else:
                root = _tree(own.view(np.uint64), free[choice[at]])
            joined = root != np.arange(n)
            u.append(own[joined])
            v.append(own[root[joined]])
        if not u:
            return None
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    for batch in batches:
        columns = tuple(np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
        choice, kept, _ = columns
        cut = len(choice)
        if cut:
            last = (choice == choice[-1]) & (kept == kept[-1])
            cut -= int(np.argmin(last[::-1])) if not last.all() else cut
        if (out := links(*(c[:cut] for c in columns))) is not None:
            yield out
        rest = tuple(c[cut:] for c in columns)
    if (out := links(*rest)) is not None:
        yield out


def dense_links(prints: DataFrame) -> DataFrame:
    """(u, v): trees over all links within the distinct fingerprints `fp`, by the choices of blocks."""
    dealt = prints.mapInArrow(_choices, "choice int, kept long, fp long").repartition("choice", "kept")
    return dealt.sortWithinPartitions("choice", "kept").mapInArrow(_group_links, "u long, v long").distinct()


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints `fp` exactly as all links at DISTANCE or less do."""
    stored = _segments(prints)
    dense = stored.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("seg", "val")
    dense = materialise(dense, "dense")
    index = stored.join(dense, ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("b"), F.lit(False).alias("marked"))
    index = index.unionByName(dense.select("seg", "val", F.lit(None).cast("long").alias("b"), F.lit(True).alias("marked")))
    met = meet(stored, index)
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE) & ((F.col("own") != F.col("val")) | (F.col("a") < F.col("b")))
    met = materialise(met.filter(F.col("marked") | close).select("a", "b", "marked"), "met")
    edges = met.filter("not marked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if dense.isEmpty():
        return edges
    members = stored.join(dense, ["seg", "val"], "left_semi").select("fp").unionByName(met.filter("marked").select(F.col("a").alias("fp"))).distinct()
    return edges.unionByName(dense_links(members))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id of every document: the smallest doc_id that its fingerprint reaches over links."""
    rows = materialise(fingerprints(docs, size), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = connected_components(links(prints.select("fp"), bucket))
    linked = prints.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    alone = prints.join(named, F.col("fp") == F.col("__fp"), "left")
    classes = materialise(alone.select("fp", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return join_groups(rows, classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def long_votes(text: bytes) -> np.ndarray:
    """The fingerprint of LONG_WORDS x 64 bits of a text's LONG_SHINGLE-word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(LONG_WORDS, dtype=np.uint64)
    known = {w: xxh64_intdigest(w, SEED) for w in set(words)}
    one = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(one) - LONG_SHINGLE + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(min(LONG_SHINGLE, len(one))):
        mixed = scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n])
    counts = np.zeros((LONG_WORDS, 64), dtype=np.int64)
    for at in range(0, n, HELD_HASHES):  # very long texts are counted in parts
        part = mixed[at : at + HELD_HASHES]
        for k in range(LONG_WORDS):
            bits = np.unpackbits(scramble(part + np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.asarray([long_votes(t) for t in text_bytes(batch.column(1))], dtype=np.uint64).reshape(-1, LONG_WORDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(prints[:, k].view(np.int64)) for k in range(LONG_WORDS))], names=["doc_id", "digest", *PRINT])


def long_segments(prints: np.ndarray) -> np.ndarray:
    """n x LONG_SEGMENTS: the segments' values."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    cut = bits.reshape(len(prints), LONG_SEGMENTS, SEGMENT_BITS).astype(np.int64)
    return (cut << np.arange(SEGMENT_BITS)).sum(2)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under every value of the ball of radius 1 around each of its segments: two segments that differ in
    two bits or fewer meet in a value that both balls hold."""
    steps = np.concatenate([[0], 1 << np.arange(SEGMENT_BITS)])
    place = np.arange(LONG_SEGMENTS) << SEGMENT_BITS
    for batch in batches:
        prints = np.stack([batch.column(k).to_numpy() for k in range(LONG_WORDS)], axis=1)
        for part in np.array_split(prints, len(prints) // 512 + 1):
            keys = ((long_segments(part)[:, :, None] ^ steps) + place[:, None]).reshape(len(part), -1)
            repeated = np.repeat(part, keys.shape[1], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), *(pa.array(repeated[:, k]) for k in range(LONG_WORDS))], names=["key", *PRINT])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def bucket_links(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links that connect the fingerprints of each key as all pairs at LONG_DISTANCE or less do. Rows are
    sorted by key, then fingerprint. Small keys are compared by shifts, all at once, and of their near pairs a spanning forest is
    taken; a large key grows its components from member to member. So a key yields fewer links than it has members, and as both
    begin with the smallest fingerprints, the many keys of one group yield much the same links."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(new, len(key)))
    small = np.repeat(sizes <= SHIFTS, sizes)
    left, right = [], []
    for shift in range(1, min(SHIFTS, int(sizes.max(initial=0)))):
        at = np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift]))
        at = at[_far(prints[at], prints[at + shift]) <= LONG_DISTANCE]
        left.append(at)
        right.append(at + shift)
    if left:
        one, two = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((two, one))
        at: dict[int, int] = {}

        def root(x: int) -> int:
            while at.setdefault(x, x) != x:
                at[x] = at[at[x]]
                x = at[x]
            return x

        forest = []
        for i, j in zip(one[order].tolist(), two[order].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                at[max(a, b)] = min(a, b)
                forest.append((i, j))
        left, right = ([np.asarray([p[k] for p in forest], dtype=np.int64)] for k in (0, 1))
    for start, n in zip(new[sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist(), strict=True):
        own, rest = prints[start : start + n], np.arange(1, n)
        front = [0]
        while len(rest) or front:
            if not front:
                front, rest = [int(rest[0])], rest[1:]
            i = front.pop(0)
            near = _far(own[rest], own[i]) <= LONG_DISTANCE
            reached = rest[near]
            left.append(np.full(len(reached), start + i))
            right.append(start + reached)
            front.extend(reached.tolist())
            rest = rest[~near]
            if not len(rest):
                break
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


#: Columns of what a task returns: a link (u, v), or with `full` a row of a key that is too large for a task, its key in place of v's first word.
LINKED = ("full", *(f"{side}{p}" for side in "uv" for p in PRINT))


def _meeting_links(full: int):
    """Rows come sorted by key; the last key of a batch may go on in the next. A key of more than `full` rows is not linked
    but handed on row by row, so a task holds no more of a key than that and a batch."""

    def out(of_full: bool, pairs: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in range(2 * LONG_WORDS)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), of_full)), *columns], names=list(LINKED))

    def handed_on(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        rows = np.zeros((len(key), 2 * LONG_WORDS), dtype=np.uint64)
        rows[:, :LONG_WORDS], rows[:, LONG_WORDS] = prints, key.astype(np.int64).view(np.uint64)
        return out(True, rows)

    def linked(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        i, j = bucket_links(key, prints)
        return out(False, np.unique(np.concatenate([prints[i], prints[j]], axis=1), axis=0) if len(i) else np.zeros((0, 2 * LONG_WORDS), dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest, over = np.zeros(0, dtype=np.int32), np.zeros((0, LONG_WORDS), dtype=np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            prints = np.concatenate([rest, np.stack([batch.column(1 + k).to_numpy() for k in range(LONG_WORDS)], axis=1).view(np.uint64)])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            last = key[-1]
            large = np.repeat((sizes > full) | (key[starts] == over), sizes)
            if large.any():
                yield handed_on(key[large], prints[large])
            over = last if large[-1] else None
            open_key = (key == last) & ~large  # may go on in the next batch
            closed = ~large & ~open_key
            yield linked(key[closed], prints[closed])
            rest_key, rest = key[open_key], prints[open_key]
        yield linked(rest_key, rest)

    return run


def _full_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups (key, one, two) of at most two chunks; rows come sorted by group."""
    held: list[np.ndarray] = []
    group = None

    def linked():
        prints = np.concatenate(held)
        i, j = bucket_links(np.zeros(len(prints), dtype=np.int32), prints)
        pairs = np.concatenate([prints[i], prints[j]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in range(2 * LONG_WORDS)], names=list(LINKED[1:]))

    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        prints = np.stack([batch.column(3 + k).to_numpy() for k in range(LONG_WORDS)], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1)]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            if group is not None and tuple(at[a]) != group:
                yield linked()
                held = []
            group = tuple(at[a])
            held.append(prints[a:b])
    if held:
        yield linked()


def full_key_links(rows: DataFrame, chunk: int) -> DataFrame:
    """Links among the rows (key, fingerprint) of keys too large for a task: a key's rows are dealt into chunks of about `chunk` by
    a hash, and every two chunks meet in a task of their own. What connects a key's fingerprints connects them here, too, as
    each pair is together in some task."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks"))
    own = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(*PRINT), F.col("chunks")))
    met = own.select("key", *PRINT, "own", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    met = met.filter("own != other or chunks = 1")  # of several chunks, each meets itself when it meets another
    met = met.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), *PRINT)
    schema = ", ".join(f"{c} long" for c in LINKED[1:])
    return met.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", *PRINT).mapInArrow(_full_links, schema)


def similar_groups(docs: DataFrame, full: int = FULL) -> DataFrame:
    """doc_id, digest, component (struct of doc_id and digest): every document with the first one of its group of near copies.

    Documents are near copies when the fingerprints of their LONG_SHINGLE-word shingles differ in at most LONG_DISTANCE of
    LONG_SEGMENTS x SEGMENT_BITS bits, and groups are what such links connect."""
    bounded_batches(docs.sparkSession)
    rows = text_rows(docs).withColumn("digest", F.xxhash64("text"))
    rows = materialise(rows.mapInArrow(_long_fingerprints, "doc_id long, digest long, " + ", ".join(f"{p} long" for p in PRINT)), "long_prints")
    first = rows.groupBy(*PRINT).agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    prints = materialise(first.withColumn("node", F.monotonically_increasing_id()), "long_nodes")
    met = prints.select(*PRINT).mapInArrow(_meetings, "key int, " + ", ".join(f"{p} long" for p in PRINT))
    schema = "full boolean, " + ", ".join(f"{c} long" for c in LINKED[1:])
    found = materialise(met.repartition("key").sortWithinPartitions("key", *PRINT).mapInArrow(_meeting_links(full), schema).distinct(), "long_links")
    linked, large = found.filter("not full").drop("full"), found.filter("full")
    if not large.isEmpty():
        crowded = large.select(F.col(f"v{PRINT[0]}").alias("key"), *[F.col(f"u{p}").alias(p) for p in PRINT])
        linked = materialise(linked.unionByName(full_key_links(crowded, full)).distinct(), "long_links")
    named = lambda side: prints.select(*[F.col(p).alias(f"{side}{p}") for p in PRINT], F.col("node").alias(side))
    edges = linked.join(named("u"), [f"u{p}" for p in PRINT]).join(named("v"), [f"v{p}" for p in PRINT]).select("u", "v")
    roots = connected_components(edges)
    member = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialise(member.groupBy("root").agg(F.min("first").alias("component")), "long_groups")
    classes = member.select(*PRINT, "root").join(least, "root").select(*PRINT, "component")
    return rows.join(classes, list(PRINT)).select("doc_id", "digest", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the document with the smallest id (of several rows of that id the one with the smallest
    text hash), with all its columns; rows that repeat both are one document and stay once."""
    doc, digest, own_doc, own_digest = free_names(docs, "__doc", "__digest", "__own_doc", "__own_digest")
    component = F.struct(F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"))
    groups = materialise(similar_groups(docs).filter(component == F.col("component")).select(F.col("doc_id").alias(doc), F.col("digest").alias(digest)), "long_kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({own_doc: F.col("doc_id").cast("long"), own_digest: F.xxhash64(text)})
    kept = keyed.join(groups.distinct(), F.col(own_doc).eqNullSafe(F.col(doc)) & (F.col(own_digest) == F.col(digest)), "left_semi")
    repeats = not groups.groupBy(doc, digest).count().filter("count > 1").isEmpty()
    return (kept.dropDuplicates([own_doc, own_digest]) if repeats else kept).select(*docs.columns)
