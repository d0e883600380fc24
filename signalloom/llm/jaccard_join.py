"""Jaccard self-join of the documents' word n-gram sets, by prefixes whose tokens are combined where they are frequent.

A document's set holds the 62-bit hashes of its SIZE-word shingles (lower-cased in A-Z; with fewer words, of the whole sequence). Equal
sets are one node. Two nodes link when 100 * intersection >= PERCENT * union; then at most slack(n) = n // 10 of a set's n
tokens are missing in the other. All orders below are the same for every set, so that of two linked sets one's prefix lies
within the other's range and only its missing tokens can keep it from matching.

1. Survivors. In the order of hashes, the first slack + l tokens of linked sets share l or more. A set that shares fewer of
   them with other sets links with nothing. Only the others go on, and of them only the text of one document each is read again.
2. Token classes. Tokens are counted over the survivors: one of a single set is surely missing in the other and leaves the
   set, its slack along with it. The rest are class 1 (rare), 2, 3 (frequent) by LIMITS, ordered rare first.
3. First links. Sets with an equal band of least mixed hashes are compared with one of them, so that nearly all of a group of near copies
   is one component before signatures are made: a list inside one component has nothing left to find and is never built. This
   spares work only; what bands miss is found below.
4. Extended prefixes. Single tokens of class 1 and combinations of k tokens of class k are signatures. Tokens of a class k > 1 fall
   into buckets, and only tokens of one bucket combine, so that there are some few combinations a token. Of c tokens of a
   bucket a combination is left until c - k + 1 are missing. The prefix is extended until the tokens that must be missing to
   leave no signature exceed the slack. Buckets are as many as the size's power of two asks for; a set whose partners can have
   another power of two has signatures for both.
5. Lists. Sets with a common signature are candidates. Near copies share many signatures, so of the lists with the same members one is
   kept. Long lists are first compared with HUBS of their members, so that a group of near copies becomes one component by as
   many comparisons as it has members, with other hubs again where many pairs are left. Then all pairs of a list that are
   not yet in one component are looked at; sizes and the parity sketches of the sets (their differing bits are at most the
   tokens in which two sets differ) reject most before the sets themselves are compared.
6. Links are verified by the sizes of intersection and union; components are found by alternating stars.

Cases: null and empty texts and texts without words have empty sets and are linked with nothing, not even each other; very long
texts are hashed whole; rows that repeat a doc_id are documents of their own; a null id counts for a component's id only if it has no
other; an empty table gives an empty result; columns besides doc_id and text are ignored. Equality of shingles is that of their
hashes: two of 10^5 differing shingles of a pair collide with a chance of some 10^-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, files_for, join_groups, materialise, text_bytes
from signalloom.llm.components import connected_components

SIZE = 3
PERCENT = 90
#: Sets below this size have no partner but equal ones: ten tokens are the first that may miss one.
LEAST = 9
#: Sets that hold a token: up to the first it is class 1, up to the second class 2, beyond it class 3.
LIMITS = (8, 1024)
#: Tokens of a set for each bucket of a class.
BUCKET_TOKENS = 16
#: Lists of more sets than this are compared with HUBS members first: all whose pairs would be many more than that.
LONG_LIST = 4
HUBS = 3
#: Times that other hubs are tried while lists have many pairs of sets in different components; what is left then is compared pair by pair.
TURNS = 4
SKETCH = 8
#: Bands of a set and the least mixed hashes in each: of sets that link, some 0.1 % have no band in common.
BANDS, BAND_ROWS = 4, 2
#: Bits of the map of survivors that every task holds while it reads the texts: at most 2^(MAP_BITS - 6) rows of 64 bits.
MAP_BITS = 24
#: Text that is split into words at a time.
PART_BYTES = 1 << 20
#: Pairs whose ids (16 bytes each) may travel to every task.
FEW_PAIRS = 500_000
SEED = 42
ODD = np.uint64(0x9E3779B97F4A7C15)
CLASS_BITS = np.int64(3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text as longs; the two lowest bits are zero."""
    from xxhash import xxh64_intdigest

    split = [t.lower().split() for t in texts]
    words = pa.array([w for own in split for w in own], pa.binary()).dictionary_encode()
    known = np.fromiter((xxh64_intdigest(w, SEED) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    hashes = [mix(known[words.indices.to_numpy()])] if len(words) else [np.zeros(0, dtype=np.uint64)]
    one = known[words.indices.to_numpy()] if len(words) else hashes[0]
    for k in range(1, size):
        hashes.append(mix(hashes[-1][: max(0, len(one) - k)] * ODD + one[k:]))
    out, at = [], 0
    for own in split:
        n = len(own)
        tokens = hashes[min(n, size) - 1][at : at + max(1, n - size + 1)] if n else one[:0]
        out.append(np.unique(tokens.view(np.int64) & ~CLASS_BITS))
        at += n
    return out


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """`token_sets` over parts of about PART_BYTES, so that few words are held as objects at a time."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= PART_BYTES:
            out += token_sets(part)
            part, size = [], 0
    return out + token_sets(part)


def slack(n):
    """How many tokens of a set of n may be missing in a linked set."""
    return n * (100 - PERCENT) // 100


def shared_least(n):
    """Tokens that prefixes of slack + this many share with any linked set's."""
    return slack(n) + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))


def digest(tokens: np.ndarray) -> bytes:
    own = tokens.view(np.uint64)
    return (int(mix(own).sum(dtype=np.uint64)).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mix(own * ODD + np.uint64(1)))).to_bytes(8, "little")) if len(own) else b""


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, n, digest of the set, key (the digest's first half), and the tokens of the first prefix."""
    for batch in batches:
        sets = sets_of(text_bytes(batch.column(2)))
        digests = [digest(s) for s in sets]
        n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        prefix = [s[: slack(len(s)) + shared_least(len(s))] if len(s) >= LEAST else s[:0] for s in sets]
        key = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(digests, pa.binary()), pa.array(key, pa.int64()), _lists(prefix)], names=["doc_id", "text_hash", "n", "digest", "key", "prefix"])


def bands(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the least tokens under BANDS * BAND_ROWS orders, BAND_ROWS to a band."""
    own, out = tokens.view(np.uint64), []
    for k in range(BANDS):
        value = np.asarray([k], dtype=np.uint64)
        for j in range(BAND_ROWS):
            salt = mix(np.asarray([k * BAND_ROWS + j + 1], dtype=np.uint64))
            value = mix((value + np.uint64(1)) * ODD + mix(own ^ salt).min(keepdims=True))
        out.append(value)
    return np.concatenate(out).view(np.int64)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, tokens, bands, parity sketch of each survivor."""
    for batch in batches:
        sets = sets_of(text_bytes(batch.column(1)))
        sketch = np.zeros((len(sets), SKETCH * 64), dtype=np.uint8)
        for row, own in zip(sketch, sets, strict=True):
            row += (np.bincount((mix(own.view(np.uint64)) % np.uint64(SKETCH * 64)).astype(np.int64), minlength=SKETCH * 64) & 1).astype(np.uint8)
        words = np.packbits(sketch, axis=1).view(np.int64).reshape(len(sets), SKETCH)
        n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(sets), _lists([bands(s) for s in sets]), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(SKETCH))], names=["node", "n", "tokens", "bands", *SKETCHES])


SKETCHES = tuple(f"s{k}" for k in range(SKETCH))


def powers(n: int) -> list[int]:
    """The powers of two of n and of its partners' sizes."""
    low, high = -(-n * PERCENT // 100), n * 100 // PERCENT
    return list(range(low.bit_length(), high.bit_length() + 1))


def signatures(n: int, coded: np.ndarray) -> np.ndarray:
    """Hashes of the signatures of a set of n tokens. `coded`: its tokens that other sets hold, the class in the lowest bits."""
    coded = np.unique(coded)
    left = slack(n) - (n - len(coded))
    if left < 0:
        return np.zeros(0, dtype=np.int64)
    kind, token = coded & CLASS_BITS, coded & ~CLASS_BITS
    order = np.lexsort((token, kind))
    kind, token = kind[order], token[order].view(np.uint64)
    out = []
    for power in powers(n):
        buckets = max(1, (1 << power) // BUCKET_TOKENS // 2)
        bucket = np.where(kind == 1, 0, (mix(token) % np.uint64(buckets)).astype(np.int64)) * 4 + kind
        by = np.argsort(bucket, kind="stable")
        new = np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]])
        starts = np.flatnonzero(new)
        nth = np.empty(len(by), dtype=np.int64)
        nth[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        must_miss = np.cumsum(nth >= kind - 1)  # tokens to be missing for no signature to be left
        end = int(np.searchsorted(must_miss, left + 1)) + 1
        single = kind[:end] == 1
        out.append(mix(token[:end][single]))
        groups: dict[int, list[int]] = {}
        for b, t in zip(bucket[:end][~single].tolist(), token[:end][~single].tolist(), strict=True):
            groups.setdefault(b, []).append(t)
        for k in (2, 3):
            sets = [c for b, own in groups.items() if b & 3 == k for c in combinations(own, k)]
            if sets:
                chosen = np.asarray(sets, dtype=np.uint64)
                value = np.full(len(sets), power * 4 + k, dtype=np.uint64)
                for column in chosen.T:
                    value = mix(value * ODD + column)
                out.append(value)
    return np.unique(np.concatenate(out)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded, ends = batch.column(2).flatten().to_numpy(), np.cumsum([0, *batch.column(2).value_lengths().to_pylist()])
        found = [signatures(n, coded[ends[k] : ends[k + 1]]) for k, n in enumerate(batch.column(1).to_pylist())]
        for at in range(0, len(found), 256):
            part = found[at : at + 256]
            node, comp = (np.repeat(batch.column(k).to_numpy()[at : at + 256], [len(x) for x in part]) for k in (0, 3))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(node), pa.array(comp)], names=["sig", "node", "comp"])


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def survivors(sets: DataFrame) -> DataFrame:
    """One row for each set that may link with another one: node, digest, and doc_id and text_hash of a document that has it."""
    postings = sets.select("key", F.explode("prefix").alias("token"))
    held = postings.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("token")
    hits = postings.join(held, "token", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("hits"))
    groups = sets.filter(F.col("n") >= LEAST).groupBy("digest", "key", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"))
    # every copy of a set has posted the same tokens; a partner may be smaller and so share no more than its own least
    smaller = F.ceil(F.col("n") * PERCENT / 100)
    least = F.floor(smaller * (100 - PERCENT) / 100) + 1
    found = groups.join(hits, "key").filter(F.col("hits") >= least * F.col("copies"))
    few = found.select("digest", "first.doc_id", "first.text_hash").repartition(files_for(sets.count()))
    return materialise(few.withColumn("node", F.monotonically_increasing_id()), "jaccard_survivors")


def full_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, tokens and sketch of every survivor, from the text of one document each. A map of fixed size keeps most other texts out of the shuffle."""
    place = F.col("text_hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(text_hash & 63 as int))")
    bits = nodes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    texts = _hashed(docs).withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word").filter("bits & bit != 0")
    wanted = nodes.select("node", F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"))
    met = texts.join(wanted, (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "text")
    if not sets.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        met = met.dropDuplicates(["node"])
    return materialise(met.mapInArrow(_full, "node long, n long, tokens array<long>, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCHES)), "jaccard_sets")


def signed(full: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(sig, node, comp) of the signatures that two sets or more have, with the number of sets in the list; of lists with the same sets, one.
    With `roots` (node, root) of components found so far, only lists whose sets are in several of them; comp is the component, or the node."""
    tokens = full.select("node", "n", F.explode("tokens").alias("token"))
    kind = F.when(F.col("sets") <= LIMITS[0], 1).when(F.col("sets") <= LIMITS[1], 2).otherwise(3)
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("token", kind.cast("long").alias("kind"))
    coded = tokens.join(counts, "token").groupBy("node", "n").agg(F.collect_list(F.col("token").bitwiseOR(F.col("kind"))).alias("coded"))
    if roots is None:
        coded = coded.withColumn("comp", F.col("node"))
    else:
        coded = coded.join(roots, "node", "left").select("node", "n", "coded", F.coalesce("root", "node").alias("comp"))
    sigs = materialise(coded.mapInArrow(_signed, "sig long, node long, comp long"), "jaccard_signatures")
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in range(2)]  # 128 bits of the list's sets
    lists = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high"), *same).filter("low < high")
    lists = lists.groupBy("members", "same0", "same1").agg(F.min("sig").alias("sig")).select("sig", "members")
    return materialise(sigs.join(lists, "sig"), "jaccard_lists")


def may_link(a: str, b: str) -> Column:
    """Sizes and sketches leave it open that the sets link: they differ in at most the tokens that a union may have beyond the intersection."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCHES), F.lit(0))
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n) & (differ * (100 + PERCENT) <= (n + m) * (100 - PERCENT))


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The (u, v) whose sets link. Only sets that stand in a pair are shuffled where their ids are few enough to travel."""
    pairs = materialise(pairs, "jaccard_pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked_pairs = pairs.count()
    own = full.select("node", "n", "tokens")
    if asked_pairs <= FEW_PAIRS:
        own = own.join(F.broadcast(asked), "node", "left_semi")
    one, two = (own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "uv")
    both = pairs.join(one, "u").join(two, "v").withColumn("common", F.size(F.array_intersect("tu", "tv")))
    found = both.filter((100 + PERCENT) * F.col("common") >= PERCENT * (F.col("nu") + F.col("nv"))).select("u", "v")
    return materialise(found.repartition(files_for(asked_pairs)), "jaccard_links")


def few_pairs(members: DataFrame) -> bool:
    """The lists have some LONG_LIST pairs of different components for each of their members at most."""
    own = members.groupBy("sig", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = own.groupBy("sig").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    n, all_pairs = pairs.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
    return not n or all_pairs <= LONG_LIST * n


def first_links(full: DataFrame) -> DataFrame:
    """(u, v): links of sets with one set of each of their bands, as many comparisons as there are bands at most."""
    rows = full.select("node", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min_by("node", F.xxhash64("node")).alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    pairs = rows.join(hubs, "band").filter("node != hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    about = full.drop("tokens", "bands")
    met = pairs.join(about.alias("a"), F.col("u") == F.col("a.node")).join(about.alias("b"), F.col("v") == F.col("b.node")).filter(may_link("a", "b"))
    return verified(met.select("u", "v"), full)


def linked(full: DataFrame, lists: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(u, v): links that connect the nodes exactly as all links do; `links` are those found before, with whose components `lists` were made."""
    about = full.drop("tokens", "bands")
    members = lists.join(about, "node")
    if not lists.filter(F.col("members") > LONG_LIST).isEmpty() and not few_pairs(members):
        for turn in range(TURNS):
            # at first the same sets are hubs in all their lists, then each list has its own: lists of one group try many pairs
            own = [F.col("sig")] if turn else []
            hub = lambda k: F.min_by(F.struct("node", "n", "comp", *SKETCHES), F.xxhash64("node", F.lit(k), *own))  # noqa: B023, E731
            long = members.filter(F.col("members") > LONG_LIST)
            hubs = long.groupBy("sig").agg(F.array_distinct(F.array(*[hub(turn * HUBS + k) for k in range(HUBS)])).alias("hubs")).select("sig", F.explode("hubs").alias("h"))
            met = long.alias("a").join(hubs.select("sig", "h.*").alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") != F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & may_link("a", "b"))
            star = verified(met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct(), full)
            if turn and star.isEmpty():
                break
            links = star if links is None else links.unionByName(star)
            roots = connected_components(links).select("node", F.col("root").alias("found"))
            members = members.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("found", "node")).drop("found")
            open_lists = members.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("sig")
            members = materialise(members.join(open_lists, "sig", "left_semi"), "jaccard_open")
            if few_pairs(members):
                break
    met = members.alias("a").join(members.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & may_link("a", "b"))
    rest = verified(met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), full)
    return rest if links is None else links.unionByName(rest)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    bounded_batches(docs.sparkSession)
    sets = materialise(_hashed(docs).mapInArrow(_described, "doc_id long, text_hash long, n long, digest binary, key long, prefix array<long>"), "jaccard_prefixes")
    nodes = survivors(sets)
    full = full_sets(docs, sets, nodes)
    links = first_links(full)
    roots = connected_components(linked(full, signed(full, connected_components(links)), links))
    rows = sets.filter("n > 0").select("doc_id", "n", "digest")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(roots, "node").select("digest", "root")
    named = first.join(rooted, "digest", "left")
    least = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    classes = materialise(named.join(least, "root", "left").select("digest", F.coalesce("least", "first").alias("component_id")), "jaccard_classes")
    held = join_groups(rows, classes, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return held.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
