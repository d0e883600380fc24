"""Hard negatives of every anchor: the best rows of another label whose score lies in a band below a positive's.

Scores are integer inner products of the scaled vectors. Most pairs of anchor and row can be neither, which is seen from a few
numbers: all vectors are turned by the orthogonal matrix of the principal components (fitted on the sums of outer products of
all rows), so that the leading components carry most of a product. A pair's product is accumulated STEP components at a
time; the rest is at most the product of the residual norms (Cauchy-Schwarz), plus a slack for the rounding of doubles. A pair
whose bound falls below what it must reach (or, for a negative, whose lower bound lies above every cap) is dropped; what
survives is verified by an integer product. A bound only ever drops pairs that cannot be in the result.

Rows are packed into blocks. Every block of anchors meets every block of rows in a shuffle on the anchor block's number, and a
task keeps the best of what it has seen for each anchor, so that later blocks are held to a higher bar. Two passes: positives
of each anchor, then negatives of each (anchor, positive).

Cases: rows with a null vec_id, label or vector or with a null or non-finite component take no part, nor do rows whose scaled
squared norm reaches 2^62, as scores would not fit a long; shorter vectors count as padded with zeros; ties go to the smaller
vec_id; a vec_id names one row, so rows that repeat it count once, by the smallest (label, vector); an anchor without
positives or a positive without negatives has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, free_names, materialise

ANCHORS_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: Negative scores lie between these hundredths of the positive's.
BAND = (50, 95)
#: Rows and anchors of a block, anchors compared at once, and components added to a product at a time.
BLOCK_ROWS = 2048
BLOCK_ANCHORS = 8192
ANCHORS_AT_ONCE = 256
STEP = 8
SCALE = 256
LARGEST = float(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, own (scaled components as longs) of the rows that take part, labels of every seventh id moved on by one."""
    (size,) = free_names(vectors, "__size")
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(LARGEST)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = rows.withColumn(size, F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))).filter(F.col(size) < LARGEST)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("own"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "own")).alias("x")).select("vec_id", "x.label", "x.own")


def _packed(width: int, most: int):
    """Blocks of rows: packed ids, labels and components, in order of id within a block."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (0, 1))
        own = np.zeros((len(ids), width), dtype=np.int64)
        at = 0
        for b in parts:
            lengths = b.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own[at + row, place] = b.column(2).flatten().to_numpy()
            at += b.num_rows
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()], pa.binary()) for x in (ids, labels, own)], names=["ids", "labels", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most - n), batch.slice(most - n)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return run


def _outer_sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for own in batch.column(0).to_pylist():
                x = np.frombuffer(own, dtype=np.int64).reshape(-1, width).astype(float)
                total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


def rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """The orthogonal matrix whose columns are the principal directions, largest first. It only decides how early pairs drop,
    so the order of its sums is free."""
    sums = np.zeros((width, width))
    for r in blocks.select("own").mapInArrow(_outer_sums(width), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["s"]
    scale = np.abs(sums).max() or 1.0
    return np.linalg.eigh(sums / scale)[1][:, ::-1].copy()


class Turned:
    """Rotated vectors with the norms of what each step leaves."""

    def __init__(self, own: np.ndarray, turn: np.ndarray):
        self.own, self.z = own, own.astype(float) @ turn
        width = own.shape[1]
        self.cuts = [*range(STEP, width, STEP), width]
        squares = np.cumsum((self.z**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, c]) if c < width else np.zeros(len(own)) for c in self.cuts]
        self.norm = np.sqrt(squares[:, 0]) if width else np.zeros(len(own))


def survivors(a: Turned, b: Turned, least: np.ndarray, most: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of every pair that `allowed(anchors)` leaves and that may score between least and most (of the
    anchor); scores are exact."""
    width = a.z.shape[1]
    # errors of the rotation and of the sums: some width roundings of numbers below the norms
    error = 8 * (width + 4) * np.finfo(float).eps
    found = []
    for at in range(0, len(a.z), ANCHORS_AT_ONCE):
        own = np.arange(at, min(at + ANCHORS_AT_ONCE, len(a.z)))
        own = own[least[own] <= most[own]]
        if not len(own):
            continue
        slack = lambda i, j: a.norm[i] * b.norm[j] * error + 1e-6
        part = a.z[own, : a.cuts[0]] @ b.z[:, : a.cuts[0]].T
        bound = np.outer(a.rest[0][own], b.rest[0]) + slack(own[:, None], np.arange(len(b.z))[None, :])
        i, j = np.nonzero(allowed(own) & (part + bound >= least[own][:, None]) & (part - bound <= most[own][:, None]))
        part, i = part[i, j], own[i]
        for k in range(1, len(a.cuts)):
            span = slice(a.cuts[k - 1], a.cuts[k])
            part = part + np.einsum("ij,ij->i", a.z[i, span], b.z[j, span])
            bound = a.rest[k][i] * b.rest[k][j] + slack(i, j)
            keep = (part + bound >= least[i]) & (part - bound <= most[i])
            i, j, part = i[keep], j[keep], part[keep]
        found.append((i, j, np.einsum("ij,ij->i", a.own[i], b.own[j])))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def margin(bar: np.ndarray, sign: int) -> np.ndarray:
    """Whole scores as doubles, moved beyond what rounding them to a double can change."""
    out = bar.astype(float)
    return out + sign * (np.abs(out) * 1e-15 + 1)


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` first of each group by descending score, then ascending id; places are in that order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < top]


def _arrays(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64), np.frombuffer(row["own"], dtype=np.int64).reshape(-1, width)


LAST = np.iinfo(np.int64).max


class Positives:
    """The best rows of an anchor block's labels so far."""

    def __init__(self, row: dict, width: int, turn: np.ndarray):
        self.ids, self.labels, own = _arrays(row, width)
        self.anchors = Turned(own, turn)
        self.held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(len(self.ids), -np.inf)

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: Turned) -> None:
        allowed = lambda own: (self.labels[own][:, None] == labels[None, :]) & (self.ids[own][:, None] != ids[None, :])
        i, j, score = survivors(self.anchors, rows, self.least, np.full(len(self.ids), np.inf), allowed)
        merged = tuple(np.concatenate(x) for x in zip(self.held, (i, score, ids[j]), strict=True))
        keep = best_of(merged[0], merged[1], merged[2], POSITIVES)
        self.held = tuple(x[keep] for x in merged)
        full = np.bincount(self.held[0], minlength=len(self.ids)) == POSITIVES
        worst = np.full(len(self.ids), LAST)
        np.minimum.at(worst, self.held[0], self.held[1])
        self.least = np.where(full, margin(worst, -1), -np.inf)  # what equals the worst score can still win by its id

    def rows(self) -> pa.RecordBatch:
        i, score, ids = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(ids), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])


class Negatives:
    """The best rows of other labels so far in the band below each (anchor, positive)."""

    def __init__(self, row: dict, width: int, turn: np.ndarray):
        self.ids, self.labels, own = _arrays(row, width)
        self.anchors = Turned(own, turn)
        self.anchor, self.positive, self.score = (np.frombuffer(row[k], dtype=np.int64) for k in ("pair_anchor", "pair_id", "pair_score"))
        # whole scores in the band: ceil(lo * p / 100) to floor(hi * p / 100), in pieces that stay in a long
        whole, over = np.divmod(self.score, 100)
        self.low = BAND[0] * whole - (-BAND[0] * over) // 100
        self.high = BAND[1] * whole + (BAND[1] * over) // 100
        self.held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        self.bars(self.low)

    def bars(self, low: np.ndarray) -> None:
        """What a row must reach, and must not exceed, to matter to any positive of an anchor."""
        live = low <= self.high
        self.least, self.most = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        np.minimum.at(self.least, self.anchor[live], margin(low[live], -1))
        np.maximum.at(self.most, self.anchor[live], margin(self.high[live], 1))

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: Turned) -> None:
        i, j, score = survivors(self.anchors, rows, self.least, self.most, lambda own: self.labels[own][:, None] != labels[None, :])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        # where each positive's band begins among its anchor's rows: rows before it in the common order of rows and caps
        is_row = np.repeat([1, 0], [len(i), len(self.anchor)])
        common = np.lexsort((is_row, np.concatenate([-score, -self.high]), np.concatenate([i, self.anchor])))
        before = np.zeros(len(common), dtype=np.int64)
        before[common] = np.cumsum(is_row[common])
        first = before[len(i) :]
        pair = np.repeat(np.arange(len(self.anchor)), NEGATIVES)
        at = np.repeat(first, NEGATIVES) + np.tile(np.arange(NEGATIVES), len(self.anchor))
        pair, at = pair[at < len(i)], at[at < len(i)]
        good = (i[at] == self.anchor[pair]) & (score[at] >= self.low[pair])
        pair, at = pair[good], at[good]
        merged = tuple(np.concatenate(x) for x in zip(self.held, (pair, score[at], ids[j[at]]), strict=True))
        keep = best_of(merged[0], merged[1], merged[2], NEGATIVES)
        self.held = tuple(x[keep] for x in merged)
        full = np.bincount(self.held[0], minlength=len(self.anchor)) == NEGATIVES
        worst = np.full(len(self.anchor), LAST)
        np.minimum.at(worst, self.held[0], self.held[1])
        self.bars(np.where(full, worst, self.low))

    def rows(self) -> pa.RecordBatch:
        p, score, ids = self.held
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[self.anchor[p]], self.positive[p], self.score[p], ids, score)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _met(kind: type, width: int, turn: np.ndarray):
    """Rows come sorted by anchor block: its own row (with the anchors) first, then the blocks of rows that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, number = None, None
        for batch in batches:
            for k in range(batch.num_rows):  # a row is a whole block
                row = {name: batch.column(at)[k].as_py() for at, name in enumerate(batch.schema.names)}
                if row["head"] == 0:
                    if (row["block"], row["part"]) != number:
                        if state is not None:
                            yield state.rows()
                        state, number = kind(row, width, turn), (row["block"], row["part"])
                else:
                    ids, labels, own = _arrays(row, width)
                    state.meet(ids, labels, Turned(own, turn))
        if state is not None:
            yield state.rows()

    return run


PAIRS = ("pair_anchor", "pair_id", "pair_score")
BLOCK = "ids binary, labels binary, own binary"


def _meeting(anchors: DataFrame, blocks: DataFrame, kind: type, width: int, turn: np.ndarray, schema: str) -> DataFrame:
    """Every block of anchors (`block`, from 0) meets every block of rows; a group is a block of anchors with one part of the
    row blocks, so that few anchor blocks still keep all cores busy."""
    spark = blocks.sparkSession
    n_anchors, n_rows = anchors.count(), blocks.count()
    parts = max(1, min(n_rows, 4 * spark.sparkContext.defaultParallelism // max(1, n_anchors)))
    pairs = [F.col(c) if c in anchors.columns else F.lit(None).cast("binary").alias(c) for c in PAIRS]
    heads = anchors.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("head"), "ids", "labels", "own", *pairs)
    part = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts)).cast("int")
    dealt = blocks.select(part.alias("part"), "ids", "labels", "own").select(
        F.explode(F.sequence(F.lit(0), F.lit(max(0, n_anchors - 1)))).alias("block"), "part", F.lit(1).alias("head"), "ids", "labels", "own", *[F.lit(None).cast("binary").alias(c) for c in PAIRS]
    )
    joined = heads.unionByName(dealt).repartition(max(1, min(parts * n_anchors, 1 << 16)), "block", "part").sortWithinPartitions("block", "part", "head")
    return joined.mapInArrow(_met(kind, width, turn), schema)


def _best(found: DataFrame, keys: list[str], score: str, ids: str, top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ids)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, anchor_id, place) of every anchor of the blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = np.frombuffer(batch.column(1)[k].as_py(), dtype=np.int64)
            block = np.full(len(ids), batch.column(0)[k].as_py(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(ids), pa.array(np.arange(len(ids)))], names=["block", "anchor_id", "place"])


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [[np.asarray(x, dtype=np.int64).tobytes() for x in batch.column(k).to_pylist()] for k in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in packed)], names=["block", *PAIRS])


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialise(usable(vectors), "vectors")
    width = rows.agg(F.max(F.size("own"))).first()[0]
    own = rows.filter(F.col("vec_id") % ANCHORS_EVERY == 0)
    n_anchors = own.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, width)
    blocks = materialise(rows.mapInArrow(_packed(width, BLOCK_ROWS), BLOCK), "vector_blocks")
    turn = rotation(blocks, width)
    packed = own.repartition(-(-n_anchors // BLOCK_ANCHORS)).mapInArrow(_packed(width, BLOCK_ANCHORS), BLOCK)
    anchors = materialise(packed, "anchor_blocks").withColumn("block", F.row_number().over(Window.orderBy("ids")) - 1)  # some rows
    anchors = materialise(anchors, "anchors")
    found = _meeting(anchors, blocks, Positives, width, turn, "anchor_id long, positive_id long, positive_score long")
    positives = _best(found, ["anchor_id"], "positive_score", "positive_id", POSITIVES).drop("rank")
    places = anchors.select("block", "ids").mapInArrow(_anchor_ids, "block int, anchor_id long, place long")
    gathered = positives.join(places, "anchor_id").groupBy("block").agg(*[F.collect_list(c).alias(n) for n, c in zip(PAIRS, ("place", "positive_id", "positive_score"), strict=True)])
    pairs = materialise(gathered.mapInArrow(_pack_pairs, "block int, " + ", ".join(f"{c} binary" for c in PAIRS)), "anchor_pairs")
    paired = anchors.join(pairs, "block", "left").withColumns({c: F.coalesce(c, F.lit(b"")) for c in PAIRS})
    found = _meeting(paired, blocks, Negatives, width, turn, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _best(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", NEGATIVES)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
