"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, served twice at most. A copy of a document finishes, by
the virtual clock, at the words that its source has queued up to its end divided by the source's target. All copies are
sorted by virtual finish over the cluster by range, and the sequence is cut where its running total reaches the budget. All
queues are served at rates in proportion to their targets, so the budget ends when the clock reads 1: the copy of each
source that is then in service leaves with the words it was served, at clock 1, and the cut falls behind these.

The running total is taken in two steps: the words of each range (a row per range), and, in the one range where the budget
ends, the words of its rows in order. Sizes, and the sorted ranges, are written once.

Targets: the budget is `share` of all words, divided by weight; no source gets more than `repeats` times its words, and what
it leaves is divided anew by weight among the others until none is above.

Cases: null text has no words; null is a source of its own, last in order; documents without words are returned with
nothing taken; documents of equal shuffle key (rows that repeat an id) are ordered by id, then size, and each such row has
its own place and its own share of the mix; very long texts count whole, and one that is in service when the budget ends
keeps its first words; empty tables give empty results; an empty source (no words) has target 0; columns besides doc_id, text
and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import TOTAL_BUCKETS, free_names, materialise, n_words, running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: one row per source, from per-source sums made before any shuffle.

    Filling level: with sources in order of the level at which they are full (cap / weight), the first k are full exactly
    when the level left for the others, (budget - their caps) / (other weights), is below the next one's.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(int(repeats)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("is_open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("is_open"), F.struct(F.col("full"), F.col("level")))).over(everything)["level"])
    )
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def sizes_of(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size), written once: texts are read for their sizes a single time. `row` numbers the rows."""
    row = F.monotonically_increasing_id() if row is None else row
    sizes = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    return materialise(sizes, "sizes")


def schedule(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """row, doc_id, source, size, source_size, target, shuffle_key, repeat, words, virtual_finish: every copy of every document.

    `words` is the size, but for a copy in service at clock 1, which leaves then with what it was served."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sizes.withColumn("shuffle_key", key).withColumn("bucket", F.conv(F.substring("shuffle_key", 1, 3), 16, 10).cast("long"))
    assert TOTAL_BUCKETS == 16**3
    queued = running_total(rows, ["source"], "bucket", ["shuffle_key", "doc_id", "size", "row"], "size", "queued")
    goal = targets(sizes, weights, share, repeats).withColumnRenamed("source", "__source")  # a row per source; adaptive execution broadcasts it if it is small
    timed = queued.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "bucket")
    copies = timed.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    end = F.col("queued") + F.col("repeat") * F.col("source_size")
    goal_words = F.floor("target")
    in_service = (end > goal_words) & (end - F.col("size") < goal_words)
    return copies.select(
        "row", "doc_id", "source", "size", "source_size", "target", "shuffle_key", "repeat",
        F.when(in_service, goal_words - end + F.col("size")).otherwise(F.col("size")).alias("words"),
        F.when(in_service, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(end, goal_words), F.lit(2.0))).alias("virtual_finish"),
    )


ORDER = ("virtual_finish", "source", "shuffle_key", "doc_id", "size", "row", "repeat")


def mix(sizes: DataFrame, **options) -> DataFrame:
    """The mix: the copies of `sizes` sorted by virtual finish and cut at the total budget. `place` is the range, `words` what
    a copy gives to the mix."""
    copies = schedule(sizes, **options).filter("words > 0")
    dealt = copies.repartitionByRange(*ORDER).withColumn("place", F.spark_partition_id()).sortWithinPartitions(*ORDER)
    ranges = materialise(dealt, "mix")
    budget = targets(sizes, **{k: v for k, v in options.items() if k != "seed"}).agg(F.sum(F.floor("target")).alias("budget"))  # one row
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("place").agg(F.sum("words").alias("__words")).withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    totals = totals.crossJoin(F.broadcast(budget)).filter("__before < budget")  # a row per range
    begun = ranges.join(F.broadcast(totals), "place")
    whole = begun.filter("__before + __words <= budget")
    so_far = Window.partitionBy("place").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = begun.filter("__before + __words > budget").withColumn("__end", F.col("__before") + F.sum("words").over(so_far))
    last = last.withColumn("words", F.least(F.col("words"), F.col("budget") - F.col("__end") + F.col("words"))).filter("words > 0")
    return whole.unionByName(last.drop("__end")).drop("__words", "__before", "budget")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document, what its copies give to the mix summed."""
    sizes = sizes_of(docs)
    goal = targets(sizes, **{k: v for k, v in options.items() if k != "seed"}).withColumnRenamed("source", "__source")
    taken = mix(sizes, **options).groupBy(F.col("row").alias("__row")).agg(F.sum("words").alias("__taken"))
    each = sizes.join(taken, F.col("row") == F.col("__row"), "left").join(goal, F.col("source").eqNullSafe(F.col("__source")))
    return each.select("doc_id", "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in mixing order, repeats included; a copy cut at the budget keeps its first words.

    Texts meet their copies by id, source and size. Where rows repeat all three, the table is numbered in a written copy of it
    first, and they meet by number, each row with its own copies."""
    (row,) = free_names(docs, "__row")
    sizes = sizes_of(docs)
    own = ["doc_id", "source", "size"]
    if not sizes.groupBy(*own).count().filter("count > 1").isEmpty():
        docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        sizes = sizes_of(docs, F.col(row))
    names = free_names(docs, *[f"__{c}" for c in (*own, "row", "words", "virtual_finish", "shuffle_key", "repeat")])
    doc, source, size, number, words, finish, key, repeat = names
    sequence = mix(sizes, **options).select(*[F.col(n.strip("_")).alias(n) for n in names])
    if row in docs.columns:
        same = F.col(row) == F.col(number)
    else:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (n_words(F.col("text")) == F.col(size))
    joined = docs.join(sequence, same)
    space = r"\x20\x09-\x0D"
    first = F.array_join(F.slice(F.split(F.col("text"), rf"(?<=[^{space}])(?=[{space}])", -1), F.lit(1), F.col(words).cast("int")), "")
    cut = F.col(words) < F.col(size)
    joined = joined.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.orderBy(finish, source, key, doc, size, number, repeat).select(*[c for c in docs.columns if c != row])
