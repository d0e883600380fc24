"""How often groups of patterns stand in a text: policy keywords, hedges, tenses, and their ratio to a company's own past."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.columns import average_rank, over_days, safe_div

#: A word is what stands between white space.
WORD = r"[^ \t\n\x0B\f\r]+"


def automaton(groups: Mapping[str, Sequence[str]]):
    """One Aho-Corasick automaton over the patterns of all groups; a pattern's value is (its number, its length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, p in enumerate(dict.fromkeys(p for ps in groups.values() for p in ps)):
        if not p:
            raise ValueError("a pattern is not empty")
        found.add_word(p, (k, len(p)))
    if len(found):
        found.make_automaton()
    return found


def count_patterns(machine, text: str, number: int, whole_words: bool = False) -> list[int]:
    """Occurrences of each of `number` patterns in one pass over the text; occurrences of the same pattern do not overlap, the
    leftmost counting. With whole_words, one that touches another letter or digit does not count."""
    counts, end = [0] * number, [-1] * number
    if not len(machine):
        return counts
    for last, (k, size) in machine.iter(text):
        first = last - size + 1
        if first <= end[k]:
            continue
        if whole_words and (first > 0 and text[first - 1].isalnum() or last + 1 < len(text) and text[last + 1].isalnum()):
            continue
        counts[k] += 1
        end[k] = last
    return counts


def _counted(groups: dict[str, tuple[str, ...]], whole_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(groups)
        place = {p: k for k, p in enumerate(dict.fromkeys(p for ps in groups.values() for p in ps))}
        members = [[place[p] for p in dict.fromkeys(ps)] for ps in groups.values()]
        for batch in batches:
            each = [None if t is None else count_patterns(machine, t, len(place), whole_words) for t in batch.columns[-1].to_pylist()]
            sums = [pa.array([None if c is None else sum(c[k] for k in own) for c in each], pa.int64()) for own in members]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], names=[*batch.schema.names[:-1], *(f"{g}_count" for g in groups)])

    return run


def pattern_density(df: DataFrame, text: str, groups: Mapping[str, Sequence[str]], keep: Sequence[str], whole_words: bool = False) -> DataFrame:
    """The columns `keep`, n_words, and for each group the occurrences of its patterns (`<group>_count`) and these by the text's
    words (`<group>_density`, null without words). A null text has nulls. However many patterns, a text is read once."""
    groups = {g: tuple(ps) for g, ps in groups.items()}
    body = F.col(f"`{text}`").cast("string")
    rows = df.select(*keep, F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"), body.alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"{g}_count", T.LongType()) for g in groups)])
    counted = rows.mapInArrow(_counted(groups, whole_words), schema)
    return counted.withColumns({f"{g}_density": safe_div(F.col(f"{g}_count").cast("double"), F.col("n_words")) for g in groups})


def against_history(df: DataFrame, entity: str, date: str, value: str, out: str, days: int = 730) -> DataFrame:
    """`out`: the value by the entity's mean over the `days` days before (two years by default), null without any."""
    return df.withColumn(out, safe_div(F.col(value), F.avg(value).over(over_days([entity], date, days, "left"))))


def temporal_orientation(df: DataFrame, future: str, past: str, out: str = "orientation") -> DataFrame:
    """`out`: future by past occurrences, null without past ones."""
    return df.withColumn(out, safe_div(F.col(future).cast("double"), F.col(past)))


def density_rank(df: DataFrame, date: str, density: str, out: str) -> DataFrame:
    """`out`: the rank of the density among the rows of its day, ties averaged."""
    return df.withColumn(out, average_rank(density, [date]))
