"""Filing changes and irregular averages as streams: keyed state, event-time timers, out-of-order rows.

A day is answered once the watermark has passed it, since until then rows of that day or before may still come. So rows may come in
any order within `lateness`; a row older than the watermark is late and dropped, as is one without a date. The state of an entity is what
its open days need: for filing changes the filings of the look-back and those of days still open, for averages the last day
and average and the rows of open days. Answers come in order of days for each entity, and equal those of the batch operators
over the rows that were not late. State lives in the stream's checkpoint, so a restart goes on where the stream was.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from signalloom.sources.shared import shared_path

DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of entities, each a key of the state; the bucket of rows without an entity.
BUCKETS, NO_KEY = 1024, -1
#: Rows in a record of the state.
STATE_ROWS = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store; set it unless the session names another provider than the default."""
    if spark.conf.get(PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


class DayProcessor(StatefulProcessor):
    """Holds rows until the watermark has passed the days on which they matter, then answers these days in order. The state's key is a
    bucket of entities, and its rows are held STATE_ROWS to a record, so that a call of the state store and a timer serve many of them."""

    #: Fields of an answer besides its entity, with their types.
    answers = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")  # (entity, day, ...)
        self.last = handle.getListState("last", "packed binary")  # (entity, what it was at its last answered day)

    def wake(self, day: int) -> None:
        """Ask to be called when nothing of `day` can come any more."""
        self.handle.registerTimer(day * DAY_MS + 1)

    @staticmethod
    def keep(state, rows: list[tuple]) -> None:
        """Hold these rows only. An empty list is no state."""
        state.clear()
        for at in range(0, len(rows), STATE_ROWS):
            state.appendValue((pickle.dumps(rows[at : at + STATE_ROWS]),))

    @staticmethod
    def of(state) -> Iterator[tuple]:
        return (row for (packed,) in state.get() for row in pickle.loads(packed))

    @staticmethod
    def open_day(timer_values: TimerValues) -> int:
        """The first day of which rows may still come."""
        return -(-timer_values.getCurrentWatermarkInMs() // DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        first = None
        for part in rows:
            held = [(None if key[0] == NO_KEY else r.key, *self.held(r)) for r in part.itertuples(index=False)]
            for at in range(0, len(held), STATE_ROWS):
                self.rows.appendValue((pickle.dumps(held[at : at + STATE_ROWS]),))
            first = min([r[1] for r in held] + ([] if first is None else [first]), default=None)
        if first is not None:
            self.wake(first)  # one timer, not one for each day: whoever answers asks for the next
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All closed days of all entities at once, of each in order; the first day still open asks for the next timer."""
        open_day, found, kept = self.open_day(timerValues), [], []
        last = dict(self.of(self.last))
        entities: dict[object, list[tuple]] = {}
        for entity, *row in self.of(self.rows):
            entities.setdefault(entity, []).append(tuple(row))
        changed, ahead = False, []
        for entity, rows in entities.items():
            out, rest, known, next_day = self.answer(rows, last.get(entity), open_day)
            found += [(entity, *x) for x in out]
            kept += [(entity, *x) for x in rest]
            changed |= len(rest) < len(rows) or known != last.get(entity)
            if known is not None:
                last[entity] = known
            if next_day is not None:
                ahead.append(next_day)
        if changed:
            self.keep(self.rows, kept)
            self.keep(self.last, list(last.items()))
        if ahead:
            self.wake(min(ahead))
        if found:
            columns = list(zip(*found, strict=True))
            yield pd.DataFrame({"key": pd.Series(columns[0], dtype="object" if key[0] == NO_KEY else None)} | {n: pd.Series(c, dtype=t) for (n, t), c in zip(self.answers, columns[1:], strict=True)})

    def close(self) -> None:
        pass

    def held(self, row) -> tuple:
        """What is held of a row, its day first."""
        raise NotImplementedError

    def answer(self, rows: list[tuple], last: tuple | None, open_day: int) -> tuple[list[tuple], list[tuple], tuple | None, int | None]:
        """Of one entity: the answers of its closed days, the rows still to be held, what is carried on, and the first open day."""
        raise NotImplementedError


def missing(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


class FilingDelta(DayProcessor):
    answers = (("day", "int32"), ("signal", "float64"), ("n_filings_in_window", "int32"))

    def __init__(self, lookback_days: int):
        self.lookback = lookback_days

    def held(self, row) -> tuple:
        return (int(row.day), None if missing(row.document_id) else row.document_id, None if missing(row.length) else float(row.length))

    def answer(self, rows: list[tuple], last: tuple | None, open_day: int):
        done, before = last or (None, None)
        # order of (day, document, length), nulls first
        rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0, r[2] is not None, r[2] or 0.0))
        wanted = {d for r in rows for d in (r[0], r[0] + self.lookback + 1)}
        days = sorted(d for d in wanted if d < open_day and (done is None or d > done))
        of_row = [r[0] for r in rows]
        out = []
        for day in days:
            end = bisect_right(of_row, day)
            n = end - bisect_left(of_row, day - self.lookback)
            now, former = (rows[end - 1][2], rows[end - 2][2]) if n > 1 else (None, None)
            signal = now - former if now is not None and former is not None else None
            if signal != before:
                out.append((day, signal, n))
                before = signal
        if days:
            last = (days[-1], before)
            rows = [r for r in rows if r[0] + self.lookback + 1 > days[-1]]
        return out, rows, last, min((d for d in wanted if d >= open_day), default=None)


class IrregularAverage(DayProcessor):
    answers = (("day", "int32"), ("value", "float64"), ("average", "float64"))

    def __init__(self, halflife_days: float):
        self.rate = math.log(2) / halflife_days

    def held(self, row) -> tuple:
        return int(row.day), None if missing(row.value) else float(row.value)

    def answer(self, rows: list[tuple], last: tuple | None, open_day: int):
        rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        n = bisect_left(rows, open_day, key=lambda r: r[0])
        at, average = last or (None, None)
        out = []
        for day, value in rows[:n]:
            if value is not None:
                weight = 1.0 if average is None else 1.0 - math.exp(-self.rate * (day - at))
                average, at = weight * value + (1.0 - weight) * (average or 0.0), day
            out.append((day, value, average))
        return out, rows[n:], last if average is None else (at, average), rows[n][0] if n < len(rows) else None


EPOCH = "1970-01-01"


def _dated(df: DataFrame, date: str, lateness: str) -> DataFrame:
    """The rows with their day as event time under a watermark."""
    day = F.col(date).cast("date")
    rows = df.filter(day.isNotNull()).withColumns({"__time": day.cast("timestamp"), "day": F.datediff(day, F.lit(EPOCH).cast("date"))})
    return rows.withWatermark("__time", lateness)


def _typed(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _bucket(key: str, buckets: int):
    return F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).alias("__bucket")


def stream_filing_delta(filings: DataFrame, lookback_days: int = 180, lateness: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """D-32 over a stream of (qid, date, document_id, length): qid, date, signal, n_filings_in_window at every change."""
    keyed_state(filings.sparkSession)
    rows = _dated(filings, "date", lateness).select(_bucket("qid", buckets), F.col("qid").alias("key"), "day", "document_id", F.col("length").cast("double").alias("length"), "__time")
    found = rows.groupBy("__bucket").transformWithStateInPandas(FilingDelta(lookback_days), f"key {_typed(filings, 'qid')}, day int, signal double, n_filings_in_window int", "Append", "EventTime")
    return found.select(F.col("key").alias("qid"), F.date_from_unix_date("day").alias("date"), "signal", "n_filings_in_window")


def stream_irregular_ewma(df: DataFrame, key: str, date: str, value: str, halflife_days: float, out: str, lateness: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """D-30 over a stream of (key, date, value): each row with the average after it. Rows of one day come in order of value."""
    keyed_state(df.sparkSession)
    rows = _dated(df, date, lateness).select(_bucket(key, buckets), F.col(key).alias("key"), "day", F.col(value).cast("double").alias("value"), "__time")
    found = rows.groupBy("__bucket").transformWithStateInPandas(IrregularAverage(halflife_days), f"key {_typed(df, key)}, day int, value double, average double", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.date_from_unix_date("day").alias(date), F.col("value").alias(value), F.col("average").alias(out))


def replay(df: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Everything that `build` answers when the rows of `df` arrive as a stream: a run over the files of a written copy, until
    all are read and the watermark stands behind the last. Days within the lateness of the last row stay open, so unanswered."""
    spark = df.sparkSession
    base = shared_path(spark, name)
    df.write.parquet(f"{base}/in")
    answers = build(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
    run = answers.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{base}/out")
