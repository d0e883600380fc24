"""Calls of the state store grow with buckets of entities, not with rows or days."""

from types import SimpleNamespace

import pandas as pd
import pytest

from signalloom.streaming import stateful


class State:
    def __init__(self):
        self.held = []

    def get(self):
        return iter(self.held)

    def clear(self):
        self.held = []

    def appendValue(self, row):  # noqa: N802
        self.held.append(row)


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):  # noqa: N802
        return State()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


FILINGS = pd.DataFrame({"key": [k % 50 for k in range(1000)], "day": range(1000), "document_id": range(1000), "length": 1.0})
VALUES = pd.DataFrame({"key": [k % 50 for k in range(1000)], "day": range(1000), "value": 1.0})


@pytest.mark.parametrize(("processor", "rows"), [(stateful.FilingDelta(180), FILINGS), (stateful.IrregularAverage(5), VALUES)])
def test_one_timer_and_one_record_for_many_entities_and_days(processor, rows):
    handle = Handle()
    processor.init(handle)
    list(processor.handleInputRows((0,), iter([rows]), None))
    assert handle.timers == [1] and len(processor.rows.held) == 1
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 500 * stateful.DAY_MS)
    (found,) = processor.handleExpiredTimer((0,), at, None)
    assert found["key"].nunique() == 50 and found["day"].max() < 500
    assert handle.timers == [1, 500 * stateful.DAY_MS + 1] and len(processor.rows.held) == 1
