"""Work grows with the records: grids are spread after the last shuffle, and nothing wide is shuffled or gathered."""

import pytest

from signalloom import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["daily_differences", "rolling_sections_months", "rolling_sections_grid", "rolling_sections_own_grid"])
def test_days_are_spread_after_the_last_shuffle(spark, sf_dir, name):
    above = plan(queries.queries()[name](spark, sf_dir)).split("Exchange")[0]
    assert "Generate explode(sequence" in above


@pytest.mark.parametrize("name", ["sector_sentiment_asof", "sector_sentiment_median", "sector_sentiment_sum", "sector_panel_ffill", "sector_pivot", "signal_features"])
def test_documents_and_entities_are_summed_without_maps(spark, sf_dir, name):
    shown = plan(queries.queries()[name](spark, sf_dir))
    assert "Aggregate(keys=[qid" not in shown and "distinct" not in shown
