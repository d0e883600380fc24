"""The joins behind a sliding sector signal run once: its frames read what was written of them."""

from signalloom.operators import intervals


def test_the_input_is_not_in_the_plan(spark):
    pit = spark.sql("SELECT 'a' sectorId, id % 3 id, id documentid, date_add(DATE '2020-01-01', CAST(id AS INT)) date, 1.0D sentiment, 0.5D weight, 0.5D weighted_sentiment FROM range(40)")
    out = intervals.sliding_sector(pit, 30, "trailing")
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    last = out.orderBy("date").collect()
    assert len(last) == 69 and last[29].n_docs == 30 and last[29].n_companies == 3 and last[68].n_companies == 1
