"""The balls of op6 are never a broadcast, however small the file of fingerprints that they are made from."""

from signalloom.llm import simhash
from signalloom.llm.common import materialise


def test_balls_meet_the_index_by_merge(spark):
    prints = materialise(spark.range(2000).selectExpr("xxhash64(id) fp"), "ball_test")
    stored = simhash._segments(prints)
    plan = simhash.meet(stored, stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan
