"""Physical plan shapes that the design relies on at scale."""

from affinity.catalog import QUERIES, ratings
from affinity.operators import features as FT
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_scan_is_pruned(spark):
    plan = _plan(QUERIES["read_events_parquet"](spark, SF_SMALL))
    read = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    assert "props" in read and "value" not in read  # implicit events do not read the score column


def test_engagement_uses_hash_aggregates_and_broadcast_scores(spark):
    plan = _plan(QUERIES["engagement_ratings"](spark, SF_SMALL))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("HashAggregate") >= 4  # partial + final, twice
    assert "BroadcastHashJoin" in plan  # by measured size; nothing forces it


def test_no_cross_or_nested_loop_joins(spark):
    for name in ("purchase_preferences", "build_purchase_preferences", "engagement_ratings"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_matrix_has_no_window_and_no_python_udf(spark):
    ff = FT.prepare(ratings(spark, SF_SMALL))
    for df in (ff.matrix(), ff.rated_block()):
        plan = _plan(df)
        assert "Window" not in plan  # no per-user window: ordering came from the range-partitioned pass
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_preferences_read_their_inputs_once(spark):
    """With broadcasts off, as for large inputs: the final plan reads the stored line counts only, and joins can spill."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES["purchase_preferences"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("line-counts" in line and "l_orderkey" not in line for line in scans)
