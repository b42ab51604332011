"""Plan-shape checks for the scale rules: partial aggregation before every
shuffle of a per-sender statistic, top-k pages, pushed-down scans."""

from conftest import SF_SMALL
from inboxlake.operators import reputation as rep
from inboxlake.plans.catalog import queries
from inboxlake.sources.fixtures import Fixture


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sender_stats_aggregate_partially_before_shuffle(spark):
    fx = Fixture(spark, SF_SMALL)
    p = plan(rep.rebuild_scalars(rep.folded_results(fx.emails, fx.triage, fx.categories)))
    assert "partial_count" in p and "partial_sum" in p


def test_recent_actions_use_window_group_limit(spark):
    fx = Fixture(spark, SF_SMALL)
    p = plan(rep.recent_actions(rep.folded_results(fx.emails, fx.triage, fx.categories)))
    assert "WindowGroupLimit" in p


def test_queue_page_is_top_k(spark):
    p = plan(queries()["triage_queue_urgent"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_scans_prune_columns(spark):
    df = queries()["stage_metrics"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" not in p


def test_no_cartesian_products(spark):
    for name in ["knn_neighbours", "dashboard_stats", "search_exact_terms", "sender_stats_full"]:
        p = plan(queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
