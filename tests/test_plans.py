"""Shape of the physical plans of all registered queries."""

import os

import pytest

from palaver.operators import cleaning, common, quantiles
from palaver.plans import adapter
from palaver.plans.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
RUNS_A_MODEL = {"score_comments", "cached_answers", "cached_scoring"}
# These write tables or fit models while the query is built.
ACTS = {
    "tfidf_logreg", "csv_round_trip", "predictions_round_trip", "run_registry", "logreg_optimality",
    "benchmark_job", "stored_cache", "example_splits", "cooccurrence_wide",
}


def physical(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTS))
def test_plan_shape(spark, name):
    plan = physical(spark, QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for python in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert python not in plan
    assert ("MapInArrow" in plan) == (name in RUNS_A_MODEL)


def test_resumed_scoring_cleans_once(spark):
    plan = physical(spark, QUERIES["resumed_scoring"](spark, SF_DIR))
    assert "documents.parquet" not in plan and "FileScan" in plan


def test_scans_read_only_what_is_used(spark):
    plan = physical(spark, QUERIES["monthly_volume"](spark, SF_DIR))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("lang" in line or "props" in line for line in scans)
    assert all("o_totalprice" not in line for line in scans)
    plan = physical(spark, QUERIES["weekly_quota_sample"](spark, SF_DIR))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    pushed = scan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


@pytest.mark.parametrize(
    "name,scans",
    [("seeded_sample", 1), ("scatter_points", 1), ("avg_post_score_by_sentiment", 2)],
)
def test_texts_are_read_no_more_often_than_needed(spark, name, scans):
    plan = physical(spark, QUERIES[name](spark, SF_DIR))
    assert sum("FileScan" in line and "text#" in line for line in plan.splitlines()) <= scans


def test_funnel_shuffles_no_text(spark):
    df = QUERIES["cleaning_funnel"](spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    counting = plan.split("hashpartitioning(_key")[1].splitlines()[1]
    assert "partial_min_by" in counting and "comment_body" not in counting


def test_measured_comments_shuffle_no_text(spark):
    measured = adapter.raw_comments(spark, SF_DIR, cleaning.measure_bodies)
    comments = cleaning.clean_measured(measured)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = comments._jdf.queryExecution().explainString(formatted).split("\n\n")
    shipped = [n for n in nodes if ") Exchange" in n and "Input [" in n]
    assert len(shipped) >= 2 and not any("text#" in n or "comment_body#" in n for n in shipped)
    whole = cleaning.clean(adapter.raw_comments(spark, SF_DIR)).drop("comment_body")
    assert sorted(map(repr, comments.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_one_row_group_is_dealt_before_it_is_measured(spark, monkeypatch):
    """One task would do the work of all; the texts are shuffled once, for the join too."""
    here = adapter.raw_comments(spark, SF_DIR, cleaning.measure_bodies)
    monkeypatch.setattr(common, "TASK_ROWS", 100)
    dealt = adapter.raw_comments(spark, SF_DIR, cleaning.measure_bodies)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = dealt._jdf.queryExecution().explainString(formatted).split("\n\n")
    shipped = [n for n in nodes if ") Exchange" in n and "hashpartitioning(doc_id" in n]
    assert len(shipped) == 1 and "text#" in shipped[0]
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, here.collect()))
    split = common.dealt(spark.range(0, 1_000, 1, 8), "id")
    assert "Exchange" not in physical(spark, split)


def test_quartiles_are_taken_from_measured_comments(spark, monkeypatch):
    """What the query stores was derived without shuffling a text."""
    plans = []
    plain = quantiles._written

    def watched(df, purpose):
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plans.append(df._jdf.queryExecution().explainString(formatted))
        return plain(df, purpose)

    monkeypatch.setattr(quantiles, "_written", watched)
    QUERIES["score_quartiles"](spark, SF_DIR)
    shipped = [n for n in plans[0].split("\n\n") if ") Exchange" in n and "Input [" in n]
    assert len(shipped) >= 2 and not any("text#" in n or "comment_body#" in n for n in shipped)


def test_model_batches_need_no_shuffle_of_their_own(spark):
    from palaver.plans import catalogue

    scored = physical(spark, QUERIES["score_comments"](spark, SF_DIR))
    cleaned = physical(spark, catalogue.cleaned(spark, SF_DIR))
    assert scored.count("Exchange hash") == cleaned.count("Exchange hash")
