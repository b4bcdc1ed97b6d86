"""Physical-plan properties the operators are designed for (checked with the
executed plan, as ``explain`` shows it)."""
import pytest

from tests.conftest import SF_DIR
from tonality.plans import load_all

QUERIES = load_all()


def plan(spark, name):
    df = QUERIES[name].build(spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,limit", [("class_quota", 150), ("error_term_frequency", 20), ("articles_in_window", 30)])
def test_top_k_is_a_map_side_group_limit(spark, name, limit):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p and "Partial" in p and f"row_number(), {limit}" in p


def test_window_join_has_equi_keys(spark):
    p = plan(spark, "articles_in_window")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "HashJoin [ticker" in p or "SortMergeJoin [ticker" in p


def test_filter_and_columns_reach_the_scan(spark):
    p = plan(spark, "filter_equals")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in p


@pytest.mark.parametrize("name", ["class_report", "consensus_label", "negation_antonym", "random_deletion_sentence",
                                  "pad_truncate_tokens", "confidence_slices"])
def test_no_python_in_the_plan(spark, name):
    p = plan(spark, name)
    assert "EvalPython" not in p and "PythonUDF" not in p


def test_evaluation_is_one_aggregate_per_run(spark):
    p = plan(spark, "overall_metrics")
    assert p.count("Exchange hashpartitioning(model") == 1  # a single shuffle on the run keys
