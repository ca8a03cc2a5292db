"""What must hold of the physical plans."""

import contextlib
import io as text_io

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = text_io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["raw_to_trusted", "weighted_sentiment", "trusted_to_refined", "dispersion", "corpus_tfidf", "class_stats", "peak_posts"])
def test_no_python_rows_and_no_pairs(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for word in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["project_filter_basics"](spark, SF_DIR))
    assert "EqualTo(l_linestatus,F)" in text and "In(l_returnflag, [A,R])" in text and "l_suppkey" not in text
    text = plan(contract.queries()["daily_mix"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_top_terms_prune_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(contract.queries()["term_top_k"](spark, SF_DIR))


def test_daily_table_shuffles_once(spark):
    text = plan(contract.queries()["daily_table"](spark, SF_DIR))
    assert text.count("hashpartitioning") == 1
