"""What Spark makes of the queries: pushed filters, pruned columns, no nested loops but bounded ones."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {k: f for m in entry._modules() if not m.__name__.startswith("quern.llm") for k, f in m.QUERIES.items()}
#: Their one side is bounded: class means, or the distinct values of a score.
NESTED = {"sem_classify_embedding", "sem_join_cascade", "eval_kendall"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CORE))
def test_no_nested_loops_and_no_row_at_a_time_python(spark, name):
    text = plan(CORE[name](spark, DATA))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert name in NESTED or "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    ("name", "pushed", "read"),
    [
        ("sem_classify_label", "", "scoreSentiment:string"),
        ("cars_crashed", "EqualTo(crash,true)", "car_id:bigint,crash:boolean"),
        ("sem_filter_rule", "EqualTo(isTopCritic,true)", "isTopCritic:boolean,publicationName:string,reviewText:string"),
        ("lineitem_summary", "LessThanOrEqual(l_shipdate", "l_quantity:double"),
        ("p3_found", "", "id:string,originalScore:string"),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, read):
    text = plan(CORE[name](spark, DATA))
    assert pushed in " ".join(re.findall(r"PushedFilters: \[[^]]*\]", text))
    assert read in " ".join(re.findall(r"ReadSchema: \S+", text))


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(CORE["p3_found"](spark, DATA))
    assert "partial_count(1)" in text and text.count("Exchange") >= 2
