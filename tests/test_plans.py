"""Plans: columns are pruned, filters pushed, and native queries hold no Python."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from httplens.operators import features
from httplens.plans import inputs
from httplens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PYTHON = {"network_scores_batched", "rl_replay", "rl_session", "ga_fitness", "residual_loads", "partition_manifest", "index_digests"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("url_components", {"page_id", "url"}), ("content_metrics_text", {"conv_id", "turn", "text"}), ("rl_rewards", {"event_id", "value"}), ("class_counts", {"toxic"}), ("index_digests", {"vec_id", "label"})])
def test_scans_read_what_is_used(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()[name](spark, SF)))
    assert read and all({c.split(":")[0] for c in r.split(",")} == columns for r in read)


def test_filters_reach_the_scan(spark):
    df = inputs.table(spark, SF, "events").where("event_type = 'click' and value > 3").select("event_id")
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,click\).*GreaterThan\(value,3.0\)", plan(df))


def test_unused_features_cost_nothing(spark):
    r = inputs.pages_as_requests(spark, SF)
    few = plan(features.candidates(r, ("method_is_get",), ("page_id",)))
    assert "aggregate" not in few and "html" not in few


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.__module__.endswith(".queries")))
def test_queries_stay_in_the_engine(spark, name):
    df = entry.queries()[name](spark, SF)
    text = plan(df)
    assert bool(re.search("Python|Pandas|Arrow", text)) == (name in PYTHON)
    assert "CartesianProduct" not in text and F is not None
