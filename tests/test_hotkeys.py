from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from cellweft.operators import hotkeys as H

SCHEMA = "row_id long, slice_id string, cellbin_id string, joint_clone_id string, loaded_at timestamp_ntz, n_cellbins string"


def test_latest_row_rule(spark):
    rows = [(1, "s", "a", "x", None, "clash"), (2, "s", "a", "y", None, ""), (3, "s", "b", "x", D(2031, 1, 2), ""), (4, "s", "b", "z", D(2031, 1, 1), ""), (5, None, None, "q", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.latest_rows(df, ["slice_id", "cellbin_id"], ["joint_clone_id"], "loaded_at", "row_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("s", "a", "y"), ("s", "b", "x"), (None, None, "q")], key=repr)
    assert H.latest_rows(df.limit(0), ["slice_id"], ["cellbin_id"], "loaded_at", "row_id").collect() == []


def test_sizes_shares_and_missing_ids(spark):
    rows = [(i, " s1", f"c{i}", "A@nan" if i < 30 else f"B{i}", None, "") for i in range(40)]
    rows += [(100, "S1", "C0 ", "A@nan", None, ""), (101, "s1", "n1", "nan@ nan", None, ""), (102, "s1", "n2", " ", None, ""), (103, "s1", "n3", None, None, ""), (104, None, "c", "A", None, ""), (105, "s1", None, "A", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["slice_id"], r["joint_clone_id"]): (r["n_cellbins"], r["section_cellbins"], r["giant_clone_flag"]) for r in H.clone_sizes(df, 0.05).collect()}
    assert got[("S1", "A@nan")] == (30, 40, True) and got[("S1", "B30")] == (1, 40, False) and len(got) == 11
    assert H.clone_sizes(df.limit(0)).collect() == []
    assert {r["joint_clone_id"]: r["giant_sections"] for r in H.clone_sections(df).collect()}["A@nan"] == 1


def test_only_algebraic_states(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert H.combined(df, ["k"], n=F.count("*"), s=F.sum("id")).count() == 3
    with pytest.raises(ValueError, match="grows"):
        H.combined(df, ["k"], l=F.collect_list("id"))


def test_shuffle_carries_partial_states_only(spark):
    """A hot key is one partial state per task: the aggregate before the exchange leaves tasks x keys rows."""
    plan = H.combined(spark.range(1000).withColumn("k", F.lit(1)), ["k"], n=F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # below the exchange in the tree
