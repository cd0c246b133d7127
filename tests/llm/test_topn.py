import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from cellweft.llm import topn

EDGE = "edge_id long, source_anchor_id string, target_anchor_id string, v2_row_normalized_transition_prob double, loaded_at timestamp_ntz, rank_no_old int"


def brute(rows, n):
    out = []
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]), key=lambda r: (-r[1], (r[2] is None, r[2] or "")))
        out += [(g, r[2], i + 1) for i, r in enumerate(best[:n])]
    return sorted(out, key=repr)


def test_hot_group_ties_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.integers(40)}", float(rng.integers(8)), f"t{i:05d}") for i in range(4000)]
    rows += [(None, 1.0, "a"), (None, None, "b"), ("g1", float("nan"), "c"), ("g2", 9.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, t string").repartition(7)
    got = topn.top_n(df, "g", "s", "t", 3).select("g", "t", "rank_no").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3)


def test_a_task_hands_on_n_rows_of_a_group_even_of_equal_scores():
    t = pa.table({"g": ["a"] * 6 + ["b"], "s": [5.0, 4, 3, 3, 2, 1, 0.5], "t": list("uvwxyzq"), "_is_bound": [False] * 7})
    kept = topn._prune(t, "g", "s", "t", 3)
    assert sorted(zip(kept.column("t").to_pylist(), kept.column("_is_bound").to_pylist())) == [("q", False), ("u", False), ("v", False), ("w", True)]
    n = 50_000
    same = pa.table({"g": [None] * n, "s": [1.0] * n, "t": [f"t{i:06d}" for i in reversed(range(n))], "_is_bound": [False] * n})
    assert sorted(topn._prune(same, "g", "s", "t", 2).column("t").to_pylist()) == ["t000000", "t000001"]


def test_hot_group_of_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(topn, "PRUNE_ROWS", 500)
    rows = [("hot", 1.0, f"t{i * 7919 % 20000:05d}") for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, s double, t string").repartition(9)
    assert sorted(map(tuple, topn.top_n(df, "g", "s", "t", 3).select("g", "t", "rank_no").collect())) == [("hot", f"t{i:05d}", i + 1) for i in range(3)]


def test_many_groups_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(topn, "PRUNE_ROWS", 100)
    rows = [(f"g{i % 900}", float(i % 17), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, t string").coalesce(1)
    assert sorted(map(tuple, topn.top_n(df, "g", "s", "t", 2).select("g", "t", "rank_no").collect()), key=repr) == brute(rows, 2)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "g string, s double, t string, extra int")
    out = topn.top_n(df, "g", "s", "t", 2)
    assert out.collect() == [] and "extra" in out.columns


def test_current_transitions_takes_later_usable_row(spark):
    from datetime import datetime as D

    rows = [
        (1, "a", "x", 0.5, D(2031, 1, 1), 0), (2, " A ", "X", 0.4, D(2031, 1, 2), 0),  # later
        (3, "a", "y", 0.3, None, 0), (4, "a", "y", 0.2, None, 0),  # null times: larger id
        (5, "a", "z", float("nan"), D(2031, 1, 3), 0), (6, "a", "z", 1.5, D(2031, 1, 3), 0), (7, "a", "z", 0.0, None, 0), (8, "a", None, 0.9, None, 0),
    ]
    got = topn.current_transitions(spark.createDataFrame(rows, EDGE)).collect()
    assert sorted(map(tuple, got)) == [("A", "X", 0.4), ("A", "Y", 0.2)]
    assert isinstance(got[0]["prob"], float) and T.DoubleType() is not None
