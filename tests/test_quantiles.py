import numpy as np
import pytest

from cellweft.operators import quantiles as Q


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_equal_to_numpy(spark, monkeypatch, accuracy):
    """Hot keys, ties, keys of one or two rows, null keys, unusable numbers; a coarse sketch gives the same."""
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    data = {"hot": rng.normal(size=3000), "tied": rng.integers(0, 4, 900).astype(float), "same": np.full(400, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), None: rng.random(11)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("hot", float("nan")), ("two", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 0.99, "f": 1.0}
    got = {r["k"]: [r[n] for n in at] for r in Q.quantiles(df, ["k"], "v", **at).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        assert np.allclose(got[k], np.quantile(v, list(at.values())))
    every = np.concatenate(list(data.values()))
    assert np.allclose(Q.quantiles(df, [], "v", m=0.5).first()["m"], np.median(every))


def test_none(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert Q.quantiles(df, ["k"], "v", m=0.5).collect() == []
    assert Q.quantiles(df, [], "v", m=0.5).first()["m"] is None
    assert Q.column_quantiles(spark.createDataFrame([(1.0, 2.0), (3.0, None)], "x double, y double"), ["x", "y"], m=0.5).first().asDict() == {"_m_x": 2.0, "_m_y": 2.0}
