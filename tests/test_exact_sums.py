"""Shares of a source do not depend on the order of its rows, and halves go up as in decimal arithmetic."""

import math
from collections import defaultdict
from fractions import Fraction

import pytest

from cellweft.operators import markov
from cellweft.plans.transitions import _DAYED, R
from oracle import connect

P = [0.001] * 4 + [0.01] * 3 + [0.02, 0.03] + [0.04] * 5 + [0.05] * 3 + [0.07, 0.08, 0.1, 0.34]  # 1.024 in all


def orders(p):
    return [sorted(p), sorted(p, reverse=True), p[::2] + p[1::2], p[7:] + p[:7]]


def tables(spark, p):
    e = spark.createDataFrame([("a", f"t{i}", v) for i, v in enumerate(p)], "src string, dst string, p double").coalesce(1)
    return e, spark.createDataFrame([("a",)], "id string")


def test_self_loops_by_exact_sums(spark):
    assert len({sum_in_order(p) for p in orders(P)}) > 1
    for p in orders(P):
        e, nodes = tables(spark, p)
        assert sorted(r["p"] for r in markov.with_self_loops(nodes, e).collect()) == sorted(v / math.fsum(p) for v in p)


def test_mixture_by_exact_sums(spark):
    for p in orders(P):
        e, nodes = tables(spark, p)
        w = [v * 0.85 for v in p] + [0.05]
        assert sorted(r["p"] for r in markov.mixture([(e, 0.85)], nodes, 0.05).collect()) == sorted(v / math.fsum(w) for v in w)


def sum_in_order(p):
    s = 0.0
    for v in p:
        s += v
    return s


@pytest.mark.parametrize(("name", "digits"), [("m10_self_loops", 6), ("m17_mixture", 5)])
def test_whole_table_equals_fractions(spark, sf, name, digits):
    """Its SQL adds doubles in an order of threads and differs from itself at halves; fractions do not."""
    con = connect(sf("0.01"))
    parts, total = defaultdict(Fraction), defaultdict(Fraction)
    ids = [i for (i,) in con.execute(_DAYED + " SELECT id FROM nodes").fetchall()]
    for src, dst, p, same in con.execute(_DAYED + " SELECT src, dst, p, source_day = target_day FROM de").fetchall():
        part = Fraction(1) if name == "m10_self_loops" else Fraction(0) if same is None else Fraction("0.85") if same else Fraction("0.1")
        if part:
            parts[src, dst] += part * Fraction(repr(p))
    sources = {s for s, _ in parts}
    for i in ids:
        if name == "m17_mixture":
            parts[i, i] += Fraction("0.05")
        elif i not in sources:
            parts[i, i] = Fraction(1)
    for (s, _), v in parts.items():
        total[s] += v
    want = {k: math.floor(v / total[k[0]] * 10**digits + Fraction(1, 2)) / 10**digits for k, v in parts.items()}
    assert {(r["src"], r["dst"]): r["p"] for r in R.queries[name](spark, sf("0.01")).collect()} == want
