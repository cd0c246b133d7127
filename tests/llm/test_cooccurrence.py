from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from cellweft.llm import cooccurrence as C

S = C.MEMBER


def brute(rows, min_count, min_ratio):
    b = {(s or "", k, i) for s, k, i in rows if k is not None and i is not None}
    n, m, t = Counter(), Counter(), Counter()
    sets = {}
    for s, k, i in b:
        sets.setdefault(k, set()).add(i)
    for s, i, _ in {(s, i, k) for s, k, i in b}:
        m[s, i] += 1
    for s, _ in {(s, k) for s, k, _ in b}:
        t[s] += 1
    for items in sets.values():
        for pair in combinations(sorted(items), 2):
            n[pair] += 1
    out = {}
    for (l, r), o in n.items():
        e = sum(m[s, l] * m[s, r] / t[s] for s in t)
        if o >= min_count and (e == 0 or o / e >= min_ratio):
            out[l, r] = (o, round(e, 9))
    return out


def got(store, only=None):
    return {(r["left"], r["right"]): (r["observed"], round(r["expected"], 9)) for r in store.scores(only).collect()}


def baskets(seed, n=60):
    rng = np.random.default_rng(seed)
    return [(f"s{k % 3}", f"k{k}", f"i{int(rng.zipf(1.6)) % 25:02d}") for k in range(n) for _ in range(5)]


def test_updates_equal_a_fresh_count_and_outlive_the_object(spark, tmp_path):
    f = lambda rows: spark.createDataFrame(rows, S)
    first, more = baskets(1), [(s, "x" + k, i) for s, k, i in baskets(2, 20)]
    for least, ratio in ((1, 0.0), (3, 1.2)):
        path = f"file://{tmp_path}/{least}"
        C.PairStore(spark, path, least, ratio, 4).apply(None, f(first))
        assert got(C.PairStore(spark, path, least, ratio, 4)) == brute(first, least, ratio)
        # Baskets arrive, one changes and one goes; the store is opened anew.
        k1, k2 = [r for r in first if r[1] == "k1"], [r for r in first if r[1] == "k2"]
        changed = [("s1", "k1", "i01"), ("s1", "k1", "i77")]
        now = [r for r in first if r[1] not in ("k1", "k2")] + more + changed
        store = C.PairStore(spark, path, least, ratio, 4)
        touched = store.apply(f(k1 + k2), f(more + changed))
        again = C.PairStore(spark, path, least, ratio, 4)
        assert again.generation == 2 and got(again) == got(store) == brute(now, least, ratio)
        names = {r["item"] for r in touched.collect()}
        assert got(store, touched) == {p: v for p, v in brute(now, least, ratio).items() if names & set(p)}
        with pytest.raises(ValueError):
            C.PairStore(spark, path, least + 1, ratio, 4)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rows = [("s", f"b{i}", x) for i in range(40) for x in (f"i{i}", f"j{i}")]
    store = C.PairStore(spark, f"file://{tmp_path}/p", 1, 0.0, 16)
    store.apply(None, spark.createDataFrame(rows, S))
    before = dict(store.files)
    store.apply(None, spark.createDataFrame([("s", "new", "i0"), ("s", "new", "j0")], S))
    for table in ("pairs", "members"):
        assert sum(before[k] != store.files[k] for k in before if k[0] == table) == 1
    assert got(store)["i0", "j0"][0] == 2


def test_pairs_across_sections_are_kept(spark, tmp_path):
    """``l`` in ten baskets of section A, ``r`` in one of them there and in the other nine only in section B."""
    rows = [("A", f"k{i}", "l") for i in range(10)] + [("A", "k0", "r")] + [("B", f"k{i}", "r") for i in range(1, 10)]
    rows += [("B", f"z{i}", "w") for i in range(30)]
    for ratio in (0.0, 7.31):
        store = C.PairStore(spark, f"file://{tmp_path}/{ratio}", 4, ratio, 4)
        store.apply(None, spark.createDataFrame(rows, S))
        assert got(store) == brute(rows, 4, ratio) == {("l", "r"): (10, 1.0)}


def test_huge_basket_is_blocked(spark, tmp_path):
    rows = [("s", "big", f"i{i:03d}") for i in range(100)] + [("s", "b2", "i000"), ("s", "b2", "i099")]
    store = C.PairStore(spark, f"file://{tmp_path}/p", block_items=16)
    store.apply(None, spark.createDataFrame(rows, S))
    assert got(store) == brute(rows, 1, 0.0)


def test_nulls_repeats_empty(spark, tmp_path):
    rows = [("s", "a", "x"), ("s", "a", "x"), ("s", "a", "y"), (None, "a", "z"), ("s", None, "x"), ("s", "b", None)]
    store = C.PairStore(spark, f"file://{tmp_path}/p")
    store.apply(None, spark.createDataFrame(rows, S))
    # z lies in another section, so chance gives none of it with x or y.
    assert got(store) == {("x", "y"): (1, 1.0), ("x", "z"): (1, 0.0), ("y", "z"): (1, 0.0)}
    none = C.PairStore(spark, f"file://{tmp_path}/none")
    assert got(none) == {}
    none.apply(None, spark.createDataFrame([], S))
    assert got(none) == {}
