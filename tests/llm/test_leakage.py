from hypothesis import given, settings
from hypothesis import strategies as st

from cellweft.llm import leakage as L


def test_words():
    assert L.words_of("<b>Große</b> Ca­fé-ﬁne_x ÉCOLE 12a﻿!") == ["grosse", "cafe", "fine", "x", "ecole", "12a"]
    assert L.words_of("Café STRASSE straße") == ["cafe", "strasse", "strasse"]
    assert L.words_of(None) == [] and L.words_of("") == [] and L.words_of("a < b > c") == ["a", "c"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(2, 5))
def test_tiles_are_common_disjoint_and_found(a, b, n):
    found = L.tiles(a, b, n)
    ua, ub = set(), set()
    for i, j, k in found:
        assert k >= n and a[i:i + k] == b[j:j + k]
        assert not ua & set(range(i, i + k)) and not ub & set(range(j, j + k))
        ua |= set(range(i, i + k))
        ub |= set(range(j, j + k))
    windows = lambda x: {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}
    assert bool(found) == bool(windows(a) & windows(b))
    # The first tile is a longest common run.
    longest = max((k for k in range(n, 41) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i:i + k] == b[j:j + k]), default=0)
    assert max((k for *_, k in found), default=0) == longest


def test_repeated_words_take_no_square():
    import time

    began = time.time()
    assert L.tiles(["x"] * 100_000, ["x"] * 2_400, 12) == [(0, 0, 2_400)]
    a = (["x"] * 50 + ["y"]) * 1000
    found = L.tiles(a, a, 12)
    assert sum(k for *_, k in found) == len(a) and time.time() - began < 10


def test_window_hashes_agree_between_texts():
    w = [f"w{i % 7}" for i in range(3000)]
    h = L.window_hashes(w, 12)
    assert len(h) == 2989 and (L.window_hashes(["other"] + w[700:712], 12)[1:] == h[700:701]).all()
    assert len(set(h.tolist())) == 7 and len(L.window_hashes(w[:11], 12)) == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string")


W = [f"word{i}" for i in range(40)]


def test_reordered_interrupted_null_and_shared_loss(spark):
    rows = [
        (1, " ".join(W[20:32] + ["zz"] + W[0:12]), "clash"), (2, " ".join(W[0:11]), None), (3, None, None), (4, "", None),
        (5, " ".join(w.upper() for w in W[5:17]), None), (6, "other " * 3000 + " ".join(W[10:30]), None),
    ]
    items = spark.createDataFrame([(7, " ".join(W)), (8, None), (9, "short one")], "item_id long, text string")
    got = {(r["doc"], r["item"]): (r["n_tiles"], r["longest"], r["words"], r["coverage"]) for r in L.leaks(docs(spark, rows), items).collect()}
    assert got == {(1, 7): (2, 12, 24, 0.6), (5, 7): (1, 12, 12, 0.3), (6, 7): (1, 20, 20, 0.5)}
    assert {r["doc"] for r in L.leaks(docs(spark, rows), items, min_coverage=0.5).collect()} == {1, 6}


def test_shuffled_seeds_give_the_same(spark, sf, monkeypatch):
    d = sf("0.001")
    a, b = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    small = sorted(map(tuple, L.leaks(a, b).collect()))
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, L.leaks(a, b).collect())) == small


def test_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert L.leaks(docs(spark, [(1, "a b", "x")]), items).collect() == []
    assert L.leaks(docs(spark, []), spark.createDataFrame([(1, " ".join(W))], "item_id long, text string")).collect() == []
