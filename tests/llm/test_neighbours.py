import numpy as np

from cellweft.llm import neighbours as N


def frame(spark, x, ids=None):
    ids = ids or [f"v{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], "id string, vec array<double>")


def brute(ids, x, k, far):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(0, np.round(1 - u @ u.T, 12))
    out = {}
    for i in range(len(x)):
        near = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i and d[i, j] <= far)[:k]
        out[ids[i]] = [b for _, b in near]
    return out


def test_exact_setting_with_copies_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    x[50:75] = x[50]  # copies, more than k
    x[80] = 3 * x[81]  # same direction
    ids = [f"v{(i * 37) % 1000:04d}" for i in range(len(x))]
    got = {r["id"]: r["indices"] for r in N.most_similar(frame(spark, x, ids), 6, 4, params=N.EXACT).collect()}
    assert got == brute(ids, x, 4, 2.0)


def test_recall_with_learned_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(60, size=6000)] + 0.35 * rng.normal(size=(6000, 16))
    df = frame(spark, x)
    p = N.RouterParams(part_rows=400, sample_size=3000, block_rows=300, block_queries=900)
    listed = N.most_similar(df, 16, 5, params=p)
    row = N.recall_at_k(listed, df, 16, 5, 2.0, every=20).first()
    assert row["queries"] > 200 and row["recall"] >= 0.9


def test_close_pairs_of_whole_tables_of_two_sizes(spark, sf):
    """The registered query against all pairs by numpy, and recall over all distances, on 1,500 and 15,000 anchors."""
    import duckdb

    from cellweft.llm.queries import R, _anchors
    from cellweft.plans.registry import Tables

    for size in ("0.01", "0.1"):
        rows = duckdb.sql(f"SELECT upper(trim(anchor_id)), features FROM '{sf(size)}/niche_anchors.parquet' QUALIFY row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC) = 1").fetchall()
        ok = [r for r in rows if r[1] is not None and len(r[1]) == 48 and np.isfinite(r[1]).all() and any(r[1])]
        ids, u = np.array([r[0] for r in ok], dtype=object), N._unit(np.array([r[1] for r in ok], dtype=float))
        want = set()
        for a in range(0, len(u), 2000):
            d = np.maximum(0, np.round(1 - u[a:a + 2000] @ u.T, 12))
            d[np.arange(len(d)), np.arange(a, a + len(d))] = 9
            for i, j in zip(*np.nonzero(d <= 0.02)):
                near = np.flatnonzero(d[i] <= 0.02)
                if j in sorted(near, key=lambda x: (d[i, x], ids[x]))[:5]:
                    want.add((min(ids[a + i], ids[j]), max(ids[a + i], ids[j])))
        assert {tuple(r) for r in R.queries["p1_found"](spark, sf(size)).collect()} == want and want
        v = _anchors(Tables(spark, sf(size)))
        assert N.recall_at_k(N.most_similar(v, 48, 5), v, 48, 5, 2.0, every=10).first()["recall"] >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    u = N._unit(rng.normal(size=(1000, 8)))
    part = N.balanced_parts(u, N._knn(u, 8), 10, rng)
    assert np.bincount(part, minlength=10).max() <= 105 and (np.bincount(part, minlength=10) > 0).all()


def test_unusable_and_empty(spark):
    rows = [("a", [1.0, 2.0]), ("b", [1.0, float("nan")]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [1.0, None]), ("g", [float("inf"), 1.0]), (None, [1.0, 1.0]), ("h", [2.0, 4.0])]
    df = N.usable_vectors(spark.createDataFrame(rows, "k string, v array<double>"), "k", "v", 2)
    assert sorted(r["id"] for r in df.collect()) == ["a", "h"]
    got = {r["id"]: (r["indices"], r["distances"]) for r in N.most_similar(df, 2, 3).collect()}
    assert got == {"a": (["h"], [0.0]), "h": (["a"], [0.0])}
    assert N.most_similar(df.where("id = 'zzz'"), 2, 3).collect() == []


def test_latest_version(spark):
    rows = [(" m::1", "s", 1, [1.0]), ("M::1", "s", 2, None), ("M::2", "S", 1, [2.0]), (None, "s", 1, [3.0])]
    got = N.current_anchors(spark.createDataFrame(rows, "anchor_id string, slice_id string, rep_version int, features array<float>")).collect()
    assert sorted((r["anchor_id"], r["features"]) for r in got) == [("M::1", None), ("M::2", [2.0])]
