import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweft.operators import spatial as G

SCHEMA = "group string, id string, x double, y double, l string"


def points(spark, xy, group="g"):
    return spark.createDataFrame([(group, f"p{i:03d}", float(a), float(b), None) for i, (a, b) in enumerate(xy)], SCHEMA)


def test_unit_square(spark):
    p = points(spark, [(0, 0), (1, 0), (0, 1), (1, 1)])
    assert G.within_radius(p, 1.1).count() == 8
    assert G.symmetric(G.nearest(p, 2)).count() == 8
    assert G.first_neighbour_distance(p).collect()[0]["r"] == 1.0
    assert G.delaunay(p).count() == 5
    assert G.degree_summary(p, G.within_radius(p, 1.1)).collect()[0]["n_edges"] == 4


def test_nearest_equals_brute_force_with_outliers_and_copies(spark):
    rng = np.random.default_rng(0)
    xy = np.r_[rng.normal(size=(60, 2)), [[500, 500], [500, 500], [-900, 3]]]
    p = points(spark, xy).unionByName(points(spark, [(0, 0)], "one"))
    got = {}
    for r in G.nearest(p, 3).collect():
        got.setdefault(r["src"] + r["group"], []).append((r["d"], r["dst"]))
    for i in range(len(xy)):
        d = sorted((float(np.hypot(*(xy[i] - xy[j]))), f"p{j:03d}") for j in range(len(xy)) if j != i)[:3]
        assert [b for _, b in sorted(got[f"p{i:03d}g"])] == [b for _, b in d]
    assert "p000one" not in got


def test_unusable_and_empty(spark):
    raw = spark.createDataFrame([("g", "a", 1.0, float("nan")), ("g", "b", None, 1.0), ("g", "c", float("inf"), 1.0), ("g", None, 1.0, 1.0), ("g", "d", 1.0, 2.0)], "s string, k string, x double, y double")
    p = G.located(raw, "s", "k")
    assert [r["id"] for r in p.collect()] == ["d"]
    e = p.where("id = 'z'")
    assert G.nearest(e, 2).collect() == [] and G.within_radius(e, 1.0).collect() == [] and G.delaunay(e).collect() == []
    assert G.first_neighbour_distance(p).collect()[0]["r"] == 0.0 and G.normalised(p).collect()[0]["xn"] == 0.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=3, max_size=14, unique=True))
def test_triangulation_is_delaunay(cells):
    rng = np.random.default_rng(1)
    xy = np.array(cells, dtype=float) + 0.01 * rng.random((len(cells), 2))
    e = {tuple(x) for x in G.triangulation_edges(xy)}
    n = len(xy)
    for a in range(n):
        for b in range(a + 1, n):
            for c in range(b + 1, n):
                m = 2 * (xy[[b, c]] - xy[a])
                if abs(np.linalg.det(m)) < 1e-3:
                    continue
                o = np.linalg.solve(m, (xy[[b, c]] ** 2).sum(1) - (xy[a] ** 2).sum())
                r2 = ((xy[a] - o) ** 2).sum()
                others = [k for k in range(n) if k not in (a, b, c)]
                if all(((xy[k] - o) ** 2).sum() > r2 * (1 + 1e-6) for k in others) and r2 < 1e4:
                    assert {(a, b), (a, c), (b, c)} <= e  # an empty circle's triangle is in the triangulation


def test_collinear_has_no_triangles():
    assert len(G.triangulation_edges(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 0


def test_means_that_round_to_zero_keep_their_sign(spark, tmp_path):
    """As in the SQL, byte for byte; numbers alone compare equal."""
    from cellweft.plans.spatial import R as Q
    from oracle import connect

    schema = "anchor_id string, slice_id string, time string, time_day int, mouse_id string, anchor_index bigint, cell_type_l1 string, cell_type_l2 string, cell_type_l3 string, x double, y double, rep_version int, features array<float>"
    rows = [(f"s::{i}", "s", "D0", 0, "m", i, "a", "b", "c", float(i), 0.0, 1, [f, -f] + [1.5 * i] * 46) for i, f in enumerate((-0.000004, 0.000002, -0.000003))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/spark")
    next(tmp_path.glob("spark/*.parquet")).rename(tmp_path / "niche_anchors.parquet")
    got = sorted((r["anchor"], repr(list(r["mean_vector"])), repr(list(r["var_vector"]))) for r in Q.queries["g14_mean_variance"](spark, str(tmp_path)).collect())
    want = sorted((a, repr(m), repr(v)) for a, m, v in connect(str(tmp_path)).execute(Q.sql["g14_mean_variance"]).fetchall())
    assert got == want and got[0][1].startswith("[-0.0, 0.0,")
