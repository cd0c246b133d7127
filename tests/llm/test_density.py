import duckdb
import numpy as np

from cellweft.llm import density as D
from cellweft.llm.queries import R


def brute(ids, slices, x):
    """Groups from every single-link cluster at many densities, settled and tested exactly."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = set()
    for s in set(slices):
        at = np.array([i for i, v in enumerate(slices) if v == s])
        v = u[at]
        for eps in (0.05, 0.1, 0.16, 0.2, 0.25, 0.3, 0.35):
            near = 1 - v @ v.T <= eps
            label = np.full(len(at), -1)
            for i in range(len(at)):
                if label[i] < 0:
                    todo = [i]
                    label[i] = i
                    while todo:
                        j = todo.pop()
                        for q in np.flatnonzero(near[j] & (label < 0)):
                            label[q] = i
                            todo.append(q)
            for g in set(label):
                m = np.flatnonzero(label == g)
                for _ in range(8):
                    if len(m) < 5:
                        break
                    c = v[m].mean(0)
                    d = 1 - v @ (c / np.linalg.norm(c))
                    new = np.flatnonzero(d <= 0.25)
                    if np.array_equal(new, m):
                        if not ((d > 0.25) & (d <= 0.35)).any():
                            names = sorted(ids[at[i]] for i in m)
                            found |= {(names[0], n) for n in names}
                        break
                    m = new
    return found


def test_found_equals_brute_force_on_whole_table(spark, sf):
    d = sf("0.001")
    rows = duckdb.sql(f"SELECT upper(trim(anchor_id)), upper(trim(slice_id)), features FROM '{d}/niche_anchors.parquet' QUALIFY row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC) = 1").fetchall()
    ok = [r for r in rows if r[2] is not None and len(r[2]) == 48 and np.isfinite(r[2]).all() and any(r[2])]
    want = brute([r[0] for r in ok], [r[1] for r in ok], np.array([r[2] for r in ok], dtype=float))
    assert {tuple(r) for r in R.queries["p5_found"](spark, d).collect()} == want and want


def test_no_group_of_a_larger_table_is_lost(spark, sf):
    d = sf("0.1")
    rows = duckdb.sql(f"SELECT upper(trim(anchor_id)), upper(trim(slice_id)), features FROM '{d}/niche_anchors.parquet' QUALIFY row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC) = 1").fetchall()
    ok = [r for r in rows if r[1] is not None and r[2] is not None and len(r[2]) == 48 and np.isfinite(r[2]).all() and any(r[2])]
    want = brute([r[0] for r in ok], [r[1] for r in ok], np.array([r[2] for r in ok], dtype=float))
    got = {tuple(r) for r in R.queries["p5_found"](spark, d).collect()}
    assert len({g for g, _ in want}) == 317 and got == want


def test_groups_that_reduction_links_come_apart(spark):
    rng = np.random.default_rng(5)
    far = [c * np.eye(8)[2] for c in (1, -1)]  # the only axis kept; the other two groups meet at its origin
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 8)) for c, n in [(np.eye(8)[0], 10), (np.eye(8)[1], 10), (far[0], 50), (far[1], 50)]])
    df = spark.createDataFrame([("s", f"a{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "slice_id string, id string, vec array<double>")
    got = {}
    for r in D.compact_groups(df, 8, params=D.DensityParams(components=1)).collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert {k: len(v) for k, v in got.items()} == {"a000": 10, "a010": 10, "a020": 50, "a070": 50}


def groups_of(members):
    got = {}
    for r in members.collect():
        got.setdefault((r["slice_id"], r["group_id"]), set()).add(r["id"])
    return {frozenset(g) for g in got.values()}


def holds(u, ids, g):
    """The definition, said on its own."""
    at = np.array([i in g for i in ids])
    m = u[at].mean(0)
    d = 1 - u @ (m / np.linalg.norm(m))
    return at.sum() >= 5 and (d[at] <= 0.25).all() and (d[~at] > 0.35).all()


def around(rng, mean, n, distance, dim):
    """``n`` unit vectors at ``distance`` from their mean direction, spread evenly around it."""
    q = rng.normal(size=(n, dim))
    q -= q.mean(0)
    q -= np.outer(q @ mean, mean)
    # Equal lengths and a zero sum, by turns.
    for _ in range(500):
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        q -= q.mean(0)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    c = 1 - distance
    return c * mean + np.sqrt(1 - c * c) * q


def test_wide_groups_without_dense_cores(spark):
    """Six vectors 0.2 from their mean and 0.43 from each other; others as wide, of several sizes, beside tight ones and strays."""
    rng = np.random.default_rng(9)
    dim, parts, rows = 32, [], []
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for s, (n, far) in enumerate([(6, 0.2), (5, 0.23), (9, 0.24), (40, 0.22)]):
        parts.append([(f"w{s}_{i:02d}", v) for i, v in enumerate(around(rng, basis[s], n, far, dim))])
    parts.append([(f"t_{i:02d}", v) for i, v in enumerate(around(rng, basis[10], 8, 0.03, dim))])
    for slice_id, some in (("only", parts[:1]), ("all", parts)):
        x = [(i, v) for p in some for i, v in p]
        if slice_id == "all":
            x += [(f"z{i:02d}", rng.normal(size=dim)) for i in range(30)]
        rows += [(slice_id, f"{slice_id}_{i}", [float(a) for a in v]) for i, v in x]
        ids, u = [i for i, _ in x], np.array([v / np.linalg.norm(v) for _, v in x])
        assert all(holds(u, ids, {i for i, _ in p}) for p in some)
    df = spark.createDataFrame(rows, "slice_id string, id string, vec array<double>")
    got = groups_of(D.compact_groups(df, dim))
    want = {frozenset(f"{s}_{i}" for i, _ in p) for s, some in (("only", parts[:1]), ("all", parts)) for p in some}
    assert want <= got
    # Of a slice cut into many small blocks, what comes out meets the definition, and the tight group is there.
    small = groups_of(D.compact_groups(df.where("slice_id = 'all'"), dim, params=D.DensityParams(block_rows=25, max_pivots=2)))
    ids = [f"all_{i}" for i in ids]
    assert small and all(holds(u, ids, g) for g in small) and frozenset(f"all_t_{i:02d}" for i in range(8)) in small


def test_blocks_of_a_slice_lose_no_group(spark):
    """A slice of far more vectors than a block: groups without dense cores, and one whose members no block of either pass holds together."""
    rng = np.random.default_rng(21)
    dim, x = 48, []
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for s in range(12):
        x += [(f"w{s:02d}_{i}", v) for i, v in enumerate(around(rng, basis[s], 6, 0.2, dim))]
    x += [(f"z{i:03d}", rng.normal(size=dim)) for i in range(120)]
    ids, u = [i for i, _ in x], np.array([v / np.linalg.norm(v) for _, v in x])
    df = spark.createDataFrame([("s", i, [float(a) for a in v]) for i, v in x], "slice_id string, id string, vec array<double>")
    want = {g for g in (frozenset(f"w{s:02d}_{i}" for i in range(6)) for s in range(12)) if holds(u, ids, g)}
    whole = groups_of(D.compact_groups(df, dim))
    cut = groups_of(D.compact_groups(df, dim, params=D.DensityParams(block_rows=12, max_pivots=2)))
    assert len(want) > 5 and want <= whole and cut == whole


def blobs(rng, n_groups, size, dim=24):
    centres = np.eye(dim)[:n_groups]
    return np.concatenate([c + 0.08 * rng.normal(size=(size, dim)) for c in centres])


def test_blocks_with_margins_merge(spark):
    rng = np.random.default_rng(4)
    x = blobs(rng, 12, 50)
    x[0:8] = x[0]  # copies count as members
    rows = [("big", f"a{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("small", f"b{i}", [float(v) for v in r]) for i, r in enumerate(blobs(rng, 1, 4))]
    df = spark.createDataFrame(rows, "slice_id string, id string, vec array<double>")
    p = D.DensityParams(block_rows=60, components=20)
    members = D.with_copies(D.compact_groups(df, 24, params=p), df)
    got = {}
    for r in members.collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == {frozenset(f"a{i:04d}" for i in range(50 * k, 50 * k + 50)) for k in range(12)}
    top = D.typical_members(members).collect()
    assert all(r["size"] == 50 and len(r["typical"]) == 3 for r in top)


def test_empty_and_null_slice(spark):
    schema = "slice_id string, id string, vec array<double>"
    assert D.compact_groups(spark.createDataFrame([], schema), 3).collect() == []
    assert D.compact_groups(spark.createDataFrame([(None, "a", [1.0, 0.0, 0.0])], schema), 3).collect() == []
