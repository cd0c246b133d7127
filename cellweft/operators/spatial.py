"""Spatial neighbourhoods within groups (slices) of located points.

Range and nearest-neighbour joins bucket points into a grid whose cells are as wide as the search radius, so a point meets only the
points of its own and the adjacent cells: an equi-join on the cell, never all pairs. Points have columns ``group``, ``id``, x, y.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalars import finite
from cellweft.operators.quantiles import group_ranks, quantiles, with_quantiles
from cellweft.session import cut, release


def located(df: DataFrame, group: str, id_col: str, x: str = "x", y: str = "y", *keep: str) -> DataFrame:
    """(group, id, x, y, kept): rows with finite coordinates as doubles (G1)."""
    return df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), finite(x).alias("x"), finite(y).alias("y"), *keep).where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")


def normalised(points: DataFrame) -> DataFrame:
    """Adds xn, yn: centred on the per-axis median of the group and divided by the median distance from it, or by 1 if that is 0."""
    mid = quantiles(points, ["group"], "x", mx=0.5).join(quantiles(points, ["group"], "y", my=0.5), "group")
    c = points.join(mid, "group").withColumn("cx", F.col("x") - F.col("mx")).withColumn("cy", F.col("y") - F.col("my"))
    size = quantiles(c, ["group"], F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2), s=0.5)
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return c.join(size, "group").withColumn("xn", F.col("cx") / s).withColumn("yn", F.col("cy") / s).drop("mx", "my", "cx", "cy", "s")


def within_radius(points: DataFrame, radius: float | DataFrame) -> DataFrame:
    """(group, src, dst, d) for all ordered pairs of distinct points of a group at most ``radius`` apart.

    ``radius`` is a number above 0 or a frame (group, r). Both directions are given, so the graph is symmetric.
    """
    p = points.withColumn("r", F.lit(float(radius))) if isinstance(radius, (int, float)) else points.join(radius.select("group", "r"), "group")
    if isinstance(radius, (int, float)) and radius <= 0:
        raise ValueError("radius must be positive")
    p = p.where("r > 0").withColumn("cx", F.floor(F.col("x") / F.col("r"))).withColumn("cy", F.floor(F.col("y") / F.col("r")))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    b = p.select("group", F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    b = b.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("group", "dst", "bx", "by", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    d2 = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2
    j = p.select("group", F.col("id").alias("src"), "x", "y", "r", "cx", "cy").join(b, ["group", "cx", "cy"]).where(F.col("src") != F.col("dst"))
    return j.withColumn("d2", d2).where(F.col("d2") <= F.col("r") * F.col("r")).select("group", "src", "dst", F.sqrt("d2").alias("d"))


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(group, src, dst, d, rank): the k nearest other points of each point in its group, ties by dst.

    Exact: a first radius is guessed from the group's density; points that have fewer than k others within it are asked again with
    twice the radius, and so on until it spans the group. Each round is a range join over the points that are still open.
    """
    box = points.groupBy("group").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    span = F.sqrt(F.col("w") ** 2 + F.col("h") ** 2)
    guess = F.greatest(F.sqrt(F.greatest(F.col("w"), F.lit(1e-9)) * F.greatest(F.col("h"), F.lit(1e-9)) * (k + 1) / F.col("n")), span * 1e-3, F.lit(1e-9))
    box = cut(box.select("group", "n", guess.alias("r"), (span * 1.0001 + 1e-9).alias("span")))
    open_, parts = cut(points.select("group", "id", "x", "y")), []
    pts = points.select("group", "id", "x", "y")
    w = Window.partitionBy("group", "src").orderBy("d", "dst")
    for turn in range(40):
        r = box.select("group", "span", (F.col("r") * 2.0**turn).alias("r"))
        found = _range_between(open_, pts, r).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        done = found.groupBy("group", "src").agg(F.count("*").alias("got"))
        state = open_.join(done.withColumnRenamed("src", "id"), ["group", "id"], "left").join(r, "group")
        # Settled: k neighbours, or a radius that spans the whole group.
        state = state.withColumn("settled", (F.coalesce("got", F.lit(0)) >= k) | (F.col("r") >= F.col("span")))
        settled = state.where("settled").select("group", F.col("id").alias("src"))
        parts.append(cut(found.join(settled, ["group", "src"])))
        rest = cut(state.where("NOT settled").select("group", "id", "x", "y"))
        release(open_)
        open_ = rest
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _range_between(a: DataFrame, b: DataFrame, radius: DataFrame) -> DataFrame:
    r = radius.select("group", "r")
    cell = lambda df, x, y: df.withColumn("cx", F.floor(F.col(x) / F.col("r"))).withColumn("cy", F.floor(F.col(y) / F.col("r")))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = cell(a.join(r, "group"), "x", "y").withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    left = left.select("group", F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "r", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    # Only groups that still have open points.
    live = left.select("group").distinct()
    right = cell(b.join(r, "group").join(live, "group", "left_semi"), "x", "y").select("group", F.col("id").alias("dst"), "x", "y", "cx", "cy")
    j = left.join(right, ["group", "cx", "cy"]).where("src <> dst").withColumn("d2", (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)
    return j.where(F.col("d2") <= F.col("r") ** 2).select("group", "src", "dst", F.sqrt("d2").alias("d"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges with their reverses, distinct."""
    e = edges.select("group", "src", "dst", "d")
    return e.unionByName(e.select("group", F.col("dst").alias("src"), F.col("src").alias("dst"), "d")).groupBy("group", "src", "dst").agg(F.min("d").alias("d"))


def first_neighbour_distance(points: DataFrame) -> DataFrame:
    """(group, r): median distance to the nearest other point; 0 for a group of one."""
    d = nearest(points, 1)
    return with_quantiles(points.select("group").distinct(), d, ["group"], "d", r=0.5).select("group", F.coalesce("r", F.lit(0.0)).alias("r"))


def delaunay(points: DataFrame) -> DataFrame:
    """(group, src, dst), src < dst: edges of the Delaunay triangulation of each group.

    A group of fewer than three points, or of collinear ones, has none. Points at one place count as their smallest id. One group is
    one task, as a triangulation of a slice is; slices are bounded by what was imaged at once.
    """

    def edges(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id").drop_duplicates(["x", "y"])
        e = triangulation_edges(p[["x", "y"]].to_numpy(dtype=float))
        ids = p["id"].to_numpy()
        a, b = (ids[e[:, 0]], ids[e[:, 1]]) if len(e) else (ids[:0], ids[:0])
        swap = a > b
        return pd.DataFrame({"group": p["group"].iloc[0] if len(p) else None, "src": np.where(swap, b, a), "dst": np.where(swap, a, b)})

    kind = points.schema["id"].dataType.simpleString()
    return points.select("group", "id", "x", "y").groupBy("group").applyInPandas(edges, f"group string, src {kind}, dst {kind}")


def triangulation_edges(xy: np.ndarray) -> np.ndarray:
    """Index pairs (i < j) of the Delaunay edges of distinct points, by incremental insertion (Bowyer-Watson).

    Points come in the order of rows of a grid, to and fro, so each is found by a short walk from the triangle made last; what it
    replaces is found from there by neighbours, so a point costs about the same however many there are.
    """
    n = len(xy)
    if n < 3:
        return np.zeros((0, 2), dtype=int)
    centre, size = xy.mean(0), max(np.ptp(xy[:, 0]), np.ptp(xy[:, 1]), 1e-12)
    q = (xy - centre) / size
    if np.linalg.matrix_rank(q - q[0], tol=1e-9) < 2:
        return np.zeros((0, 2), dtype=int)
    far = 1e4
    px, py = [*q[:, 0].tolist(), -far, far, 0.0], [*q[:, 1].tolist(), -far, -far, far]
    corners: list[tuple[int, int, int] | None] = [(n, n + 1, n + 2)]
    beside: list[list[int]] = [[-1, -1, -1]]  # across the edge opposite to each corner

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        a, b, c = t
        bx, by, ex, ey = px[b] - px[a], py[b] - py[a], px[c] - px[a], py[c] - py[a]
        d = 2 * (bx * ey - by * ex)
        d = d if abs(d) > 1e-300 else 1e-300
        b2, e2 = bx * bx + by * by, ex * ex + ey * ey
        ux, uy = (ey * b2 - by * e2) / d, (bx * e2 - ex * b2) / d
        return px[a] + ux, py[a] + uy, (ux * ux + uy * uy) * (1 + 1e-12)

    circles = [circle(corners[0])]  # type: ignore[arg-type]
    strips = max(1, int(np.sqrt(n / 2)))
    row = np.minimum(((q[:, 1] - q[:, 1].min()) / max(np.ptp(q[:, 1]), 1e-12) * strips).astype(int), strips - 1)
    order = np.lexsort((np.where(row % 2 == 0, q[:, 0], -q[:, 0]), row)).tolist()
    last = 0
    for i in order:
        x, y = px[i], py[i]
        inside = lambda t: (x - circles[t][0]) ** 2 + (y - circles[t][1]) ** 2 < circles[t][2]
        at = last
        for _ in range(4 * len(corners) + 8):
            a = corners[at]
            for k in range(3):
                u, v = a[(k + 1) % 3], a[(k + 2) % 3]  # type: ignore[index]
                if (px[v] - px[u]) * (y - py[u]) - (py[v] - py[u]) * (x - px[u]) < 0 and beside[at][k] >= 0:
                    at = beside[at][k]
                    break
            else:
                break
        if not inside(at):  # rounding on a thin triangle: look everywhere
            at = next((t for t, c in enumerate(corners) if c is not None and inside(t)), at)
        bad, todo, rim = {at}, [at], []
        while todo:
            t = todo.pop()
            for k in range(3):
                o = beside[t][k]
                if o in bad:
                    continue
                if o >= 0 and inside(o):
                    bad.add(o)
                    todo.append(o)
        for t in bad:
            a = corners[t]
            rim += [(a[(k + 1) % 3], a[(k + 2) % 3], beside[t][k]) for k in range(3) if beside[t][k] not in bad]  # type: ignore[index]
        ends: dict[int, tuple[int, int]] = {}
        for u, v, o in rim:
            t = len(corners)
            corners.append((i, u, v)), beside.append([o, -1, -1]), circles.append(circle((i, u, v)))
            if o >= 0:
                b = corners[o]
                k = next(k for k in range(3) if b[k] not in (u, v))  # type: ignore[index]
                beside[o][k] = t
            for end, k in ((u, 2), (v, 1)):  # the edges to the new point lie opposite to v and to u
                if end in ends:
                    t2, k2 = ends.pop(end)
                    beside[t][k], beside[t2][k2] = t2, t
                else:
                    ends[end] = (t, k)
            last = t
        for t in bad:
            corners[t] = None
    tri = np.array([c for c in corners if c is not None and max(c) < n], dtype=int).reshape(-1, 3)
    e = np.sort(np.r_[tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]], axis=1)
    return np.unique(e, axis=0)


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, id, degree): out-edges of each point, 0 for isolated ones."""
    d = edges.groupBy("group", F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return points.select("group", "id").join(d, ["group", "id"], "left").select("group", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_summary(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, n_nodes, n_edges, mean_degree, median_degree, max_degree) of a symmetric graph."""
    return degrees(points, edges).groupBy("group").agg(
        F.count("*").alias("n_nodes"), F.floor(F.sum("degree") / 2).alias("n_edges"), F.avg("degree").alias("mean_degree"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"))


def neighbour_groups(points: DataFrame, k: int) -> DataFrame:
    """(group, anchor, member, role, group_id): each point with its k-1 nearest others, itself as ``center``."""
    near = nearest(points, k - 1).select("group", F.col("src").alias("anchor"), F.col("dst").alias("member"), F.lit("member").alias("role"))
    own = points.select("group", F.col("id").alias("anchor"), F.col("id").alias("member"), F.lit("center").alias("role"))
    return own.unionByName(near).withColumn("group_id", F.concat(F.col("group"), F.lit("__"), F.col("anchor"), F.lit("__k"), F.lit(str(k))))


def multiplicity(groups: DataFrame) -> DataFrame:
    """One row: in how many groups a point is, mean, median and largest."""
    n = groups.groupBy("group", "member").agg(F.countDistinct("group_id").alias("n"))
    return n.agg(F.count("*").alias("n_points"), F.avg("n").alias("mean_groups"), F.median("n").alias("median_groups"), F.max("n").alias("max_groups"))


def equal_bin(rank: str, size: str, q: int) -> Column:
    """Bin 0..q-1 of equal frequency by 0-based rank (quantile cut of first ranks, in closed form; not ntile)."""
    r, n = F.col(rank), F.col(size)
    # ceil(r*q/(n-1)) - 1 in whole numbers.
    up = F.when(n > 1, F.floor((r * q + (n - 2)) / F.nullif(n - 1, F.lit(0)))).otherwise(0)
    return F.greatest(up - 1, F.lit(0)).cast("int")


def tiles(points: DataFrame, q: int) -> DataFrame:
    """Adds tile_x, tile_y (equal-frequency bins per axis) and ``tile_id`` such as ``g__tile_x03_y11``."""
    t = group_ranks(points, ["group"], ["x", "id"], "_rx", "_nx").withColumn("tile_x", equal_bin("_rx", "_nx", q)).drop("_rx", "_nx")
    t = group_ranks(t, ["group"], ["y", "id"], "_ry", "_ny").withColumn("tile_y", equal_bin("_ry", "_ny", q)).drop("_ry", "_ny")
    return t.withColumn("tile_id", F.format_string("%s__tile_x%02d_y%02d", "group", "tile_x", "tile_y"))


def with_self(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, anchor, member, d): neighbours and the anchor itself, distinct."""
    e = edges.select("group", F.col("src").alias("anchor"), F.col("dst").alias("member"), "d")
    return e.unionByName(points.select("group", F.col("id").alias("anchor"), F.col("id").alias("member"), F.lit(0.0).alias("d"))).dropDuplicates(["group", "anchor", "member"])


def neighbour_arrays(members: DataFrame) -> DataFrame:
    """(group, anchor, members array): the ragged form, sorted (S6, G11). Bounded by the neighbours of a point."""
    return members.groupBy("group", "anchor").agg(F.sort_array(F.collect_list("member")).alias("members"))


def neighbour_features(points: DataFrame, members: DataFrame, labels: Sequence[str], vector: str | None = None) -> DataFrame:
    """One row per anchor: counts and distances of its neighbourhood, and per label column its richness, entropy and top share.

    ``points`` carry the label columns and, if ``vector`` is named, an array column whose mean and population variance over
    members are given as arrays. Members without a label do not count for that label.
    """
    m = members.join(points.select("group", F.col("id").alias("member"), *labels, *([vector] if vector else [])), ["group", "member"])
    own = F.col("anchor") == F.col("member")
    out = members.groupBy("group", "anchor").agg(F.count("*").alias("n_neighbors"), F.coalesce(F.avg(F.when(~own, F.col("d"))), F.lit(0.0)).alias("mean_distance"))
    out = out.withColumn("pseudo_density", F.col("n_neighbors") / F.greatest("mean_distance", F.lit(1e-12)))
    for label in labels:
        c = m.where(F.col(label).isNotNull()).groupBy("group", "anchor", label).agg(F.count("*").alias("n"))
        s = c.groupBy("group", "anchor").agg(F.sum("n").alias("t"), F.count("*").alias("richness"), F.max("n").alias("m"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("nln"))
        out = out.join(s.select("group", "anchor", F.col("richness").alias(f"{label}_richness"), F.when(F.col("richness") > 1, F.ln(F.col("t").cast("double")) - F.col("nln") / F.col("t")).otherwise(0.0).alias(f"{label}_entropy"), (F.col("m") / F.col("t")).alias(f"{label}_top_share")), ["group", "anchor"], "left")
    if vector:
        # One row of running sums per anchor, folded within tasks first; elements are never rows.
        size = points.select(F.max(F.size(vector)).alias("n")).first()["n"] or 0
        x = lambda i: F.col(vector)[i].cast("double")
        v = m.groupBy("group", "anchor").agg(F.array(*[F.avg(x(i)) for i in range(size)]).alias("mean_vector"), F.array(*[F.var_pop(x(i)) for i in range(size)]).alias("var_vector"))
        out = out.join(v, ["group", "anchor"], "left")
    return out


def composition_columns(points: DataFrame, members: DataFrame, label: str, vocabulary: Sequence[str], prefix: str) -> DataFrame:
    """One row per anchor and one column ``prefix__token`` per vocabulary entry: its share of labelled members, 0 if absent."""
    import re as _re

    name = lambda v: f"{prefix}__" + (_re.sub("[^0-9A-Za-z]+", "_", v).strip("_").lower() or "na")
    m = members.join(points.select("group", F.col("id").alias("member"), label), ["group", "member"])
    tokens: dict[str, list[str]] = {}
    for v in vocabulary:
        tokens.setdefault(name(v), []).append(v)
    total = F.count(label)
    return m.groupBy("group", "anchor").agg(*[F.coalesce(F.count_if(F.col(label).isin(*vs)) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(n) for n, vs in sorted(tokens.items())])


def mean_neighbour_degree(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, id, degree, neighbour_degree): own degree and the mean degree of the neighbours, 0 without any."""
    d = degrees(points, edges)
    m = edges.join(d.select("group", F.col("id").alias("dst"), F.col("degree").alias("nd")), ["group", "dst"]).groupBy("group", F.col("src").alias("id")).agg(F.avg("nd").alias("neighbour_degree"))
    return d.join(m, ["group", "id"], "left").withColumn("neighbour_degree", F.coalesce("neighbour_degree", F.lit(0.0)))
