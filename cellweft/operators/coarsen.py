"""Coarse states: clusters of anchors, their sizes and summaries, macrostates of the coarse chain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.quantiles import with_quantiles


def cluster_count(n: Column, mean: Column, low: int = 50, high: int = 150, at_mean: int = 100) -> Column:
    """round(100 * sqrt(n / mean)) within bounds, half to even."""
    return F.greatest(F.least(F.bround(at_mean * F.sqrt(n / mean)).cast("int"), F.lit(high)), F.lit(low))


def preflight_count(n: Column, step: int = 64, low: int = 512, high: int = 2048, scale: float = 1.0) -> Column:
    """round(sqrt(n) * scale / step) * step within bounds."""
    return F.greatest(F.least((F.bround(F.sqrt(n) * scale / step) * step).cast("int"), F.lit(high)), F.lit(low))


def seeded_centroids(points: DataFrame, key: str, vec: str, k: int, seed: int = 1) -> DataFrame:
    """(state, centroid): the ``k`` first points by md5(seed|key) (C3, C11). One bounded top-k, reproducible on any engine."""
    p = points.where(F.col(vec).isNotNull()).select(vec, key, F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).alias("h")).orderBy("h", key).limit(k)
    return p.withColumn("state", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", key)) - 1).select("state", F.col(vec).alias("centroid"))  # k rows


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, vec: str, *keep: str) -> DataFrame:
    """(key, kept columns, state, distance): nearest centroid, ties to the smaller state (C3, C21). ``centroids`` number k, a parameter of the run."""
    c = centroids.agg(F.sort_array(F.collect_list(F.struct("state", "centroid"))).alias("_c"))  # k entries
    d = F.transform("_c", lambda c: F.struct(F.sqrt(F.aggregate(F.zip_with(c["centroid"], F.col(vec), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("distance"), c["state"].alias("state")))
    best = points.where(F.col(vec).isNotNull()).crossJoin(F.broadcast(c)).select(key, *keep, F.array_min(d).alias("b"))  # one row of k centroids
    return best.select(key, *keep, F.col("b.state").alias("state"), F.col("b.distance").alias("distance"))


def kmeans(points: DataFrame, key: str, vec: str, k: int, rounds: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(assignment, centroids) by Lloyd's rounds from :func:`seeded_centroids`.

    Each round is a projection and one aggregate of k rows, which come to the driver; a state without points keeps its centroid.
    """
    spark = points.sparkSession
    dim_schema = "state int, centroid array<double>"
    now = [(r["state"], list(map(float, r["centroid"]))) for r in seeded_centroids(points, key, vec, k, seed).collect()]
    for _ in range(rounds):
        c = spark.createDataFrame(now, dim_schema)
        a = nearest_centroid(points, c, key, vec, vec)
        dim = len(now[0][1]) if now else 0
        means = a.groupBy("state").agg(F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)]).alias("centroid")).collect()
        new = {r["state"]: list(r["centroid"]) for r in means}
        moved = [(s, new.get(s, c)) for s, c in now]
        if all(np.allclose(a[1], b[1], atol=1e-9) for a, b in zip(moved, now)):
            break
        now = moved
    c = spark.createDataFrame(now, dim_schema)
    return nearest_centroid(points, c, key, vec), c


def layered_states(points: DataFrame, layer: str, key: str, vec: str, k: int, seed: int = 1) -> DataFrame:
    """(layer, key, state, distance): each layer's points by ``k`` seeded centroids of that layer, ids shifted by k per layer before (C11).

    Layers (time points) are few; their k centroids each are found by a rank limited within tasks and joined as one row a layer.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    ok = points.where(F.col(vec).isNotNull() & F.col(layer).isNotNull())
    r = ok.select(layer, key, vec, h.alias("_h")).withColumn("_r", F.row_number().over(Window.partitionBy(layer).orderBy("_h", key))).where(F.col("_r") <= k)
    c = r.groupBy(layer).agg(F.sort_array(F.collect_list(F.struct((F.col("_r") - 1).alias("state"), F.col(vec).alias("centroid")))).alias("_c"))
    c = c.withColumn("_shift", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(layer)) - 1) * k)  # a row a layer
    d = F.transform("_c", lambda c: F.struct(F.sqrt(F.aggregate(F.zip_with(c["centroid"], F.col(vec), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("distance"), c["state"].alias("state")))
    b = ok.join(F.broadcast(c), layer).select(layer, key, "_shift", F.array_min(d).alias("b"))
    return b.select(layer, key, (F.col("b.state") + F.col("_shift")).alias("state"), F.col("b.distance").alias("distance"))


def chosen_count(candidates: DataFrame, default: int, least_share: float = 0.001) -> DataFrame:
    """Candidates (k, n_states, min_share) with ``passes`` and ``selected``: no empty state and no share under ``least_share``; the default if it
    passes, else the passing k nearest to it, ties to the smaller (P2, C15)."""
    ok = (F.col("n_states") == F.col("k")) & (F.col("min_share") >= least_share)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("passes"), F.abs(F.col("k") - default), "k")  # a row a candidate
    return candidates.withColumn("passes", ok).withColumn("selected", (F.row_number().over(w) == 1) & F.col("passes"))


def state_summary(df: DataFrame, state: str, labels: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per state: size, share, centroid, population variance of position, and per label its dominant value and purity."""
    total = df.agg(F.count("*").alias("_t"))
    g = df.groupBy(state).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.var_pop(x) + F.var_pop(y)).alias("spread")).crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row
    for label in labels:
        c = df.where(F.col(label).isNotNull()).groupBy(state, label).agg(F.count("*").alias("c"))
        d = c.groupBy(state).agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias(f"dominant_{label}"), (F.max("c") / F.sum("c")).alias(f"purity_{label}"))
        g = g.join(d, state, "left")
    return g


def state_qc(summary: DataFrame, tiny: int = 10) -> DataFrame:
    """(metric, value, status): number of states, median size, share of tiny states, smallest and largest share."""
    a = summary.agg(F.count("*").cast("double").alias("n_states"), F.median("n").alias("median_size"), F.avg((F.col("n") < tiny).cast("double")).alias("tiny_share"), F.max("share").alias("largest_share"))
    def row(name: str, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"), F.when(ok, "PASS").otherwise("WARN").alias("status"))

    m = F.array(row("n_states", F.col("n_states") > 0), row("median_size", F.col("median_size") >= tiny), row("tiny_share", F.col("tiny_share") <= 0.1), row("largest_share", F.col("largest_share") <= 0.15))
    return a.select(F.explode(m).alias("m")).select("m.*")


def size_grid(assigned: DataFrame, group: str, state: str, k: int) -> DataFrame:
    """(group, state, n, share, ratio): sizes with empty states in, share of the group, ratio to the group's median."""
    g = assigned.select(group).distinct().withColumn(state, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    n = g.join(assigned.groupBy(group, F.col(state).cast("int").alias(state)).agg(F.count("*").alias("n")), [group, state], "left").na.fill(0, ["n"])
    mid = n.groupBy(group).agg(F.median("n").alias("_m"), F.sum("n").alias("_t"))
    return n.join(mid, group).select(group, state, "n", (F.col("n") / F.col("_t")).alias("share"), F.coalesce(F.col("n") / F.nullif(F.col("_m"), F.lit(0.0)), F.lit(0.0)).alias("ratio"))


def compactness(df: DataFrame, state: str, x: str = "x", y: str = "y") -> DataFrame:
    """(state, n, median_r, p90_r, diffuse): distance to the centroid; diffuse above max(2 * median p90, p90 of p90)."""
    c = df.groupBy(state).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    r = df.join(c, state).withColumn("_r", F.sqrt((F.col(x) - F.col("_x")) ** 2 + (F.col(y) - F.col("_y")) ** 2))
    s = with_quantiles(r.groupBy(state).agg(F.count("*").alias("n")), r, [state], "_r", median_r=0.5, p90_r=0.9)
    lim = s.agg(F.greatest(2 * F.median("p90_r"), F.percentile("p90_r", F.lit(0.9))).alias("_l"))
    return s.crossJoin(F.broadcast(lim)).withColumn("diffuse", F.col("p90_r") > F.col("_l")).drop("_l")  # one row


def moved_across_scales(df: DataFrame, key: str, scale: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, scales, dx, dy, consistent): whether coordinates agree over scales."""
    return df.groupBy(key).agg(F.countDistinct(scale).alias("scales"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy")).withColumn("consistent", (F.col("dx") <= tolerance) & (F.col("dy") <= tolerance))


def representative_groups(df: DataFrame, time: str, group: str) -> DataFrame:
    """(time, group, n): per time the group whose size is nearest to the median, ties by name."""
    n = df.groupBy(time, group).agg(F.count("*").alias("n"))
    mid = n.groupBy(time).agg(F.median("n").alias("_m"))
    w = Window.partitionBy(time).orderBy(F.abs(F.col("n") - F.col("_m")), group)
    return n.join(mid, time).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(time, group, "n")


def terminal_score(states: DataFrame) -> DataFrame:
    """Adds ``score``: .40 final share + .25 min(enrichment / 5, 1) + .20 size-weighted diagonal + .15 (1 - entropy); and a label."""
    s = 0.40 * F.col("final_share") + 0.25 * F.least(F.col("enrichment") / 5, F.lit(1.0)) + 0.20 * F.col("diagonal") + 0.15 * (1 - F.col("entropy"))
    return states.withColumn("score", s).withColumn("label", F.when(F.col("score") >= 0.65, "terminal_like").when(F.col("score") >= 0.4, "late").otherwise("transient"))


# --- the coarse chain, small enough for one process -------------------------------------------------------------------

def coarse_matrix(edges: DataFrame, limit: int = 2000) -> tuple[list[str], np.ndarray]:
    """State names and the dense matrix of a coarse chain; refuses more than ``limit`` states."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("s")).distinct().orderBy("s").limit(limit + 1).toPandas()["s"].tolist()
    if len(n) > limit:
        raise ValueError(f"a coarse chain may have at most {limit} states")
    at = {s: i for i, s in enumerate(n)}
    m = np.zeros((len(n), len(n)))
    # Summed on the executors first, so at most limit * limit entries come, as one Arrow table.
    e = edges.groupBy("src", "dst").agg(F.sum("p").alias("p")).toArrow()
    rows, cols = ([at[x] for x in e.column(c).to_pylist()] for c in ("src", "dst"))
    np.add.at(m, (rows, cols), e.column("p").to_numpy())
    return n, m


def stationary(p: np.ndarray) -> np.ndarray:
    """Stationary weights of a row-stochastic matrix; of a reducible one, from the uniform start (lazy power iteration)."""
    w = np.full(len(p), 1 / max(1, len(p)))
    for _ in range(5000):
        new = 0.5 * w + 0.5 * (w @ p)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w / w.sum()


def macrostates(p: np.ndarray, k: int) -> dict[str, np.ndarray | float]:
    """Memberships of the states in ``k`` macrostates (C15): the inner-simplex start of the published GPCCA method.

    The invariant subspace is spanned by the leading eigenvectors (real and imaginary parts), made orthonormal under the stationary weights
    with the constant vector first; vertices of the simplex are found by successive projection. Memberships are clipped at 0
    and normalised. Returns memberships, the coarse matrix and its metastability trace / k.
    """
    n = len(p)
    k = max(1, min(k, n))
    w = np.maximum(stationary(p), 1e-12)
    val, vec = np.linalg.eig(p)
    cols: list[np.ndarray] = [np.ones(n)]
    for i in np.argsort(-np.abs(val)):
        for part in (vec[:, i].real, vec[:, i].imag):
            x = part.copy()
            for c in cols:
                x -= c * (w * c * x).sum() / (w * c * c).sum()
            size = np.sqrt((w * x * x).sum())
            if size > 1e-8 and len(cols) < k:
                cols.append(x / size)
    x = np.stack(cols, axis=1)
    rows: list[int] = [int(np.argmax(np.linalg.norm(x, axis=1)))]
    y = x - x[rows[0]]
    while len(rows) < x.shape[1]:
        far = int(np.argmax(np.linalg.norm(y, axis=1)))
        d = y[far] / max(np.linalg.norm(y[far]), 1e-300)
        rows.append(far)
        y = y - np.outer(y @ d, d)
    chi = np.clip(x @ np.linalg.pinv(x[rows]), 0, None)
    chi = chi / np.maximum(chi.sum(axis=1, keepdims=True), 1e-300)
    mass = chi.T @ (w[:, None] * chi)
    pc = np.linalg.pinv(mass) @ (chi.T @ (w[:, None] * (p @ chi)))
    return {"memberships": chi, "coarse": pc, "metastability": float(np.trace(pc) / chi.shape[1])}


def projected(nodes: DataFrame, memberships: pd.DataFrame) -> DataFrame:
    """Nodes (id, state) with their state's memberships, top macrostate and entropy over ln k (C17). ``memberships``: state, m (list)."""
    spark = nodes.sparkSession
    k = len(memberships["m"].iloc[0]) if len(memberships) else 1
    m = spark.createDataFrame([(str(s), [float(x) for x in v]) for s, v in zip(memberships["state"], memberships["m"])], "state string, m array<double>")
    j = nodes.join(F.broadcast(m), "state")  # a row a coarse state, at most 2000
    h = F.aggregate("m", F.lit(0.0), lambda s, x: s + F.when(x > 0, -x * F.ln(x)).otherwise(0.0))
    top = F.array_position("m", F.array_max("m")) - 1
    return j.select("id", "state", "m", top.cast("int").alias("macrostate"), F.array_max("m").alias("top"), (h / F.ln(F.lit(float(k)))).alias("entropy") if k > 1 else F.lit(0.0).alias("entropy"))


def spectral_groups(p: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Diagnostic clustering of states by the leading eigenvectors of P' (C16)."""
    val, vec = np.linalg.eig(p.T)
    x = vec[:, np.argsort(-val.real)[:k]].real
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    lab = np.zeros(len(x), dtype=int)
    for _ in range(50):
        lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(len(c))])
    return lab
