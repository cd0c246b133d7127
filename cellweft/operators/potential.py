"""Potentials over units: combined z-scores, residuals on depth, guarded correlation, shares within and between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.markov import dense_index


def combined_z(df: DataFrame, terms: dict[str, float], out: str = "phi") -> DataFrame:
    """Adds ``out``, the weighted sum of z-scores (population deviation; constant columns count 0), and its dense rank, best first."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in terms], *[F.stddev_pop(c).alias(f"_s_{c}") for c in terms])
    z = sum((F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) * w for c, w in terms.items()), F.lit(0.0))
    scored = df.crossJoin(F.broadcast(stats)).withColumn(out, z).select(*df.columns, out)  # one row
    # A dense rank is the index of the distinct value, which range partitions number without one task seeing all.
    v = scored.select(F.round(out, 9).alias("_v")).distinct().withColumn("_less", -F.col("_v"))
    v = dense_index(v, ["_less"], "rank").select("_v", (F.col("rank") + 1).alias("rank"))
    return scored.join(v, F.round(scored[out], 9) == F.col("_v")).drop("_v")


def residual(df: DataFrame, y: str, x: str, out: str = "residual") -> DataFrame:
    """Adds the z-score of y less its least-squares line on x; of y itself for fewer than 3 rows or constant x."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.count("*").alias("_n"))
    r = df.crossJoin(F.broadcast(s)).withColumn("_r", F.when((F.col("_n") < 3) | F.col("_b").isNull(), F.col(y)).otherwise(F.col(y) - F.col("_b") * F.col(x) - F.col("_a")))
    z = r.agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    return r.crossJoin(F.broadcast(z)).withColumn(out, F.coalesce((F.col("_r") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))).select(*df.columns, out)  # one row


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; 0 for fewer than three pairs or a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(F.count_if(both) >= 3, F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def same_label_mass(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """One row: share of edge mass between nodes of one label (N4). ``labels``: id, label."""
    a, b = labels.select(F.col("id").alias("src"), F.col(label).alias("_a")), labels.select(F.col("id").alias("dst"), F.col(label).alias("_b"))
    j = edges.join(a, "src").join(b, "dst")
    return j.agg(F.sum("p").alias("mass"), (F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("p"))), F.lit(0.0)) / F.sum("p")).alias("same_share"))


def between_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: share of the variance of ``value`` that lies between groups (eta squared)."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("S"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("B"), F.sum("q").alias("Q"))
    mu = F.col("S") / F.col("N")
    return t.select(F.col("N").alias("n"), F.coalesce((F.col("B") / F.col("N") - mu * mu) / F.nullif(F.col("Q") / F.col("N") - mu * mu, F.lit(0.0)), F.lit(0.0)).alias("eta2"))


def aggregated_states(units: DataFrame, state: str, sums: Sequence[str]) -> DataFrame:
    """Per state: units and sums of their summaries."""
    return units.groupBy(state).agg(F.count("*").alias("n_units"), *[F.sum(c).alias(c) for c in sums])


def parameter_grid(df: DataFrame, **values: Sequence[float]) -> DataFrame:
    """``df`` once for each combination of parameter values (N6). The grid is a literal array, not a join."""
    for k, vs in values.items():
        df = df.withColumn(k, F.explode(F.array(*[F.lit(float(v)) for v in vs])))
    return df


def enriched_state(df: DataFrame, group: str, state: str, target: str) -> DataFrame:
    """(group, state, share, purity): per group the state holding most of the ``target`` rows, ties by purity, then state."""
    c = df.groupBy(group, state).agg(F.count("*").alias("n"), F.count_if(F.col(target)).alias("t"))
    c = c.withColumn("share", F.coalesce(F.col("t") / F.nullif(F.sum("t").over(Window.partitionBy(group)), F.lit(0)), F.lit(0.0))).withColumn("purity", F.col("t") / F.col("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("share"), F.desc("purity"), state))).where("r = 1").select(group, state, "share", "purity")
