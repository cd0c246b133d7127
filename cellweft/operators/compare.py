"""Comparison of candidate sets, kernels and gradings of the same sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.quantiles import with_quantiles


def candidate_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, recall, jaccard, top1_same, rank_correlation): how far ``b`` finds the candidates of ``a`` (B1). Inputs: src, dst, rank."""
    na = a.groupBy("src").agg(F.count("*").alias("na"), F.min_by("dst", "rank").alias("ta"))
    nb = b.groupBy("src").agg(F.count("*").alias("nb"), F.min_by("dst", "rank").alias("tb"))
    both = a.select("src", "dst", F.col("rank").alias("ra")).join(b.select("src", "dst", F.col("rank").alias("rb")), ["src", "dst"])
    m = both.groupBy("src").agg(F.count("*").alias("m"), F.corr("ra", "rb").alias("c"))
    j = na.join(nb, "src").join(m, "src", "left").na.fill(0, ["m"])
    return j.select("src", (F.col("m") / F.col("na")).alias("recall"), (F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("jaccard"), (F.col("ta") == F.col("tb")).alias("top1_same"), F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)).alias("rank_correlation"))


def drift(a: DataFrame, b: DataFrame, p: str = "p") -> DataFrame:
    """(src, dst, pa, pb, drift): full outer join of two edge tables, a missing edge counting 0 (B2)."""
    j = a.select("src", "dst", F.col(p).alias("pa")).join(b.select("src", "dst", F.col(p).alias("pb")), ["src", "dst"], "full")
    j = j.select("src", "dst", F.coalesce("pa", F.lit(0.0)).alias("pa"), F.coalesce("pb", F.lit(0.0)).alias("pb"))
    return j.withColumn("drift", F.abs(F.col("pb") - F.col("pa")))


def drift_summary(d: DataFrame) -> DataFrame:
    """One row: edges, only in a, only in b, mean, median and p95 of the drift (B2)."""
    a = d.agg(F.count("*").alias("n"), F.count_if((F.col("pa") > 0) & (F.col("pb") == 0)).alias("only_a"), F.count_if((F.col("pa") == 0) & (F.col("pb") > 0)).alias("only_b"), F.avg("drift").alias("mean"))
    return with_quantiles(a, d, [], "drift", median=0.5, p95=0.95)


def plausibility(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """One row: sources, share whose best target has their own label, mean share of mass on their own label."""
    w = Window.partitionBy("src").orderBy(F.desc("p"), "dst")
    e = edges.withColumn("r", F.row_number().over(w))
    l = e.join(labels.select(F.col("id").alias("src"), F.col(label).alias("_a")), "src").join(labels.select(F.col("id").alias("dst"), F.col(label).alias("_b")), "dst").where("_a IS NOT NULL AND _b IS NOT NULL")
    s = l.groupBy("src").agg(F.max(F.when(F.col("r") == 1, (F.col("_a") == F.col("_b")).cast("double"))).alias("top"), (F.sum(F.when(F.col("_a") == F.col("_b"), F.col("p")).otherwise(0.0)) / F.sum("p")).alias("own"))
    return s.agg(F.count("*").alias("n"), F.avg("top").alias("top_agreement"), F.avg("own").alias("own_mass"))


def with_overall(df: DataFrame, key: str, measures: dict[str, Column], overall: str = "global") -> DataFrame:
    """Aggregates per key and over all rows (key = ``overall``) in one pass: each row counts in both groups."""
    both = df.withColumn(key, F.explode(F.array(F.col(key).cast("string"), F.lit(overall))))
    return both.groupBy(key).agg(*[c.alias(n) for n, c in measures.items()])


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value * weight over the sum of weights of rows that have a value."""
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def flags(df: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """A boolean per limit (column: (">=" or "<=", value)) and ``all_pass``."""
    out, every = df, F.lit(True)
    for c, (op, v) in limits.items():
        ok = F.coalesce(F.col(c) >= v if op == ">=" else F.col(c) <= v, F.lit(False))
        out, every = out.withColumn(f"{c}_ok", ok), every & ok
    return out.withColumn("all_pass", every)


def mass_shift(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per stratum (``keys`` but the last): largest absolute change of the mean of ``value`` over the last key."""
    x = a.groupBy(*keys).agg(F.avg(value).alias("va"))
    y = b.groupBy(*keys).agg(F.avg(value).alias("vb"))
    j = x.join(y, list(keys), "full")
    d = F.abs(F.coalesce("vb", F.lit(0.0)) - F.coalesce("va", F.lit(0.0)))
    return j.groupBy(*keys[:-1]).agg(F.max(d).alias("shift"), F.max_by(keys[-1], F.struct(d, F.col(keys[-1]))).alias("where"))
