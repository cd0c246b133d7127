"""Pivots over scales and the scalers of feature columns. Statistics are one aggregate row; scaling is a projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.scalars import finite
from cellweft.operators.quantiles import column_quantiles


def pivot_scales(df: DataFrame, keys: Sequence[str], scale: str, scales: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long (key, scale) to one row per key with columns ``scale__feature``, scale by scale (R2). A missing scale gives nulls.

    Conditional aggregation with a fixed column list: one shuffle on the key, no pass to find the values.
    """
    cols = [F.max(F.when(F.col(scale) == s, F.col(f))).alias(f"{s}__{f}") for s in scales for f in features]
    return df.where(F.col(scale).isin(*scales)).groupBy(*keys).agg(*cols)


def imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite and missing values become the column's median, or 0 if it has none (F16)."""
    mid = column_quantiles(df, columns, m=0.5)
    j = df.crossJoin(F.broadcast(mid))  # one row
    return j.select(*[F.coalesce(finite(c), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _scaled(df: DataFrame, columns: Sequence[str], over: DataFrame, stats: dict[str, object], expr: object) -> DataFrame:
    """``stats`` are aggregates, or numbers for quantiles."""
    at = {s: p for s, p in stats.items() if isinstance(p, float)}
    row = over.agg(*[f(finite(c)).alias(f"_{s}_{c}") for c in columns for s, f in stats.items() if s not in at], F.lit(1).alias("_one"))  # type: ignore[operator]
    if at:
        row = row.crossJoin(F.broadcast(column_quantiles(over, columns, **at)))  # one row each
    j = df.crossJoin(F.broadcast(row))  # one row
    return j.select(*[expr(finite(c), {s: F.col(f"_{s}_{c}") for s in stats}).alias(c) if c in columns else F.col(c) for c in df.columns])  # type: ignore[operator]


def robust(df: DataFrame, columns: Sequence[str], over: DataFrame | None = None, policy: str = "chain") -> DataFrame:
    """Columns centred on the median and divided by the interquartile range, with one of three rules for flat columns.

    ``chain``: IQR, else population deviation, else 1. ``unit``: IQR below 1e-8 counts as 1 and missing values become the median.
    ``drop``: IQR below 1e-6 makes the column 0. ``over``: rows that statistics are taken from (a union of both sides, say).
    """
    stats = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "sd": F.stddev_pop}

    def one(c: Column, s: dict[str, Column]) -> Column:
        iqr = s["q3"] - s["q1"]
        if policy == "chain":
            return (c - s["q2"]) / F.when(iqr > 0, iqr).when(s["sd"] > 0, s["sd"]).otherwise(1.0)
        if policy == "unit":
            return (F.coalesce(c, s["q2"]) - s["q2"]) / F.when(iqr < 1e-8, 1.0).otherwise(iqr)
        if policy == "drop":
            return F.when(iqr < 1e-6, 0.0).otherwise((c - s["q2"]) / iqr)
        raise ValueError(policy)

    return _scaled(df, columns, over if over is not None else df, stats, one)


def standard(df: DataFrame, columns: Sequence[str], over: DataFrame | None = None, floor: float = 1e-6) -> DataFrame:
    """z-scores by population deviation; a column that varies less than ``floor`` becomes 0."""
    stats = {"mu": F.avg, "sd": F.stddev_pop}
    return _scaled(df, columns, over if over is not None else df, stats, lambda c, s: F.when(s["sd"] < floor, 0.0).otherwise((c - s["mu"]) / s["sd"]))


def fallback(df: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """(x-median)/IQR, else (x-mean)/deviation, else (x-min)/range, else 0, whichever first is wider than ``floor`` (T4)."""
    stats = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "mu": F.avg, "sd": F.stddev_pop, "lo": F.min, "hi": F.max}

    def one(c: Column, s: dict[str, Column]) -> Column:
        iqr, span = s["q3"] - s["q1"], s["hi"] - s["lo"]
        return F.when(iqr > floor, (c - s["q2"]) / iqr).when(s["sd"] > floor, (c - s["mu"]) / s["sd"]).when(span > floor, (c - s["lo"]) / span).otherwise(0.0)

    return _scaled(df, columns, df, stats, one)


def balanced_blocks(df: DataFrame, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """z-scores of all blocks' columns, each divided by the root of its block's width, so that blocks weigh alike."""
    cols = [c for b in blocks.values() for c in b]
    width = {c: len(b) for b in blocks.values() for c in b}
    return standard(df, cols).select(*[(F.col(c) / float(np.sqrt(width[c]))).alias(c) if c in width else F.col(c) for c in df.columns])


def moments(df: DataFrame, vector: str, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sums, matrix of products) of an array column: one small matrix per task is summed, no row leaves its task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        flat = np.concatenate([[n], s, c.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    ok = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: finite(x).isNotNull())).select(vector)
    got = ok.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    if not len(got):
        return 0.0, np.zeros(dim), np.zeros((dim, dim))
    return got[0], got[1:dim + 1], got[dim + 1:].reshape(dim, dim)


def principal_components(df: DataFrame, vector: str, dim: int, k: int, out: str = "pcs", centre: bool = True, scale: bool = False) -> DataFrame:
    """Adds ``out``: the first ``k`` principal components of an array column (G19, R4 and C2 with ``scale``; SVD without ``centre``, G20).

    Signs are fixed by making the largest loading of each axis positive. Rows with unusable vectors get null.
    """
    n, s, c = moments(df, vector, dim)
    mu = s / n if centre and n else np.zeros(dim)
    cov = (c / n if n else c) - np.outer(mu, mu)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None)) if scale else np.ones(dim)
    sd = np.where(sd > 1e-12, sd, 1.0)
    _, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    a = axes[:, ::-1][:, :k]
    a = a * np.sign(a[np.abs(a).argmax(axis=0), np.arange(a.shape[1])])
    load = (a / sd[:, None]).T
    v = F.col(vector)
    pcs = F.array(*[F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda x, w: x.cast("double") * w), F.lit(-float(mu @ row)), lambda t, x: t + x) for row in load])
    return df.withColumn(out, F.when(v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: finite(x).isNotNull()), pcs))


def log_cpm(counts: DataFrame, cell: str, gene: str, count: str, target: float = 1e4) -> DataFrame:
    """Long counts with ``value`` = ln(1 + target * share of the cell)."""
    total = counts.groupBy(cell).agg(F.sum(count).alias("_t"))
    return counts.join(total, cell).withColumn("value", F.coalesce(F.log1p(F.lit(target) * F.col(count) / F.nullif(F.col("_t"), F.lit(0))), F.lit(0.0))).drop("_t")


def variable_genes(values: DataFrame, cells: DataFrame, cell: str, gene: str, value: str, n: int) -> DataFrame:
    """The ``n`` genes of largest variance over all cells, cells without an entry counting 0."""
    total = cells.agg(F.countDistinct(cell).alias("_n"))
    s = values.groupBy(gene).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")).crossJoin(F.broadcast(total))
    var = F.col("_q") / F.col("_n") - (F.col("_s") / F.col("_n")) ** 2
    return s.select(gene, var.alias("variance")).orderBy(F.desc("variance"), gene).limit(n)
