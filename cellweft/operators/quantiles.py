"""Exact quantiles whose states stay small, whatever share of all rows a key has.

A sketch first brackets each quantile; then values are counted per key and value (so ties are one row), and only those inside a bracket
are brought together. A bracket holds about 4 / ACCURACY of a key's distinct values, the rest are summed as compact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalars import finite
from cellweft.session import cut

#: Rank error of the sketch is at most one part in this many; a bracket reaches twice that to both sides.
ACCURACY = 10_000


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; without keys ``b`` is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    renamed = b
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_k_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, **at: float) -> DataFrame:
    """(keys, a column for each of ``at``): quantiles of the finite numbers of ``value`` with linear interpolation.

    Keys without a finite number give no row (without keys: one row of nulls). Null keys are a key.
    """
    d = df.select(*keys, finite(value).alias("_v")).where("_v IS NOT NULL")
    ps = list(at.values())
    probes = [float(x) for p in ps for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    a = d.groupBy(*keys).agg(F.percentile_approx("_v", probes, ACCURACY).alias("_b"), F.count("*").alias("_n"))
    c = d.groupBy(*keys, "_v").agg(F.count("*").alias("_w"))
    j = joined(c, a, keys, "inner")
    aggs = [F.max("_n").alias("_n")]
    v, w = F.col("_v"), F.col("_w")
    for i in range(len(ps)):
        lo, hi = F.col("_b")[2 * i], F.col("_b")[2 * i + 1]
        aggs += [F.coalesce(F.sum(F.when(v < lo, w)), F.lit(0)).alias(f"_under{i}"), F.max(F.when(v < lo, v)).alias(f"_before{i}"), F.min(F.when(v > hi, v)).alias(f"_after{i}"),
                 F.array_sort(F.collect_list(F.when((v >= lo) & (v <= hi), F.struct("_v", "_w")))).alias(f"_in{i}")]
    r = j.groupBy(*keys).agg(*aggs)

    def ranked(i: int, rank: Column) -> Column:
        """The value at a 0-based rank: inside the bracket, or the nearest one beside it."""
        start = F.struct(F.col(f"_under{i}").cast("long").alias("c"), F.lit(None).cast("double").alias("x"))
        got = F.aggregate(f"_in{i}", start, lambda s, e: F.struct((s["c"] + e["_w"]).alias("c"), F.when(s["x"].isNull() & (s["c"] + e["_w"] > rank), e["_v"]).otherwise(s["x"]).alias("x")))
        return F.when(rank < F.col(f"_under{i}"), F.col(f"_before{i}")).otherwise(F.coalesce(got["x"], F.col(f"_after{i}")))

    out = []
    for i, (name, p) in enumerate(at.items()):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        k = F.floor(pos)
        low = ranked(i, k)
        high = F.when(pos > k, ranked(i, k + 1)).otherwise(low)
        out.append((low + (high - low) * (pos - k)).alias(name))
    return r.select(*keys, *out)


def with_quantiles(aggregated: DataFrame, df: DataFrame, keys: Sequence[str], value: Column | str, **at: float) -> DataFrame:
    """``aggregated`` (a row a key) with :func:`quantiles` of ``df`` beside it; null where a key has none."""
    return joined(aggregated, quantiles(df, keys, value, **at), keys)


def group_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "_r", size: str = "_n") -> DataFrame:
    """Adds the 0-based ``rank`` of each row within its key by ``order`` (ending in a unique column) and the key's ``size``.

    Rows are range-partitioned by key and order, numbered within a partition, and shifted by what earlier partitions hold of the key, so a key
    with a third of all rows is numbered by many tasks.
    """
    part = cut(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    n = part.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)  # a row a partition that has the key
    start = n.withColumn("_start", F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn(size, F.sum("_c").over(w)).drop("_c")
    rn = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) - 1
    out = joined(part.withColumn(rank, rn), start, [*keys, "_p"], "inner")
    return out.withColumn(rank, F.col(rank) + F.col("_start")).drop("_p", "_start")


def column_quantiles(df: DataFrame, columns: Sequence[str], **at: float) -> DataFrame:
    """One row with ``_{name}_{column}`` for each column: all columns' values go through one pass as (column, value) rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    q = quantiles(long, ["c"], "v", **at)
    return q.agg(*[F.max(F.when(F.col("c") == c, F.col(n))).alias(f"_{n}_{c}") for c in columns for n in at])
