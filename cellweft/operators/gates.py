"""Checks that must fail rather than hand on bad rows.

A check is one aggregate over the frame; :func:`require` raises with what it found. :func:`verdicts` gives the same as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.scalars import finite
from cellweft.operators.quantiles import with_quantiles


class CheckFailed(ValueError):
    """A frame does not satisfy what the next stage relies on."""


def require(df: DataFrame, what: str, **violations: Column) -> DataFrame:
    """``df`` itself, if no row satisfies any of ``violations`` (null counts as no). One pass over the columns they name."""
    got = df.agg(*[F.count_if(v).alias(k) for k, v in violations.items()]).first()
    bad = {k: got[k] for k in violations if got[k]}
    if bad:
        raise CheckFailed(f"{what}: " + ", ".join(f"{n} rows with {k}" for k, n in bad.items()))
    return df


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that come more than once (M3, duplicated)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "keys") -> DataFrame:
    """``df`` itself if ``keys`` are unique (validate one_to_one / many_to_one)."""
    first = repeated_keys(df, keys).limit(3).collect()
    if first:
        raise CheckFailed(f"{what}: {list(keys)} repeat, for example {[tuple(r)[:-1] for r in first]}")
    return df


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Equi-join that refuses to multiply rows: the right keys (and the left ones, for ``one_to_one``) must be unique."""
    require_unique(right, keys, "right side")
    if validate == "one_to_one":
        require_unique(left, keys, "left side")
    return left.join(right, list(keys), how)


def join_key_audit(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per candidate key set: unique on either side, rows of a, rows of a found in b, coverage, valid."""
    k = list(keys)
    n = a.agg(F.count("*").alias("n_left"), F.countDistinct(F.struct(*k)).alias("keys_left"))
    m = b.agg(F.count("*").alias("n_right"), F.countDistinct(F.struct(*k)).alias("keys_right"))
    hit = a.join(b.select(*k).distinct(), k, "left_semi").agg(F.count("*").alias("matched"))
    one = n.crossJoin(m).crossJoin(hit)  # single rows
    cover = F.col("matched") / F.nullif(F.col("n_left"), F.lit(0))
    return one.select(F.lit(",".join(k)).alias("key"), "n_left", "n_right", (F.col("n_left") == F.col("keys_left")).alias("unique_left"), (F.col("n_right") == F.col("keys_right")).alias("unique_right"), "matched", cover.alias("coverage"),
                      ((cover >= 0.999) & (F.col("n_right") == F.col("keys_right"))).alias("valid"))


def integrity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, missing, non_finite, mean, std, q25, median, q75): sample deviation and linear quantiles over finite values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    f = finite("v")
    a = long.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v").isNotNull() & f.isNull()).alias("non_finite"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"))
    return with_quantiles(a, long, ["column"], "v", q25=0.25, median=0.5, q75=0.75)


def complete_scales(df: DataFrame, keys: Sequence[str], scale: str, scales: Sequence[str]) -> DataFrame:
    """``df`` if each key has each of ``scales`` once and no other (R1); raises otherwise."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(scale).alias("d"), F.count_if(~F.coalesce(F.col(scale).isin(*scales), F.lit(False))).alias("odd"))
    require(bad, "scales", missing_or_repeated=(F.col("n") != len(scales)) | (F.col("d") != len(scales)), unexpected=F.col("odd") > 0)
    return df


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, status): added, removed or changed rows of two snapshots, by null-safe comparison."""
    a = before.select(key, F.struct(*columns).alias("_a"))
    b = after.select(key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, status.alias("status")).where("status IS NOT NULL")
