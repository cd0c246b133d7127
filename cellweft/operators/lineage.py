"""Barcode evidence per cell and per overlapping group of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Assays in their order of precedence for dominant features, and the order of loci in a joint id.
ASSAYS = ("RA", "TA", "CA")
LOCI = ("CA", "RA", "TA")


def _assay_rank(c: str = "assay") -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in ASSAYS]), F.col(c))


def summary(evidence: DataFrame, keys: Sequence[str], assays: Sequence[str] = ASSAYS) -> DataFrame:
    """Per key: total count, distinct features and assays, totals per assay, dominant feature and its assay, entropy, Simpson, assay balance (L2-L4).

    ``evidence``: keys, assay, feature_id, n (> 0), any number of rows per feature. The dominant feature has the largest summed count,
    ties by assay precedence, then feature. Two aggregations on nested keys; no list is built.
    """
    f = evidence.groupBy(*keys, "assay", "feature_id").agg(F.sum("n").alias("n"))
    first = F.struct((-F.col("n")).alias("a"), F.coalesce(F.nullif(_assay_rank(), F.lit(0)), F.lit(99)).alias("b"), F.col("feature_id").alias("c"))
    nln, sq = F.sum(F.col("n") * F.ln(F.col("n").cast("double"))), F.sum(F.col("n").cast("double") * F.col("n"))
    g = f.groupBy(*keys).agg(
        F.sum("n").alias("total_count"), F.count("*").alias("n_features"), F.countDistinct("assay").alias("n_assays"), nln.alias("_nln"), sq.alias("_sq"), F.max("n").alias("dominant_count"),
        F.min_by("feature_id", first).alias("dominant_feature"), F.min_by("assay", first).alias("dominant_assay"),
        *[F.coalesce(F.sum(F.when(F.col("assay") == a, F.col("n"))), F.lit(0)).alias(f"{a}_count") for a in assays],
        *[F.count_if(F.col("assay") == a).alias(f"{a}_features") for a in assays])
    t = F.col("total_count").cast("double")
    h = F.when(F.col("n_features") > 1, F.ln(t) - F.col("_nln") / t).otherwise(0.0)
    parts = [F.col(f"{a}_count").cast("double") for a in assays]
    pos = F.lit(0)
    hb = F.lit(0.0)
    for x in parts:
        pos = pos + (x > 0).cast("int")
        hb = hb + F.when(x > 0, -(x / t) * F.ln(x / t)).otherwise(0.0)
    return g.select(
        *keys, "total_count", "n_features", "n_assays", *[f"{a}_{k}" for a in assays for k in ("count", "features")], "dominant_feature", "dominant_assay", (F.col("dominant_count") / t).alias("dominant_fraction"),
        h.alias("entropy"), F.when(F.col("n_features") > 1, 1 - F.col("_sq") / (t * t)).otherwise(0.0).alias("simpson"), F.when(pos > 1, hb / F.ln(pos.cast("double"))).otherwise(0.0).alias("assay_balance"))


def cell_summary(cells: DataFrame, evidence: DataFrame, key: str = "cell_key") -> DataFrame:
    """:func:`summary` of every cell, cells without evidence at 0 (L2)."""
    s = summary(evidence, [key])
    numbers = [c for c, k in s.dtypes if k in ("bigint", "int", "double")]
    return cells.select(key).distinct().join(s, key, "left").withColumn("evidence_present", F.col("total_count").isNotNull()).na.fill(0, numbers)


def group_summary(members: DataFrame, evidence: DataFrame, key: str = "cell_key", group: str = "group_id") -> DataFrame:
    """Members, members with evidence and :func:`summary` per overlapping group.

    A cell counts once in each of its groups and totals over groups are not sums over cells. Repeated (cell, group) rows are an error of
    the caller; here they count once. Groups without evidence stay, at 0.
    """
    m = members.select(key, group).distinct()
    n = m.groupBy(group).agg(F.count("*").alias("n_members"))
    e = m.join(evidence.select(key, "assay", "feature_id", "n"), key)
    has = e.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("n_with_evidence"))
    s = summary(e, [group])
    numbers = [c for c, k in s.dtypes if k in ("bigint", "int", "double")]
    out = n.join(has, group, "left").join(s, group, "left").na.fill(0, ["n_with_evidence", *numbers])
    return out.withColumn("fraction_with_evidence", F.col("n_with_evidence") / F.col("n_members"))


def top_features(evidence: DataFrame, group: str, n: int = 10) -> DataFrame:
    """(group, rank, assay, feature_id, n, fraction): the ``n`` largest features of each group."""
    f = evidence.groupBy(group, "assay", "feature_id").agg(F.sum("n").alias("n")).withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "assay", "feature_id"))).where(F.col("rank") <= n)


def assay_grid(groups: DataFrame, evidence: DataFrame, group: str, assays: Sequence[str] = ASSAYS) -> DataFrame:
    """(group, assay, n, n_features) with every assay for every group, 0 where absent (L6). Assays are a fixed short list."""
    e = evidence.groupBy(group, "assay").agg(F.sum("n").alias("n"), F.countDistinct("feature_id").alias("n_features"))
    g = groups.select(group).distinct().withColumn("assay", F.explode(F.array(*[F.lit(a) for a in assays])))
    return g.join(e, [group, "assay"], "left").na.fill(0, ["n", "n_features"])


def unit_counts(members: DataFrame, unit: str, key: str) -> DataFrame:
    """(unit, local, uniq, ratio): memberships with multiplicity and distinct cells."""
    c = members.groupBy(unit).agg(F.count("*").alias("local"), F.countDistinct(key).alias("uniq"))
    return c.withColumn("ratio", F.col("local") / F.col("uniq"))


def coverage(summary_: DataFrame, sample: str, value: str = "n_features") -> DataFrame:
    """Per sample and over all (sample ``ALL``): cells, cells with at least 1 and 3 features, quantiles (L8). One GROUPING SETS pass."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    both = summary_.withColumn(sample, F.explode(F.array(F.col(sample), F.lit("ALL"))))
    r = both.groupBy(sample).agg(F.count("*").alias("n_cells"), F.count_if(F.col(value) >= 1).alias("at_least_1"), F.count_if(F.col(value) >= 3).alias("at_least_3"), q.alias("q"))
    return r.select(sample, "n_cells", "at_least_1", "at_least_3", *[F.col("q")[i].alias(f"q{n}") for i, n in enumerate(("05", "25", "50", "75", "95"))])


def join_validation(cells: DataFrame, evidence: DataFrame, key: str = "cell_key") -> DataFrame:
    """One row: evidence cells, those without a cell, cells with more than one position."""
    e = evidence.select(key).distinct().join(cells.select(key, F.lit(1).alias("_c")).distinct(), key, "left")
    a = e.agg(F.count("*").alias("evidence_cells"), F.count_if(F.col("_c").isNull()).alias("without_cell"))
    # Nulls make a position of their own, so a struct is compared as a whole.
    b = cells.groupBy(key).agg(F.countDistinct(F.struct("x", "y")).alias("n")).agg(F.count_if(F.col("n") > 1).alias("moved_cells"))
    return a.crossJoin(b)  # one row each


def assay_qc(evidence: DataFrame) -> DataFrame:
    """(sample_id, slice_id, assay, rows, total, cells, features)."""
    return evidence.groupBy("sample_id", "slice_id", "assay").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.countDistinct("cell_key").alias("cells"), F.countDistinct("feature_id").alias("features"))


def inflation_audit(evidence: DataFrame, annotation: DataFrame, key: str = "feature_id") -> DataFrame:
    """One row: total count, total after joining a one-to-many annotation as it is, and after collapsing it first."""
    n = annotation.groupBy(key).agg(F.count("*").alias("k"))
    j = evidence.join(n, key, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    return j.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("k")).alias("joined_total"), F.sum("n").alias("collapsed_total"), F.count_if(F.col("k") > 1).alias("rows_multiplied"))


def group_checks(members: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """One row of checks of neighbour groups (group, anchor, member, role, group_id): one centre, size at most k, one slice, known members."""
    g = members.groupBy("group_id").agg(F.count_if(F.col("role") == "center").alias("centres"), F.count("*").alias("n"), F.countDistinct("member").alias("d"), F.countDistinct("group").alias("slices"))
    a = g.agg(F.count("*").alias("n_groups"), F.bool_and(F.col("centres") == 1).alias("one_centre"), F.bool_and(F.col("n") <= k).alias("size_ok"), F.bool_and(F.col("n") == F.col("d")).alias("no_repeats"), F.bool_and(F.col("slices") == 1).alias("one_slice"))
    b = members.join(cells.select(F.col("id").alias("member")).distinct(), "member", "left_anti").agg(F.count("*").alias("unknown_members"))
    return a.crossJoin(b)  # one row each
