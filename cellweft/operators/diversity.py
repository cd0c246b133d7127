"""Composition and diversity of labels per group.

Counts are taken per (group, label) first; everything else is computed from those compact counts, so a group of very many rows is
pre-aggregated within tasks and no list of its rows is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_counts(df: DataFrame, group: Sequence[str], label: str, weight: Column | None = None) -> DataFrame:
    """(group, label, n): rows, or the sum of ``weight``, per label; null labels are left out (value_counts)."""
    return df.where(F.col(label).isNotNull()).groupBy(*group, label).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, count) with null as a value of its own (S3)."""
    return df.groupBy(column).count()


def composition(counts: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Adds ``share`` of the group total."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def diversity(counts: DataFrame, group: Sequence[str], label: str, top: int = 5) -> DataFrame:
    """Per group: total, richness, dominant label and share, entropy, entropy by ln(richness), Simpson, ``k:n;...``.

    ``counts``: group, label, n. Labels with n <= 0 do not count. The dominant label is the one of largest n, ties by label. The
    text lists the ``top`` largest and puts the remainder into ``other:n``.
    """
    c = counts.where("n > 0").withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), label)))
    # sum(-p ln p) = ln(total) - sum(n ln n) / total, in one pass over the counts.
    g = c.groupBy(*group).agg(
        F.sum("n").alias("total"), F.count("*").alias("richness"),
        F.max(F.when(F.col("_r") == 1, F.col(label))).alias("dominant"), F.max("n").alias("_top"),
        F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("_nln"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_sq"),
        # At most ``top`` entries are collected.
        F.sort_array(F.collect_list(F.when(F.col("_r") <= top, F.struct(F.col("_r"), F.concat(F.col(label), F.lit(":"), F.col("n").cast("string")).alias("t"))))).alias("_l"),
        F.sum(F.when(F.col("_r") > top, F.col("n"))).alias("_rest"),
    )
    ent = F.when(F.col("richness") > 1, F.ln(F.col("total").cast("double")) - F.col("_nln") / F.col("total")).otherwise(0.0)
    text = F.concat_ws(";", F.array_join(F.transform("_l", lambda x: x["t"]), ";"), F.concat(F.lit("other:"), F.col("_rest").cast("string")))
    return g.select(
        *group, "total", "richness", "dominant", (F.col("_top") / F.col("total")).alias("dominant_share"), ent.alias("entropy"),
        F.when(F.col("richness") > 1, ent / F.ln(F.col("richness").cast("double"))).otherwise(0.0).alias("norm_entropy"),
        F.when(F.col("richness") > 1, 1 - F.col("_sq") / (F.col("total").cast("double") * F.col("total"))).otherwise(0.0).alias("simpson"), text.alias("distribution"))


def dominant_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must end in a unique column (drop_duplicates after a sort, idxmax, head(1))."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share_of_a, share_of_b, expected, enrichment) with expected = n_a * n_b / n."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("_n"))
    na, nb = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b))
    m = n.withColumn("_a", na).withColumn("_b", nb).crossJoin(F.broadcast(every))  # one row
    e = F.col("_a") * F.col("_b") / F.col("_n")
    return m.select(a, b, "n", (F.col("n") / F.col("_a")).alias("share_of_a"), (F.col("n") / F.col("_b")).alias("share_of_b"), e.alias("expected"), (F.col("n") / e).alias("enrichment"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, purity, nmi, ari): how far two labellings agree.

    Purity is the share of rows in the largest ``b`` of their ``a``; NMI is mutual information over the mean entropy (0 if both
    are constant); ARI is the adjusted Rand index in closed form. All come from the contingency counts.
    """
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    na, nb = n.groupBy(a).agg(F.sum("n").alias("n"), F.max("n").alias("m")), n.groupBy(b).agg(F.sum("n").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = n.agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.ln("n")).alias("hab"), pairs("n").alias("sab"))
    t = t.crossJoin(na.agg(F.sum(F.col("n") * F.ln("n")).alias("ha"), pairs("n").alias("sa"), F.sum("m").alias("m"))).crossJoin(nb.agg(F.sum(F.col("n") * F.ln("n")).alias("hb"), pairs("n").alias("sb")))
    ea, eb, eab = (F.ln("N") - F.col(h) / F.col("N") for h in ("ha", "hb", "hab"))
    chance = F.col("sa") * F.col("sb") / (F.col("N") * (F.col("N") - 1) / 2)
    return t.select(
        F.col("N").cast("long").alias("n"), (F.col("m") / F.col("N")).alias("purity"), F.coalesce((ea + eb - eab) / F.nullif((ea + eb) / 2, F.lit(0.0)), F.lit(0.0)).alias("nmi"),
        F.coalesce((F.col("sab") - chance) / F.nullif((F.col("sa") + F.col("sb")) / 2 - chance, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def rare_labels(counts: DataFrame, group: str, label: str, floor: int = 10, share: float = 0.01, collapsed: float = 0.75) -> DataFrame:
    """Labels of few rows and where they ended up (C8): label, n, host (the group with most of them), host_share, collapsed.

    Rare: n < max(floor, ceil(share of all rows)). Collapsed: at least ``collapsed`` of a rare label's rows are in one group that
    is larger than max(20, twice the median group).
    """
    total = counts.agg(F.sum("n").alias("_all"))
    per = counts.groupBy(label).agg(F.sum("n").alias("total")).crossJoin(F.broadcast(total))  # one row
    rare = per.where(F.col("total") < F.greatest(F.lit(floor), F.ceil(F.lit(share) * F.col("_all"))))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("_size"))
    mid = sizes.agg(F.median("_size").alias("_mid"))
    host = dominant_row(counts.join(rare.select(label, "total"), label), [label], [F.desc("n"), F.col(group)])
    h = host.join(sizes, group).crossJoin(F.broadcast(mid))
    s = F.col("n") / F.col("total")
    return h.select(label, F.col("total").alias("n"), F.col(group).alias("host"), s.alias("host_share"), ((s >= collapsed) & (F.col("_size") > F.greatest(F.lit(20.0), 2 * F.col("_mid")))).alias("collapsed"))
