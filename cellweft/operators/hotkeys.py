"""Per-key results when a few keys hold most rows.

Every aggregate here is algebraic, so each task folds its rows into one state per key before the shuffle: what crosses the
network is (distinct keys of a task) states, whatever share of rows the hottest key has. Spark's hash aggregate bounds its
table by execution memory and falls back to sorted spilling, so a task with very many keys survives too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.keys import key, trimmed


def latest_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str], time: str, tie: str) -> DataFrame:
    """Of rows with equal ``keys`` the one with the latest ``time`` (null is the oldest; equal times: larger ``tie``).

    ``max_by`` over (time, tie) keeps one state per key and task. Keys may be null (they form a group of their own).
    An empty input gives an empty result.
    """
    # A struct compares null as the smallest value, which is the rule wanted here.
    order = F.struct(F.col(time), F.col(tie))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[v].alias(v) for v in values])


def combined(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """``groupBy(keys).agg(...)`` for algebraic aggregates only (count, sum, min, max, min_by, max_by).

    Refuses functions whose state grows with the rows of a key (collect_list and the like), since those would bring a hot
    key back into one task.
    """
    for name, c in aggregates.items():
        said = str(c).lower()
        if any(x in said for x in ("collect_", "listagg", "percentile", "median", "mode(", "string_agg")):
            raise ValueError(f"{name}: its state grows with the rows of a key")
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def joint_id(col: str) -> Column:
    """A joint clone id without outer blanks; null if it is null, blank or all its alleles are missing (``nan``)."""
    c = trimmed(col)
    return F.when(F.exists(F.split(c, "@"), lambda a: ~F.lower(trimmed(a)).isin("", "nan")), c)


def clone_sizes(assignment: DataFrame, giant_share: float = 0.05) -> DataFrame:
    """Size of each joint clone in each section, over the later row of each cellbin, and whether it is giant.

    Input columns: row_id, slice_id, cellbin_id, joint_clone_id, loaded_at (others are ignored). Rows with a null slice or
    cellbin are dropped; cellbins whose later row names no clone drop out of both counts. A clone is giant in a section
    with at least ``giant_share`` of its remaining cellbins. Returns slice_id, joint_clone_id, n_cellbins,
    section_cellbins, clone_share, giant_clone_flag; repeated rows count once; an empty table gives no rows.
    """
    rows = assignment.select(
        key("slice_id").alias("slice_id"), key("cellbin_id").alias("cellbin_id"),
        joint_id("joint_clone_id").alias("joint_clone_id"), "loaded_at", "row_id",
    ).where("slice_id IS NOT NULL AND cellbin_id IS NOT NULL")
    current = latest_rows(rows, ["slice_id", "cellbin_id"], ["joint_clone_id"], "loaded_at", "row_id")
    sizes = combined(current.where("joint_clone_id IS NOT NULL"), ["slice_id", "joint_clone_id"], n_cellbins=F.count("*"))
    totals = combined(sizes, ["slice_id"], section_cellbins=F.sum("n_cellbins"))
    share = F.col("n_cellbins") / F.col("section_cellbins")
    return (
        sizes.join(totals, "slice_id")
        .withColumn("clone_share", share)
        .withColumn("giant_clone_flag", F.col("n_cellbins") >= F.lit(giant_share) * F.col("section_cellbins"))
    )


def clone_sections(assignment: DataFrame, giant_share: float = 0.05) -> DataFrame:
    """One row per joint clone: size over all sections and the share of all remaining cellbins, from compact per-section sizes."""
    per = clone_sizes(assignment, giant_share)
    return combined(
        per, ["joint_clone_id"], n_cellbins=F.sum("n_cellbins"), n_sections=F.count("*"),
        giant_sections=F.sum(F.col("giant_clone_flag").cast("long")), max_section_share=F.max("clone_share"),
    )
