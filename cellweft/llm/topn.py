"""The N best items of every group.

Partition lower bounds: within a task, the N-th best row of a group, by score and tie, is a lower bound of that group's N-th best row
overall. A task hands on its N best rows of a group and no more; the best bound of each group then removes most of what is left, and
only the survivors are ranked. A group with a third of all rows thus sends at most N rows per task, however many of its scores are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.session import cut

#: Rows a task holds before it prunes them to its local best.
PRUNE_ROWS = 200_000


def _prune(table: pa.Table, group: str, score: str, tie: str, n: int) -> pa.Table:
    """The ``n`` best rows of each group by score, then tie; ``_is_bound`` marks the n-th, which only groups of n rows have."""
    codes = table.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices
    keys = pa.table({"g": codes, "s": table.column(score), "t": table.column(tie)})
    order = pc.sort_indices(keys, sort_keys=[("g", "ascending"), ("s", "descending"), ("t", "ascending")])
    c = codes.to_numpy(zero_copy_only=False)[order.to_numpy()]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
    kept = table.take(order.filter(pa.array(rank < n)))
    at = table.schema.get_field_index("_is_bound")
    return kept.set_column(at, table.schema.field(at), pa.array(rank[rank < n] == n - 1))


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of highest ``score`` of each ``group`` with their ``rank_no`` (1 is best), equal scores by ascending ``tie``.

    Rows with a null or NaN score are dropped; a null group is a group; null ties come last. Rows equal in group, score and tie
    are ranked in arbitrary order among themselves, so dedupe first if that matters. All columns of ``df`` are kept; ``df`` must
    not have columns named ``_is_bound``, ``_g``, ``_s``, ``_t`` or ``rank_no``. An empty input gives no rows.
    """
    if n < 1:
        raise ValueError("n must be positive")
    schema = df.withColumn("_is_bound", F.lit(False)).schema

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= PRUNE_ROWS:
                held = [_prune(pa.concat_tables(held), group, score, tie, n)]
                # Many groups of few rows cannot be pruned; they stay, and are handed on rather than held.
                rows = held[0].num_rows
                if rows > PRUNE_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _prune(pa.concat_tables(held), group, score, tie, n).to_batches()

    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).withColumn("_is_bound", F.lit(False))
    # Written once, since bounds and survivors both come from it.
    kept = cut(scored.mapInArrow(local, schema))
    best = Window.partitionBy("_g").orderBy(F.desc("_s"), F.asc_nulls_last("_t"))
    bounds = kept.where("_is_bound").select(F.col(group).alias("_g"), F.col(score).alias("_s"), F.col(tie).alias("_t"))
    bounds = bounds.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    s, t = F.col(score), F.col(tie)
    reaches = F.col("_s").isNull() | (s > F.col("_s")) | ((s == F.col("_s")) & (F.col("_t").isNull() | (t <= F.col("_t"))))
    survivors = kept.join(bounds, F.col(group).eqNullSafe(F.col("_g")), "left").where(reaches)
    w = Window.partitionBy(group).orderBy(s.desc(), t.asc_nulls_last())
    return survivors.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n).drop("_is_bound", "_g", "_s", "_t")


def current_transitions(edges: DataFrame) -> DataFrame:
    """The later row of each source and target among usable rows: source_anchor_id, target_anchor_id, prob.

    Unusable: null source or target; a v2 probability that is null, not a number or not in (0, 1].
    """
    from cellweft.functions.keys import key
    from cellweft.operators.hotkeys import latest_rows

    p = F.col("v2_row_normalized_transition_prob")
    usable = edges.where(F.col("target_anchor_id").isNotNull() & F.col("source_anchor_id").isNotNull() & (p > 0) & (p <= 1)).select(
        key("source_anchor_id").alias("source_anchor_id"), key("target_anchor_id").alias("target_anchor_id"),
        p.alias("prob"), "loaded_at", "edge_id",
    )
    return latest_rows(usable, ["source_anchor_id", "target_anchor_id"], ["prob"], "loaded_at", "edge_id")


__all__ = ["current_transitions", "top_n"]
