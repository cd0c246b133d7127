"""Referential integrity from signed change deltas.

A ledger holds, per (registry, key), how many rows of each month refer to the key and how many live registrations of each pair of times
it has. A change is a signed row: +1 when a reference or registration appears, -1 when it goes. Times are part of what is counted, so
merging is a sum whatever goes, in any order or number of batches: a registration that is retracted takes its times along. A key
referred to by a third of all rows is one compact state per month and task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.keys import cell_key, key, month

LEDGER = ["registry", "ref_key"]
#: What a count is of: references have the month of loading (null if not known), registrations their times.
COUNTED = [*LEDGER, "is_reference", "load_month", "registered_at", "deleted_at"]
_NEVER = "timestamp_ntz"


def reference_deltas(rows: DataFrame, sign: int | Column = 1) -> DataFrame:
    """Signed references. ``rows``: registry, ref_key, loaded_at. Null references are no references.

    The months of loading bound when the key was needed.
    """
    n = sign if isinstance(sign, Column) else F.lit(sign)
    none = F.lit(None).cast(_NEVER)
    return rows.where("ref_key IS NOT NULL").select(
        *LEDGER, F.lit(True).alias("is_reference"), F.date_trunc("month", "loaded_at").cast(_NEVER).alias("load_month"),
        none.alias("registered_at"), none.alias("deleted_at"), n.cast("long").alias("n"))


def existence_deltas(rows: DataFrame, sign: int | Column = 1) -> DataFrame:
    """Signed registrations. ``rows``: registry, ref_key, registered_at, deleted_at.

    Repeated rows of one key are one registration (counts above zero only mean "exists"); were their times to differ, the
    earliest registration and the latest deletion of those that are left hold.
    """
    n = sign if isinstance(sign, Column) else F.lit(sign)
    return rows.where("ref_key IS NOT NULL").select(
        *LEDGER, F.lit(False).alias("is_reference"), F.lit(None).cast(_NEVER).alias("load_month"),
        F.col("registered_at").cast(_NEVER).alias("registered_at"), F.col("deleted_at").cast(_NEVER).alias("deleted_at"), n.cast("long").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum ledgers and deltas in one aggregation; counts of zero leave the ledger."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")


def key_states(ledger: DataFrame) -> DataFrame:
    """Per key: refs, exists, first_month and last_month of its references, registered_at (earliest), deleted_at (latest)."""
    ref, there = F.col("is_reference") & (F.col("n") > 0), ~F.col("is_reference") & (F.col("n") > 0)
    return ledger.groupBy(*LEDGER).agg(
        F.sum(F.when(F.col("is_reference"), F.col("n")).otherwise(0)).alias("refs"), F.sum(F.when(F.col("is_reference"), 0).otherwise(F.col("n"))).alias("exists"),
        F.min(F.when(ref, F.col("load_month"))).alias("first_month"), F.max(F.when(ref, F.col("load_month"))).alias("last_month"),
        F.min(F.when(there, F.col("registered_at"))).alias("registered_at"), F.max(F.when(there, F.col("deleted_at"))).alias("deleted_at"))


def orphan_keys(ledger: DataFrame) -> DataFrame:
    """Keys with positive references and no existence: the current orphan report."""
    return key_states(ledger).where("refs > 0 AND exists <= 0").select(*LEDGER, "refs")


def suspect_keys(ledger: DataFrame) -> DataFrame:
    """Referenced keys of which some row may be missing, late or deleted; all other keys cannot give a case."""
    return key_states(ledger).where(
        "refs > 0 AND (exists <= 0 OR registered_at > first_month OR deleted_at < last_month + INTERVAL 1 MONTH)"
    ).select(*LEDGER, (F.col("exists") > 0).alias("known"), "registered_at", "deleted_at")


def state_of(known: Column, registered: Column, deleted: Column, loaded: Column) -> Column:
    """``missing``, ``late``, ``deleted`` or null, in this order of precedence; a null time never makes late or deleted."""
    return F.when(~known, "missing").when(registered > loaded, "late").when(deleted <= loaded, "deleted")


def faulty_references(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows that refer to a missing, late or deleted key: table_name, row_id, state, load_month.

    ``rows``: table_name, row_id, registry, ref_key, loaded_at. Only suspect keys take part in the join; they are few when the
    data is mostly sound, and Spark then broadcasts them by their measured size. Otherwise the join is a shuffle whose hot
    keys adaptive execution splits.
    """
    bad = suspect_keys(ledger)
    state = state_of(F.col("known"), F.col("registered_at"), F.col("deleted_at"), F.col("loaded_at"))
    return (
        rows.where("ref_key IS NOT NULL").join(bad, LEDGER)
        .select("table_name", "row_id", state.alias("state"), month("loaded_at").alias("load_month"))
        .where("state IS NOT NULL")
    )


def lineage_references(edges: DataFrame, assignment: DataFrame, evidence: DataFrame) -> DataFrame:
    """The references of the three tables in one shape: table_name, row_id, registry, ref_key, loaded_at."""
    def take(df: DataFrame, table: str, registry: str, row_id: str, ref: Column) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col(row_id).alias("row_id"), F.lit(registry).alias("registry"), ref.alias("ref_key"), "loaded_at")

    bins = cell_key("sample_id", "slice_id", "cellbin_id")
    return (
        take(edges, "transition_edges", "anchor", "edge_id", key("target_anchor_id"))
        .unionByName(take(assignment, "cellbin_clone_assignment", "cellbin", "row_id", bins))
        .unionByName(take(evidence, "cellbin_feature_evidence", "cellbin", "evidence_id", bins))
    )


def lineage_registrations(anchors: DataFrame, atlas: DataFrame, cellbins: DataFrame) -> DataFrame:
    """What the references may name: registry, ref_key, registered_at, deleted_at. Atlas anchors are never deleted."""
    never = F.lit(None).cast("timestamp_ntz")

    def take(df: DataFrame, registry: str, ref: Column, deleted: Column) -> DataFrame:
        return df.select(F.lit(registry).alias("registry"), ref.alias("ref_key"), "registered_at", deleted.alias("deleted_at"))

    return (
        take(anchors, "anchor", key("anchor_id"), F.col("deleted_at"))
        .unionByName(take(atlas, "anchor", key("anchor_id"), never))
        .unionByName(take(cellbins, "cellbin", cell_key("sample_id", "slice_id", "cellbin_id"), F.col("deleted_at")))
    )
