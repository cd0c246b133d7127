"""Queries on skewed keys and on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cellweft.operators import hotkeys, references
from cellweft.plans.registry import Registry, Tables
from cellweft.session import cut

R = Registry()

_CURRENT = """
WITH r AS (
  SELECT upper(trim(slice_id)) AS slice_id, upper(trim(cellbin_id)) AS cellbin_id, trim(joint_clone_id) AS j, loaded_at, row_id
  FROM cellbin_clone_assignment WHERE slice_id IS NOT NULL AND cellbin_id IS NOT NULL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY slice_id, cellbin_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS n FROM r
), s AS (
  SELECT slice_id, j AS joint_clone_id, count(*) AS n_cellbins FROM k
  WHERE n = 1 AND j IS NOT NULL AND len(list_filter(string_split(j, '@'), lambda a: lower(trim(a)) NOT IN ('', 'nan'))) > 0
  GROUP BY ALL
), t AS (SELECT *, sum(n_cellbins) OVER (PARTITION BY slice_id) AS section_cellbins FROM s)
"""


@R.query("p2_found", _CURRENT + "SELECT slice_id, joint_clone_id FROM t WHERE n_cellbins >= 0.05 * section_cellbins")
def p2_found(t: Tables) -> DataFrame:
    return hotkeys.clone_sizes(t.cellbin_clone_assignment).where("giant_clone_flag").select("slice_id", "joint_clone_id")


@R.query("p2_sizes", _CURRENT + """
SELECT slice_id, joint_clone_id, n_cellbins, CAST(section_cellbins AS BIGINT) AS section_cellbins,
  round(n_cellbins / section_cellbins, 9) AS clone_share, n_cellbins >= 0.05 * section_cellbins AS giant_clone_flag FROM t""")
def p2_sizes(t: Tables) -> DataFrame:
    return hotkeys.clone_sizes(t.cellbin_clone_assignment).selectExpr(
        "slice_id", "joint_clone_id", "n_cellbins", "section_cellbins", "round(clone_share, 9) AS clone_share", "giant_clone_flag")


_REFS = """
WITH refs AS (
  SELECT 'transition_edges' AS table_name, edge_id AS row_id, 'anchor' AS registry, upper(trim(target_anchor_id)) AS ref_key, loaded_at FROM transition_edges
  UNION ALL SELECT 'cellbin_clone_assignment', row_id, 'cellbin', upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id)), loaded_at FROM cellbin_clone_assignment
  UNION ALL SELECT 'cellbin_feature_evidence', evidence_id, 'cellbin', upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id)), loaded_at FROM cellbin_feature_evidence
), keys AS (
  SELECT registry, ref_key, min(registered_at) AS registered_at, max(deleted_at) AS deleted_at FROM (
    SELECT 'anchor' AS registry, upper(trim(anchor_id)) AS ref_key, registered_at, deleted_at FROM niche_anchors
    UNION ALL SELECT 'anchor', upper(trim(anchor_id)), registered_at, NULL FROM atlas_anchors
    UNION ALL SELECT 'cellbin', upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id)), registered_at, deleted_at FROM cellbins
  ) WHERE ref_key IS NOT NULL GROUP BY ALL
), cases AS (
  SELECT table_name, row_id, CASE WHEN k.ref_key IS NULL THEN 'missing' WHEN k.registered_at > r.loaded_at THEN 'late'
      WHEN k.deleted_at <= r.loaded_at THEN 'deleted' END AS state, coalesce(strftime(r.loaded_at, '%Y-%m'), 'unknown') AS load_month
  FROM refs r LEFT JOIN keys k ON r.registry = k.registry AND r.ref_key = k.ref_key WHERE r.ref_key IS NOT NULL
)
"""


def _ledger(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(references, ledger): the written ledger of registrations, into which the references are merged as a change."""
    refs = references.lineage_references(t.transition_edges, t.cellbin_clone_assignment, t.cellbin_feature_evidence)
    held = cut(references.merge(references.existence_deltas(references.lineage_registrations(t.niche_anchors, t.atlas_anchors, t.cellbins))))
    return refs, references.merge(held, references.reference_deltas(refs))


def _faulty(t: Tables) -> DataFrame:
    return references.faulty_references(*_ledger(t))


@R.query("p7_found", _REFS + "SELECT * FROM cases WHERE state IS NOT NULL")
def p7_found(t: Tables) -> DataFrame:
    return _faulty(t)


@R.query("p7_report", _REFS + "SELECT table_name, load_month, state, count(*) AS n_rows FROM cases WHERE state IS NOT NULL GROUP BY ALL")
def p7_report(t: Tables) -> DataFrame:
    return _faulty(t).groupBy("table_name", "load_month", "state").count().withColumnRenamed("count", "n_rows")


@R.query("p7_orphan_keys", _REFS + """
SELECT r.registry, r.ref_key, count(*) AS refs FROM refs r LEFT JOIN keys k ON r.registry = k.registry AND r.ref_key = k.ref_key
WHERE r.ref_key IS NOT NULL AND k.ref_key IS NULL GROUP BY ALL""")
def p7_orphan_keys(t: Tables) -> DataFrame:
    return references.orphan_keys(_ledger(t)[1])
