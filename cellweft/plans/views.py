"""The domain's current tables: tidy keys, current versions, usable values. Each has the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.keys import cell_key, filled, key
from cellweft.operators.hotkeys import latest_rows
from cellweft.plans.registry import Tables

ANCHORS = """
anchors AS (
  SELECT upper(trim(anchor_id)) AS anchor_id, upper(trim(slice_id)) AS slice_id, "time", time_day, mouse_id, anchor_index, cell_type_l1 AS l1, cell_type_l2 AS l2, cell_type_l3 AS l3, x, y
  FROM niche_anchors WHERE anchor_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC NULLS LAST, coalesce(mouse_id, '') DESC, coalesce(cell_type_l1, '') DESC, coalesce(cell_type_l2, '') DESC, coalesce(cell_type_l3, '') DESC) = 1
)"""


def anchors(t: Tables) -> DataFrame:
    """Current version of each anchor without its vector."""
    d = t.niche_anchors.where("anchor_id IS NOT NULL").select(
        key("anchor_id").alias("anchor_id"), key("slice_id").alias("slice_id"), "time", "time_day", "mouse_id", "anchor_index",
        F.col("cell_type_l1").alias("l1"), F.col("cell_type_l2").alias("l2"), F.col("cell_type_l3").alias("l3"), "x", "y", "rep_version")
    text = [F.coalesce(c, F.lit("")) for c in ("mouse_id", "l1", "l2", "l3")]
    cols = ["slice_id", "time", "time_day", "mouse_id", "anchor_index", "l1", "l2", "l3", "x", "y"]
    best = d.groupBy("anchor_id").agg(F.max_by(F.struct(*cols), F.struct("rep_version", *text)).alias("r"))
    return best.select("anchor_id", *[F.col("r")[c].alias(c) for c in cols])


def current_vectors(t: Tables, dim: int = 48) -> DataFrame:
    """id, slice_id, day, vec (doubles) of anchors whose current version has ``dim`` finite numbers."""
    d = t.niche_anchors.where("anchor_id IS NOT NULL").select(key("anchor_id").alias("id"), key("slice_id").alias("slice_id"), F.col("time_day").alias("day"), "rep_version", "features")
    b = d.groupBy("id").agg(F.max_by(F.struct("day", "slice_id", "features"), F.struct("rep_version", "features")).alias("r")).select("id", "r.*")
    return b.where(f"size(features) = {dim} AND forall(features, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))").select("id", "slice_id", "day", F.col("features").cast("array<double>").alias("vec"))


EDGES = """
edges AS (
  SELECT upper(trim(source_anchor_id)) AS src, upper(trim(target_anchor_id)) AS dst, v2_row_normalized_transition_prob AS p, row_normalized_transition_prob AS p1,
    source_time, target_time, source_slice_id, target_slice_id, target_mouse_id FROM transition_edges
  WHERE source_anchor_id IS NOT NULL AND target_anchor_id IS NOT NULL AND p > 0 AND p <= 1 AND NOT isnan(p)
  QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY loaded_at DESC NULLS LAST, edge_id DESC) = 1
)"""


def edges(t: Tables) -> DataFrame:
    """Current usable transition of each source and target: src, dst, p and metadata."""
    p = F.col("v2_row_normalized_transition_prob")
    d = t.transition_edges.where(F.col("source_anchor_id").isNotNull() & F.col("target_anchor_id").isNotNull() & (p > 0) & (p <= 1)).select(
        key("source_anchor_id").alias("src"), key("target_anchor_id").alias("dst"), p.alias("p"), F.col("row_normalized_transition_prob").alias("p1"),
        "source_time", "target_time", "source_slice_id", "target_slice_id", "target_mouse_id", "loaded_at", "edge_id")
    return latest_rows(d, ["src", "dst"], ["p", "p1", "source_time", "target_time", "source_slice_id", "target_slice_id", "target_mouse_id"], "loaded_at", "edge_id")


EVIDENCE = """
evidence AS (
  SELECT upper(trim(sample_id)) AS sample_id, upper(trim(slice_id)) AS slice_id, upper(trim(assay)) AS assay, upper(trim(feature_id)) AS feature_id,
    coalesce(nullif(upper(trim(cell_key)), ''), upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id))) AS cell_key, CAST(sum(count) AS BIGINT) AS n
  FROM cellbin_feature_evidence WHERE count > 0 GROUP BY ALL
)"""


def evidence(t: Tables) -> DataFrame:
    """Detected features of each cell: sample, slice, assay, feature, cell_key and the summed count n."""
    return t.cellbin_feature_evidence.where("count > 0").select(
        key("sample_id").alias("sample_id"), key("slice_id").alias("slice_id"), key("assay").alias("assay"), key("feature_id").alias("feature_id"),
        F.coalesce(filled("cell_key"), cell_key("sample_id", "slice_id", "cellbin_id")).alias("cell_key"), "count",
    ).groupBy("sample_id", "slice_id", "assay", "feature_id", "cell_key").agg(F.sum("count").alias("n"))


CELLS = """
cells AS (
  SELECT DISTINCT upper(trim(sample_id)) AS sample_id, upper(trim(slice_id)) AS slice_id, section_order, upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id)) AS cell_key,
    CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(y) THEN y END AS y FROM cellbins WHERE cellbin_id IS NOT NULL
)"""


def cells(t: Tables) -> DataFrame:
    """Distinct cellbins with finite coordinates or null ones."""
    from cellweft.functions.scalars import finite

    return t.cellbins.where("cellbin_id IS NOT NULL").select(
        key("sample_id").alias("sample_id"), key("slice_id").alias("slice_id"), "section_order", cell_key("sample_id", "slice_id", "cellbin_id").alias("cell_key"), finite("x").alias("x"), finite("y").alias("y")).distinct()


ASSIGNED = """
assigned AS (
  SELECT upper(trim(sample_id)) AS sample_id, upper(trim(slice_id)) AS slice_id, upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id)) AS cell_key,
    nullif(upper(trim(clone_id)), '') AS clone_id, clone_status, trim(joint_clone_id) AS joint_clone_id, joint_prob, n_supporting_features, total_clone_evidence_count AS evidence_count
  FROM cellbin_clone_assignment WHERE cellbin_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id, slice_id, upper(trim(cellbin_id)) ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1
)"""


def assigned(t: Tables) -> DataFrame:
    """Later clone assignment of each cellbin."""
    from cellweft.functions.keys import trimmed

    d = t.cellbin_clone_assignment.where("cellbin_id IS NOT NULL").select(
        key("sample_id").alias("sample_id"), key("slice_id").alias("slice_id"), cell_key("sample_id", "slice_id", "cellbin_id").alias("cell_key"), filled("clone_id").alias("clone_id"), "clone_status",
        trimmed("joint_clone_id").alias("joint_clone_id"), "joint_prob", "n_supporting_features", F.col("total_clone_evidence_count").alias("evidence_count"), "loaded_at", "row_id")
    return latest_rows(d, ["sample_id", "slice_id", "cell_key"], ["clone_id", "clone_status", "joint_clone_id", "joint_prob", "n_supporting_features", "evidence_count"], "loaded_at", "row_id")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, so that the order of additions does not show."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
