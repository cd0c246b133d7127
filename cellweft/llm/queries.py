"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm import components, cooccurrence, density, language, leakage, neighbours, tokenize, topn
from cellweft.plans.registry import Registry, Tables
from cellweft.session import cut

R = Registry()

_TRANSITIONS = """
WITH u AS (
  SELECT upper(trim(source_anchor_id)) AS source_anchor_id, upper(trim(target_anchor_id)) AS target_anchor_id,
    v2_row_normalized_transition_prob AS prob, loaded_at, edge_id FROM transition_edges
  WHERE target_anchor_id IS NOT NULL AND prob > 0 AND prob <= 1 AND NOT isnan(prob)
), c AS (
  SELECT *, row_number() OVER (PARTITION BY source_anchor_id, target_anchor_id ORDER BY loaded_at DESC NULLS LAST, edge_id DESC) AS n FROM u
), k AS (
  SELECT source_anchor_id, target_anchor_id, prob,
    CAST(row_number() OVER (PARTITION BY source_anchor_id ORDER BY prob DESC, target_anchor_id) AS INTEGER) AS rank_no FROM c WHERE n = 1
)
"""


@R.query("p3_found", _TRANSITIONS + "SELECT source_anchor_id, rank_no, target_anchor_id FROM k WHERE rank_no <= 3")
def p3_found(t: Tables) -> DataFrame:
    best = topn.top_n(topn.current_transitions(t.transition_edges), "source_anchor_id", "prob", "target_anchor_id", 3)
    return best.select("source_anchor_id", "rank_no", "target_anchor_id")


@R.query("p4_found", """
WITH RECURSIVE l AS (
  SELECT upper(trim(cell_key)) AS k, upper(trim(clone_id)) AS c FROM clone_cellbin_membership
  WHERE trim(clone_id) <> '' AND trim(cell_key) <> '' AND coalesce(membership_status, '') <> 'filtered'
  UNION SELECT upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id)), upper(trim(clone_id))
  FROM cellbin_clone_assignment WHERE trim(clone_id) <> '' AND trim(cellbin_id) <> ''
), n AS (SELECT DISTINCT k, c FROM l WHERE k IS NOT NULL),
e AS (SELECT DISTINCT a.k, b.k AS m FROM n a JOIN n b ON a.c = b.c),
reach AS (SELECT k, m FROM e UNION SELECT r.k, e.m FROM reach r JOIN e ON r.m = e.k)
SELECT min(m) AS group_cell_key, k AS cell_key FROM reach GROUP BY k HAVING count(DISTINCT m) > 1""")
def p4_found(t: Tables) -> DataFrame:
    return components.clone_groups(t.clone_cellbin_membership, t.cellbin_clone_assignment)


_USABLE = """
WITH v AS (
  SELECT upper(trim(anchor_id)) AS id, upper(trim(slice_id)) AS slice_id, CAST(features AS DOUBLE[]) AS f,
    row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC NULLS LAST) AS n FROM niche_anchors WHERE anchor_id IS NOT NULL
), a AS (
  SELECT id, slice_id, f FROM v WHERE n = 1 AND len(f) = 48 AND len(list_filter(f, lambda x: NOT isfinite(x) OR x IS NULL)) = 0
    AND len(list_filter(f, lambda x: x <> 0)) > 0
)
"""
_DIM = 48


def _anchors(t: Tables) -> DataFrame:
    return neighbours.usable_vectors(neighbours.current_anchors(t.niche_anchors), "anchor_id", "features", _DIM)


@R.query("p1_found", _USABLE + """, d AS (
  SELECT a.id, b.id AS o, greatest(0, round(1 - list_cosine_similarity(a.f, b.f), 12)) AS d FROM a JOIN a b ON a.id <> b.id
), k AS (SELECT id, o, row_number() OVER (PARTITION BY id ORDER BY d, o) AS n FROM d WHERE d <= 0.02)
SELECT DISTINCT least(id, o) AS anchor_id_a, greatest(id, o) AS anchor_id_b FROM k WHERE n <= 5""")
def p1_found(t: Tables) -> DataFrame:
    return neighbours.close_pairs(neighbours.most_similar(_anchors(t), _DIM, k=5, max_distance=0.02))


def _groups(t: Tables) -> DataFrame:
    v = cut(neighbours.usable_vectors(neighbours.current_anchors(t.niche_anchors), "anchor_id", "features", _DIM, "slice_id"))
    current = t.run_params.where("is_current").select("n_pca_components").first()
    p = density.DensityParams(components=current[0]) if current and current[0] else density.DensityParams()
    return density.with_copies(density.compact_groups(v, _DIM, params=p), v)


@R.query("p5_found")
def p5_found(t: Tables) -> DataFrame:
    return _groups(t).select(F.col("group_id").alias("group_anchor_id"), F.col("id").alias("anchor_id"))


@R.query("p5_metaniches")
def p5_metaniches(t: Tables) -> DataFrame:
    return density.typical_members(_groups(t))


def _features(t: Tables, ratio: float) -> DataFrame:
    least = t.run_params.where("is_current").select("min_feature_cooccurrence_cellbins").first()
    return cooccurrence.feature_pairs(t.cellbin_feature_evidence, least[0] if least and least[0] else 1, ratio)


_PAIRS = """
WITH b AS (
  SELECT DISTINCT upper(trim(slice_id)) AS s, coalesce(nullif(upper(trim(cell_key)), ''), upper(trim(sample_id)) || '|' || upper(trim(slice_id)) || '|' || upper(trim(cellbin_id))) AS k,
    upper(trim(assay)) || '::' || upper(trim(feature_id)) AS f FROM cellbin_feature_evidence WHERE count > 0
), m AS (SELECT s, f, count(DISTINCT k) AS n FROM b GROUP BY ALL), t AS (SELECT s, count(DISTINCT k) AS n FROM b GROUP BY ALL),
o AS (SELECT x.f AS l, y.f AS r, count(DISTINCT x.k) AS observed FROM b x JOIN b y ON x.k = y.k AND x.f < y.f GROUP BY ALL HAVING count(DISTINCT x.k) >= 4),
e AS (SELECT l, r, observed, sum(ml.n * mr.n / t.n) AS expected FROM o JOIN m ml ON ml.f = l JOIN m mr ON mr.f = r AND mr.s = ml.s JOIN t ON t.s = ml.s GROUP BY ALL)
"""


@R.query("p6_found", _PAIRS + "SELECT l AS feature_left, r AS feature_right FROM e WHERE observed / expected >= 7.31")
def p6_found(t: Tables) -> DataFrame:
    return _features(t, 7.31).select(F.col("left").alias("feature_left"), F.col("right").alias("feature_right"))


@R.query("p6_pairs", _PAIRS + "SELECT l AS feature_left, r AS feature_right, observed, round(expected, 6) AS expected, round(observed / expected, 6) AS ratio FROM e")
def p6_pairs(t: Tables) -> DataFrame:
    return _features(t, 0.0).select(
        F.col("left").alias("feature_left"), F.col("right").alias("feature_right"), "observed", F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"))


@R.query("p8_ids")
def p8_ids(t: Tables) -> DataFrame:
    return tokenize.encoded(t.documents, "doc_id", "text")


_WINDOWS = r"""
regexp_extract_all(strip_accents(lower(replace(replace(regexp_replace(regexp_replace(text, '<[^<>]*>', '', 'g'), '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), 'ß', 'ss'), 'ẞ', 'ss'))), '[\p{L}\p{N}]+')
"""


@R.query("p9_found", f"""
WITH d AS (SELECT doc_id, {_WINDOWS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WINDOWS} AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""")
def p9_found(t: Tables) -> DataFrame:
    return leakage.leaks(t.documents, t.eval_items).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@R.query("p9_leaks")
def p9_leaks(t: Tables) -> DataFrame:
    found = leakage.leaks(t.documents, t.eval_items)
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


@R.query("p10_found")
def p10_found(t: Tables) -> DataFrame:
    found = language.document_passages(t.documents, t.lang_codes)
    return language.wrong_labels(t.documents, found, t.lang_codes).select("doc_id", "lang_code")


@R.query("p10_passages")
def p10_passages(t: Tables) -> DataFrame:
    return language.document_passages(t.documents, t.lang_codes)
