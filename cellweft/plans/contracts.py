"""Queries on contracts between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions import scalars as S
from cellweft.functions.keys import key
from cellweft.operators import clones as K
from cellweft.operators import contracts as C
from cellweft.operators import fate as FT
from cellweft.operators import markov
from cellweft.operators import spatial as G
from cellweft.plans import views as V
from cellweft.plans.lineage import _JOINT
from cellweft.plans.registry import Registry, Tables
from cellweft.plans.spatial import _MEM, _POINTS, _RADIUS, _pts
from cellweft.plans.transitions import _COMPONENTS, _DAYED, _METRICS, _VEC, _dayed, _fate, _nodes, _vectors

R = Registry()
_A, _AE = "WITH " + V.ANCHORS, "WITH " + V.ANCHORS + "," + V.EDGES


@R.query("t10_edge_contract", "SELECT edge_id, source_anchor_id, target_anchor_id, source_slice_id, target_slice_id, source_mouse_id, target_mouse_id, source_time, target_time, row_normalized_transition_prob, v2_row_normalized_transition_prob, v2_unnormalized_weight, v2_rank_within_source, loaded_at FROM transition_edges")
def t10(t: Tables) -> DataFrame:
    return C.conforming(t.transition_edges, C.EDGE_COLUMNS)


@R.query("t8_identity", _AE + "SELECT src, dst, p, s.slice_id AS source_slice, d.slice_id AS target_slice, s.l1 AS source_l1, d.l1 AS target_l1 FROM edges JOIN anchors s ON src = s.anchor_id JOIN anchors d ON dst = d.anchor_id")
def t8(t: Tables) -> DataFrame:
    n = V.anchors(t).select(F.col("anchor_id").alias("id"), F.col("slice_id").alias("slice"), "l1")
    return C.with_identity(V.edges(t).select("src", "dst", "p"), n, ["slice", "l1"])


@R.query("t11_shard_report", "WITH e AS (SELECT source_slice_id, upper(trim(source_anchor_id)) AS src, v2_row_normalized_transition_prob AS p FROM transition_edges), s AS (SELECT source_slice_id, src, count(*) AS n, sum(p) FILTER (isfinite(p)) AS s, count(*) FILTER (p IS NULL OR NOT isfinite(p)) AS bad, count(*) FILTER (isfinite(p) AND p < 0) AS neg FROM e GROUP BY ALL), r AS (SELECT source_slice_id, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_edges, count(*) FILTER (n <> 10) AS wrong_k, CAST(sum(bad) AS BIGINT) AS unusable, CAST(sum(neg) AS BIGINT) AS negative, count(*) FILTER (abs(coalesce(s, 0) - 1) > 1e-5) AS off_one FROM s GROUP BY ALL) SELECT *, wrong_k = 0 AND unusable = 0 AND negative = 0 AND off_one = 0 AS passes FROM r")
def t11(t: Tables) -> DataFrame:
    e = t.transition_edges.select("source_slice_id", key("source_anchor_id").alias("src"), F.col("v2_row_normalized_transition_prob").alias("p"))
    return C.shard_report(e, ["source_slice_id"], 10)


@R.query("t3_approximate_candidates")
def t3(t: Tables) -> DataFrame:
    v = _vectors(t).select("id", F.col("features").alias("vec"))
    return C.lsh_candidates(v, v, "vec", 48, 5)


@R.query("g21_group_means", _A + _VEC + """, z AS (SELECT anchors.slice_id, id, unnest(range(1, 49)) AS i, unnest(vec) AS x FROM u JOIN anchors ON anchor_id = id), g AS (SELECT slice_id, i, avg(x) AS m, count(*) AS n FROM z GROUP BY ALL)
SELECT slice_id, max(n) AS n_cells, list(round(m, 5) ORDER BY i) AS mean_vector FROM g GROUP BY slice_id""")
def g21(t: Tables) -> DataFrame:
    v = V.current_vectors(t).where("day IS NOT NULL").select("id", "slice_id", "vec")
    return C.group_means(v.select("slice_id", "id"), v, "slice_id", "id", "vec").withColumn("mean_vector", F.transform("mean_vector", lambda x: F.round(x, 5)))


@R.query("g22_neighbour_integrity", _MEM + "SELECT count(*) FILTER (own = 0) AS without_self, 0::BIGINT AS unknown, 0::BIGINT AS repeated, 0::BIGINT AS without_list FROM (SELECT anchor, count(*) FILTER (anchor = member) AS own FROM m GROUP BY anchor)")
def g22(t: Tables) -> DataFrame:
    p = _pts(t)
    return C.neighbour_integrity(G.with_self(p, G.within_radius(p, _RADIUS)), p)


@R.query("l13_spatial_subset", _POINTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, id) AS rx, row_number() OVER (PARTITION BY g ORDER BY y, id) AS ry, count(*) OVER (PARTITION BY g) AS n FROM pts), b AS (SELECT g, id, (greatest(((rx - 1) * 4 + n - 2) // (n - 1) - 1, 0), greatest(((ry - 1) * 4 + n - 2) // (n - 1) - 1, 0)) AS tile FROM r),
c AS (SELECT g, count(DISTINCT tile) AS c FROM b GROUP BY g), q AS (SELECT b.*, row_number() OVER (PARTITION BY g, tile ORDER BY md5('1|' || id), id) <= 50 // c AS first FROM b JOIN c USING (g))
SELECT id FROM q QUALIFY row_number() OVER (PARTITION BY g ORDER BY first DESC, md5('1|' || id), id) <= 50""")
def l13(t: Tables) -> DataFrame:
    return C.spatial_subset(_pts(t), 50, bins=4).select("id")


@R.query("c20_enrichment", _A + ", n AS (SELECT slice_id, l1, count(*) AS n FROM anchors WHERE l1 IS NOT NULL AND slice_id IS NOT NULL GROUP BY ALL), m AS (SELECT *, n / sum(n) OVER (PARTITION BY slice_id) AS share, sum(n) OVER (PARTITION BY l1) / sum(n) OVER () AS background FROM n) SELECT slice_id, l1, n, round(share, 6) AS share, round(background, 6) AS background, round(share / background, 6) AS enrichment, share / background >= 2 AS enriched FROM m")
def c20(t: Tables) -> DataFrame:
    return V.rounded(C.enrichment(V.anchors(t), "slice_id", "l1"))


@R.query("j8_allele_qc", _JOINT + ", a AS (SELECT cell_key, unnest(al) AS allele, n_supporting_features AS n FROM jj) SELECT allele, nullif(regexp_extract(allele, '^(CA|TA|RA)_', 1), '') AS locus, count(DISTINCT cell_key) AS n_cells, max(n) AS max_n, min(n) AS min_n FROM a GROUP BY allele")
def j8(t: Tables) -> DataFrame:
    a = V.assigned(t).select("cell_key", F.explode(S.joint_alleles("joint_clone_id")).alias("allele"), F.col("n_supporting_features").alias("n")).withColumn("locus", S.locus("allele"))
    return C.allele_qc(a)


@R.query("j2_reference_mapping", _JOINT + ", a AS (SELECT DISTINCT unnest(al) AS allele FROM jj), d AS (SELECT allele, nullif(regexp_extract(allele, '^(CA|TA|RA)_', 1), '') AS locus FROM a), x AS (SELECT count(*) AS n_alleles, count(*) FILTER (locus = 'CA') AS ca, count(*) FILTER (locus IN ('CA', 'TA')) AS both_ FROM d) SELECT 'ca' AS bank, n_alleles, ca AS n_mapped, round(ca / n_alleles, 6) AS fraction, false AS selected FROM x UNION ALL SELECT 'ca_ta', n_alleles, both_, round(both_ / n_alleles, 6), true FROM x")
def j2(t: Tables) -> DataFrame:
    a = V.assigned(t).select(F.explode(S.joint_alleles("joint_clone_id")).alias("allele")).withColumn("locus", S.locus("allele"))
    return V.rounded(C.reference_mapping(a, {"ca": a.where("locus = 'CA'"), "ca_ta": a.where("locus IN ('CA', 'TA')")}))


@R.query("j10_incidence", _JOINT + """, p AS (SELECT joint_clone_id, count(*) AS n FROM jj GROUP BY ALL), ok AS (SELECT joint_clone_id FROM p WHERE n < 0.05 * (SELECT sum(n) FROM p)), c AS (SELECT cell_key, ok.joint_clone_id AS clone FROM assigned LEFT JOIN ok USING (joint_clone_id))
SELECT cell_key, coalesce(clone, 'unassigned') AS clone, dense_rank() OVER (ORDER BY cell_key) - 1 AS "row", CASE WHEN clone IS NOT NULL THEN dense_rank() OVER (ORDER BY clone NULLS LAST) - 1 END AS col FROM c""")
def j10(t: Tables) -> DataFrame:
    a = V.assigned(t)
    return C.incidence(a, K.clone_qc(a))


@R.query("fate5_assignment_checks", _A + ", s AS (SELECT count(*) FILTER (time_day IS NULL) AS u FROM anchors) SELECT u AS unassigned, 0::BIGINT AS unknown, 0::BIGINT AS out_of_range, 0::BIGINT AS repeated FROM s")
def fate5(t: Tables) -> DataFrame:
    a = V.anchors(t)
    n = FT.layered(_nodes(t)).select("id", F.col("layer").alias("state"))
    return C.assignment_checks(a.select(F.col("anchor_id").alias("id")), n, 99)


@R.query("fate11_mapped_endpoints", _METRICS + "SELECT id, state, round(prob, 12) AS prob, CASE state WHEN 'Immune' THEN 'Blood' WHEN 'Glia' THEN 'Nerve' ELSE state END AS refined FROM fate")
def fate11(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([("Immune", "Blood"), ("Glia", "Nerve")], "state string, refined string")
    return V.rounded(C.mapped_endpoints(_fate(t)[0], m), 12)


@R.query("fate12_stability", _METRICS + """, n AS (SELECT day, count(*) AS n FROM fn GROUP BY ALL), g AS (SELECT day, state, n FROM n, (SELECT DISTINCT state FROM fate)), m AS (SELECT day, state, sum(prob) AS m FROM fate JOIN fn USING (id) GROUP BY ALL), z AS (SELECT day, state, coalesce(m, 0) / n AS mp FROM g LEFT JOIN m USING (day, state)),
l AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY mp DESC, state) = 1 AS lead FROM z) SELECT state, sum(lead::INT)::BIGINT AS leads, bool_and(lead) AS always, round(coalesce(max(mp) / nullif(avg(mp), 0), 0), 6) AS peak_ratio, round(stddev_pop(mp), 6) AS sd FROM l GROUP BY state""")
def fate12(t: Tables) -> DataFrame:
    f, n = _fate(t)
    return V.rounded(FT.stability(FT.by_group(f, n, "day"), "day"))


@R.query("fate10_quantiles", _METRICS + "SELECT slice_id, round(quantile_cont(top1, .25), 6) AS p25, round(median(top1), 6) AS p50, round(quantile_cont(top1, .75), 6) AS p75 FROM q JOIN fn USING (id) GROUP BY slice_id")
def fate10q(t: Tables) -> DataFrame:
    f, n = _fate(t)
    return V.rounded(FT.quantiles_by(FT.metrics(f, 8).join(n.select("id", "slice_id"), "id"), "slice_id", "top1"))


@R.query("fate13_tiers", _METRICS + ", z AS (SELECT id, round(top1, 9) AS top1, round(greatest(least(h / ln(8), 1), 0), 9) AS ne FROM q), l AS (SELECT quantile_cont(top1, .25) AS lo, quantile_cont(top1, .75) AS hi, quantile_cont(ne, .75) AS e FROM z) SELECT id, CASE WHEN top1 >= hi THEN 'high' WHEN top1 <= lo AND ne >= e THEN 'low' ELSE 'mixed' END AS tier FROM z, l")
def fate13(t: Tables) -> DataFrame:
    m = V.rounded(FT.metrics(_fate(t)[0], 8), 9)
    return FT.tiers(m).select("id", "tier")


@R.query("c14_largest_component", _COMPONENTS + """, big AS (SELECT id FROM w WHERE m = (SELECT m FROM w GROUP BY m ORDER BY count(*) DESC, m LIMIT 1)), s AS (SELECT src, dst, sum(p) AS x FROM de WHERE src IN (SELECT id FROM big) AND dst IN (SELECT id FROM big) GROUP BY ALL)
SELECT src, dst, round(round(x / sum(x) OVER (PARTITION BY src), 12), 6) AS p FROM s UNION ALL SELECT id, id, 1.0 FROM big WHERE id NOT IN (SELECT src FROM s)""")
def c14(t: Tables) -> DataFrame:
    # Twelve digits first: sums differ in their last ones by order, which would show at halves of the sixth.
    return V.rounded(V.rounded(_in_largest_component(_nodes(t), _dayed(t)), 12))


def _in_largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges of the largest weak component, renormalised, with a self-loop where a node has none (C14)."""
    from cellweft.operators.graph import component_sizes, weak_components
    from cellweft.session import cut

    c = cut(weak_components(nodes, edges))
    big = c.join(component_sizes(c).where("rank = 1").select("component"), "component", "left_semi").select("id")
    # Restricted edges sum to 1 already; written once, since loops are what they leave out.
    e = cut(markov.restricted(edges, big))
    loops = big.select(F.col("id").alias("src")).join(e.select("src").distinct(), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    return e.unionByName(loops)
