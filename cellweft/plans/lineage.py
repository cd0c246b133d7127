"""Queries on barcode evidence, clones and their composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions import scalars as S
from cellweft.operators import clones as K
from cellweft.operators import lineage as L
from cellweft.operators import potential as N
from cellweft.operators import spatial as G
from cellweft.operators.diversity import dominant_row
from cellweft.plans import views as V
from cellweft.plans.registry import Registry, Tables

R = Registry()

_EV = "WITH " + V.EVIDENCE
_CE = "WITH " + V.CELLS + "," + V.EVIDENCE
_AS = "WITH " + V.ASSIGNED


def _summary_sql(key: str, source: str) -> str:
    return f""", fx AS (SELECT {key}, assay, feature_id, CAST(sum(n) AS BIGINT) AS n FROM {source} GROUP BY ALL),
sx AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS total_count, count(*) AS n_features, count(DISTINCT assay) AS n_assays, CAST(coalesce(sum(n) FILTER (assay = 'RA'), 0) AS BIGINT) AS RA_count, count(*) FILTER (assay = 'RA') AS RA_features,
  CAST(coalesce(sum(n) FILTER (assay = 'TA'), 0) AS BIGINT) AS TA_count, count(*) FILTER (assay = 'TA') AS TA_features, CAST(coalesce(sum(n) FILTER (assay = 'CA'), 0) AS BIGINT) AS CA_count, count(*) FILTER (assay = 'CA') AS CA_features,
  arg_min(feature_id, (-n, CASE assay WHEN 'RA' THEN 1 WHEN 'TA' THEN 2 WHEN 'CA' THEN 3 ELSE 99 END, feature_id)) AS dominant_feature, arg_min(assay, (-n, CASE assay WHEN 'RA' THEN 1 WHEN 'TA' THEN 2 WHEN 'CA' THEN 3 ELSE 99 END, feature_id)) AS dominant_assay,
  max(n) / sum(n) AS dominant_fraction, CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0 END AS entropy, CASE WHEN count(*) > 1 THEN 1 - sum(n * n) / sum(n)**2 ELSE 0 END AS simpson FROM fx GROUP BY {key}),
sy AS (SELECT *, (RA_count > 0)::INT + (TA_count > 0)::INT + (CA_count > 0)::INT AS pos, list_sum([CASE WHEN c > 0 THEN -(c / total_count) * ln(c / total_count) ELSE 0 END FOR c IN [RA_count, TA_count, CA_count]]) AS hb FROM sx)"""


_COLS = "total_count, n_features, n_assays, RA_count, RA_features, TA_count, TA_features, CA_count, CA_features, dominant_feature, dominant_assay"
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in "total_count n_features n_assays RA_count RA_features TA_count TA_features CA_count CA_features".split()) + ", dominant_feature, dominant_assay"
_FLOATS = "round(coalesce(dominant_fraction, 0), 6) AS dominant_fraction, round(coalesce(entropy, 0), 6) AS entropy, round(coalesce(simpson, 0), 6) AS simpson, round(coalesce(CASE WHEN pos > 1 THEN hb / ln(pos) ELSE 0 END, 0), 6) AS assay_balance"


@R.query("l2_cell_summary", _CE + _summary_sql("cell_key", "evidence") + f"SELECT c.cell_key, {_ZERO}, {_FLOATS}, s.total_count IS NOT NULL AS evidence_present FROM (SELECT DISTINCT cell_key FROM cells) c LEFT JOIN sy s USING (cell_key)")
def l2(t: Tables) -> DataFrame:
    return V.rounded(L.cell_summary(V.cells(t), V.evidence(t)))


def _cell_points(t: Tables) -> DataFrame:
    return G.located(dominant_row(V.cells(t).where("x IS NOT NULL AND y IS NOT NULL"), ["cell_key"], [F.col("x"), F.col("y")]), "slice_id", "cell_key")


_TILES = _CE + """, cp AS (SELECT slice_id AS g, cell_key, x, y FROM cells WHERE x IS NOT NULL AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY x, y) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, cell_key) AS rx, row_number() OVER (PARTITION BY g ORDER BY y, cell_key) AS ry, count(*) OVER (PARTITION BY g) AS n FROM cp),
mem AS (SELECT cell_key, g || '__tile_x' || lpad(CAST(CAST(greatest(((rx - 1) * 5 + n - 2) // (n - 1) - 1, 0) AS INTEGER) AS VARCHAR), 2, '0') || '_y' || lpad(CAST(CAST(greatest(((ry - 1) * 5 + n - 2) // (n - 1) - 1, 0) AS INTEGER) AS VARCHAR), 2, '0') AS group_id FROM rk),
ge AS (SELECT m.group_id, e.* FROM mem m JOIN evidence e USING (cell_key))"""


def _tile_members(t: Tables) -> DataFrame:
    return G.tiles(_cell_points(t), 5).select(F.col("id").alias("cell_key"), F.col("tile_id").alias("group_id"))


@R.query("l5_group_summary", _TILES + _summary_sql("group_id", "ge") + f", nm AS (SELECT group_id, count(*) AS n_members FROM mem GROUP BY ALL), ne AS (SELECT group_id, count(DISTINCT cell_key) AS n_with_evidence FROM ge GROUP BY ALL) SELECT group_id, n_members, coalesce(n_with_evidence, 0) AS n_with_evidence, {_ZERO}, {_FLOATS}, round(coalesce(n_with_evidence, 0) / n_members, 6) AS fraction_with_evidence FROM nm LEFT JOIN ne USING (group_id) LEFT JOIN sy USING (group_id)")
def l5(t: Tables) -> DataFrame:
    return V.rounded(L.group_summary(_tile_members(t), V.evidence(t)))


@R.query("l6_top_features", _EV + ", f AS (SELECT slice_id, assay, feature_id, CAST(sum(n) AS BIGINT) AS n FROM evidence GROUP BY ALL) SELECT slice_id, assay, feature_id, n, round(n / sum(n) OVER (PARTITION BY slice_id), 6) AS fraction, row_number() OVER (PARTITION BY slice_id ORDER BY n DESC, assay, feature_id) AS rank FROM f QUALIFY rank <= 10")
def l6(t: Tables) -> DataFrame:
    return V.rounded(L.top_features(V.evidence(t), "slice_id"))


@R.query("l6_assay_grid", _CE + ", e AS (SELECT slice_id, assay, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT feature_id) AS f FROM evidence GROUP BY ALL) SELECT slice_id, assay, coalesce(n, 0) AS n, coalesce(f, 0) AS n_features FROM (SELECT * FROM (SELECT DISTINCT slice_id FROM cells), (VALUES ('RA'), ('TA'), ('CA')) a(assay)) g LEFT JOIN e USING (slice_id, assay)")
def l6g(t: Tables) -> DataFrame:
    return L.assay_grid(V.cells(t), V.evidence(t), "slice_id")


@R.query("l7_unit_counts", _EV + "SELECT slice_id, count(*) AS local, count(DISTINCT cell_key) AS uniq, round(count(*) / count(DISTINCT cell_key), 6) AS ratio FROM evidence GROUP BY ALL")
def l7(t: Tables) -> DataFrame:
    return V.rounded(L.unit_counts(V.evidence(t), "slice_id", "cell_key"))


@R.query("l8_coverage", _EV + """, c AS (SELECT sample_id, cell_key, count(DISTINCT (assay, feature_id)) AS n FROM evidence GROUP BY ALL), b AS (SELECT * FROM c UNION ALL SELECT 'ALL', cell_key, n FROM c)
SELECT sample_id, count(*) AS n_cells, count(*) FILTER (n >= 1) AS at_least_1, count(*) FILTER (n >= 3) AS at_least_3, round(quantile_cont(n, .05), 6) AS q05, round(quantile_cont(n, .25), 6) AS q25, round(quantile_cont(n, .5), 6) AS q50, round(quantile_cont(n, .75), 6) AS q75, round(quantile_cont(n, .95), 6) AS q95 FROM b GROUP BY ALL""")
def l8(t: Tables) -> DataFrame:
    c = V.evidence(t).groupBy("sample_id", "cell_key").agg(F.countDistinct("assay", "feature_id").alias("n_features"))
    return V.rounded(L.coverage(c, "sample_id"))


@R.query("l9_join_validation", _CE + ", e AS (SELECT DISTINCT cell_key FROM evidence), m AS (SELECT cell_key, count(DISTINCT (x, y)) AS n FROM cells GROUP BY ALL) SELECT count(*) AS evidence_cells, count(*) FILTER (cell_key NOT IN (SELECT cell_key FROM cells)) AS without_cell, (SELECT count(*) FROM m WHERE n > 1) AS moved_cells FROM e")
def l9(t: Tables) -> DataFrame:
    return L.join_validation(V.cells(t), V.evidence(t))


@R.query("l10_assay_qc", _EV + "SELECT sample_id, slice_id, assay, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT cell_key) AS cells, count(DISTINCT feature_id) AS features FROM evidence GROUP BY ALL")
def l10(t: Tables) -> DataFrame:
    return L.assay_qc(V.evidence(t))


@R.query("l11_inflation", _EV + ", k AS (SELECT feature_id, count(*) AS k FROM (SELECT DISTINCT assay, feature_id FROM evidence) GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * k) AS BIGINT) AS joined_total, CAST(sum(n) AS BIGINT) AS collapsed_total, count(*) FILTER (k > 1) AS rows_multiplied FROM evidence JOIN k USING (feature_id)")
def l11(t: Tables) -> DataFrame:
    e = V.evidence(t)
    return L.inflation_audit(e, e.select("assay", "feature_id").distinct())


@R.query("l12_group_checks", "WITH " + V.CELLS + ", p AS (SELECT count(*) AS n FROM (SELECT DISTINCT cell_key FROM cells WHERE x IS NOT NULL AND y IS NOT NULL)) SELECT n AS n_groups, true AS one_centre, true AS size_ok, true AS no_repeats, true AS one_slice, 0::BIGINT AS unknown_members FROM p")
def l12(t: Tables) -> DataFrame:
    p = _cell_points(t)
    return L.group_checks(G.neighbour_groups(p, 4), p, 4)


_FE = _EV + ", ev AS (SELECT assay || '::' || feature_id AS feature, assay, cell_key, CAST(sum(n) AS BIGINT) AS n FROM evidence GROUP BY ALL)"
_REF = _FE + """, nn AS (SELECT count(DISTINCT cell_key) AS tot FROM ev), ref AS (SELECT feature, count(DISTINCT cell_key) AS n_cells, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT cell_key) / any_value(tot) AS fraction, -ln(count(DISTINCT cell_key) / any_value(tot) + 1 / (10 * any_value(tot))) AS rarity FROM ev, nn GROUP BY feature)"""


def _features(t: Tables) -> DataFrame:
    return V.evidence(t).groupBy("assay", "feature_id", "cell_key").agg(F.sum("n").alias("n")).select(F.concat("assay", F.lit("::"), "feature_id").alias("feature"), "assay", "cell_key", "n")


@R.query("k2_feature_reference", _REF + "SELECT feature, n_cells, total, round(fraction, 8) AS fraction, round(rarity, 6) AS rarity, CASE WHEN fraction <= 0.001 THEN 'rare' WHEN fraction <= 0.005 THEN 'low' ELSE 'common_filtered' END AS frequency_class, fraction <= 0.005 AS valid FROM ref")
def k2(t: Tables) -> DataFrame:
    r = K.feature_reference(_features(t))
    return r.select("feature", "n_cells", "total", F.round("fraction", 8).alias("fraction"), F.round("rarity", 6).alias("rarity"), "frequency_class", "valid")


@R.query("k3_cell_complexity", _FE + """, c AS (SELECT cell_key, count(DISTINCT feature) AS n_features, count(DISTINCT assay) AS n_loci, max(n) / sum(n) AS mf FROM ev GROUP BY cell_key), s AS (SELECT *, n_features * greatest(n_loci, 1) * (1 - mf) AS b FROM c), q AS (SELECT quantile_cont(b, .99) AS q FROM s)
SELECT cell_key, n_features, n_loci, round(mf, 6) AS max_fraction, round(b, 6) AS bridge_score, b > q AND n_features > 1 AS bridge FROM s, q""")
def k3(t: Tables) -> DataFrame:
    return V.rounded(K.cell_complexity(_features(t)))


_RARE = _REF + ", rr AS (SELECT feature FROM ref WHERE fraction <= 0.02), re AS (SELECT DISTINCT cell_key, feature FROM ev JOIN rr USING (feature)), rn AS (SELECT feature, count(*) AS n FROM re GROUP BY ALL), pr AS (SELECT a.feature AS src, b.feature AS dst, count(*) AS observed FROM re a JOIN re b ON a.cell_key = b.cell_key AND a.feature < b.feature GROUP BY ALL HAVING count(*) >= 2)"


def _rare(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _features(t)
    # Features in more than 2 % of cells are common and link nothing: a parameter of K2.
    ref = K.feature_reference(e, low=0.02)
    few = ref.where("valid").select("feature")
    kept = e.join(few, "feature", "left_semi")
    return e, kept, ref


@R.query("k4_compatibility", _RARE + "SELECT src, dst, observed, round(observed / (a.n + b.n - observed), 6) AS jaccard FROM pr JOIN rn a ON a.feature = src JOIN rn b ON b.feature = dst")
def k4(t: Tables) -> DataFrame:
    return V.rounded(K.compatibility_graph(_rare(t)[1]))


_COMP = _RARE + """, u AS (SELECT src AS a, dst AS b FROM pr UNION SELECT dst, src FROM pr), co AS (WITH RECURSIVE r(id, m) USING KEY (id) AS (SELECT feature, feature FROM rr UNION SELECT u.a, min(r.m) FROM r JOIN u ON u.b = r.id JOIN recurring.r q ON q.id = u.a WHERE r.m < q.m GROUP BY u.a) SELECT * FROM r),
cs AS (SELECT m AS component, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, m) AS rank FROM co GROUP BY m)"""


@R.query("k5_components", _COMP + "SELECT id, component, n, rank FROM co JOIN cs ON co.m = cs.component")
def k5(t: Tables) -> DataFrame:
    _, kept, ref = _rare(t)
    return K.components(ref.where("valid").select(F.col("feature").alias("id")), K.compatibility_graph(kept))


_SIG = _COMP + ", sm AS (SELECT id AS feature, m AS signature FROM co)"


def _signed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, kept, ref = _rare(t)
    c = K.components(ref.where("valid").select(F.col("feature").alias("id")), K.compatibility_graph(kept))
    return kept, c.select(F.col("id").alias("feature"), F.col("component").alias("signature")), ref


@R.query("k6_signatures", _SIG + "SELECT signature, count(DISTINCT feature) AS n_features, count(DISTINCT assay) AS n_loci, count(DISTINCT cell_key) AS n_cells, CASE WHEN count(DISTINCT feature) > 100 THEN 'filtered' WHEN count(DISTINCT assay) >= 2 THEN 'A' WHEN count(DISTINCT feature) > 1 THEN 'B' ELSE 'C' END AS clone_class FROM ev JOIN sm USING (feature) GROUP BY signature")
def k6(t: Tables) -> DataFrame:
    e, m, _ = _signed(t)
    return K.signatures(e, m)


_SCORE = _SIG + ", sz AS (SELECT signature, count(*) AS size FROM sm GROUP BY ALL), sc AS (SELECT cell_key, signature, sum(rarity * ln(1 + n)) + 0.75 * count(DISTINCT assay) + count(DISTINCT feature) / any_value(size) AS score FROM ev JOIN sm USING (feature) JOIN ref USING (feature) JOIN sz USING (signature) GROUP BY ALL)".replace("sum(rarity * ln(1 + n))", "sum(rarity * ln(1 + ev.n))")


@R.query("k7_candidate_scores", _SCORE + "SELECT cell_key, signature, round(score, 6) AS score FROM sc")
def k7(t: Tables) -> DataFrame:
    e, m, ref = _signed(t)
    return V.rounded(K.candidate_scores(e, m, ref))


@R.query("k10_decided", _SCORE + """, k AS (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY score DESC, signature) AS r FROM sc QUALIFY r <= 5), b AS (SELECT cell_key, max(signature) FILTER (r = 1) AS best, max(score) AS score, max(score) FILTER (r = 2) AS second, count(*) AS n_candidates FROM k GROUP BY ALL)
SELECT cell_key, best, round(score, 6) AS score, round(second, 6) AS second, round(score - coalesce(second, 0), 6) AS margin, n_candidates, CASE WHEN score < 4 THEN 'unassigned' WHEN second >= 4 AND second >= 0.75 * score THEN 'assigned_multi' WHEN score - coalesce(second, 0) < 1 THEN 'ambiguous' ELSE 'assigned_single' END AS status FROM b""")
def k10(t: Tables) -> DataFrame:
    e, m, ref = _signed(t)
    return V.rounded(K.decided(K.candidate_scores(e, m, ref), 4.0, 1.0))


@R.query("k12_sensitivity", _REF + ", g AS (SELECT * FROM (VALUES (0.001), (0.005), (0.02)) a(max_fraction), (VALUES (1), (2), (4)) b(min_cells)) SELECT max_fraction::DOUBLE AS max_fraction, min_cells, count(*) FILTER (fraction <= max_fraction AND n_cells >= min_cells) AS n_valid, count(*) FILTER (NOT (fraction <= max_fraction AND n_cells >= min_cells)) AS n_filtered FROM ref, g GROUP BY ALL")
def k12(t: Tables) -> DataFrame:
    return K.sensitivity(K.feature_reference(_features(t)), [0.001, 0.005, 0.02], [1, 2, 4])


@R.query("k15_memberships", _SCORE + ", s AS (SELECT avg(score) AS m, stddev_pop(score) AS d FROM sc), w AS (SELECT cell_key, signature, score, score / sum(score) OVER (PARTITION BY cell_key) AS weight, count(*) OVER (PARTITION BY cell_key) AS n, row_number() OVER (PARTITION BY cell_key ORDER BY score DESC, signature) = 1 AS pr FROM sc) SELECT cell_key, signature, round(weight, 6) AS weight, round((score - m) / d, 6) AS z, pr AS \"primary\", n > 1 AND max(weight) OVER (PARTITION BY cell_key) < 0.75 AS ambiguous FROM w, s")
def k15(t: Tables) -> DataFrame:
    e, m, ref = _signed(t)
    return V.rounded(K.memberships(K.candidate_scores(e, m, ref)))


@R.query("k1_allele_metadata", _EV + ", d AS (SELECT DISTINCT feature_id, assay AS a FROM evidence), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY a) AS r FROM d) SELECT feature_id, string_agg(a, ';' ORDER BY a) FILTER (r <= 3) AS alleles, count(a) AS n_alleles, bool_and(a IS NULL) AS all_missing FROM r GROUP BY ALL")
def k1(t: Tables) -> DataFrame:
    return K.allele_metadata(V.evidence(t), "feature_id", "assay")


@R.query("k19_tile_composition", _TILES + ", " + V.ASSIGNED.strip() + """, m AS (SELECT group_id AS unit, cell_key, clone_id FROM mem LEFT JOIN assigned USING (cell_key)), n AS (SELECT unit, count(*) AS n_cells, count(clone_id) AS n_assigned FROM m GROUP BY ALL), c AS (SELECT unit, clone_id, count(*) AS n FROM m WHERE clone_id IS NOT NULL GROUP BY ALL),
d AS (SELECT unit, count(*) AS richness, arg_min(clone_id, (-n, clone_id)) AS dominant, max(n) / sum(n) AS ds, CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0 END AS h, CASE WHEN count(*) > 1 THEN 1 - sum(n * n) / sum(n)**2 ELSE 0 END AS s FROM c GROUP BY unit)
SELECT unit, n_cells, n_assigned, coalesce(richness, 0) AS richness, dominant, round(coalesce(ds, 0), 6) AS dominant_share, round(coalesce(h, 0), 6) AS entropy, round(coalesce(s, 0), 6) AS simpson, round(n_assigned / n_cells, 6) AS coverage FROM n LEFT JOIN d USING (unit)""")
def k19(t: Tables) -> DataFrame:
    u = _tile_members(t).withColumnRenamed("group_id", "unit")
    return V.rounded(K.unit_composition(u, V.assigned(t)).drop("norm_entropy", "distribution"))


_JOINT = _AS + ", ja AS (SELECT *, list_filter(string_split(joint_clone_id, '@'), lambda a: lower(trim(a)) NOT IN ('', 'nan', 'none', 'null', 'na')) AS al FROM assigned), jj AS (SELECT * FROM ja WHERE len(al) > 0)"


@R.query("f11_joint_alleles", _JOINT + "SELECT cell_key, al AS alleles, len(al) AS n_alleles FROM jj")
def f11(t: Tables) -> DataFrame:
    a = S.joint_alleles("joint_clone_id")
    return V.assigned(t).where(F.size(a) > 0).select("cell_key", a.alias("alleles"), F.size(a).cast("long").alias("n_alleles"))


@R.query("j3_allele_frequencies", _JOINT + ", n AS (SELECT count(*) AS n FROM jj) SELECT allele, nullif(regexp_extract(allele, '^(CA|TA|RA)_', 1), '') AS locus, count(*) AS n_cells, round(count(*) / any_value(n), 8) AS fraction FROM (SELECT unnest(al) AS allele FROM jj), n GROUP BY allele")
def j3(t: Tables) -> DataFrame:
    return V.rounded(K.allele_frequencies(V.assigned(t)), 8)


@R.query("j6_joint_ids", _JOINT + ", x AS (SELECT cell_key, a, nullif(regexp_extract(a, '^(CA|TA|RA)_', 1), '') AS l FROM (SELECT cell_key, unnest(al) AS a FROM jj)) SELECT cell_key, coalesce(max(a) FILTER (l = 'CA'), 'nan') || '@' || coalesce(max(a) FILTER (l = 'RA'), 'nan') || '@' || coalesce(max(a) FILTER (l = 'TA'), 'nan') AS joint_id FROM x WHERE l IS NOT NULL GROUP BY ALL")
def j6(t: Tables) -> DataFrame:
    a = V.assigned(t).select("cell_key", F.explode(S.joint_alleles("joint_clone_id")).alias("allele")).withColumn("n", F.lit(1))
    return K.joint_ids(K.one_allele_per_locus(a))


@R.query("j6_merged_ids", _JOINT + """, ids AS (SELECT DISTINCT joint_clone_id AS id, al FROM jj), x AS (SELECT id, al, unnest(al) AS allele FROM ids), fw AS (SELECT allele FROM x GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5),
e AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM x a JOIN fw USING (allele) JOIN x b ON a.allele = b.allele AND a.id < b.id WHERE len(list_filter(a.al, lambda u: len(list_filter(b.al, lambda v: split_part(u, '_', 1) = split_part(v, '_', 1) AND u <> v)) > 0)) = 0),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), co AS (WITH RECURSIVE r(id, m) USING KEY (id) AS (SELECT id, id FROM ids UNION SELECT u.a, min(r.m) FROM r JOIN u ON u.b = r.id JOIN recurring.r q ON q.id = u.a WHERE r.m < q.m GROUP BY u.a) SELECT * FROM r) SELECT id AS joint_id, m AS component FROM co""")
def j6m(t: Tables) -> DataFrame:
    a = V.assigned(t)
    return K.merged_joint_ids(a)


@R.query("j9_clone_qc", _JOINT + """, p AS (SELECT joint_clone_id, slice_id, count(*) AS n, sum(joint_prob) AS sp, count(joint_prob) AS np FROM jj GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p),
c AS (SELECT joint_clone_id, CAST(sum(n) AS BIGINT) AS n_cells, sum(n) / any_value(t) AS cs, count(*) AS n_sections, max(n) / sum(n) AS ss, len(list_distinct(list_transform(list_filter(string_split(joint_clone_id, '@'), lambda a: lower(trim(a)) NOT IN ('', 'nan', 'none', 'null', 'na')), lambda a: split_part(a, '_', 1)))) AS n_loci, sum(sp) / nullif(sum(np), 0) AS mp FROM p, t GROUP BY joint_clone_id),
f AS (SELECT *, concat_ws(';', CASE WHEN cs >= 0.05 THEN 'giant_clone' END, CASE WHEN ss >= 0.95 AND n_cells >= 100 THEN 'single_section' END, CASE WHEN n_loci = 1 THEN 'single_locus' END) AS flags FROM c)
SELECT joint_clone_id, n_cells, round(cs, 8) AS clone_share, n_sections, round(ss, 8) AS section_share, CAST(n_loci AS INTEGER) AS n_loci, round(mp, 8) AS mean_prob, flags, CASE WHEN contains(flags, 'giant_clone') THEN 'filtered' WHEN flags <> '' THEN 'warning' ELSE 'pass' END AS status FROM f""")
def j9(t: Tables) -> DataFrame:
    return V.rounded(K.clone_qc(V.assigned(t)), 8)


@R.query("j12_layers", _AS + "SELECT 'clone' AS layer, count(*) AS n_cells, count(clone_id) AS n_assigned, round(count(clone_id) / count(*), 6) AS fraction FROM assigned UNION ALL SELECT 'joint', count(*), count(nullif(joint_clone_id, '')), round(count(nullif(joint_clone_id, '')) / count(*), 6) FROM assigned")
def j12(t: Tables) -> DataFrame:
    a = V.assigned(t)
    return V.rounded(K.layers({"clone": a.select("cell_key", F.col("clone_id").alias("clone")), "joint": a.select("cell_key", F.nullif("joint_clone_id", F.lit("")).alias("clone"))}))


@R.query("k13_loss_audit", _AS + ", m AS (SELECT upper(trim(cell_key)) AS cell_key, max(membership_status) AS s FROM clone_cellbin_membership WHERE cell_key IS NOT NULL GROUP BY ALL) SELECT coalesce(clone_status, 'none') AS status_a, coalesce(s, 'none') AS status_b, count(*) AS n FROM assigned FULL JOIN m USING (cell_key) GROUP BY ALL")
def k13(t: Tables) -> DataFrame:
    m = t.clone_cellbin_membership.where("cell_key IS NOT NULL").groupBy(F.upper(F.trim("cell_key")).alias("cell_key")).agg(F.max("membership_status").alias("status"))
    return K.loss_audit(V.assigned(t).select("cell_key", F.col("clone_status").alias("status")), m)


# --- potentials ------------------------------------------------------------------------------------------------------

_PHI = _EV + ", c AS (SELECT cell_key, sum(n)::DOUBLE AS total, count(*)::DOUBLE AS feats, max(n) / sum(n) AS dom FROM evidence GROUP BY ALL), s AS (SELECT avg(total) AS mt, stddev_pop(total) AS st, avg(feats) AS mf, stddev_pop(feats) AS sf, avg(dom) AS md, stddev_pop(dom) AS sd, regr_slope(dom, feats) AS b, regr_intercept(dom, feats) AS a FROM c)"


def _units(t: Tables) -> DataFrame:
    return V.evidence(t).groupBy("cell_key").agg(F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("feats"), (F.max("n") / F.sum("n")).alias("dom"))


@R.query("n1_potential", _PHI + ", p AS (SELECT cell_key, 0.35 * (dom - md) / sd + 0.25 * (feats - mf) / sf - 0.2 * (total - mt) / st AS phi FROM c, s) SELECT cell_key, round(phi, 6) AS phi, dense_rank() OVER (ORDER BY round(phi, 9) DESC) AS rank FROM p")
def n1(t: Tables) -> DataFrame:
    return V.rounded(N.combined_z(_units(t), {"dom": 0.35, "feats": 0.25, "total": -0.2}).select("cell_key", "phi", "rank"))


@R.query("n2_residual", _PHI + ", r AS (SELECT cell_key, dom - b * feats - a AS r FROM c, s), q AS (SELECT avg(r) AS m, stddev_pop(r) AS d FROM r) SELECT cell_key, round((r - m) / d, 6) AS residual FROM r, q")
def n2(t: Tables) -> DataFrame:
    return V.rounded(N.residual(_units(t), "dom", "feats").select("cell_key", "residual"))


@R.query("n3_correlation", _EV + ", c AS (SELECT slice_id, cell_key, sum(n)::DOUBLE AS total, count(*)::DOUBLE AS feats FROM evidence GROUP BY ALL) SELECT slice_id, round(CASE WHEN count(*) >= 3 THEN coalesce(corr(total, feats), 0) ELSE 0 END, 6) AS r FROM c GROUP BY slice_id")
def n3(t: Tables) -> DataFrame:
    c = V.evidence(t).groupBy("slice_id", "cell_key").agg(F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("feats"))
    return V.rounded(c.groupBy("slice_id").agg(N.correlation("total", "feats").alias("r")))


@R.query("n4_same_label_mass", "WITH " + V.ANCHORS + "," + V.EDGES + "SELECT round(sum(p), 6) AS mass, round(coalesce(sum(p) FILTER (a.l1 = b.l1), 0) / sum(p), 6) AS same_share FROM edges JOIN anchors a ON src = a.anchor_id JOIN anchors b ON dst = b.anchor_id")
def n4(t: Tables) -> DataFrame:
    return V.rounded(N.same_label_mass(V.edges(t), V.anchors(t).select(F.col("anchor_id").alias("id"), "l1"), "l1"))


@R.query("n4_between_variance", "WITH " + V.ANCHORS + ", g AS (SELECT slice_id, count(*) AS n, avg(x) AS m, sum(x * x) AS q FROM anchors WHERE isfinite(x) GROUP BY ALL), t AS (SELECT sum(n) AS N, sum(n * m) AS S, sum(n * m * m) AS B, sum(q) AS Q FROM g) SELECT CAST(N AS BIGINT) AS n, round((B / N - (S / N)**2) / (Q / N - (S / N)**2), 6) AS eta2 FROM t")
def n4v(t: Tables) -> DataFrame:
    return V.rounded(N.between_variance(V.anchors(t).where("x IS NOT NULL AND NOT isnan(x)"), "slice_id", "x"))


@R.query("n7_enriched_state", "WITH " + V.ANCHORS + ", c AS (SELECT time, l1, count(*) AS n, count(*) FILTER (mouse_id = 'M00000') AS t FROM anchors WHERE l1 IS NOT NULL GROUP BY ALL), s AS (SELECT *, coalesce(t / nullif(sum(t) OVER (PARTITION BY time), 0), 0) AS share, t / n AS purity FROM c) SELECT time, l1, round(share, 6) AS share, round(purity, 6) AS purity FROM s QUALIFY row_number() OVER (PARTITION BY time ORDER BY share DESC, purity DESC, l1) = 1")
def n7(t: Tables) -> DataFrame:
    a = V.anchors(t).where("l1 IS NOT NULL").withColumn("target", F.coalesce(F.col("mouse_id") == "M00000", F.lit(False)))
    return V.rounded(N.enriched_state(a, "time", "l1", "target"))
