"""Queries of operators that the other queries use only inside a chain, one each, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions import scalars as S
from cellweft.functions.keys import key
from cellweft.operators import clones as K
from cellweft.operators import coarsen as CO
from cellweft.operators import compare as B
from cellweft.operators import contracts as C
from cellweft.operators import diversity as D
from cellweft.operators import fate as FT
from cellweft.operators import gates, lineage, potential, scaling
from cellweft.operators import markov as M
from cellweft.operators import spatial as G
from cellweft.operators import transitions as T
from cellweft.plans import views as V
from cellweft.plans.lineage import _FE, _JOINT, _SCORE, _features, _signed
from cellweft.plans.registry import Registry, Tables
from cellweft.plans.spatial import _MEM, _NEAR, _POINTS, _RADIUS, _pts
from cellweft.plans.transitions import _DAYED, _FATE, _FLAG, _METRICS, _N, _VEC, _dayed, _fate, _flagged, _nodes, _vectors
from cellweft.session import shared_path
from cellweft.sources import tables as IO

R = Registry()
_A, _E, _AE = "WITH " + V.ANCHORS, "WITH " + V.EDGES, "WITH " + V.ANCHORS + "," + V.EDGES
_EV, _AS, _CE = "WITH " + V.EVIDENCE, "WITH " + V.ASSIGNED, "WITH " + V.CELLS
_LOCI = ("CA", "RA", "TA")


# --- sources and sinks: written to the shared folder and read back -----------------------------------------------------

@R.query("s2_partitioned_export", _A + "SELECT time_day, anchor_id, slice_id FROM anchors WHERE time_day IS NOT NULL")
def s2(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "export")
    IO.write(V.anchors(t).where("time_day IS NOT NULL").select("time_day", "anchor_id", "slice_id"), path, by=["time_day"])
    return t.spark.read.parquet(path).select("time_day", "anchor_id", "slice_id")


@R.query("s5_feature_sink", _A + "SELECT anchor_id, anchor_index, x, y FROM anchors")
def s5(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "features")
    IO.write(V.anchors(t).select("anchor_id", "anchor_index", "x", "y"), path)
    return t.spark.read.parquet(path)


@R.query("s5_feature_sink_csv", _A + "SELECT anchor_id, anchor_index, x, y FROM anchors")
def s5_csv(t: Tables) -> DataFrame:
    path, d = shared_path(t.spark, "features"), V.anchors(t).select("anchor_id", "anchor_index", "x", "y")
    IO.write(d, path, "csv")
    return t.spark.read.schema(d.schema).option("header", True).csv(path)


@R.query("s6_ragged_index", _NEAR + ", m AS (SELECT src AS anchor, dst AS member FROM e UNION SELECT id, id FROM pts) SELECT anchor, count(*) AS n, string_agg(member, ',' ORDER BY member) AS members FROM m GROUP BY anchor")
def s6(t: Tables) -> DataFrame:
    p = _pts(t)
    path = shared_path(t.spark, "lists")
    IO.write(G.neighbour_arrays(G.with_self(p, G.within_radius(p, _RADIUS))), path)
    return t.spark.read.parquet(path).select("anchor", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


@R.query("s7_tsv", _EV + "SELECT sample_id, slice_id, assay, feature_id, cell_key, n FROM evidence")
def s7(t: Tables) -> DataFrame:
    path, d = shared_path(t.spark, "tsv"), V.evidence(t)
    IO.write(d, path, "tsv")
    return IO.read_tsv(t.spark, path, d.schema, ["cell_key", "feature_id"])


@R.query("s8_json", _AS + "SELECT cell_key, clone_id, clone_status, n_supporting_features, joint_prob FROM assigned")
def s8(t: Tables) -> DataFrame:
    path, d = shared_path(t.spark, "json"), V.assigned(t).select("cell_key", "clone_id", "clone_status", "n_supporting_features", "joint_prob")
    IO.write(d, path, "json")
    return t.spark.read.schema(d.schema).json(path)


@R.query("s11_node_features", _A + "SELECT slice_id, anchor_index, x, y, row_number() OVER (ORDER BY slice_id, anchor_index) - 1 AS node_index FROM anchors WHERE slice_id IS NOT NULL AND anchor_index IS NOT NULL")
def s11(t: Tables) -> DataFrame:
    a = V.anchors(t).where("slice_id IS NOT NULL AND anchor_index IS NOT NULL")
    return IO.with_node_index(a, M.dense_index(a.select("slice_id", "anchor_index"), ["slice_id", "anchor_index"]), ["x", "y"])


@R.query("s13_manifest", "SELECT 'item_' || item_id AS name, strlen(text) + 1 AS length, sha256(text || chr(10)) AS sha256 FROM eval_items WHERE text IS NOT NULL")
def s13(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "packet")
    t.eval_items.where("text IS NOT NULL").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("value")).write.partitionBy("name").text(path)
    found = IO.checksums(t.spark, path)
    return found.where("length > 0").select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "length", "sha256")


@R.query("s15_union_bank", _JOINT + """, x AS (SELECT cell_key, unnest(al) AS allele FROM jj), f AS (SELECT allele, count(*) AS n FROM x GROUP BY ALL), tot AS (SELECT count(*) AS t FROM jj),
q AS (SELECT unnest(list_filter(string_split(trim(joint_clone_id), '@'), lambda a: lower(trim(a)) NOT IN ('', 'nan', 'none', 'null', 'na'))) AS allele FROM joint_clone_qc), g AS (SELECT allele, count(*) AS n FROM q GROUP BY ALL),
b AS (SELECT 'calls' AS bank, allele, n::DOUBLE AS sample_count, n / t AS normalized_count, n = 1 AS invalid FROM f, tot UNION ALL SELECT 'qc', allele, 'inf'::DOUBLE, 1.0, n > 1 FROM g)
SELECT nullif(regexp_extract(trim(allele), '^(CA|TA|RA)_', 1), '') AS locus, allele, invalid, round(normalized_count, 9) AS normalized_count, sample_count, bank FROM b QUALIFY row_number() OVER (PARTITION BY allele ORDER BY invalid, normalized_count, sample_count, bank) = 1""")
def s15(t: Tables) -> DataFrame:
    f = K.allele_frequencies(V.assigned(t))
    calls = f.select("locus", "allele", F.col("n_cells").alias("sample_count"), F.col("fraction").alias("normalized_count"), (F.col("n_cells") == 1).alias("invalid"))
    q = t.joint_clone_qc.select(F.explode(S.joint_alleles("joint_clone_id")).alias("allele")).groupBy("allele").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    qc = q.select(S.locus("allele").alias("locus"), "allele", none.alias("sample_count"), none.alias("normalized_count"), (F.col("n") > 1).alias("invalid"))
    return V.rounded(IO.union_bank({"calls": calls, "qc": qc}), 9)


@R.query("s16_inventory", _A + "SELECT time_day AS day, CAST(count(*) AS BIGINT) AS n_rows FROM anchors WHERE time_day IS NOT NULL GROUP BY ALL")
def s16(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "inventory")
    IO.write(V.anchors(t).where("time_day IS NOT NULL").withColumn("part", F.concat(F.lit("M_D"), F.col("time_day").cast("string"), F.lit("_X"))).select("anchor_id", "part"), path, by=["part"])
    return IO.inventory(t.spark, path).groupBy("day").agg(F.sum("rows").alias("n_rows"))


# --- expressions -----------------------------------------------------------------------------------------------------

_DAYS = {"D0": 0, "D3": 3, "D9": 9, "D21": 21, "D35": 35}


@R.query("f1_standardised", _A + """SELECT anchor_id, CAST(regexp_extract("time", '^D(\\d+)$', 1) AS INTEGER) AS time_day, "time", mouse_id || '_rep' || anchor_index AS batch_id, coalesce(l2, 'NA') AS tier2 FROM anchors WHERE "time" IS NOT NULL""")
def f1(t: Tables) -> DataFrame:
    a = V.anchors(t).where("time IS NOT NULL").select("anchor_id", F.col("time").alias("sample_type"), "mouse_id", F.col("anchor_index").alias("repeat"), F.col("l2").alias("tier2"))
    return C.standardised(a, _DAYS).select("anchor_id", "time_day", "time", "batch_id", "tier2")


@R.query("f3_file_names", "SELECT DISTINCT doc_kind || ' / ' || source AS name, regexp_replace(doc_kind || ' / ' || source, '[^0-9A-Za-z._-]', '_', 'g') AS file_name FROM documents")
def f3(t: Tables) -> DataFrame:
    d = t.documents.select(F.concat("doc_kind", F.lit(" / "), "source").alias("name")).distinct()
    return d.select("name", S.file_name("name").alias("file_name"))


@R.query("f4_feature_parts", _FE + "SELECT DISTINCT feature, split_part(feature, '::', 1) AS assay, substr(feature, strpos(feature, '::') + 2) AS name FROM ev WHERE feature IS NOT NULL")
def f4(t: Tables) -> DataFrame:
    f = _features(t).select("feature").where("feature IS NOT NULL").distinct().withColumn("p", S.split_feature("feature"))
    return f.select("feature", "p.assay", F.col("p.feature").alias("name"))


@R.query("f5_anchor_ids", _A + "SELECT anchor_id, slice_id || '::' || anchor_index AS built FROM anchors")
def f5(t: Tables) -> DataFrame:
    return V.anchors(t).select("anchor_id", S.anchor_id("slice_id", "anchor_index").alias("built"))


@R.query("f6_ranges", "SELECT printf('pc%03d', n) AS name FROM range(1, 49) r(n)")
def f6(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in S.expand_range("pc001..pc048")], "name string")


@R.query("f7_selected_columns", "SELECT cell_type_l1, cell_type_l2, x, y FROM niche_anchors")
def f7(t: Tables) -> DataFrame:
    d = t.niche_anchors
    return d.select(*S.select_columns(d.columns, ["cell_type_*", "x", "y"], exclude=["l3"]))


@R.query("f8_column_groups", "SELECT column_name AS name, CASE WHEN column_name LIKE 'cell!_type!_%' ESCAPE '!' THEN 'label' WHEN column_name LIKE '%!_at' ESCAPE '!' THEN 'time' WHEN column_name LIKE '%!_id' ESCAPE '!' THEN 'identity' ELSE 'other' END AS kind FROM (DESCRIBE SELECT * FROM niche_anchors)")
def f8(t: Tables) -> DataFrame:
    g = S.column_groups(t.niche_anchors.columns, {"label": ["cell_type_*"], "time": ["*_at"], "identity": ["*_id"]})
    return t.spark.createDataFrame([(c, k) for k, cs in g.items() for c in cs], "name string, kind string")


_PARTS = """, d AS (SELECT DISTINCT joint_clone_id AS id FROM assigned WHERE joint_clone_id IS NOT NULL), p AS (SELECT id, trim(unnest(string_split(id, '@')), ' "''') AS a FROM d),
q AS (SELECT DISTINCT id, a, coalesce(try_cast(nullif(regexp_extract(a, '(\\d+)(?:_(\\d+))?', 1), '') AS INTEGER), 2147483647) AS s, coalesce(try_cast(nullif(regexp_extract(a, '(\\d+)(?:_(\\d+))?', 2), '') AS INTEGER), 2147483647) AS e FROM p WHERE lower(a) NOT IN ('', 'nan', 'none', 'null', 'na'))"""


@R.query("f9_alleles", _AS + _PARTS + "SELECT d.id, coalesce(string_agg(a, ',' ORDER BY s, e, a), '') AS alleles FROM d LEFT JOIN q USING (id) GROUP BY d.id")
def f9(t: Tables) -> DataFrame:
    d = V.assigned(t).where("joint_clone_id IS NOT NULL").select(F.col("joint_clone_id").alias("id")).distinct()
    return d.select("id", F.array_join(S.alleles(F.translate("id", "@", ",")), ",").alias("alleles"))


@R.query("f10_loci", _JOINT + ", x AS (SELECT DISTINCT unnest(al) AS allele FROM jj) SELECT allele, nullif(regexp_extract(trim(allele), '^(CA|TA|RA)_', 1), '') AS locus, regexp_matches(allele, '^(CA|TA|RA)_\\d+_\\d+') AS well_formed FROM x")
def f10(t: Tables) -> DataFrame:
    a = V.assigned(t).select(F.explode(S.joint_alleles("joint_clone_id")).alias("allele")).distinct()
    return a.select("allele", S.locus("allele").alias("locus"), S.well_formed_alleles("allele").alias("well_formed"))


_COUNTS = _A + ", c AS (SELECT slice_id, l1, count(*)::DOUBLE AS n FROM anchors WHERE l1 IS NOT NULL GROUP BY ALL)"


@R.query("f13_simpson", _COUNTS + "SELECT slice_id, round(CASE WHEN count(*) > 1 THEN 1 - sum(n * n) / sum(n)**2 ELSE 0 END, 9) AS simpson FROM c GROUP BY slice_id")
def f13(t: Tables) -> DataFrame:
    # A list of label counts, as many as there are labels.
    c = D.label_counts(V.anchors(t), ["slice_id"], "l1").groupBy("slice_id").agg(F.collect_list("n").alias("ns"))
    return c.select("slice_id", F.round(S.simpson("ns"), 9).alias("simpson"))


@R.query("f15_guarded_division", "SELECT row_id, coalesce(CAST(n_supporting_features AS DOUBLE) / nullif(CASE WHEN isfinite(total_clone_evidence_count) THEN total_clone_evidence_count END, 0), 0) AS share FROM cellbin_clone_assignment")
def f15(t: Tables) -> DataFrame:
    return t.cellbin_clone_assignment.select("row_id", S.ratio(F.col("n_supporting_features").cast("double"), S.finite("total_clone_evidence_count")).alias("share"))


@R.query("f17_phrases", "SELECT doc_id, array_to_string(list_filter(['kernel', 'clone', 'the slice'], lambda p: contains(lower(text), p)), ';') AS hits FROM documents WHERE text IS NOT NULL")
def f17(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(S.phrases_in("text", ["kernel", "clone", "the slice"]), ";").alias("hits"))


@R.query("f19_vector_distances", _A + _VEC + "SELECT id, round(list_sum(list_transform(range(1, 49), lambda i: abs(vec[i] - vec[49 - i]))), 5) AS l1, round(list_distance(vec, list_reverse(vec)), 5) AS l2 FROM u")
def f19(t: Tables) -> DataFrame:
    v = _vectors(t)
    return v.select("id", F.round(S.l1("vec", F.reverse("vec")), 5).alias("l1"), F.round(S.l2("vec", F.reverse("vec")), 5).alias("l2"))


@R.query("f20_label_vectors", _A + _VEC + """, w AS (SELECT id, vec, list_transform(vec, lambda x: abs(x)) AS a FROM u WHERE list_sum(list_transform(vec, lambda x: abs(x))) > 0), s AS (SELECT id, vec, list_transform(a, lambda x: x / list_sum(a)) AS p FROM w)
SELECT id, round(list_dot_product(vec, list_reverse(vec)) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(vec, vec))), 5) AS cosine,
  round(list_sum(list_transform(range(1, 49), lambda i: CASE WHEN p[i] > 0 THEN p[i] * ln(p[i] / ((p[i] + p[49 - i]) / 2)) ELSE 0 END)), 5) AS js FROM s""")
def f20(t: Tables) -> DataFrame:
    v = _vectors(t).withColumn("a", F.transform("vec", lambda x: F.abs(x))).withColumn("s", F.aggregate("a", F.lit(0.0), lambda s, x: s + x)).where("s > 0")
    v = v.withColumn("p", F.transform("a", lambda x: x / F.col("s")))
    return v.select("id", F.round(S.cosine("vec", F.reverse("vec")), 5).alias("cosine"), F.round(S.jensen_shannon("p", F.reverse("p")), 5).alias("js"))


@R.query("f21_softmax", _E + "SELECT src, dst, round(exp(-(1 - p)) / sum(exp(-(1 - p))) OVER (PARTITION BY src), 9) AS prob FROM edges")
def f21(t: Tables) -> DataFrame:
    return V.rounded(T.softmax(V.edges(t).select("src", "dst", (1 - F.col("p")).alias("d")), "d").select("src", "dst", "prob"), 9)


# --- space -----------------------------------------------------------------------------------------------------------

@R.query("g1_located", _POINTS + "SELECT g AS \"group\", id, x, y FROM pts")
def g1(t: Tables) -> DataFrame:
    return G.located(V.anchors(t), "slice_id", "anchor_id")


_ENT1 = ", c AS (SELECT m.anchor, p.l1, count(*) AS n FROM m JOIN pts p ON m.g = p.g AND m.member = p.id WHERE p.l1 IS NOT NULL GROUP BY ALL)"


@R.query("g13_composition_entropy", _MEM + _ENT1 + "SELECT anchor, round(CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0 END, 6) AS l1_entropy FROM c GROUP BY anchor")
def g13(t: Tables) -> DataFrame:
    p = _pts(t)
    f = G.neighbour_features(p, G.with_self(p, G.within_radius(p, _RADIUS)), ["l1"]).where("l1_entropy IS NOT NULL")
    return V.rounded(f.select("anchor", "l1_entropy"))


@R.query("g15_spatial_summary", _MEM + ", b AS (SELECT anchor, count(*) AS n_neighbors, coalesce(avg(d) FILTER (anchor <> member), 0) AS md FROM m GROUP BY anchor) SELECT anchor, n_neighbors, round(md, 6) AS mean_distance, round(n_neighbors / greatest(md, 1), 6) AS density_per_unit FROM b")
def g15(t: Tables) -> DataFrame:
    p = _pts(t)
    f = G.neighbour_features(p, G.with_self(p, G.within_radius(p, _RADIUS)), [])
    # The pseudo density divides by at least 1e-12; a whole unit keeps lone anchors readable here.
    return V.rounded(f.select("anchor", "n_neighbors", "mean_distance", F.least("pseudo_density", F.col("n_neighbors") / F.greatest("mean_distance", F.lit(1.0))).alias("density_per_unit")))


_GENES = _FE + ", tot AS (SELECT cell_key, sum(n) AS t FROM ev GROUP BY ALL), val AS (SELECT cell_key, feature, ln(1 + 10000 * ev.n / t) AS value FROM ev JOIN tot USING (cell_key))"


@R.query("g20_log_cpm", _GENES + "SELECT cell_key, feature, round(value, 9) AS value FROM val")
def g20(t: Tables) -> DataFrame:
    return scaling.log_cpm(_features(t).groupBy("cell_key", "feature").agg(F.sum("n").alias("n")), "cell_key", "feature", "n").select("cell_key", "feature", F.round("value", 9).alias("value"))


@R.query("g20_variable_features", _GENES + ", nc AS (SELECT count(DISTINCT cell_key) AS k FROM ev), s AS (SELECT feature, round(sum(value * value) / any_value(k) - (sum(value) / any_value(k))**2, 12) AS variance FROM val, nc GROUP BY feature) SELECT feature, round(variance, 9) AS variance FROM s ORDER BY s.variance DESC, feature LIMIT 50")
def g20v(t: Tables) -> DataFrame:
    e = _features(t).groupBy("cell_key", "feature").agg(F.sum("n").alias("n"))
    v = scaling.log_cpm(e, "cell_key", "feature", "n")
    return V.rounded(scaling.variable_genes(v, e, "cell_key", "feature", "value", 50), 9)


# --- representation --------------------------------------------------------------------------------------------------

_LONG = _A + ", lg AS (SELECT anchor_id, unnest(['radius_x2', 'radius_x4', 'radius_x8']) AS scale, x FROM anchors)"


def _scaled(t: Tables) -> DataFrame:
    return V.anchors(t).select("anchor_id", F.explode(F.array(F.lit("radius_x2"), F.lit("radius_x4"), F.lit("radius_x8"))).alias("scale"), "x")


@R.query("r1_complete_scales", _LONG + "SELECT * FROM lg")
def r1(t: Tables) -> DataFrame:
    return gates.complete_scales(_scaled(t), ["anchor_id"], "scale", ["radius_x2", "radius_x4", "radius_x8"])


@R.query("r3_validated", _POINTS + "SELECT id, x, y FROM pts")
def r3(t: Tables) -> DataFrame:
    p = G.located(V.anchors(t), "slice_id", "anchor_id").select("id", "x", "y")
    return C.validated_output(p, p.schema, None, ["x", "y"])


@R.query("r4_balanced_blocks", _POINTS + ", d AS (SELECT id, x, y, CAST(length(id) AS DOUBLE) AS w FROM pts), s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(w) AS mw, stddev_pop(w) AS sw FROM d) SELECT id, round((x - mx) / sx / sqrt(2), 6) AS x, round((y - my) / sy / sqrt(2), 6) AS y, round(CASE WHEN sw < 1e-6 THEN 0 ELSE (w - mw) / sw END, 6) AS w FROM d, s")
def r4(t: Tables) -> DataFrame:
    p = G.located(V.anchors(t), "slice_id", "anchor_id").select("id", "x", "y", F.length("id").cast("double").alias("w"))
    return V.rounded(scaling.balanced_blocks(p, {"place": ["x", "y"], "name": ["w"]}))


# --- transitions -----------------------------------------------------------------------------------------------------

_C2 = "0.7 * (1 - p) + 0.3 * coalesce(CASE WHEN isfinite(p1) THEN 1 - p1 END, 0)"


@R.query("t5_combined_cost", _E + f"SELECT src, dst, round({_C2}, 9) AS cost FROM edges")
def t5(t: Tables) -> DataFrame:
    e = V.edges(t).withColumns({"a": 1 - F.col("p"), "b": 1 - F.col("p1")})
    return V.rounded(e.select("src", "dst", T.combined_cost({"a": 0.7, "b": 0.3}).alias("cost")), 9)


@R.query("t6_temperatures", _E + f"SELECT source_time, target_time, round(greatest(median({_C2}), 1e-3), 9) AS tau FROM edges GROUP BY ALL")
def t6(t: Tables) -> DataFrame:
    e = V.edges(t).withColumns({"a": 1 - F.col("p"), "b": 1 - F.col("p1")}).withColumn("cost", T.combined_cost({"a": 0.7, "b": 0.3}))
    return V.rounded(T.temperatures(e, "cost", ["source_time", "target_time"]), 9)


@R.query("t13_resumed", _E + ", s AS (SELECT src, count(*) AS n FROM edges GROUP BY ALL) SELECT src, n FROM s")
def t13(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "shard")
    for _ in range(2):  # made, then found
        out = C.resumed(t.spark, path, lambda: V.edges(t).groupBy("src").agg(F.count("*").alias("n")), lambda d: d.columns == ["src", "n"])
    return out


@R.query("v2_soft_gate", _E + "SELECT src, dst, round(0.4 + 0.6 * exp(-(1 - p) / 0.25), 9) AS gate FROM edges")
def v2(t: Tables) -> DataFrame:
    return V.edges(t).select("src", "dst", F.round(T.soft_gate(1 - F.col("p"), F.lit(0.25), 0.6), 9).alias("gate"))


@R.query("v4_component_weights", _E + "SELECT src, dst, round(exp(-(1 - p) / 0.5), 9) AS g_state, round(pow(0.4 + 0.6 * exp(-p), 2), 9) AS g_comp, round(pow(p, 0.5), 9) AS g_spatial, 1.0::DOUBLE AS g_slice_mouse FROM edges")
def v4(t: Tables) -> DataFrame:
    e = V.edges(t).withColumns({"d": 1 - F.col("p"), "tau": F.lit(0.5)})
    g = C.component_weights(e, "d", "tau", T.soft_gate(F.col("p"), F.lit(1.0), 0.6), F.col("p"), F.lit(1.0), (2.0, 0.5, 1.0))
    return V.rounded(g.select("src", "dst", "g_state", "g_comp", "g_spatial", "g_slice_mouse"), 9)


@R.query("v7_probability_validation", _E + ", s AS (SELECT src, sum(p) AS s, sum(-p * ln(p)) AS h, max(p) AS m FROM edges GROUP BY ALL) SELECT count(*) AS n_sources, round(min(s), 6) AS min_sum, round(max(s), 6) AS max_sum, round(avg(s), 6) AS mean_sum, round(avg(h), 6) AS mean_entropy, round(avg(m), 6) AS mean_top1, round(quantile_cont(m, 0.95), 6) AS p95_top1 FROM s")
def v7(t: Tables) -> DataFrame:
    return V.rounded(T.probability_diagnostics(V.edges(t)).drop("mean_effective"))


@R.query("v8_entropy_top1", _E + "SELECT src, round(sum(-p * ln(p)), 6) AS entropy, max(p) AS top1 FROM edges GROUP BY src")
def v8(t: Tables) -> DataFrame:
    return T.source_summary(V.edges(t)).select("src", F.round("entropy", 6).alias("entropy"), "top1")


@R.query("v9_plan_totals", _E + "SELECT source_slice_id, count(DISTINCT src) AS n_sources, count(*) AS n_edges FROM edges GROUP BY ALL")
def v9(t: Tables) -> DataFrame:
    return C.shard_report(V.edges(t), ["source_slice_id"]).select("source_slice_id", "n_sources", "n_edges")


@R.query("m13_eigenvalues", _DAYED + """, h AS (SELECT CASE WHEN source_day > 0 THEN 'late' ELSE 'first' END AS a, CASE WHEN target_day > 0 THEN 'late' ELSE 'first' END AS b, sum(p) AS w FROM de GROUP BY ALL), q AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM h),
d AS (SELECT coalesce(max(p) FILTER (a = 'first' AND b = 'first'), CASE WHEN count(*) FILTER (a = 'first') = 0 THEN 1 ELSE 0 END) AS x, coalesce(max(p) FILTER (a = 'late' AND b = 'late'), CASE WHEN count(*) FILTER (a = 'late') = 0 THEN 1 ELSE 0 END) AS y FROM q)
SELECT 1.0::DOUBLE AS largest, round(abs(x + y - 1), 6) AS second, round(1 - abs(x + y - 1), 6) AS gap FROM d""")
def m13(t: Tables) -> DataFrame:
    from cellweft.operators.graph import eigenvalue_gap

    late = lambda c: F.when(F.col(c) > 0, "late").otherwise("first")
    halves = _nodes(t).select("id", late("day").alias("group"))
    e = M.coarse(_dayed(t).select("src", "dst", "p"), halves)
    _, p = CO.coarse_matrix(e)
    g = eigenvalue_gap(p)
    top = [*g["top"], 0.0][:2]
    return V.rounded(t.spark.createDataFrame([(float(top[0]), float(top[1]), float(g["gap"]))], "largest double, second double, gap double"))


@R.query("m14_edge_table", _AE + _N + "SELECT e.src, e.dst, e.p, a.slice_id AS source_slice_id, a.\"time\" AS source_time, b.slice_id AS target_slice_id, b.\"time\" AS target_time FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id")
def m14(t: Tables) -> DataFrame:
    return C.with_identity(V.edges(t).select("src", "dst", "p"), _nodes(t), ["slice_id", "time"])


# --- fate ------------------------------------------------------------------------------------------------------------

@R.query("fate1_final_nodes", _AE + _N + "SELECT id, day, slice_id FROM nodes WHERE day = (SELECT max(day) FROM nodes)")
def fate1(t: Tables) -> DataFrame:
    return M.final_nodes(_nodes(t)).select("id", "day", "slice_id")


_KS = (4, 6, 8, 12)
_CAND = _POINTS + "".join(f""", c{k} AS (SELECT row_number() OVER (ORDER BY md5('1|' || id), id) - 1 AS state, [x, y] AS c FROM pts QUALIFY row_number() OVER (ORDER BY md5('1|' || id), id) <= {k}),
a{k} AS (SELECT id, state FROM pts, c{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt((c[1] - x)**2 + (c[2] - y)**2), state) = 1), n{k} AS (SELECT state, count(*) AS n FROM a{k} GROUP BY ALL), s{k} AS (SELECT {k} AS k, count(*) AS n_states, min(n) / sum(n) AS min_share FROM n{k})""" for k in _KS)


@R.query("fate2_chosen_k", _CAND + ", e AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in _KS) + "), p AS (SELECT *, n_states = k AND min_share >= 0.05 AS passes FROM e) SELECT k, n_states, round(min_share, 9) AS min_share, passes, passes AND row_number() OVER (ORDER BY passes DESC, abs(k - 12), k) = 1 AS selected FROM p")
def fate2(t: Tables) -> DataFrame:
    from functools import reduce

    p = G.located(V.anchors(t), "slice_id", "anchor_id").select("id", F.array("x", "y").alias("v"))
    rows = []
    for k in _KS:  # candidates are few
        n = CO.nearest_centroid(p, CO.seeded_centroids(p, "id", "v", k), "id", "v").groupBy("state").agg(F.count("*").alias("n"))
        rows.append(n.agg(F.count("*").alias("n_states"), (F.min("n") / F.sum("n")).alias("min_share")).select(F.lit(k).alias("k"), "*"))
    return V.rounded(CO.chosen_count(reduce(DataFrame.unionByName, rows), 12, 0.05), 9)


_DOM = "{l}, count(*) AS c"


@R.query("fate4_state_summary", _POINTS + """, g AS (SELECT l2 AS state, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, var_pop(x) + var_pop(y) AS spread FROM pts WHERE l2 IS NOT NULL GROUP BY ALL), t AS (SELECT count(*) AS t FROM pts WHERE l2 IS NOT NULL),
c AS (SELECT l2 AS state, l1, count(*) AS c FROM pts WHERE l2 IS NOT NULL AND l1 IS NOT NULL GROUP BY ALL), d AS (SELECT state, arg_min(l1, (-c, l1)) AS dominant_l1, max(c) / sum(c) AS purity_l1 FROM c GROUP BY state)
SELECT g.state, n, round(mean_x, 5) AS mean_x, round(mean_y, 5) AS mean_y, round(spread, 3) AS spread, round(n / t, 9) AS share, dominant_l1, round(purity_l1, 9) AS purity_l1 FROM g LEFT JOIN d USING (state), t""")
def fate4(t: Tables) -> DataFrame:
    p = _pts(t).where("l2 IS NOT NULL").withColumnRenamed("l2", "state")
    s = CO.state_summary(p, "state", ["l1"])
    return s.select("state", "n", F.round("mean_x", 5).alias("mean_x"), F.round("mean_y", 5).alias("mean_y"), F.round("spread", 3).alias("spread"), F.round("share", 9).alias("share"), "dominant_l1", F.round("purity_l1", 9).alias("purity_l1"))


@R.query("fate6_one_hot", _AE + _N + "SELECT id, l1 AS state, 1.0::DOUBLE AS prob FROM nodes WHERE day = (SELECT max(day) FROM nodes) AND l1 IS NOT NULL")
def fate6(t: Tables) -> DataFrame:
    return FT.one_hot(M.final_nodes(_nodes(t)), "l1")


# --- coarse states ---------------------------------------------------------------------------------------------------

@R.query("c2_standardised", _POINTS + ", s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM pts WHERE g IS NOT NULL) SELECT id, round((x - mx) / sx, 6) AS x, round((y - my) / sy, 6) AS y FROM pts, s")
def c2(t: Tables) -> DataFrame:
    p = G.located(V.anchors(t), "slice_id", "anchor_id")
    return V.rounded(scaling.standard(p.select("id", "x", "y"), ["x", "y"], p.where("group IS NOT NULL")))


@R.query("c10_allocation", _A + """, n AS (SELECT slice_id, count(*) AS n FROM anchors WHERE slice_id IS NOT NULL GROUP BY ALL), i AS (SELECT *, n * 200 / sum(n) OVER () AS ideal FROM n), b AS (SELECT *, least(n, greatest(floor(ideal), 1)) AS base FROM i),
r AS (SELECT *, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, slice_id) AS k, 200 - sum(base) OVER () AS rest FROM b) SELECT slice_id, n, CAST(least(n, base + CASE WHEN k <= rest THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM r""")
def c10(t: Tables) -> DataFrame:
    n = V.anchors(t).where("slice_id IS NOT NULL").groupBy("slice_id").agg(F.count("*").alias("n"))
    return T.allocation(n, "slice_id", 200)


@R.query("c11_layered_states", _A + """, p AS (SELECT anchor_id, time_day, x, y FROM anchors WHERE time_day IS NOT NULL AND isfinite(x) AND isfinite(y)), c AS (SELECT time_day, row_number() OVER (PARTITION BY time_day ORDER BY md5('1|' || anchor_id), anchor_id) - 1 AS s, x AS cx, y AS cy FROM p QUALIFY s < 6),
l AS (SELECT time_day, (row_number() OVER (ORDER BY time_day) - 1) * 6 AS shift FROM (SELECT DISTINCT time_day FROM p))
SELECT time_day, anchor_id, CAST(s + shift AS BIGINT) AS state, round(sqrt((cx - x)**2 + (cy - y)**2), 5) AS distance FROM p JOIN c USING (time_day) JOIN l USING (time_day) QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY sqrt((cx - x)**2 + (cy - y)**2), s) = 1""")
def c11(t: Tables) -> DataFrame:
    p = V.anchors(t).select("anchor_id", "time_day", S.finite("x").alias("x"), S.finite("y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    d = CO.layered_states(p.withColumn("v", F.array("x", "y")), "time_day", "anchor_id", "v", 6)
    return d.select("time_day", "anchor_id", F.col("state").cast("long").alias("state"), F.round("distance", 5).alias("distance"))


_MEMB = {"Epithelial": (0.7, 0.2, 0.1), "Immune": (0.1, 0.8, 0.1), "Fibroblast": (0.2, 0.2, 0.6)}


@R.query("c17_projected", _A + """, m AS (SELECT * FROM (VALUES ('Epithelial', [0.7, 0.2, 0.1]), ('Immune', [0.1, 0.8, 0.1]), ('Fibroblast', [0.2, 0.2, 0.6])) v(state, m)) SELECT anchor_id AS id, l1 AS state, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS macrostate, CAST(list_max(m) AS DOUBLE) AS top,
  round(list_sum(list_transform(m, lambda x: -x * ln(x))) / ln(3), 6) AS entropy FROM anchors JOIN m ON l1 = state""")
def c17(t: Tables) -> DataFrame:
    import pandas as pd

    n = V.anchors(t).select(F.col("anchor_id").alias("id"), F.col("l1").alias("state"))
    return V.rounded(CO.projected(n, pd.DataFrame({"state": list(_MEMB), "m": [list(v) for v in _MEMB.values()]})).drop("m"))


@R.query("c18_terminal_score", _FLAG + """, g AS (SELECT l1 AS state, avg(is_final::INT) AS final_share, count(*) AS n FROM f WHERE l1 IS NOT NULL GROUP BY ALL), b AS (SELECT avg(is_final::INT) AS base FROM f), h AS (SELECT l1, l2, count(*)::DOUBLE AS n FROM f WHERE l1 IS NOT NULL AND l2 IS NOT NULL GROUP BY ALL),
q AS (SELECT l1 AS state, max(n) / sum(n) AS diagonal, CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0 END AS entropy FROM h GROUP BY l1),
s AS (SELECT g.state, 0.4 * final_share + 0.25 * least(coalesce(final_share / nullif(base, 0), 0) / 5, 1) + 0.2 * diagonal + 0.15 * (1 - entropy) AS score FROM g JOIN q USING (state), b)
SELECT state, round(score, 6) AS score, CASE WHEN score >= 0.65 THEN 'terminal_like' WHEN score >= 0.4 THEN 'late' ELSE 'transient' END AS label FROM s""")
def c18(t: Tables) -> DataFrame:
    n = _flagged(t)
    g = n.where("l1 IS NOT NULL").groupBy(F.col("l1").alias("state")).agg(F.avg(F.col("is_final").cast("int")).alias("final_share"))
    base = n.agg(F.avg(F.col("is_final").cast("int")).alias("base"))
    d = D.diversity(D.label_counts(n.where("l1 IS NOT NULL"), ["l1"], "l2"), ["l1"], "l2").select(F.col("l1").alias("state"), F.col("dominant_share").alias("diagonal"), F.col("norm_entropy").alias("entropy"))
    s = g.join(d, "state").crossJoin(F.broadcast(base)).withColumn("enrichment", S.ratio("final_share", "base"))  # one row
    return V.rounded(CO.terminal_score(s).select("state", "score", "label"))


@R.query("c21_section_states", _POINTS + """, c AS (SELECT row_number() OVER (ORDER BY md5('1|' || id), id) - 1 AS state, [x, y] AS c FROM pts QUALIFY row_number() OVER (ORDER BY md5('1|' || id), id) <= 8), a AS (SELECT id, g, state FROM pts, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt((c[1] - x)**2 + (c[2] - y)**2), state) = 1)
, n AS (SELECT g, state, count(*) AS n FROM a GROUP BY ALL) SELECT g AS section, CAST(state AS BIGINT) AS state, n, round(n / sum(n) OVER (PARTITION BY g), 9) AS share FROM n""")
def c21(t: Tables) -> DataFrame:
    p = G.located(V.anchors(t), "slice_id", "anchor_id").withColumn("v", F.array("x", "y"))
    a = CO.nearest_centroid(p, CO.seeded_centroids(p, "id", "v", 8), "id", "v", "group")
    n = D.label_counts(a.withColumn("state", F.col("state").cast("long")), ["group"], "state")
    total = n.groupBy("group").agg(F.sum("n").alias("t"))
    return n.join(total, "group").select(F.col("group").alias("section"), "state", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


# --- lineage ---------------------------------------------------------------------------------------------------------

@R.query("l1_conforming", "SELECT sample_id, slice_id, cellbin_id, assay, feature_id, count FROM cellbin_feature_evidence")
def l1(t: Tables) -> DataFrame:
    return C.conforming(t.cellbin_feature_evidence, [*C.CELL_KEY, "assay", "feature_id", "count"])


_LS = _EV + ", f AS (SELECT cell_key, assay, feature_id, sum(n) AS n FROM evidence GROUP BY ALL)"


@R.query("l3_dominant_assay", _LS + "SELECT cell_key, arg_min(assay, (-n, CASE assay WHEN 'RA' THEN 1 WHEN 'TA' THEN 2 WHEN 'CA' THEN 3 ELSE 99 END, feature_id)) AS dominant_assay FROM f GROUP BY cell_key")
def l3(t: Tables) -> DataFrame:
    return lineage.summary(V.evidence(t), ["cell_key"]).select("cell_key", "dominant_assay")


@R.query("l4_assay_balance", _LS + """, a AS (SELECT cell_key, assay, sum(n)::DOUBLE AS n FROM f WHERE assay IN ('RA', 'TA', 'CA') GROUP BY ALL), t AS (SELECT cell_key, sum(n)::DOUBLE AS t FROM f GROUP BY ALL)
SELECT t.cell_key, round(coalesce(CASE WHEN count(a.n) > 1 THEN sum(-(a.n / t.t) * ln(a.n / t.t)) / ln(count(a.n)) ELSE 0 END, 0), 6) AS assay_balance FROM t LEFT JOIN a USING (cell_key) GROUP BY t.cell_key""")
def l4(t: Tables) -> DataFrame:
    return V.rounded(lineage.summary(V.evidence(t), ["cell_key"]).select("cell_key", "assay_balance"))


@R.query("l14_unique_cells", _CE + "SELECT sample_id, slice_id, cell_key, min(section_order) AS section_order FROM cells GROUP BY ALL")
def l14(t: Tables) -> DataFrame:
    c = V.cells(t).groupBy("sample_id", "slice_id", "cell_key").agg(F.min("section_order").alias("section_order"))
    return C.unique_cells(c.withColumnRenamed("cell_key", "cellbin_id")).withColumnRenamed("cellbin_id", "cell_key")


@R.query("l15_section_summary", _LS.replace("SELECT cell_key, assay", "SELECT slice_id, assay") + """SELECT slice_id, CAST(sum(n) AS BIGINT) AS total_count, count(*) AS n_features, count(DISTINCT assay) AS n_assays, arg_min(feature_id, (-n, CASE assay WHEN 'RA' THEN 1 WHEN 'TA' THEN 2 WHEN 'CA' THEN 3 ELSE 99 END, feature_id)) AS dominant_feature, round(max(n) / sum(n), 9) AS dominant_fraction FROM f GROUP BY slice_id""")
def l15(t: Tables) -> DataFrame:
    s = lineage.summary(V.evidence(t), ["slice_id"])
    return V.rounded(s.select("slice_id", "total_count", "n_features", "n_assays", "dominant_feature", "dominant_fraction"), 9)


# --- clones ----------------------------------------------------------------------------------------------------------

@R.query("k8_top_scores", _SCORE + ", k AS (SELECT cell_key, score, row_number() OVER (PARTITION BY cell_key ORDER BY score DESC, signature) AS r FROM sc QUALIFY r <= 2) SELECT cell_key, round(max(score), 6) AS score, round(max(score) FILTER (r = 2), 6) AS second, count(*) AS n_candidates FROM k GROUP BY ALL")
def k8(t: Tables) -> DataFrame:
    return V.rounded(K.decided(K.candidate_scores(*_signed(t)), 4.0, 1.0, keep=2).select("cell_key", "score", "second", "n_candidates"))


_BEST = """, {n}k AS (SELECT cell_key, {s} AS score, row_number() OVER (PARTITION BY cell_key ORDER BY {s} DESC, signature) AS r FROM sc QUALIFY r <= 2), {n}b AS (SELECT cell_key, max(score) AS b, max(score) - coalesce(max(score) FILTER (r = 2), 0) AS m FROM {n}k GROUP BY ALL)"""


@R.query("k9_null_thresholds", _SCORE + _BEST.format(n="x", s="sqrt(score)") + "SELECT round(quantile_cont(b, .99), 6) AS min_score, round(quantile_cont(m, .95), 6) AS min_margin FROM xb")
def k9(t: Tables) -> DataFrame:
    s = K.candidate_scores(*_signed(t))
    return V.rounded(K.null_thresholds(s, s.withColumn("score", F.sqrt("score"))))


@R.query("k13_loss_reasons", _SCORE + """, k AS (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY score DESC, signature) AS r FROM sc QUALIFY r <= 5), b AS (SELECT cell_key, max(signature) FILTER (r = 1) AS best, max(score) AS score, max(score) FILTER (r = 2) AS second FROM k GROUP BY ALL),
d AS (SELECT cell_key, best, CASE WHEN score < 4 THEN 'unassigned' WHEN second >= 4 AND second >= 0.75 * score THEN 'assigned_multi' WHEN score - coalesce(second, 0) < 1 THEN 'ambiguous' ELSE 'assigned_single' END AS status FROM b)
SELECT signature, count(*) AS overlap, count(*) FILTER (best = signature AND status LIKE 'assigned%') AS assigned, count(*) FILTER (best <> signature) AS better_elsewhere, count(*) FILTER (best = signature AND status = 'unassigned') AS under_threshold, count(*) FILTER (best = signature AND status = 'ambiguous') AS ambiguous,
  round(count(*) FILTER (best = signature AND status LIKE 'assigned%') / count(*), 9) AS conversion FROM sc JOIN d USING (cell_key) GROUP BY signature""")
def k13(t: Tables) -> DataFrame:
    s = K.candidate_scores(*_signed(t))
    return V.rounded(K.loss_reasons(s, K.decided(s, 4.0, 1.0)), 9)


@R.query("k14_membership_thresholds", _FE + """, q AS (SELECT assay, CASE WHEN assay = 'RA' THEN 'A' ELSE 'B' END AS clone_class, quantile_cont(ln(1 + n), .95) AS q95, quantile_cont(ln(1 + n), .99) AS q99 FROM ev WHERE assay IS NOT NULL GROUP BY ALL), s AS (SELECT *, (q99 - q95) / (2.326 - 1.645) AS sigma FROM q)
SELECT assay, clone_class, round(q95, 6) AS q95, round(q99, 6) AS q99, round(sigma, 6) AS sigma, round(q95 - 1.645 * sigma, 6) AS mu, round(greatest(q95 - 1.645 * sigma + 2.326 * sigma, CASE clone_class WHEN 'A' THEN 1.0 ELSE 2.5 END), 6) AS threshold FROM s""")
def k14(t: Tables) -> DataFrame:
    n = _features(t).where("assay IS NOT NULL").groupBy("cell_key", "feature", "assay").agg(F.sum("n").alias("n")).select("assay", F.when(F.col("assay") == "RA", "A").otherwise("B").alias("clone_class"), F.log1p(F.col("n").cast("double")).alias("score"))
    return V.rounded(K.membership_thresholds(n, "assay", "score", {"A": 1.0, "B": 2.5}, "clone_class"))


@R.query("k16_membership_summary", _SCORE + """, w AS (SELECT cell_key, signature, score / sum(score) OVER (PARTITION BY cell_key) AS weight, row_number() OVER (PARTITION BY cell_key ORDER BY score DESC, signature) = 1 AS pr FROM sc)
SELECT signature, count(*) AS n_cells, count(*) FILTER (pr) AS n_primary, round(sum(weight), 6) AS mass FROM w GROUP BY signature""")
def k16(t: Tables) -> DataFrame:
    m = K.memberships(K.candidate_scores(*_signed(t)))
    return V.rounded(m.groupBy("signature").agg(F.count("*").alias("n_cells"), F.count_if("primary").alias("n_primary"), F.sum("weight").alias("mass")))


@R.query("k17_incidence", _FE + ", nn AS (SELECT count(DISTINCT cell_key) AS tot FROM ev), ref AS (SELECT feature FROM ev, nn GROUP BY feature HAVING count(DISTINCT cell_key) / any_value(tot) <= 0.005) SELECT cell_key, count(DISTINCT feature) AS n_valid, count(DISTINCT assay) AS n_loci, CAST(sum(n) AS BIGINT) AS total FROM ev JOIN ref USING (feature) GROUP BY cell_key")
def k17(t: Tables) -> DataFrame:
    e = _features(t)
    valid = K.feature_reference(e).where("valid").select("feature")
    return e.join(valid, "feature").groupBy("cell_key").agg(F.countDistinct("feature").alias("n_valid"), F.countDistinct("assay").alias("n_loci"), F.sum("n").alias("total"))


@R.query("k18_component_support", _SCORE + "SELECT signature, count(DISTINCT feature) AS n_features, count(DISTINCT assay) AS n_loci, count(DISTINCT cell_key) AS n_cells, CASE WHEN count(DISTINCT feature) > 20 THEN 'filtered' WHEN count(DISTINCT assay) >= 2 THEN 'A' WHEN count(DISTINCT feature) > 1 THEN 'B' ELSE 'C' END AS clone_class FROM ev JOIN sm USING (feature) GROUP BY signature HAVING count(DISTINCT cell_key) >= 2")
def k18(t: Tables) -> DataFrame:
    e, m, _ = _signed(t)
    return K.signatures(e, m, 20).where("n_cells >= 2")


# --- joint clones ----------------------------------------------------------------------------------------------------

_ALL = _JOINT + ", x AS (SELECT cell_key, slice_id, unnest(al) AS allele FROM jj), tot AS (SELECT count(*) AS t FROM jj), fr AS (SELECT allele, nullif(regexp_extract(trim(allele), '^(CA|TA|RA)_', 1), '') AS locus, count(*) AS n_cells, count(*) / any_value(t) AS fraction FROM x, tot GROUP BY ALL)"


@R.query("j1_cell_alleles", _FE + """, an AS (SELECT DISTINCT feature, allele FROM (SELECT DISTINCT feature, unnest(['CA_1_2del', 'RA_' || length(feature) || '_' || (length(feature) + 1) || 'ins' || assay]) AS allele FROM ev WHERE feature IS NOT NULL))
SELECT cell_key, feature, n, allele, nullif(regexp_extract(allele, '^(CA|TA|RA)_', 1), '') AS locus FROM ev LEFT JOIN an USING (feature)""")
def j1(t: Tables) -> DataFrame:
    e = _features(t).groupBy("cell_key", "feature", "assay").agg(F.sum("n").alias("n"))
    n = F.length("feature")
    ann = e.where("feature IS NOT NULL").select("feature", "assay").distinct().select("feature", F.concat(F.lit(' "CA_1_2del"; RA_'), n.cast("string"), F.lit("_"), (n + 1).cast("string"), F.lit("ins"), "assay", F.lit(";nan")).alias("allele"))
    return C.cell_alleles(e, ann)


@R.query("j4_allele_classes", _ALL + """, kn AS (SELECT allele, n_cells / (SELECT max(n_cells) FROM fr) AS k FROM fr WHERE n_cells % 2 = 0), c AS (SELECT allele, locus, n_cells, fraction, CASE WHEN locus IS NULL THEN 'locus_mismatch' WHEN k < 0.02 THEN 'reference_mapped_rare' WHEN k IS NOT NULL THEN 'reference_mapped_common' ELSE 'unmapped_de_novo_candidate' END AS allele_class FROM fr LEFT JOIN kn USING (allele))
SELECT allele, locus, n_cells, round(fraction, 9) AS fraction, allele_class, allele_class = 'reference_mapped_rare' OR (allele_class = 'unmapped_de_novo_candidate' AND fraction < 0.005) AS valid FROM c""")
def j4(t: Tables) -> DataFrame:
    f = K.allele_frequencies(V.assigned(t))
    most = f.agg(F.max("n_cells").alias("m"))
    known = f.where(F.col("n_cells") % 2 == 0).crossJoin(F.broadcast(most)).select("allele", (F.col("n_cells") / F.col("m")).alias("normalized_count"))  # one row
    return V.rounded(K.allele_classes(f, known, 0.02), 9)


@R.query("j5_one_allele", _JOINT + ", x AS (SELECT cell_key, unnest(al) AS allele FROM jj), y AS (SELECT cell_key, allele, nullif(regexp_extract(trim(allele), '^(CA|TA|RA)_', 1), '') AS locus, count(*) AS count FROM x GROUP BY ALL) SELECT cell_key, locus, allele, count, count(*) OVER (PARTITION BY cell_key, locus) AS candidates FROM y WHERE locus IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_key, locus ORDER BY count DESC, allele) = 1")
def j5(t: Tables) -> DataFrame:
    a = V.assigned(t).select("cell_key", F.explode(S.joint_alleles("joint_clone_id")).alias("allele")).withColumn("n", F.lit(1))
    return K.one_allele_per_locus(a).select("cell_key", "locus", "allele", "count", "candidates")


_JC = _ALL + """, sm AS (SELECT allele, count(DISTINCT slice_id) AS sc FROM x GROUP BY ALL), kp AS (SELECT cell_key, locus, min(allele) AS allele FROM x JOIN fr USING (allele) JOIN sm USING (allele) WHERE fraction < 0.02 AND sc < 2 AND locus IS NOT NULL GROUP BY ALL),
wd AS (SELECT cell_key, max(allele) FILTER (locus = 'CA') AS ca, max(allele) FILTER (locus = 'RA') AS ra, max(allele) FILTER (locus = 'TA') AS ta FROM kp GROUP BY ALL), w AS (SELECT *, coalesce(ca, 'nan') || '@' || coalesce(ra, 'nan') || '@' || coalesce(ta, 'nan') AS tmp FROM wd),
ids AS (SELECT tmp, ca, ra, ta, min(cell_key) AS f FROM w GROUP BY ALL), lg AS (SELECT tmp, f, 0 AS pos, ca AS allele FROM ids WHERE ca IS NOT NULL UNION ALL SELECT tmp, f, 1, ra FROM ids WHERE ra IS NOT NULL UNION ALL SELECT tmp, f, 2, ta FROM ids WHERE ta IS NOT NULL),
nm AS (SELECT allele, k, CASE WHEN k >= 6 AND fraction < 0.02 THEN 0.02 ELSE fraction END AS prob FROM (SELECT allele, count(*) AS k FROM lg GROUP BY ALL) JOIN fr USING (allele)), fw AS (SELECT lg.allele, ids.* FROM lg JOIN nm USING (allele) JOIN ids USING (tmp) WHERE prob < 0.02 AND k BETWEEN 2 AND 5),
ed AS (SELECT DISTINCT a.tmp AS src, b.tmp AS dst FROM fw a JOIN fw b ON a.allele = b.allele AND a.tmp < b.tmp AND coalesce(a.ca = b.ca, true) AND coalesce(a.ra = b.ra, true) AND coalesce(a.ta = b.ta, true)), u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
co AS (WITH RECURSIVE r(id, m) USING KEY (id) AS (SELECT tmp, tmp FROM ids UNION SELECT u.a, min(r.m) FROM r JOIN u ON u.b = r.id JOIN recurring.r q ON q.id = u.a WHERE r.m < q.m GROUP BY u.a) SELECT id AS tmp, m AS component FROM r),
na AS (SELECT component, string_agg(allele, '@' ORDER BY pos, f, allele) AS joint_clone_id, count(*)::INTEGER AS joint_allele_num FROM (SELECT component, pos, allele, min(f) AS f FROM lg JOIN co USING (tmp) GROUP BY ALL) GROUP BY component),
ct AS (SELECT component, count(*) AS bc_num FROM co GROUP BY ALL), pr AS (SELECT a.component, count(*) FILTER (coalesce(x.ca = y.ca, true) AND coalesce(x.ra = y.ra, true) AND coalesce(x.ta = y.ta, true)) / count(*) AS share FROM co a JOIN co b ON a.component = b.component AND a.tmp < b.tmp JOIN ids x ON x.tmp = a.tmp JOIN ids y ON y.tmp = b.tmp GROUP BY ALL),
cl AS (SELECT component, joint_clone_id, bc_num, joint_allele_num, coalesce(share, 1.0) AS bc_consistency FROM ct JOIN na USING (component) LEFT JOIN pr USING (component))
"""


def _joint(t: Tables) -> tuple[DataFrame, DataFrame]:
    x = V.assigned(t).select("cell_key", "slice_id", F.explode(S.joint_alleles("joint_clone_id")).alias("allele"))
    f = K.allele_frequencies(V.assigned(t)).select("allele", "locus", F.col("fraction").alias("normalized_count"))
    n = x.groupBy("allele").agg(F.countDistinct("slice_id").alias("sample_count"))
    return K.joint_clones(x.join(f, "allele").join(n, "allele"), 0.02, 2, 6, _LOCI)


@R.query("j6_joint_clones", _JC + "SELECT joint_clone_id, bc_num, joint_allele_num, round(bc_consistency, 9) AS bc_consistency FROM cl")
def j6_clones(t: Tables) -> DataFrame:
    return V.rounded(_joint(t)[1], 9)


@R.query("j6_cell_joint_clones", _JC + "SELECT cell_key, tmp AS tmp_id, joint_clone_id, round(coalesce(a.prob, 1) * coalesce(b.prob, 1) * coalesce(c.prob, 1), 12) AS joint_prob, joint_allele_num, round(bc_consistency, 9) AS bc_consistency FROM w JOIN co USING (tmp) JOIN cl USING (component) LEFT JOIN nm a ON a.allele = w.ca LEFT JOIN nm b ON b.allele = w.ra LEFT JOIN nm c ON c.allele = w.ta")
def j6_cells(t: Tables) -> DataFrame:
    return _joint(t)[0].withColumns({"joint_prob": F.round("joint_prob", 12), "bc_consistency": F.round("bc_consistency", 9)})


@R.query("j7_policies", _JOINT + """, p AS (SELECT 'any' AS policy, count(*) AS n_cells, count(*) FILTER (len(al) > 0) AS n_assigned, avg(CASE WHEN len(al) > 0 THEN joint_prob END) AS mean_prob FROM ja UNION ALL SELECT 'several_loci', count(*), count(*) FILTER (len(al) > 1), avg(CASE WHEN len(al) > 1 THEN joint_prob END) FROM ja),
s AS (SELECT *, n_assigned / n_cells AS fraction, 1.0 * (n_assigned / n_cells) - 0.5 * coalesce(mean_prob, 0) AS score FROM p) SELECT policy, n_cells, n_assigned, round(fraction, 6) AS fraction, round(mean_prob, 6) AS mean_prob, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, policy) AS INTEGER) AS rank, row_number() OVER (ORDER BY score DESC, policy) = 1 AS selected FROM s""")
def j7(t: Tables) -> DataFrame:
    a = V.assigned(t).withColumn("k", F.coalesce(F.size(S.joint_alleles("joint_clone_id")), F.lit(0)))
    rows = [a.agg(F.count("*").alias("n_cells"), F.count_if(F.col("k") > least).alias("n_assigned"), F.avg(F.when(F.col("k") > least, F.col("joint_prob"))).alias("mean_prob")).select(F.lit(name).alias("policy"), "*") for name, least in (("any", 0), ("several_loci", 1))]
    s = rows[0].unionByName(rows[1]).withColumn("fraction", F.col("n_assigned") / F.col("n_cells"))
    return V.rounded(K.policy_selection(s, {"fraction": 1.0, "mean_prob": -0.5}, "policy"))


@R.query("j11_section_composition", _AS + """, m AS (SELECT DISTINCT slice_id AS unit, cell_key, clone_id FROM assigned), n AS (SELECT unit, count(*) AS n_cells, count(clone_id) AS n_assigned FROM m GROUP BY ALL), c AS (SELECT unit, clone_id, count(*) AS n FROM m WHERE clone_id IS NOT NULL GROUP BY ALL),
d AS (SELECT unit, count(*) AS richness, arg_min(clone_id, (-n, clone_id)) AS dominant, max(n) / sum(n) AS ds FROM c GROUP BY unit) SELECT unit, n_cells, n_assigned, coalesce(richness, 0) AS richness, dominant, round(coalesce(ds, 0), 6) AS dominant_share, round(n_assigned / n_cells, 6) AS coverage FROM n LEFT JOIN d USING (unit)""")
def j11(t: Tables) -> DataFrame:
    a = V.assigned(t)
    u = K.unit_composition(a.select(F.col("slice_id").alias("unit"), "cell_key"), a.select("cell_key", "clone_id"))
    return V.rounded(u.select("unit", "n_cells", "n_assigned", "richness", "dominant", "dominant_share", "coverage"))


# --- potentials and comparison ---------------------------------------------------------------------------------------

@R.query("n5_state_sums", _FE + ", u AS (SELECT cell_key, assay, sum(n) AS total, count(DISTINCT feature) AS features FROM ev GROUP BY ALL) SELECT assay, count(*) AS n_units, CAST(sum(total) AS BIGINT) AS total, CAST(sum(features) AS BIGINT) AS features FROM u GROUP BY assay")
def n5(t: Tables) -> DataFrame:
    u = _features(t).groupBy("cell_key", "assay").agg(F.sum("n").alias("total"), F.countDistinct("feature").alias("features"))
    return potential.aggregated_states(u, "assay", ["total", "features"])


@R.query("n6_parameter_grid", _E + ", g AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0)) a(power), (VALUES (0.25::DOUBLE), (1.0)) b(tau)), w AS (SELECT power, tau, src, sum(pow(p, power) * exp(-(1 - p) / tau)) AS w FROM edges, g GROUP BY ALL) SELECT power, tau, count(*) AS n_sources, round(avg(w), 6) AS mean_weight FROM w GROUP BY ALL")
def n6(t: Tables) -> DataFrame:
    g = potential.parameter_grid(V.edges(t).select("src", "p"), power=[0.5, 1.0], tau=[0.25, 1.0])
    w = g.groupBy("power", "tau", "src").agg(F.sum(F.pow("p", F.col("power")) * F.exp(-(1 - F.col("p")) / F.col("tau"))).alias("w"))
    return V.rounded(w.groupBy("power", "tau").agg(F.count("*").alias("n_sources"), F.avg("w").alias("mean_weight")))


_F2 = _FATE + ", f2 AS (SELECT id, state, prob FROM fate QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(prob, 12) DESC, state) <= 2), jn AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.state, b.state) AS state, coalesce(a.prob, 0) AS pa, coalesce(b.prob, 0) AS pb FROM fate a FULL JOIN f2 b ON a.id = b.id AND a.state = b.state)"


def _two_fates(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    f = _fate(t)[0].select("id", "state", "prob")
    w = Window.partitionBy("id").orderBy(F.desc(F.round("prob", 12)), "state")
    return f, f.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


@R.query("b5_endpoint_masses", _F2 + "SELECT state, round(sum(pa), 6) AS mass_a, round(sum(pb), 6) AS mass_b, round(sum(pb) - sum(pa), 6) AS change, round(coalesce(CASE WHEN isnan(corr(pa, pb)) THEN 0 ELSE corr(pa, pb) END, 0), 6) AS pearson FROM jn GROUP BY state")
def b5(t: Tables) -> DataFrame:
    return V.rounded(FT.compared_states(*_two_fates(t)))


@R.query("b5_divergence", _F2 + "SELECT id, round(0.5 * sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0 END), 6) AS js FROM jn GROUP BY id")
def b5d(t: Tables) -> DataFrame:
    return V.rounded(FT.divergence(*_two_fates(t)))


@R.query("b5_agreement", _METRICS + ", h2 AS (SELECT id, sum(CASE WHEN prob > 0 THEN -prob * ln(prob) ELSE 0 END) AS h2 FROM k WHERE r <= 2 GROUP BY id) SELECT count(*) AS n, 1.0::DOUBLE AS agreement, round(avg(h2 - h), 6) AS entropy_change, 0.0::DOUBLE AS top1_change FROM q JOIN h2 USING (id)")
def b5a(t: Tables) -> DataFrame:
    # Cutting fates to their two best states keeps leader and top share; only the entropy falls.
    a, b = _two_fates(t)
    m = V.rounded(FT.compared(FT.metrics(a.withColumn("prob", F.round("prob", 12)), 8), FT.metrics(b.withColumn("prob", F.round("prob", 12)), 8)))
    return m.select("n", "agreement", "entropy_change", (F.col("top1_change") + 0.0).alias("top1_change"))


@R.query("b7_kernel_choice", _E + """, s AS (SELECT src, count(*) AS n, sum(p) AS a, sum(CASE WHEN isfinite(p1) THEN p1 END) AS b FROM edges GROUP BY ALL), k AS (SELECT 'v1' AS kernel, avg(CASE WHEN abs(b - 1) <= 0.5 THEN 1.0 ELSE 0.0 END) AS near_one, avg(n) AS degree FROM s WHERE b IS NOT NULL UNION ALL SELECT 'v2', avg(CASE WHEN abs(a - 1) <= 0.5 THEN 1.0 ELSE 0.0 END), avg(n) FROM s),
z AS (SELECT *, 1.0 * near_one - 0.001 * degree AS score FROM k) SELECT kernel, round(near_one, 6) AS near_one, round(degree, 6) AS degree, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, kernel) AS INTEGER) AS rank, row_number() OVER (ORDER BY score DESC, kernel) = 1 AS selected FROM z""")
def b7(t: Tables) -> DataFrame:
    s = V.edges(t).groupBy("src").agg(F.count("*").alias("n"), F.sum("p").alias("v2"), F.sum(S.finite("p1")).alias("v1"))
    near = lambda c: F.avg(F.when(F.abs(F.col(c) - 1) <= 0.5, 1.0).otherwise(0.0)).alias("near_one")
    rows = [s.where(f"{c} IS NOT NULL").agg(near(c), F.avg("n").alias("degree")).select(F.lit(c).alias("kernel"), "*") for c in ("v1", "v2")]
    return V.rounded(K.policy_selection(rows[0].unionByName(rows[1]), {"near_one": 1.0, "degree": -0.001}, "kernel"))


# --- relational primitives -------------------------------------------------------------------------------------------

@R.query("x_unpivot", _A + "SELECT anchor_id, kind, label FROM (UNPIVOT (SELECT anchor_id, l1, l2, l3 FROM anchors) ON l1, l2, l3 INTO NAME kind VALUE label)")
def x_unpivot(t: Tables) -> DataFrame:
    return V.anchors(t).unpivot("anchor_id", ["l1", "l2", "l3"], "kind", "label").where("label IS NOT NULL")


_CELLS2 = "WITH a AS (SELECT DISTINCT upper(trim(clone_id)) AS clone_id FROM cellbin_clone_assignment WHERE clone_id IS NOT NULL), b AS (SELECT DISTINCT upper(trim(clone_id)) AS clone_id FROM clone_cellbin_membership WHERE clone_id IS NOT NULL)"


def _clone_ids(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(d.where("clone_id IS NOT NULL").select(key("clone_id").alias("clone_id")) for d in (t.cellbin_clone_assignment, t.clone_cellbin_membership))  # type: ignore[return-value]


@R.query("x_intersect", _CELLS2 + " SELECT * FROM a INTERSECT SELECT * FROM b")
def x_intersect(t: Tables) -> DataFrame:
    a, b = _clone_ids(t)
    return a.intersect(b)


@R.query("x_except", _CELLS2 + " SELECT * FROM b EXCEPT SELECT * FROM a")
def x_except(t: Tables) -> DataFrame:
    a, b = _clone_ids(t)
    return b.exceptAll(b.join(a.distinct(), "clone_id", "left_semi")).distinct()


@R.query("x_fixed_bins", _E + "SELECT CAST(CASE WHEN p < 0 THEN 0 WHEN p >= 1 THEN 11 ELSE floor(p * 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM edges GROUP BY ALL")
def x_bins(t: Tables) -> DataFrame:
    return V.edges(t).groupBy(F.width_bucket("p", F.lit(0.0), F.lit(1.0), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"))
