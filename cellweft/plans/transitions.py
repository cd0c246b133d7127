"""Queries on transitions, Markov tables and fate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions import scalars as S
from cellweft.operators import fate as FT
from cellweft.operators import gates, graph, markov, scaling
from cellweft.operators import transitions as T
from cellweft.operators.quantiles import quantiles
from cellweft.plans import views as V
from cellweft.plans.registry import Registry, Tables

R = Registry()

_A, _E = "WITH " + V.ANCHORS, "WITH " + V.EDGES
_AE = "WITH " + V.ANCHORS + "," + V.EDGES


def _nodes(t: Tables) -> DataFrame:
    a = V.anchors(t).select(F.col("anchor_id").alias("id"), F.col("time_day").alias("day"), "time", "slice_id", "anchor_index", "l1", "l2", "mouse_id")
    return a.where("day IS NOT NULL")


_N = ", nodes AS (SELECT anchor_id AS id, time_day AS day, \"time\", slice_id, anchor_index, l1, l2, mouse_id FROM anchors WHERE time_day IS NOT NULL)"


@R.query("t1_adjacent_times", _A + """, n AS (SELECT "time", time_day, count(*) AS n FROM anchors WHERE time_day IS NOT NULL GROUP BY ALL),
w AS (SELECT "time" AS source_time, lead("time") OVER o AS target_time, time_day AS source_day, lead(time_day) OVER o AS target_day, n AS n_source, lead(n) OVER o AS n_target FROM n WINDOW o AS (ORDER BY time_day, "time"))
SELECT *, target_day - source_day AS delta FROM w WHERE target_time IS NOT NULL""")
def t1(t: Tables) -> DataFrame:
    return T.adjacent_times(V.anchors(t), "time", "time_day")


_VEC = """, v AS (SELECT upper(trim(anchor_id)) AS id, time_day AS day, CAST(features AS DOUBLE[]) AS vec FROM niche_anchors
  QUALIFY row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC NULLS LAST) = 1),
u AS (SELECT * FROM v WHERE len(vec) = 48 AND len(list_filter(vec, lambda x: NOT isfinite(x) OR x IS NULL)) = 0 AND day IS NOT NULL)"""


def _vectors(t: Tables) -> DataFrame:
    d = t.niche_anchors.where("anchor_id IS NOT NULL").select(F.upper(F.trim("anchor_id")).alias("id"), F.col("time_day").alias("day"), "slice_id", "rep_version", "features")
    b = d.groupBy("id").agg(F.max_by(F.struct("day", "slice_id", "features"), F.struct("rep_version", "features")).alias("r")).select("id", "r.*")
    return b.where("size(features) = 48 AND forall(features, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND day IS NOT NULL").withColumn("vec", F.col("features").cast("array<double>"))


@R.query("t2_nearest_targets", _A + _VEC + """, days AS (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM (SELECT DISTINCT day FROM u)),
k AS (SELECT d.day || '->' || d.nx AS time_pair, a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rank FROM u a JOIN days d ON a.day = d.day JOIN u b ON b.day = d.nx)
SELECT time_pair, src, dst, round(d, 5) AS distance, rank FROM k WHERE rank <= 5""")
def t2(t: Tables) -> DataFrame:
    v = _vectors(t)
    days = T.adjacent_times(v, "day", "day").select("source_day", "target_day", F.concat(F.col("source_day").cast("string"), F.lit("->"), F.col("target_day").cast("string")).alias("time_pair"))
    s = v.join(F.broadcast(days), F.col("day") == F.col("source_day")).select("time_pair", "id", "vec")  # days: a row a time point
    g = v.join(F.broadcast(days), F.col("day") == F.col("target_day")).select("time_pair", "id", "vec")
    return V.rounded(T.nearest_targets(s, g, 5), 5)


_COST = _E + ", c AS (SELECT src, dst, p, p1, source_time, target_time, target_slice_id, 1 - p AS cost FROM edges)"


@R.query("t7_weighted", _COST + """, tau AS (SELECT source_time, greatest(median(cost), 1e-3) AS tau FROM c GROUP BY ALL), w AS (SELECT c.*, exp(greatest(least(-cost / tau, 700), -700)) AS w FROM c JOIN tau USING (source_time))
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS prob FROM w""")
def t7(t: Tables) -> DataFrame:
    e = V.edges(t).withColumn("cost", 1 - F.col("p"))
    return V.rounded(T.weighted(e, "cost", ["source_time"]).select("src", "dst", "prob"))


@R.query("t9_source_summary", _E + "SELECT src, count(*) AS n_targets, round(sum(p), 6) AS row_sum, round(sum(-p * ln(p)), 6) AS entropy, max(p) AS top1, round(exp(sum(-p * ln(p))), 5) AS effective FROM edges GROUP BY src")
def t9(t: Tables) -> DataFrame:
    s = T.source_summary(V.edges(t))
    return s.select("src", "n_targets", F.round("row_sum", 6).alias("row_sum"), F.round("entropy", 6).alias("entropy"), "top1", F.round("effective", 5).alias("effective"))


@R.query("t9_diagnostics", _E + """, s AS (SELECT source_time, src, sum(p) AS s, sum(-p * ln(p)) AS h, max(p) AS m FROM edges GROUP BY ALL)
SELECT source_time, count(*) AS n_sources, round(min(s), 6) AS min_sum, round(max(s), 6) AS max_sum, round(avg(s), 6) AS mean_sum, round(avg(h), 6) AS mean_entropy, round(avg(m), 6) AS mean_top1, round(quantile_cont(m, 0.95), 6) AS p95_top1, round(avg(exp(h)), 4) AS mean_effective FROM s GROUP BY source_time""")
def t9d(t: Tables) -> DataFrame:
    d = T.probability_diagnostics(V.edges(t), keys=["source_time"])
    return V.rounded(d.withColumn("mean_effective", F.round("mean_effective", 4)))


@R.query("t9_category_spread", _E + """, c AS (SELECT src, target_slice_id, sum(p) AS m FROM edges GROUP BY ALL), q AS (SELECT *, m / sum(m) OVER (PARTITION BY src) AS q FROM c)
SELECT src, round(sum(CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END), 6) AS category_entropy, round(max(q), 6) AS category_top FROM q GROUP BY src""")
def t9c(t: Tables) -> DataFrame:
    return V.rounded(T.category_spread(V.edges(t), "target_slice_id"))


@R.query("v1_bandwidth", _E + """, a AS (SELECT quantile_cont(p, 0.5) AS a FROM edges WHERE p > 1e-6) SELECT src, greatest(coalesce(quantile_cont(p, 0.5) FILTER (p > 1e-6), any_value(a)), 1e-6) AS tau FROM edges, a GROUP BY src""")
def v1(t: Tables) -> DataFrame:
    return T.adaptive_bandwidth(V.edges(t), "p")


@R.query("v3_balance_gate", _E + """, n AS (SELECT target_slice_id AS c, count(*) AS n FROM edges GROUP BY ALL), s AS (SELECT sum(n) AS t, count(*) AS k FROM n), m AS (SELECT target_mouse_id AS c, count(*) AS n FROM edges GROUP BY ALL), sm AS (SELECT sum(n) AS t, count(*) AS k FROM m)
SELECT src, dst, round(greatest(least(least(1, sqrt((1 / s.k) / (n.n / s.t))) * least(1, sqrt((1 / sm.k) / (m.n / sm.t))), 1), 0.2), 6) AS gate
FROM edges JOIN n ON target_slice_id IS NOT DISTINCT FROM n.c JOIN m ON target_mouse_id IS NOT DISTINCT FROM m.c, s, sm""")
def v3(t: Tables) -> DataFrame:
    return V.rounded(T.balance_gate(V.edges(t), ["target_slice_id", "target_mouse_id"]).select("src", "dst", "gate"))


@R.query("v5_sharpened", _E + """, tau AS (SELECT src, median(p) AS tau FROM edges GROUP BY src), w AS (SELECT src, dst, pow(p, 0.5) * exp(-(1 - p) / tau) * (0.5 + 0.5 * exp(-p)) AS w FROM edges JOIN tau USING (src)),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM w QUALIFY rank <= 10)
SELECT src, dst, rank, round(CASE WHEN sum(w) OVER (PARTITION BY src) > 0 THEN w / sum(w) OVER (PARTITION BY src) ELSE 1 / count(*) OVER (PARTITION BY src) END, 6) AS prob FROM k""")
def v5(t: Tables) -> DataFrame:
    e = V.edges(t)
    tau = quantiles(e, ["src"], "p", tau=0.5)
    g = e.join(tau, "src").withColumn("d", 1 - F.col("p")).withColumn("gate", T.soft_gate(F.col("p"), F.lit(1.0), 0.5))
    return V.rounded(T.sharpened(g, "p", "d", "tau", ["gate"], 0.5, 10).select("src", "dst", "rank", "prob"))


for _policy in ("zero", "uniform", "drop"):
    _zero = {"zero": "0", "uniform": "1 / n", "drop": "0"}[_policy]

    @R.query(f"v6_normalised_{_policy}", "WITH " + """e AS (SELECT edge_id, upper(trim(source_anchor_id)) AS src, greatest(coalesce(CASE WHEN isfinite(v2_row_normalized_transition_prob) THEN v2_row_normalized_transition_prob END, 0), 0) AS w FROM transition_edges),
s AS (SELECT *, sum(w) OVER (PARTITION BY src) AS s, count(*) OVER (PARTITION BY src) AS n FROM e) SELECT edge_id, round(CASE WHEN s > 0 THEN w / s ELSE """ + _zero + " END, 6) AS q FROM s" + (" WHERE s > 0" if _policy == "drop" else ""))
    def v6(t: Tables, policy: str = _policy) -> DataFrame:
        e = t.transition_edges.select("edge_id", F.upper(F.trim("source_anchor_id")).alias("src"), F.col("v2_row_normalized_transition_prob").alias("w"))
        return V.rounded(T.normalised(e, "w", "q", policy).select("edge_id", "q"))


@R.query("v10_rank_correlation", _E + """, r AS (SELECT src, rank() OVER (PARTITION BY src ORDER BY p) + (count(*) OVER (PARTITION BY src, p) - 1) / 2 AS a, rank() OVER (PARTITION BY src ORDER BY p1) + (count(*) OVER (PARTITION BY src, p1) - 1) / 2 AS b FROM edges WHERE isfinite(p1)),
c AS (SELECT src, count(*) AS n, avg(a * b) - avg(a) * avg(b) AS cov, avg(a * a) - avg(a)**2 AS va, avg(b * b) - avg(b)**2 AS vb FROM r GROUP BY src HAVING count(*) >= 3)
SELECT src, n, round(CASE WHEN va > 1e-9 AND vb > 1e-9 THEN cov / sqrt(va * vb) ELSE 0 END, 5) AS spearman FROM c""")
def v10(t: Tables) -> DataFrame:
    e = V.edges(t).where(S.finite("p1").isNotNull())
    r = e.select("src", S.average_rank("p", ["src"]).alias("a"), S.average_rank("p1", ["src"]).alias("b"))
    c = r.groupBy("src").agg(F.count("*").alias("n"), (F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("cov"), (F.avg(F.col("a") ** 2) - F.avg("a") ** 2).alias("va"), (F.avg(F.col("b") ** 2) - F.avg("b") ** 2).alias("vb")).where("n >= 3")
    return c.select("src", "n", F.round(F.when((F.col("va") > 1e-9) & (F.col("vb") > 1e-9), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).otherwise(0.0), 5).alias("spearman"))


@R.query("t12_shard_plan", _A + """, n AS (SELECT "time", time_day, count(*) AS n FROM anchors WHERE time_day IS NOT NULL GROUP BY ALL), w AS (SELECT "time", lead("time") OVER o AS target_time, lead(n) OVER o AS n_target FROM n WINDOW o AS (ORDER BY time_day, "time")),
s AS (SELECT "time", slice_id, count(*) AS n_rows FROM anchors GROUP BY ALL) SELECT "time", target_time, slice_id, n_rows, n_rows * least(30, n_target) AS expected_edges, n_rows * n_target * 8 / 2**30 AS dense_gib FROM s JOIN w USING ("time") WHERE target_time IS NOT NULL""")
def t12(t: Tables) -> DataFrame:
    a = V.anchors(t)
    return T.shard_plan(a, T.adjacent_times(a, "time", "time_day"), "time", "slice_id", 30)


_MD5 = "md5('1|' || anchor_id)"


@R.query("s9_hash_sample", _A + f"SELECT slice_id, anchor_id FROM anchors QUALIFY row_number() OVER (PARTITION BY slice_id ORDER BY {_MD5}, anchor_id) <= 20")
def s9(t: Tables) -> DataFrame:
    return T.hash_sample(V.anchors(t).select("slice_id", "anchor_id"), ["slice_id"], "anchor_id", 20)


@R.query("s10_head_sample", _A + "SELECT slice_id, anchor_id FROM anchors QUALIFY row_number() OVER (PARTITION BY slice_id ORDER BY anchor_id) <= 20")
def s10(t: Tables) -> DataFrame:
    return T.head_sample(V.anchors(t).select("slice_id", "anchor_id"), ["slice_id"], "anchor_id", 20)


@R.query("s18_stride_sample", _A + ", r AS (SELECT slice_id, anchor_id, row_number() OVER (PARTITION BY slice_id ORDER BY anchor_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY slice_id) // 25) AS s FROM anchors) SELECT slice_id, anchor_id FROM r WHERE r % s = 0 AND r // s < 25")
def s18(t: Tables) -> DataFrame:
    return T.stride_sample(V.anchors(t).select("slice_id", "anchor_id"), ["slice_id"], "anchor_id", 25)


@R.query("t14_quota_sample", _A + f""", n AS (SELECT slice_id, count(*) AS n FROM anchors GROUP BY ALL), i AS (SELECT *, n * 100 / sum(n) OVER () AS ideal FROM n), b AS (SELECT *, least(n, greatest(floor(ideal), 1)) AS base FROM i),
q AS (SELECT slice_id, least(n, base + CASE WHEN row_number() OVER (ORDER BY ideal - floor(ideal) DESC, slice_id) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END) AS quota FROM b)
SELECT slice_id, anchor_id FROM anchors JOIN q USING (slice_id) QUALIFY row_number() OVER (PARTITION BY slice_id ORDER BY {_MD5}, anchor_id) <= any_value(quota) OVER (PARTITION BY slice_id)""")
def t14(t: Tables) -> DataFrame:
    return T.quota_sample(V.anchors(t).select("slice_id", "anchor_id"), "slice_id", "anchor_id", 100)


@R.query("c22_spaced_subset", _A + """, r AS (SELECT slice_id, anchor_id, row_number() OVER (PARTITION BY slice_id ORDER BY anchor_id) - 1 AS r, count(*) OVER (PARTITION BY slice_id) AS n FROM anchors), p AS (SELECT DISTINCT slice_id, (i * (n - 1)) // 9 AS r FROM (SELECT DISTINCT slice_id, n FROM r), range(10) t(i))
SELECT slice_id, anchor_id FROM r JOIN p USING (slice_id, r)""")
def c22(t: Tables) -> DataFrame:
    return T.spaced_subset(V.anchors(t).select("slice_id", "anchor_id"), ["slice_id"], "anchor_id", 10)


@R.query("k11_permuted", _A + f""", a AS (SELECT slice_id, anchor_id, row_number() OVER (PARTITION BY slice_id ORDER BY anchor_id) AS r FROM anchors), b AS (SELECT slice_id, l1, row_number() OVER (PARTITION BY slice_id ORDER BY md5('7|' || anchor_id), anchor_id) AS r FROM anchors)
SELECT slice_id, anchor_id, b.l1 AS l1_shuffled FROM a JOIN b USING (slice_id, r)""")
def k11(t: Tables) -> DataFrame:
    return T.permuted(V.anchors(t).select("slice_id", "anchor_id", "l1"), ["slice_id"], "anchor_id", "l1", 7).select("slice_id", "anchor_id", "l1_shuffled")


# --- Markov tables ---------------------------------------------------------------------------------------------------

@R.query("m1_global_nodes", _A + _N + "SELECT id, row_number() OVER (ORDER BY day, \"time\", slice_id, anchor_index, id) - 1 AS node_index, day = max(day) OVER () AS is_final FROM nodes")
def m1(t: Tables) -> DataFrame:
    n = markov.dense_index(_nodes(t), ["day", "time", "slice_id", "anchor_index", "id"])
    last = n.agg(F.max("day").alias("_l"))
    return n.crossJoin(F.broadcast(last)).select("id", "node_index", (F.col("day") == F.col("_l")).alias("is_final"))


@R.query("m2_endpoint_audit", _AE + "SELECT count(*) AS n_edges, count(*) FILTER (s.anchor_id IS NULL) AS no_source, count(*) FILTER (d.anchor_id IS NULL) AS no_target FROM edges LEFT JOIN anchors s ON src = s.anchor_id LEFT JOIN anchors d ON dst = d.anchor_id")
def m2(t: Tables) -> DataFrame:
    return markov.endpoint_audit(V.edges(t), V.anchors(t).select(F.col("anchor_id").alias("id")))


@R.query("m3_repeated_edges", "SELECT upper(trim(source_anchor_id)) AS src, upper(trim(target_anchor_id)) AS dst, count(*) AS n FROM transition_edges GROUP BY ALL HAVING count(*) > 1")
def m3(t: Tables) -> DataFrame:
    return gates.repeated_keys(t.transition_edges.select(F.upper(F.trim("source_anchor_id")).alias("src"), F.upper(F.trim("target_anchor_id")).alias("dst")), ["src", "dst"])


_FLAG = _AE + _N + ", f AS (SELECT *, day = max(day) OVER () AS is_final FROM nodes)"


def _flagged(t: Tables) -> DataFrame:
    n = _nodes(t)
    return n.crossJoin(F.broadcast(n.agg(F.max("day").alias("_l")))).withColumn("is_final", F.col("day") == F.col("_l")).drop("_l")  # one row


@R.query("m4_absorbing", _FLAG + "SELECT src, dst, p FROM edges WHERE src NOT IN (SELECT id FROM f WHERE is_final) UNION ALL SELECT id, id, 1.0 FROM f WHERE is_final")
def m4(t: Tables) -> DataFrame:
    final = _flagged(t).where("is_final")
    return markov.absorbing(V.edges(t).join(final.select(F.col("id").alias("src")), "src", "left_anti"), final)


@R.query("m5_row_sums", _FLAG + """, s AS (SELECT src AS id, sum(p) AS s FROM edges GROUP BY src), d AS (SELECT is_final, abs(coalesce(s, 0) - CASE WHEN is_final THEN 0 ELSE 1 END) AS dev FROM f LEFT JOIN s USING (id))
SELECT is_final, count(*) AS n, round(max(dev), 6) AS max_dev, round(quantile_cont(dev, 0.99), 6) AS p99_dev, count(*) FILTER (dev > 1e-6) AS over_1e6, count(*) FILTER (dev > 1e-5) AS over_1e5 FROM d GROUP BY is_final""")
def m5(t: Tables) -> DataFrame:
    return V.rounded(markov.row_sum_qc(_flagged(t), V.edges(t)))


@R.query("m6_degrees_by_time", _AE + _N + """, o AS (SELECT src AS id, count(*) AS o FROM edges GROUP BY src), i AS (SELECT dst AS id, count(*) AS i FROM edges GROUP BY dst), d AS (SELECT day, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id))
SELECT day, min(o) AS min_out, round(avg(o), 6) AS mean_out, max(o) AS max_out, min(i) AS min_in, round(avg(i), 6) AS mean_in, max(i) AS max_in FROM d GROUP BY day""")
def m6(t: Tables) -> DataFrame:
    return V.rounded(markov.degrees_by(_nodes(t), V.edges(t), "day"))


@R.query("m7_mass_by_keys", _E + """SELECT 'target_slice_id' AS key, target_slice_id AS value, round(sum(p), 6) AS mass, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'target_mouse_id', target_mouse_id, round(sum(p), 6), count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'source_time', source_time, round(sum(p), 6), count(*) FROM edges GROUP BY ALL""")
def m7(t: Tables) -> DataFrame:
    return V.rounded(markov.mass_by(V.edges(t), ["target_slice_id", "target_mouse_id", "source_time"]))


@R.query("m8_row_stats", _AE + _N + """, n AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src), d AS (SELECT coalesce(n, 0) AS n FROM nodes LEFT JOIN n USING (id))
SELECT min(d.n) AS min_nnz, median(d.n) AS median_nnz, round(quantile_cont(d.n, 0.99), 6) AS p99_nnz, max(d.n) AS max_nnz, count(*) FILTER (d.n = 0) AS zero_rows, (SELECT count(*) FROM edges WHERE p < 0) AS negative, (SELECT round(coalesce(sum(p), 0), 6) FROM edges WHERE src = dst) AS self_mass FROM d""")
def m8(t: Tables) -> DataFrame:
    return V.rounded(markov.row_stats(_nodes(t), V.edges(t)))


_DAYED = _AE + _N + ", de AS (SELECT e.src, e.dst, e.p, a.day AS source_day, b.day AS target_day FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)"


def _dayed(t: Tables) -> DataFrame:
    n = _nodes(t)
    return V.edges(t).select("src", "dst", "p").join(n.select(F.col("id").alias("src"), F.col("day").alias("source_day")), "src").join(n.select(F.col("id").alias("dst"), F.col("day").alias("target_day")), "dst")


@R.query("m9_verdict", _DAYED + """, s AS (SELECT src, sum(p) AS s, count(*) AS n FROM de GROUP BY src), r AS (SELECT max(abs(s - 1)) AS max_dev, median(n) AS median_nnz, count(*) AS n_sources, (SELECT count(*) FROM de WHERE source_day > target_day) AS backward, (SELECT count(*) FROM nodes) AS n_nodes FROM s)
SELECT round(max_dev, 6) AS max_dev, median_nnz, n_sources, backward, n_nodes, max_dev <= 1e-5 AS stochastic, backward = 0 AS forward, median_nnz BETWEEN 5 AND 50 AS density, n_sources = n_nodes AS coverage, max_dev <= 1e-5 AND backward = 0 AND median_nnz BETWEEN 5 AND 50 AND n_sources = n_nodes AS passes FROM r""")
def m9(t: Tables) -> DataFrame:
    return V.rounded(markov.kernel_verdict(_nodes(t), _dayed(t)))


@R.query("m10_self_loops", _DAYED + "SELECT src, dst, round(p / sum(p) OVER (PARTITION BY src), 6) AS p FROM de UNION ALL SELECT id, id, 1.0 FROM nodes WHERE id NOT IN (SELECT src FROM de)")
def m10(t: Tables) -> DataFrame:
    # Twelve digits first: a quotient of decimals that ends at a half goes up, though its double may lie just below.
    return V.rounded(V.rounded(markov.with_self_loops(_nodes(t), _dayed(t)), 12))


_COMPONENTS = _DAYED + ", u AS (SELECT src AS a, dst AS b FROM de UNION SELECT dst, src FROM de), w AS (WITH RECURSIVE r(id, m) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT u.a, min(r.m) FROM r JOIN u ON u.b = r.id JOIN recurring.r q ON q.id = u.a WHERE r.m < q.m GROUP BY u.a) SELECT * FROM r)"


@R.query("m11_components", _COMPONENTS + " SELECT id, m AS component FROM w")
def m11(t: Tables) -> DataFrame:
    return graph.weak_components(_nodes(t), _dayed(t))


@R.query("m12_mass_direction", _DAYED + """, m AS (SELECT sum(p) AS total, coalesce(sum(p) FILTER (target_day > source_day), 0) AS forward, coalesce(sum(p) FILTER (target_day = source_day AND src <> dst), 0) AS within, coalesce(sum(p) FILTER (target_day < source_day), 0) AS backward, coalesce(sum(p) FILTER (src = dst), 0) AS self FROM de)
SELECT round(total, 6) AS total, round(forward, 6) AS forward, round(within, 6) AS within, round(backward, 6) AS backward, round(self, 6) AS self, round(forward / total, 6) AS forward_share, round(within / total, 6) AS within_share, round(backward / total, 6) AS backward_share, round(self / total, 6) AS self_share FROM m""")
def m12(t: Tables) -> DataFrame:
    return V.rounded(markov.mass_by_direction(_dayed(t)))


@R.query("m15_within_time_graph", _A + _VEC + """, k AS (SELECT a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS r FROM u a JOIN u b ON a.day = b.day AND a.id <> b.id),
w AS (SELECT src, dst, exp(-d) AS w FROM k WHERE r <= 4) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 5) AS p FROM w""")
def m15(t: Tables) -> DataFrame:
    v = _vectors(t).select(F.col("day").cast("string").alias("time_pair"), "id", "vec")
    near = T.nearest_targets(v, v, 5).where("src <> dst")
    from pyspark.sql import Window

    near = near.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where("r <= 4").withColumnRenamed("distance", "d")
    return V.rounded(markov.similarity_graph(near), 5)


@R.query("m16_restricted", _DAYED + ", k AS (SELECT id FROM nodes WHERE l1 = 'Immune' OR l1 = 'Epithelial'), s AS (SELECT src, dst, sum(p) AS w FROM de WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY ALL) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM s")
def m16(t: Tables) -> DataFrame:
    return V.rounded(markov.restricted(_dayed(t), _nodes(t).where("l1 IN ('Immune', 'Epithelial')").select("id")))


@R.query("m17_mixture", _DAYED + """, x AS (SELECT src, dst, 0.85 * p AS w FROM de WHERE source_day = target_day UNION ALL SELECT src, dst, 0.10 * p FROM de WHERE source_day <> target_day UNION ALL SELECT id, id, 0.05 FROM nodes), s AS (SELECT src, dst, sum(w) AS w FROM x GROUP BY ALL)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 5) AS p FROM s""")
def m17(t: Tables) -> DataFrame:
    e = _dayed(t)
    # Twelve digits first, as above.
    return V.rounded(V.rounded(markov.mixture([(e.where("source_day = target_day"), 0.85), (e.where("source_day <> target_day"), 0.10)], _nodes(t), 0.05), 12), 5)


@R.query("m18_distribution", _E + "SELECT source_time, target_time, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets, round(sum(p), 6) AS mass, min(p) AS min_p, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p, max(p) AS max_p FROM edges GROUP BY ALL")
def m18(t: Tables) -> DataFrame:
    return V.rounded(markov.entry_distribution(V.edges(t), ["source_time", "target_time"]))


@R.query("c13_coarse", _DAYED + ", s AS (SELECT a.l2 AS src, b.l2 AS dst, sum(p) AS w FROM de JOIN nodes a ON de.src = a.id JOIN nodes b ON de.dst = b.id WHERE a.l2 IS NOT NULL AND b.l2 IS NOT NULL GROUP BY ALL) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM s UNION ALL SELECT l2, l2, 1.0 FROM (SELECT DISTINCT l2 FROM nodes WHERE l2 IS NOT NULL) WHERE l2 NOT IN (SELECT src FROM s)")
def c13(t: Tables) -> DataFrame:
    g = _nodes(t).where("l2 IS NOT NULL").select("id", F.col("l2").alias("group"))
    return V.rounded(markov.coarse(_dayed(t), g))


# --- fate ------------------------------------------------------------------------------------------------------------

_FATE = _DAYED + """, lay AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS layer FROM (SELECT DISTINCT day FROM nodes)), fn AS (SELECT n.*, lay.layer FROM nodes n JOIN lay USING (day)),
fe0 AS (SELECT de.src, de.dst, de.p FROM de JOIN fn a ON src = a.id JOIN fn b ON dst = b.id WHERE b.layer = a.layer + 1), fe AS (SELECT src, dst, p / sum(p) OVER (PARTITION BY src) AS p FROM fe0),
r AS (WITH RECURSIVE r AS (SELECT id, l1 AS state, 1.0::DOUBLE AS prob FROM fn WHERE layer = (SELECT max(layer) FROM fn) AND l1 IS NOT NULL UNION ALL SELECT fe.src, r.state, fe.p * r.prob FROM r JOIN fe ON fe.dst = r.id) SELECT * FROM r),
fate AS (SELECT id, state, sum(prob) AS prob FROM r GROUP BY ALL)
"""


def _fate(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = FT.layered(_nodes(t))
    lay = n.select("id", "layer")
    e = _dayed(t).join(lay.select(F.col("id").alias("src"), F.col("layer").alias("a")), "src").join(lay.select(F.col("id").alias("dst"), F.col("layer").alias("b")), "dst").where("b = a + 1")
    e = T.normalised(e, "p", "q", "drop").select("src", "dst", F.col("q").alias("p"))
    return FT.backward(e, n, FT.one_hot(markov.final_nodes(n), "l1")), n


@R.query("fate7_backward", _FATE + "SELECT id, state, round(prob, 12) AS prob FROM fate")
def p7b(t: Tables) -> DataFrame:
    return V.rounded(_fate(t)[0], 12)


_METRICS = _FATE + """, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(prob, 12) DESC, state) AS r FROM fate), q AS (SELECT id, max(state) FILTER (r = 1) AS top_state, max(prob) AS top1, coalesce(max(prob) FILTER (r = 2), 0) AS p2, sum(CASE WHEN prob > 0 THEN -prob * ln(prob) ELSE 0 END) AS h FROM k GROUP BY id)
"""


@R.query("fate9_metrics", _METRICS + "SELECT id, round(top1, 9) AS top1, round(top1 - p2, 9) AS margin, round(h, 9) AS entropy, round(greatest(least(h / ln(8), 1), 0), 9) AS norm_entropy FROM q")
def p9m(t: Tables) -> DataFrame:
    return V.rounded(FT.metrics(_fate(t)[0], 8).drop("top_state"), 9)


@R.query("fate8_sums", _FATE + ", s AS (SELECT id, sum(prob) AS s FROM fate GROUP BY id) SELECT count(*) AS n_nodes, round(min(s), 6) AS min_sum, round(max(s), 6) AS max_sum, count(*) FILTER (abs(s - 1) > 1e-6) AS off FROM s")
def p8s(t: Tables) -> DataFrame:
    return V.rounded(FT.sums_qc(_fate(t)[0]))


@R.query("fate10_by_slice", _FATE + """, n AS (SELECT slice_id, count(*) AS n FROM fn GROUP BY ALL), g AS (SELECT slice_id, state, n FROM n, (SELECT DISTINCT state FROM fate)), m AS (SELECT slice_id, state, sum(prob) AS mass FROM fate JOIN fn USING (id) GROUP BY ALL), z AS (SELECT g.*, coalesce(mass, 0) AS mass FROM g LEFT JOIN m USING (slice_id, state))
SELECT slice_id, state, round(mass / n, 6) AS mean_prob, round(mass, 6) AS mass, round(coalesce(mass / nullif(sum(mass) OVER (PARTITION BY slice_id), 0), 0), 6) AS share FROM z""")
def p10s(t: Tables) -> DataFrame:
    f, n = _fate(t)
    return V.rounded(FT.by_group(f, n, "slice_id").drop("dominant_share"))


@R.query("fate3_incoming", _FLAG + ", i AS (SELECT dst AS id, count(*) AS n, sum(p) AS m FROM edges GROUP BY dst) SELECT id, coalesce(n, 0) AS in_degree, round(coalesce(m, 0), 6) AS in_mass FROM f LEFT JOIN i USING (id) WHERE is_final")
def p3i(t: Tables) -> DataFrame:
    return V.rounded(FT.incoming(V.edges(t), _flagged(t).where("is_final")))


@R.query("fate16_state_pairs", _A + """, p AS (SELECT l1 AS s, l2 AS k, count(*)::DOUBLE AS v FROM anchors WHERE l1 IS NOT NULL AND mouse_id IS NOT NULL GROUP BY ALL), pm AS (SELECT l1 AS s, mouse_id AS k, count(*)::DOUBLE AS v FROM anchors WHERE l1 IS NOT NULL AND mouse_id IS NOT NULL GROUP BY ALL),
g AS (SELECT DISTINCT a.s AS a, b.s AS b, k.k FROM (SELECT DISTINCT s FROM pm) a JOIN (SELECT DISTINCT s FROM pm) b ON a.s < b.s, (SELECT DISTINCT k FROM pm) k), x AS (SELECT g.a, g.b, coalesce(u.v, 0) AS u, coalesce(w.v, 0) AS w FROM g LEFT JOIN pm u ON u.s = g.a AND u.k = g.k LEFT JOIN pm w ON w.s = g.b AND w.k = g.k)
SELECT a, b, round(sum(u * w) / (sqrt(sum(u * u)) * sqrt(sum(w * w))), 6) AS cosine, round(sum(abs(u - w)), 6) AS l1 FROM x GROUP BY ALL""")
def p16p(t: Tables) -> DataFrame:
    c = V.anchors(t).where("l1 IS NOT NULL AND mouse_id IS NOT NULL").groupBy("l1", "mouse_id").agg(F.count("*").cast("double").alias("v"))
    return V.rounded(FT.state_pairs(c, "l1", "mouse_id", "v"))


@R.query("fate14_annotation", _FATE + ", s AS (SELECT 'l2' AS label_kind, l2 AS label, state, sum(prob) AS m FROM fn JOIN fate USING (id) WHERE l2 IS NOT NULL GROUP BY ALL UNION ALL SELECT 'mouse_id', mouse_id, state, sum(prob) FROM fn JOIN fate USING (id) WHERE mouse_id IS NOT NULL GROUP BY ALL) SELECT label_kind, label, state, round(m / sum(m) OVER (PARTITION BY label_kind, label), 6) AS share FROM s")
def p14a(t: Tables) -> DataFrame:
    f, n = _fate(t)
    return V.rounded(FT.annotation(n, f, ["l2", "mouse_id"]))


# --- scaling ---------------------------------------------------------------------------------------------------------

_XY = _A + ", z AS (SELECT anchor_id, CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(y) THEN y END AS y, anchor_index::DOUBLE AS i FROM anchors), s AS (SELECT quantile_cont(x, .25) AS q1, quantile_cont(x, .5) AS q2, quantile_cont(x, .75) AS q3, stddev_pop(x) AS sd, avg(x) AS mu FROM z)"


@R.query("r5_robust", _XY + "SELECT anchor_id, round((x - q2) / CASE WHEN q3 - q1 > 0 THEN q3 - q1 WHEN sd > 0 THEN sd ELSE 1 END, 6) AS x FROM z, s")
def r5(t: Tables) -> DataFrame:
    return V.rounded(scaling.robust(V.anchors(t).select("anchor_id", "x"), ["x"]))


@R.query("r6_standard", _XY + "SELECT anchor_id, round(CASE WHEN sd < 1e-6 THEN 0 ELSE (x - mu) / sd END, 6) AS x FROM z, s")
def r6(t: Tables) -> DataFrame:
    return V.rounded(scaling.standard(V.anchors(t).select("anchor_id", "x"), ["x"]))


@R.query("t4_fallback_scaling", _XY + "SELECT anchor_id, round(CASE WHEN q3 - q1 > 1e-6 THEN (x - q2) / (q3 - q1) WHEN sd > 1e-6 THEN (x - mu) / sd ELSE 0 END, 6) AS x FROM z, s")
def t4(t: Tables) -> DataFrame:
    return V.rounded(scaling.fallback(V.anchors(t).select("anchor_id", "x"), ["x"]))


@R.query("f16_imputed", "SELECT edge_id, coalesce(CASE WHEN isfinite(v2_row_normalized_transition_prob) THEN v2_row_normalized_transition_prob END, (SELECT median(v2_row_normalized_transition_prob) FILTER (isfinite(v2_row_normalized_transition_prob)) FROM transition_edges), 0) AS p FROM transition_edges")
def f16(t: Tables) -> DataFrame:
    return scaling.imputed(t.transition_edges.select("edge_id", F.col("v2_row_normalized_transition_prob").alias("p")), ["p"])


@R.query("r2_pivot_scales", _E + "SELECT src, max(p) FILTER (target_time = 'D9') AS D9__p, max(p1) FILTER (target_time = 'D9') AS D9__p1, max(p) FILTER (target_time = 'D21') AS D21__p, max(p1) FILTER (target_time = 'D21') AS D21__p1 FROM edges WHERE target_time IN ('D9', 'D21') GROUP BY src")
def r2(t: Tables) -> DataFrame:
    return scaling.pivot_scales(V.edges(t), ["src"], "target_time", ["D9", "D21"], ["p", "p1"])


@R.query("g23_integrity", """WITH z AS (SELECT 'p' AS "column", v2_row_normalized_transition_prob AS v FROM transition_edges UNION ALL SELECT 'w', v2_unnormalized_weight FROM transition_edges), f AS (SELECT *, CASE WHEN isfinite(v) THEN v END AS g FROM z)
SELECT "column", count(*) AS n, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NOT NULL AND g IS NULL) AS non_finite, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS std, round(quantile_cont(g, .25), 6) AS q25, round(median(g), 6) AS median, round(quantile_cont(g, .75), 6) AS q75 FROM f GROUP BY ALL""")
def g23(t: Tables) -> DataFrame:
    e = t.transition_edges.select(F.col("v2_row_normalized_transition_prob").alias("p"), F.col("v2_unnormalized_weight").alias("w"))
    return V.rounded(gates.integrity(e, ["p", "w"]))


@R.query("c7_join_key_audit", _A + ", m AS (SELECT DISTINCT upper(trim(anchor_id)) AS anchor_id FROM anchor_to_metaniche), r AS (SELECT upper(trim(anchor_id)) AS anchor_id FROM anchor_to_metaniche), h AS (SELECT count(*) AS matched FROM anchors WHERE anchor_id IN (SELECT anchor_id FROM m)), l AS (SELECT count(*) AS n_left, count(DISTINCT anchor_id) AS dl FROM anchors), q AS (SELECT count(*) AS n_right, count(DISTINCT anchor_id) AS dr FROM r) SELECT 'anchor_id' AS key, n_left, n_right, n_left = dl AS unique_left, n_right = dr AS unique_right, matched, round(matched / n_left, 6) AS coverage, matched / n_left >= 0.999 AND n_right = dr AS valid FROM l, q, h")
def c7(t: Tables) -> DataFrame:
    return V.rounded(gates.join_key_audit(V.anchors(t), t.anchor_to_metaniche.select(F.upper(F.trim("anchor_id")).alias("anchor_id")), ["anchor_id"]))


@R.query("g19_pca")
def g19(t: Tables) -> DataFrame:
    return scaling.principal_components(_vectors(t).select("id", "vec"), "vec", 48, 10).select("id", "pcs")
