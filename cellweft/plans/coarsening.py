"""Queries on coarse states, comparisons and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.keys import key
from cellweft.operators import coarsen as C
from cellweft.operators import compare as B
from cellweft.operators import gates
from cellweft.operators.markov import coarse
from cellweft.plans import views as V
from cellweft.plans.registry import Registry, Tables
from cellweft.plans.transitions import _dayed, _vectors
from cellweft.sources import tables as IO
from cellweft.streaming import windows as ST

R = Registry()
_A = "WITH " + V.ANCHORS
_E = "WITH " + V.EDGES


@R.query("c1_cluster_counts", _A + ", n AS (SELECT slice_id, count(*) AS n FROM anchors GROUP BY ALL), m AS (SELECT avg(n) AS m FROM n) SELECT slice_id, n, CAST(greatest(least(round_even(100 * sqrt(n / m), 0), 150), 50) AS INTEGER) AS k, CAST(greatest(least(round_even(sqrt(n) / 64, 0) * 64, 2048), 512) AS INTEGER) AS preflight FROM n, m")
def c1(t: Tables) -> DataFrame:
    n = V.anchors(t).groupBy("slice_id").agg(F.count("*").alias("n"))
    m = n.agg(F.avg("n").alias("_m"))
    return n.crossJoin(F.broadcast(m)).select("slice_id", "n", C.cluster_count(F.col("n"), F.col("_m")).alias("k"), C.preflight_count(F.col("n")).alias("preflight"))  # one row


_PTS = _A + ", pt AS (SELECT anchor_id, slice_id, l1, l2, x, y, [x, y] AS v FROM anchors WHERE isfinite(x) AND isfinite(y)), cen AS (SELECT row_number() OVER (ORDER BY md5('1|' || anchor_id), anchor_id) - 1 AS state, v AS c FROM pt QUALIFY row_number() OVER (ORDER BY md5('1|' || anchor_id), anchor_id) <= 12), asg AS (SELECT anchor_id, state, sqrt((v[1] - c[1])**2 + (v[2] - c[2])**2) AS d FROM pt, cen QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY sqrt((v[1] - c[1])**2 + (v[2] - c[2])**2), state) = 1)"


def _pts(t: Tables) -> DataFrame:
    return V.anchors(t).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").withColumn("v", F.array("x", "y"))


def _assigned(t: Tables) -> DataFrame:
    p = _pts(t)
    return C.nearest_centroid(p, C.seeded_centroids(p, "anchor_id", "v", 12), "anchor_id", "v")


@R.query("c3_fixed_centroids", _PTS + "SELECT anchor_id, CAST(state AS INTEGER) AS state, round(d, 6) AS distance FROM asg")
def c3(t: Tables) -> DataFrame:
    return V.rounded(_assigned(t).select("anchor_id", F.col("state").cast("int").alias("state"), "distance"))


@R.query("c3_state_summary", _PTS + """, j AS (SELECT pt.*, state FROM pt JOIN asg USING (anchor_id)), l AS (SELECT state, l1, count(*) AS c FROM j WHERE l1 IS NOT NULL GROUP BY ALL), d AS (SELECT state, arg_min(l1, (-c, l1)) AS dominant_l1, max(c) / sum(c) AS p FROM l GROUP BY state)
SELECT CAST(state AS INTEGER) AS state, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(var_pop(x) + var_pop(y), 4) AS spread, round(count(*) / (SELECT count(*) FROM j), 6) AS share, any_value(dominant_l1) AS dominant_l1, round(any_value(p), 6) AS purity_l1 FROM j LEFT JOIN d USING (state) GROUP BY state""")
def c3s(t: Tables) -> DataFrame:
    j = _pts(t).join(_assigned(t).select("anchor_id", F.col("state").cast("int").alias("state")), "anchor_id")
    s = C.state_summary(j, "state", ["l1"])
    return V.rounded(s.withColumn("spread", F.round("spread", 4)))


@R.query("c4_kmeans")
def c4(t: Tables) -> DataFrame:
    return C.kmeans(_vectors(t).select("id", "vec"), "id", "vec", 12, rounds=5)[0]


@R.query("c5_state_qc", _PTS + """, n AS (SELECT state, count(*) AS n FROM asg GROUP BY ALL), a AS (SELECT count(*)::DOUBLE AS k, median(n)::DOUBLE AS m, avg((n < 10)::INT)::DOUBLE AS t, max(n) / sum(n) AS l FROM n)
SELECT 'n_states' AS metric, k AS value, 'PASS' AS status FROM a UNION ALL SELECT 'median_size', m, CASE WHEN m >= 10 THEN 'PASS' ELSE 'WARN' END FROM a UNION ALL SELECT 'tiny_share', round(t, 6), CASE WHEN t <= 0.1 THEN 'PASS' ELSE 'WARN' END FROM a UNION ALL SELECT 'largest_share', round(l, 6), CASE WHEN l <= 0.15 THEN 'PASS' ELSE 'WARN' END FROM a""")
def c5(t: Tables) -> DataFrame:
    j = _pts(t).join(_assigned(t).select("anchor_id", "state"), "anchor_id")
    return V.rounded(C.state_qc(C.state_summary(j, "state", [])))


@R.query("c6_compactness", _PTS + """, j AS (SELECT state, x, y FROM pt JOIN asg USING (anchor_id)), c AS (SELECT state, avg(x) AS cx, avg(y) AS cy FROM j GROUP BY ALL), r AS (SELECT state, sqrt((x - cx)**2 + (y - cy)**2) AS r FROM j JOIN c USING (state)), s AS (SELECT state, count(*) AS n, median(r) AS m, quantile_cont(r, .9) AS p FROM r GROUP BY ALL), l AS (SELECT greatest(2 * median(p), quantile_cont(p, .9)) AS l FROM s)
SELECT CAST(state AS INTEGER) AS state, n, round(m, 5) AS median_r, round(p, 5) AS p90_r, p > l AS diffuse FROM s, l""")
def c6(t: Tables) -> DataFrame:
    j = _pts(t).join(_assigned(t).select("anchor_id", F.col("state").cast("int").alias("state")), "anchor_id")
    return V.rounded(C.compactness(j, "state"), 5)


@R.query("c9_across_scales", "WITH r AS (SELECT upper(trim(anchor_id)) AS id, rep_version AS s, x, y FROM niche_anchors) SELECT id, count(DISTINCT s) AS scales, round(max(x) - min(x), 6) AS dx, round(max(y) - min(y), 6) AS dy, max(x) - min(x) <= 1e-6 AND max(y) - min(y) <= 1e-6 AS consistent FROM r GROUP BY id")
def c9(t: Tables) -> DataFrame:
    return V.rounded(C.moved_across_scales(t.niche_anchors.select(key("anchor_id").alias("id"), F.col("rep_version").alias("s"), "x", "y"), "id", "s"))


@R.query("c12_size_grid", _PTS + """, j AS (SELECT slice_id, CAST(state AS INTEGER) AS state FROM pt JOIN asg USING (anchor_id)), n AS (SELECT slice_id, state, count(*) AS n FROM j GROUP BY ALL), g AS (SELECT slice_id, CAST(s AS INTEGER) AS state FROM (SELECT DISTINCT slice_id FROM j), range(12) r(s)), z AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (slice_id, state)), q AS (SELECT slice_id, median(n) AS m, sum(n) AS t FROM z GROUP BY ALL)
SELECT slice_id, state, n, round(n / t, 6) AS share, round(coalesce(n / nullif(m, 0), 0), 6) AS ratio FROM z JOIN q USING (slice_id)""")
def c12(t: Tables) -> DataFrame:
    j = _pts(t).join(_assigned(t).select("anchor_id", "state"), "anchor_id")
    return V.rounded(C.size_grid(j, "slice_id", "state", 12))


@R.query("c23_representative", _A + ", n AS (SELECT time, slice_id, count(*) AS n FROM anchors GROUP BY ALL), m AS (SELECT time, median(n) AS m FROM n GROUP BY ALL) SELECT time, slice_id, n FROM n JOIN m USING (time) QUALIFY row_number() OVER (PARTITION BY time ORDER BY abs(n - m), slice_id) = 1")
def c23(t: Tables) -> DataFrame:
    return C.representative_groups(V.anchors(t), "time", "slice_id")


@R.query("c15_macrostates")
def c15(t: Tables) -> DataFrame:
    import pandas as pd

    a = V.anchors(t).where("l2 IS NOT NULL").select(F.col("anchor_id").alias("id"), F.col("l2").alias("group"))
    names, p = C.coarse_matrix(coarse(_dayed(t), a))
    m = C.macrostates(p, 4)["memberships"]
    return C.projected(a.withColumnRenamed("group", "state"), pd.DataFrame({"state": names, "m": list(m)}))


_RANKS = _E + ", ra AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) AS rank FROM edges QUALIFY rank <= 10), rb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY coalesce(CASE WHEN isfinite(p1) THEN p1 END, 0) DESC, dst) AS rank FROM edges QUALIFY rank <= 10)"


def _ranks(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    from cellweft.functions.scalars import finite

    e = V.edges(t)

    def top(order: F.Column) -> DataFrame:  # type: ignore[name-defined]
        return e.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(order.desc(), "dst"))).where("rank <= 10").select("src", "dst", "rank")

    return top(F.col("p")), top(F.coalesce(finite("p1"), F.lit(0.0)))


@R.query("b1_candidate_overlap", _RANKS + ", na AS (SELECT src, count(*) AS na, arg_min(dst, rank) AS ta FROM ra GROUP BY src), nb AS (SELECT src, count(*) AS nb, arg_min(dst, rank) AS tb FROM rb GROUP BY src), m AS (SELECT ra.src, count(*) AS m FROM ra JOIN rb ON ra.src = rb.src AND ra.dst = rb.dst GROUP BY ALL) SELECT src, round(coalesce(m, 0) / na, 6) AS recall, round(coalesce(m, 0) / (na + nb - coalesce(m, 0)), 6) AS jaccard, ta = tb AS top1_same FROM na JOIN nb USING (src) LEFT JOIN m USING (src)")
def b1(t: Tables) -> DataFrame:
    return V.rounded(B.candidate_overlap(*_ranks(t)).drop("rank_correlation"))


_DRIFT = _E + ", a AS (SELECT src, dst, p FROM edges), b AS (SELECT src, dst, p1 AS p FROM edges WHERE p1 > 0 AND p1 <= 1), d AS (SELECT src, dst, coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb, abs(coalesce(b.p, 0) - coalesce(a.p, 0)) AS drift FROM a FULL JOIN b USING (src, dst))"


def _drift(t: Tables) -> DataFrame:
    e = V.edges(t)
    return B.drift(e.select("src", "dst", "p"), e.where("p1 > 0 AND p1 <= 1").select("src", "dst", F.col("p1").alias("p")))


@R.query("b2_drift", _DRIFT + "SELECT src, dst, pa, pb, round(drift, 6) AS drift FROM d")
def b2(t: Tables) -> DataFrame:
    return _drift(t).withColumn("drift", F.round("drift", 6))


@R.query("b2_drift_summary", _DRIFT + "SELECT count(*) AS n, count(*) FILTER (pa > 0 AND pb = 0) AS only_a, count(*) FILTER (pa = 0 AND pb > 0) AS only_b, round(avg(drift), 6) AS mean, round(median(drift), 6) AS median, round(quantile_cont(drift, .95), 6) AS p95 FROM d")
def b2s(t: Tables) -> DataFrame:
    return V.rounded(B.drift_summary(_drift(t)))


@R.query("b3_plausibility", "WITH " + V.ANCHORS + "," + V.EDGES + ", e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) AS r FROM edges), s AS (SELECT src, max((a.l1 = b.l1)::INT) FILTER (r = 1) AS top, coalesce(sum(p) FILTER (a.l1 = b.l1), 0) / sum(p) AS own FROM e JOIN anchors a ON src = a.anchor_id JOIN anchors b ON dst = b.anchor_id WHERE a.l1 IS NOT NULL AND b.l1 IS NOT NULL GROUP BY src) SELECT count(*) AS n, round(avg(top), 6) AS top_agreement, round(avg(own), 6) AS own_mass FROM s")
def b3(t: Tables) -> DataFrame:
    return V.rounded(B.plausibility(V.edges(t), V.anchors(t).select(F.col("anchor_id").alias("id"), "l1"), "l1"))


@R.query("b4_with_overall", _E + ", s AS (SELECT source_time, src, count(*) AS n, max(p) AS m FROM edges GROUP BY ALL), b AS (SELECT * FROM s UNION ALL SELECT 'global', src, n, m FROM s) SELECT source_time, round(sum(m * n) / sum(n), 6) AS top1, count(*) AS n_sources, round(sum(m * n) / sum(n), 9) >= 0.05 AS top1_ok, round(sum(m * n) / sum(n), 9) >= 0.05 AS all_pass FROM b GROUP BY ALL")
def b4(t: Tables) -> DataFrame:
    s = V.edges(t).groupBy("source_time", "src").agg(F.count("*").alias("n"), F.max("p").alias("m"))
    w = B.with_overall(s, "source_time", {"top1": F.round(B.weighted_mean("m", "n"), 9), "n_sources": F.count("*")})
    return V.rounded(B.flags(w, {"top1": (">=", 0.05)}))


@R.query("b6_mass_shift", _E + ", a AS (SELECT source_time, target_slice_id, avg(p) AS va FROM edges GROUP BY ALL), b AS (SELECT source_time, target_slice_id, avg(p1) AS vb FROM edges WHERE isfinite(p1) GROUP BY ALL) SELECT source_time, round(max(abs(coalesce(vb, 0) - coalesce(va, 0))), 6) AS shift FROM a FULL JOIN b USING (source_time, target_slice_id) WHERE target_slice_id IS NOT NULL GROUP BY ALL")
def b6(t: Tables) -> DataFrame:
    e = V.edges(t).where("target_slice_id IS NOT NULL")
    ok = e.where("p1 IS NOT NULL AND NOT isnan(p1) AND abs(p1) < double('infinity')").select("source_time", "target_slice_id", F.col("p1").alias("v"))
    return V.rounded(B.mass_shift(e.select("source_time", "target_slice_id", F.col("p").alias("v")), ok, ["source_time", "target_slice_id"], "v").drop("where"))


_CB = ("sample_id", "slice_id", "section_order", "cellbin_id", "x", "y", "registered_at", "deleted_at")


@R.query("s4_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS filled FROM cellbins" for c in _CB))
def s4(t: Tables) -> DataFrame:
    return IO.profile(t.cellbins).select("column", "n", "filled")


@R.query("s12_selected_rows", "SELECT edge_id FROM transition_edges WHERE upper(trim(source_anchor_id)) IN (SELECT upper(trim(anchor_id)) FROM atlas_anchors)")
def s12(t: Tables) -> DataFrame:
    e = t.transition_edges.select("edge_id", key("source_anchor_id").alias("anchor_id"))
    return IO.selected_rows(e, t.atlas_anchors.select(key("anchor_id").alias("anchor_id")), ["anchor_id"]).select("edge_id")


@R.query("s14_snapshot_diff", "WITH a AS (SELECT DISTINCT upper(trim(anchor_id)) AS id, cell_type_l1 AS l FROM anchor_to_metaniche QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(l, '')) = 1), b AS (SELECT DISTINCT upper(trim(anchor_id)) AS id, cell_type_l1 AS l FROM niche_anchors QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(l, '')) = 1) SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.l IS DISTINCT FROM b.l")
def s14(t: Tables) -> DataFrame:
    def one(d: DataFrame) -> DataFrame:
        d = d.select(key("anchor_id").alias("id"), F.col("cell_type_l1").alias("l"))
        return d.groupBy("id").agg(F.min_by(F.struct("l"), F.coalesce("l", F.lit(""))).alias("r")).select("id", "r.l")

    return gates.snapshot_diff(one(t.anchor_to_metaniche), one(t.niche_anchors), "id", ["l"])


@R.query("events_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(t: Tables) -> DataFrame:
    return ST.tumbling_counts(t.events, "ts", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
