"""Queries on niches: coordinates, graphs, neighbourhoods, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions import scalars as S
from cellweft.operators import diversity as D
from cellweft.operators import spatial as G
from cellweft.plans import views as V
from cellweft.plans.registry import Registry, Tables
from cellweft.plans.views import current_vectors

R = Registry()

_W = "WITH " + V.ANCHORS
_POINTS = _W + ", pts AS (SELECT slice_id AS g, anchor_id AS id, x, y, l1, l2, l3 FROM anchors WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y))"
_RADIUS = 300.0
_NEAR = _POINTS + f", e AS (SELECT a.g, a.id AS src, b.id AS dst, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS d FROM pts a JOIN pts b ON a.g = b.g AND a.id <> b.id AND (a.x-b.x)**2 + (a.y-b.y)**2 <= {_RADIUS}**2)"
_NN = _POINTS + ", nn AS (SELECT a.g, a.id AS src, b.id AS dst, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS d, row_number() OVER (PARTITION BY a.g, a.id ORDER BY (a.x-b.x)**2 + (a.y-b.y)**2, b.id) AS rank FROM pts a JOIN pts b ON a.g = b.g AND a.id <> b.id)"


def _pts(t: Tables) -> DataFrame:
    return G.located(V.anchors(t), "slice_id", "anchor_id", "x", "y", "l1", "l2", "l3")


@R.query("s3_counts_by_type", _W + "SELECT l1, count(*) AS count FROM anchors GROUP BY ALL")
def s3_counts(t: Tables) -> DataFrame:
    return D.value_counts(V.anchors(t), "l1")


@R.query("f2_tokens", _W + "SELECT l2, coalesce(nullif(lower(trim(regexp_replace(l2, '[^0-9A-Za-z]+', '_', 'g'), '_')), ''), 'na') AS token, regexp_replace(anchor_id, '[^0-9A-Za-z._-]', '_', 'g') AS file FROM anchors")
def f2_tokens(t: Tables) -> DataFrame:
    return V.anchors(t).select("l2", S.token("l2").alias("token"), S.file_name("anchor_id").alias("file"))


@R.query("f18_quadrants", _POINTS + """, r AS (SELECT id, g, count(*) OVER (PARTITION BY g) AS n,
  rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM pts)
SELECT id, CASE WHEN rx * 3 <= n THEN 'left' WHEN rx * 3 <= 2 * n THEN 'middle' ELSE 'right' END || '_' || CASE WHEN ry * 3 <= n THEN 'low' WHEN ry * 3 <= 2 * n THEN 'mid' ELSE 'high' END AS quadrant FROM r""")
def f18_quadrants(t: Tables) -> DataFrame:
    return _pts(t).select("id", S.quadrant("x", "y", ["group"]).alias("quadrant"))


@R.query("g2_normalised", _POINTS + """, m AS (SELECT g, median(x) AS mx, median(y) AS my FROM pts GROUP BY g), c AS (SELECT p.*, x - mx AS cx, y - my AS cy FROM pts p JOIN m USING (g)),
s AS (SELECT g, median(sqrt(cx**2 + cy**2)) AS s FROM c GROUP BY g)
SELECT id, round(cx / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS xn, round(cy / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS yn FROM c JOIN s USING (g)""")
def g2_normalised(t: Tables) -> DataFrame:
    return V.rounded(G.normalised(_pts(t)).select("id", "xn", "yn"))


@R.query("g3_first_neighbour", _NN + "SELECT g AS slice_id, round(median(d), 6) AS r FROM nn WHERE rank = 1 GROUP BY g")
def g3_first_neighbour(t: Tables) -> DataFrame:
    return V.rounded(G.first_neighbour_distance(_pts(t)).withColumnRenamed("group", "slice_id"))


@R.query("g4_within_radius", _NEAR + "SELECT src, dst, round(d, 6) AS d FROM e")
def g4_within_radius(t: Tables) -> DataFrame:
    return V.rounded(G.within_radius(_pts(t), _RADIUS).select("src", "dst", "d"))


@R.query("g5_symmetric_knn", _NN + ", s AS (SELECT src, dst, d FROM nn WHERE rank <= 6 UNION SELECT dst, src, d FROM nn WHERE rank <= 6) SELECT src, dst, round(min(d), 6) AS d FROM s GROUP BY ALL")
def g5_symmetric_knn(t: Tables) -> DataFrame:
    return V.rounded(G.symmetric(G.nearest(_pts(t), 6)).select("src", "dst", "d"))


@R.query("g6_delaunay")
def g6_delaunay(t: Tables) -> DataFrame:
    return G.delaunay(_pts(t))


@R.query("g7_degrees", _NEAR + """, d AS (SELECT p.g, p.id, count(e.dst) AS degree FROM pts p LEFT JOIN e ON p.g = e.g AND p.id = e.src GROUP BY ALL)
SELECT g AS slice_id, count(*) AS n_nodes, CAST(floor(sum(degree) / 2) AS BIGINT) AS n_edges, round(avg(degree), 6) AS mean_degree, median(degree) AS median_degree, max(degree) AS max_degree FROM d GROUP BY g""")
def g7_degrees(t: Tables) -> DataFrame:
    p = _pts(t)
    return V.rounded(G.degree_summary(p, G.within_radius(p, _RADIUS)).withColumnRenamed("group", "slice_id"))


_GROUPS = _NN + ", mem AS (SELECT g, src AS anchor, dst AS member, 'member' AS role FROM nn WHERE rank <= 4 UNION ALL SELECT g, id, id, 'center' FROM pts)"


@R.query("g8_neighbour_groups", _GROUPS + "SELECT anchor, member, role, g || '__' || anchor || '__k5' AS group_id FROM mem")
def g8_groups(t: Tables) -> DataFrame:
    return G.neighbour_groups(_pts(t), 5).drop("group")


@R.query("g9_multiplicity", _GROUPS + ", n AS (SELECT g, member, count(DISTINCT anchor) AS n FROM mem GROUP BY ALL) SELECT count(*) AS n_points, round(avg(n), 6) AS mean_groups, median(n) AS median_groups, max(n) AS max_groups FROM n")
def g9_multiplicity(t: Tables) -> DataFrame:
    return V.rounded(G.multiplicity(G.neighbour_groups(_pts(t), 5)))


@R.query("g10_tiles", _POINTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, id) AS rx, row_number() OVER (PARTITION BY g ORDER BY y, id) AS ry, count(*) OVER (PARTITION BY g) AS n FROM pts),
b AS (SELECT id, g, x, y, CAST(greatest(((rx - 1) * 10 + n - 2) // (n - 1) - 1, 0) AS INTEGER) AS tile_x, CAST(greatest(((ry - 1) * 10 + n - 2) // (n - 1) - 1, 0) AS INTEGER) AS tile_y FROM r)
SELECT g || '__tile_x' || lpad(CAST(tile_x AS VARCHAR), 2, '0') || '_y' || lpad(CAST(tile_y AS VARCHAR), 2, '0') AS tile_id, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM b GROUP BY ALL""")
def g10_tiles(t: Tables) -> DataFrame:
    return V.rounded(G.tiles(_pts(t), 10).groupBy("tile_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")))


@R.query("g11_neighbour_arrays", _NEAR + ", m AS (SELECT src AS anchor, dst AS member FROM e UNION SELECT id, id FROM pts) SELECT anchor, list(member ORDER BY member) AS members FROM m GROUP BY anchor")
def g11_arrays(t: Tables) -> DataFrame:
    p = _pts(t)
    return G.neighbour_arrays(G.with_self(p, G.within_radius(p, _RADIUS))).drop("group")


_MEM = _NEAR + ", m AS (SELECT g, src AS anchor, dst AS member, d FROM e UNION ALL SELECT g, id, id, 0.0 FROM pts)"


@R.query("g12_composition", _MEM + """, v AS (SELECT m.anchor, p.l1 FROM m JOIN pts p ON m.g = p.g AND m.member = p.id)
SELECT anchor, coalesce(count(*) FILTER (l1 = 'Epithelial') / nullif(count(l1), 0), 0) AS ct_l1__epithelial, coalesce(count(*) FILTER (l1 = 'Fibroblast') / nullif(count(l1), 0), 0) AS ct_l1__fibroblast, coalesce(count(*) FILTER (l1 = 'Immune') / nullif(count(l1), 0), 0) AS ct_l1__immune FROM v GROUP BY anchor""")
def g12_composition(t: Tables) -> DataFrame:
    p = _pts(t)
    return G.composition_columns(p, G.with_self(p, G.within_radius(p, _RADIUS)), "l1", ["Epithelial", "Fibroblast", "Immune"], "ct_l1").drop("group")


def _ent(label: str) -> str:
    return f""", c_{label} AS (SELECT m.anchor, p.{label}, count(*) AS n FROM m JOIN pts p ON m.g = p.g AND m.member = p.id WHERE p.{label} IS NOT NULL GROUP BY ALL),
s_{label} AS (SELECT anchor, count(*) AS {label}_richness, round(CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0 END, 6) AS {label}_entropy, round(max(n) / sum(n), 6) AS {label}_top_share FROM c_{label} GROUP BY anchor)"""


@R.query("g17_niche_features", _MEM + _ent("l1") + _ent("l2") + """, b AS (SELECT anchor, count(*) AS n_neighbors, coalesce(avg(d) FILTER (anchor <> member), 0) AS md FROM m GROUP BY anchor)
SELECT anchor, n_neighbors, round(md, 6) AS mean_distance, l1_richness, l1_entropy, l1_top_share, l2_richness, l2_entropy, l2_top_share FROM b LEFT JOIN s_l1 USING (anchor) LEFT JOIN s_l2 USING (anchor)""")
def g17_features(t: Tables) -> DataFrame:
    p = _pts(t)
    return V.rounded(G.neighbour_features(p, G.with_self(p, G.within_radius(p, _RADIUS)), ["l1", "l2"]).drop("group", "pseudo_density"))


@R.query("g14_mean_variance", _MEM + """, v AS (SELECT upper(trim(anchor_id)) AS id, CAST(features AS DOUBLE[]) AS vec FROM niche_anchors QUALIFY row_number() OVER (PARTITION BY upper(trim(anchor_id)) ORDER BY rep_version DESC NULLS LAST) = 1),
u AS (SELECT id, vec FROM v WHERE len(vec) = 48 AND len(list_filter(vec, lambda x: NOT isfinite(x) OR x IS NULL)) = 0), k AS (SELECT m.anchor, u.vec FROM m JOIN u ON m.member = u.id JOIN u o ON o.id = m.anchor), z AS (SELECT anchor, unnest(range(1, 49)) AS i, unnest(vec) AS x FROM k), g AS (SELECT anchor, i, avg(x) AS a, var_pop(x) AS s FROM z GROUP BY ALL)
SELECT anchor, list(round(a, 5) ORDER BY i) AS mean_vector, list(round(s, 5) ORDER BY i) AS var_vector FROM g GROUP BY anchor""")
def g14_mean_variance(t: Tables) -> DataFrame:
    p = _pts(t).join(current_vectors(t).select("id", "vec"), "id")
    f = G.neighbour_features(p, G.with_self(p, G.within_radius(p, _RADIUS)), [], "vec")
    five = lambda c: F.transform(c, lambda x: S.signed_round(x, 5)).alias(c)
    return f.select("anchor", five("mean_vector"), five("var_vector"))


@R.query("g16_topology", _NEAR + """, d AS (SELECT p.g, p.id, count(e.dst) AS degree FROM pts p LEFT JOIN e ON p.g = e.g AND p.id = e.src GROUP BY ALL)
SELECT d.id, d.degree, round(coalesce(avg(o.degree), 0), 6) AS neighbour_degree FROM d LEFT JOIN e ON e.src = d.id LEFT JOIN d o ON o.id = e.dst GROUP BY ALL""")
def g16_topology(t: Tables) -> DataFrame:
    p = _pts(t)
    return V.rounded(G.mean_neighbour_degree(p, G.within_radius(p, _RADIUS)).drop("group"))


_DIV = """SELECT {g}, CAST(sum(n) AS BIGINT) AS total, count(*) AS richness, arg_min({l}, (-n, {l})) AS dominant, round(max(n) / sum(n), 6) AS dominant_share, round(CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0 END, 6) AS entropy,
  round(CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0 END, 6) AS norm_entropy, round(CASE WHEN count(*) > 1 THEN 1 - sum(n * n) / sum(n)**2 ELSE 0 END, 6) AS simpson FROM c GROUP BY {g}"""


@R.query("f12_diversity_by_slice", _W + ", c AS (SELECT slice_id, l2, count(*) AS n FROM anchors WHERE l2 IS NOT NULL GROUP BY ALL)" + _DIV.format(g="slice_id", l="l2"))
def f12_diversity(t: Tables) -> DataFrame:
    return V.rounded(D.diversity(D.label_counts(V.anchors(t), ["slice_id"], "l2"), ["slice_id"], "l2").drop("distribution"))


@R.query("f14_distribution_text", _W + """, c AS (SELECT slice_id, l2, count(*) AS n, row_number() OVER (PARTITION BY slice_id ORDER BY count(*) DESC, l2) AS r FROM anchors WHERE l2 IS NOT NULL GROUP BY slice_id, l2)
SELECT slice_id, string_agg(l2 || ':' || n, ';' ORDER BY r) FILTER (r <= 5) || coalesce(';other:' || CAST(sum(n) FILTER (r > 5) AS BIGINT), '') AS distribution FROM c GROUP BY slice_id""")
def f14_text(t: Tables) -> DataFrame:
    return D.diversity(D.label_counts(V.anchors(t), ["slice_id"], "l2"), ["slice_id"], "l2").select("slice_id", "distribution")


@R.query("fate15_contingency", _W + """, c AS (SELECT l1, mouse_id, count(*) AS n FROM anchors WHERE l1 IS NOT NULL AND mouse_id IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY l1) AS a, sum(n) OVER (PARTITION BY mouse_id) AS b, sum(n) OVER () AS t FROM c)
SELECT l1, mouse_id, n, round(n / a, 6) AS share_of_a, round(n / b, 6) AS share_of_b, round(a * b / t, 6) AS expected, round(n / (a * b / t), 6) AS enrichment FROM m""")
def p15_contingency(t: Tables) -> DataFrame:
    return V.rounded(D.contingency(V.anchors(t), "l1", "mouse_id"))


@R.query("c19_agreement", _W + """, c AS (SELECT l1, slice_id, count(*)::DOUBLE AS n FROM anchors WHERE l1 IS NOT NULL GROUP BY ALL), a AS (SELECT l1, sum(n) AS n FROM c GROUP BY ALL), b AS (SELECT slice_id, sum(n) AS n, max(n) AS m FROM c GROUP BY ALL),
t AS (SELECT sum(n) AS N, sum(n * ln(n)) AS hab, sum(n * (n - 1) / 2) AS sab FROM c), ta AS (SELECT sum(n * ln(n)) AS ha, sum(n * (n - 1) / 2) AS sa FROM a), tb AS (SELECT sum(n * ln(n)) AS hb, sum(n * (n - 1) / 2) AS sb, sum(m) AS m FROM b)
SELECT CAST(N AS BIGINT) AS n, round(m / N, 6) AS purity, round(((ln(N) - ha / N) + (ln(N) - hb / N) - (ln(N) - hab / N)) / (((ln(N) - ha / N) + (ln(N) - hb / N)) / 2), 6) AS nmi,
  round((sab - sa * sb / (N * (N - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (N * (N - 1) / 2)), 6) AS ari FROM t, ta, tb""")
def c19_agreement(t: Tables) -> DataFrame:
    return V.rounded(D.agreement(V.anchors(t), "slice_id", "l1"))


@R.query("c8_rare_states", _W + """, c AS (SELECT slice_id, l3, count(*) AS n FROM anchors WHERE l3 IS NOT NULL GROUP BY ALL), z AS (SELECT slice_id, sum(n) AS size FROM c GROUP BY ALL), q AS (SELECT median(size) AS mid FROM z),
t AS (SELECT l3, sum(n) AS total FROM c GROUP BY ALL), r AS (SELECT * FROM t WHERE total < greatest(10, ceil(0.01 * (SELECT sum(n) FROM c)))),
h AS (SELECT c.*, r.total, row_number() OVER (PARTITION BY l3 ORDER BY n DESC, slice_id) AS k FROM c JOIN r USING (l3))
SELECT l3, CAST(total AS BIGINT) AS n, slice_id AS host, round(n / total, 6) AS host_share, n / total >= 0.75 AND size > greatest(20.0, 2 * mid) AS collapsed FROM h JOIN z USING (slice_id), q WHERE k = 1""")
def c8_rare(t: Tables) -> DataFrame:
    return V.rounded(D.rare_labels(D.label_counts(V.anchors(t), ["slice_id"], "l3"), "slice_id", "l3"))


@R.query("g18_vocabulary", _W + "SELECT coalesce(nullif(lower(trim(regexp_replace(l2, '[^0-9A-Za-z]+', '_', 'g'), '_')), ''), 'na') AS token, count(*) AS n_cells, count(DISTINCT slice_id) AS n_slices FROM anchors GROUP BY ALL")
def g18_vocabulary(t: Tables) -> DataFrame:
    return V.anchors(t).groupBy(S.token("l2").alias("token")).agg(F.count("*").alias("n_cells"), F.countDistinct("slice_id").alias("n_slices"))
