"""Markov objects as edge tables (src, dst, p). No matrix is ever built of more than a coarse state space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.quantiles import with_quantiles
from cellweft.operators.transitions import exact_sum, normalised
from cellweft.session import cut


def dense_index(df: DataFrame, order: Sequence[str], out: str = "node_index") -> DataFrame:
    """Adds a dense 0-based index by ``order`` (ending in a unique column) without one task seeing all rows (M1).

    Rows are range-partitioned, numbered within partitions, and shifted by the sizes of earlier partitions, of which there is one
    number each.
    """
    part = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rn = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return part.withColumn("_rn", rn).join(F.broadcast(start), "_p").withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_p", "_rn", "_start")  # start: a row a partition


def final_nodes(nodes: DataFrame, day: str = "day") -> DataFrame:
    """Nodes of the last day (P1): a scalar maximum joined as one row."""
    last = nodes.agg(F.max(day).alias("_last"))
    return nodes.crossJoin(F.broadcast(last)).where(F.col(day) == F.col("_last")).drop("_last")


def endpoint_audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, edges without a source node, edges without a target node (M2)."""
    n = nodes.select("id").distinct()
    s = edges.join(n.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(n.select(F.col("id").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return s.agg(F.count("*").alias("n_edges"), F.count_if(F.col("_s").isNull()).alias("no_source"), F.count_if(F.col("_d").isNull()).alias("no_target"))


def absorbing(edges: DataFrame, final: DataFrame) -> DataFrame:
    """Edges and a self-loop of weight 1 for each final node (M4). A final node with out-edges is an error for the caller's gate."""
    return edges.select("src", "dst", "p").unionByName(final.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("p")))


def row_sum_qc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per ``is_final``: nodes, largest and p99 deviation of row sums from 1 (0 for final nodes), counts over 1e-6 and 1e-5 (M5)."""
    s = edges.groupBy(F.col("src").alias("id")).agg(F.sum("p").alias("s"))
    want = F.when(F.col("is_final"), 0.0).otherwise(1.0)
    d = nodes.select("id", "is_final").join(s, "id", "left").withColumn("dev", F.abs(F.coalesce("s", F.lit(0.0)) - want))
    a = d.groupBy("is_final").agg(F.count("*").alias("n"), F.max("dev").alias("max_dev"), F.count_if(F.col("dev") > 1e-6).alias("over_1e6"), F.count_if(F.col("dev") > 1e-5).alias("over_1e5"))
    return with_quantiles(a, d, ["is_final"], "dev", p99_dev=0.99)


def degrees_by(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Per ``key`` of nodes: smallest, mean and largest in- and out-degree, nodes without edges included (M6)."""
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    d = nodes.select("id", key).join(o, "id", "left").join(i, "id", "left").na.fill(0, ["o", "i"])
    return d.groupBy(key).agg(*[f(c).alias(f"{n}_{w}") for c, w in (("o", "out"), ("i", "in")) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


def mass_by(edges: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """(key, value, mass, n) over each of ``keys`` at once, one shuffle of compact sums (M7)."""
    long = edges.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), F.col(p).alias("_p")) for k in keys])).alias("e")).select("e.*")
    return long.groupBy("key", "value").agg(F.sum("_p").alias("mass"), F.count("*").alias("n"))


def row_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: targets per node (min, median, p99, max), nodes without any, negative entries, self mass (M8)."""
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    d = nodes.select("id").join(n, "id", "left").na.fill(0, ["n"])
    a = with_quantiles(d.agg(F.min("n").alias("min_nnz"), F.max("n").alias("max_nnz"), F.count_if(F.col("n") == 0).alias("zero_rows")), d, [], "n", median_nnz=0.5, p99_nnz=0.99)
    b = edges.agg(F.count_if(F.col("p") < 0).alias("negative"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("p"))), F.lit(0.0)).alias("self_mass"))
    return a.crossJoin(b)  # one row each


def kernel_verdict(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-5, low: int = 5, high: int = 50) -> DataFrame:
    """One row of checks of a transition kernel and whether all hold (M9). ``edges`` carry source_day, target_day."""
    s = edges.groupBy("src").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    a = with_quantiles(s.agg(F.max(F.abs(F.col("s") - 1)).alias("max_dev"), F.count("*").alias("n_sources")), s, [], "n", median_nnz=0.5)
    b = edges.agg(F.count_if(F.col("source_day") > F.col("target_day")).alias("backward"))
    c = nodes.agg(F.count("*").alias("n_nodes"))
    r = a.crossJoin(b).crossJoin(c)  # one row each
    ok = {"stochastic": F.col("max_dev") <= tolerance, "forward": F.col("backward") == 0, "density": F.col("median_nnz").between(low, high), "coverage": F.col("n_sources") == F.col("n_nodes")}
    out = r.select("*", *[v.alias(k) for k, v in ok.items()])
    return out.withColumn("passes", F.col("stochastic") & F.col("forward") & F.col("density") & F.col("coverage"))


def with_self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows normalised to 1; nodes without out-mass get a self-loop of 1."""
    e = normalised(edges, "p", "q", "drop", exact=True).select("src", "dst", F.col("q").alias("p"))
    loops = nodes.select(F.col("id").alias("src")).join(e.select("src").distinct(), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    return e.unionByName(loops)


def mass_by_direction(edges: DataFrame) -> DataFrame:
    """One row: forward, within, backward and self mass and their shares (M12). Needs source_day, target_day."""
    d = F.col("target_day") - F.col("source_day")
    own = F.col("src") == F.col("dst")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    m = edges.agg(F.sum("p").alias("total"), part(d > 0).alias("forward"), part((d == 0) & ~own).alias("within"), part(d < 0).alias("backward"), part(own).alias("self"))
    return m.select("*", *[(F.col(c) / F.col("total")).alias(f"{c}_share") for c in ("forward", "within", "backward", "self")])


def similarity_graph(near: DataFrame) -> DataFrame:
    """(src, dst, p) from nearest neighbours (src, dst, d): exp(-d), normalised per source."""
    return normalised(near.withColumn("w", F.exp(-F.col("d"))), "w", "p", "drop").select("src", "dst", "p")


def restricted(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id), repeated ones summed, renormalised."""
    e = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return normalised(e.groupBy("src", "dst").agg(F.sum("p").alias("w")), "w", "p", "drop").select("src", "dst", "p")


def mixture(parts: Sequence[tuple[DataFrame, float]], nodes: DataFrame, self_weight: float) -> DataFrame:
    """Weighted sum of edge tables and self-loops, normalised per source."""
    from functools import reduce

    every = [e.select("src", "dst", (F.col("p") * w).alias("w")) for e, w in parts]
    if self_weight > 0:
        every.append(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(self_weight).alias("w")))
    return normalised(reduce(DataFrame.unionByName, every).groupBy("src", "dst").agg(exact_sum(F.col("w")).alias("w")), "w", "p", "drop", exact=True).select("src", "dst", "p")


def entry_distribution(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per ``keys``: edges, distinct ends, mass, smallest, mean, median and largest entry."""
    a = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"), F.sum("p").alias("mass"), F.min("p").alias("min_p"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))
    return with_quantiles(a, edges, keys, "p", median_p=0.5)


def coarse(edges: DataFrame, groups: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """(src, dst, p) between groups: summed mass, normalised; a group without out-mass gets a self-loop.

    ``groups``: id, group. ``final`` (group) limits the self-loops to final groups; other empty rows then stay empty.
    """
    g = groups.select("id", "group")
    m = edges.join(g.select(F.col("id").alias("src"), F.col("group").alias("gs")), "src").join(g.select(F.col("id").alias("dst"), F.col("group").alias("gd")), "dst")
    m = normalised(m.groupBy(F.col("gs").alias("src"), F.col("gd").alias("dst")).agg(F.sum("p").alias("w")), "w", "p", "drop").select("src", "dst", "p")
    every = final.select(F.col("group").alias("src")).distinct() if final is not None else g.select(F.col("group").alias("src")).distinct()
    return m.unionByName(every.join(m.select("src").distinct(), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p")))
