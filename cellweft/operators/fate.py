"""Probability of ending in each terminal state, propagated backwards over time layers, and summaries of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.gates import require
from cellweft.operators.quantiles import quantiles, with_quantiles
from cellweft.session import cut


def layered(nodes: DataFrame) -> DataFrame:
    """Adds ``layer``: 0, 1, ... by ascending day (days are few)."""
    d = nodes.select("day").where("day IS NOT NULL").distinct().withColumn("layer", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day")) - 1)
    return nodes.join(F.broadcast(d), "day")  # a row a day


def one_hot(final: DataFrame, state: str) -> DataFrame:
    """(id, state, prob = 1) of terminal nodes."""
    return final.where(F.col(state).isNotNull()).select("id", F.col(state).alias("state"), F.lit(1.0).alias("prob"))


def backward(edges: DataFrame, nodes: DataFrame, terminal: DataFrame) -> DataFrame:
    """(id, state, prob): F[layer] = P[layer] * F[next], from the last but one layer to the first.

    ``nodes``: id, layer. ``edges``: src, dst, p, each from a layer to the next, or it raises. ``terminal``: id, state, prob. One join
    and one aggregation a layer; the loop is over layers, of which there are as many as time points.
    """
    lay = nodes.select("id", "layer")
    e = edges.join(lay.select(F.col("id").alias("src"), F.col("layer").alias("ls")), "src").join(lay.select(F.col("id").alias("dst"), F.col("layer").alias("ld")), "dst")
    e = cut(e.select("src", "dst", "p", "ls", "ld"))
    require(e, "edges", not_to_the_next_layer=F.col("ld") != F.col("ls") + 1)
    top = lay.agg(F.max("layer").alias("m")).first()["m"]
    known = cut(terminal.select("id", "state", "prob"))
    out, now = known, known
    for layer in range((top or 0) - 1, -1, -1):
        step = e.where(F.col("ls") == layer).join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "state").agg(F.sum(F.col("p") * F.col("prob")).alias("prob"))
        now = cut(step)
        out = out.unionByName(now)
    return out


def metrics(fate: DataFrame, k: int) -> DataFrame:
    """(id, top_state, top1, margin, entropy, norm_entropy): ties to the smaller state; entropy over ln k within [0, 1]."""
    w = Window.partitionBy("id").orderBy(F.desc("prob"), "state")
    f = fate.withColumn("r", F.row_number().over(w))
    h = F.sum(F.when(F.col("prob") > 0, -F.col("prob") * F.ln("prob")).otherwise(0.0))
    a = f.groupBy("id").agg(F.max(F.when(F.col("r") == 1, F.col("state"))).alias("top_state"), F.max("prob").alias("top1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("prob"))), F.lit(0.0)).alias("p2"), h.alias("entropy"))
    norm = F.greatest(F.least(F.col("entropy") / F.ln(F.lit(float(k))), F.lit(1.0)), F.lit(0.0)) if k > 1 else F.lit(0.0)
    return a.select("id", "top_state", "top1", (F.col("top1") - F.col("p2")).alias("margin"), "entropy", norm.alias("norm_entropy"))


def sums_qc(fate: DataFrame) -> DataFrame:
    """One row: nodes, smallest and largest total probability, nodes off 1 by more than 1e-6."""
    s = fate.groupBy("id").agg(F.sum("prob").alias("s"))
    return s.agg(F.count("*").alias("n_nodes"), F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.count_if(F.abs(F.col("s") - 1) > 1e-6).alias("off"))


def by_group(fate: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, state, mean_prob, mass, share, dominant_share): over all nodes of a group, a missing probability counting 0 (P10)."""
    n = nodes.groupBy(group).agg(F.count("*").alias("n"))
    tops = fate.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("prob"), "state"))).withColumn("top", F.when(F.col("r") == 1, 1).otherwise(0))
    m = tops.join(nodes.select("id", group), "id").groupBy(group, "state").agg(F.sum("prob").alias("mass"), F.sum("top").alias("tops"))
    states = fate.select("state").distinct()
    grid = n.crossJoin(F.broadcast(states))  # groups x terminal states, both few
    g = grid.join(m, [group, "state"], "left").na.fill(0, ["mass", "tops"])
    return g.select(group, "state", (F.col("mass") / F.col("n")).alias("mean_prob"), "mass", F.coalesce(F.col("mass") / F.nullif(F.sum("mass").over(Window.partitionBy(group)), F.lit(0.0)), F.lit(0.0)).alias("share"), (F.col("tops") / F.col("n")).alias("dominant_share"))


def quantiles_by(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p25, p50, p75) with linear interpolation (P10)."""
    return with_quantiles(values.select(group).distinct(), values, [group], value, p25=0.25, p50=0.5, p75=0.75)


def stability(summary: DataFrame, time: str) -> DataFrame:
    """Per state: times it leads, whether it leads at all of them, largest over mean probability."""
    w = Window.partitionBy(time).orderBy(F.desc("mean_prob"), "state")
    r = summary.withColumn("lead", (F.row_number().over(w) == 1).cast("int"))
    n = summary.agg(F.countDistinct(time).alias("_t"))
    return r.groupBy("state").agg(F.sum("lead").alias("leads"), F.max("mean_prob").alias("most"), F.avg("mean_prob").alias("mean"), F.stddev_pop("mean_prob").alias("sd")).crossJoin(F.broadcast(n)).select(
        "state", "leads", (F.col("leads") == F.col("_t")).alias("always"), F.coalesce(F.col("most") / F.nullif(F.col("mean"), F.lit(0.0)), F.lit(0.0)).alias("peak_ratio"), "sd")


def tiers(m: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Adds ``tier``: high, low or mixed by the table's own quantiles of top1 and norm_entropy."""
    q = quantiles(m, [], "top1", _l=low, _h=high).crossJoin(quantiles(m, [], "norm_entropy", _e=high))  # one row each
    t = F.when(F.col("top1") >= F.col("_h"), "high").when((F.col("top1") <= F.col("_l")) & (F.col("norm_entropy") >= F.col("_e")), "low").otherwise("mixed")
    return m.crossJoin(F.broadcast(q)).withColumn("tier", t).drop("_l", "_h", "_e")  # one row


def incoming(edges: DataFrame, final: DataFrame) -> DataFrame:
    """(id, in_degree, in_mass) of terminal nodes, 0 without in-edges."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.sum("p").alias("in_mass"))
    return final.select("id").join(i, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("in_mass", F.lit(0.0)).alias("in_mass"))


def state_pairs(profiles: DataFrame, state: str, key: str, value: str) -> DataFrame:
    """(a, b, cosine, l1) of all unordered pairs of states by their sparse profiles.

    States are few (terminal states, labels); the pairing is an equi-join on profile keys, with norms for what only one side has.
    """
    p = profiles.groupBy(state, key).agg(F.sum(value).alias("v"))
    n = p.groupBy(state).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum(F.abs("v")).alias("mass"))
    a, b = p.select(F.col(state).alias("a"), key, F.col("v").alias("va")), p.select(F.col(state).alias("b"), key, F.col("v").alias("vb"))
    both = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"), F.sum(F.abs(F.col("va") - F.col("vb")) - F.abs("va") - F.abs("vb")).alias("less"))
    na, nb = n.select(F.col(state).alias("a"), F.col("norm").alias("na"), F.col("mass").alias("ma")), n.select(F.col(state).alias("b"), F.col("norm").alias("nb"), F.col("mass").alias("mb"))
    grid = na.join(nb, F.col("a") < F.col("b"))
    g = grid.join(both, ["a", "b"], "left").na.fill(0.0, ["dot", "less"])
    return g.select("a", "b", F.coalesce(F.col("dot") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)), F.lit(0.0)).alias("cosine"), (F.col("ma") + F.col("mb") + F.col("less")).alias("l1"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: nodes in both, share whose leading state agrees, mean change of entropy and top share (B5). Inputs: :func:`metrics`."""
    j = a.select("id", F.col("top_state").alias("sa"), F.col("entropy").alias("ha"), F.col("top1").alias("ta")).join(b.select("id", F.col("top_state").alias("sb"), F.col("entropy").alias("hb"), F.col("top1").alias("tb")), "id")
    return j.agg(F.count("*").alias("n"), F.avg((F.col("sa") == F.col("sb")).cast("double")).alias("agreement"), F.avg(F.col("hb") - F.col("ha")).alias("entropy_change"), F.avg(F.col("tb") - F.col("ta")).alias("top1_change"))


def compared_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """(state, mass_a, mass_b, change, pearson): endpoint masses of two fate tables and the correlation of their probabilities over nodes.

    A probability that only one table has counts 0 in the other.
    """
    j = a.select("id", "state", F.col("prob").alias("pa")).join(b.select("id", "state", F.col("prob").alias("pb")), ["id", "state"], "full").na.fill(0.0, ["pa", "pb"])
    g = j.groupBy("state").agg(F.sum("pa").alias("mass_a"), F.sum("pb").alias("mass_b"), F.corr("pa", "pb").alias("_c"))
    return g.select("state", "mass_a", "mass_b", (F.col("mass_b") - F.col("mass_a")).alias("change"), F.coalesce(F.nanvl("_c", F.lit(0.0)), F.lit(0.0)).alias("pearson"))


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, js): Jensen-Shannon divergence of the two tables' probabilities of each node."""
    j = a.select("id", "state", F.col("prob").alias("pa")).join(b.select("id", "state", F.col("prob").alias("pb")), ["id", "state"], "full").na.fill(0.0, ["pa", "pb"])
    m = (F.col("pa") + F.col("pb")) / 2
    half = lambda p: F.sum(F.when(F.col(p) > 0, F.col(p) * F.ln(F.col(p) / m)).otherwise(0.0))
    return j.groupBy("id").agg((0.5 * half("pa") + 0.5 * half("pb")).alias("js"))


def annotation(nodes: DataFrame, fate: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label_kind, label, state, share): composition of labels' mean fate."""
    long = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("label_kind"), F.col(c).cast("string").alias("label")) for c in labels])).alias("e")).select("id", "e.*").where("label IS NOT NULL")
    s = long.join(fate, "id").groupBy("label_kind", "label", "state").agg(F.sum("prob").alias("m"))
    return s.select("label_kind", "label", "state", (F.col("m") / F.sum("m").over(Window.partitionBy("label_kind", "label"))).alias("share"))
