"""Candidate transitions between time points and the weights and probabilities on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalars import finite
from cellweft.operators.quantiles import group_ranks, joined, quantiles, with_quantiles


def adjacent_times(df: DataFrame, time: str, day: str) -> DataFrame:
    """(source_time, target_time, source_day, target_day, delta, n_source, n_target): consecutive time points.

    The window runs over the distinct times, which are few whatever the table's size.
    """
    n = df.where(F.col(day).isNotNull()).groupBy(time, day).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(day, time)
    nx = n.select(F.col(time).alias("source_time"), F.lead(time).over(w).alias("target_time"), F.col(day).alias("source_day"), F.lead(day).over(w).alias("target_day"), F.col("n").alias("n_source"), F.lead("n").over(w).alias("n_target"))
    return nx.where("target_time IS NOT NULL").withColumn("delta", F.col("target_day") - F.col("source_day")).select("source_time", "target_time", "source_day", "target_day", "delta", "n_source", "n_target")


def nearest_targets(source: DataFrame, target: DataFrame, k: int, source_rows: int = 4096, target_rows: int = 16384) -> DataFrame:
    """(time_pair, src, dst, distance, rank): the k targets nearest to each source of the same pair, ties by dst.

    ``source``/``target``: time_pair, id, vec. Exact, so every source is held against every target of its pair: both are cut by hash into
    blocks of about ``source_rows`` and ``target_rows``, as many as a pair's counts need, each two blocks meet in one task as
    matrices, and the local bests are ranked; k rows a source leave each task.
    """
    import numpy as np
    import pyarrow as pa

    def counted(d: DataFrame, rows: int, name: str) -> DataFrame:
        return d.groupBy("time_pair").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    # A row a time pair.
    sizes = F.broadcast(counted(source, source_rows, "_a").join(counted(target, target_rows, "_b"), "time_pair"))
    own, every = (lambda n: F.pmod(F.hash("id"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    s = source.join(sizes, "time_pair").select("time_pair", "id", "vec", own("_a").alias("i"), every("_b").alias("j"))
    t = target.join(sizes, "time_pair").select("time_pair", "id", "vec", every("_a").alias("i"), own("_b").alias("j"))

    def best(a: pa.Table, c: pa.Table) -> pa.Table:
        empty = {"time_pair": pa.array([], pa.string()), "src": pa.array([], pa.string()), "dst": pa.array([], pa.string()), "distance": pa.array([], pa.float64())}
        if not a.num_rows or not c.num_rows:
            return pa.table(empty)
        mat = lambda x: np.asarray(x.column("vec").combine_chunks().flatten(), dtype=float).reshape(x.num_rows, -1)
        x, y = mat(a), mat(c)
        sid, tid = np.asarray(a.column("id").to_pylist(), dtype=object), np.asarray(c.column("id").to_pylist(), dtype=object)
        rows = []
        yy = (y * y).sum(1)
        for at in range(0, len(x), 512):
            z = x[at:at + 512]
            d2 = np.maximum((z * z).sum(1)[:, None] + yy[None, :] - 2 * z @ y.T, 0)
            kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
            p, q = np.nonzero(d2 <= kth[:, None] + 1e-9)
            # Exact distances for what is kept: the expanded square loses digits near zero.
            rows.append((p + at, q, np.sqrt(((z[p] - y[q]) ** 2).sum(1))))
        p, q, d = (np.concatenate([r[i] for r in rows]) for i in range(3))
        pair = a.column("time_pair")[0].as_py()
        return pa.table({"time_pair": pa.array([pair] * len(p), pa.string()), "src": pa.array(sid[p], pa.string()), "dst": pa.array(tid[q], pa.string()), "distance": d})

    g = ["time_pair", "i", "j"]
    s, t = s.toDF(*s.columns), t.toDF(*t.columns)  # both may come from one frame
    local = s.groupBy(*g).cogroup(t.groupBy(*g)).applyInArrow(best, "time_pair string, src string, dst string, distance double")
    w = Window.partitionBy("time_pair", "src").orderBy("distance", "dst")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def combined_cost(parts: dict[str, float]) -> Column:
    """Weighted sum of scaled distance columns; missing ones count 0 (T5)."""
    return sum((F.coalesce(finite(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))


def temperatures(edges: DataFrame, cost: str, keys: Sequence[str]) -> DataFrame:
    """(keys, tau): median finite cost per ``keys``, at least 1e-3."""
    return quantiles(edges, keys, cost, tau=0.5).withColumn("tau", F.greatest("tau", F.lit(1e-3)))


def softmax(edges: DataFrame, distance: str, src: str = "src", out: str = "prob") -> DataFrame:
    """``out`` = exp(-distance) over its sum per source."""
    from cellweft.functions.scalars import softmax_weight

    return normalised(edges.withColumn("_w", softmax_weight(distance)), "_w", out, "zero", src).drop("_w")


def weighted(edges: DataFrame, cost: str, keys: Sequence[str], temperature: DataFrame | None = None) -> DataFrame:
    """Adds tau (median finite cost per ``keys``, at least 1e-3), weight exp(-cost/tau) and prob per source.

    A source whose weights sum to 0 gets probabilities 0.
    """
    tau = temperature if temperature is not None else temperatures(edges, cost, keys)
    e = edges.join(tau, list(keys)).withColumn("weight", F.exp(F.greatest(F.least(-F.col(cost) / F.col("tau"), F.lit(700.0)), F.lit(-700.0))))
    return normalised(e, "weight", "prob", "zero")


def exact_sum(c: Column) -> Column:
    """Aggregate: the sum of numbers as if added without rounding and rounded once, so that no order of rows shows.

    Each is split, without loss, into a multiple of 2^-26, a multiple of 2^-52 and the rest; sums of the first two are exact while they
    stay below 2^27. Larger or tiny sums are as good as plain ones.
    """
    high = (c + F.lit(1.5 * 2**26)) - F.lit(1.5 * 2**26)
    middle = ((c - high) + F.lit(1.5)) - F.lit(1.5)
    return F.sum(high) + (F.sum(middle) + F.sum((c - high) - middle))


def normalised(edges: DataFrame, weight: str, out: str, zero: str = "zero", src: str = "src", exact: bool = False) -> DataFrame:
    """``out`` = weight over its sum per source. Null, NaN and negative weights count 0.

    A source whose sum is 0 gets 0 (``zero``), 1/n (``uniform``) or no rows (``drop``). ``exact``: sums by :func:`exact_sum`.
    """
    w = F.greatest(F.coalesce(finite(weight), F.lit(0.0)), F.lit(0.0))
    # Sums per source are compact partial states; a source with a tenth of all rows is never one task.
    sums = edges.groupBy(F.col(src).alias("_of")).agg((exact_sum(w) if exact else F.sum(w)).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    e = edges.join(sums, F.col(src).eqNullSafe(F.col("_of")))
    e = e.withColumn(out, F.when(F.col("_sum") > 0, w / F.col("_sum")).otherwise(1.0 / F.col("_n") if zero == "uniform" else F.lit(0.0)))
    return (e.where("_sum > 0") if zero == "drop" else e).drop("_of", "_sum", "_n")


def source_summary(edges: DataFrame, prob: str = "p", src: str = "src") -> DataFrame:
    """(src, n_targets, row_sum, entropy, top1, effective) per source: entropy of p, exp(entropy) targets."""
    p = F.col(prob)
    h = F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    return edges.groupBy(src).agg(F.count("*").alias("n_targets"), F.sum(p).alias("row_sum"), h.alias("entropy"), F.max(p).alias("top1"), F.exp(h).alias("effective"))


def probability_diagnostics(edges: DataFrame, prob: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Over sources: row sums, mean entropy and top share, share of sources whose top share is at least .95."""
    s = edges.groupBy(*keys, "src").agg(F.sum(prob).alias("s"), F.sum(F.when(F.col(prob) > 0, -F.col(prob) * F.ln(prob)).otherwise(0.0)).alias("h"), F.max(prob).alias("m"))
    a = s.groupBy(*keys).agg(F.count("*").alias("n_sources"), F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.avg("s").alias("mean_sum"), F.avg("h").alias("mean_entropy"), F.avg("m").alias("mean_top1"), F.avg(F.exp("h")).alias("mean_effective"))
    cols = [*keys, "n_sources", "min_sum", "max_sum", "mean_sum", "mean_entropy", "mean_top1", "p95_top1", "mean_effective"]
    return with_quantiles(a, s, keys, "m", p95_top1=0.95).select(*cols)


def category_spread(edges: DataFrame, category: str, prob: str = "p") -> DataFrame:
    """(src, category_entropy, category_top): how a source's mass spreads over target categories."""
    c = edges.groupBy("src", category).agg(F.sum(prob).alias("m"))
    c = c.withColumn("q", F.col("m") / F.sum("m").over(Window.partitionBy("src")))
    return c.groupBy("src").agg(F.sum(F.when(F.col("q") > 0, -F.col("q") * F.ln("q")).otherwise(0.0)).alias("category_entropy"), F.max("q").alias("category_top"))


def adaptive_bandwidth(edges: DataFrame, distance: str, floor: float = 1e-6, q: float = 0.5) -> DataFrame:
    """(src, tau): quantile of the source's distances above ``floor``; the overall one where it has none; at least ``floor`` (V1)."""
    d = F.when(finite(distance) > floor, finite(distance))
    every = quantiles(edges, [], d, _all=q)
    own = with_quantiles(edges.select("src").distinct(), edges, ["src"], d, tau=q)
    return own.crossJoin(F.broadcast(every)).select("src", F.greatest(F.coalesce("tau", "_all"), F.lit(floor)).alias("tau"))


def soft_gate(distance: Column | str, tau: Column | str, strength: float) -> Column:
    """(1 - s) + s * exp(-d / tau); 1 for s <= 0 (V2)."""
    if strength <= 0:
        return F.lit(1.0)
    d, t = (F.col(x) if isinstance(x, str) else x for x in (distance, tau))
    return (1 - strength) + strength * F.exp(-d / t)


def balance_gate(edges: DataFrame, categories: Sequence[str], low: float = 0.2) -> DataFrame:
    """Adds ``gate``: product over ``categories`` of min(1, sqrt((1/n)/frequency)), within [low, 1]; 1 for a single category (V3)."""
    e, gate = edges, F.lit(1.0)
    for c in categories:
        n = edges.groupBy(c).agg(F.count("*").alias(f"_n_{c}"))
        t = n.agg(F.sum(f"_n_{c}").alias(f"_t_{c}"), F.count("*").alias(f"_k_{c}"))
        key = n.crossJoin(F.broadcast(t)).withColumnRenamed(c, f"_c_{c}")
        e = e.join(key, F.col(c).eqNullSafe(F.col(f"_c_{c}")))
        gate = gate * F.when(F.col(f"_k_{c}") > 1, F.least(F.lit(1.0), F.sqrt((1 / F.col(f"_k_{c}")) / (F.col(f"_n_{c}") / F.col(f"_t_{c}"))))).otherwise(1.0)
    return e.withColumn("gate", F.greatest(F.least(gate, F.lit(1.0)), F.lit(low))).select(*edges.columns, "gate")


def sharpened(edges: DataFrame, prior: str, distance: str, tau: str, gates: Sequence[str], power: float = 1.0, keep: int = 10) -> DataFrame:
    """w = prior^power * exp(-d/tau) * gates; the ``keep`` best targets of a source (ties by dst), renormalised as ``prob`` (V5)."""
    w = F.pow(F.col(prior), power) * F.exp(-F.col(distance) / F.col(tau))
    for g in gates:
        w = w * F.col(g)
    e = edges.withColumn("w", w)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return normalised(e.withColumn("rank", rank).where(F.col("rank") <= keep), "w", "prob", "uniform")


def shard_plan(sources: DataFrame, pairs: DataFrame, time: str, slice_: str, k: int) -> DataFrame:
    """One row per (time pair, source slice): source rows, expected edges and the GiB of a dense distance block."""
    n = sources.groupBy(time, slice_).agg(F.count("*").alias("n_rows"))
    p = pairs.select(F.col("source_time").alias(time), "target_time", "n_target")
    return n.join(p, time).select(time, "target_time", slice_, "n_rows", (F.col("n_rows") * F.least(F.lit(k), "n_target")).alias("expected_edges"), (F.col("n_rows") * F.col("n_target") * 8 / 2**30).alias("dense_gib"))


def allocation(sizes: DataFrame, stratum: str, cap: int, n: str = "n") -> DataFrame:
    """(stratum, n, quota): ``cap`` shared in proportion to ``n`` by largest remainder, at least 1 and at most n each (C10). Strata are few."""
    one = Window.partitionBy(F.lit(1))
    q = sizes.select(stratum, F.col(n).alias("n")).withColumn("ideal", F.col("n") * cap / F.sum("n").over(one)).withColumn("base", F.least("n", F.greatest(F.floor("ideal"), F.lit(1))))
    left = F.lit(cap) - F.sum("base").over(one)
    rank = F.row_number().over(one.orderBy(F.desc(F.col("ideal") - F.floor("ideal")), stratum))
    return q.withColumn("quota", F.least("n", F.col("base") + F.when(rank <= left, 1).otherwise(0))).select(stratum, "n", "quota")


def quota_sample(df: DataFrame, stratum: str, key: str, cap: int, seed: int = 1) -> DataFrame:
    """``cap`` rows shared among strata by :func:`allocation`.

    Rows of a stratum are taken in the order of md5(seed|key), which any engine reproduces.
    """
    quota = allocation(df.groupBy(stratum).agg(F.count("*").alias("n")), stratum, cap).select(F.col(stratum).alias("_s"), "quota")
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(order)).join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where("_r <= quota").drop("_r", "_s", "quota")


def hash_sample(df: DataFrame, partition: Sequence[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of each partition by md5(seed|key) order, without replacement."""
    w = Window.partitionBy(*partition).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def head_sample(df: DataFrame, partition: Sequence[str], key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each partition by key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*partition).orderBy(key))).where(F.col("_r") <= n).drop("_r")


def stride_sample(df: DataFrame, partition: Sequence[str], key: str, n: int) -> DataFrame:
    """Every max(1, size // n)-th row of each partition by key, at most ``n``."""
    r = group_ranks(df, partition, [key]).withColumn("_s", F.greatest(F.lit(1), F.floor(F.col("_n") / n)))
    return r.where("_r % _s = 0").where(F.floor(F.col("_r") / F.col("_s")) < n).drop("_r", "_n", "_s")


def spaced_subset(df: DataFrame, partition: Sequence[str], key: str, n: int) -> DataFrame:
    """Rows at the positions int(linspace(0, size - 1, n)) of each partition by key."""
    d = group_ranks(df, partition, [key])
    # Position i of n is floor(i * (size - 1) / (n - 1)); row r is chosen if some i maps to it.
    i = F.ceil(F.col("_r") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (i < n) & (F.floor(i * (F.col("_n") - 1) / (n - 1)) == F.col("_r")) if n > 1 else F.col("_r") == 0
    return d.where((F.col("_n") <= n) | hit).drop("_r", "_n")


def permuted(df: DataFrame, partition: Sequence[str], key: str, value: str, seed: int) -> DataFrame:
    """``value`` shuffled among the rows of each partition (K11): key order joined with hash order, by ranks, which are unique."""
    a = group_ranks(df, partition, [key]).drop("_n")
    h = df.select(*partition, F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).alias("_h"), F.col(key).alias("_key"), F.col(value).alias(f"{value}_shuffled"))
    b = group_ranks(h, partition, ["_h", "_key"]).drop("_h", "_key", "_n")
    return joined(a, b, [*partition, "_r"], "inner").drop("_r")
