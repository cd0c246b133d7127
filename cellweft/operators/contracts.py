"""Table contracts between stages: schemas, whole-table validation, identity joins, resumable shards, dense indices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellweft.functions.scalars import alleles, finite, locus
from cellweft.operators.gates import CheckFailed, join_checked, require, require_unique

#: Columns of a transition table, in the order of its contract.
EDGE_COLUMNS = (
    "edge_id", "source_anchor_id", "target_anchor_id", "source_slice_id", "target_slice_id", "source_mouse_id", "target_mouse_id", "source_time", "target_time",
    "row_normalized_transition_prob", "v2_row_normalized_transition_prob", "v2_unnormalized_weight", "v2_rank_within_source", "loaded_at")
#: The key of a cell in every lineage table (L1).
CELL_KEY = ("sample_id", "slice_id", "cellbin_id")


def conforming(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The contract's columns in its order; a missing one is an error, extra ones are dropped."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CheckFailed(f"missing columns {missing}")
    return df.select(*columns)


def validated_output(df: DataFrame, schema: StructType, rows: int | None, numbers: Sequence[str]) -> DataFrame:
    """``df`` if its columns are exactly the schema's, it has ``rows`` rows, and ``numbers`` are finite."""
    if [f.name for f in df.schema] != [f.name for f in schema]:
        raise CheckFailed(f"columns {df.columns} are not {schema.names}")
    got = df.agg(F.count("*").alias("n"), *[F.count_if(finite(c).isNull()).alias(c) for c in numbers]).first()
    if rows is not None and got["n"] != rows:
        raise CheckFailed(f"{got['n']} rows, not {rows}")
    bad = {c: got[c] for c in numbers if got[c]}
    if bad:
        raise CheckFailed(f"not finite: {bad}")
    return df


def standardised(df: DataFrame, days: dict[str, int]) -> DataFrame:
    """Adds time_day from ``sample_type``, time (``D`` and the day) and batch_id; a type without a day is an error (F1).

    Missing middle-tier labels become ``NA``. ``days`` is a short mapping and becomes one expression.
    """
    day = F.create_map(*[x for k, v in days.items() for x in (F.lit(k), F.lit(v))])[F.col("sample_type")]
    out = df.withColumn("time_day", day).withColumn("time", F.concat(F.lit("D"), F.col("time_day").cast("string"))).withColumn("batch_id", F.concat(F.col("mouse_id"), F.lit("_rep"), F.col("repeat").cast("string")))
    if "tier2" in df.columns:
        out = out.withColumn("tier2", F.coalesce("tier2", F.lit("NA")))
    return require(out, "sample types", without_day=F.col("time_day").isNull())


def unique_cells(df: DataFrame) -> DataFrame:
    """The cell table, if its key is unique."""
    return require_unique(df, CELL_KEY, "cells")


def with_identity(edges: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edges with ``source_*`` and ``target_*`` copies of node columns; every end must be known."""
    s = nodes.select(F.col("id").alias("src"), *[F.col(c).alias(f"source_{c}") for c in columns], F.lit(True).alias("_s"))
    d = nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"target_{c}") for c in columns], F.lit(True).alias("_d"))
    return join_checked(join_checked(edges, s, ["src"]), d, ["dst"]).where("_s AND _d").drop("_s", "_d")


def shard_report(edges: DataFrame, shard: Sequence[str], k: int | None = None, tolerance: float = 1e-5) -> DataFrame:
    """Per shard: sources, edges, sources without exactly ``k`` edges, unusable and negative values, sources off 1, passes."""
    p = finite("p")
    s = edges.groupBy(*shard, "src").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.count_if(p.isNull()).alias("bad"), F.count_if(p < 0).alias("neg"))
    wrong = F.count_if(F.col("n") != k) if k else F.lit(0).cast("long")
    r = s.groupBy(*shard).agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_edges"), wrong.alias("wrong_k"), F.sum("bad").alias("unusable"), F.sum("neg").alias("negative"), F.count_if(F.abs(F.coalesce("s", F.lit(0.0)) - 1) > tolerance).alias("off_one"))
    return r.withColumn("passes", (F.col("wrong_k") == 0) & (F.col("unusable") == 0) & (F.col("negative") == 0) & (F.col("off_one") == 0))


def component_weights(edges: DataFrame, state: str, tau: str, comp: Column, spatial: Column, balance: Column, powers: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds g_state = exp(-d / tau) and the powers of the three gates (V4)."""
    g = edges.withColumn("g_state", F.exp(-F.col(state) / F.col(tau)))
    for name, c, w in zip(("g_comp", "g_spatial", "g_slice_mouse"), (comp, spatial, balance), powers):
        g = g.withColumn(name, F.pow(c, w))
    return g


def lsh_candidates(a: DataFrame, b: DataFrame, vec: str, dim: int, k: int, tables: int = 8, bits: int = 12, seed: int = 1, probes: int = 12, bucket_rows: int = 32, block_rows: int = 32768) -> DataFrame:
    """(src, dst, distance, rank): approximate nearest targets by the signs of random projections, reranked exactly.

    Vectors are centred on the targets' mean. Codes have as many of ``bits`` as leave about ``bucket_rows`` targets a bucket. In each
    of ``tables`` hash tables a source meets the targets of its own bucket and of the ``probes`` buckets that its projections are
    nearest to. A task holds the buckets of about ``block_rows`` targets, so that a source comes once for several of its buckets, and
    passes k targets a source on. Sources left with fewer than k rows are joined exactly, so every source has its k rows where there
    are as many targets. Ties by dst. ``id`` is a string, vectors are finite and shuffled in their own type.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from cellweft.operators.transitions import nearest_targets
    from cellweft.session import cut

    a, b = a.select("id", F.col(vec).alias("vec")), b.select("id", F.col(vec).alias("vec"))
    got = b.agg(F.count("*").alias("n"), *[F.avg(F.col("vec")[i]).alias(f"m{i}") for i in range(dim)]).first()
    mean = np.array([got[f"m{i}"] or 0.0 for i in range(dim)])
    used = min(bits, max(1, round(np.log2(max(got["n"], 1) / bucket_rows))))
    blocks = 1 << min(used, max(0, int(np.ceil(np.log2(max(got["n"], 1) / block_rows)))))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))[:, :used]
    # What a probe flips: none, one or two signs; the cheapest by the squared projections it crosses come first.
    flips = np.array([[i in f for i in range(used)] for f in [(), *[(i,) for i in range(used)], *[(i, j) for i in range(used) for j in range(i)]]])
    mask = (flips << np.arange(used)).sum(axis=1)

    def hashed(d: DataFrame, more: int) -> DataFrame:
        def codes(batches):
            for r in batches:
                if not r.num_rows:
                    continue
                x = np.asarray(r.column("vec").flatten(), dtype=float).reshape(r.num_rows, dim) - mean
                for t in range(tables):
                    p = x @ planes[t].T
                    h = ((p > 0) << np.arange(used)).sum(axis=1)[:, None] ^ mask[np.argsort(p * p @ flips.T, axis=1, kind="stable")[:, :more + 1]]
                    # Row and block in order, one output row for each, with its buckets there.
                    row, block = np.repeat(np.arange(len(h)), h.shape[1]), h.ravel() % blocks
                    by = np.lexsort((block, row))
                    row, block, code = row[by], block[by], h.ravel()[by]
                    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), pa.array(code.astype(np.int32)))
                    at = pa.array(row[start])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), t, dtype=np.int32)), pa.array(block[start].astype(np.int32)), lists, r.column("id").take(at), r.column("vec").take(at)], ["t", "block", "h", "id", "vec"])

        return d.mapInArrow(codes, f"t int, block int, h array<int>, id string, vec {d.schema['vec'].dataType.simpleString()}")

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        rows = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]
        if x.num_rows and y.num_rows:
            u, v = (np.asarray(z.column("vec").combine_chunks().flatten(), dtype=float).reshape(z.num_rows, -1) for z in (x, y))
            uu, vv = (u * u).sum(1), (v * v).sum(1)
            _, both = np.unique(np.array(x.column("id").to_pylist() + y.column("id").to_pylist(), dtype=object), return_inverse=True)
            uid, vid = both[:len(u)], both[len(u):]
            (su, hu), (sv, hv) = ((np.repeat(np.arange(z.num_rows), pc.list_value_length(h).to_numpy()), np.asarray(h.flatten())) for z, h in ((x, x.column("h").combine_chunks()), (y, y.column("h").combine_chunks())))
            o, w = np.argsort(hu, kind="stable"), np.argsort(hv, kind="stable")
            su, hu, sv, hv = su[o], hu[o], sv[w], hv[w]
            for h in np.intersect1d(hu, hv):
                every, c = su[np.searchsorted(hu, h):np.searchsorted(hu, h, "right")], sv[np.searchsorted(hv, h):np.searchsorted(hv, h, "right")]
                most = min(k + 1, len(c))  # one more: a source may meet itself
                for s in range(0, len(every), 512):
                    i = every[s:s + 512]
                    d2 = np.maximum(uu[i][:, None] + vv[c] - 2 * u[i] @ v[c].T, 0)
                    p, q = np.nonzero(d2 <= np.partition(d2, most - 1, axis=1)[:, most - 1][:, None] + 1e-9)
                    p, q = i[p], c[q]
                    other = uid[p] != vid[q]
                    p, q = p[other], q[other]
                    # Exact distances for what is kept: the expanded square loses digits near zero.
                    rows.append(_firsts(p, q, np.sqrt(((u[p] - v[q]) ** 2).sum(1)), vid, k))
        p, q, d = _firsts(*(np.concatenate([r[i] for r in rows]) for i in range(3)), vid if len(rows) > 1 else np.zeros(0, dtype=int), k)
        start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, dtype=int)
        near = pa.StructArray.from_arrays([pa.array(d), y.column("id").combine_chunks().take(pa.array(q))], ["distance", "dst"])
        return pa.table({"src": x.column("id").take(pa.array(p[start])), "near": pa.ListArray.from_arrays(pa.array(np.r_[start, len(p)].astype(np.int32)), near)})

    s, t = hashed(a, probes), hashed(b, 0)
    s, t = s.toDF(*s.columns), t.toDF(*t.columns)  # both may come from one frame
    local = s.groupBy("t", "block").cogroup(t.groupBy("t", "block")).applyInArrow(best, "src string, near array<struct<distance:double,dst:string>>")
    # At most k targets from each of a source's blocks.
    every = local.groupBy("src").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    near = cut(every.select("src", F.posexplode("near").alias("i", "c")).select("src", "c.dst", "c.distance", (F.col("i") + 1).alias("rank")))
    full = near.where(F.col("rank") == k).select(F.col("src").alias("id"))
    short = cut(a.join(full, "id", "left_anti"))
    if short.isEmpty():
        return near
    pair, w = F.lit("").alias("time_pair"), Window.partitionBy("src").orderBy("distance", "dst")
    rest = nearest_targets(short.select(pair, "id", "vec"), b.select(pair, "id", "vec"), k + 1).where("src <> dst")
    rest = rest.select("src", "dst", "distance").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return near.join(full.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(rest)


def _firsts(p, q, d, order, k: int):
    """The ``k`` nearest of each ``p``, ties by ``order`` of ``q``; sorted by ``p``."""
    import numpy as np

    by = np.lexsort((order[q], d, p))
    p, q, d = p[by], q[by], d[by]
    keep = np.arange(len(p)) - np.searchsorted(p, p) < k
    return p[keep], q[keep], d[keep]


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame], valid: Callable[[DataFrame], bool], refuse: bool = False) -> DataFrame:
    """The table at ``path`` if it exists and is valid, else it is made and written.

    An invalid one is made again, or refused with ``refuse``. The commit marker of the file system says whether it exists whole.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        have = spark.read.parquet(path)
        if valid(have):
            return have
        if refuse:
            raise CheckFailed(f"{path} exists and is not valid")
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def assignment_checks(nodes: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """One row: nodes without a state, states without a node, ids outside 0..k-1, repeated nodes (P5)."""
    n = nodes.select("id").distinct().join(assigned.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("unassigned"))
    m = assigned.select("id").distinct().join(nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown"))
    r = assigned.agg(F.count_if(~F.col("state").between(0, k - 1)).alias("out_of_range"), (F.count("*") - F.countDistinct("id")).alias("repeated"))
    return n.crossJoin(m).crossJoin(r)  # one row each


def mapped_endpoints(fate: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fate with raw state kept and its refined name added, a raw state without one keeping its own."""
    m = join_checked(fate, mapping.select("state", "refined"), ["state"])
    return m.withColumn("refined", F.coalesce("refined", "state"))


def smoke_subset(nodes: DataFrame, edges: DataFrame, layer: int, sources: int, most: int) -> DataFrame:
    """(id): first ``sources`` sources of a layer with out-edges, and their targets, sources halved until at most ``most``."""
    src = edges.select(F.col("src").alias("id")).distinct().join(nodes.where(F.col("layer") == layer).select("id"), "id", "left_semi")
    while True:
        s = src.orderBy("id").limit(sources)
        got = s.unionByName(edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()
        if sources <= 1 or got.count() <= most:
            return got
        sources //= 2


def group_means(members: DataFrame, vectors: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """(group, n_cells, mean_vector): mean of the members' vectors; a member without one is an error."""
    j = require(members.select(group, key).distinct().join(vectors.select(key, vec), key, "left"), "members", without_vector=F.col(vec).isNull())
    # Running sums per group, folded within tasks first; elements are never rows.
    size = vectors.select(F.max(F.size(vec)).alias("n")).first()["n"] or 0
    return j.groupBy(group).agg(F.count("*").alias("n_cells"), F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(size)]).alias("mean_vector"))


def neighbour_integrity(members: DataFrame, points: DataFrame) -> DataFrame:
    """One row: anchors without themselves, unknown members, repeated pairs, points without a list."""
    ids = points.select("group", "id").distinct()
    a = members.groupBy("group", "anchor").agg(F.count_if(F.col("anchor") == F.col("member")).alias("own")).agg(F.count_if(F.col("own") == 0).alias("without_self"))
    b = members.join(ids.withColumnRenamed("id", "member"), ["group", "member"], "left_anti").agg(F.count("*").alias("unknown"))
    c = members.groupBy("group", "anchor", "member").count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    d = ids.join(members.select("group", F.col("anchor").alias("id")), ["group", "id"], "left_anti").agg(F.count("*").alias("without_list"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def cell_alleles(evidence: DataFrame, annotation: DataFrame) -> DataFrame:
    """(cell_key, feature, allele, locus, n): evidence with each of its feature's alleles, normalised, distinct."""
    a = annotation.select("feature", F.explode(alleles("allele")).alias("allele")).distinct()
    return evidence.select("cell_key", "feature", "n").join(a, "feature", "left").withColumn("locus", locus("allele"))


def reference_mapping(allele_table: DataFrame, banks: dict[str, DataFrame]) -> DataFrame:
    """(bank, n_alleles, n_mapped, fraction, selected): share of distinct alleles each bank knows; the best, ties by name."""
    from functools import reduce

    d = allele_table.select("locus", "allele").where("allele IS NOT NULL").distinct()
    rows = [d.join(b.select("locus", "allele", F.lit(1).alias("_m")).distinct(), ["locus", "allele"], "left").agg(F.count("*").alias("n_alleles"), F.count("_m").alias("n_mapped")).select(F.lit(k).alias("bank"), "*") for k, b in sorted(banks.items())]
    r = reduce(DataFrame.unionByName, rows).withColumn("fraction", F.coalesce(F.col("n_mapped") / F.nullif(F.col("n_alleles"), F.lit(0)), F.lit(0.0)))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("fraction"), "bank")  # a row a bank
    return r.withColumn("selected", F.row_number().over(w) == 1)


def allele_qc(alleles_: DataFrame) -> DataFrame:
    """(allele, locus, n_cells, max_n, min_n) without order-dependent picks."""
    return alleles_.where("allele IS NOT NULL").groupBy("allele").agg(F.min("locus").alias("locus"), F.countDistinct("cell_key").alias("n_cells"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))


def incidence(assigned: DataFrame, qc: DataFrame) -> DataFrame:
    """(cell_key, clone, status, row, col): binary cell-by-clone entries with dense indices by key order; clones filtered by QC give ``unassigned``."""
    j = assigned.join(qc.select("joint_clone_id", F.col("status").alias("_q")), "joint_clone_id", "left")
    c = j.select("cell_key", F.when(F.col("_q").isNotNull() & (F.col("_q") != "filtered"), F.col("joint_clone_id")).alias("clone"))
    from cellweft.operators.markov import dense_index

    cols = dense_index(c.where("clone IS NOT NULL").select("clone").distinct(), ["clone"], "col")
    rows = dense_index(c.select("cell_key").distinct(), ["cell_key"], "row")
    return c.join(rows, "cell_key").join(cols, "clone", "left").select("cell_key", F.coalesce("clone", F.lit("unassigned")).alias("clone"), "row", "col")


def spatial_subset(points: DataFrame, n: int, bins: int = 20, seed: int = 1) -> DataFrame:
    """About ``n`` points of each group spread over its equal-frequency cells, floor(n / cells) of each and the rest by hash."""
    from cellweft.operators.spatial import tiles

    t = tiles(points, bins)
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    cells = t.groupBy("group").agg(F.countDistinct("tile_id").alias("_c"))
    r = t.join(cells, "group").withColumn("_r", F.row_number().over(Window.partitionBy("tile_id").orderBy(h, "id"))).withColumn("_first", F.col("_r") <= F.floor(F.lit(n) / F.col("_c")))
    k = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("_first"), h, "id"))
    return r.withColumn("_k", k).where(F.col("_k") <= n).select(*points.columns)


def enrichment(df: DataFrame, state: str, label: str, high: float = 2.0) -> DataFrame:
    """(state, label, n, share, background, enrichment, enriched): share within a state over the overall share (C20)."""
    n = df.where(F.col(state).isNotNull() & F.col(label).isNotNull()).groupBy(state, label).agg(F.count("*").alias("n"))
    s, l = n.groupBy(state).agg(F.sum("n").alias("_s")), n.groupBy(label).agg(F.sum("n").alias("_l"))
    t = n.agg(F.sum("n").alias("_t"))
    j = n.join(s, state).join(l, label).crossJoin(F.broadcast(t))  # one row
    share, back = F.col("n") / F.col("_s"), F.col("_l") / F.col("_t")
    return j.select(state, label, "n", share.alias("share"), back.alias("background"), (share / back).alias("enrichment"), (share / back >= high).alias("enriched"))
