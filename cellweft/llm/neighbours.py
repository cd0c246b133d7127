"""The most similar vectors of every vector.

Learned partitions: the neighbour graph of a bounded sample is cut into parts of equal size, and a small network learns to tell
from a vector which parts hold its neighbours. Every vector is filed under its most probable part and asks its several most
probable parts, where candidates are reranked by exact distance. Parts follow the density of the data, since each holds the
same number of sample vectors; exact copies are one vector throughout, so a vector that a third of all rows repeat costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.session import cut


@dataclass(frozen=True)
class RouterParams:
    """What is fitted on the driver is bounded by ``sample_limit``; every vector is indexed and queried whatever these are.

    There are rows / ``part_rows`` parts, at least ``min_parts``, as long as each has 8 sample vectors; the sample grows with the parts (16
    vectors each) up to ``sample_limit``. Past ``sample_limit`` / 8 parts (18 million distinct vectors as set here) parts grow with the
    rows unless ``sample_limit`` is raised.
    """

    part_rows: int = 1500
    min_parts: int = 8
    sample_size: int = 24_000
    sample_limit: int = 96_000
    graph_k: int = 10
    hidden: int = 192
    epochs: int = 24
    #: A vector asks its most probable parts until their probabilities sum to this, at most ``max_probes`` of them.
    coverage: float = 0.9
    #: None: 12, or the square root of the number of parts if that is more.
    max_probes: int | None = None
    seed: int = 11
    #: Larger parts than this are searched in blocks of this many rows, each a group of its own.
    block_rows: int = 12000
    block_queries: int = 60000

    def parts_for(self, rows: int, sampled: int) -> int:
        return max(1, min(max(self.min_parts, round(rows / self.part_rows)), sampled // 8))

    def sample_for(self, rows: int) -> int:
        return min(self.sample_limit, max(self.sample_size, 16 * round(rows / self.part_rows)))


#: The exact setting: every vector asks every part.
EXACT = RouterParams(coverage=2.0, max_probes=1 << 30)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, *keep: str) -> DataFrame:
    """(id, vec, kept columns) of rows whose vector has ``dim`` finite numbers, not all zero; a null id is dropped."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).alias("id"), v.alias("vec"), *keep)


def current_anchors(anchors: DataFrame) -> DataFrame:
    """Per anchor the row of highest rep_version: anchor_id, slice_id, features. Repeated rows of a version are alike."""
    from cellweft.functions.keys import key

    rows = anchors.where("anchor_id IS NOT NULL").select(key("anchor_id").alias("anchor_id"), key("slice_id").alias("slice_id"), "rep_version", "features")
    best = rows.groupBy("anchor_id").agg(F.max_by(F.struct("slice_id", "features"), F.struct("rep_version", "features", "slice_id")).alias("r"))
    return best.select("anchor_id", "r.slice_id", "r.features")


def _vectors(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    # Dividing by the largest entry first keeps very large and very small vectors from over- or underflowing.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _knn(u: np.ndarray, k: int, block: int = 1000) -> np.ndarray:
    out = np.empty((len(u), k), dtype=np.int32)
    for i in range(0, len(u), block):
        s = u[i:i + block] @ u.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        out[i:i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(u: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12) -> np.ndarray:
    """Cut the neighbour graph into ``parts`` of (nearly) equal size with few edges between them.

    Starts from capacity-bounded assignment to spread-out seeds, then moves vertices to the part most of their neighbours are in,
    as long as that part has room; each move lowers the number of cut edges.
    """
    n = len(u)
    cap = int(np.ceil(1.05 * n / parts))
    u = u.astype(np.float32)
    seeds = u[rng.choice(n, parts, replace=False)]
    strips = [slice(a, a + 4096) for a in range(0, n, 4096)]
    for _ in range(5):
        near = np.concatenate([(u[s] @ seeds.T).argmax(axis=1) for s in strips])
        total = np.zeros_like(seeds)
        np.add.at(total, near, u)
        some = np.bincount(near, minlength=parts) > 0
        seeds[some] = _unit(total[some] + 1e-9)
    # The few best seeds of each vector; one that finds them all full goes where there is most room.
    m = min(16, parts)
    first, sure = np.empty((n, m), dtype=np.int32), np.empty(n, dtype=np.float32)
    for s in strips:
        score = u[s] @ seeds.T
        top = np.argpartition(-score, m - 1, axis=1)[:, :m]
        by = np.take_along_axis(score, top, axis=1)
        first[s], sure[s] = np.take_along_axis(top, np.argsort(-by, axis=1), axis=1), by.max(axis=1)
    part, room = np.empty(n, dtype=np.int64), np.full(parts, cap)
    for i in np.argsort(-sure):
        p = next((c for c in first[i] if room[c] > 0), None)
        part[i] = room.argmax() if p is None else p
        room[part[i]] -= 1
    adj: list[list[int]] = [list(g) for g in graph]
    for i, g in enumerate(graph):
        for j in g:
            adj[j].append(i)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            names, votes = np.unique(part[adj[i]], return_counts=True)
            best, mine = int(names[votes.argmax()]), part[i]
            if best != mine and votes.max() > votes[names == mine].sum() and room[best] > 0:
                room[mine] += 1
                room[best] -= 1
                part[i] = best
                moved += 1
        if moved < n // 500:
            break
    return part


class Router:
    """One hidden layer; gives the probability of each part."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.w = weights

    @property
    def parts(self) -> int:
        return self.w[2].shape[1]

    @classmethod
    def fit(cls, u: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, p: RouterParams) -> Router:
        """Targets are the parts of a vector's neighbours and its own, so the probabilities say where to look, not only where it lies."""
        rng = np.random.default_rng(p.seed)
        n, d = u.shape
        of_near = part[graph]

        def wanted(ix: np.ndarray) -> np.ndarray:
            t = np.zeros((len(ix), parts), dtype=np.float32)
            for j in range(of_near.shape[1]):
                np.add.at(t, (np.arange(len(ix)), of_near[ix, j]), 0.5 / of_near.shape[1])
            t[np.arange(len(ix)), part[ix]] += 0.5
            return t

        w = [rng.normal(0, (2 / d) ** 0.5, (d, p.hidden)), np.zeros(p.hidden), rng.normal(0, (1 / p.hidden) ** 0.5, (p.hidden, parts)), np.zeros(parts)]
        w = [x.astype(np.float32) for x in w]
        m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        x32, batch = u.astype(np.float32) * np.float32(d ** 0.5), 256
        for e in range(p.epochs):
            rate = 3e-3 * (1 - e / p.epochs) + 1e-4
            for ix in np.array_split(rng.permutation(n), max(1, n // batch)):
                h0 = x32[ix] @ w[0] + w[1]
                h = np.maximum(h0, 0)
                g = (_softmax(h @ w[2] + w[3]) - wanted(ix)) / len(ix)
                back = (g @ w[2].T) * (h0 > 0)
                t += 1
                for i, grad in enumerate((x32[ix].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return cls(w)

    def probabilities(self, u: np.ndarray) -> np.ndarray:
        x = u.astype(np.float32) * np.float32(u.shape[1] ** 0.5)
        return _softmax(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_router(vectors: DataFrame, dim: int, rows: int, p: RouterParams) -> Router:
    """Fit on at most ``sample_limit`` vectors, drawn by hash over the whole table; the same way at every size."""
    size = p.sample_for(rows)
    # The share drawn is set a little high and cut back, so the result never exceeds the bound.
    share = min(1.0, 1.1 * size / max(1, rows))
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").limit(size).toArrow()
    u = _unit(_vectors(drawn.column("vec"), dim)) if drawn.num_rows else np.eye(1, dim)
    parts = p.parts_for(rows, len(u))
    graph = _knn(u.astype(np.float32), min(p.graph_k, len(u) - 1)) if len(u) > 1 else np.zeros((1, 1), dtype=np.int32)
    return Router.fit(u, graph, balanced_parts(u, graph, parts, np.random.default_rng(p.seed)), parts, p)


def distinct_vectors(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep), (classes: id, vec, ids): exact copies as one class, named by its smallest id, with its k+1 smallest ids.

    The rank limit is applied within tasks before the shuffle, so a vector that very many rows repeat sends few rows.
    """
    # Two hashes, 128 bits together, name a class where only its rows are told apart; classes themselves group by the vector too.
    h = vectors.withColumn("h", F.xxhash64("vec")).withColumn("h2", F.xxhash64("vec", F.lit(1)))
    w = Window.partitionBy("h", "h2", "vec").orderBy("id")
    firsts = h.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    # At most k+1 ids a class, so the list is bounded.
    classes = firsts.groupBy("h", "h2", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(classes.select(F.col("ids")[0].alias("id"), "h", "h2", "vec", "ids"))
    copied = classes.where(F.size("ids") > 1).select("h", "h2", F.col("id").alias("rep"))
    members = h.select("id", "h", "h2").join(copied, ["h", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return members, classes


def nearest_classes(classes: DataFrame, dim: int, k: int, max_distance: float, p: RouterParams) -> DataFrame:
    """(id, other, distance): for each class its k nearest other classes among the parts it asks, within ``max_distance``."""
    spark = classes.sparkSession
    router = fit_router(classes, dim, classes.count(), p)
    shared = spark.sparkContext.broadcast(router.w)
    cover = p.coverage
    probes = min(router.parts, p.max_probes or max(12, int(np.ceil(router.parts ** 0.5))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Router(shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_vectors(b.column("vec"), dim))
            prob = r.probabilities(u)
            top = np.argpartition(-prob, probes - 1, axis=1)[:, :probes]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(prob, top, axis=1), axis=1), axis=1)
            got = np.take_along_axis(prob, top, axis=1).cumsum(axis=1)
            ask = np.c_[np.ones(len(u), dtype=bool), got[:, :-1] < cover]
            row, rank = np.nonzero(ask)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(top[row, rank].astype(np.int32)), b.column("id").take(at), pa.array(rank == 0), b.column("vec").take(at)], ["part", "id", "filed", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    asked = cut(classes.select("id", "vec").mapInArrow(route, f"part int, id string, filed boolean, vec {kind}"))
    # Large parts are searched in blocks: filed rows are spread over a blocks, asking rows over b, and each pair of blocks is a group.
    sizes = asked.groupBy("part").agg(F.count_if("filed").alias("nf"), F.count("*").alias("nq"))
    sizes = sizes.select("part", F.greatest(F.lit(1), F.ceil(F.col("nf") / p.block_rows)).alias("a"), F.greatest(F.lit(1), F.ceil(F.col("nq") / p.block_queries)).alias("b"))
    # One row a part, and parts number about rows / part_rows.
    rows = asked.join(sizes, "part")
    h = F.xxhash64("id", F.lit(5))
    filed = rows.where("filed").select("part", F.pmod(h, F.col("a")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("j"), "id", "vec", F.lit(True).alias("is_filed"))
    asking = rows.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("i"), F.pmod(h, F.col("b")).alias("j"), "id", "vec", F.lit(False).alias("is_filed"))

    def rerank(t: pa.Table) -> pa.Table:
        is_filed = t.column("is_filed").to_numpy()
        u, ids = _unit(_vectors(t.column("vec"), dim)), np.asarray(t.column("id").to_pylist(), dtype=object)
        fu, fi, qu, qi = u[is_filed], ids[is_filed], u[~is_filed], ids[~is_filed]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f32, q32 = fu.astype(np.float32), qu.astype(np.float32)
        step = max(1, 4_000_000 // max(1, len(fu)))
        for s in range(0, len(qu) if len(fu) else 0, step):
            sim = q32[s:s + step] @ f32.T
            # Ties at the k-th place all stay (1e-5 is far above single-precision error), so exact distances decide.
            kth = -np.partition(-sim, min(k, sim.shape[1] - 1), axis=1)[:, min(k, sim.shape[1] - 1)]
            q, f = np.nonzero(sim >= np.maximum(kth, 1 - max_distance)[:, None] - 1e-5)
            dist = 1 - (qu[s + q] * fu[f]).sum(axis=1)
            keep = (dist <= max_distance) & (qi[s + q] != fi[f])
            out.append((qi[s + q[keep]], fi[f[keep]], dist[keep]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.array([], dtype=object if c < 2 else float) for c in range(3)]
        return pa.table({"id": pa.array(cols[0], pa.string()), "other": pa.array(cols[1], pa.string()), "distance": pa.array(cols[2].astype(float), pa.float64())})

    found = filed.unionByName(asking).groupBy("part", "i", "j").applyInArrow(rerank, "id string, other string, distance double")
    # Noise far below any real difference is rounded off, so equal vectors of different length tie.
    found = found.withColumn("distance", F.greatest(F.lit(0.0), F.round("distance", 12)))
    w = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def most_similar(vectors: DataFrame, dim: int, k: int, max_distance: float = 2.0, params: RouterParams | None = None) -> DataFrame:
    """The k most similar other vectors of every vector: id, indices (ids by distance, then id), distances (1 - cosine).

    ``vectors``: id (string, unique), vec (array of ``dim`` usable numbers; see :func:`usable_vectors`). Copies count as
    vectors of distance 0. Neighbours beyond ``max_distance`` are left out; vectors without any get empty lists. An empty input
    gives no rows. Recall is below 1 where a neighbour lies in a part that was not asked; ``params=EXACT`` asks all of them.
    """
    p = params or RouterParams()
    vectors = vectors.select("id", "vec")
    members, classes = distinct_vectors(vectors, k)
    near = nearest_classes(classes, dim, k, max_distance, p)
    # Per class the k+1 nearest ids, its own smallest among them; bounded, so lists are safe.
    named = near.join(classes.select(F.col("id").alias("other"), "ids"), "other").select("id", "distance", F.explode(F.slice("ids", 1, k)).alias("other"))
    own = classes.where(F.size("ids") > 1).select("id", F.lit(0.0).alias("distance"), F.explode("ids").alias("other"))
    w = Window.partitionBy("id").orderBy("distance", "other")
    ranked = named.unionByName(own).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    lists = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("l")).withColumnRenamed("id", "rep")
    full = members.join(lists, "rep", "left").select("id", F.slice(F.filter(F.coalesce("l", F.array()), lambda x: x["other"] != F.col("id")), 1, k).alias("l"))
    return full.select("id", F.transform("l", lambda x: x["other"]).alias("indices"), F.transform("l", lambda x: x["distance"]).alias("distances"))


def close_pairs(listed: DataFrame) -> DataFrame:
    """Distinct pairs (anchor_id_a < anchor_id_b) of which at least one lists the other."""
    p = listed.select("id", F.explode("indices").alias("o"))
    return p.select(F.least("id", "o").alias("anchor_id_a"), F.greatest("id", "o").alias("anchor_id_b")).distinct()


def recall_at_k(listed: DataFrame, vectors: DataFrame, dim: int, k: int, max_distance: float, every: int = 100) -> DataFrame:
    """One row (queries, wanted, found, recall): lists against brute force for the ids whose hash is divisible by ``every``.

    The query set is collected as a matrix (rows / ``every`` vectors) and held against all rows in blocks.
    """
    q = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).toArrow()
    qid = np.asarray(q.column("id").to_pylist(), dtype=object)
    qu = _unit(_vectors(q.column("vec"), dim)) if len(qid) else np.zeros((0, dim))
    sent = vectors.sparkSession.sparkContext.broadcast((qid, qu))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, us = sent.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            d = np.round(1 - us @ _unit(_vectors(b.column("vec"), dim)).T, 12)
            bi = np.asarray(b.column("id").to_pylist(), dtype=object)
            kth = np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, min(k, d.shape[1] - 1)]
            x, y = np.nonzero((d <= max_distance) & (d <= kth[:, None]))
            keep = ids[x] != bi[y]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[keep]], pa.string()), pa.array(bi[y[keep]], pa.string()), pa.array(d[x[keep], y[keep]])], ["id", "o", "d"])

    w = Window.partitionBy("id").orderBy("d", "o")
    truth = vectors.select("id", "vec").mapInArrow(scan, "id string, o string, d double").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    got = listed.select("id", F.explode("indices").alias("o")).withColumn("hit", F.lit(1))
    return truth.join(got, ["id", "o"], "left").agg(F.countDistinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
