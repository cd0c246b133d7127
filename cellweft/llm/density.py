"""Groups of mutually similar records by density, with their size and most typical members.

Vectors of a partition key (a slice) are reduced by principal components and split into blocks around pivots; a vector near the
border of two blocks is in both. Each block finds dense cores on its own, at several densities, by reduced and by true distances; cores
that share a vector are one cluster across blocks. Every cluster then settles on its mean over all vectors of its slice, and is
tested exactly. Blocks thus only propose: what border cores, densities or the split of a very dense block miss is in no group yet.

A second pass proposes from those vectors, without blocks. Members of a group may be far from each other (0.25 from the mean allows
0.875 between two of them), so no density of cores covers all groups; from every vector in no group the means of its nearest others
at many radii and numbers settle among all vectors of its slice in no group, and what holds there is tested in the same exact way.
The pass is repeated over slices where it found groups until it finds none, so how the first pass was cut into blocks loses nothing
that the second one finds in a whole slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.neighbours import _unit, _vectors
from cellweft.session import cut, release


@dataclass(frozen=True)
class DensityParams:
    components: int = 30
    #: Densities at which cores are sought, as 1 - cosine; a cluster found at any of them is tested.
    levels: tuple[float, ...] = (0.16, 0.2, 0.25, 0.3)
    #: Densities at which cores are sought by true distances, so that groups which reduction links come apart.
    full_levels: tuple[float, ...] = tuple(i / 50 for i in range(1, 19))
    min_points: int = 5
    block_rows: int = 4000
    #: Pivots of a slice; blocks that still have more than ``block_rows`` vectors are split by hash, so that no task holds more.
    max_pivots: int = 64
    #: A vector also joins the blocks whose pivot is at most this much farther than the nearest one (Euclidean, unit vectors).
    margin: float = 0.12
    settle_rounds: int = 6
    #: Around vectors in no group: radii, as 1 - cosine, and numbers of nearest others whose means are tried.
    wide_radii: tuple[float, ...] = tuple(i / 20 for i in range(2, 18))
    wide_counts: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 19, 22, 26, 31, 37, 44, 53, 64)
    seed: int = 7


def _units(t: pa.Table | pa.RecordBatch, dim: int, col: str = "vec") -> np.ndarray:
    return _unit(_vectors(t.column(col), dim)) if t.num_rows else np.zeros((0, dim))


def principal_axes(points: DataFrame, dim: int, components: int) -> np.ndarray:
    """(dim x components) axes of largest variance of the unit vectors, from exact sums over all rows, one matrix per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            u = _units(b, dim)
            n, s, c = n + len(u), s + u.sum(0), c + u.T @ u
        flat = np.concatenate([[n], s, c.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    rows = points.select("vec").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    got = np.array([r["v"] for r in rows])
    if not len(got) or got[0] == 0:
        return np.eye(dim)[:, :components]
    n, s, c = got[0], got[1:dim + 1], got[dim + 1:].reshape(dim, dim)
    _, axes = np.linalg.eigh(c / n - np.outer(s / n, s / n))
    return np.ascontiguousarray(axes[:, ::-1][:, :components])


def distinct_points(vectors: DataFrame) -> DataFrame:
    """(slice_id, id, w, vec): one row per distinct vector of a slice, named by its smallest id, with its number of copies.

    Copies collapse by an algebraic aggregate, so a vector that a third of all rows repeat is one point of that weight.
    """
    return vectors.withColumn("h", F.xxhash64("vec")).groupBy("slice_id", "h", "vec").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("slice_id", "id", "w", "vec")


def in_blocks(points: DataFrame, p: DensityParams) -> DataFrame:
    """Points with their blocks: adds ``block``, ``own`` (its nearest pivot's block) and ``shared`` (it is in several).

    A point near several pivots comes once for each. A slice of at most ``block_rows`` points is one block; a block of more (vectors are
    uneven, and pivots bounded) is cut by hash into ``sub`` blocks of about that size, each thinner but as wide.
    """
    sizes = points.groupBy("slice_id").agg(F.when(F.count("*") > p.block_rows, F.least(F.ceil(2 * F.count("*") / p.block_rows), F.lit(p.max_pivots))).otherwise(1).alias("blocks"))
    sized = points.join(sizes, "slice_id")
    h = F.xxhash64("id", F.lit(p.seed))
    w = Window.partitionBy("slice_id").orderBy("h", "id")
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    large = sized.where("blocks > 1").withColumn("unit", F.transform("vec", lambda x: x.cast("double") / size))
    # Pivots only of slices with several blocks, drawn by hash: about 32 in block_rows points go through the window.
    cand = large.withColumn("h", h).where(F.pmod("h", F.lit(p.block_rows)) < 32)
    pivots = cand.withColumn("block", F.row_number().over(w)).where("block <= blocks").select("slice_id", F.struct("block", "unit").alias("pv"))
    packed = pivots.groupBy("slice_id").agg(F.collect_list("pv").alias("pivots"))  # a pivot a block
    d = F.transform("pivots", lambda v: F.struct(
        F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - 2 * F.aggregate(F.zip_with(v["unit"], F.col("unit"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))).alias("d"), v["block"].alias("block")))
    far = large.join(packed, "slice_id").withColumn("d", d).withColumn("best", F.array_min("d"))
    close = F.filter("d", lambda x: x["d"] <= F.col("best")["d"] + p.margin)
    many = far.withColumn("near", close).select("slice_id", "id", "w", "vec", (F.size("near") > 1).alias("shared"), "best", F.explode("near").alias("b")).select(
        "slice_id", "id", "w", "vec", F.col("b.block").alias("block"), (F.col("b.block") == F.col("best.block")).alias("own"), "shared")
    # A slice whose hashes gave no pivot stays whole.
    lone = sized.join(packed.select("slice_id", F.lit(1).alias("has")), "slice_id", "left").where("has IS NULL").select(
        "slice_id", "id", "w", "vec", F.lit(1).alias("block"), F.lit(True).alias("own"), F.lit(False).alias("shared"))
    every = lone.unionByName(many)
    held = every.groupBy("slice_id", "block").agg(F.ceil(F.count("*") / p.block_rows).alias("subs"))
    return every.join(held, ["slice_id", "block"]).withColumn("sub", F.pmod(F.xxhash64("id", F.lit(p.seed + 1)), F.col("subs"))).drop("subs")


def _settled(start: np.ndarray, u: np.ndarray, w: np.ndarray, within: float, rounds: int, least: float) -> np.ndarray:
    """Distinct means that ``start`` directions move to by taking the mean of what is within ``within``, again and again."""
    now, n = start, len(u)
    for r in range(rounds):
        sets: dict[bytes, np.ndarray] = {}
        for s in range(0, len(now), max(1, 4_000_000 // max(1, n))):
            near = 1 - now[s:s + max(1, 4_000_000 // max(1, n))] @ u.T <= within
            near = near[(near * w).sum(axis=1) >= least]
            for row, packed in zip(near, np.packbits(near, axis=1)):
                sets.setdefault(packed.tobytes(), row)
        if not sets:
            return np.zeros((0, u.shape[1]))
        held = np.array(list(sets.values()))
        total = (held * w) @ u
        total = total[np.abs(total).max(axis=1) > 1e-9]
        nxt = _unit(total) if len(total) else total
        if nxt.shape == now.shape and np.allclose(nxt, now, atol=1e-12):
            return nxt
        now = nxt
    return now


def _core_labels(near: np.ndarray, weight: np.ndarray, min_points: int) -> np.ndarray:
    """DBSCAN's cores from a matrix of neighbourhoods (own row included): cluster number of each core, -1 for others."""
    core = near.astype(np.float32) @ weight.astype(np.float32) >= min_points
    label, c = np.full(len(near), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = np.zeros(len(near), dtype=bool)
            todo[i] = True
            while todo.any():
                label[todo] = c
                todo = near[todo].any(axis=0) & core & (label < 0)
            c += 1
    return label


def local_clusters(blocked: DataFrame, axes: np.ndarray, dim: int, p: DensityParams, radius: float) -> DataFrame:
    """(slice_id, local, level, total, shared): each block's clusters of cores at each density, reduced and in full.

    Clusters that no other block shares settle on their means here already, so several densities that find one group give one row
    (level -1). ``total`` sums the unit vectors of cores that the block owns, so that a core on a border counts once; ``shared`` names the
    cores that other blocks have too.
    """
    spec = (axes, p.levels, p.full_levels, p.min_points, p.settle_rounds, radius)

    def find(t: pa.Table) -> pa.Table:
        a, levels, full, least, rounds, within = spec
        u = _units(t, dim)
        w = t.column("w").to_numpy()
        own, shared = t.column("own").to_numpy(), t.column("shared").to_numpy()
        ids = np.asarray(t.column("id").to_pylist(), dtype=object)
        slice_id, block, sub = (t.column(c)[0].as_py() for c in ("slice_id", "block", "sub"))
        names, level_no, totals, border, seen, mine_only = [], [], [], [], set(), []
        for first, z, steps in ((0, (u @ a).astype(np.float32), levels), (len(levels), u.astype(np.float32), full)):
            # Single precision and in place: one matrix of the block is held. The slack below covers its error.
            sq = (z * z).sum(axis=1)
            d2 = z @ z.T
            d2 *= -2
            d2 += sq[:, None]
            d2 += sq[None, :]
            for i, level in enumerate(steps, first):
                label = _core_labels(d2 <= 2 * level + 1e-5, w, least)
                for c in range(label.max() + 1):
                    at = label == c
                    if not (at & shared).any():
                        digest = hashlib.md5(at.tobytes()).digest()
                        if digest in seen:
                            continue
                        seen.add(digest)
                        mine_only.append((u[at] * w[at, None]).sum(axis=0))
                        continue
                    mine = at & own
                    names.append(f"{slice_id}/{block:06d}/{sub}/{i}/{c}"), level_no.append(i)
                    totals.append((u[mine] * w[mine, None]).sum(axis=0)), border.append(ids[at & shared].tolist())
            del d2
        apart = np.array([m for m in mine_only if np.abs(m).max() > 1e-9])
        for c, m in enumerate(_settled(_unit(apart), u, w, within, rounds, least) if len(apart) else []):
            names.append(f"{slice_id}/{block:06d}/{sub}/-1/{c}"), level_no.append(-1), totals.append(m), border.append([])
        return pa.table({"slice_id": pa.array([slice_id] * len(names), pa.string()), "local": pa.array(names, pa.string()), "level": pa.array(level_no, pa.int32()),
                         "total": pa.array([x.tolist() for x in totals], pa.list_(pa.float64())), "shared": pa.array(border, pa.list_(pa.string()))})

    return blocked.groupBy("slice_id", "block", "sub").applyInArrow(find, "slice_id string, local string, level int, total array<double>, shared array<string>")


def _merged(found: DataFrame) -> DataFrame:
    """Adds ``cluster``: local clusters of a slice and level that share a core are one."""
    from cellweft.llm.components import linked_groups

    links = cut(found.select(F.col("local").alias("record"), F.explode("shared").alias("core"), "slice_id", "level").select("record", F.concat_ws("/", "slice_id", "level", "core").alias("match_key")))
    if links.isEmpty():
        return found.withColumn("cluster", F.col("local"))
    groups = linked_groups(links).select(F.col("record").alias("local"), "group_id")
    return found.join(groups, "local", "left").withColumn("cluster", F.coalesce("group_id", "local"))


def _summed(parts: DataFrame, dim: int) -> DataFrame:
    """(slice_id, cluster, mean): sums of partial sums, whose direction is the mean's."""
    total = F.array(*[F.sum(F.col("total")[i]) for i in range(dim)])
    return parts.groupBy("slice_id", "cluster").agg(total.alias("mean")).where(F.exists("mean", lambda x: x != 0))


#: Points that meet the centres of their slice in one task.
_ASSIGN_ROWS = 20000


def _met(points: DataFrame, centres: DataFrame, each: object, schema: str) -> DataFrame:
    """Blocks of a slice's points with all centres of the slice, so that no task holds a whole slice."""
    sizes = points.groupBy("slice_id").agg(F.ceil(F.count("*") / _ASSIGN_ROWS).alias("nb"))
    pts = points.join(sizes, "slice_id").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb"))).select("slice_id", "b", "id", "w", "vec")
    cts = centres.join(sizes, "slice_id").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("slice_id", "b", "cluster", "mean")
    return pts.groupBy("slice_id", "b").cogroup(cts.groupBy("slice_id", "b")).applyInArrow(each, schema)  # type: ignore[arg-type]


def _partial_means(points: DataFrame, centres: DataFrame, dim: int, within: float) -> DataFrame:
    """(slice_id, cluster, total): per block of points the sum of unit vectors within ``within`` of each centre."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        names, totals = [], []
        if left.num_rows and right.num_rows:
            u, c, w = _units(left, dim), _units(right, dim, "mean"), left.column("w").to_numpy().astype(float)
            near = np.zeros((len(c), dim))
            for s in range(0, len(u), 4096):
                v = u[s:s + 4096]
                near += ((1 - v @ c.T <= within) * w[s:s + 4096, None]).T @ v
            names, totals = right.column("cluster").to_pylist(), near.tolist()
        slice_id = right.column("slice_id")[0].as_py() if names else None
        return pa.table({"slice_id": pa.array([slice_id] * len(names), pa.string()), "cluster": pa.array(names, pa.string()), "total": pa.array(totals, pa.list_(pa.float64()))})

    return _met(points, centres, add, "slice_id string, cluster string, total array<double>")


def _assign(points: DataFrame, centres: DataFrame, dim: int, within: float) -> DataFrame:
    """(slice_id, cluster, id, w, distance) of points within ``within`` of a centre of their slice."""

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        keep_p, keep_c, dist = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            u, c = _units(left, dim), _units(right, dim, "mean")
            for s in range(0, len(u), 4096):
                d = 1 - u[s:s + 4096] @ c.T
                x, y = np.nonzero(d <= within)
                keep_p.append(x + s), keep_c.append(y), dist.append(d[x, y])
        at = left.select(["slice_id", "id", "w"]).take(pa.array(np.concatenate(keep_p)))
        cl = right.column("cluster").take(pa.array(np.concatenate(keep_c)))
        return pa.table({"slice_id": at.column("slice_id"), "cluster": cl, "id": at.column("id"), "w": at.column("w"), "distance": np.concatenate(dist)})

    return _met(points, centres, near, "slice_id string, cluster string, id string, w long, distance double")


def wide_centres(rest: DataFrame, dim: int, p: DensityParams, radius: float, clear: float, least: int) -> DataFrame:
    """(slice_id, cluster, mean): directions around which the given points (those in no group) hold a group among themselves.

    A slice's points are tried in strips of about ``block_rows``, each against all of the slice's given points, so that a group is found
    whatever the size of its slice. A task holds these points once and its distances in steps; work grows with their square.
    """
    spec = (p.wide_radii, p.wide_counts, p.settle_rounds)

    def find(t: pa.Table) -> pa.Table:
        radii, counts, rounds = spec
        u, w = _units(t, dim), t.column("w").to_numpy().astype(float)
        slice_id, strip = (t.column(c)[0].as_py() for c in ("slice_id", "strip"))
        mine = np.flatnonzero(t.column("mine").to_numpy(zero_copy_only=False))
        most, within = max(counts) + 1, (radius + clear) / 2
        good: dict[bytes, np.ndarray] = {}
        if w.sum() >= least:
            step = max(1, 2_000_000 // len(u))
            for s in range(0, len(mine), step):
                d = 1 - u[mine[s:s + step]] @ u.T
                start = [((d <= r) * w) @ u for r in radii]
                # The nearest ones in order, a bounded number of them.
                order = np.argpartition(d, most - 1, axis=1)[:, :most] if d.shape[1] > most else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, axis=1), axis=1), axis=1)
                run = (u * w[:, None])[order].cumsum(axis=1)
                start += [run[:, n] for n in counts if n < run.shape[1]]
                every = np.concatenate(start)
                every = every[np.abs(every).max(axis=1) > 1e-9]
                moved = _settled(_unit(every), u, w, within, rounds, least)
                # Only what holds is kept from step to step.
                for m in _settled(moved, u, w, within, 1, least) if len(moved) else moved:
                    d = 1 - u @ m
                    near = d <= radius
                    if w[near].sum() >= least and not ((d > radius) & (d <= clear)).any():
                        good.setdefault(np.packbits(near).tobytes(), m)
        return pa.table({"slice_id": pa.array([slice_id] * len(good), pa.string()), "cluster": pa.array([f"{slice_id}/{strip}/{i}" for i in range(len(good))], pa.string()),
                         "mean": pa.array([m.tolist() for m in good.values()], pa.list_(pa.float64()))})

    strips = rest.groupBy("slice_id").agg(F.ceil(F.count("*") / p.block_rows).alias("strips"))
    each = rest.join(strips, "slice_id").withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)))
    each = each.select("slice_id", "strip", (F.pmod(F.xxhash64("id", F.lit(p.seed)), F.col("strips")) == F.col("strip")).alias("mine"), "w", "vec")
    return each.groupBy("slice_id", "strip").applyInArrow(find, "slice_id string, cluster string, mean array<double>")


def _settle(points: DataFrame, centres: DataFrame, dim: int, radius: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(centres, means of what is within ``radius`` of them), both written, moved on until nothing moves or ``rounds`` are over."""
    for i in range(max(1, rounds)):
        nxt = cut(_summed(_partial_means(points, centres, dim, radius), dim))
        if i + 1 == max(1, rounds):
            break
        size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        a, b = centres.select("slice_id", "cluster", F.col("mean").alias("was"), size("mean").alias("sa")), nxt.withColumn("sb", size("mean"))
        moved = b.join(a, ["slice_id", "cluster"]).where(F.exists(F.zip_with("was", "mean", lambda x, y: F.abs(x / F.col("sa") - y / F.col("sb"))), lambda d: d > 1e-9))
        if moved.isEmpty():
            break
        release(centres)
        centres = nxt
    return centres, nxt


def _tested(points: DataFrame, centres: DataFrame, own: DataFrame, dim: int, radius: float, clear: float, least: int) -> DataFrame:
    """(slice_id, group_id, id, w, distance) of the centres that hold a group; ``own`` are the means of what is within ``radius`` of them.

    The members' own mean must hold them all and nobody else: the test is against it, not against the centre they were drawn by.
    """
    mine = _assign(points, centres, dim, radius).select("slice_id", "cluster", "id", F.lit(True).alias("member"))
    tested = cut(_assign(points, own, dim, clear).join(mine, ["slice_id", "cluster", "id"], "full"))
    member = F.coalesce("member", F.lit(False))
    # A member out of reach of the own mean has no distance.
    good = tested.groupBy("slice_id", "cluster").agg(
        F.sum(F.when(member, F.col("w"))).alias("n"), F.bool_and(member & (F.col("distance") <= radius)).alias("ok"), F.min("id").alias("group_id"))
    good = good.where(F.col("ok") & (F.col("n") >= least))
    # The same group may be found at several densities.
    one = good.groupBy("slice_id", "group_id", "n").agg(F.min("cluster").alias("cluster"))
    return tested.join(one, ["slice_id", "cluster"]).select("slice_id", "group_id", "id", "w", "distance")


def compact_groups(vectors: DataFrame, dim: int, radius: float = 0.25, clear: float = 0.35, least: int = 5, params: DensityParams | None = None) -> DataFrame:
    """Groups of at least ``least`` vectors of a slice, each within ``radius`` of the group's mean direction while no other vector
    of the slice is within ``clear``: slice_id, group_id (smallest id), id (representative of its copies), w (copies), distance.

    ``vectors``: slice_id, id (unique), vec (usable). Copies count as vectors. Null slices are left out; an empty input gives no rows.
    Every row returned meets the definition. A group is missed only if no density of cores and no mean of the second pass moves to its
    mean.
    """
    p = params or DensityParams()
    points = cut(distinct_points(vectors.select("slice_id", "id", "vec").where("slice_id IS NOT NULL")))
    axes = principal_axes(points, dim, min(p.components, dim))
    found = cut(local_clusters(in_blocks(points, p), axes, dim, p, radius))
    centres, own = _settle(points, cut(_summed(_merged(found), dim)), dim, radius, p.settle_rounds)
    first = cut(_tested(points, centres, own, dim, radius, clear, least))
    every, rest = first, cut(points.join(first.select("slice_id", "id"), ["slice_id", "id"], "left_anti"))
    while not rest.isEmpty():
        wide = cut(wide_centres(rest, dim, p, radius, clear, least))
        if wide.isEmpty():
            break
        more = _tested(points, *_settle(points, wide, dim, radius, 1), dim, radius, clear, least)
        more = cut(more.join(every.select("slice_id", "group_id").distinct(), ["slice_id", "group_id"], "left_anti").select(first.columns))
        every = every.unionByName(more)
        # A slice that gave groups is looked at again without them; no group, no further pass.
        rest = cut(rest.join(more.select("slice_id", "id"), ["slice_id", "id"], "left_anti").join(more.select("slice_id").distinct(), "slice_id", "left_semi"))
    return every


def with_copies(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every vector of a group, copies included: slice_id, group_id, id, distance."""
    h = vectors.withColumn("h", F.xxhash64("vec"))
    rep = h.groupBy("slice_id", "h", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("w")).where("w > 1")
    copies = h.join(rep.drop("w"), ["slice_id", "h", "vec"]).select("slice_id", F.col("rep"), "id")
    extra = groups.where("w > 1").select("slice_id", "group_id", F.col("id").alias("rep"), "distance").join(copies, ["slice_id", "rep"]).select("slice_id", "group_id", "id", "distance")
    return groups.where("w = 1").select("slice_id", "group_id", "id", "distance").unionByName(extra)


def typical_members(members: DataFrame, n: int = 3) -> DataFrame:
    """Per group its size and its ``n`` members nearest to the mean: slice_id, group_id, size, typical (ids, best first)."""
    w = Window.partitionBy("slice_id", "group_id").orderBy("distance", "id")
    best = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).groupBy("slice_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("l"))
    return members.groupBy("slice_id", "group_id").agg(F.count("*").alias("size")).join(best, ["slice_id", "group_id"]).select(
        "slice_id", "group_id", "size", F.transform("l", lambda x: x["id"]).alias("typical"))


__all__ = ["DensityParams", "compact_groups", "typical_members", "with_copies"]
