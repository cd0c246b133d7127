"""Groups of records linked directly or through others.

The giant component is peeled first: breadth-first joins from the vertex of highest degree, whose visited set then stands for one
vertex. The rest, many small components, is labelled by propagating minima, with the graph contracted after each round so that a chain
of length d needs about log d rounds. A record and what it matches by are the two sides of a bipartite graph, so a match key shared by a third of all
records is a star of that many edges, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.session import cut, release

#: Peeling goes on until the frontier is empty. It also ends when this many rounds in succession each found less than PEEL_SHARE of
#: what is visited already: then a long thin tail hangs on the giant component, which contraction takes in few rounds.
PEEL_THIN_ROUNDS = 2
PEEL_SHARE = 0.02


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense-enough long ids for both sides: (nodes: name, side, id), (edges: u, v in both directions), both written."""
    ends = links.select(F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("record").alias("name")), F.struct(F.lit(1).alias("side"), F.col("match_key").alias("name"))
    )).alias("e")).select("e.*").distinct()
    nodes = cut(ends.withColumn("id", F.monotonically_increasing_id()))
    left = nodes.where("side = 0").select(F.col("name").alias("record"), F.col("id").alias("u"))
    right = nodes.where("side = 1").select(F.col("name").alias("match_key"), F.col("id").alias("v"))
    one = links.join(left, "record").join(right, "match_key").select("u", "v").distinct()
    return nodes, cut(one)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _peel(edges: DataFrame, thin_rounds: int | None) -> tuple[int | None, DataFrame | None]:
    """(vertex of highest degree, vertices reached from it, written); ``thin_rounds`` None goes on until nothing new is reached."""
    hub = edges.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not hub:
        return None, None
    start = hub[0]["u"]
    visited = frontier = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"))
    old: list[DataFrame] = []
    seen, thin = 1, 0
    while True:
        reached = edges.join(frontier.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id")).distinct()
        frontier = cut(reached.join(visited, "id", "left_anti"))
        old.append(frontier)
        n = frontier.count()
        if not n:
            break
        visited = visited.unionByName(frontier)
        thin = thin + 1 if n < PEEL_SHARE * seen else 0
        seen += n
        if thin_rounds is not None and thin >= thin_rounds:
            break
    all_seen = cut(visited)
    release(*old)
    return start, all_seen


def _propagate(edges: DataFrame) -> DataFrame:
    """(id, label) with one vertex of each component as label. ``edges`` (written) hold both directions.

    Each round every vertex takes the smallest vertex around it, itself included, and the graph shrinks to the vertices that were
    taken. Of a chain about a third stay, so rounds grow with the logarithm of the longest chain and later rounds are small.
    """
    maps: list[DataFrame] = []
    while not maps or not edges.isEmpty():
        least = cut(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")))
        maps.append(least)
        ends = edges.join(least.withColumnRenamed("to", "a"), "u").join(least.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        smaller = cut(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        release(edges)
        edges = smaller
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        up = labels.select(F.col("u").alias("to"), F.col("to").alias("top"))
        labels = m.join(up, "to", "left").select("u", F.coalesce("top", "to").alias("to"))
    return labels.select(F.col("u").alias("id"), F.col("to").alias("label"))


def linked_groups(links: DataFrame, thin_rounds: int | None = PEEL_THIN_ROUNDS) -> DataFrame:
    """Components over ``links`` (record, match_key): one row per record with its ``group_id``, the smallest record of its group.

    Two records are linked if they share a match key. Null records or keys link nothing and give no rows; repeated links count
    once; an empty input gives no rows. Records are strings; the smallest is by code point. ``thin_rounds``: see PEEL_THIN_ROUNDS; groups
    are the same whatever it is.
    """
    # Written, since nodes and edges both come from it.
    links = cut(links.where("record IS NOT NULL AND match_key IS NOT NULL").select("record", "match_key").distinct())
    nodes, edges = _numbered(links)
    both = cut(_both(edges))
    release(edges)
    start, seen = _peel(both, thin_rounds)
    if start is None:
        return nodes.where("side = 0").select(F.col("name").alias("record"), F.col("name").alias("group_id"))
    # The visited set becomes one vertex; edges inside it go, edges out of it (if peeling stopped at a thin tail) start at the hub.
    giant = seen.select(F.col("id").alias("u"), F.lit(True).alias("gu"))
    out_u = both.join(giant, "u", "left")
    contracted = out_u.join(giant.select(F.col("u").alias("v"), F.col("gu").alias("gv")), "v", "left")
    rest = cut(contracted.where("gu IS NULL OR gv IS NULL").select(
        F.when(F.col("gu"), F.lit(start)).otherwise(F.col("u")).alias("u"), F.when(F.col("gv"), F.lit(start)).otherwise(F.col("v")).alias("v")).distinct())
    release(both)
    labels = cut(_propagate(rest))
    # If peeling stopped at a thin tail, propagation gave the hub a label.
    hub_label = labels.where(F.col("id") == start).select("label").head()
    in_giant = seen.select("id", F.lit(hub_label["label"] if hub_label else start).cast("long").alias("label"))
    every = in_giant.unionByName(labels.where(F.col("id") != start).join(seen, "id", "left_anti"))
    records = nodes.where("side = 0").join(every, "id").select(F.col("name").alias("record"), "label")
    least = records.groupBy("label").agg(F.min("record").alias("group_id"))
    return records.join(least, "label").select("record", "group_id")


def clone_links(membership: DataFrame, assignment: DataFrame) -> DataFrame:
    """(record: cell key, match_key: clone id) of every row that says which cellbin has which clone call."""
    from cellweft.functions.keys import cell_key, filled, trimmed

    a = membership.where(~F.coalesce(F.lower(trimmed("membership_status")) == "filtered", F.lit(False))).select(
        filled("cell_key").alias("record"), filled("clone_id").alias("match_key"))
    b = assignment.where(filled("cellbin_id").isNotNull()).select(
        cell_key("sample_id", "slice_id", "cellbin_id").alias("record"), filled("clone_id").alias("match_key"))
    return a.unionByName(b)


def clone_groups(membership: DataFrame, assignment: DataFrame) -> DataFrame:
    """group_cell_key, cell_key of every cellbin that is linked with at least one other."""
    g = linked_groups(clone_links(membership, assignment))
    # A group of at least two has a member other than its smallest: those name the groups, whose smallest members follow.
    others = g.where("record <> group_id")
    heads = others.select("group_id").distinct().select(F.col("group_id").alias("record"), "group_id")
    return others.unionByName(heads).select(F.col("group_id").alias("group_cell_key"), F.col("record").alias("cell_key"))
