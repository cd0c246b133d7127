"""Connected components of edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.session import cut, release


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id linked with each node whatever the direction; isolated nodes are their own.

    Each round every node takes the smallest node around it and the graph contracts to the nodes taken, so the number of rounds
    grows with the logarithm of the longest path.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    e = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        least = cut(e.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("to")))
        maps.append(least)
        nxt = cut(e.join(least.withColumnRenamed("to", "a"), "src").join(least.select(F.col("src").alias("dst"), F.col("to").alias("b")), "dst")
                  .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        release(e)
        e = nxt
    ids = nodes.select("id").distinct()
    if not maps:
        return ids.withColumn("component", F.col("id"))
    top = maps[-1]
    for m in reversed(maps[:-1]):
        top = m.join(top.select(F.col("src").alias("to"), F.col("to").alias("t")), "to", "left").select("src", F.coalesce("t", "to").alias("to"))
    # A root taken in a later round is the smallest of what it stood for, not always of all; the least member is the name.
    root = ids.join(top.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("to", "id").alias("root"))
    name = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(name, "root").select("id", "component")


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, n, rank): sizes, the largest first, ties by name (K5, C14)."""
    from cellweft.operators.markov import dense_index

    n = components.groupBy("component").agg(F.count("*").alias("n")).withColumn("_less", -F.col("n"))
    return dense_index(n, ["_less", "component"], "rank").select("component", "n", (F.col("rank") + 1).alias("rank"))


def strong_components(edges: list[tuple[str, str]], nodes: list[str]) -> dict[str, tuple[str, bool]]:
    """node -> (smallest node of its strong component, whether that class is closed). For coarse graphs that fit the driver.

    Tarjan's algorithm without recursion; a class is closed if no edge leaves it.
    """
    out: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    comp: dict[str, str] = {}
    for s in nodes:
        if s in index:
            continue
        index[s] = low[s] = len(index)
        stack.append(s), on.add(s)
        work = [(s, iter(out[s]))]
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w), on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    for w in members:
                        comp[w] = min(members)
    leaves = {comp[a] for a, b in edges if comp[a] != comp[b]}
    return {n: (comp[n], comp[n] not in leaves) for n in nodes}


def eigenvalue_gap(matrix: np.ndarray, top: int = 10) -> dict[str, object]:
    """Absolute eigenvalues of a coarse matrix, how many are 1, and 1 - |second|."""
    v = np.sort(np.abs(np.linalg.eigvals(matrix)))[::-1]
    return {"top": v[:top].tolist(), "n_unit": int((np.abs(v - 1) < 1e-8).sum()), "gap": float(1 - v[1]) if len(v) > 1 else 1.0}
