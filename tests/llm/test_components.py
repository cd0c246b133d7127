import numpy as np
import pytest

from cellweft.llm import components


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, k in links:
        if r is not None and k is not None:
            parent[find(("r", r))] = find(("k", k))
    groups = {}
    for x in list(parent):
        if x[0] == "r":
            groups.setdefault(find(x), []).append(x[1])
    return sorted((r, min(g)) for g in groups.values() for r in g)


def run(spark, links, **k):
    df = spark.createDataFrame(links, "record string, match_key string")
    return sorted(map(tuple, components.linked_groups(df, **k).collect()))


@pytest.mark.parametrize("rounds", [None, 1, 4])
def test_chains_hub_and_singles(spark, rounds):
    chain = [(f"c{i:03d}", f"k{i}") for i in range(60)] + [(f"c{i:03d}", f"k{i + 1}") for i in range(60)]
    hub = [(f"h{i:03d}", "hub") for i in range(80)] + [("h001", "k0x"), ("z", "k0x")]
    rng = np.random.default_rng(2)
    small = [(f"s{rng.integers(90)}", f"m{rng.integers(70)}") for _ in range(90)]
    links = chain + hub + small + [("lone", "only"), (None, "hub"), ("lone", None), ("lone", "only")]
    assert run(spark, links, thin_rounds=rounds) == brute(links)


@pytest.mark.parametrize("rounds", [None, 1])
def test_thin_tail_of_the_giant_component(spark, rounds):
    links = [(f"h{i:04d}", "hub") for i in range(300)] + [("h0000", "t0")] + [(f"t{i}", f"t{i + d}") for i in range(9) for d in (0, 1)]
    assert run(spark, links, thin_rounds=rounds) == brute(links)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []


def test_clone_groups_drop_singles_and_blank(spark):
    m = spark.createDataFrame(
        [("c1", "A|S|1", "member"), ("C1 ", "a|s|2", None), ("c2", "A|S|3", "member"), ("c1", "A|S|4", "filtered"), (" ", "A|S|5", "member"), ("c1", "", "member")],
        "clone_id string, cell_key string, membership_status string")
    a = spark.createDataFrame([("A", "S", "3", "c9"), ("A", "S", "6", "c9"), ("A", "S", None, "c9"), ("A", "S", "7", "")], "sample_id string, slice_id string, cellbin_id string, clone_id string")
    got = sorted(map(tuple, components.clone_groups(m, a).collect()))
    assert got == [("A|S|1", "A|S|1"), ("A|S|1", "A|S|2"), ("A|S|3", "A|S|3"), ("A|S|3", "A|S|6")]
