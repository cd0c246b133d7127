from datetime import datetime as D

from cellweft.operators import references as R

REF = "table_name string, row_id long, registry string, ref_key string, loaded_at timestamp_ntz"
KEY = "registry string, ref_key string, registered_at timestamp_ntz, deleted_at timestamp_ntz"
T1, T2, T3 = D(2031, 1, 1), D(2031, 2, 1), D(2031, 3, 1)


def ledger(spark, refs, keys):
    return R.merge(R.reference_deltas(spark.createDataFrame(refs, REF)), R.existence_deltas(spark.createDataFrame(keys, KEY)))


def test_states_in_order(spark):
    keys = [("a", "ok", T1, None), ("a", "ok", T1, None), ("a", "late", T2, T1), ("a", "gone", T1, T2), ("b", "miss", T1, None), ("a", None, T1, None), ("a", "free", None, None)]
    refs = [("t", 1, "a", "ok", T2), ("t", 2, "a", "late", T1), ("t", 3, "a", "late", T3), ("t", 4, "a", "gone", T2), ("t", 5, "a", "gone", T1), ("t", 6, "a", "miss", None), ("t", 7, "a", "gone", None), ("t", 8, "a", None, T1), ("t", 9, "a", "free", T3)]
    df = spark.createDataFrame(refs, REF)
    got = sorted(map(tuple, R.faulty_references(df, ledger(spark, refs, keys)).collect()))
    assert got == [("t", 2, "late", "2031-01"), ("t", 3, "deleted", "2031-03"), ("t", 4, "deleted", "2031-02"), ("t", 6, "missing", "unknown")]
    assert [tuple(r) for r in R.orphan_keys(ledger(spark, refs, keys)).collect()] == [("a", "miss", 1)]


def test_deltas_in_any_order_and_removals(spark):
    k = spark.createDataFrame([("a", "x", T1, None)], KEY)
    r = spark.createDataFrame([("t", 1, "a", "x", T2), ("t", 2, "a", "y", T2)], REF)
    one = R.merge(R.existence_deltas(k), R.reference_deltas(r))
    two = R.merge(R.merge(R.reference_deltas(r)), R.existence_deltas(k))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    # The registration goes: x is an orphan; its reference goes too: nothing is left of it.
    less = R.merge(one, R.existence_deltas(k, -1))
    assert sorted(r_["ref_key"] for r_ in R.orphan_keys(less).collect()) == ["x", "y"]
    none = R.merge(less, R.reference_deltas(r, -1))
    assert none.collect() == []


def test_retracted_times_go(spark):
    """A registration of 5 January is replaced by one of 5 March; the reference was loaded on 1 February, in any order of merging."""
    old, new = D(2031, 1, 5), D(2031, 3, 5)
    refs = spark.createDataFrame([("t", 1, "a", "x", T2)], REF)
    reg = lambda at, sign: R.existence_deltas(spark.createDataFrame([("a", "x", at, None)], KEY), sign)
    first = R.merge(R.reference_deltas(refs), reg(old, 1))
    assert R.faulty_references(refs, first).collect() == []
    for deltas in ([reg(old, -1), reg(new, 1)], [reg(new, 1), reg(old, -1)]):
        led = first
        for d in deltas:
            led = R.merge(led, d)
        assert [tuple(r) for r in R.faulty_references(refs, led).collect()] == [("t", 1, "late", "2031-02")]
    # A deletion that is taken back, and a reference that moves to a later month.
    gone = R.existence_deltas(spark.createDataFrame([("a", "x", old, T1)], KEY))
    undone = R.merge(R.merge(R.reference_deltas(refs), gone), R.existence_deltas(spark.createDataFrame([("a", "x", old, T1)], KEY), -1), reg(old, 1))
    assert R.faulty_references(refs, undone).collect() == []


def test_empty(spark):
    assert ledger(spark, [], []).collect() == []
    assert R.faulty_references(spark.createDataFrame([], REF), ledger(spark, [], [])).collect() == []
