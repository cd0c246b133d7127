"""Every core query on whole tables against its SQL; those without SQL must run."""

import importlib

import pytest

import __spark_entry__ as entry
from oracle import connect, spark_rows, sql_rows

REGISTRIES = [importlib.import_module(f"cellweft.plans.{m}").R for m in entry.CORE]
SQL = {k: (r.queries[k], r.sql[k]) for r in REGISTRIES for k in r.sql}
PLAIN = {k: q for r in REGISTRIES for k, q in r.queries.items() if k not in r.sql}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    query, sql = SQL[name]
    d = sf("0.01")
    assert spark_rows(query(spark, d)) == sql_rows(connect(d), sql)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_other_queries_run(spark, sf, name):
    df = PLAIN[name](spark, sf("0.001"))
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_imported_by_nothing_else():
    from pathlib import Path

    root = Path(entry.__file__).parent / "cellweft"
    inside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert inside and not [p for p in inside if "cellweft.llm" in p.read_text()]
