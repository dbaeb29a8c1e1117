"""Registered queries against their DuckDB SQL at the smallest scale. PLANS=all runs every one."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from marlstone import plans

SF = "/root/testdata/sf0.001"
SOME = "e01_age m05_timing f08_due_within c01_triage c05_checklist c07_readiness t01_kind t04_cost x08_canonical_url k01_similar_titles v04_merge h01_quota h04_repeat u10_upsert a11_strength s02_nested_load".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if not isinstance(v, (bool, int)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()) if os.environ.get("PLANS") == "all" else SOME)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = plans.queries()[name](spark, SF)
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry_is_registered(spark):
    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["user_id", "opp_id", "score", "confidence", "place"]
