"""Every registered query of the tree operators against its SQL."""

import os

import duckdb
import pytest

from treeplan import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got or name in ("shifted_ranges", "max_delete")
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()), key=repr)


def test_golden_sizes(spark):
    d = "/root/testdata/sf0.01"
    got = {r.action: (r.files, r.bytes) for r in catalog.plan_summary(spark, d).collect()}
    assert got == {"copy_new": (50, 159148), "copy_full": (250, 636148), "skip": (700, 1590909)}
    assert catalog.hardlink_groups(spark, d).count() == 125
    assert catalog.delete_plan(spark, d).count() == 40


def test_pruned_plan(spark, sf):
    text = catalog.plan_default(spark, sf) if hasattr(catalog, "plan_default") else catalog.QUERIES["plan_default"](spark, sf)
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "FullOuter" not in plan
