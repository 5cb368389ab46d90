import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textlode import catalog

TABLES = "lineitem customer events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    want = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, got.collect())
    assert found == rows(want.columns, want.fetchall())
    assert found


@pytest.mark.parametrize("name", ["match_structures", "classify_contents", "view_decoded", "view_normalised"])
def test_texts_made_of_one_group_of_rows_are_shared_out(spark, name):
    found = [r["count"] for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(found) == (7_500 if name == "match_structures" else 15_000)
    assert len(found) >= spark.sparkContext.defaultParallelism and max(found) < sum(found) / 3


def test_overlap_kept_equals_a_loop(spark, sf):
    groups: dict = {}
    for r in catalog.spans(spark, sf).collect():
        groups.setdefault((r["path"], r["rule_id"]), []).append((r["s"], -r["e"], r["ordinal"]))
    want = set()
    for key, spans in groups.items():
        reach = -1
        for s, e, ordinal in sorted(spans):
            if s >= reach:
                want.add((*key, ordinal))
                reach = -e
    assert {tuple(r) for r in catalog.QUERIES["overlap_kept"](spark, sf).collect()} == want


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
