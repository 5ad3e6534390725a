"""Every registered inventory query against its SQL, at the smallest scale."""

import math
from decimal import Decimal

import duckdb
import pytest

from stockyard.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in registry.SQL:
        cur = duck.execute(registry.SQL[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["i3_work_items", "l1_latest_state", "l10_best_per_identifier", "l16_failure_digest", "d6_resolve_verticals", "q2_top_categories"])
def test_partitioning_does_not_matter(spark, sf, name, monkeypatch):
    from stockyard.plans import views

    found = []
    for n in (1, 17):
        monkeypatch.setattr(registry, "spark_view", lambda s, d, v, n=n: views.spark_view(s, d, v).repartition(n))
        df = registry.QUERIES[name](spark, sf)
        found.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    assert found[0] == found[1]
