"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from tidelag.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A fixed threshold of which no row is left on the smallest tables.
MAY_BE_EMPTY = {"jaccard_fuzzy", "pair_correlation", "vacated_opportunity"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.6g}") or 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toArrow()
    if name not in MAY_BE_EMPTY:
        assert found.num_rows
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert rows(found.column_names, [tuple(r.values()) for r in found.to_pylist()]) == rows(names, want.fetchall())
