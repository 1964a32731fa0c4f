import math
import os

import duckdb
import pytest

from quillstone.plans import registry

SF = "/root/testdata/sf0.01"


def _text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(rows):
    return sorted("|".join(f"{n}={_text(r[n])}" for n in sorted(r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(r.asDict() for r in found.collect()) == _rows(dict(zip(columns, r)) for r in cur.fetchall())
