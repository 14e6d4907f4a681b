"""Every catalogue query with SQL, on both engines."""

import math
from pathlib import Path

import duckdb
import pytest

from strandline.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = sorted((tuple(_plain(r[i]) for i in places) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr) == wanted


def test_rounding_is_that_of_the_sql(spark):
    """Halves of a millionth and the doubles beside them, of either sign."""
    halves = [(k + 0.5) / 1e6 * sign for k in range(64_215_000, 64_216_000) for sign in (1, -1)]
    values = [v for h in halves for v in (math.nextafter(h, 0), h, math.nextafter(h, 1000 * h))] + [0.0, -1e-9, 1e300, float("inf")]
    found = [r["v"] for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i").select(catalogue.r6("x").alias("v")).collect()]
    rows = duckdb.connect().execute("SELECT round(x, 6) + 0e0 FROM (SELECT unnest(?::DOUBLE[]) AS x, unnest(range(?)) AS i) ORDER BY i", [values, len(values)]).fetchall()
    assert found == [r[0] for r in rows]


def test_catalogue_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
