"""Every registered query against its SQL, at the size at which ties and rare values show."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tallyspark.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    df, sql = QUERIES[name](spark, DATA), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())
