"""Every registered query of the engine's own operators against its SQL, on whole tables."""

import duckdb
import pytest

from lodestrata.plans.oracle import SQL
from lodestrata.plans.queries import FOUND

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query_equals_sql(spark, duck, name):
    df = FOUND[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert name in ("canonical_patch", "failure_classification") and rows
        return
    want = duck.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert columns == sorted(df.columns)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted((rounded(r[c] for c in columns) for r in rows), key=repr) == sorted((rounded(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_entry_works_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(FOUND) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__._optional("lodestrata.no_such_part") is None
