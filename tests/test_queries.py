"""Every query against its SQL at the smallest size, and rows from the others."""

import duckdb
import pytest

from wakeline.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"score_slow_stratum", "score_colocation", "score_erratic", "detect", "iforest_by_type", "ping_pipeline_iforest", "ping_pipeline_staypoint"}


def values(rows):
    shown = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    assert values(got.select(columns).collect()) == values(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_has_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    assert name in ("distinct_stays", "stay_summary") or df.limit(1).count() == 1
