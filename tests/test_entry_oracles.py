"""Driver contract and every registered query against its DuckDB oracle (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from tidemark.plans.oracle import ORACLES
from tidemark.plans.queries import QUERIES
from tools.compare import TABLES, digest


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["station_id", "obs_ts", "snapshot_source_ts"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    s = E.queries()[name](spark, SMALL).toPandas()
    d = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert digest(s) == digest(d)


def test_score_batch_rows(spark):
    df = E.queries()["score_batch"](spark, SMALL)
    ok = E.queries()["obs_outcome"](spark, SMALL).where("outcome = 'ok'").count()
    rows = df.collect()
    assert len(rows) == ok and all(r["prediction"] == 42.0 for r in rows)


def test_scale_conf_sizes_partitions():
    from tidemark.session import scale_conf
    conf = scale_conf(100 * (1 << 40), total_cores=8000)  # 100 TiB on 1000 x 8 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600  # 100 TiB / 256 MiB
    assert scale_conf(1 << 20, total_cores=8)["spark.sql.shuffle.partitions"] == "24"


def test_modules_import_without_a_spark_session():
    """Nothing may build Spark columns at import time (the driver imports the
    entry module before it has a session)."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import tidemark, tidemark.streaming, tidemark.plans.oracle, __spark_entry__ as E;"
            "assert len(E.queries()) >= 31 and len(E.oracle_sql()) >= 31")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
