"""Every registered query that has SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from echoloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["wavelet_energies", "ridge_features", "event_method_curves", "mixture_build", "subset_search", "kde_overlap", "stage_scores", "mrmr_ranking", "pca2"]


@pytest.mark.parametrize("name", FAST)
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_mmd_of_many_suppliers_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(17)
    frame = pd.DataFrame({"s_suppkey": np.arange(6000)})
    frame["s_acctbal"] = np.round(rng.normal(size=6000) * np.where(frame["s_suppkey"] % 2, 0.3, 1.0), 3) * 20 + (frame["s_suppkey"] % 2)
    spark.createDataFrame(frame).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    got = catalogue.QUERIES["mmd_exact"](spark, str(tmp_path)).toPandas()
    assert got["mmd2"][0] > 0 and plain(got) == plain(con.sql(catalogue.ORACLE_SQL["mmd_exact"]).df())
