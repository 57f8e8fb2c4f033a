"""The registered queries: names, SQL pairs, the flagship query, and a sample of results."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_sql import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("media_kinds", "identity_keys", "folder_grid_layout", "search_many_top", "knn_cosine", "cache_migrations",
          "kmeans_labels", "debounced_input", "similar_with_map")


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100
    assert set(SAMPLE) <= set(sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["media_id", "score", "cluster", "x", "y"] and df.count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cur = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
