"""A sample of the registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["scan_messages", "clean_text", "build_pairs", "sample_n", "tfidf_weights", "retrieve_sparse",
                                  "threshold_sweep", "spearman", "handle_batch", "density_clusters", "classification_report"])
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ngrams_shuffles_rows_not_terms(spark, plan):
    assert "Generate" not in plan(entry.queries()["ngrams"](spark, SF), "simple")
