"""Queries against the same in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from basketgraph.plans import queries

SF = "/root/testdata/sf0.001"
NAMES = ["standardize_items", "mapping_log", "regroup_items", "cooccurrence_edges", "adjacency", "locate_header", "top_nodes", "skipgram_pairs", "negative_sampling", "knn_edges", "modularity", "covariance", "minmax_scale", "random_walks", "pca_projection"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [d[columns].sort_values(columns).astype(str).values.tolist() for d in (ours, theirs)]
    assert rows[0] == rows[1]
