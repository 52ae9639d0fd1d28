"""Reports over all ranked candidates."""

import duckdb
import pytest

from ctxgraph.plans import matrix


@pytest.mark.parametrize("name", ["relation_groups_all", "import_counts_all"])
def test_all_candidates_are_included(spark, name):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(tuple, db.execute(matrix.ORACLES[name]).fetchall()))
    got = sorted(map(tuple, matrix.QUERIES[name](spark, sf).collect()))
    assert got == want
    capped = matrix.QUERIES[name.removesuffix("_all")](spark, sf).collect()
    print(name, len(got), len(capped))
    if name == "relation_groups_all":
        assert len(got) == matrix.edges(spark, sf).select("src", "dst", "kind").distinct().count() > len(capped)
