"""A third of all rows on one order, part, supplier and user: results must not change."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import TABLES, connect, mismatch

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "lineitem": "* REPLACE (CASE WHEN r % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey, CASE WHEN r % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey,"
                " CASE WHEN r % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey)",
    "orders": "* REPLACE (CASE WHEN r % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey)",
    "events": "* REPLACE (CASE WHEN r % 3 = 0 THEN 0 ELSE user_id END AS user_id)",
}
NAMES = [
    "flagship_sweep_voi", "rag_hist_quant_75", "relabel_volume", "densify_labels", "gt_affinities", "rand_voi", "voi_per_seg_cluster",
    "skeleton_edges", "expected_run_length", "split_documents", "merge_documents", "error_counts", "val_to_test_transfer",
    "ingroup_rank", "split_lists_disjoint", "site_fragment_lut", "seed_components", "edt_squared",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hot"))
    con = duckdb.connect()
    for t in TABLES:
        columns = HOT.get(t, "*")
        con.execute(
            f"COPY (SELECT {columns} EXCLUDE (r) FROM (SELECT *, row_number() OVER () AS r FROM '{SOURCE}/{t}.parquet')) TO '{root}/{t}.parquet' (FORMAT parquet)"
            if t not in HOT else
            f"COPY (SELECT * EXCLUDE (r) FROM (SELECT {columns} FROM (SELECT *, row_number() OVER () AS r FROM '{SOURCE}/{t}.parquet'))) TO '{root}/{t}.parquet' (FORMAT parquet)"
        )
    return root


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, hot, name):
    assert mismatch(queries()[name](spark, hot), connect(hot), oracle_sql()[name]) is None
