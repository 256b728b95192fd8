"""Physical plans: pushdown, pruning, shuffles, and operators that must not appear."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from voxelith.operators import contingency, neighbours
from voxelith.plans import domain
from voxelith.sources.tables import table

ROOT = "/root/testdata/sf0.001"

LAZY = [
    "rag_mean_affinity", "rag_hist_quant_75", "fragment_centers", "gt_affinities", "grow_boundary_xy", "max_filter_maxima",
    "chunk_stitch_last_wins", "block_halo_counts", "roi_intersection", "skeleton_edges", "expected_run_length", "split_stats",
    "merge_stats", "error_counts", "running_best", "val_to_test_transfer", "ingroup_rank", "upsert_scores", "rand_voi",
    "site_fragment_lut", "values_around_sites", "line_sample", "balance_weights", "combined_loss", "split_lists_disjoint",
    "halfsynth_names", "global_fragment_ids", "masked_affinities",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_nothing_quadratic_or_global(spark, name):
    text = plan(queries()[name](spark, ROOT))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # a window without partition keys would put all rows in one task
    assert not re.search(r"windowspecdefinition\([a-z_]+#\d+L? (ASC|DESC)", text)
    assert "BatchEvalPython" not in text  # no row-at-a-time functions


def test_neighbours_cost_one_shuffle(spark):
    voxels = spark.read.parquet(f"{ROOT}/lineitem.parquet").selectExpr("l_orderkey AS z", "l_partkey AS y", "l_suppkey AS x", "l_linenumber AS v")
    text = plan(neighbours.with_neighbours(voxels, ["v"], sides=("lower", "upper")))
    assert text.count("Exchange") == 1
    assert text.count("FileScan") == 1


def test_rand_voi_joins_nothing(spark):
    items = table(spark, ROOT, "lineitem", "l_suppkey", "l_linenumber")
    text = plan(contingency.rand_voi(contingency.contingency(items, "l_suppkey", "l_linenumber")))
    assert "Join" not in text and text.count("FileScan") == 1


def test_top_k_is_not_a_sort(spark):
    scores = table(spark, ROOT, "supplier", "s_suppkey", "s_acctbal").toDF("cluster", "v")
    assert "TakeOrderedAndProject" in plan(contingency.worst(scores, "v"))


def test_scan_reads_only_needed_columns(spark):
    text = plan(domain.sites(spark, ROOT))
    assert "ReadSchema: struct<event_id:bigint>" in text
    text = plan(domain.reports(spark, ROOT).where(F.col("setup") == 3))
    assert "EqualTo(l_suppkey,3)" in text


def test_lead_shares_its_shuffle(spark):
    text = plan(queries()["skeleton_edges"](spark, ROOT))
    assert text.count("REPARTITION_BY_COL") == 2  # same exchange twice: one is reused at run time


@pytest.mark.parametrize("name", ["roi_box_scan", "slice_mid_z", "center_crop", "import_center_crop"])
def test_boxes_reach_the_scan(spark, name):
    plan = queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey" in plan and "LessThan(l_" in plan
