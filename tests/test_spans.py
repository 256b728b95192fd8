"""Sweeps by spans give the scores of one row a point."""

import pytest
from pyspark.sql import functions as F

from voxelith.operators import components, contingency, skeletons, spans

POINTS = [0, 10, 20, 30]
KEY = ["threshold_pct"]


@pytest.fixture(scope="module")
def made(spark):
    ids = spark.range(1, 41).select("id")
    pairs = spark.range(1, 40).selectExpr("id AS u", "id + 1 AS v", "(id * 7) % 50 / 100D AS merge_score")
    lut = components.sweep(ids, pairs, POINTS).localCheckpoint()
    # two of three rows lie in background; some fragments have no entry
    sites = spark.range(300).selectExpr("id % 9 AS component", "IF(id % 3 = 0, (id * 13) % 43, 0) AS seg", "id % 4 + 1 AS n")
    pieces = spark.range(400).selectExpr(
        "id % 9 AS component", "IF(id % 5 = 0, 0, (id * 3) % 43) AS su", "(id * 3) % 43 + IF(id % 2 = 0, 1, 0) AS sv",
        "1 + id % 7 / 8D AS length",
    )
    return lut, sites, pieces


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def listed(df):
    return df.withColumn("threshold_pct", F.explode(F.filter(F.array(*map(F.lit, POINTS)), lambda p: (p >= df["first"]) & (p <= df["last"])))).drop("first", "last")


def test_spans_are_the_sweep(made):
    lut, sites, pieces = made
    held = spans.spans(lut)
    assert held.count() < lut.count() / 1.5
    assert rows(listed(held)) == rows(lut)
    for df, columns in ((sites, ["seg"]), (pieces, ["su", "sv"])):
        got = spans.at_spans(df, held, POINTS, columns)
        assert rows(listed(got)) == rows(skeletons.at_points(df, lut, POINTS, columns))


def test_background_is_dealt(made):
    # one key for all of background would be one task
    plan = spans.at_spans(made[1], spans.spans(made[0]), POINTS, ["seg"])._jdf.queryExecution().toString()
    assert "xxhash64" in plan


def test_scores_by_spans(made):
    lut, sites, pieces = made
    held = spans.spans(lut)
    nodes, edges = spans.at_spans(sites, held, POINTS, ["seg"]), spans.at_spans(pieces, held, POINTS, ["su", "sv"])
    nodes0, edges0 = skeletons.at_points(sites, lut, POINTS, ["seg"]), skeletons.at_points(pieces, lut, POINTS, ["su", "sv"])
    table = contingency.contingency(nodes, "component", "seg", ["first", "last"], weight="n")
    table0 = contingency.contingency(nodes0, "component", "seg", KEY, weight="n")
    assert rows(contingency.rand_voi(table, points=POINTS)) == rows(contingency.rand_voi(table0, KEY))
    count = table0.select(*KEY, "seg").distinct().groupBy(*KEY).agg(F.count("*").alias("number_of_segments"))
    assert rows(contingency.segment_counts(table, POINTS)) == rows(count)
    for omit in (True, False):
        want = skeletons.expected_run_length(edges0, skeletons.merging_segments(nodes0, KEY), KEY, omit)
        assert rows(skeletons.expected_run_length_at(edges, skeletons.merging_at(nodes, POINTS), POINTS, omit)) == rows(want)


def test_no_edges(spark, made):
    none = made[2].where("FALSE").selectExpr("*", "0 AS first", "30 AS last")
    assert skeletons.expected_run_length_at(none, spark.createDataFrame([], "seg bigint, merges array<boolean>"), POINTS).count() == 0
