"""Hand-computed fixtures for overlap, skeleton, graph and score operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelith.functions import losses, strings
from voxelith.operators import components, contingency, ordering, rag, relabel, scores, skeletons


def labels(spark, gt, seg):
    return spark.createDataFrame(list(zip(gt, seg)), "gt bigint, s bigint")


def voi(spark, gt, seg, **kw):
    return contingency.rand_voi(contingency.contingency(labels(spark, gt, seg), "gt", "s", **kw)).first()


def test_voi_by_hand(spark):
    row = voi(spark, (1, 1, 2, 2), (1, 1, 1, 2))
    assert (row.voi_split, row.voi_merge, row.voi) == (0.5, 0.688722, 1.188722)
    assert (row.rand_split, row.rand_merge) == (0.75, 0.6)


def test_voi_identity_and_background(spark):
    row = voi(spark, (1, 1, 2, 3), (7, 7, 8, 9))
    assert (row.voi, row.rand_split, row.rand_merge) == (0.0, 1.0, 1.0)
    assert voi(spark, (0, 0, 1), (1, 2, 3), ignore_truth_zero=True).voi == 0.0
    assert voi(spark, (0, 0, 1), (1, 2, 3)).voi > 0


def test_cluster_scores_add_up(spark):
    rng = random.Random(3)
    table = contingency.contingency(
        labels(spark, [rng.randrange(5) for _ in range(300)], [rng.randrange(7) for _ in range(300)]), "gt", "s"
    )
    total = contingency.rand_voi(table).first()
    for by, name, want in (("gt", "voi_split_i", total.voi_split), ("seg", "voi_merge_j", total.voi_merge)):
        assert contingency.cluster_voi(table, by).agg(F.sum(name)).first()[0] == pytest.approx(want, abs=1e-4)


def skeleton(spark, segs):
    nodes = [(1, 1, 0.0, 0.0, 0.0), (2, 1, 3.0, 0.0, 0.0), (3, 1, 3.0, 4.0, 0.0), (4, 2, 0.0, 0.0, 0.0), (5, 2, 0.0, 0.0, 5.0)]
    rows = [(*n, s) for n, s in zip(nodes, segs)]
    nodes = spark.createDataFrame(rows, "id bigint, component bigint, z double, y double, x double, seg bigint")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 99)], "source bigint, target bigint")
    return nodes, skeletons.attribute_edges(nodes, edges)


def test_erl_by_hand(spark):
    nodes, edges = skeleton(spark, (10, 10, 11, 12, 12))
    row = skeletons.expected_run_length(edges, skeletons.merging_segments(nodes)).first()
    assert (row.erl, row.max_erl, row.total_path_length) == (2.833333, 6.166667, 12.0)
    assert [tuple(r) for r in skeletons.split_pairs(edges).collect()] == [(1, 10, 11)]
    assert skeletons.merge_pairs(nodes).count() == 0


def test_erl_merging_segment(spark):
    nodes, edges = skeleton(spark, (10, 10, 11, 12, 10))
    row = skeletons.expected_run_length(edges, skeletons.merging_segments(nodes)).first()
    assert row.erl == 0.0
    docs = skeletons.merge_documents(skeletons.merge_pairs(nodes)).collect()
    assert sorted(tuple(d) for d in docs) == [(10, 1, False), (10, 2, True)]


def test_erl_background_flag(spark):
    nodes, edges = skeleton(spark, (0, 0, 11, 12, 12))
    merging = skeletons.merging_segments(nodes)
    assert skeletons.expected_run_length(edges, merging).first().erl == round(25 / 12, 6)
    assert skeletons.expected_run_length(edges, merging, omit_background=False).first().erl == round(34 / 12, 6)


EDGES = [(1, 2, 0.1), (2, 3, 0.3), (4, 5, 0.2), (1, 3, 0.9)]


def groups(rows):
    out = {}
    for fragment, segment in rows:
        out.setdefault(segment, set()).add(fragment)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("forest", [False, True])
def test_components_by_hand(spark, forest):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id bigint")
    edges = spark.createDataFrame(EDGES, "u bigint, v bigint, merge_score double")
    lut = components.sweep(nodes, edges, [0, 20, 30], forest).collect()
    at = lambda t: groups([(r.fragment, r.segment) for r in lut if r.threshold_pct == t])
    assert at(0) == [[i] for i in range(1, 7)]
    assert at(20) == [[1, 2], [3], [4, 5], [6]]
    assert at(30) == [[1, 2, 3], [4, 5], [6]]


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "shuffled_path"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(shape)
    ids = rng.sample(range(10**12), 120)
    if shape == "random":
        edges = [tuple(rng.sample(ids, 2)) for _ in range(100)]
    elif shape == "star":
        edges = [(max(ids), n) for n in ids if n != max(ids)]
    else:
        order = sorted(ids) if shape == "path" else ids
        edges = list(zip(order, order[1:]))
    want = union_find(ids, edges)
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    table = spark.createDataFrame(edges, "u bigint, v bigint")
    for chunk in (7, 10**6):  # many chunks put the work on the star loop
        got = components.connected_components(nodes, table, chunk).collect()
        assert {r.id: r.component for r in got} == want
    stars = {r.child: r.parent for r in components.star_forest(table).collect()}
    assert {n: stars.get(n, n) for n in ids} == want


def test_forest_keeps_every_threshold(spark):
    rng = random.Random(5)
    ids = list(range(40))
    rows = [(*sorted(rng.sample(ids, 2)), rng.randrange(0, 60) / 100) for _ in range(400)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    edges = spark.createDataFrame(rows, "u bigint, v bigint, merge_score double").cache()
    forest = components.minimum_forest(edges)
    assert forest.count() <= len(ids) - 1
    points = [0, 1, 2, 5, 29, 57, 58]
    for reduce, chunk in ((True, 10**6), (False, 10**6), (False, 9)):
        lut = components.sweep(nodes, edges, points, reduce, chunk).collect()
        for p in points:
            want = union_find(ids, [(u, v) for u, v, s in rows if round(s * 100) <= p])
            assert {r.fragment: r.segment for r in lut if r.threshold_pct == p} == want


def test_sweep_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id bigint")
    none = spark.createDataFrame([], "u bigint, v bigint, merge_score double")
    for forest in (False, True):
        assert {(r.fragment, r.segment) for r in components.sweep(nodes, none, [10], forest).collect()} == {(1, 1), (2, 2)}


def test_relabel(spark):
    voxels = spark.createDataFrame([(0,), (1,), (2,), (9,)], "frag bigint")
    lut = spark.createDataFrame([(1, 5), (2, 5)], "fragment bigint, segment bigint")
    keep = {r.frag: r.segment for r in relabel.relabel(voxels, lut, "frag").collect()}
    zero = {r.frag: r.segment for r in relabel.relabel(voxels, lut, "frag", missing="zero").collect()}
    assert keep == {0: 0, 1: 5, 2: 5, 9: 9}
    assert zero == {0: 0, 1: 5, 2: 5, 9: 0}


def test_dense_ids(spark):
    got = relabel.densify(spark.createDataFrame([(0,), (40,), (7,), (40,)], "l bigint"), "l").collect()
    assert sorted((r.l, r.dense) for r in got) == [(0, 0), (7, 1), (40, 2), (40, 2)]
    rng = random.Random(1)
    ids = [rng.randrange(2**62) for _ in range(200)] + list(range(65530, 65545)) + [2**16 * k for k in range(20)]
    ranked = ordering.dense_ids(spark.createDataFrame([(i,) for i in ids], "l bigint"), "l").collect()
    assert {r.l: r.dense for r in ranked} == {v: i for i, v in enumerate(sorted(set(ids)))}


def test_next_in_group_matches_lead(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(500)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, t bigint")
    got = ordering.next_in_group(df, "k", ["t", "id"], F.expr("t div 10"), "id", "nxt").collect()
    for key in (1, 2, 3):
        order = [i for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])) if k == key]
        want = dict(zip(order, [*order[1:], None]))
        assert {r.id: r.nxt for r in got if r.k == key} == want


def test_group_rank_and_std(spark):
    df = spark.createDataFrame([("g", 10.0), ("g", 12.0), ("g", 9.0), ("h", 1.0)], "group_name string, erl double")
    ranks = {(r.group_name, r.erl): r.ingroup_rank for r in scores.ingroup_rank(df).collect()}
    assert ranks == {("g", 10.0): 2, ("g", 12.0): 1, ("g", 9.0): 3, ("h", 1.0): 1}
    std = {r.group_name: r.erl_std for r in scores.group_std(df, ["erl"]).collect()}
    assert std == {"g": 1.528, "h": None}


def test_transfer(spark):
    rows = [("s", "val", 10, 5.0), ("s", "val", 20, 8.0), ("s", "test", 10, 7.0), ("s", "test", 20, 6.0)]
    df = spark.createDataFrame(rows, "setup string, split string, pct int, erl double")
    row = scores.transfer(df, "erl", ["erl"]).first()
    assert (row.pct, row.erl) == (20, 6.0)


def test_best_point_takes_first_of_ties(spark):
    df = spark.createDataFrame([("s", 30, 1.0), ("s", 10, 1.0), ("s", 20, 2.0)], "setup string, pct int, voi double")
    assert scores.best_points(df, "voi", ["setup"]).first().pct == 10
    assert scores.best_points(df.withColumnRenamed("voi", "erl"), "erl", ["setup"]).first().pct == 20


def test_upsert_null_keys(spark):
    old = spark.createDataFrame([(1, None, 1.0), (2, "a", 2.0)], "k int, r string, v double")
    new = spark.createDataFrame([(1, None, 9.0), (3, None, 3.0)], "k int, r string, v double")
    got = sorted((r.k, r.v) for r in scores.upsert(old, new, ["k", "r"]).collect())
    assert got == [(1, 9.0), (2, 2.0), (3, 3.0)]


def test_edge_scores(spark):
    rows = [(1, 2, a) for a in (0, 51, 102, 153, 255)]
    df = spark.createDataFrame(rows, "u bigint, v bigint, aff bigint")
    value = lambda n: df.groupBy("u", "v").agg(rag.score(n).alias("s")).first().s
    assert value("mean") == round(1 - 561 / 5 / 255, 6)
    assert value("hist_quant_50") == 0.6
    assert value("hist_quant_75") == 0.4
    assert value("hist_quant_75_initmax") == 0.0
    assert len(rag.MERGE_FUNCTIONS) == 11
    with pytest.raises(ValueError):
        rag.score("median")


def test_strip_is_a_character_set(spark):
    df = spark.createDataFrame([("edges_hist_quant_75",), ("edges_sedge",)], "s string")
    got = [r[0] for r in df.select(strings.strip_chars(F.col("s"), "edges_")).collect()]
    assert got == ["hist_quant_75", ""]


def test_threshold_keys_round(spark):
    df = spark.createDataFrame([(0.29,), (0.57,), (0.58,), (0.0,)], "t double")
    assert [r[0] for r in df.select(strings.threshold_key(F.col("t"))).collect()] == [29, 57, 58, 0]


def test_setup_name(spark):
    paths = ["/m/09-11_21-54_a-rather-long-name/model_checkpoint_400000.pt", "/m/run/model_12345.pt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(strings.setup_name(F.col("p"))).collect()] == ["09-11_21-54_a-rather__400k", None]


def test_masked_mean_falls_back(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.0), (2.0, 4.0, 2.0)], "p double, t double, w double")
    assert df.agg(losses.weighted_mse("p", "t", "w")).first()[0] == 8.0
    flat = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 5.0, 0.0)], "p double, t double, w double")
    assert flat.agg(losses.weighted_mse("p", "t", "w")).first()[0] == 0.0
    assert df.where("false").agg(losses.masked_total(F.col("p"), F.lit(True))).first()[0] == 0.0


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0], 1), ([1.0, 3.0], 0)], "l array<double>, y int")
    got = [r[0] for r in df.select(losses.cross_entropy_map(F.col("l"), F.col("y"))).collect()]
    total = math.log(math.exp(1) + math.exp(3))
    assert got == pytest.approx([total - 3, total - 1])


def test_sweep_points_are_exact(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    edges = spark.createDataFrame([(1, 2, 0.36), (2, 3, 0.3600004)], "u bigint, v bigint, merge_score double")
    got = {(r.threshold_pct, r.fragment): r.segment for r in components.sweep(nodes, edges, [29, 36, 37]).collect()}
    assert [got[29, i] for i in (1, 2, 3)] == [1, 2, 3]
    assert [got[36, i] for i in (1, 2, 3)] == [1, 1, 3]
    assert [got[37, i] for i in (1, 2, 3)] == [1, 1, 1]
    fine = {(r.threshold_pct, r.fragment): r.segment for r in components.sweep(nodes, edges, [355, 360, 365], scale=1000).collect()}
    assert [fine[p, 3] for p in (355, 360, 365)] == [3, 3, 1] and fine[360, 2] == 1


def test_upsert_keeps_the_last_of_a_key(spark):
    schema = "k string, v int"
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], schema)
    new = spark.createDataFrame([("a", 4), ("c", 5), ("a", 6), (None, 7), ("c", 8)], schema).coalesce(1)
    assert sorted(map(tuple, scores.upsert(old, new, ["k"]).collect()), key=str) == sorted([("a", 6), ("b", 2), ("c", 8), (None, 7)], key=str)


def test_dense_ids_of_any_sign(spark):
    rows = [(-5,), (9,), (3,), (-5,), (0,), (None,), (-(1 << 62),), (1 << 62,)]
    df = spark.createDataFrame(rows, "l bigint")
    got = {r.l: r.dense for r in relabel.densify(df, "l").collect()}
    assert got == {-(1 << 62): 0, -5: 1, 0: 2, 3: 3, 9: 4, 1 << 62: 5, None: None}


def test_hot_background_is_dealt_evenly(spark):
    voxels = spark.range(20_000).selectExpr("id AS z", "id % 7 AS y", "0L AS x", "CASE WHEN id % 10 = 0 THEN id ELSE 0 END AS frag")
    lut = spark.range(1, 20_000).selectExpr("id AS fragment", "id + 1 AS segment")
    joined = voxels.alias("v").join(lut.alias("l").hint("merge"), relabel.on_label(voxels, "frag", "l.fragment"), "left")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    got = relabel.relabel(voxels, lut, "frag").agg(F.count("*"), F.sum("segment")).first()
    assert tuple(got) == (20_000, sum(i + 1 for i in range(10, 20_000, 10)))


def test_documents_have_one_layout_at_any_size(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 7)], "seg bigint, component bigint")
    got = sorted(tuple(d) for d in skeletons.merge_documents(pairs).collect())
    assert got == [(1, i, i == 24) for i in range(25)] + [(2, 7, True)]


def test_threshold_generators():
    assert components.thresholds_pct(0, 52, 2) == list(range(0, 51, 2))
    assert components.thresholds_between(0.0, 0.5, 3) == [0.0, 0.25, 0.5]
