"""A task that looks at neighbours holds a bounded number of rows, whatever the volume's size."""

import pytest

from voxelith import session
from voxelith.operators import components, neighbours, rag
from voxelith.plans import domain

ROWS = [(z, y, 0, 1 + z // 8, 10, 20, 30) for z in range(64) for y in range(4)]


def test_parts():
    assert [session.parts(n, 10) for n in (0, 1, 10, 11, 100)] == [1, 1, 1, 2, 10]


@pytest.mark.parametrize("known", [True, False])
def test_neighbours_split_by_rows(spark, monkeypatch, known):
    voxels = spark.createDataFrame(ROWS, "z bigint, y bigint, x bigint, frag bigint, az bigint, ay bigint, ax bigint")
    monkeypatch.setattr(neighbours, "parts", lambda rows: session.parts(rows, 8))
    near = neighbours.with_neighbours(voxels, ["frag"], size=(4, 4, 4), rows=len(ROWS) if known else None)
    assert near.rdd.getNumPartitions() == len(ROWS) // 8
    faces = rag.faces(voxels, size=(4, 4, 4), rows=len(ROWS) if known else None)
    assert sorted(map(tuple, faces.collect())) == sorted((k, k + 1, 10) for k in range(1, 8) for _ in range(4))


def test_scans_are_asked_for_while_writing_only(spark):
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    assert session.cut_lineage(spark.range(5), scans=7).count() == 5
    assert spark.conf.get(key, None) == before


def test_a_stored_tables_tasks_follow_its_rows(spark):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(k, None) for k in keys]
    stored = session.cut_lineage(spark.range(10000).selectExpr("id % 5000 AS id").groupBy("id").count(), shuffles=40)
    assert stored.count() == 5000 and len(stored.inputFiles()) == 40
    assert [spark.conf.get(k, None) for k in keys] == before


def test_voxels_and_edges_are_stored_by_rows(spark, monkeypatch, tmp_path):
    lines = spark.range(4096).selectExpr(
        "id div 4 AS l_orderkey", "CAST(1 + id % 4 AS INT) AS l_linenumber", "id % 7 / 100D AS l_discount",
        "id % 5 / 100D AS l_tax", "CAST(40 + id % 9 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice",
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    whole = sorted(map(tuple, domain.rag_edges(spark, str(tmp_path)).collect()))
    for module in (domain, neighbours):
        monkeypatch.setattr(module, "parts", lambda rows, task_rows=256: session.parts(rows, 256))
    voxels = domain.fragment_voxels(spark, str(tmp_path))
    assert len(voxels.inputFiles()) == 16
    edges = domain.rag_edges(spark, str(tmp_path), voxels=voxels)
    assert 8 < len(edges.inputFiles()) <= 16
    assert sorted(map(tuple, edges.collect())) == whole and len(whole) > 0


def test_a_sweeps_tasks_follow_its_rows(spark, monkeypatch):
    """Nodes at every point, their labels and the forest's edges are split by rows, with the same segments."""
    points = [0, 10, 20, 30]
    nodes = session.cut_lineage(spark.range(1, 400).select("id"))
    pairs = spark.range(1, 390).selectExpr("id AS u", "id + 1 + id % 3 AS v", "(id * 7) % 50 / 100D AS merge_score")
    whole = {forest: sorted(map(tuple, components.sweep(nodes, pairs, points, forest).collect())) for forest in (False, True)}
    for module in (session, components):
        monkeypatch.setattr(module, "TASK_ROWS", 64)
    monkeypatch.setattr(session, "parts", lambda rows, task_rows=64: max(1, -(-rows // task_rows)))
    monkeypatch.setattr(components, "parts", session.parts)
    for forest in (False, True):
        swept = components.sweep(nodes, pairs, points, forest)
        assert swept.rdd.getNumPartitions() == -(-399 * len(points) // 64)
        assert sorted(map(tuple, swept.collect())) == whole[forest]
    cuts = []
    monkeypatch.setattr(components, "cut_lineage", lambda df, **tasks: cuts.append(tasks) or session.cut_lineage(df, **tasks))
    components.minimum_forest(pairs)
    assert {"scans": 4, "shuffles": 13} in cuts and {"scans": 2, "shuffles": 7} in cuts


def test_fragments_are_stored_by_rows(spark, monkeypatch):
    stored = session.cut_lineage(spark.range(4096).selectExpr("id % 1000 AS frag"))
    monkeypatch.setattr(domain, "parts", lambda rows, task_rows=256: session.parts(rows, 256))
    ids = domain.fragment_ids(stored)
    assert len(ids.inputFiles()) == 16 and sorted(r.id for r in ids.collect()) == list(range(1000))


@pytest.mark.parametrize("name", ["hist_quant_50", "hist_quant_75_initmax", "quantile_90"])
def test_every_scores_tasks_follow_its_rows(spark, monkeypatch, name):
    """What finds quantiles of faces is split by rows as the mean is, before and after the edges' shuffle."""
    voxels = spark.createDataFrame(ROWS, "z bigint, y bigint, x bigint, frag bigint, az bigint, ay bigint, ax bigint")
    stored = session.cut_lineage(voxels)
    cuts = []
    monkeypatch.setattr(domain, "cut_lineage", lambda df, **tasks: cuts.append((tasks, df)) or session.cut_lineage(df, **tasks))
    for module in (domain, neighbours):
        monkeypatch.setattr(module, "parts", lambda rows, task_rows=16: session.parts(rows, 16))
    edges = domain.rag_edges(spark, "", name, voxels=stored)
    assert [c[0] for c in cuts] == [{"scans": len(ROWS) // 16, "shuffles": len(ROWS) // 16}]
    assert sorted((r.u, r.v, round(r.merge_score, 6), r.n_faces) for r in edges.collect()) == [
        (k, k + 1, round(1 - 10 / 255, 6), 4) for k in range(1, 8)
    ]
