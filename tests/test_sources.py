"""Sources, stores, the resumable stream and the staged evaluation on small inputs."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_volumes import dense, volume
from voxelith.operators import blockops, predict, sampling
from voxelith.operators.grid import Box, block_grid
from voxelith.plans import domain, evaluation
from voxelith.sources import specs, stores, volumes
from voxelith.streaming.resume import process_requests

ROOT = "/root/testdata/sf0.001"


def test_volume_round_trip_and_pruning(spark, tmp_path):
    array = np.random.default_rng(0).integers(1, 100, (6, 7, 8))
    path = str(tmp_path / "v")
    volumes.write_volume(volume(spark, array), path, (4, 4, 4))
    box = Box((1, 2, 3), (4, 4, 4))
    back = volumes.read_volume(spark, path, box)
    assert back.count() == 64
    assert np.array_equal(dense(back, "v", array.shape)[1:5, 2:6, 3:7], array[1:5, 2:6, 3:7])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(z), IsNotNull(y), IsNotNull(x), GreaterThanOrEqual(z,1)" in plan


@pytest.mark.parametrize("mode, shape", [("pad", (5, 6, 7)), ("crop", (3, 4, 5)), ("keep", None)])
def test_write_groups(spark, tmp_path, mode, shape):
    arrays = {n: (volume(spark, np.ones(s, dtype=int)), s) for n, s in (("raw", (5, 6, 7)), ("seg", (3, 4, 5)), ("x", (5, 6, 7)))}
    assert volumes.write_groups(arrays, str(tmp_path), ["raw", "seg"], mode) == ["raw", "seg"]
    for name in ("raw", "seg"):
        want = np.prod(shape or arrays[name][1])
        assert spark.read.parquet(str(tmp_path / name)).count() == want
    assert not (tmp_path / "x").exists()


def test_pack_chunks_round_trip(spark):
    array = np.random.default_rng(1).integers(1, 100, (5, 6, 7))
    chunks = volumes.pack_chunks(volume(spark, array), "v", (4, 4, 4))
    assert chunks.count() == 8
    assert np.array_equal(dense(volumes.unpack_chunks(chunks, "v", (4, 4, 4)), "v", array.shape), array)


def write_zarr(path, array, chunks, compressor, order="C", sep="."):
    path.mkdir(parents=True)
    meta = {"chunks": list(chunks), "shape": list(array.shape), "dtype": array.dtype.str, "order": order,
            "compressor": compressor, "fill_value": 0, "filters": None, "zarr_format": 2, "dimension_separator": sep}
    (path / ".zarray").write_text(json.dumps(meta))
    (path / ".zattrs").write_text(json.dumps({"resolution": [20, 9, 9], "offset": [0, 0, 0]}))
    counts = [-(-s // c) for s, c in zip(array.shape, chunks)]
    for key in np.ndindex(*counts):
        cell = np.zeros(chunks, dtype=array.dtype)
        part = array[tuple(slice(k * c, (k + 1) * c) for k, c in zip(key, chunks))]
        cell[tuple(slice(0, n) for n in part.shape)] = part
        raw = cell.tobytes(order)
        if compressor and compressor["id"] == "zlib":
            raw = zlib.compress(raw)
        elif compressor:
            zstandard = pytest.importorskip("zstandard")
            raw = zstandard.ZstdCompressor(level=5).compress(raw)
        target = path / sep.join(map(str, key))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(raw)


@pytest.mark.parametrize("compressor, order, sep", [
    (None, "C", "."), ({"id": "zlib", "level": 1}, "F", "."), ({"id": "zstd", "level": 5}, "C", "/"),
])
def test_zarr_scan(spark, tmp_path, compressor, order, sep):
    array = np.random.default_rng(2).integers(0, 255, (5, 6, 7)).astype("u1")
    write_zarr(tmp_path / "a.zarr" / "raw", array, (2, 4, 3), compressor, order, sep)
    path = str(tmp_path / "a.zarr" / "raw")
    whole = volumes.read_zarr(spark, path)
    assert whole.count() == array.size
    assert np.array_equal(dense(whole, "v", array.shape), array)
    box = Box((1, 1, 2), (2, 3, 4))
    assert volumes.read_zarr(spark, path, box).count() == 24
    meta, attrs = volumes.zarr_metadata(spark, path)
    spec = specs.resolve_spec(path, attrs, tuple(meta["shape"]), "uint8")
    assert (spec.voxel_size, spec.roi, spec.interpolatable) == ((20, 9, 9), Box((0, 0, 0), (100, 54, 63)), True)


def test_zarr_with_channels(spark, tmp_path):
    array = np.random.default_rng(3).random((3, 4, 4, 4)).astype("f4")
    write_zarr(tmp_path / "affs", array, (3, 2, 2, 2), None)
    rows = volumes.read_zarr(spark, str(tmp_path / "affs"), Box((0, 0, 0), (2, 4, 4))).collect()
    assert len(rows) == 3 * 2 * 16
    for r in rows:
        assert r.v == pytest.approx(float(array[r.c, r.z, r.y, r.x]))


def test_npy_scan(spark, tmp_path):
    cube = np.linspace(-1, 1, 60).reshape(1, 3, 4, 5)
    np.save(tmp_path / "cube_01.npy", cube)
    rows = volumes.read_npy(spark, str(tmp_path), "signed").collect()
    want = ((cube[0] / 2 + 0.5) * 255).astype("uint8")
    assert len(rows) == 60
    assert all(r.v == want[r.z, r.y, r.x] and r.cube == "cube_01" for r in rows)


def test_specs(spark, tmp_path):
    spec = specs.resolve_spec("a.n5", {"resolution": [9, 9, 20], "offset": [1, 2, 3]}, (4, 5, 6), "uint64")
    assert (spec.voxel_size, spec.roi.begin, spec.interpolatable) == ((20, 9, 9), (3, 2, 1), False)
    plain = specs.resolve_spec("a.zarr", {}, (3, 4, 5, 6), "float32")
    assert plain.voxel_size == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        specs.resolve_spec("a.zarr", {}, (4, 5, 6), "uint8", specs.ArraySpec(dtype="uint64"))
    assert specs.parse_name("volumes/raw") == ("volumes/raw", None)
    assert specs.parse_name("volumes/raw[3,7]") == ("volumes/raw", [3, 7])
    with pytest.raises(NotImplementedError):
        specs.parse_name("raw[1:3]")
    roi = tmp_path / "roi.json"
    roi.write_text('{"container": "/data/a.zarr",\n "offset": [50, 40, 30],\n "size": [10, 20, 30]}')
    assert specs.read_container(spark, str(roi)) == ("/data/a.zarr", Box((50, 40, 30), (10, 20, 30)))


def test_catalogue_listing(spark, tmp_path):
    base = str(tmp_path)
    for name in ("g/raw", "g/multi/s0", "g/multi/s1"):
        spark.range(3).write.parquet(f"{base}/{name}")
    found = [p.removeprefix(base) for p in specs.expand_group(spark, f"{base}/g")]
    assert found == ["/g/multi", "/g/raw"]
    assert specs.open_path(spark, f"{base}/g/multi").endswith("/s0")
    assert specs.open_path(spark, f"{base}/g/raw").endswith("/raw")


def test_project_axis(spark):
    df = volume(spark, np.arange(24).reshape(2, 3, 4))
    got = specs.project(df, ("z",), [40], (0,), (40,))
    assert got.columns == ["y", "x", "v"] and got.count() == 12


def test_read_cubes(spark, tmp_path):
    for i in (2, 0, 1):
        spark.range(2).write.parquet(str(tmp_path / f"cube_{i}.parquet"))
    df = volumes.read_cubes(spark, str(tmp_path), limit=2)
    assert sorted({r.cube for r in df.collect()}) == ["cube_0", "cube_1"]
    with pytest.raises(FileNotFoundError):
        volumes.read_cubes(spark, str(tmp_path), "*.orc")


def test_versioned_table(spark, tmp_path):
    store = stores.VersionedTable(spark, str(tmp_path / "scores"))
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = lambda *r: spark.createDataFrame(list(r), "k int, run_type string, v double")
    store.upsert(rows((1, None, 1.0), (2, "a", 2.0)), ["k", "run_type"])
    store.upsert(rows((1, None, 5.0)), ["k", "run_type"])
    assert sorted((r.k, r.v) for r in store.read().collect()) == [(1, 5.0), (2, 2.0)]
    (tmp_path / "scores" / "v2").mkdir()  # an attempt that never finished
    assert store.find("k = 1").count() == 1
    store.upsert(rows((3, "b", 3.0)), ["k", "run_type"])
    assert store.read().count() == 3
    with pytest.raises(LookupError):
        stores.VersionedTable(spark, store.path).find("k = 9")
        store.upsert(rows().where("false"), ["k", "run_type"])
        spark.createDataFrame([], "k int").write.parquet(str(tmp_path / "none" / "v0"))
        stores.VersionedTable(spark, str(tmp_path / "none")).projection(["k"])


def test_lut_partition_pruning(spark, tmp_path):
    lut = spark.createDataFrame([(10, 1, 1), (29, 1, 2), (29, 2, 2)], "threshold_pct int, fragment bigint, segment bigint")
    path = str(tmp_path / "lut")
    stores.write_lut(lut, path)
    at = stores.read_lut(spark, path, 0.29)
    assert at.count() == 2
    assert "PartitionFilters: [isnotnull(threshold_pct" in at._jdf.queryExecution().executedPlan().toString()


def test_site_lut_blocks_add_up(spark, tmp_path):
    path = str(tmp_path / "sites")
    for rows in ([(1, 7), (2, 0)], [(3, 0), (4, 9)]):
        stores.append_site_lut(spark.createDataFrame(rows, "id bigint, fragment bigint"), path)
    lut, background = stores.read_site_lut(spark, path)
    assert sorted(tuple(r) for r in lut.collect()) == [(1, 7), (4, 9)]
    assert background.first()[0] == 2


def test_run_groups(spark, tmp_path):
    groups = {"A": {"runs": {"r1": {"scores_db_name": "s1"}, "r2": {"wandb": "w"}}}, "B": {"runs": {"r3": None}}}
    got = {r.run_name: (r.group_name, r.scores_db_name) for r in stores.run_groups(spark, groups).collect()}
    assert got == {"r1": ("A", "s1"), "r2": ("A", None), "r3": ("B", None)}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None), (None, None)], "name string, erl double")
    stores.write_scores_csv(df, str(tmp_path / "csv"))
    back = stores.read_scores_csv(spark, str(tmp_path / "csv"), "name string, erl double")
    assert sorted(r.name for r in back.collect()) == ["a", "b"]


def test_split_folders(spark, tmp_path):
    cubes = spark.createDataFrame([(0, 1), (27, 2), (40, 3)], "cube_id int, v int")
    lists = sampling.split_table(spark, {"training": [0, 1], "validation": [27], "testing": []})
    assigned = sampling.assign_split(cubes, lists)
    target = str(tmp_path / "split")
    stores.write_splits(assigned, target, dry_run=True)
    assert not specs.exists(spark, target)
    stores.write_splits(assigned, target)
    assert specs.children(spark, target)[-2:] == ["split=training", "split=validation"]
    with pytest.raises(Exception, match="already exists"):
        stores.write_splits(assigned, target)


def test_stream_resumes(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    blocks = block_grid(spark, Box((0, 0, 0), (16, 8, 8)), (4, 4, 4)).select("block_id", "bz", "by", "bx")
    work = lambda batch: batch.select("block_id", (F.col("bz") * 2).alias("v"))
    args = (at("requests"), at("done"), at("out"), at("checkpoint"), work)
    blocks.where("block_id < 10").repartition(3).write.mode("append").parquet(at("requests"))
    process_requests(spark, *args, files_per_batch=2)
    assert stores.read_done(spark, at("done")).count() == 10
    blocks.write.mode("append").parquet(at("requests"))  # asks again for the finished ones
    process_requests(spark, *args)
    out = spark.read.parquet(at("out"))
    assert out.count() == 16 and out.select("block_id").distinct().count() == 16
    process_requests(spark, *args)
    assert stores.read_done(spark, at("done")).count() == 16


@pytest.mark.parametrize("hierarchical", [False, True])
def test_staged_evaluation(spark, tmp_path, hierarchical):
    cfg = evaluation.Config(
        setup="s", workspace=str(tmp_path), grid_yx=(2, 2), block=(16, 16, 16), context=(2, 2, 2), min_seed_distance=3,
        fragment_threshold=0.3, points=[10, 40, 70], merge_function="hist_quant_50", hierarchical=hierarchical,
        epsilon=0.05 if hierarchical else 0.0, filter_fragments=0.1 if hierarchical else 0.0,
    )
    raw = domain.voxels(spark, ROOT).select("z", "y", "x", "raw")
    sites, edges = domain.sites(spark, ROOT), domain.site_edges(spark, ROOT)
    halves = {"val": "component % 2 = 0", "test": "component % 2 = 1"}
    annotations = {k: (sites.where(c), edges) for k, c in halves.items()}
    model = predict.linear_model([0.5, -0.3, 0.2], [0.5, 0.5, 0.6])
    if hierarchical:  # the same, with a neighbourhood
        voxel_wise, means = model, predict.box_mean_model()
        model = predict.BlockModel(lambda b: voxel_wise(means.apply(b)[0].reshape(-1, 1)).T.reshape(3, *(n - 2 for n in b.shape[1:])), means.context)
    synapses = {"val": edges.where("source % 3 = 0")}
    evaluation.run(spark, cfg, list(evaluation.STAGES), raw, model, annotations, synapses=synapses)
    table = stores.VersionedTable(spark, cfg.at("scores")).read()
    assert table.count() == 6
    rows = table.where("split = 'val'").orderBy("pct").collect()
    assert all(r.synapse_voi is not None for r in rows)
    assert all(0 <= r.erl <= r.max_erl for r in rows)
    counts = [r.number_of_segments for r in rows]
    assert counts == sorted(counts, reverse=True)
    best = min(rows, key=lambda r: (r.voi, r.pct)).pct
    assert evaluation.resolve_threshold(spark, cfg) == best / 100
    segmentation = spark.read.parquet(cfg.at("segmentation"))
    assert segmentation.count() == raw.count()
    evaluation.run(spark, cfg, ["evaluate"], annotations=annotations)
    assert stores.VersionedTable(spark, cfg.at("scores")).read().count() == 6


def test_stage_names_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        evaluation.run(spark, evaluation.Config("s", str(tmp_path), (1, 1)), ["fragments", "print"])


def test_load_symbol():
    assert predict.load_symbol("voxelith.operators.predict.linear_model") is predict.linear_model


def test_zarr_fill_value(spark, tmp_path):
    array = np.arange(1, 4 * 8 * 6 + 1).reshape(4, 8, 6).astype("<i4")
    write_zarr(tmp_path / "raw", array, (2, 4, 3), None)
    meta = json.loads((tmp_path / "raw" / ".zarray").read_text())
    (tmp_path / "raw" / ".zarray").write_text(json.dumps(meta | {"fill_value": 7}))
    (tmp_path / "raw" / "0.1.1").unlink()
    array[0:2, 4:8, 3:6] = 7
    want = {(z, y, x, int(v)) for (z, y, x), v in np.ndenumerate(array)}
    path = str(tmp_path / "raw")
    assert {tuple(r) for r in volumes.read_zarr(spark, path).collect()} == want
    assert {tuple(r) for r in volumes.read_zarr(spark, path, keep_zero=False).collect()} == want
    box = Box((1, 3, 2), (2, 3, 3))
    inside = {w for w in want if all(b <= c < e for c, b, e in zip(w, box.begin, box.end))}
    assert {tuple(r) for r in volumes.read_zarr(spark, path, box).collect()} == inside


def test_zarr_box_opens_only_its_chunks(spark, tmp_path):
    array = np.arange(1, 4 * 8 * 6 + 1).reshape(4, 8, 6).astype("<i4")
    write_zarr(tmp_path / "raw", array, (2, 4, 3), None)
    rows = volumes.read_zarr(spark, str(tmp_path / "raw"), Box((0, 0, 0), (2, 4, 6)), keep_zero=False)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan
    scan = [n for n in _nodes(rows._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan binaryFile")]
    assert [n.metrics().apply("numFiles").value() for n in scan] == [2]


def _nodes(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_npy_with_channels_is_refused(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((1, 2, 2, 2)))
    assert volumes.read_npy(spark, str(tmp_path)).count() == 8
    np.save(tmp_path / "b.npy", np.zeros((2, 2, 2, 2)))
    with pytest.raises(Exception, match="channels would be lost"):
        volumes.read_npy(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("order, kind", [("C", "<f4"), ("F", ">i2")])
def test_npy_cube_is_many_slabs(spark, tmp_path, order, kind):
    cube = np.asarray(np.random.default_rng(6).integers(0, 99, (1, 5, 7, 6)), dtype=kind, order=order)
    np.save(tmp_path / "a.npy", cube)
    np.save(tmp_path / "flat.npy", np.ones((2, 3)))
    np.save(tmp_path / "none.npy", np.ones((0, 2, 2)))
    rows = volumes.read_npy(spark, str(tmp_path), slab_bytes=100)
    assert rows.rdd.getNumPartitions() > 8
    got = {(r.z, r.y, r.x): r.v for r in rows.where("cube = 'a'").collect()}
    assert got == {p: cube[0][p] for p in np.ndindex(5, 7, 6)}
    assert rows.where("cube <> 'a'").count() == 6


def test_npy_reads_no_more_than_its_slab(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(1000.0).reshape(10, 10, 10))
    slabs = list(volumes._npy_slabs(f"file:{tmp_path}/a.npy", 800).itertuples())
    assert [s.first for s in slabs] == list(range(0, 1000, 100))
    (tmp_path / "a.npy").write_bytes((tmp_path / "a.npy").read_bytes()[: slabs[0].offset + 1600])
    assert sum(len(f) for f in volumes._npy_rows(slabs[1], None)) == 100
    with pytest.raises(ValueError, match="ends early"):
        list(volumes._npy_rows(slabs[2], None))


@pytest.mark.parametrize("stage", ["fragments", "agglomerate"])
def test_killed_stage_does_only_the_rest(spark, tmp_path, monkeypatch, stage):
    def config(name, **more):
        return evaluation.Config(
            "s", str(tmp_path / name), (2, 2), (4, 16, 16), (2, 2, 2), 0.3, 3, points=[40], merge_function="hist_quant_50", hierarchical=True, **more
        )

    raw = domain.voxels(spark, ROOT).select("z", "y", "x", "raw")
    whole, cfg = config("whole"), config("parts", layers=1)
    model = predict.linear_model([0.5, -0.3, 0.2], [0.5, 0.5, 0.6])
    before = ["predict", "fragments"][: 1 if stage == "fragments" else 2]
    evaluation.run(spark, whole, [*before, stage], raw, model)
    evaluation.run(spark, cfg, before, raw, model)
    name = {"fragments": "watershed", "agglomerate": "merge_trees"}[stage]
    real, seen = getattr(blockops, name), []

    def dies_at_the_second(*args, **kwargs):
        seen.append(kwargs["layers"])
        if len(seen) == 2:
            raise RuntimeError("killed")
        return real(*args, **kwargs)

    monkeypatch.setattr(blockops, name, dies_at_the_second)
    with pytest.raises(RuntimeError, match="killed"):
        evaluation.run(spark, cfg, [stage])
    cfg.resume = True
    evaluation.run(spark, cfg, [stage])
    layers = range(-(-(raw.agg(F.max("z")).first()[0] + 1) // 4))
    assert seen == [(0, 1), (1, 2), *[(k, k + 1) for k in layers if k >= 1]]
    table = {"fragments": "fragments", "agglomerate": "edges_hist_quant_50"}[stage]
    rows = [sorted(spark.read.parquet(c.at(table)).collect()) for c in (whole, cfg)]
    assert rows[0] == rows[1] and rows[0]
    evaluation.run(spark, cfg, [stage])  # all is logged
    assert len(seen) == 2 + len(layers) - 1
    cfg.min_seed_distance, cfg.merge_function = 4, "mean"
    if stage == "fragments":  # other settings have a log of their own
        evaluation.run(spark, cfg, [stage])
        assert len(seen) == 2 + len(layers) - 1 + len(layers)
