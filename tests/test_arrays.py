"""The chunked array source: both formats, pruning by pushed boxes, repeated tasks, refused rows."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import write_zarr
from tests.test_volumes import dense, volume
from voxelith.operators.grid import Box
from voxelith.sources import arrays
from voxelith.sources.arrays import Layout

SHAPE, CHUNK = (5, 6, 7), (2, 4, 3)


def cube(seed=0, kind="u1"):
    return np.random.default_rng(seed).integers(1, 200, SHAPE).astype(kind)


@pytest.mark.parametrize("kind, packing", [("zarr", None), ("zarr", "zstd"), ("n5", "gzip"), ("n5", None)])
def test_round_trip(spark, tmp_path, kind, packing):
    path, array = str(tmp_path / "a"), cube()
    arrays.write_array(volume(spark, array), "v", path, Layout(kind, SHAPE, CHUNK, "<u2" if kind == "zarr" else ">u2", packing))
    back = arrays.read_array(spark, path)
    assert back.columns == ["z", "y", "x", "v"] and back.count() == array.size
    assert np.array_equal(dense(back, "v", SHAPE), array)
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("_")]


def test_reads_blocks_of_others(spark, tmp_path):
    """N5 by hand: big-endian, x fastest, small edge blocks, a missing block, a block with a length."""
    array = cube(1, ">i4")
    meta = {"dimensions": [7, 6, 5], "blockSize": [3, 4, 2], "dataType": "int32", "compression": {"type": "gzip", "useZlib": True}}
    (tmp_path / "attributes.json").write_text(json.dumps(meta))
    for z, y, x in np.ndindex(3, 2, 3):
        block = array[2 * z : 2 * z + 2, 4 * y : 4 * y + 4, 3 * x : 3 * x + 3]
        if (z, y, x) == (1, 1, 1):
            array[2:4, 4:6, 3:6] = 0
            continue
        mode = int((z, y, x) == (0, 0, 0))
        head = struct.pack(">HHIII", mode, 3, *block.shape[::-1]) + (struct.pack(">I", block.size) if mode else b"")
        target = tmp_path / str(x) / str(y) / str(z)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(head + zlib.compress(block.tobytes()))
    assert np.array_equal(dense(arrays.read_array(spark, str(tmp_path)), "v", SHAPE), array)
    assert arrays.read_array(spark, str(tmp_path), keep_zero=False).count() == np.count_nonzero(array)


def test_box_opens_only_its_chunks(spark, tmp_path):
    array = cube(2)
    write_zarr(tmp_path / "a", array, CHUNK, None, "F", "/")
    for key in np.ndindex(3, 2, 3):
        if key not in ((1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)):
            (tmp_path / "a" / "/".join(map(str, key))).write_bytes(b"broken")
    box = Box((2, 3, 1), (2, 2, 4))
    rows = arrays.read_array(spark, str(tmp_path / "a")).where(box.contains())
    assert {(r.z, r.y, r.x): r.v for r in rows.collect()} == {
        (z, y, x): array[z, y, x] for z in (2, 3) for y in (3, 4) for x in range(1, 5)
    }
    assert "BatchScan" in rows._jdf.queryExecution().executedPlan().toString()
    reader = arrays.ArrayReader(str(tmp_path / "a"), arrays.stored_layout(*arrays.open_store(str(tmp_path / "a"))), True)
    list(reader.pushFilters([arrays.GreaterThanOrEqual(("z",), 2), arrays.LessThan(("z",), 4), arrays.EqualTo(("x",), 4)]))
    assert sum(p.last - p.first for p in reader.partitions()) == 2
    with pytest.raises(Exception, match="buffer size|reshape"):
        arrays.read_array(spark, str(tmp_path / "a")).count()
    assert arrays.read_array(spark, str(tmp_path / "a")).where("z > 90").count() == 0


def test_channels_and_fill_value(spark, tmp_path):
    path = str(tmp_path / "a")
    cells = spark.createDataFrame([(1, 0, 1, 2, 0.5), (0, 1, 1, 1, None)], "c int, z int, y int, x int, p double")
    arrays.write_array(cells, "p", path, Layout("zarr", (2, 3, 2, 3), (1, 2, 2, 2), "<f4", "zlib", fill=-1.0))
    back = {(r.c, r.z, r.y, r.x): r.v for r in arrays.read_array(spark, path).collect()}
    assert len(back) == 36 and back.pop((1, 0, 1, 2)) == 0.5 and set(back.values()) == {-1.0}


def test_region_update_keeps_other_cells(spark, tmp_path):
    path, array = str(tmp_path / "a"), cube(3)
    arrays.write_array(volume(spark, array), "v", path, Layout("n5", SHAPE, CHUNK, ">u1", "gzip"))
    region = volume(spark, array).where("z = 3 AND x > 1").withColumn("v", F.lit(7))
    for _ in range(2):  # once more changes nothing
        arrays.write_array(region, "v", path)
    want = array.copy()
    want[3, :, 2:] = 7
    assert np.array_equal(dense(arrays.read_array(spark, path), "v", SHAPE), want)
    arrays.write_array(region, "v", path, Layout("n5", SHAPE, CHUNK, ">u1", "gzip"), mode="overwrite")
    assert arrays.read_array(spark, path, keep_zero=False).count() == 6 * 5


def test_failed_write_leaves_no_array_and_a_repeat_mends_it(spark, tmp_path):
    path, array, layout = str(tmp_path / "a"), cube(4), Layout("zarr", SHAPE, CHUNK, "|u1", "zlib")
    bad = volume(spark, array).withColumn("v", F.when(F.expr("z = 4 AND x = 6"), 300).otherwise(F.col("v")))
    with pytest.raises(Exception, match="doesn't fit"):
        arrays.write_array(bad, "v", path, layout)
    with pytest.raises(Exception, match="no array at"):
        arrays.read_array(spark, path)
    arrays.write_array(volume(spark, array).where("z < 4"), "v", path, layout)
    array[4] = 0  # nothing of the failed write is left
    assert np.array_equal(dense(arrays.read_array(spark, path), "v", SHAPE), array)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("mine")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="not empty"):
            arrays.write_array(volume(spark, array), "v", str(tmp_path / "other"), layout, mode)


def test_second_attempt_at_a_task_is_harmless(tmp_path):
    """A task that died after some chunks, then ran whole, and a late twin of it."""
    import pyarrow as pa

    path, array, layout = str(tmp_path / "a"), cube(5), Layout("zarr", SHAPE, CHUNK, "|u1", "zlib")
    writer = arrays.ArrayWriter({"path": path, "array": json.dumps(layout.__dict__)}, ["z", "y", "x", "v"], False)
    rows = [(*p, int(array[p])) for k in np.ndindex(3, 2, 3) for p in np.ndindex(*SHAPE) if tuple(i // c for i, c in zip(p, CHUNK)) == k]
    batches = [pa.RecordBatch.from_pylist([dict(zip("zyxv", r)) for r in rows[i : i + 11]]) for i in range(0, len(rows), 11)]

    def dies():
        yield from batches[:7]
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(dies())
    message = writer.write(iter(batches))
    assert (message.first, message.last) == (0, 17) == (writer.write(iter(batches)).first, 17)
    writer.commit([message, None, arrays.Written(None, None)])
    reader = arrays.ArrayReader(path, arrays.stored_layout(*arrays.open_store(path)), True)
    back = np.zeros(SHAPE, int)
    for p in reader.partitions():
        for b in reader.read(p):
            back[tuple(b.column(a).to_numpy() for a in "zyx")] = b.column("v").to_numpy()
    assert np.array_equal(back, array)
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([message, arrays.Written(17, 20)])


@pytest.mark.parametrize("rows, error", [
    ([(0, 0, 9, 1)], "outside"), ([(0, 0, 0, 1), (0, 0, 0, 2)], "two rows"), ([(0, None, 0, 1)], "without a place"), ([(0, 0, 0, -1)], "doesn't fit"),
])
def test_refused_rows(spark, tmp_path, rows, error):
    voxels = spark.createDataFrame(rows, "z long, y long, x long, v long")
    with pytest.raises(Exception, match=error):
        arrays.write_array(voxels, "v", str(tmp_path / "a"), Layout("zarr", SHAPE, CHUNK, "|u1"))


def test_rows_out_of_order_are_refused(spark, tmp_path):
    arrays.register(spark)
    rows = spark.createDataFrame([(4, 0, 0, 1), (0, 0, 0, 1)], "z long, y long, x long, v long").coalesce(1)
    layout = json.dumps(Layout("zarr", SHAPE, CHUNK, "|u1").__dict__)
    with pytest.raises(Exception, match="sorted by chunk"):
        rows.write.format(arrays.NAME).mode("append").option("array", layout).save(str(tmp_path / "a"))


def test_empty_array(spark, tmp_path):
    path = str(tmp_path / "a")
    none = spark.createDataFrame([], "z long, y long, x long, v long")
    arrays.write_array(none, "v", path, Layout("zarr", (0, 4, 4), (2, 2, 2), "|u1"))
    assert arrays.read_array(spark, path).count() == 0
