"""Queries through array files: volumes derived from the tables, written in chunks and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.grid import Box
from voxelith.plans import domain
from voxelith.plans.domain import sql
from voxelith.plans.registry import query
from voxelith.session import ensure_checkpoint_dir
from voxelith.sources import arrays

DEPTH = "(SELECT max((l_orderkey * 8 + l_linenumber) // 1024) + 1 FROM lineitem)"


def _fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _layout(spark: SparkSession, root: str, kind: str, dtype: str, packing: str) -> arrays.Layout:
    return arrays.Layout(kind, domain.volume_box(spark, root).shape, (16, 16, 16), dtype, packing)


@query(
    "array_source_box",
    sql("vox", body=f"""SELECT a.z, b.y, c.x, coalesce(raw, 0) AS v FROM range(10, 60) a(z), range(4, 20) b(y), range(8, 31) c(x)
        LEFT JOIN vox ON vox.z = a.z AND vox.y = b.y AND vox.x = c.x WHERE a.z < {DEPTH}"""),
)
def array_source_box(spark: SparkSession, root: str) -> DataFrame:
    """The raw volume as a zarr array; a box of it, which opens only that box's chunks."""
    path = _fresh_path(spark, "raw.zarr")
    arrays.write_array(domain.voxels(spark, root).select("z", "y", "x", "raw"), "raw", path, _layout(spark, root, "zarr", "|u1", "zlib"))
    return arrays.read_array(spark, path).where(Box((10, 4, 8), (50, 16, 23)).contains())


@query(
    "array_region_update",
    sql("vox", body="SELECT z, y, x, v FROM (SELECT z, y, x, CASE WHEN y >= 6 AND y < 21 THEN frag ELSE gt END AS v FROM vox) WHERE v <> 0"),
)
def array_region_update(spark: SparkSession, root: str) -> DataFrame:
    """Truth labels as an N5 array, fragments written over a slab that cuts chunks; all labels of the result."""
    path = _fresh_path(spark, "labels.n5")
    voxels = domain.voxels(spark, root)
    arrays.write_array(voxels.select("z", "y", "x", "gt"), "gt", path, _layout(spark, root, "n5", ">u8", "gzip"))
    arrays.write_array(voxels.where("y >= 6 AND y < 21").select("z", "y", "x", F.col("frag")), "frag", path)
    return arrays.read_array(spark, path, keep_zero=False).where("v <> 0")
