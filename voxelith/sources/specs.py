"""Dataset metadata: voxel size, offset, type rules, names, and box containers."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from voxelith.operators.grid import Box

log = logging.getLogger(__name__)

# Element types that may be interpolated when nothing else is said.
INTERPOLATABLE = ("float32", "float64", "float128", "uint8")


@dataclass(frozen=True)
class ArraySpec:
    """What is known about one dataset; ``None`` means "read it from the stored attributes"."""

    voxel_size: tuple[int, ...] | None = None
    roi: Box | None = None
    dtype: str | None = None
    interpolatable: bool | None = None


def resolve_spec(
    path: str, attributes: dict, shape: tuple[int, ...], dtype: str, given: ArraySpec = ArraySpec(), channels_first: bool = True
) -> ArraySpec:
    """Fill a spec from stored attributes; N5 containers store axes reversed.

    Missing resolution means unit voxels, missing offset means the origin; a given dtype must
    agree with the stored one.
    """
    turn = -1 if path.rstrip("/").endswith(".n5") else 1
    voxel_size = given.voxel_size
    if voxel_size is None and "resolution" in attributes:
        voxel_size = tuple(attributes["resolution"][::turn])
    if voxel_size is None:
        voxel_size = (1,) * len(shape)
        log.warning("%s has no resolution, assuming %s", path, voxel_size)
    roi = given.roi
    if roi is None:
        n = len(voxel_size)
        offset = tuple(attributes["offset"][::turn]) if "offset" in attributes else (0,) * n
        spatial = shape[-n:] if channels_first else shape[:n]
        roi = Box(offset, tuple(s * v for s, v in zip(spatial, voxel_size)))
    if given.dtype is not None and given.dtype != dtype:
        raise ValueError(f"{path}: dtype {given.dtype} given but {dtype} stored")
    interpolatable = given.interpolatable
    if interpolatable is None:
        interpolatable = dtype in INTERPOLATABLE
        log.warning("%s: interpolatable set to %s from dtype %s", path, interpolatable, dtype)
    return replace(given, voxel_size=voxel_size, roi=roi, dtype=dtype, interpolatable=interpolatable)


def parse_name(name: str) -> tuple[str, list[int] | None]:
    """``volume/raw[3,7]`` to the dataset and the fixed leading indices; ranges are refused."""
    base, bracket, rest = name.partition("[")
    if not bracket:
        return name, None
    parts = rest.rstrip("]").split(",")
    if any(":" in p for p in parts):
        raise NotImplementedError("ranges in dataset names")
    return base, [int(p) for p in parts]


def project(df, axes: tuple[str, ...], world: list[int], begin: tuple[int, ...], voxel_size: tuple[int, ...]):
    """Fix leading axes at world positions and drop them."""
    from pyspark.sql import functions as F

    for axis, at, b, v in zip(axes, world, begin, voxel_size):
        df = df.where(F.col(axis) == (at - b) // v).drop(axis)
    return df


def read_container(spark: SparkSession, path: str) -> tuple[str, Box]:
    """JSON box container ``{container, offset, size}``: a view over a larger dataset."""
    row = spark.read.schema("container string, offset array<bigint>, size array<bigint>").json(path, multiLine=True).first()
    return row["container"], Box(tuple(row["offset"]), tuple(row["size"]))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder; one that isn't there is no error."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    """Small metadata file; Spark's readers skip names that start with a dot."""
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a path, sorted; works on any Hadoop file system."""
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def open_path(spark: SparkSession, path: str) -> str:
    """The dataset itself, or its finest scale when it is a multiscale group."""
    has_data = any(not c.startswith((".", "_")) and c != "s0" for c in children(spark, path))
    if not has_data or exists(spark, f"{path}/s0"):
        if exists(spark, f"{path}/s0"):
            return f"{path}/s0"
        raise FileNotFoundError(path)
    return path


def is_multiscale(names: list[str]) -> bool:
    return bool(names) and all(n.startswith("s") for n in names)


def expand_group(spark: SparkSession, path: str, marker: str = "_SUCCESS") -> list[str]:
    """Datasets below a group, depth first; a multiscale group counts as one dataset."""
    names = children(spark, path)
    if marker in names:
        return [path]
    folders = [n for n in names if not n.startswith((".", "_"))]
    if is_multiscale(folders):
        return [path]
    found = []
    for name in folders:
        found += expand_group(spark, f"{path}/{name}", marker)
    return found
