"""Volumes on disk: Parquet voxel tables, packed chunks, zarr chunk scans, npy cubes."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES, BLOCK, Box, block_of
from voxelith.operators.volumes import center_box, crop, pad
from voxelith.session import ship_package
from voxelith.sources.arrays import open_store
from voxelith.sources.specs import children, exists, read_text


def write_volume(voxels: DataFrame, path: str, block: tuple[int, int, int], mode: str = "errorifexists") -> None:
    """Voxel table clustered by block and sorted inside, so row-group statistics prune box scans.

    Range partitioning keeps neighbouring blocks in one file without a folder per block.
    """
    (
        voxels.select(*voxels.columns, *block_of(block))
        .repartitionByRange(*BLOCK)
        .sortWithinPartitions(*BLOCK, *AXES)
        .drop(*BLOCK)
        .write.mode(mode).option("compression", "zstd").parquet(path)
    )


def read_volume(spark: SparkSession, path: str, box: Box | None = None, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if box is not None:
        df = df.where(box.contains())
    return df.select(*AXES, *columns) if columns else df


def write_groups(
    arrays: dict[str, tuple[DataFrame, tuple[int, int, int]]],
    path: str,
    groups: list[str] | None = None,
    mode: str = "pad",
) -> list[str]:
    """Write named volumes, given as (voxels with ``v``, shape), side by side under one path.

    ``pad`` centres all in the largest shape, ``crop`` cuts all to the smallest, ``keep`` leaves
    them. Only names in ``groups`` are written; returns what was.
    """
    if mode not in ("pad", "crop", "keep"):
        raise ValueError(f"unknown mode {mode!r}")
    largest = tuple(max(s[i] for _, s in arrays.values()) for i in range(3))
    smallest = tuple(min(s[i] for _, s in arrays.values()) for i in range(3))
    written = []
    for name, (voxels, shape) in arrays.items():
        if groups is not None and name not in groups:
            continue
        if mode == "pad" and shape != largest:
            voxels = pad(voxels, "v", shape, largest)
        elif mode == "crop" and shape != smallest:
            voxels = crop(voxels, center_box(shape, smallest))
        voxels.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        written.append(name)
    return written


def pack_chunks(voxels: DataFrame, value: str, size: tuple[int, int, int]) -> DataFrame:
    """One row per chunk with its cells as sorted ``(index, value)`` pairs.

    A chunk has at most ``prod(size)`` cells, which bounds the array.
    """
    _, sy, sx = size
    index = ((F.col("z") - F.col("bz") * size[0]) * sy + F.col("y") - F.col("by") * sy) * sx + F.col("x") - F.col("bx") * sx
    blocks = voxels.select(*AXES, value, *block_of(size))
    return blocks.groupBy(*BLOCK).agg(
        F.sort_array(F.collect_list(F.struct(index.cast("int").alias("i"), F.col(value).alias("v")))).alias("cells")
    )


def unpack_chunks(chunks: DataFrame, value: str, size: tuple[int, int, int]) -> DataFrame:
    _, sy, sx = size
    rows = chunks.select(*BLOCK, F.inline("cells"))
    return rows.select(
        (F.col("bz") * size[0] + F.expr(f"i div {sy * sx}")).alias("z"),
        (F.col("by") * sy + F.expr(f"i div {sx} % {sy}")).alias("y"),
        (F.col("bx") * sx + F.expr(f"i % {sx}")).alias("x"),
        F.col("v").alias(value),
    )


def read_cubes(spark: SparkSession, root: str, pattern: str = "*.parquet", limit: int | None = None) -> DataFrame:
    """Every cube under a folder with its name; ``limit`` keeps the first cubes by name."""
    names = [n for n in children(spark, root) if n.endswith(pattern.lstrip("*"))]
    if not names:
        raise FileNotFoundError(f"no {pattern} under {root}")
    names = names[:limit]
    df = spark.read.parquet(*[f"{root}/{n}" for n in names])
    suffix = pattern.lstrip("*").replace(".", r"\.")
    return df.withColumn("cube", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+){suffix}(/|$)", 1))


SLAB_BYTES = 32 << 20


def _npy_slabs(path: str, slab_bytes: int) -> pd.DataFrame:
    """Ranges of a cube's cells from its header; nothing else of the file is read."""
    fs, inner = open_store(path)
    with fs.open_input_file(inner) as f:
        version = np.lib.format.read_magic(f)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"{path}: npy version {version} is not supported")
        read_header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read_header(f)
        offset = f.tell()
    if dtype.hasobject:
        raise ValueError(f"{path} holds objects")
    if any(n > 1 for n in shape[:-3]):
        raise ValueError(f"{path} has shape {shape}: channels would be lost")
    shape = ((1, 1, 1) + tuple(shape))[-3:]
    first = np.arange(0, int(np.prod(shape, dtype=object)), max(1, slab_bytes // dtype.itemsize))
    return pd.DataFrame({
        "path": path, "offset": offset, "first": first, "cells": max(1, slab_bytes // dtype.itemsize), "shape": [list(shape)] * len(first),
        "dtype": dtype.str, "fortran": fortran,
    })


def _npy_rows(slab, rescale: str | None):
    """Voxels of one range of cells, some at a time."""
    shape, dtype = tuple(int(n) for n in slab.shape), np.dtype(slab.dtype)
    stored = shape[::-1] if slab.fortran else shape
    end = min(slab.first + slab.cells, int(np.prod(shape, dtype=object)))
    fs, inner = open_store(slab.path)
    with fs.open_input_file(inner) as f:
        f.seek(slab.offset + slab.first * dtype.itemsize)
        for low in range(slab.first, end, 1 << 16):
            count = min(1 << 16, end - low)
            content = f.read(count * dtype.itemsize)
            if len(content) < count * dtype.itemsize:
                raise ValueError(f"{slab.path} ends early")
            cells = np.frombuffer(content, dtype)
            if rescale == "signed":
                cells = ((cells / 2.0 + 0.5) * 255).astype("uint8")
            elif rescale == "unit":
                cells = (cells * 255).astype("uint8")
            at = np.unravel_index(np.arange(low, low + count), stored)
            z, y, x = at[::-1] if slab.fortran else at
            name = slab.path.rsplit("/", 1)[-1].removesuffix(".npy")
            yield pd.DataFrame({"cube": name, "z": z, "y": y, "x": x, "v": cells.astype("float64")})


def read_npy(spark: SparkSession, path: str, rescale: str | None = None, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """``.npy`` cubes as voxels ``cube, z, y, x, v``; leading axes of length one are dropped.

    ``rescale`` maps [-1, 1] (``signed``) or [0, 1] (``unit``) to 0..255 by truncation. A cube of
    any size is many tasks: its header tells ranges of cells, and each range is read by itself.
    Spark lists the files; they are opened with the Arrow file systems.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0  # of the listing: no content is read

    def headers(batches):
        for pdf in batches:
            for name in pdf["path"]:
                slabs = _npy_slabs(name, slab_bytes)
                if len(slabs):  # a cube without cells has none
                    yield slabs

    def cells(batches):
        for pdf in batches:
            for slab in pdf.itertuples():
                yield from _npy_rows(slab, rescale)

    slabs = files.select("path").mapInPandas(
        headers, "path string, offset bigint, first bigint, cells bigint, shape array<bigint>, dtype string, fortran boolean"
    )
    slabs = slabs.repartition(min(100_000, size // slab_bytes + 1), "path", "first")
    return slabs.mapInPandas(cells, "cube string, z bigint, y bigint, x bigint, v double")


def zarr_metadata(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """``.zarray`` and ``.zattrs`` of a version-2 array."""
    texts = {n: json.loads(read_text(spark, f"{path}/{n}")) for n in (".zarray", ".zattrs") if exists(spark, f"{path}/{n}")}
    return texts[".zarray"], texts.get(".zattrs", {})


def _decode(content: bytes, compressor: dict | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return content
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if kind in ("zlib", "gzip"):
        return zlib.decompress(content, wbits=47)
    raise ValueError(f"unsupported compressor {kind!r}")


def read_zarr(spark: SparkSession, path: str, box: Box | None = None, keep_zero: bool = True) -> DataFrame:
    """Scan a zarr v2 array chunk by chunk: ``[c,] z, y, x, v``.

    Chunks outside the box (voxel units) are dropped by their file's path when Spark lists the
    files, so they are never opened; each of the others is decoded on its own. A chunk without a
    file holds the fill value: such chunks are the grid's keys less the files', and are made from
    it unless they hold nothing but zeros that aren't asked for.
    """
    ship_package(spark)
    meta, _ = zarr_metadata(spark, path)
    chunk, shape, dtype = meta["chunks"], meta["shape"], meta["dtype"]
    order, compressor, sep = meta.get("order", "C"), meta.get("compressor"), meta.get("dimension_separator", ".")
    names = (["c"] if len(shape) == 4 else []) + list(AXES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # a filter on the file's metadata alone is applied to the listing
    key = F.split(F.regexp_extract(F.col("_metadata.file_path"), rf"([0-9]+(?:[{sep}][0-9]+){{{len(shape) - 1}}})$", 1), rf"[{sep}]")
    files = files.where(F.size(key) == len(shape))
    reach = [(0, -(-s // c)) for s, c in zip(shape, chunk)]
    if box is not None:
        for i, (b, e) in enumerate(zip(box.begin, box.end)):
            axis = i + len(shape) - 3
            low, high = max(0, b // chunk[axis]), min(reach[axis][1], -(-e // chunk[axis]))
            reach[axis] = (low, max(low, high))
            at = key[axis].cast("bigint")
            files = files.where((at >= low) & (at < high))
    files = files.withColumn("key", F.transform(key, lambda k: k.cast("bigint")))
    fill = meta.get("fill_value") or 0
    counts = [high - low for low, high in reach]
    if (keep_zero or fill != 0) and all(counts):
        number, keys = F.col("id"), []
        for (low, _), n in zip(reversed(reach), reversed(counts)):
            keys.append(number % n + low)
            number = F.floor(number / n)
        grid = spark.range(int(np.prod(counts))).select(F.array(*reversed(keys)).alias("key"))
        absent = grid.join(files.select("key"), "key", "left_anti").select("key", F.lit(None).cast("binary").alias("content"))
        files = files.select("key", "content").unionByName(absent)

    def run(batches):
        for pdf in batches:
            for key_, content in zip(pdf["key"], pdf["content"]):
                if content is None:
                    cells = np.full(chunk, fill, dtype=dtype)
                else:
                    cells = np.frombuffer(_decode(bytes(content), compressor), dtype=dtype).reshape(chunk, order=order)
                origin = [int(k) * c for k, c in zip(key_, chunk)]
                cells = cells[tuple(slice(0, s - o) for s, o in zip(shape, origin))]
                picked = np.nonzero(cells) if not keep_zero else tuple(np.indices(cells.shape).reshape(cells.ndim, -1))
                frame = {n: a + o for n, a, o in zip(names, picked, origin)}
                frame["v"] = cells[picked].astype("float64" if cells.dtype.kind == "f" else "int64")
                yield pd.DataFrame(frame)

    kind = "double" if np.dtype(dtype).kind == "f" else "bigint"
    out = files.select("key", "content").mapInPandas(run, ", ".join(f"{n} bigint" for n in names) + f", v {kind}")
    return out.where(box.contains()) if box is not None else out
