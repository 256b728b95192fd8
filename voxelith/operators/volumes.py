"""Whole-volume operators that stay in DataFrame form: crop, pad, stitch, masks, filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES, BLOCK, Box, with_halo
from voxelith.operators.relabel import on_label
from voxelith.operators.sampling import unit_hash
from voxelith.session import ship_package


def center_box(shape: tuple[int, ...], small: tuple[int, ...]) -> Box:
    """Box of the centred crop: ``lo = floor((A - B) / 2)``, ``hi = lo + B``."""
    if any(b > a for a, b in zip(shape, small)):
        raise ValueError(f"cannot crop {shape} to larger {small}")
    return Box(tuple((a - b) // 2 for a, b in zip(shape, small)), tuple(small))


def even_center_box(shape: tuple[int, ...], size: tuple[int, ...]) -> Box:
    """Import-time crop around the centre voxel: ``c // 2 - s // 2`` to ``c // 2 + s // 2``."""
    begin = tuple(c // 2 - s // 2 for c, s in zip(shape, size))
    return Box(begin, tuple(2 * (s // 2) for s in size))


def crop(voxels: DataFrame, box: Box, rebase: bool = True) -> DataFrame:
    """Voxels in a box, optionally with coordinates relative to it."""
    inside = voxels.where(box.contains())
    if not rebase:
        return inside
    rest = [c for c in voxels.columns if c not in AXES]
    return inside.select(
        *[(F.col(a) - F.lit(b)).cast("bigint").alias(a) for a, b in zip(AXES, box.begin)], *rest
    )


def dense_grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """Every coordinate of a box, generated in parallel."""
    nz, ny, nx = shape
    return spark.range(nz * ny * nx).selectExpr(
        f"id div {ny * nx} AS z", f"(id div {nx}) % {ny} AS y", f"id % {nx} AS x"
    )


def pad(voxels: DataFrame, value: str, shape: tuple[int, ...], target: tuple[int, ...]) -> DataFrame:
    """Centre a volume in a larger dense box filled with zeros.

    Existing rows are shifted and only the cells that are missing are filled, by union with a
    zero grid and one aggregate: cheaper than a left join of the dense grid.
    """
    if any(a > t for a, t in zip(shape, target)):
        raise ValueError(f"cannot pad {shape} to smaller {target}")
    lo = [(t - a) // 2 for a, t in zip(shape, target)]
    moved = voxels.select(*[(F.col(a) + F.lit(o)).alias(a) for a, o in zip(AXES, lo)], F.col(value))
    zeros = dense_grid(voxels.sparkSession, target).select(*AXES, F.lit(0).cast("bigint").alias(value))
    return moved.unionByName(zeros).groupBy(*AXES).agg(F.sum(value).alias(value))


def label_offset(raw_shape: list[Column], label_shape: list[Column], resolution: tuple[int, ...]) -> list[Column]:
    """World offset that centres a label volume in its raw volume."""
    half = lambda c: F.floor(c / F.lit(2)).cast("bigint")
    return [
        ((half(r) - half(s)) * F.lit(v)).alias(f"offset_{a}")
        for r, s, v, a in zip(raw_shape, label_shape, resolution, AXES)
    ]


def boundary(label: str = "gt") -> Column:
    return (F.col(label) == 0).cast("bigint")


def affinity_mask(threshold: float = 0.5, top: int = 255) -> Column:
    """Mean of the three affinities strictly above a share of the maximum."""
    return (F.col("az") + F.col("ay") + F.col("ax")) / F.lit(3.0) > F.lit(threshold * top)


def low_affinity_fragments(voxels: DataFrame, minimum: float, top: int = 255) -> DataFrame:
    """Zero out fragments whose mean affinity is below ``minimum`` of the maximum."""
    total = F.col("az") + F.col("ay") + F.col("ax")
    keep = (
        voxels.where("frag <> 0").groupBy("frag").agg((F.sum(total) / (3.0 * F.count("*"))).alias("m"))
        .where(F.col("m") >= F.lit(minimum * top)).select(F.col("frag").alias("kept"))
    )
    return (
        voxels.alias("v").join(keep, on_label(voxels, "frag", "kept"), "left")
        .withColumn("frag", F.coalesce("kept", F.lit(0).cast("bigint")))
        .drop("kept")
    )


def replace_sections(voxels: DataFrame, sections: list[int], columns: list[str]) -> DataFrame:
    """Set the listed sections to zero."""
    return voxels.withColumns(
        {c: F.when(F.col("z").isin(sections), 0).otherwise(F.col(c)).cast("bigint") for c in columns}
    )


def apply_mask(voxels: DataFrame, mask: DataFrame, columns: list[str]) -> DataFrame:
    """Multiply columns with a 0/1 mask volume; voxels without a mask value are masked out."""
    joined = voxels.join(mask.select(*AXES, "mask"), list(AXES), "left")
    return joined.withColumns(
        {c: F.when(F.col("mask") > 0, F.col(c)).otherwise(0).cast("bigint") for c in columns}
    ).drop("mask")


def max_filter(
    voxels: DataFrame,
    value: str,
    width: int,
    size: tuple[int, int, int] = (32, 32, 32),
    out: str = "peak",
    extent: Box | None = None,
) -> DataFrame:
    """Cubic maximum filter; an even width reaches one voxel further down than up.

    Three one-dimensional windows inside a block that already holds its halo: one shuffle for
    the whole filter.
    """
    before, after = width // 2, (width - 1) // 2
    blocks = with_halo(voxels.select(*AXES, value), size, (before,) * 3, (after,) * 3, extent).repartition(*BLOCK)
    blocks = blocks.withColumn(out, F.col(value))
    for axis in AXES:
        line = Window.partitionBy(*BLOCK, *[a for a in AXES if a != axis]).orderBy(axis)
        blocks = blocks.withColumn(out, F.max(out).over(line.rangeBetween(-before, after)))
    return blocks.where("own").select(*AXES, value, out)


def stitch(chunks: DataFrame, value: str, order: str) -> DataFrame:
    """Overlapping chunk outputs to one volume; where chunks overlap the later one wins."""
    return chunks.groupBy(*AXES).agg(F.max_by(value, order).alias(value))


def scan_chunks(voxels: DataFrame, total: Box, reference: tuple[int, ...], stride: tuple[int, ...]) -> DataFrame:
    """Each voxel with the number of every scan chunk that covers it.

    Chunk numbers count the first axis fastest, in scan order; the last chunk of an axis snaps
    to the edge. Candidates come from arithmetic, so there is no join with the chunk list.
    """
    out, number, factor = voxels, F.lit(0).cast("bigint"), 1
    for i, axis in enumerate(AXES):
        span = total.shape[i] - reference[i]
        last = -(-span // stride[i])
        rel = F.col(axis) - F.lit(total.begin[i])
        low = F.greatest(F.floor((rel - F.lit(reference[i])) / F.lit(stride[i])), F.lit(0)).cast("bigint")
        high = F.least(F.floor(rel / F.lit(stride[i])), F.lit(last)).cast("bigint")
        candidates = F.array_distinct(F.concat(F.sequence(F.least(low, high), high), F.array(F.lit(last).cast("bigint"))))
        shift = lambda c, s=stride[i], m=span: F.least(c * F.lit(s), F.lit(m))
        out = out.withColumn(f"c{axis}", F.explode(candidates)).where(
            (shift(F.col(f"c{axis}")) <= F.col(axis) - F.lit(total.begin[i]))
            & (F.col(axis) - F.lit(total.begin[i]) < shift(F.col(f"c{axis}")) + F.lit(reference[i]))
        )
        number = number + F.col(f"c{axis}") * F.lit(factor)
        factor *= last + 1
    return out.withColumn("chunk", number).drop("cz", "cy", "cx")


def line_samples(lines: DataFrame) -> DataFrame:
    """Voxels along straight lines ``id, z0..x0, z1..x1`` (voxel units), one step per unit length."""
    square = lambda a: (F.col(f"{a}1") - F.col(f"{a}0")) * (F.col(f"{a}1") - F.col(f"{a}0"))
    steps = F.greatest(F.ceil(F.sqrt((square("z") + square("y") + square("x")).cast("double"))), F.lit(1)).cast("bigint")
    at = lambda a: F.floor(
        F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("step") / F.col("steps")
    ).cast("bigint").alias(a)
    return (
        lines.withColumn("steps", steps)
        .withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("steps"))))
        .select("id", "step", at("z"), at("y"), at("x"))
    )


def neighbourhood(sites: DataFrame, reach: int = 1) -> DataFrame:
    """Every voxel coordinate in the cube around each site (``id, z, y, x`` in voxel units)."""
    steps = F.array(*[F.lit(d).cast("bigint") for d in range(-reach, reach + 1)])
    out = sites
    for a in AXES:
        out = out.withColumn(f"d{a}", F.explode(steps))
    return out.select("id", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES])


def points_from_arrays(df: DataFrame, ids: str, locations: str) -> DataFrame:
    """``-ids`` / ``-locations`` array pairs to ``id, z, y, x``; three coordinates per id."""
    at = lambda k: F.element_at(locations, F.col("pos") * 3 + k)
    return df.select("*", F.posexplode(ids).alias("pos", "id")).select(
        "id", *[at(i + 1).alias(a) for i, a in enumerate(AXES)]
    )


def apply_function(df: DataFrame, column: str, function, out: str, kind: str = "double", **arguments) -> DataFrame:
    """Apply an arbitrary vectorised function of one column; Arrow batches, never row by row."""

    ship_package(df.sparkSession)

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(function(values, **arguments))

    return df.withColumn(out, run(column))


def flip(voxels: DataFrame, box: Box, axes: tuple[str, ...]) -> DataFrame:
    """Mirror coordinates inside a box."""
    return voxels.withColumns(
        {a: F.lit(2 * b + s - 1) - F.col(a) for a, b, s in zip(AXES, box.begin, box.shape) if a in axes}
    )


def transpose_xy(voxels: DataFrame) -> DataFrame:
    return voxels.withColumns({"y": F.col("x"), "x": F.col("y")})


def intensity_augment(
    voxels: DataFrame, value: str, seed: int, scale: tuple[float, float] = (0.9, 1.1), shift: tuple[float, float] = (-0.1, 0.1)
) -> DataFrame:
    """Random scale about the section mean and shift, drawn per z section from a seeded hash."""
    unit = lambda salt: unit_hash(F.col("z"), seed * 2 + salt)
    means = voxels.groupBy("z").agg(F.avg(value).alias("__mean"))
    factor = F.lit(scale[0]) + unit(0) * F.lit(scale[1] - scale[0])
    offset = F.lit(shift[0]) + unit(1) * F.lit(shift[1] - shift[0])
    return voxels.join(means, "z").withColumn(
        "augmented", F.col("__mean") + (F.col(value) - F.col("__mean")) * factor + offset
    ).drop("__mean")
