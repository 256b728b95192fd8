"""World-unit boxes, block grids, halos, and the done-block anti join.

Coordinates are ordered (z, y, x); boxes are half open. Grids are generated inside Spark with
``range`` so a grid of any size stays a distributed relation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
BLOCK = ("bz", "by", "bx")


@dataclass(frozen=True)
class Box:
    """Half-open box: ``begin <= c < begin + shape`` on every axis."""

    begin: tuple[int, ...]
    shape: tuple[int, ...]

    @property
    def end(self) -> tuple[int, ...]:
        return tuple(b + s for b, s in zip(self.begin, self.shape))

    @property
    def empty(self) -> bool:
        return any(s <= 0 for s in self.shape)

    def grow(self, low: tuple[int, ...], high: tuple[int, ...]) -> Box:
        return Box(
            tuple(b - a for b, a in zip(self.begin, low)),
            tuple(s + a + c for s, a, c in zip(self.shape, low, high)),
        )

    def shift(self, by: tuple[int, ...]) -> Box:
        return Box(tuple(b + d for b, d in zip(self.begin, by)), self.shape)

    def intersect(self, other: Box) -> Box:
        begin = tuple(max(a, b) for a, b in zip(self.begin, other.begin))
        end = tuple(min(a, b) for a, b in zip(self.end, other.end))
        return Box(begin, tuple(max(0, e - b) for b, e in zip(begin, end)))

    def to_voxels(self, voxel_size: tuple[int, ...], offset: tuple[int, ...] | None = None) -> Box:
        """World box to array indices of a dataset that starts at ``offset``.

        Every voxel that the box touches belongs to it, whether or not the box is aligned.
        """
        offset = offset or (0,) * len(self.begin)
        begin = tuple((b - o) // v for b, o, v in zip(self.begin, offset, voxel_size))
        end = tuple(-((o - e) // v) for e, o, v in zip(self.end, offset, voxel_size))
        return Box(begin, tuple(max(0, e - b) if s > 0 else 0 for b, e, s in zip(begin, end, self.shape)))

    def contains(self, columns: tuple[str, ...] = AXES) -> Column:
        """Predicate that reaches the Parquet scan: plain comparisons on plain columns."""
        tests = [
            (F.col(c) >= F.lit(b)) & (F.col(c) < F.lit(e))
            for c, b, e in zip(columns, self.begin, self.end)
        ]
        predicate = tests[0]
        for test in tests[1:]:
            predicate = predicate & test
        return predicate


def context_of(input_shape: tuple[int, ...], output_shape: tuple[int, ...]) -> tuple[int, ...]:
    """Voxels a valid model needs around its output on each side."""
    return tuple((i - o) // 2 for i, o in zip(input_shape, output_shape))


def block_of(size: tuple[int, int, int], columns: tuple[str, ...] = AXES) -> list[Column]:
    """Block coordinates of a voxel; floor division so negative coordinates work too."""
    return [
        F.floor(F.col(c) / F.lit(s)).cast("bigint").alias(b)
        for c, s, b in zip(columns, size, BLOCK)
    ]


def block_grid(
    spark: SparkSession,
    total: Box,
    write_shape: tuple[int, int, int],
    context: tuple[int, int, int] = (0, 0, 0),
    fit: str = "shrink",
) -> DataFrame:
    """One row per block: id, grid position, write box and read box (write grown by context).

    ``shrink`` clips the last blocks to the total box, ``overhang`` keeps them whole.
    """
    if fit not in ("shrink", "overhang"):
        raise ValueError(f"unknown fit {fit!r}")
    counts = [math.ceil(s / w) for s, w in zip(total.shape, write_shape)]
    nz, ny, nx = counts
    df = spark.range(nz * ny * nx).select(
        F.col("id").alias("block_id"),
        F.expr(f"id div {ny * nx}").alias("bz"),
        F.expr(f"(id div {nx}) % {ny}").alias("by"),
        F.expr(f"id % {nx}").alias("bx"),
    )
    out = [F.col("block_id"), *[F.col(b) for b in BLOCK]]
    for i, axis in enumerate(AXES):
        begin = F.lit(total.begin[i]) + F.col(BLOCK[i]) * F.lit(write_shape[i])
        end = begin + F.lit(write_shape[i])
        if fit == "shrink":
            end = F.least(end, F.lit(total.end[i]))
        out += [
            begin.cast("bigint").alias(f"write_{axis}0"),
            end.cast("bigint").alias(f"write_{axis}1"),
            (begin - F.lit(context[i])).cast("bigint").alias(f"read_{axis}0"),
            (end + F.lit(context[i])).cast("bigint").alias(f"read_{axis}1"),
        ]
    return df.select(*out)


def voxels_per_block(write_shape: tuple[int, ...], voxel_size: tuple[int, ...]) -> int:
    return math.prod(w // v for w, v in zip(write_shape, voxel_size))


def pending_blocks(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks not yet in the done log; presence of an id in the log means finished."""
    return blocks.join(done.select("block_id"), "block_id", "left_anti")


Layers = tuple[int, int]  # first layer of blocks along z, and the one behind the last


def near_layers(size: int, context: int, layers: Layers | None) -> Column:
    """Voxels that the blocks of some layers read; bounds on z, so they reach the scan."""
    if layers is None:
        return F.lit(True)
    return (F.col("z") >= layers[0] * size - context) & (F.col("z") < layers[1] * size + context)


def in_layers(layers: Layers | None) -> Column:
    return F.lit(True) if layers is None else (F.col("bz") >= layers[0]) & (F.col("bz") < layers[1])


def with_halo(
    voxels: DataFrame,
    size: tuple[int, int, int],
    before: tuple[int, int, int],
    after: tuple[int, int, int],
    extent: Box | None = None,
) -> DataFrame:
    """Copy every voxel to each block whose read box holds it, flagged ``own`` at home.

    With ``extent`` (the volume's box) no copies are made for blocks outside the volume.

    ``before``/``after`` are the context a block needs on its low/high side, at most one block
    wide, so a voxel has at most 27 and usually one copy. Emits ``bz, by, bx, own`` columns.
    """
    if any(b > s or a > s for b, a, s in zip(before, after, size)):
        raise ValueError("context may not exceed the block size")
    lists = []
    for i, (axis, s, lo, hi) in enumerate(zip(AXES, size, before, after)):
        home = F.floor(F.col(axis) / F.lit(s)).cast("bigint")
        rest = F.col(axis) - home * F.lit(s)
        options = [home]
        if hi:  # low planes are the high context of the previous block
            test = rest < F.lit(hi)
            if extent is not None:
                test = test & (home > F.lit(extent.begin[i] // s))
            options.append(F.when(test, home - 1))
        if lo:  # high planes are the low context of the next block
            test = rest >= F.lit(s - lo)
            if extent is not None:
                test = test & (home < F.lit((extent.end[i] - 1) // s))
            options.append(F.when(test, home + 1))
        lists.append(F.array_compact(F.array(*options)))
    out = voxels
    for name, options in zip(BLOCK, lists):
        out = out.select("*", F.explode(options).alias(name))
    own = F.lit(True)
    for axis, name, s in zip(AXES, BLOCK, size):
        own = own & (F.floor(F.col(axis) / F.lit(s)).cast("bigint") == F.col(name))
    return out.withColumn("own", own)


def scan_shifts(
    spark: SparkSession,
    total: Box,
    reference: Box,
    stride: tuple[int, ...] | None = None,
) -> DataFrame:
    """Shifts that tile ``total`` with ``reference``; the last one per axis snaps to the edge."""
    stride = stride or reference.shape
    if any(r > t for r, t in zip(reference.shape, total.shape)):
        raise ValueError("reference does not fit into the total box")
    low = [t - r for t, r in zip(total.begin, reference.begin)]
    span = [t - r for t, r in zip(total.shape, reference.shape)]
    counts = [math.ceil(s / st) + 1 for s, st in zip(span, stride)]
    divisors = [math.prod(counts[i + 1:]) for i in range(len(counts))]
    names = [f"shift_{a}" for a in AXES[-len(counts):]]
    return spark.range(math.prod(counts)).select(
        *[
            F.expr(f"{low[i]} + least((id div {divisors[i]}) % {counts[i]} * {stride[i]}, {span[i]})")
            .cast("bigint")
            .alias(names[i])
            for i in range(len(counts))
        ]
    )


def box_overlaps(
    left: DataFrame, right: DataFrame, cell: tuple[int, int, int]
) -> DataFrame:
    """3-D box intersection join through a cell grid, so it is an equi join and not a theta join.

    Both sides carry ``id, z0, z1, y0, y1, x0, x1``. Every box is listed in the cells it
    touches, at the level (cells doubled so many times) where it touches few; boxes of different
    levels meet at the coarser one. A pair is reported only in the cell that holds the low corner of
    the overlap, which makes the result unique without a distinct.
    """
    names = ("id", "z0", "z1", "y0", "y1", "x0", "x1")

    def levelled(df: DataFrame, tag: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{tag}_{c}") for c in names])
        extent = {a: F.col(f"{tag}_{a}1") - F.col(f"{tag}_{a}0") for a in AXES}
        for axis in AXES:
            out = out.where(extent[axis] > 0)
        fit = F.greatest(F.lit(1.0), *[extent[a] / F.lit(float(size)) for a, size in zip(AXES, cell)])
        return out.withColumn(f"{tag}_level", F.ceil(F.log2(fit)).cast("int"))

    def listed(df: DataFrame, tag: str, levels: Column) -> DataFrame:
        out = df.withColumn("level", F.explode(levels))
        for axis, size in zip(AXES, cell):
            width = F.call_function("shiftleft", F.lit(size).cast("bigint"), F.col("level"))
            low = F.floor(F.col(f"{tag}_{axis}0") / width).cast("bigint")
            high = F.floor((F.col(f"{tag}_{axis}1") - 1) / width).cast("bigint")
            out = out.select("*", F.explode(F.sequence(low, high)).alias(f"c{axis}"))
        return out

    sides = {"l": levelled(left, "l"), "r": levelled(right, "r")}
    # at most as many levels as a coordinate has bits
    present = {tag: F.array(*[F.lit(r[0]) for r in side.select(f"{tag}_level").distinct().collect()]).cast("array<int>") for tag, side in sides.items()}
    own = {tag: F.array(f"{tag}_level") for tag in sides}
    # a pair meets at the coarser of its two levels: once with the right box there, once the left
    pairs = (
        (F.filter(present["r"], lambda k: k >= F.col("l_level")), own["r"]),
        (own["l"], F.filter(present["l"], lambda k: k > F.col("r_level"))),
    )
    cols = [F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")]
    keep = F.lit(True)
    for axis, size in zip(AXES, cell):
        lo = F.greatest(f"l_{axis}0", f"r_{axis}0")
        hi = F.least(f"l_{axis}1", f"r_{axis}1")
        width = F.call_function("shiftleft", F.lit(size).cast("bigint"), F.col("level"))
        keep = keep & (hi > lo) & (F.floor(lo / width).cast("bigint") == F.col(f"c{axis}"))
        cols += [lo.alias(f"{axis}0"), hi.alias(f"{axis}1")]
    out = None
    for of_left, of_right in pairs:
        met = listed(sides["l"], "l", of_left).join(listed(sides["r"], "r", of_right), ["level", "cz", "cy", "cx"]).where(keep).select(*cols)
        out = met if out is None else out.unionByName(met)
    return out
