"""Neighbour access on a sparse voxel table.

A voxel and its lower neighbour may live in different blocks, so the last plane of each block
is copied to the next one. After that single shuffle every axis is a ``lag`` inside the block:
the three windows reuse the block partitioning and only sort. A self join per axis would
shuffle both sides three times. Partitions are as many as the rows need, so a task's sorts hold a bounded
number of rows in a volume of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES, BLOCK, with_halo
from voxelith.session import cut_lineage, parts

DEFAULT_BLOCK = (32, 32, 32)


def with_neighbours(
    voxels: DataFrame,
    carry: list[str],
    axes: tuple[str, ...] = AXES,
    sides: tuple[str, ...] = ("lower",),
    size: tuple[int, int, int] = DEFAULT_BLOCK,
    rows: int | None = None,
) -> DataFrame:
    """Add ``<side>_<axis>_<column>``: the value one step down/up each axis, null if absent.

    ``rows`` is the number of voxels where the caller knows it, as that of a stored table; else they are
    stored here to be counted.
    """
    if rows is None:
        voxels = cut_lineage(voxels)
        rows = voxels.count()
    on = [int(a in axes) for a in AXES]
    before = tuple(o if "lower" in sides else 0 for o in on)
    after = tuple(o if "upper" in sides else 0 for o in on)
    blocks = with_halo(voxels, size, before, after)
    # Diagonal copies are never a face neighbour; home copies and one-axis copies remain.
    away = F.lit(0)
    for axis, name, s in zip(AXES, BLOCK, size):
        away = away + F.when(F.floor(F.col(axis) / F.lit(s)) != F.col(name), 1).otherwise(0)
    blocks = blocks.where(away <= 1).repartition(parts(rows), *BLOCK)
    added = []
    for axis in axes:
        line = [*BLOCK, *[a for a in AXES if a != axis]]
        window = Window.partitionBy(*line).orderBy(axis)
        for side in sides:
            shift, step = (F.lag, -1) if side == "lower" else (F.lead, 1)
            # one struct per side so each window is evaluated once
            blocks = blocks.withColumn(
                f"__{side}_{axis}",
                shift(F.struct(F.col(axis).alias("at"), *[F.col(c) for c in carry])).over(window),
            )
            added.append((side, axis, step))
    out = [F.col(c) for c in voxels.columns]
    for side, axis, step in added:
        cell = F.col(f"__{side}_{axis}")
        for c in carry:
            out.append(
                F.when(cell["at"] == F.col(axis) + F.lit(step), cell[c]).alias(f"{side}_{axis}_{c}")
            )
    return blocks.where("own").select(*out)


def label_affinities(voxels: DataFrame, label: str = "gt", rows: int | None = None) -> DataFrame:
    """Ground-truth affinities along -1 offsets: same non-zero label, 0 where no neighbour."""
    near = with_neighbours(voxels.select(*AXES, label), [label], rows=rows)
    return near.select(
        *AXES,
        *[
            F.when((F.col(f"lower_{a}_{label}") == F.col(label)) & (F.col(label) != 0), 1)
            .otherwise(0)
            .cast("bigint")
            .alias(f"gt_a{a}")
            for a in AXES
        ],
    )


def grow_boundary_xy(voxels: DataFrame, label: str = "gt", rows: int | None = None) -> DataFrame:
    """Erode labels by one voxel in the section plane: a differing neighbour turns a voxel to 0."""
    near = with_neighbours(voxels.select(*AXES, label), [label], ("y", "x"), ("lower", "upper"), rows=rows)
    differs = F.lit(False)
    for axis in ("y", "x"):
        for side in ("lower", "upper"):
            other = F.col(f"{side}_{axis}_{label}")
            differs = differs | F.coalesce(other != F.col(label), F.lit(False))
    return near.select(*AXES, F.when(differs, 0).otherwise(F.col(label)).cast("bigint").alias("eroded"))
