"""Lookup-table operators: relabelling, site lookups, and segment membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES
from voxelith.operators.ordering import dense_ids


def on_label(voxels: DataFrame, label: str, key: str) -> Column:
    """Join condition of labels with a table that has no entry for background.

    Background, often a third of a volume, would meet in one task as a single key. Its second join
    key is a hash of the row, so it is dealt evenly and matches nothing. ``voxels`` is joined under
    the alias ``v``.
    """
    own = F.col(f"v.{label}")
    dealt = F.when(own == 0, F.xxhash64(*[F.col(f"v.{c}") for c in voxels.columns])).otherwise(own)
    return (own == F.col(key)) & (dealt == F.col(key))


def relabel(
    voxels: DataFrame, lut: DataFrame, label: str, out: str = "segment", missing: str = "keep"
) -> DataFrame:
    """Replace labels through ``lut(fragment, segment)``; unmatched keep their label or become 0.

    The lookup side has one row per fragment, so Spark may broadcast it when measured small and
    otherwise split a hot fragment's partition. Background is never looked up (see
    :func:`on_label`).
    """
    default = F.col(f"v.{label}") if missing == "keep" else F.lit(0).cast("bigint")
    return (
        voxels.alias("v")
        .join(lut.where("fragment <> 0").select("fragment", "segment").alias("l"), on_label(voxels, label, "l.fragment"), "left")
        .select("v.*", F.coalesce("l.segment", default).alias(out))
    )


def densify(voxels: DataFrame, label: str, out: str = "dense") -> DataFrame:
    """Relabel to consecutive ids in ascending order; a null label stays null.

    The rank is computed on distinct ids. Background, a third of a volume as a rule, is looked up
    beside the join: its rank is the number of negative labels.
    """
    ids = dense_ids(voxels, label)
    zero = ids.agg(F.count_if(F.col(label) < 0)).scalar()
    return (
        voxels.alias("v").join(ids.where(F.col(label) != 0).alias("i"), on_label(voxels, label, f"i.{label}"), "left")
        .select("v.*", F.when(F.col(f"v.{label}") == 0, zero).otherwise(F.col("i.dense")).alias(out))
    )


def site_fragments(
    sites: DataFrame,
    voxels: DataFrame,
    voxel_size: tuple[int, int, int] = (1, 1, 1),
    label: str = "frag",
) -> DataFrame:
    """Fragment under each site in world units (0 outside the volume).

    The voxel index is the floor of world by voxel size, so the lookup is a plain equi join.
    """
    at = [F.floor(F.col(f"s.{a}") / F.lit(v)).cast("bigint") == F.col(f"v.{a}") for a, v in zip(AXES, voxel_size)]
    return (
        sites.alias("s")
        .join(voxels.select(*AXES, label).alias("v"), at, "left")
        .select("s.*", F.coalesce(f"v.{label}", F.lit(0).cast("bigint")).alias("fragment"))
    )


def foreground_lut(located: DataFrame) -> DataFrame:
    return located.where("fragment <> 0").select(F.col("id").alias("site"), "fragment")


def background_sites(located: DataFrame) -> DataFrame:
    return located.agg(F.count_if(F.col("fragment") == 0).alias("num_bg_sites"))


def endpoints(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct ids on either end of an edge list, from a single scan."""
    return edges.select(F.explode(F.array(source, target)).alias("id")).distinct()
