"""Region adjacency graph: faces between fragments and named edge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES
from voxelith.operators.neighbours import DEFAULT_BLOCK, with_neighbours

# Quantiles that name the histogram merge functions.
QUANTILES = (10, 25, 50, 75, 90)


def faces(
    voxels: DataFrame,
    label: str = "frag",
    affinities: tuple[str, str, str] = ("az", "ay", "ax"),
    size: tuple[int, int, int] = DEFAULT_BLOCK,
    rows: int | None = None,
) -> DataFrame:
    """Voxel faces between two different non-zero labels: ``u < v`` and the 8-bit affinity.

    ``rows`` is the number of voxels, if known (see :func:`with_neighbours`).
    """
    near = with_neighbours(voxels.select(*AXES, label, *affinities), [label], size=size, rows=rows)
    face = [
        F.when(
            (F.col(f"lower_{a}_{label}") != 0)
            & (F.col(label) != 0)
            & (F.col(f"lower_{a}_{label}") != F.col(label)),
            F.struct(
                F.least(f"lower_{a}_{label}", label).alias("u"),
                F.greatest(f"lower_{a}_{label}", label).alias("v"),
                F.col(aff).alias("aff"),
            ),
        )
        for a, aff in zip(AXES, affinities)
    ]
    return near.select(F.explode(F.array_compact(F.array(*face))).alias("f")).select("f.u", "f.v", "f.aff")


def score(name: str, aff: str = "aff", top: int = 255) -> Column:
    """Aggregate for a merge function by name; low score means merge.

    ``mean``; ``hist_quant_Q`` (smallest of the 256 bins at which the cumulative count reaches
    Q percent); the ``_initmax`` variants start from the largest affinity; ``quantile_Q``
    interpolates between bins. Affinities are 8-bit, so a group's buffer never holds more
    than 256 distinct values and partial aggregation collapses hot edges before the shuffle.
    """
    value = F.col(aff)
    if name == "mean":
        raw = F.sum(value) / F.count(value)
    elif name.endswith("_initmax"):
        raw = F.max(value)
    elif name.startswith("hist_quant_"):
        q = int(name.rsplit("_", 1)[1])
        raw = F.expr(f"percentile_disc({q / 100}D) WITHIN GROUP (ORDER BY {aff})")
    elif name.startswith("quantile_"):
        q = int(name.rsplit("_", 1)[1])
        raw = F.percentile(value, F.lit(q / 100))
    else:
        raise ValueError(f"unknown merge function {name!r}")
    return F.lit(1.0) - raw / F.lit(float(top))


MERGE_FUNCTIONS = (
    "mean",
    *[f"hist_quant_{q}" for q in QUANTILES],
    *[f"hist_quant_{q}_initmax" for q in QUANTILES],
)


def edges(face_table: DataFrame, name: str = "mean") -> DataFrame:
    """One undirected scored edge per touching fragment pair, plus its contact size."""
    return face_table.groupBy("u", "v").agg(
        score(name).alias("merge_score"), F.count("*").alias("n_faces")
    )


def nodes(voxels: DataFrame, label: str = "frag", voxel_size: tuple[int, int, int] = (20, 9, 9)) -> DataFrame:
    """RAG nodes with the integer centre of mass in world units."""
    return (
        voxels.where(F.col(label) != 0)
        .groupBy(F.col(label).alias("id"))
        .agg(
            *[
                F.floor(F.sum(a) * F.lit(s) / F.count("*")).cast("bigint").alias(f"center_{a}")
                for a, s in zip(AXES, voxel_size)
            ],
            F.count("*").alias("n_voxels"),
        )
    )


def both_directions(edge_table: DataFrame) -> DataFrame:
    """Undirected edges listed from both ends, in one pass over the input."""
    rest = [c for c in edge_table.columns if c not in ("u", "v")]
    return edge_table.select(
        F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"),
        *rest,
    ).select("e.u", "e.v", *rest)


def segment_graph(edge_table: DataFrame, lut: DataFrame, threshold: float) -> DataFrame:
    """Edges inside each segment at a threshold: both ends map to it and the score passes.

    Edges with an end outside the lookup table dangle and drop out of the inner joins.
    """
    low = lut.select(F.col("fragment").alias("u"), F.col("segment").alias("segment"))
    high = lut.select(F.col("fragment").alias("v"), F.col("segment").alias("segment"))
    return (
        edge_table.where(F.col("merge_score") <= F.lit(threshold))
        .join(low, "u")
        .join(high, ["v", "segment"])
        .select("segment", "u", "v", "merge_score", (F.lit(1.0) - F.col("merge_score")).alias("weight"))
    )
