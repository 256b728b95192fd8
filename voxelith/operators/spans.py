"""Sweeps by spans: a row holds from the sweep point ``first`` to ``last``, instead of one row a point.

Raising the threshold only merges segments, and a segment is named after its smallest fragment, so a
fragment has the same segment over a run of points and never gets it back. Rows are joined and summed by these
few runs; points are listed inside a task, after the last shuffle of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.operators.relabel import on_label

KEY = "threshold_pct"


def spans(lut: DataFrame) -> DataFrame:
    """``fragment, segment, first, last`` of a sweep's ``threshold_pct, fragment, segment``."""
    return lut.groupBy("fragment", "segment").agg(F.min(KEY).alias("first"), F.max(KEY).alias("last"))


def at_spans(rows: DataFrame, table: DataFrame, points: list[int], columns: list[str]) -> DataFrame:
    """Rows with the fragments in ``columns`` replaced by segments, one row for each span of all of them.

    A fragment without an entry keeps its own id, as does background, which is never looked up.
    """
    out = rows.withColumns({"first": F.lit(min(points)), "last": F.lit(max(points))})
    for c in columns:
        own = table.select(
            F.col("fragment").alias("__fragment"), F.col("segment").alias("__segment"),
            F.col("first").alias("__first"), F.col("last").alias("__last"),
        )
        out = (
            out.alias("v").join(own, on_label(out, c, "__fragment"), "left")
            .withColumns({
                c: F.coalesce("__segment", c),
                "first": F.greatest("first", "__first"),  # a missing bound is passed over
                "last": F.least("last", "__last"),
            })
            .drop("__fragment", "__segment", "__first", "__last")
            .where("first <= last")
        )
    return out


def holds(point: int) -> Column:
    return (F.col("first") <= F.lit(point)) & (F.col("last") >= F.lit(point))


def each_point(points: list[int], **columns: list[Column]) -> Column:
    """Generator of ``threshold_pct`` and one entry of each list a point."""
    return F.inline(F.array(*[
        F.struct(F.lit(p).alias(KEY), *[values[i].alias(name) for name, values in columns.items()])
        for i, p in enumerate(points)
    ]))


def sums_at(rows: DataFrame, by: list[str], points: list[int], value: str) -> DataFrame:
    """``by, threshold_pct, m``: the sum of a column over the rows that hold at a point, if any."""
    wide = rows.groupBy(*by).agg(*[F.sum(F.when(holds(p), F.col(value))).alias(f"__{i}") for i, p in enumerate(points)])
    return wide.select(*by, each_point(points, m=[F.col(f"__{i}") for i in range(len(points))])).where("m IS NOT NULL")
