"""Random boxes with a least share of masked-in cells, by a summed-volume table.

The table holds for every cell the number of set cells up to it on all axes, so the count of any box,
of any size and anywhere, is eight lookups.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES, Box
from voxelith.session import cut_lineage


def every_cell(spark: SparkSession, extent: Box) -> DataFrame:
    """``z, y, x`` of all cells of a box."""
    (z, y, x), (_, height, width) = extent.begin, extent.shape
    return spark.range(0 if extent.empty else math.prod(extent.shape)).select(
        (F.expr(f"id div {max(1, height * width)}L") + z).alias("z"),
        (F.expr(f"(id div {max(1, width)}L) % {max(1, height)}L") + y).alias("y"),
        (F.expr(f"id % {max(1, width)}L") + x).alias("x"),
    )


def summed_volume(mask: DataFrame, extent: Box, piece: int = 256) -> DataFrame:
    """``z, y, x, n`` for every cell of ``extent``: set cells of ``mask`` at or before it on all axes.

    Axis by axis, each line in pieces: sums run inside a piece, then what the pieces before it hold is
    added, from a table of one row a piece. Cells outside the extent, nulls and repeats don't count.

    These tables grow with the volume but compress to a few bytes a row, so their stored size says little
    of what a broadcast of them would take: they are merged.
    """
    if piece < 1:
        raise ValueError("a piece holds at least one cell")
    marked = mask.where(extent.contains()).select(*[F.col(a).cast("bigint").alias(a) for a in AXES]).distinct().withColumn("n", F.lit(1).cast("bigint"))
    out = every_cell(mask.sparkSession, extent).join(marked.hint("merge"), list(AXES), "left").select(*AXES, F.coalesce("n", F.lit(0)).alias("n"))
    for axis in reversed(AXES):
        line = [a for a in AXES if a != axis]
        inside = Window.partitionBy(*line, "piece").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        out = cut_lineage(out.withColumn("piece", F.floor(F.col(axis) / piece)).withColumn("n", F.sum("n").over(inside)))
        earlier = Window.partitionBy(*line).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = out.groupBy(*line, "piece").agg(F.max("n").alias("whole")).select(*line, "piece", F.sum("whole").over(earlier).alias("before"))
        out = out.join(pieces.hint("merge"), [*line, "piece"]).select(*AXES, (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"))
    return out


def box_counts(boxes: DataFrame, summed: DataFrame, shape: tuple[int, int, int], extent: Box) -> DataFrame:
    """``boxes`` (first cells in ``z, y, x``, unique rows) with ``inside``, the set cells of each.

    A box may reach beyond the extent; only its part inside counts.
    """
    corners = []
    for far in itertools.product((True, False), repeat=3):
        at = []
        for axis, size, low, high, is_far in zip(AXES, shape, extent.begin, extent.end, far):
            last = F.col(axis) + (size if is_far else 0) - 1
            at.append(F.when(last >= low, F.least(last, F.lit(high - 1))).cast("bigint").alias(f"c{axis}"))
        corners.append(F.struct(*at, F.lit(1 if far.count(False) % 2 == 0 else -1).alias("sign")))
    table = summed.select(*[F.col(a).alias(f"c{a}") for a in AXES], "n")
    looked_up = boxes.select(*boxes.columns, F.inline(F.array(*corners))).join(table.hint("merge"), [f"c{a}" for a in AXES], "left")
    return looked_up.groupBy(*boxes.columns).agg(F.coalesce(F.sum(F.col("n") * F.col("sign")), F.lit(0)).alias("inside"))


def random_locations(
    draws: DataFrame, summed: DataFrame, extent: Box, shape: tuple[int, int, int], least: float, attempts: int = 16, seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """``id, attempt, z, y, x, inside`` for each distinct id: the first of its places that holds enough.

    Places are even over all boxes that lie in the extent, and depend on seed, id and attempt only. A
    place is taken if at least the share ``least`` of its cells is set; an id none of whose places is
    taken has nulls. A null id is left out.
    """
    spans = [whole - size + 1 for whole, size in zip(extent.shape, shape)]
    if min(spans) < 1 or min(shape) < 1 or attempts < 1:
        raise ValueError(f"no box of {shape} in {extent.shape}, or no attempt")
    ids = draws.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("attempt").cast("string")))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("digest", digest)
        for number, (axis, low, span) in enumerate(zip(AXES, extent.begin, spans)):
            part = F.conv(F.substring("digest", 8 * number + 1, 8), 16, 10).cast("bigint")
            rows = rows.withColumn(axis, F.shiftright(part * F.lit(span).cast("bigint"), 32) + low)
        return rows.drop("digest")

    tried = placed(ids.select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(attempts - 1).cast("bigint"))).alias("attempt")))
    # draws share places, so every place is counted once, however many draws there are
    counted = box_counts(every_cell(draws.sparkSession, Box(extent.begin, tuple(spans))), summed, shape, extent)
    # the first attempt with its count, as one number; it says where the place is
    whole = math.prod(shape) + 1
    enough = F.col("inside") >= math.ceil(least * math.prod(shape))
    first = (
        tried.join(counted.hint("merge"), list(AXES))
        .groupBy("id").agg(F.min(F.when(enough, F.col("attempt") * whole + F.col("inside"))).alias("first"))
        .select("id", F.expr(f"first div {whole}L").alias("attempt"), F.expr(f"first % {whole}L").alias("inside"))
    )
    found = F.col("attempt").isNotNull()
    return placed(first).select("id", "attempt", *[F.when(found, F.col(a)).alias(a) for a in AXES], "inside")
