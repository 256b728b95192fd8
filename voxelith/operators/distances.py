"""Exact Euclidean distances over a whole volume, whatever its blocks.

Only voxels inside a mask are rows. Along a line, an inside voxel's nearest outside cell ends its
own run of inside voxels, so a run is all that a pass looks at:

* first axis: the distance to the nearer end of the run. The axis may have any length: lines are
  cut into chunks, a run that reaches a chunk's border goes on to where a row per (line, chunk)
  says the next outside cell lies;
* each further axis: the least of the values so far plus the squared offset, over the run and the
  two outside cells that end it, from the lower envelope of these parabolas. Such a line is held in
  one piece, so it is the volume's two shorter axes that should come last.

One shuffle of narrow rows an axis. Cells beyond the volume's box are neither inside nor outside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.operators.grid import AXES, Box
from voxelith.session import cut_lineage, ship_package

CHUNK = 4096
NEVER = -1  # no outside cell seen yet, in the passes' arrays


def lower_envelope(values: list[int]) -> list[int]:
    """For every place of a line the least of ``values[k] + (place - k) ** 2``; ``NEVER`` marks no value."""
    at: list[int] = []
    begins: list[float] = []
    for q, value in enumerate(values):
        if value == NEVER:
            continue
        begin = -np.inf
        while at:
            p = at[-1]
            begin = (value + q * q - values[p] - p * p) / (2 * (q - p))
            if begin > begins[-1]:
                break
            at.pop()
            begins.pop()
            begin = -np.inf
        at.append(q)
        begins.append(begin)
    if not at:
        return [NEVER] * len(values)
    out, k = [], 0
    for place in range(len(values)):
        while k + 1 < len(at) and begins[k + 1] < place:
            k += 1
        out.append(values[at[k]] + (place - at[k]) ** 2)
    return out


def along_runs(place: np.ndarray, value: np.ndarray, fresh: np.ndarray, low: int, high: int) -> np.ndarray:
    """One pass over voxels sorted by line and ``place``; ``fresh`` marks a line's first voxel."""
    starts = np.flatnonzero(fresh | np.concatenate([[True], np.diff(place) != 1]))
    out = np.empty_like(value)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
        line = [0] * int(place[a] > low) + value[a:b].tolist() + [0] * int(place[b - 1] < high - 1)
        first = int(place[a] > low)
        out[a:b] = lower_envelope(line)[first : first + b - a]
    return out


def _first_axis(inside: DataFrame, axis: str, others: list[str], low: int, high: int, chunk: int) -> DataFrame:
    """Squared distance along the first axis, null on a line without an outside cell."""
    at, home = F.col(axis), F.col("chunk")
    rows = inside.withColumn("chunk", F.floor((at - low) / chunk).cast("bigint"))
    cut = [*others, "chunk"]
    ranked = rows.withColumn("run", at - F.row_number().over(Window.partitionBy(*cut).orderBy(axis)))
    run = Window.partitionBy(*cut, "run")
    ranked = cut_lineage(ranked.withColumn("a", F.min(axis).over(run)).withColumn("b", F.max(axis).over(run)))  # read twice
    begin = home * chunk + low
    end = F.least(begin + chunk, F.lit(high))
    # a row a line and chunk: the chunk's first and last outside cell
    ends = ranked.groupBy(*cut).agg(
        F.min(F.when(F.col("a") == begin, F.col("b") + 1)).alias("first"), F.max(F.when(F.col("b") == end - 1, F.col("a") - 1)).alias("last"),
        F.min("a").alias("lowest"), F.max("b").alias("highest"), begin.alias("begin"), end.alias("end"),
    )
    # no run at a border leaves that cell outside; a full chunk has none
    ends = ends.select(
        *cut, "begin", "end",
        F.when(F.col("lowest") > F.col("begin"), F.col("begin")).when(F.col("first") < F.col("end"), F.col("first")).alias("first"),
        F.when(F.col("highest") < F.col("end") - 1, F.col("end") - 1).when(F.col("last") >= F.col("begin"), F.col("last")).alias("last"),
    )
    line = Window.partitionBy(*others).orderBy("chunk")
    before = F.coalesce(F.lag("chunk").over(line), F.lit(-1))
    after = F.lead("chunk").over(line)
    ends = ends.withColumn("gap_below", F.when(before < home - 1, F.col("begin") - 1)).withColumn(
        "gap_above", F.when(F.coalesce(after > home + 1, F.col("end") < high), F.col("end"))
    )
    ends = ends.select(
        *cut,
        F.greatest(F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.max("gap_below").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("below"),
        F.least(F.min("first").over(line.rowsBetween(1, Window.unboundedFollowing)), F.min("gap_above").over(line.rowsBetween(0, Window.unboundedFollowing))).alias("above"),
    )
    joined = ranked.join(ends, cut)
    begin, end = home * chunk + low, F.least(home * chunk + low + chunk, F.lit(high))
    below = F.when(F.col("a") > begin, F.col("a") - 1).otherwise(F.col("below"))
    above = F.when(F.col("b") < end - 1, F.col("b") + 1).otherwise(F.col("above"))
    step = F.least(at - below, above - at)
    return joined.select(*AXES, (step * step).alias("dist2"))


def _next_axis(rows: DataFrame, axis: str, others: list[str], low: int, high: int) -> DataFrame:
    ship_package(rows.sparkSession)
    names = [*AXES, "dist2"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solved(table: pa.Table) -> pa.RecordBatch:
            columns = {n: table.column(n).to_numpy() for n in names}
            fresh = np.ones(table.num_rows, bool)
            fresh[1:] = (np.diff(columns[others[0]]) != 0) | (np.diff(columns[others[1]]) != 0)
            columns["dist2"] = along_runs(columns[axis], columns["dist2"], fresh, low, high)
            return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last line of what is here are complete
            line = [batch.column(o).to_numpy() for o in others]
            new = np.flatnonzero((line[0] != line[0][-1]) | (line[1] != line[1][-1]))
            tail = int(new[-1]) + 1 if len(new) else 0
            if held and (tail or any(held[-1].column(o)[0] != batch.column(o)[0] for o in others)):
                whole = pa.Table.from_batches([*held, batch.slice(0, tail)])
                held = []
                yield solved(whole)
            elif tail:
                yield solved(pa.Table.from_batches([batch.slice(0, tail)]))
            held.append(batch.slice(tail))
        if held:
            yield solved(pa.Table.from_batches(held))

    dealt = rows.select(*names).repartition(*others).sortWithinPartitions(*others, axis)
    return dealt.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def exact_squared_distance(voxels: DataFrame, mask: str, box: Box, axes: tuple[str, str, str] = AXES, chunk: int = CHUNK) -> DataFrame:
    """``z, y, x, dist2`` of every voxel of ``box`` inside the mask: to the nearest cell of ``box`` that isn't.

    Cells without a row are outside. ``dist2`` is null if all of the box is inside. ``axes`` is the
    order of the passes.
    """
    bounds = {a: (b, e) for a, b, e in zip(AXES, box.begin, box.end)}
    inside = voxels.where(F.col(mask) > 0)
    for a, (low, high) in bounds.items():
        inside = inside.where((F.col(a) >= low) & (F.col(a) < high))
    first, *rest = axes
    rows = _first_axis(inside.select(*AXES), first, [a for a in AXES if a != first], *bounds[first], chunk)
    rows = rows.withColumn("dist2", F.coalesce("dist2", F.lit(NEVER)).cast("bigint"))
    for axis in rest:
        rows = _next_axis(rows, axis, [a for a in AXES if a != axis], *bounds[axis])
    return rows.withColumn("dist2", F.when(F.col("dist2") != NEVER, F.col("dist2")))
