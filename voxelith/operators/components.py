"""Connected components of thresholded graphs, one threshold or a whole sweep.

Two levels. Edges are range partitioned so that neighbouring fragments meet, and every task
contracts its edges chunk by chunk; that leaves only the nodes seen by several chunks. Those
ties are resolved by a distributed star contraction, which keeps ``(child, parent)`` rows with
``child > parent`` and alternates two published steps:

* *large*: a parent that itself has a parent is replaced by its smallest parent;
* *small*: a child keeps its smallest parent, its other parents become children of that one.

Both are an aggregate with map-side combine followed by an equi join against a side that has
one row per key, so a hub with a third of all edges is reduced before the shuffle and its join
partition can be split by AQE. Every row remembers whether the round changed it; the loop stops
when none did, which is exact and costs no extra pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.operators.kernels import unite
from voxelith.session import TASK_ROWS, cut_lineage, dealt, parts, ship_package

CHUNK = 1_000_000  # edges a task contracts at a time: bounds its memory


def _cut(df: DataFrame, rows: int) -> DataFrame:
    """Store ``df`` made of so many rows, with as many tasks as they need; few rows are left to AQE."""
    if rows <= TASK_ROWS:
        return cut_lineage(df)
    return cut_lineage(df, scans=parts(rows, 4 * TASK_ROWS), shuffles=parts(rows))


def _on(left: str, right: str, keys: list[str], a: str, b: str) -> Column:
    condition = F.col(f"{left}.{a}") == F.col(f"{right}.{b}")
    for k in keys:
        condition = condition & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return condition


def _smallest_parent(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys, "child").agg(F.min("parent").alias("smallest"))


def _round(edges: DataFrame, keys: list[str]) -> DataFrame:
    mins = _smallest_parent(edges, keys)
    large = (
        edges.alias("e")
        .join(mins.alias("m"), _on("e", "m", keys, "parent", "child"), "left")
        .select(
            *[F.col(f"e.{k}") for k in keys],
            F.col("e.child"),
            F.coalesce("m.smallest", "e.parent").alias("parent"),
            F.col("m.smallest").isNotNull().alias("changed"),
        )
        .groupBy(*keys, "child", "parent")
        .agg(F.max("changed").alias("changed"))
    )
    mins = _smallest_parent(large, keys)
    return (
        large.alias("e")
        .join(mins.alias("m"), _on("e", "m", keys, "child", "child"))
        .select(
            *[F.col(f"e.{k}") for k in keys],
            F.when(F.col("e.parent") == F.col("m.smallest"), F.col("e.child"))
            .otherwise(F.col("e.parent"))
            .alias("child"),
            F.col("m.smallest").alias("parent"),
            (F.col("e.changed") | (F.col("e.parent") != F.col("m.smallest"))).alias("changed"),
        )
        .groupBy(*keys, "child", "parent")
        .agg(F.max("changed").alias("changed"))
    )


def star_forest(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, child, parent`` where parent is the smallest id of the child's component."""
    keys = keys or []
    state = cut_lineage(
        edges.where("u <> v")
        .select(*keys, F.greatest("u", "v").alias("child"), F.least("u", "v").alias("parent"))
        .groupBy(*keys, "child", "parent")
        .agg(F.lit(True).alias("changed"))
    )
    while not state.where("changed").isEmpty():
        state = _cut(_round(state, keys), state.count())
    return state.select(*keys, "child", "parent")


def _contract(u: np.ndarray, v: np.ndarray, need: np.ndarray, points: list[int]):
    """Components of one chunk of edges at every sweep point: frames of ``point, node, root``.

    Points ascend, so each one only adds its own edges to the labels of the one before.
    """
    ids, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u):]
    label, touched = np.arange(len(ids)), np.zeros(len(ids), dtype=bool)
    for k, point in enumerate(points):
        now = need == k
        label = unite(label, a[now], b[now])
        touched[a[now]] = True
        touched[b[now]] = True
        yield pd.DataFrame({"point": np.int32(point), "node": ids[touched], "root": ids[label[touched]]})


def _chunk_components(edges: DataFrame, points: list[int], chunk: int = CHUNK) -> DataFrame:
    """``point, node, root``: components inside chunks of neighbouring edges.

    Edges ``u, v, need`` (``need`` indexes ``points``) are range partitioned, which also splits
    the edges of a hub. A task contracts at most ``chunk`` edges at a time, and its file is read by one
    task, so where the answers, two nodes an edge and point, are many, tasks follow their number.
    """

    def run(batches):
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= chunk:
                whole = pd.concat(held)
                yield from _contract(whole["u"].to_numpy(), whole["v"].to_numpy(), whole["need"].to_numpy(), points)
                held, rows = [], 0
        if held:
            whole = pd.concat(held)
            yield from _contract(whole["u"].to_numpy(), whole["v"].to_numpy(), whole["need"].to_numpy(), points)

    ship_package(edges.sparkSession)
    # stored first: range partitioning reads its input once more for the bounds
    stored = cut_lineage(edges.where("u <> v").select("u", "v", "need"))
    answers = 2 * stored.count() * len(points)
    few = [parts(answers, 8 * TASK_ROWS)] if answers > 8 * TASK_ROWS else []
    return stored.repartitionByRange(*few, "u", "v").mapInPandas(run, "point int, node bigint, root bigint")


def _components(edges: DataFrame, points: list[int], chunk: int = CHUNK) -> DataFrame:
    """``point, node, component`` for every node with an edge at the point.

    Chunks are joined through the nodes they share: such a node ties its chunk roots together,
    and only those ties enter the distributed star loop.
    """
    local = cut_lineage(_chunk_components(edges, points, chunk))
    rows = local.count()
    # a node has a row a chunk, so no key is large
    met = dealt(local, rows, "point", "node")
    spread = met.groupBy("point", "node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    ties = (
        met.join(spread.where("low <> high"), ["point", "node"])
        .where("root <> low")
        .select("point", F.col("low").alias("u"), F.col("root").alias("v"))
    )
    stars = star_forest(ties, ["point"])
    labels = (
        spread.alias("n")
        .join(stars.alias("s"), _on("n", "s", ["point"], "low", "child"), "left")
        .select("n.point", "n.node", F.coalesce("s.parent", "n.low").alias("component"))
    )
    # many nodes share a low root: AQE may split these, so their number of tasks isn't fixed in the plan
    return labels if rows <= TASK_ROWS else _cut(labels, rows)


def connected_components(nodes: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``id, component``: one row per node, isolated nodes are their own component.

    ``nodes`` has ``id``; ``edges`` has ``u, v``. A component is named after its smallest id.
    """
    labels = _components(edges.select("u", "v", F.lit(0).alias("need")), [0], chunk)
    return nodes.join(labels, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def thresholds_pct(low: int, high: int, step: int) -> list[int]:
    """Sweep points as whole hundredths, half open like ``arange``; ids never collide."""
    return list(range(low, high, step))


def thresholds_between(low: float, high: float, count: int) -> list[float]:
    """Evenly spaced thresholds including both ends."""
    if count == 1:
        return [low]
    return [low + (high - low) * i / (count - 1) for i in range(count)]


def minimum_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest by repeated lightest-edge contraction.

    The lightest edge of every component (ties by original end points, so the order is total)
    belongs to the forest. Each round at least halves the number of components that still have
    an outgoing edge, and parallel edges are reduced to the lightest before the next one.
    """
    rank = F.struct("merge_score", "a", "b")
    live = cut_lineage(
        edges.where("u <> v")
        .select("u", "v", F.col("merge_score"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    )
    chosen = None
    while not live.isEmpty():
        rows = live.count()
        ends = live.select(
            F.explode(F.array("u", "v")).alias("c"), rank.alias("r"), "u", "v"
        )
        best = _cut(
            ends.groupBy("c").agg(F.min(F.struct("r", "u", "v")).alias("m")).select("m.r", "m.u", "m.v").distinct(),
            2 * rows,
        )
        picked = best.select("r.merge_score", F.col("r.a").alias("u"), F.col("r.b").alias("v"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        labels = cut_lineage(_components(best.select("u", "v", F.lit(0).alias("need")), [0]))
        left = labels.select(F.col("node").alias("u"), F.col("component").alias("pu"))
        right = labels.select(F.col("node").alias("v"), F.col("component").alias("pv"))
        live = _cut(
            live.join(left, "u", "left")
            .join(right, "v", "left")
            .select(
                F.coalesce("pu", "u").alias("u2"), F.coalesce("pv", "v").alias("v2"), rank.alias("r")
            )
            .where("u2 <> v2")
            .groupBy(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
            .agg(F.min("r").alias("r"))
            .select("u", "v", "r.merge_score", "r.a", "r.b"),
            rows,
        )
    if chosen is None:
        return edges.select("u", "v", "merge_score").limit(0)
    return chosen.select("u", "v", "merge_score")


def sweep(
    nodes: DataFrame,
    edges: DataFrame,
    points: list[int],
    forest: bool = False,
    chunk: int = CHUNK,
    scale: int = 100,
) -> DataFrame:
    """Fragment-to-segment table for all sweep points: ``threshold_pct, fragment, segment``.

    A point ``p`` is the threshold ``p / scale``: hundredths by default, finer steps with a larger
    scale. Scores are compared with that number itself. An edge takes part at every point ``>= merge_score`` (inclusive), but is handled once, at
    the first such point; all points share one star loop. ``forest`` reduces the edges to a
    minimum spanning forest first, which has the same components at every threshold.
    """
    points = sorted(points)
    if forest:
        edges = minimum_forest(edges)
    point_array = F.array(*[F.lit(p) for p in points])
    thresholds = F.array(*[F.lit(p / scale) for p in points])
    needed = F.size(F.filter(thresholds, lambda t: t < F.col("merge_score")))
    live = edges.where(F.col("merge_score") <= F.lit(points[-1] / scale)).select("u", "v", needed.alias("need"))
    labels = _components(live, points, chunk)
    rows = nodes.count() * len(points)
    every = dealt(nodes.select(F.explode(point_array).alias("threshold_pct"), "id"), rows, "threshold_pct", "id")
    labels = dealt(labels, rows, "point", "node")
    return every.join(
        labels, (F.col("threshold_pct") == F.col("point")) & (F.col("id") == F.col("node")), "left"
    ).select(
        "threshold_pct", F.col("id").alias("fragment"), F.coalesce("component", "id").alias("segment")
    )
