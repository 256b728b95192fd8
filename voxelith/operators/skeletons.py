"""Skeleton scoring: lengths, expected run length, split and merge statistics.

Nodes are ``id, component, z, y, x, seg``; edges are ``source, target``. ``keys`` name extra
columns of the attributed edges (for instance a sweep point) that separate independent scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.spans import KEY, each_point, holds


def fragment_edges(located: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, su, sv, length``: summed edge lengths by the fragments under their ends.

    Edges meet their ends once, whatever the number of sweep points; :func:`at_points` then maps
    these few rows.
    """
    nodes = located.withColumnRenamed("fragment", "seg")
    return attribute_edges(nodes, edges).groupBy("component", "su", "sv").agg(F.sum("length").alias("length"))


def fragment_sites(located: DataFrame) -> DataFrame:
    """``component, seg, n``: number of sites by the fragment under them."""
    return located.groupBy("component", F.col("fragment").alias("seg")).agg(F.count("*").alias("n"))


def at_points(rows: DataFrame, lut: DataFrame, points: list[int], columns: list[str]) -> DataFrame:
    """Rows at every sweep point, with fragments in ``columns`` replaced by their segments.

    ``lut`` has ``threshold_pct, fragment, segment``; a fragment without an entry, as background,
    keeps its own id.
    """
    out = rows.withColumn("threshold_pct", F.explode(F.array(*[F.lit(p) for p in points])))
    for c in columns:
        table = lut.select("threshold_pct", F.col("fragment").alias(c), F.col("segment").alias("__segment"))
        out = out.join(table, ["threshold_pct", c], "left").withColumn(c, F.coalesce("__segment", c)).drop("__segment")
    return out


def attribute_edges(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, component, su, sv, length``; edges with a missing end drop out."""
    keys = keys or []
    a = nodes.select(
        *keys, F.col("id").alias("source"), "component", F.col("seg").alias("su"),
        F.col("z").alias("z0"), F.col("y").alias("y0"), F.col("x").alias("x0"),
    )
    b = nodes.select(
        *keys, F.col("id").alias("target"), F.col("seg").alias("sv"),
        F.col("z").alias("z1"), F.col("y").alias("y1"), F.col("x").alias("x1"),
    )
    square = lambda c: (F.col(f"{c}0") - F.col(f"{c}1")) * (F.col(f"{c}0") - F.col(f"{c}1"))
    return (
        edges.join(a, "source")
        .join(b, [*keys, "target"])
        .select(*keys, "component", "su", "sv", F.sqrt(square("z") + square("y") + square("x")).alias("length"))
    )


def lengths(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy("component").agg(F.round(F.sum("length"), 6).alias("length"))


def merging_segments(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Segments that touch more than one skeleton; min <> max needs no set per segment."""
    return (
        nodes.groupBy(*(keys or []), "seg")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select(*(keys or []), "seg")
    )


def merging_at(nodes: DataFrame, points: list[int]) -> DataFrame:
    """``seg, merges``: for segments that ever touch more than one skeleton, whether they do at each point.

    :func:`merging_segments` of nodes that have spans (see ``operators/spans``).
    """
    low = [F.min(F.when(holds(p), F.col("component"))) for p in points]
    high = [F.max(F.when(holds(p), F.col("component"))) for p in points]
    wide = nodes.groupBy("seg").agg(F.array(*[F.coalesce(a != b, F.lit(False)) for a, b in zip(low, high)]).alias("merges"))
    return wide.where(F.array_contains("merges", True))


def expected_run_length_at(
    attributed: DataFrame, merging: DataFrame, points: list[int], omit_background: bool = True
) -> DataFrame:
    """:func:`expected_run_length` at every point, of edges that have spans, with :func:`merging_at`.

    ``attributed`` has ``component, su, sv, length, first, last``. Lengths of skeletons don't depend on the
    point; they are those at the first one.
    """
    inside = attributed.where("su = sv AND su <> 0" if omit_background else "su = sv")
    wide = inside.groupBy("component", "su").agg(
        *[F.sum(F.when(holds(p), F.col("length"))).alias(f"__{i}") for i, p in enumerate(points)]
    )
    runs = wide.join(merging.withColumnRenamed("seg", "su"), "su", "left").select(
        each_point(points, r=[
            F.when(~F.coalesce(F.col("merges")[i], F.lit(False)), F.col(f"__{i}")) for i in range(len(points))
        ])
    )
    run2 = runs.groupBy(KEY).agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("run2"))
    skeletons = attributed.where(holds(points[0])).groupBy("component").agg(F.sum("length").alias("len"))
    whole = skeletons.agg(F.sum(F.col("len") * F.col("len")).alias("len2"), F.sum("len").alias("len"), F.count("*").alias("n"))
    every = whole.where("n > 0").select("len2", "len", F.explode(F.array(*[F.lit(p) for p in points])).alias(KEY))
    sums = every.join(run2, KEY, "left").withColumn("run2", F.coalesce("run2", F.lit(0.0)))
    return _run_length_scores(sums, [KEY])


def expected_run_length(
    attributed: DataFrame,
    merging: DataFrame,
    keys: list[str] | None = None,
    omit_background: bool = True,
) -> DataFrame:
    """``keys, erl, max_erl, normalized_erl, total_path_length``.

    An edge counts when both ends share a segment that is not merging. ``max_erl`` is the value
    of a perfect labelling.
    """
    keys = keys or []
    # one row per (component, su, sv): where su = sv it already is the run of that segment
    pieces = attributed.groupBy(*keys, "component", "su", "sv").agg(F.sum("length").alias("length"))
    flags = merging.select(*keys, F.col("seg").alias("su"), F.lit(True).alias("merges"))
    counts = (F.col("su") == F.col("sv")) & F.col("merges").isNull()
    if omit_background:
        counts = counts & (F.col("su") != 0)
    per_skeleton = (
        pieces.join(flags, [*keys, "su"], "left")
        .groupBy(*keys, "component")
        .agg(
            F.sum("length").alias("len"),
            F.sum(F.when(counts, F.col("length") * F.col("length")).otherwise(0.0)).alias("run2"),
        )
    )
    sums = per_skeleton.groupBy(*keys).agg(
        F.sum("run2").alias("run2"), F.sum(F.col("len") * F.col("len")).alias("len2"), F.sum("len").alias("len")
    )
    return _run_length_scores(sums, keys)


def _run_length_scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(
        *keys,
        F.round(F.try_divide("run2", "len"), 6).alias("erl"),
        F.round(F.try_divide("len2", "len"), 6).alias("max_erl"),
        F.round(F.try_divide("run2", "len2"), 6).alias("normalized_erl"),
        F.round("len", 6).alias("total_path_length"),
    )


def split_pairs(attributed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct directed (segment, segment) pairs of broken edges per skeleton, as rows."""
    return attributed.where("su <> sv").select(*(keys or []), "component", "su", "sv").distinct()


def merge_pairs(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(segment, skeleton) rows of every merging segment."""
    keys = keys or []
    return (
        nodes.select(*keys, "seg", "component").distinct()
        .join(merging_segments(nodes, keys), [*keys, "seg"], "left_semi")
    )


def split_documents(pairs: DataFrame) -> DataFrame:
    """One row per entry of a skeleton's split list, with the list's size: ``comp_id, a, b, n_pairs``.

    Rows keep the same layout for lists of any length; sizes are aggregated and joined back.
    """
    rows = pairs.select(F.col("component").alias("comp_id"), F.col("su").alias("a"), F.col("sv").alias("b"))
    return rows.join(rows.groupBy("comp_id").agg(F.count("*").alias("n_pairs")), "comp_id")


def merge_documents(pairs: DataFrame) -> DataFrame:
    """One row per entry of a segment's merge list: ``seg_id, comp_id``, and whether it is the last."""
    rows = pairs.select(F.col("seg").alias("seg_id"), F.col("component").alias("comp_id"))
    last = rows.groupBy("seg_id").agg(F.max("comp_id").alias("last"))
    return rows.join(last, "seg_id").select("seg_id", "comp_id", (F.col("comp_id") == F.col("last")).alias("is_last"))


def read_skeletons(
    nodes: DataFrame, mask: DataFrame, components: DataFrame, box_predicate
) -> DataFrame:
    """Nodes in a box with their mask and component joined on, masked-in ones with coordinates."""
    return (
        nodes.where(box_predicate)
        .join(mask, "id", "left")
        .join(components, "id", "left")
        .where("masked AND z IS NOT NULL AND component_id >= 0")
    )


def unsplittable_fragments(sites: DataFrame) -> DataFrame:
    """Fragments of a merging segment that carry more than one skeleton: ``seg, fragment``."""
    return (
        sites.where("fragment <> 0")
        .groupBy("seg", "fragment")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("seg", "fragment")
    )
