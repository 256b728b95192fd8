"""Overlap tables between two labellings and the scores computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.spans import KEY, sums_at
from voxelith.session import cut_lineage


def contingency(
    items: DataFrame,
    truth: str,
    segment: str,
    keys: list[str] | None = None,
    ignore_truth_zero: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """``keys, gt, seg, n``: number of items per label pair."""
    if ignore_truth_zero:
        items = items.where(F.col(truth) != 0)
    n = F.count("*") if weight is None else F.sum(weight)
    return items.groupBy(*(keys or []), F.col(truth).alias("gt"), F.col(segment).alias("seg")).agg(n.alias("n"))


def _sums(table: DataFrame, keys: list[str]) -> DataFrame:
    sets = [[*keys, "gt", "seg"], [*keys, "gt"], [*keys, "seg"]]
    cells = table.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, "gt", "seg"]]
    ).agg(
        F.sum("n").cast("double").alias("m"),
        F.grouping("gt").alias("no_gt"),
        F.grouping("seg").alias("no_seg"),
    )
    joint = (F.col("no_gt") == 0) & (F.col("no_seg") == 0)
    by_gt = F.col("no_seg") == 1
    by_seg = F.col("no_gt") == 1
    plogp = F.col("m") * F.log2("m")
    square = F.col("m") * F.col("m")
    return cells.groupBy(*keys).agg(
        F.sum(F.when(joint, F.col("m"))).alias("total"),
        F.sum(F.when(joint, plogp)).alias("h_joint"),
        F.sum(F.when(by_gt, plogp)).alias("h_gt"),
        F.sum(F.when(by_seg, plogp)).alias("h_seg"),
        F.sum(F.when(joint, square)).alias("q_joint"),
        F.sum(F.when(by_gt, square)).alias("q_gt"),
        F.sum(F.when(by_seg, square)).alias("q_seg"),
    )


def _sums_at(table: DataFrame, points: list[int]) -> DataFrame:
    m = F.col("m").cast("double")
    marginals = {"joint": ["gt", "seg"], "gt": ["gt"], "seg": ["seg"]}
    out = None
    for name, by in marginals.items():
        more = [F.sum(m).alias("total")] if name == "joint" else []
        part = sums_at(table, by, points, "n").groupBy(KEY).agg(
            F.sum(m * F.log2(m)).alias(f"h_{name}"), F.sum(m * m).alias(f"q_{name}"), *more
        )
        out = part if out is None else out.join(part, KEY)
    return out


def rand_voi(table: DataFrame, keys: list[str] | None = None, points: list[int] | None = None) -> DataFrame:
    """RAND and variation of information per key, in bits.

    Needs only sums over the table and its two marginals, which one grouping-set aggregate
    delivers together; nothing is joined back. With ``points`` the table's rows have spans (see
    ``operators/spans``) and the scores are those of each point; three aggregates by span, then.
    """
    sums = _sums(table, keys or []) if points is None else _sums_at(table, points)
    keys = keys or [] if points is None else [KEY]
    split = (F.col("h_gt") - F.col("h_joint")) / F.col("total")
    merge = (F.col("h_seg") - F.col("h_joint")) / F.col("total")
    # a perfect split or merge can come out as -1e-17; adding 0.0 turns -0.0 into 0.0
    tidy = lambda c: F.round(c, 6) + F.lit(0.0)
    return sums.where("total > 0").select(
        *keys,
        tidy(F.col("q_joint") / F.col("q_gt")).alias("rand_split"),
        tidy(F.col("q_joint") / F.col("q_seg")).alias("rand_merge"),
        tidy(split).alias("voi_split"),
        tidy(merge).alias("voi_merge"),
        tidy(split + merge).alias("voi"),
    )


def segment_counts(table: DataFrame, points: list[int]) -> DataFrame:
    """Number of segments at each point of a table whose rows have spans."""
    return sums_at(table, ["seg"], points, "n").groupBy(KEY).agg(F.count("*").alias("number_of_segments"))


def cluster_voi(table: DataFrame, by: str) -> DataFrame:
    """Contribution of every cluster: per ``gt`` the split, per ``seg`` the merge entropy.

    The contributions add up to ``voi_split`` / ``voi_merge``.
    """
    name = {"gt": "voi_split_i", "seg": "voi_merge_j"}[by]
    table = cut_lineage(table)  # read for the total and for the clusters
    total = table.agg(F.sum("n").cast("double")).scalar()
    n = F.col("n").cast("double")
    return (
        table.groupBy(by)
        .agg(F.sum(n).alias("m"), F.sum(n * F.log2(n)).alias("h"))
        .select(
            F.col(by).alias("cluster"),
            (F.round((F.col("m") * F.log2("m") - F.col("h")) / total, 6) + F.lit(0.0)).alias(name),
        )
    )


def worst(scores: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` largest entries by (score, id); plans as a per-partition top-k, not a sort."""
    return scores.orderBy(F.desc(column), F.desc("cluster")).limit(k)
