"""Loss arithmetic as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.arrays import sigmoid


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_error(pred: Column, target: Column, weights: Column | None = None) -> Column:
    """Per-channel weighted squared error."""
    error = F.zip_with(pred, target, lambda p, t: (p - t) * (p - t))
    return error if weights is None else F.zip_with(weights, error, lambda w, e: w * e)


def scaled_mse_map(pred: Column, target: Column, weights: Column | None = None) -> Column:
    """Channel mean of the weighted squared error: one value per voxel."""
    return _sum(squared_error(pred, target, weights)) / F.size(pred)


def masked_mean(value: Column, weight: Column) -> Column:
    """Mean over positive weights, or over everything when the loss is zero throughout."""
    inside = F.avg(F.when(weight > 0, value))
    return F.when(F.max(F.abs(value)) > 0, inside).otherwise(F.avg(value))


def weighted_mse(pred: str, target: str, weights: str) -> Column:
    """Aggregate expression over rows that hold one channel value each."""
    return masked_mean(F.col(weights) * (F.col(pred) - F.col(target)) * (F.col(pred) - F.col(target)), F.col(weights))


def cross_entropy_map(logits: Column, label: Column, mask: Column | None = None) -> Column:
    """``log(sum exp x) - x[label]`` shifted by the largest logit, times an optional mask."""
    peak = F.array_max(logits)
    total = F.log(_sum(F.transform(logits, lambda x: F.exp(x - peak)))) + peak
    loss = total - F.element_at(logits, (label + 1).cast("int"))
    return loss if mask is None else loss * mask


def hardness_loss(hardness: Column, loss_map: Column, formula: str, weight: float = 1.0) -> Column:
    if formula == "ohl":
        value = -hardness * loss_map
    elif formula == "mse":
        value = (hardness - loss_map) * (hardness - loss_map)
    else:
        raise ValueError(f"unknown hardness loss {formula!r}")
    return value * F.lit(weight)


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to one."""
    if not weights:
        raise ValueError("loss weights may not be empty")
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def combine(maps: dict[str, Column], weights: dict[str, float], exclude: tuple[str, ...] = ()) -> Column | None:
    """Weighted sum of loss maps; None when every term is excluded."""
    used = [m * F.lit(weights[k]) for k, m in maps.items() if k not in exclude and weights.get(k, 0) != 0]
    if not used:
        return None
    total = used[0]
    for term in used[1:]:
        total = total + term
    return total


def masked_total(loss: Column, mask: Column) -> Column:
    """Mean of the loss inside the mask; 0 when the mask is empty."""
    return F.coalesce(F.avg(F.when(mask, loss)), F.lit(0.0))


def finalize_hardness(
    df: DataFrame, raw: str, sample: str, mode: str = "sum_numel", c: float = 0.1, out: str = "hardness"
) -> DataFrame:
    """``sigmoid(raw) + c``, normalised over the batch or per sample.

    ``none``; ``original_batchsum`` divides by the sum of everything; ``batchsum`` by the
    sample's sum, ``sum_numel`` by its mean, ``sum10k`` by its sum over 10 000. The per-sample
    sums are aggregated and joined back: a window over the sample would hold it in one task.
    """
    base = df.withColumn(out, sigmoid(F.col(raw)) + F.lit(c))
    if mode == "none":
        return base
    if mode == "original_batchsum":
        total = base.agg(F.sum(out)).scalar()
        return base.withColumn(out, F.col(out) / total)
    divisor = {
        "batchsum": F.sum(out),
        "sum_numel": F.sum(out) / F.count("*"),
        "sum10k": F.sum(out) / F.lit(10000.0),
    }[mode]
    sums = base.groupBy(sample).agg(divisor.alias("__divisor"))
    return base.join(sums, sample).withColumn(out, F.col(out) / F.col("__divisor")).drop("__divisor")


def balance_weights(
    df: DataFrame, label: str, keys: list[str], classes: int = 2, clip: tuple[float, float] = (0.05, 0.95)
) -> DataFrame:
    """Inverse class frequency per key: ``1 / (classes * share)``, the share clipped to ``clip``."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, keys) if keys else counts.withColumn("total", counts.agg(F.sum("n")).scalar())
    share = F.least(F.greatest(F.col("n") / F.col("total"), F.lit(clip[0])), F.lit(clip[1]))
    return joined.select(*keys, label, "n", F.round(F.lit(1.0) / (F.lit(float(classes)) * share), 6).alias("weight"))
