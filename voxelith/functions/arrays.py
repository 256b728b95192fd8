"""Channel-array expressions; everything stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def scale_shift(x: Column, scale: float, shift: float) -> Column:
    return x * F.lit(scale) + F.lit(shift)


def normalise_uint8(x: Column) -> Column:
    return x / F.lit(255.0)


def quantise(x: Column, scale: float = 255.0) -> Column:
    """[0, 1] to 8-bit by truncation."""
    return (x * F.lit(scale)).cast("int")


def rescale_signed(x: Column) -> Column:
    """[-1, 1] to 0..255 by truncation."""
    return ((x / F.lit(2.0) + F.lit(0.5)) * F.lit(255)).cast("int")


def argmax(a: Column) -> Column:
    """Index of the first largest channel."""
    return F.array_position(a, F.array_max(a)) - 1


def softmax(a: Column) -> Column:
    peak = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp(x - peak))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def take(a: Column, index: int) -> Column:
    return F.element_at(a, index + 1)


def dot(a: Column, weights: list[float]) -> Column:
    products = F.zip_with(a, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_heads(a: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """1x1x1 convolution followed by a sigmoid: one output channel per weight row."""
    return F.array(*[sigmoid(dot(a, w) + F.lit(b)) for w, b in zip(weights, bias)])


def split_channels(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Multi-channel array to one row per channel."""
    return df.select(*keys, F.posexplode(column).alias("channel", "value"))


def distance_squash(d: Column, scale: float = 50.0) -> Column:
    return F.tanh(d / F.lit(scale))


def any_positive(a: Column) -> Column:
    return F.exists(a, lambda w: w > 0)


def all_positive(a: Column) -> Column:
    return F.forall(a, lambda w: w > 0)
