"""Ordering operators whose work is never one key's whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.session import cut_lineage

DIGIT_BITS = 21
LEVELS = 3


def next_in_group(
    df: DataFrame, key: str, order: list[str], bucket: Column, value: str, name: str
) -> DataFrame:
    """``lead(value) OVER (PARTITION BY key ORDER BY order)`` for keys of any size.

    ``bucket`` must not decrease along ``order``. The lead is taken inside (key, bucket); the
    last row of a bucket takes the first row of the key's next bucket, which comes from a table
    with one row per (key, bucket). A hot key is thereby spread over its buckets.
    """
    part = Window.partitionBy(key, "__bucket").orderBy(*order)
    # the window and the bucket aggregate share this shuffle
    rows = df.withColumn("__bucket", bucket).repartition(key, "__bucket")
    inner = rows.withColumn("__next", F.lead(value).over(part))
    first = rows.groupBy(key, "__bucket").agg(F.min_by(value, F.struct(*order)).alias("first"))
    chain = first.select(
        key,
        "__bucket",
        F.lead("first").over(Window.partitionBy(key).orderBy("__bucket")).alias("__first"),
    )
    return inner.join(chain, [key, "__bucket"]).select(
        *df.columns, F.coalesce("__next", "__first").alias(name)
    )


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """``column, dense``: distinct ids mapped to 0..n-1 in ascending order; null has no id.

    ``dense_rank() OVER (ORDER BY id)`` would sort all ids in one task. Here the id is cut into
    22 and twice 21 bits, the sign bit flipped so that negative ids come first; counts per prefix are
    summed level by level, so every window sees at most 2^22 rows and an id's rank is the sum of
    three offsets.
    """
    ids = values.select(F.col(column).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    digits = [f"d{i}" for i in range(LEVELS)]
    ids = cut_lineage(ids)
    for i, d in enumerate(digits):
        shift = DIGIT_BITS * (LEVELS - 1 - i)
        digit = F.shiftright("id", shift)
        if i:
            digit = digit.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        ids = ids.withColumn(d, digit)  # the first keeps the sign
    counts = {LEVELS: ids.withColumn("n", F.lit(1).cast("bigint"))}
    for level in range(LEVELS - 1, 0, -1):
        counts[level] = counts[level + 1].groupBy(*digits[:level]).agg(F.sum("n").alias("n"))
    offsets = None
    for level in range(1, LEVELS + 1):
        prefix, digit = digits[: level - 1], digits[level - 1]
        window = Window.partitionBy(*prefix).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(window), F.lit(0))
        table = counts[level].withColumn("before", before).drop("n")
        if offsets is not None:
            table = table.join(offsets, prefix).withColumn("before", F.col("before") + F.col("above")).drop("above")
        offsets = table.withColumnRenamed("before", "above")
    return offsets.select(F.col("id").alias(column), F.col("above").alias("dense"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
