"""Seeded sampling and train/val/test assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PRIME = 2_147_483_647  # fixed value: modulus of the generator


def unit_hash(key: Column, seed: int) -> Column:
    """Repeatable number in [0, 1) from a whole-number key: plain integer arithmetic, any engine."""
    first = (F.pmod(key.cast("bigint"), F.lit(PRIME)) * 48271 + seed * 69621) % PRIME
    return (first * 16807 + 12345) % PRIME / F.lit(float(PRIME))


def oversample(df: DataFrame, ratio: str) -> DataFrame:
    """Repeat each row ``ratio`` times, numbered from 0."""
    return df.where(F.col(ratio) > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), (F.col(ratio) - 1).cast("int")))
    )


def weighted_choice(requests: DataFrame, request: str, sources: list[tuple[str, float]], seed: int) -> DataFrame:
    """Pick one source per request with the given weights from a seeded hash: a map, no shuffle."""
    total = sum(w for _, w in sources)
    unit = unit_hash(F.col(request), seed)
    choice, upto = None, 0.0
    for name, weight in sources:
        upto += weight / total
        test = unit < F.lit(upto)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return requests.withColumn("source", choice.otherwise(sources[-1][0]))


def split_table(spark: SparkSession, lists: dict[str, list[int]]) -> DataFrame:
    """Split lists as rows ``split, cube_id``; a list order of definition decides ties."""
    names = list(lists)
    rows = [(n, i, c) for i, n in enumerate(names) for c in lists[n]]
    return spark.createDataFrame(rows, "split string, rank int, cube_id int")


def assign_split(cubes: DataFrame, lists: DataFrame) -> DataFrame:
    """First list that contains the cube, null when none does."""
    first = lists.groupBy("cube_id").agg(F.min_by("split", "rank").alias("split"))
    return cubes.join(first, "cube_id", "left")


def validate_lists(lists: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts of ids in several lists, ids missing from all, and ids nobody expects.

    Disjointness is a count of lists per id, not a join of every pair of lists.
    """
    held = lists.select("split", "cube_id").distinct().groupBy("cube_id").agg(F.count("*").alias("lists"))
    both = held.join(expected.select("cube_id").distinct().withColumn("known", F.lit(True)), "cube_id", "full")
    return both.agg(
        F.count_if(F.col("lists") > 1).alias("in_several"),
        F.count_if(F.col("lists").isNull()).alias("missing"),
        F.count_if(F.col("known").isNull()).alias("unexpected"),
    )
