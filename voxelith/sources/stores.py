"""Tables the stages share: scores with upsert, lookup tables, done logs, run groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.scores import upsert
from voxelith.sources.specs import children, exists

REPORT_KEYS = ["network_configuration", "merge_function", "threshold", "run_type"]


class VersionedTable:
    """Parquet table whose every change is a new complete version.

    A version counts only once its ``_SUCCESS`` marker exists, so a job lost half way leaves the
    previous version current. Nothing is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        return sorted(
            int(n[1:]) for n in children(self.spark, self.path)
            if n.startswith("v") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")
        )

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}")

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        versions = self._versions()
        merged = rows if not versions else upsert(self.read(), rows, keys)
        target = versions[-1] + 1 if versions else 0
        # an unfinished attempt may have left files under the next number
        merged.write.mode("overwrite").parquet(f"{self.path}/v{target}")

    def find(self, condition) -> DataFrame:
        return self.read().where(condition)

    def projection(self, columns: list[str]) -> DataFrame:
        """Selected columns; an empty table is an error, as for a misspelt run name."""
        rows = self.read().select(*columns)
        if rows.isEmpty():
            raise LookupError(f"no rows in {self.path}")
        return rows


def write_lut(lut: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fragment-to-segment table, a partition per sweep point, so a point reads its own files."""
    lut.write.mode(mode).partitionBy("threshold_pct").option("compression", "zstd").parquet(path)


def read_lut(spark: SparkSession, path: str, threshold: float | None = None) -> DataFrame:
    lut = spark.read.parquet(path)
    return lut if threshold is None else lut.where(F.col("threshold_pct") == round(threshold * 100))


def append_site_lut(located: DataFrame, path: str) -> None:
    """Site-to-fragment rows of some blocks; background sites are kept as fragment 0."""
    located.select("id", "fragment").write.mode("append").parquet(path)


def read_site_lut(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All blocks' rows and the total number of background sites."""
    rows = spark.read.parquet(path)
    lut = rows.where("fragment <> 0").select(F.col("id").alias("site"), "fragment")
    return lut, rows.agg(F.count_if(F.col("fragment") == 0).alias("num_bg_sites"))


DONE_SCHEMA = "block_id bigint, start timestamp, duration double"


def read_done(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], DONE_SCHEMA)
    return spark.read.schema(DONE_SCHEMA).parquet(path)


def append_done(blocks: DataFrame, path: str, start: float, duration: float) -> None:
    """Log blocks that were processed together; each gets an even share of their ``duration``."""
    count = max(1, blocks.count())
    blocks.select(
        "block_id", F.timestamp_seconds(F.lit(start)).alias("start"), F.lit(float(duration) / count).alias("duration")
    ).write.mode("append").parquet(path)


def run_groups(spark: SparkSession, groups: dict) -> DataFrame:
    """``group -> runs -> {scores_db_name, wandb}`` catalogue as rows."""
    rows = [
        (group, run, (info or {}).get("scores_db_name"), (info or {}).get("wandb"))
        for group, body in groups.items()
        for run, info in body["runs"].items()
    ]
    return spark.createDataFrame(rows, "group_name string, run_name string, scores_db_name string, wandb string")


def read_run_groups(spark: SparkSession, path: str) -> DataFrame:
    """YAML catalogue file; needs the optional YAML package."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package") from error
    with open(path, encoding="utf-8") as f:
        return run_groups(spark, yaml.safe_load(f)["groups"])


def read_scores_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema).na.drop("all")


def write_scores_csv(scores: DataFrame, path: str) -> None:
    scores.write.mode("errorifexists").option("header", True).csv(path)


def write_splits(cubes: DataFrame, path: str, dry_run: bool = False) -> None:
    """Cubes into one folder per split; refuses an existing target, does nothing on a dry run."""
    if not dry_run:
        cubes.where("split IS NOT NULL").write.mode("errorifexists").partitionBy("split").parquet(path)
