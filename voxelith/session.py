"""Session helpers: settings the engine relies on and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that every plan in this package assumes. AQE picks join strategies from measured
# sizes and splits skewed join partitions; nothing in the package forces a broadcast.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder (``spark.checkpoint.dir``).

    A temporary folder is used only in local mode with the setting absent; on a cluster a
    machine-local folder would not survive a lost executor, so that case is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelith-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Same effect as ``--py-files``; needed wherever the job was not submitted with it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="voxelith-ship-")) / "voxelith.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


TASK_ROWS = 250_000  # rows a task sorts at a time: some hundred bytes each, and three sorts


def parts(rows: int, task_rows: int = TASK_ROWS) -> int:
    """Partitions for so many rows, so that what a task holds doesn't grow with them.

    AQE merges partitions up to a number of compressed bytes; voxel rows compress to a few bytes and
    need hundreds in a sort. A number given to ``repartition`` is left as it is.
    """
    return max(1, -(-rows // task_rows))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by keys into as many tasks as so many rows need; few rows are left to AQE.

    For keys of few rows each: a number that is asked for is neither merged nor split by AQE.
    """
    return df.repartition(parts(rows), *keys) if rows > TASK_ROWS else df


def cut_lineage(df: DataFrame, scans: int | None = None, shuffles: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from the files.

    Like a reliable checkpoint it survives lost executors, but it is columnar and compressed,
    later stages read only the columns they use, and the planner sees its true size. The shuffle
    files that led to the table are removed once it is written. ``scans`` asks for at least so many
    tasks where files are read, as far as their size allows; ``shuffles`` for as many, and not fewer,
    behind each shuffle whose number the plan leaves open.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    during = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    cores = spark.sparkContext.defaultParallelism
    if scans is not None:
        during["spark.sql.files.minPartitionNum"] = str(max(scans, cores))
    if shuffles is not None:
        during["spark.sql.shuffle.partitions"] = str(max(shuffles, cores))
        during["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in during}
    try:
        for key, value in during.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
