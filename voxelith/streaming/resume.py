"""Resumable block processing: take pending blocks, process, log, until none is left.

Block requests arrive as files; a run consumes what is there (``availableNow``) and stops, so a
restarted job goes on where the last one ended. The stream's checkpoint remembers consumed
requests; the done log makes a repeated micro batch harmless.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelith.operators.grid import Layers, pending_blocks
from voxelith.sources.specs import remove
from voxelith.sources.stores import append_done, read_done

log = logging.getLogger(__name__)
REQUEST_SCHEMA = "block_id bigint, bz bigint, by bigint, bx bigint"


def process_layers(
    spark: SparkSession, total: Layers, each: int, path: str, process: Callable[[Layers], DataFrame], resume: bool = False
) -> DataFrame:
    """Run ``process`` on some layers of blocks at a time and return the rows of all of them.

    Each part has a folder of its own below ``path`` and is logged there (by its first layer, with
    the seconds it took) when its rows are on disk. With ``resume`` the parts in the log are left as
    they are; without, all begins anew. What a killed run left of an unlogged part is overwritten.
    """
    done = f"{path}/done"
    if not resume:
        remove(spark, done)  # first: without it no part counts
        remove(spark, path)
    parts = range(total[0], total[1], each)
    if not parts:
        return process((0, 0))
    finished = {r["block_id"] for r in read_done(spark, done).select("block_id").distinct().collect()}
    for first in parts:
        if first in finished:
            continue
        layers = (first, min(first + each, total[1]))
        log.info("layers %d to %d", *layers)
        start = time.time()
        process(layers).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/layer={first}")
        append_done(spark.range(first, first + 1).toDF("block_id"), done, start, time.time() - start)
    folders = [f"{path}/layer={first}" for first in parts]
    return spark.read.schema(spark.read.parquet(folders[0]).schema).parquet(*folders)


def process_requests(
    spark: SparkSession,
    requests: str,
    done: str,
    output: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 64,
) -> None:
    """Run ``process`` on the pending blocks of every micro batch.

    Each batch writes its own output folder, replaced if the batch is repeated, and the log is
    appended after the output, so a block is logged only when its rows are on disk.
    """

    def handle(batch: DataFrame, number: int) -> None:
        start = time.time()
        pending = pending_blocks(batch.dropDuplicates(["block_id"]), read_done(spark, done))
        pending = pending.persist()
        try:
            if pending.isEmpty():
                return
            process(pending).write.mode("overwrite").parquet(f"{output}/batch={number}")
            append_done(pending, done, start, time.time() - start)
        finally:
            pending.unpersist()

    stream = (
        spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(requests)
        .writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    stream.awaitTermination()
