"""Whole-volume distances against all pairs."""

import numpy as np
import pytest

from voxelith.operators import distances
from voxelith.operators.grid import Box


def test_lower_envelope():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        values = np.where(rng.random(n) < 0.3, distances.NEVER, rng.integers(0, 60, n)).tolist()
        known = [(k, v) for k, v in enumerate(values) if v != distances.NEVER]
        want = [min((v + (p - k) ** 2 for k, v in known), default=distances.NEVER) for p in range(n)]
        assert distances.lower_envelope(values) == want


@pytest.mark.parametrize("share, chunk", [(0.7, 3), (0.97, 4), (0.999, 2), (1.0, 5)])
def test_distances_know_no_blocks(spark, share, chunk):
    rng = np.random.default_rng(int(share * 100))
    low, shape = (-3, 2, 0), (23, 6, 7)
    mask = rng.random(shape) < share
    cells = np.argwhere(mask)
    rows = [(*(int(c + b) for c, b in zip(cell, low)), 1) for cell in cells] + [(100, 2, 0, 1), (0, -1, 0, 1), (-3, 2, 0, 0)]
    if mask[0, 0, 0]:
        rows.remove((-3, 2, 0, 1))
        mask[0, 0, 0] = share == 1.0
        if share == 1.0:
            rows[-1] = (-3, 2, 0, 1)
    df = spark.createDataFrame(rows, "z bigint, y bigint, x bigint, inside int")
    got = {(r.z, r.y, r.x): r.dist2 for r in distances.exact_squared_distance(df, "inside", Box(low, shape), chunk=chunk).collect()}
    outside = np.argwhere(~mask)
    want = {
        tuple(int(c + b) for c, b in zip(cell, low)): int(((outside - cell) ** 2).sum(axis=1).min()) if len(outside) else None
        for cell in np.argwhere(mask)
    }
    assert got == want


def test_lines_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(60).selectExpr("0L AS z", "id div 20 AS y", "id % 20 AS x", "1 AS inside")
        got = {(r.y, r.x): r.dist2 for r in distances.exact_squared_distance(df, "inside", Box((0, 0, 0), (1, 3, 21))).collect()}
        assert got == {(y, x): (20 - x) ** 2 for y in range(3) for x in range(20)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
