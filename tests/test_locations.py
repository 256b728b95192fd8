"""Summed volumes and random boxes against counts over plain arrays."""

import numpy as np
import pytest

from voxelith.operators import locations
from voxelith.operators.grid import Box

CELL = "z bigint, y bigint, x bigint"
EXTENT = Box((-2, 3, 0), (9, 5, 7))


@pytest.fixture(scope="module")
def mask():
    return np.random.default_rng(3).random(EXTENT.shape) < 0.5


@pytest.fixture(scope="module")
def summed(spark, mask):
    cells = [tuple(int(c + b) for c, b in zip(cell, EXTENT.begin)) for cell in np.argwhere(mask)]
    odd = [cells[0], (50, 3, 0), (-3, 3, 0), (None, 3, 0)]  # repeated, outside, null
    df = spark.createDataFrame([(*c, "more") for c in cells + odd], CELL + ", n string")
    return locations.summed_volume(df, EXTENT, piece=3)


def test_every_prefix(summed, mask):
    want = mask.cumsum(0).cumsum(1).cumsum(2)
    got = {(r.z + 2, r.y - 3, r.x): r.n for r in summed.collect()}
    assert got == {tuple(map(int, at)): int(want[tuple(at)]) for at in np.ndindex(*EXTENT.shape)}


def test_counts_of_boxes(spark, summed, mask):
    rows = [(z, y, x) for z in (-6, -2, 1, 6, 20) for y in (1, 3, 6) for x in (-1, 0, 5)]
    got = {(r.z, r.y, r.x): r.inside for r in locations.box_counts(spark.createDataFrame(rows, CELL), summed, (3, 2, 4), EXTENT).collect()}
    part = lambda first, size, low: slice(max(0, first - low), max(0, first - low + size))
    assert got == {
        at: int(mask[tuple(part(f, s, b) for f, s, b in zip(at, (3, 2, 4), EXTENT.begin))].sum()) for at in rows
    }


def test_draws(spark, summed, mask):
    draws = spark.createDataFrame([(i,) for i in [*range(60), 0, None]], "k bigint")
    draw = lambda least, seed=1: {
        r.id: tuple(r)[1:] for r in locations.random_locations(draws, summed, EXTENT, (3, 2, 4), least, attempts=5, seed=seed, id_col="k").collect()
    }
    got = draw(0.5)
    assert set(got) == set(range(60)) and got == draw(0.5) and got != draw(0.5, seed=2)
    for attempt, z, y, x, inside in (v for v in got.values() if v[0] is not None):
        z, y = z + 2, y - 3
        assert 0 <= z <= 6 and 0 <= y <= 3 and 0 <= x <= 3
        assert inside == mask[z : z + 3, y : y + 2, x : x + 4].sum() >= 12
    every = draw(0.0)
    assert {v[0] for v in every.values()} == {0} and len({v[1] for v in every.values()}) == 7
    assert set(draw(1.1).values()) == {(None,) * 5}


def test_no_cells_and_no_room(spark, summed):
    none = spark.createDataFrame([], CELL)
    assert {r.n for r in locations.summed_volume(none, Box((0, 0, 0), (2, 2, 2))).collect()} == {0}
    assert locations.summed_volume(none, Box((0, 0, 0), (0, 2, 2))).count() == 0
    with pytest.raises(ValueError):
        locations.random_locations(none, summed, EXTENT, (10, 1, 1), 0.5, id_col="z")


def test_large_tables_are_not_sent_to_the_driver(spark, mask):
    """They are of few bytes when stored, far under Spark's limit for a broadcast."""
    cells = spark.createDataFrame([tuple(map(int, cell)) for cell in np.argwhere(mask)], CELL)
    extent = Box((0, 0, 0), EXTENT.shape)
    table = locations.summed_volume(cells, extent, piece=3)
    drawn = locations.random_locations(spark.range(20), table, extent, (3, 2, 4), 0.5)
    drawn.collect()
    for df in (table, drawn):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
