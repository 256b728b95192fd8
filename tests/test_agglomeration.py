"""Merge trees of blocks: cuts, owned edges, context."""

import numpy as np
import pytest

from tests.test_kernels import by_hand
from voxelith.operators import blockops, kernels
from voxelith.operators.grid import Box

AFFINITIES = ("az", "ay", "ax")


def volume(spark, shape=(6, 8, 8), seed=3):
    """Random affinities over fragments of 2 x 2 x 2, with holes and background."""
    rng = np.random.default_rng(seed)
    rows = []
    for z, y, x in np.ndindex(*shape):
        if rng.random() < 0.9:
            frag = 0 if rng.random() < 0.1 else 1 + ((z // 2) * 4 + y // 2) * 4 + x // 2
            rows.append((z, y, x, frag, *(int(a) for a in rng.integers(0, 256, 3))))
    return rows, spark.createDataFrame(rows, "z bigint, y bigint, x bigint, frag bigint, az bigint, ay bigint, ax bigint")


def faces(rows, box=None):
    """``(z, y, x, axis), u, v, aff`` of all faces; with both voxels in ``box`` (low, high) if given."""
    at = {r[:3]: r for r in rows}
    for r in rows:
        for axis in range(3):
            low = tuple(c - (k == axis) for k, c in enumerate(r[:3]))
            if low in at and r[3] and at[low][3] and r[3] != at[low][3]:
                if box is None or all(b <= c < e for p in (r[:3], low) for c, b, e in zip(p, *box)):
                    yield (*r[:3], axis), *sorted((r[3], at[low][3])), r[4 + axis]


def merged(found, name):
    score, first = kernels.named_score(name)
    return by_hand(found, score, first)


@pytest.mark.parametrize("name", ["mean", "hist_quant_50", "hist_quant_75_initmax"])
def test_cuts_are_agglomerations_up_to_a_threshold(spark, name):
    rows, df = volume(spark)
    merges = merged([f[1:] for f in faces(rows)], name)
    trees = blockops.merge_trees(df, "frag", (16, 16, 16), name)
    points = [0, 10, 25, 40, 60, 100]
    got = {(r.threshold, r.fragment): r.segment for r in blockops.segmentations(trees, df, "frag", (16, 16, 16), points).collect()}
    present = {r[3] for r in rows if r[3]}
    for t in points:
        label = {i: i for i in present}
        for value, kept, absorbed in merges:
            if value > t / 100:
                break
            label = {i: kept if s == absorbed else s for i, s in label.items()}
        assert {i: got[t, i] for i in present} == label
    assert len(got) == len(points) * len(present)


@pytest.mark.parametrize("context", [(0, 0, 0), (1, 2, 3), (4, 4, 4)])
def test_edges_belong_to_the_block_of_their_first_face(spark, context):
    rows, df = volume(spark)
    size, extent = (4, 4, 4), Box((0, 0, 0), (6, 8, 8))
    every = list(faces(rows))
    want = {}
    for u, v in {f[1:3] for f in every}:
        place = min(f[0] for f in every if f[1:3] == (u, v))
        block = [c // s for c, s in zip(place[:3], size)]
        box = [b * s - c for b, s, c in zip(block, size, context)], [b * s + s + c for b, s, c in zip(block, size, context)]
        own = [f for f in every if [c // s for c, s in zip(f[0][:3], size)] == block]
        seen = {f[0]: f for f in [*faces(rows, box), *own]}
        label, level = {u: u, v: v}, None
        for value, kept, absorbed in merged([f[1:] for f in seen.values()], "hist_quant_75"):
            label = {i: kept if s == absorbed else s for i, s in label.items()}
            if label[u] == label[v]:
                level = value
                break
        want[u, v] = level
    for box in (None, extent):
        got = blockops.agglomerated_edges(df, "frag", size, "hist_quant_75", context, box)
        assert {(r.u, r.v): r.merge_score for r in got.collect()} == want


def test_no_faces(spark):
    _, df = volume(spark)
    alone = df.where("frag = 5")
    trees = blockops.merge_trees(alone, "frag", (4, 4, 4))
    assert trees.count() == 0 and blockops.owned_edges(trees).count() == 0
    assert [r.segment for r in blockops.segmentations(trees, alone, "frag", (4, 4, 4), [50]).collect()] == [5]
    with pytest.raises(ValueError):
        blockops.merge_trees(df, "frag", (4, 4, 4), context=(5, 0, 0))
