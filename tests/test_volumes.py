"""Grid, neighbour, crop/pad and kernel operators against hand values and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import blockops, grid, kernels, neighbours, rag, volumes
from voxelith.operators.grid import Box


def volume(spark, array, name="v"):
    rows = [(*map(int, i), int(array[i])) for i in np.ndindex(array.shape)]
    return spark.createDataFrame(rows, f"z bigint, y bigint, x bigint, {name} bigint")


def dense(df, name, shape):
    out = np.zeros(shape, dtype="int64")
    for r in df.select("z", "y", "x", name).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


def test_center_box():
    assert volumes.center_box((7,), (3,)) == Box((2,), (3,))
    assert volumes.center_box((6,), (3,)) == Box((1,), (3,))
    with pytest.raises(ValueError):
        volumes.center_box((3,), (4,))


def test_box_algebra():
    a, b = Box((0, 0, 0), (10, 10, 10)), Box((5, -2, 9), (10, 5, 10))
    assert a.intersect(b) == Box((5, 0, 9), (5, 3, 1))
    assert Box((40, 18, 18), (200, 90, 90)).to_voxels((20, 9, 9), (20, 0, 9)) == Box((1, 2, 1), (10, 10, 10))
    assert Box((10, 0, -1), (20, 20, 1)).to_voxels((20, 20, 20)) == Box((0, 0, -1), (2, 1, 1))
    assert Box((10, 0, 0), (0, 20, 20)).to_voxels((20, 20, 20)).empty
    assert a.intersect(Box((20, 0, 0), (1, 1, 1))).empty


@pytest.mark.parametrize("fit, last", [("shrink", (8, 10)), ("overhang", (8, 12))])
def test_grid(spark, fit, last):
    blocks = grid.block_grid(spark, Box((0, 0, 0), (10, 4, 4)), (4, 4, 4), (1, 0, 0), fit)
    spans = [(r.write_z0, r.write_z1) for r in blocks.orderBy("block_id").collect()]
    assert spans == [(0, 4), (4, 8), last]
    first = blocks.orderBy("block_id").first()
    assert (first.read_z0, first.read_z1) == (-1, 5)


def test_scan_snaps_to_edge(spark):
    rows = grid.scan_shifts(spark, Box((0, 0, 0), (10, 4, 4)), Box((0, 0, 0), (4, 4, 4))).collect()
    assert sorted(r.shift_z for r in rows) == [0, 4, 6]
    with pytest.raises(ValueError):
        grid.scan_shifts(spark, Box((0, 0, 0), (3, 4, 4)), Box((0, 0, 0), (4, 4, 4)))


def test_affinities_and_boundary_by_hand(spark):
    df = volume(spark, np.array([[[1, 1, 2, 0, 0]]]), "gt")
    got = neighbours.label_affinities(df).orderBy("x").collect()
    assert [r.gt_ax for r in got] == [0, 1, 0, 0, 0]
    bound = volume(spark, np.array([[[0, 3, 0]]]), "gt").orderBy("x").select(volumes.boundary()).collect()
    assert [r[0] for r in bound] == [1, 0, 1]


@pytest.mark.parametrize("size", [(2, 2, 2), (3, 4, 5), (32, 32, 32)])
def test_neighbours_do_not_depend_on_block_size(spark, size):
    rng = np.random.default_rng(0)
    array = rng.integers(0, 3, (5, 6, 7))
    df = volume(spark, array, "gt")
    near = neighbours.with_neighbours(df, ["gt"], sides=("lower", "upper"), size=size)
    for r in near.collect():
        at = (r.z, r.y, r.x)
        for axis, name in enumerate("zyx"):
            for side, step in (("lower", -1), ("upper", 1)):
                to = list(at)
                to[axis] += step
                inside = 0 <= to[axis] < array.shape[axis]
                want = int(array[tuple(to)]) if inside else None
                assert r[f"{side}_{name}_gt"] == want
    assert near.count() == array.size


def test_faces_match_brute_force(spark):
    rng = np.random.default_rng(1)
    frag = rng.integers(0, 4, (4, 5, 6))
    rows = [(*map(int, i), int(frag[i]), int(rng.integers(256)), int(rng.integers(256)), int(rng.integers(256))) for i in np.ndindex(frag.shape)]
    df = spark.createDataFrame(rows, "z bigint, y bigint, x bigint, frag bigint, az bigint, ay bigint, ax bigint")
    want = []
    for z, y, x, f, *aff in rows:
        for axis in range(3):
            to = [z, y, x]
            to[axis] -= 1
            if to[axis] >= 0:
                g = int(frag[tuple(to)])
                if f and g and f != g:
                    want.append((min(f, g), max(f, g), aff[axis]))
    got = [tuple(r) for r in rag.faces(df, size=(2, 3, 4)).collect()]
    assert sorted(got) == sorted(want)


def test_crop_inverts_pad(spark):
    array = np.random.default_rng(2).integers(1, 9, (3, 4, 5))
    padded = volumes.pad(volume(spark, array), "v", array.shape, (6, 5, 8))
    assert padded.count() == 6 * 5 * 8
    back = volumes.crop(padded, Box((1, 0, 1), (3, 4, 5)))
    assert np.array_equal(dense(back, "v", array.shape), array)


def test_stitch_matches_sequential_writes(spark):
    total, ref, stride = Box((0, 0, 0), (7, 5, 9)), (4, 3, 4), (3, 2, 4)
    df = volume(spark, np.zeros((7, 5, 9), dtype=int))
    got = volumes.stitch(volumes.scan_chunks(df, total, ref, stride), "chunk", "chunk")
    out = np.full((7, 5, 9), -1)
    starts = []
    for t, r, s in zip(total.shape, ref, stride):
        n = -(-(t - r) // s)
        starts.append([min(i * s, t - r) for i in range(n + 1)])
    number = 0
    for x, y, z in itertools.product(starts[2], starts[1], starts[0]):
        out[z:z + 4, y:y + 3, x:x + 4] = number
        number += 1
    assert np.array_equal(dense(got, "chunk", (7, 5, 9)), out)


def test_box_overlaps_match_brute_force(spark):
    rng = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            row = [i]
            for _ in range(3):
                a = rng.randrange(-20, 20)
                row += [a, a + rng.randrange(0, 12)]
            out.append(tuple(row))
        return out

    left, right = boxes(25), boxes(30)
    schema = "id bigint, z0 bigint, z1 bigint, y0 bigint, y1 bigint, x0 bigint, x1 bigint"
    got = grid.box_overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), (7, 5, 6)).collect()
    want = set()
    for a in left:
        for b in right:
            spans = [(max(a[i], b[i]), min(a[i + 1], b[i + 1])) for i in (1, 3, 5)]
            if all(h > lo for lo, h in spans):
                want.add((a[0], b[0], *itertools.chain(*spans)))
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_distance_by_hand_and_brute_force():
    line = np.array([0, 1, 1, 1, 0], dtype=bool)
    assert np.sqrt(kernels.squared_distance(line)).tolist() == [0, 1, 2, 1, 0]
    mask = np.random.default_rng(3).random((5, 6, 7)) < 0.8
    d = kernels.squared_distance(mask)
    outside = np.argwhere(~mask)
    for at in np.ndindex(mask.shape):
        assert d[at] == (((outside - at) ** 2).sum(axis=1).min() if mask[at] else 0)
    assert np.isinf(kernels.squared_distance(np.ones((2, 2, 2), dtype=bool))).all()


def test_max_filter_even_width():
    values = np.random.default_rng(4).integers(0, 99, (6, 7, 8)).astype(float)
    got = kernels.max_filter(values, 4)
    for at in np.ndindex(values.shape):
        window = tuple(slice(max(0, i - 2), i + 2) for i in at)
        assert got[at] == values[window].max()


def test_watershed_splits_two_blobs():
    mask = np.zeros((5, 5, 12), dtype=bool)
    mask[:, :, 0:5] = True
    mask[:, :, 7:12] = True
    mask[2, 2, 5:7] = True
    labels = kernels.fragments(mask, 5)
    assert (labels[~mask] == 0).all() and (labels[mask] > 0).all()
    assert labels[2, 2, 1] != labels[2, 2, 10]


def test_flood_grows_from_seeds_only():
    height = np.array([[0.0, 1.0, 2.0, 1.0, 0.0]])
    seeds = np.array([[1, 0, 0, 0, 2]])
    assert kernels.flood(height, seeds, np.ones((1, 5), dtype=bool)).tolist() == [[1, 1, 1, 2, 2]]
    inside = np.array([[True, True, False, True, True]])
    assert kernels.flood(height, seeds, inside).tolist() == [[1, 1, 0, 2, 2]]


def test_agglomeration_rescores_after_merge():
    # 1-2 merge first; their faces to 3 are then pooled: mean of (200, 0) = 100
    u = np.array([1, 1, 2])
    v = np.array([2, 3, 3])
    aff = np.array([250, 200, 0])
    merges = kernels.agglomerate(u, v, aff, kernels.mean_score)
    assert [(a, b) for _, a, b in merges] == [(1, 2), (1, 3)]
    assert merges[1][0] == pytest.approx(1 - 100 / 255)
    assert kernels.merge_levels(merges, [(1, 2), (2, 3), (1, 3)]) == [merges[0][0], merges[1][0], merges[1][0]]
    assert kernels.merge_levels(merges, [(1, 9)]) == [None]


def test_agglomeration_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(10):
        pairs = np.sort(rng.integers(1, 9, (60, 2)), axis=1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        aff = rng.integers(0, 256, len(pairs))
        merges = kernels.agglomerate(pairs[:, 0], pairs[:, 1], aff, kernels.mean_score)
        group = {i: i for i in range(1, 9)}
        for value, a, b in merges:
            pooled = {}
            for (p, q), f in zip(pairs, aff):
                k = tuple(sorted((group[p], group[q])))
                if k[0] != k[1]:
                    pooled.setdefault(k, []).append(f)
            best = min((round(1 - np.mean(f) / 255, 9), k) for k, f in pooled.items())
            assert (round(value, 9), (a, b)) == best
            group = {i: a if g == b else g for i, g in group.items()}


@pytest.mark.parametrize("size", [(3, 3, 3), (8, 8, 8)])
def test_label_volume_is_block_invariant(spark, size):
    mask = (np.random.default_rng(6).random((7, 8, 9)) < 0.4).astype(int)
    got = dense(blockops.label_volume(volume(spark, mask), "v", size, (8, 9)), "region", mask.shape)
    whole = kernels.label_regions(mask > 0)
    for label in range(1, whole.max() + 1):
        at = whole == label
        assert (got[at] == np.flatnonzero(at.ravel())[0]).all()


def test_watershed_ids_are_unique_per_block(spark):
    mask = (np.random.default_rng(7).random((8, 8, 8)) < 0.7).astype(int)
    df = volume(spark, mask)
    rows = blockops.watershed(df, "v", (4, 4, 4), (2, 2), (2, 2, 2), 3).collect()
    assert len(rows) == mask.size
    for r in rows:
        assert (r.fragment > 0) == bool(mask[r.z, r.y, r.x])
        if r.fragment:
            assert (r.fragment - 1) // 64 == ((r.z // 4) * 2 + r.y // 4) * 2 + r.x // 4


def test_signed_distance_sign(spark):
    array = np.zeros((3, 3, 9), dtype=int)
    array[:, :, 3:6] = 5
    out = blockops.signed_distmap(volume(spark, array), "v", (3, 3, 9), scale=1.0).collect()
    for r in out:
        want = min(abs(r.x - 2), abs(r.x - 6)) if 3 <= r.x < 6 else -min(abs(r.x - 3), abs(r.x - 5))
        assert r.distmap == pytest.approx(np.tanh(want))


def test_intensity_augment_is_seeded(spark):
    df = volume(spark, np.arange(60).reshape(3, 4, 5))
    a = volumes.intensity_augment(df, "v", 1).orderBy("z", "y", "x").collect()
    b = volumes.intensity_augment(df, "v", 1).orderBy("z", "y", "x").collect()
    c = volumes.intensity_augment(df, "v", 2).orderBy("z", "y", "x").collect()
    assert a == b and a != c


def test_halo_limits(spark):
    df = volume(spark, np.zeros((4, 4, 4), dtype=int))
    with pytest.raises(ValueError):
        grid.with_halo(df, (2, 2, 2), (3, 0, 0), (0, 0, 0))
    copies = grid.with_halo(df, (2, 2, 2), (1, 1, 1), (1, 1, 1))
    assert copies.where(F.col("own")).count() == 64


def test_apply_function(spark):
    df = volume(spark, np.arange(8).reshape(2, 2, 2))
    got = volumes.apply_function(df, "v", lambda s, by: np.sqrt(s) * by, "root", by=2.0).collect()
    assert all(r.root == pytest.approx(2 * r.v**0.5) for r in got)
