"""Block kernels against brute force."""

import numpy as np
import pytest

from voxelith.operators import kernels


def test_distances_and_steps():
    rng = np.random.default_rng(0)
    for shape in ((7,), (6, 5), (5, 6, 7), (1, 4, 9)):
        for share in (0.2, 0.8, 0.97, 1.0):
            mask = rng.random(shape) < share
            goals = np.argwhere(~mask)
            far, steps = kernels.nearest_outside(mask)
            assert np.array_equal(far, kernels.squared_distance(mask))
            for cell in np.argwhere(mask):
                if not len(goals):
                    assert np.isinf(far[tuple(cell)])
                    continue
                step = np.array([s[tuple(cell)] for s in steps])
                assert far[tuple(cell)] == ((goals - cell) ** 2).sum(axis=1).min() == (step**2).sum()
                assert not mask[tuple(cell + step)]


def by_hand(faces, score, first):
    """Merge the best contact, pool from scratch, until none is left."""
    pooled = {}
    for u, v, aff in faces:
        pooled.setdefault((u, v), []).append(aff)
    values = {pair: first(np.bincount(affs, minlength=256)) for pair, affs in pooled.items()}
    merges = []
    while values:
        value, (a, b) = min((s, pair) for pair, s in values.items())
        merges.append((value, a, b))
        grown = {}
        for (u, v), affs in pooled.items():
            pair = tuple(sorted(a if x == b else x for x in (u, v)))
            if pair[0] != pair[1]:
                grown.setdefault(pair, []).append((affs, values[u, v]))
        pooled = {pair: sum((p[0] for p in parts), []) for pair, parts in grown.items()}
        values = {
            pair: score(np.bincount(pooled[pair], minlength=256)) if len(parts) > 1 else parts[0][1] for pair, parts in grown.items()
        }
    return merges


@pytest.mark.parametrize("name", ["mean", "hist_quant_25", "hist_quant_75", "hist_quant_75_initmax", "hist_quant_10_initmax"])
def test_agglomeration(name):
    rng = np.random.default_rng(7)
    score, first = kernels.named_score(name)
    for _ in range(15):
        ends = np.sort(rng.integers(1, 9, (60, 2)), axis=1)
        ends = ends[ends[:, 0] < ends[:, 1]]
        aff = rng.integers(0, 256, len(ends))
        got = kernels.agglomerate(ends[:, 0], ends[:, 1], aff, score, first)
        assert got == by_hand([(*e, int(a)) for e, a in zip(ends.tolist(), aff)], score, first)


def test_initmax_begins_with_the_largest_affinity():
    u, v, aff = np.array([1, 1, 2, 2]), np.array([2, 2, 3, 3]), np.array([0, 255, 100, 100])
    plain = kernels.agglomerate(u, v, aff, *kernels.named_score("hist_quant_25"))
    initmax = kernels.agglomerate(u, v, aff, *kernels.named_score("hist_quant_25_initmax"))
    assert [m[1:] for m in plain] == [(2, 3), (1, 2)]
    assert [m[1:] for m in initmax] == [(1, 2), (1, 3)] and initmax[0][0] == 0.0


def flooded_by_hand(height, seeds, mask):
    """Cell by cell: at each height, rounds of all free cells next to a label."""
    labels = np.where(mask, seeds, 0)
    cells = [tuple(c) for c in np.argwhere(mask)]

    def near(cell):
        for axis in range(mask.ndim):
            for step in (-1, 1):
                to = list(cell)
                to[axis] += step
                if 0 <= to[axis] < mask.shape[axis]:
                    yield tuple(to)

    for now in np.unique(height[mask]):
        while True:
            taken = {}
            for cell in cells:
                found = [labels[n] for n in near(cell) if labels[n]] if not labels[cell] and height[cell] <= now else []
                if found:
                    taken[cell] = min(found)
            if not taken:
                break
            for cell, label in taken.items():
                labels[cell] = label
    return labels


def test_flood_is_level_synchronous():
    rng = np.random.default_rng(5)
    for shape in ((30,), (9, 8), (5, 6, 7), (1, 1)):
        for _ in range(15):
            height, mask = rng.integers(0, 4, shape).astype(float), rng.random(shape) < 0.8
            seeds = np.where(rng.random(shape) < 0.1, rng.integers(1, 9, shape), 0)
            before = (height.copy(), seeds.copy(), mask.copy())
            assert np.array_equal(kernels.flood(height, seeds, mask), flooded_by_hand(height, seeds, mask))
            assert all(np.array_equal(a, b) for a, b in zip(before, (height, seeds, mask)))


def test_regions_are_numbered_in_scan_order():
    rng = np.random.default_rng(6)
    for shape in ((12,), (7, 9), (4, 5, 6)):
        same = rng.random(shape) < 0.6
        got = kernels.label_regions(same)
        assert np.array_equal(got > 0, same)
        firsts = [int(np.flatnonzero(got.ravel() == k)[0]) for k in range(1, got.max() + 1)]
        assert firsts == sorted(firsts)
        want = flooded_by_hand(np.zeros(shape), np.where(same, np.arange(1, same.size + 1).reshape(shape), 0), same)
        for axis in range(same.ndim):  # neighbours inside share a region
            a, b = np.moveaxis(got, axis, 0)[:-1], np.moveaxis(got, axis, 0)[1:]
            assert (a == b)[(a > 0) & (b > 0)].all()
        assert len(np.unique(want[same])) >= got.max()
    snake = np.zeros((101, 101), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert kernels.label_regions(snake).max() == 1
