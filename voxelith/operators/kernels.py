"""Dense per-block helpers on small numpy arrays. Spark decides what a block is."""

from __future__ import annotations

import heapq

import numpy as np

FAR = np.inf


def _passes(mask: np.ndarray, goals: list[np.ndarray] | None) -> np.ndarray:
    """Squared distance of every True cell to the nearest False cell, one axis after the other.

    A pass takes, for growing offsets along its axis, the previous pass's value at the offset plus
    the squared offset. No offset beyond the largest distance left can improve anything, so a pass
    ends there; its arrays are as large as the block. ``goals``, if given, receives the step to the
    nearest cell along each axis.
    """
    d = np.where(mask, FAR, 0.0)
    for axis in range(mask.ndim):
        before, out = d, d.copy()
        source = [g.copy() for g in goals] if goals is not None else []
        for k in range(1, mask.shape[axis]):
            if k * k >= out.max(initial=0.0):
                break
            for low in (True, False):  # the cell at the offset lies below, then above
                to, at = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
                to[axis], at[axis] = (slice(k, None), slice(None, -k)) if low else (slice(None, -k), slice(k, None))
                to, at = tuple(to), tuple(at)
                value = before[at] + k * k
                better = value < out[to]
                out[to] = np.where(better, value, out[to])
                if goals is not None:
                    for i, g in enumerate(goals):
                        step = (-k if low else k) if i == axis else 0
                        g[to] = np.where(better, source[i][at] + step, g[to])
        d = out
    return d


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every True cell to the nearest False cell.

    Infinite where the array has no False cell.
    """
    return _passes(mask, None)


def nearest_outside(mask: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Squared distance and the step along each axis to the nearest False cell.

    Of equally near cells the one with the shortest step along the last axis is taken, then along
    the one before, the lower side first.
    """
    steps = [np.zeros(mask.shape, dtype=np.int64) for _ in mask.shape]
    return _passes(mask, steps), steps


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """Distance to the outside where inside, minus the distance to the inside where outside."""
    inner, outer = np.sqrt(squared_distance(mask)), np.sqrt(squared_distance(~mask))
    return np.where(mask, inner, -outer)


def max_filter(values: np.ndarray, width: int) -> np.ndarray:
    """Cubic maximum filter; an even width reaches one cell further down than up."""
    before, after = width // 2, (width - 1) // 2
    out = values
    for axis in range(values.ndim):
        padded = np.pad(out, [(before, after) if a == axis else (0, 0) for a in range(values.ndim)], constant_values=-FAR)
        windows = np.lib.stride_tricks.sliding_window_view(padded, width, axis=axis)
        out = windows.max(axis=-1)
    return out


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the components of index pairs; ``label`` maps each index to its smallest member."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def label_regions(same: np.ndarray) -> np.ndarray:
    """Face-connected regions of a boolean array, numbered 1.. in scan order; 0 outside."""
    index = np.arange(same.size).reshape(same.shape)
    low, high = [], []
    for axis in range(same.ndim):
        below, above = [slice(None)] * same.ndim, [slice(None)] * same.ndim
        below[axis], above[axis] = slice(None, -1), slice(1, None)
        both = same[tuple(below)] & same[tuple(above)]
        low.append(index[tuple(below)][both])
        high.append(index[tuple(above)][both])
    first = unite(np.arange(same.size), np.concatenate(low), np.concatenate(high)).reshape(same.shape)
    out = np.zeros(same.shape, np.int64)
    out[same] = np.unique(first[same], return_inverse=True)[1] + 1
    return out


def flood(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeded flooding from low to high, inside ``mask``, over faces.

    The water rises from one height that occurs to the next. At each height all free cells no
    higher, next to a labelled one, are taken together, in rounds until none is left; a cell takes
    the smallest label among its labelled neighbours. So the result depends on nothing but the
    three arrays. A round looks only at the neighbours of the cells taken in the round before.
    """
    # a border of outside cells spares the bounds test; flat indices make a step one addition
    shape = tuple(n + 2 for n in mask.shape)
    free = np.pad(mask & (seeds == 0), 1).ravel()
    labels = np.pad(np.where(mask, seeds, 0), 1).ravel()
    level = np.pad(height, 1).ravel()
    strides = np.array([int(np.prod(shape[a + 1:])) for a in range(mask.ndim)])
    steps = np.concatenate([-strides, strides])
    none = np.iinfo(labels.dtype).max
    cells = np.flatnonzero(free)
    cells = cells[np.argsort(level[cells], kind="stable")]
    for front in np.split(cells, np.flatnonzero(np.diff(level[cells])) + 1) if len(cells) else []:
        now = level[front[0]]
        front = front[free[front]]
        while len(front):
            near = labels[front[:, None] + steps]
            least = np.where(near > 0, near, none).min(axis=1)
            taken = front[least < none]
            labels[taken] = least[least < none]
            free[taken] = False
            front = (taken[:, None] + steps).ravel()
            front = np.unique(front[free[front] & (level[front] <= now)])
    inner = tuple(slice(1, -1) for _ in mask.shape)
    return labels.reshape(shape)[inner]


def fragments(mask: np.ndarray, min_seed_distance: int = 10) -> np.ndarray:
    """Watershed of a foreground mask on its distance map, seeded at local maxima."""
    far = squared_distance(mask)
    seeds = label_regions(max_filter(far, min_seed_distance) == far)
    return flood(-far, seeds, mask)


def agglomerate(u: np.ndarray, v: np.ndarray, aff: np.ndarray, score, first=None, count=1) -> list[tuple[float, int, int]]:
    """Merge regions from the lowest score up, re-scoring the edges of a merged region.

    ``u, v, aff`` list the faces of a block, ``aff`` in 0..255, or ``count`` faces each; ``score`` maps a 256-bin
    histogram to a number, ``first`` (if given) does so until a contact is pooled with another.
    Returns merges ``(score, kept, absorbed)`` in order; the kept region
    is the one with the smaller id.
    """
    pairs, contact = np.unique(np.stack([u, v], axis=1), axis=0, return_inverse=True)
    table = np.zeros((len(pairs), 256), dtype=np.int64)
    np.add.at(table, (contact.ravel(), aff.astype(np.int64)), count)
    counts = {(int(a), int(b)): hist for (a, b), hist in zip(pairs.tolist(), table)}
    # near[a][b] is near[b][a]: the pooled histogram of the contact and its score
    near: dict[int, dict[int, tuple[np.ndarray, float]]] = {}
    queue = []
    for (a, b), hist in counts.items():
        value = (first or score)(hist)
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = (hist, value)
        queue.append((value, a, b))
    heapq.heapify(queue)
    merges = []
    while queue:
        value, a, b = heapq.heappop(queue)
        contact = near.get(a, {}).get(b)
        if contact is None or contact[1] != value:
            continue  # an end was absorbed or the contact was re-scored since it was queued
        merges.append((value, a, b))
        del near[a][b], near[b][a]
        for c, moved in near.pop(b).items():
            del near[c][b]
            if c in near[a]:
                hist = near[a][c][0] + moved[0]
                moved = (hist, score(hist))
            near[a][c] = near[c][a] = moved
            heapq.heappush(queue, (moved[1], min(a, c), max(a, c)))
    return merges


def mean_score(hist: np.ndarray) -> float:
    return 1.0 - float(hist @ np.arange(256)) / float(hist.sum()) / 255.0


def quantile_score(q: int):
    """Score by the smallest bin at which the cumulative count reaches ``q`` percent."""

    def score(hist: np.ndarray) -> float:
        cumulative = np.cumsum(hist)
        return 1.0 - float(np.searchsorted(cumulative * 100, q * cumulative[-1])) / 255.0

    return score


def largest_score(hist: np.ndarray) -> float:
    return 1.0 - float(np.flatnonzero(hist)[-1]) / 255.0


def named_score(name: str):
    """Histogram scores by merge-function name: of pooled contacts, and of contacts before that.

    The ``_initmax`` functions begin with the largest affinity of a contact.
    """
    if name == "mean":
        return mean_score, mean_score
    score = quantile_score(int(name.removesuffix("_initmax").rsplit("_", 1)[1]))
    return score, largest_score if name.endswith("_initmax") else score


def merge_levels(merges: list[tuple[float, int, int]], pairs: list[tuple[int, int]]) -> list[float | None]:
    """Score at which the two ends of each pair first share a region; None if they never do."""
    parent: dict[int, tuple[int, int]] = {}
    for step, (_, kept, absorbed) in enumerate(merges):
        parent[absorbed] = (kept, step)

    def climb(node: int) -> list[tuple[int, int]]:
        path = [(node, -1)]
        while path[-1][0] in parent:
            path.append(parent[path[-1][0]])
        return path

    out = []
    for a, b in pairs:
        reached = {}
        worst = -1
        for node, step in climb(a):
            worst = max(worst, step)
            reached[node] = worst
        worst, level = -1, None
        for node, step in climb(b):
            worst = max(worst, step)
            if node in reached:
                level = merges[max(worst, reached[node])][0]
                break
        out.append(level)
    return out


def cut_tree(parent: np.ndarray, level: np.ndarray, threshold: float) -> np.ndarray:
    """Highest ancestor of every node that is reached by merges up to ``threshold``.

    ``parent`` holds indices, a root's own; ``level`` is that of the merge with the parent and
    doesn't fall on the way up.
    """
    root = np.where(level <= threshold, parent, np.arange(len(parent)))
    while True:
        further = root[root]
        if np.array_equal(further, root):
            return root
        root = further


def label_moments(labels: np.ndarray, kernels: list[np.ndarray], wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted count, mean and second moments of each cell's own label around it.

    ``kernels`` holds one symmetric weight vector per axis. Coordinates are array indices.
    ``wanted`` marks the cells of the labels to process.
    """
    grids = np.meshgrid(*[np.arange(n, dtype="float64") for n in labels.shape], indexing="ij")
    names = ["n", "z", "y", "x", "zz", "yy", "xx", "zy", "zx", "yx"]
    factors = {"n": np.ones(labels.shape), "z": grids[0], "y": grids[1], "x": grids[2]}
    for name in names[4:]:
        factors[name] = factors[name[0]] * factors[name[1]]
    out = {name: np.zeros(labels.shape) for name in names}
    ids, inverse = np.unique(np.where(wanted, labels, 0), return_inverse=True)
    at = np.indices(labels.shape).reshape(3, -1)
    low = np.full((3, len(ids)), max(labels.shape))
    high = np.zeros((3, len(ids)), dtype=int)
    for axis in range(3):
        np.minimum.at(low[axis], inverse.ravel(), at[axis])
        np.maximum.at(high[axis], inverse.ravel(), at[axis] + 1)
    for k, label in enumerate(ids):
        if label == 0:
            continue
        # a label has no cells outside its bounding box, so zeros around the box are exact
        box = tuple(slice(low[axis, k], high[axis, k]) for axis in range(3))
        own = labels[box] == label
        fields = np.stack([np.where(own, factors[name][box], 0.0) for name in names])
        for axis, kernel in enumerate(kernels):
            n, reach = fields.shape[axis + 1], len(kernel) // 2
            gap = np.arange(n)[:, None] - np.arange(n)[None, :]
            band = np.where(abs(gap) <= reach, kernel[np.clip(gap + reach, 0, 2 * reach)], 0.0)
            fields = np.moveaxis(np.tensordot(fields, band, axes=([axis + 1], [0])), -1, axis + 1)
        for name, field in zip(names, fields):
            out[name][box][own] = field[own]
    return out
