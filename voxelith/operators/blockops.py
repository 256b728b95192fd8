"""Block operators: Spark groups voxels (with halo) by block, a kernel sees one dense block.

A block's size is fixed by the caller, so a task never holds more than
``prod(size + 2 * context)`` cells however large the volume is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators import components, kernels
from voxelith.operators.grid import AXES, BLOCK, Box, Layers, block_of, in_layers, near_layers, with_halo
from voxelith.operators.neighbours import with_neighbours
from voxelith.session import cut_lineage, ship_package

Size = tuple[int, int, int]
Kernel = Callable[[dict[str, np.ndarray], tuple[int, int, int]], dict[str, np.ndarray]]


def map_blocks(
    voxels: DataFrame,
    inputs: list[str],
    outputs: dict[str, str],
    kernel: Kernel,
    size: Size,
    context: Size = (0, 0, 0),
    extent: Box | None = None,
    carry: tuple[str, ...] = (),
    layers: Layers | None = None,
) -> DataFrame:
    """Run ``kernel`` on every block and return its outputs at the block's own voxels.

    The kernel gets one dense array per input (absent cells are 0) and the block position and
    returns one array per output, all over the read box. Columns in ``carry`` come along unchanged,
    so that nothing has to be joined back. ``layers`` runs only those blocks, on what they read.
    """
    ship_package(voxels.sparkSession)
    shape = tuple(s + 2 * c for s, c in zip(size, context))
    voxels = voxels.where(near_layers(size[0], context[0], layers))
    halo = with_halo(voxels.select(*AXES, *inputs, *carry), size, context, context, extent).where(in_layers(layers))
    kinds = dict(voxels.dtypes)
    schema = ", ".join([f"{a} bigint" for a in AXES] + [f"{c} {kinds[c]}" for c in carry] + [f"{n} {t}" for n, t in outputs.items()])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        origin = [int(k) * s - c for k, s, c in zip(key, size, context)]
        index = tuple(pdf[a].to_numpy() - o for a, o in zip(AXES, origin))
        arrays = {}
        for name in inputs:
            arrays[name] = np.zeros(shape, dtype=pdf[name].dtype)
            arrays[name][index] = pdf[name].to_numpy()
        own = pdf["own"].to_numpy()
        at = tuple(i[own] for i in index)
        result = kernel(arrays, tuple(int(k) for k in key)) if own.any() else {}
        frame = {a: pdf[a].to_numpy()[own] for a in (*AXES, *carry)}
        for name in outputs:
            frame[name] = result[name][at] if own.any() else []
        return pd.DataFrame(frame)

    return halo.groupBy(*BLOCK).applyInPandas(run, schema)


def squared_edt(voxels: DataFrame, mask: str, size: Size, context: Size = (0, 0, 0)) -> DataFrame:
    """Squared distance to the nearest cell outside the mask, inside the read box; null if none."""

    def kernel(arrays, _):
        d = kernels.squared_distance(arrays[mask] > 0)
        return {"dist2": np.where(np.isfinite(d), d, np.nan)}

    out = map_blocks(voxels, [mask], {"dist2": "double"}, kernel, size, context)
    return out.select(*AXES, F.when(~F.isnan("dist2"), F.col("dist2")).cast("bigint").alias("dist2"))


def signed_distmap(
    voxels: DataFrame, label: str, size: Size, context: Size = (0, 0, 0), scale: float = 50.0
) -> DataFrame:
    """``tanh(signed distance / scale)``: positive inside labels, negative in the background."""

    def kernel(arrays, _):
        return {"distmap": np.tanh(kernels.signed_distance(arrays[label] > 0) / scale)}

    return map_blocks(voxels, [label], {"distmap": "double"}, kernel, size, context)


def vector_distmap(voxels: DataFrame, label: str, size: Size, context: Size = (0, 0, 0)) -> DataFrame:
    """Offset (dz, dy, dx) from each foreground voxel to its nearest outside cell.

    Ties go to the shortest step along x, then y, then z, the lower side first; null where the
    read box has no outside cell.
    """

    def kernel(arrays, _):
        far, steps = kernels.nearest_outside(arrays[label] > 0)
        return {n: np.where(np.isfinite(far), s, np.nan) for n, s in zip(("dz", "dy", "dx"), steps)}

    raw = map_blocks(voxels, [label], {"dz": "double", "dy": "double", "dx": "double"}, kernel, size, context)
    return raw.select(*AXES, *[F.when(~F.isnan(c), F.col(c)).cast("bigint").alias(c) for c in ("dz", "dy", "dx")])


def watershed(
    voxels: DataFrame,
    mask: str,
    size: Size,
    grid_yx: tuple[int, int],
    context: Size = (0, 0, 0),
    min_seed_distance: int = 10,
    per_section: bool = False,
    extent: Box | None = None,
    carry: tuple[str, ...] = (),
    layers: Layers | None = None,
) -> DataFrame:
    """Fragments of a mask: ``z, y, x, fragment`` with volume-wide unique ids, 0 outside.

    Flooding sees the read box; the part inside the write box is renumbered 1.. and an id is
    block number x voxels per block + that number. ``per_section`` floods every z section alone.
    """
    per_block = int(np.prod(size))
    ny, nx = grid_yx
    write = tuple(slice(c, c + s) for s, c in zip(size, context))

    def kernel(arrays, key):
        inside = arrays[mask] > 0
        if per_section:
            local, used = np.zeros(inside.shape, dtype=np.int64), 0
            for z in range(inside.shape[0]):
                section = kernels.fragments(inside[z], min_seed_distance)
                local[z] = np.where(section > 0, section + used, 0)
                used += int(section.max())
        else:
            local = kernels.fragments(inside, min_seed_distance)
        out = np.zeros_like(local)
        ids = np.unique(local[write])
        ids = ids[ids > 0]
        block = (key[0] * ny + key[1]) * nx + key[2]
        known = np.isin(local, ids) & (local > 0)
        out[known] = np.searchsorted(ids, local[known]) + 1 + block * per_block
        return {"fragment": out}

    return map_blocks(voxels, [mask], {"fragment": "bigint"}, kernel, size, context, extent, carry, layers)


def label_volume(voxels: DataFrame, mask: str, size: Size, extent_yx: tuple[int, int]) -> DataFrame:
    """Face-connected regions of a mask over the whole volume: ``z, y, x, region``.

    Regions are numbered inside each block first; only pairs of touching local regions across
    block faces enter the distributed component search. A region is named after its smallest
    voxel index, so the result does not depend on the block size.
    """
    ey, ex = extent_yx

    def kernel(arrays, key):
        local = kernels.label_regions(arrays[mask] > 0)
        z, y, x = np.indices(local.shape)
        index = ((z + key[0] * size[0]) * ey + y + key[1] * size[1]) * ex + x + key[2] * size[2]
        first = np.full(local.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, local.ravel(), index.ravel())
        return {"region": np.where(local > 0, first[local], -1)}

    inside = map_blocks(voxels.where(F.col(mask) > 0), [mask], {"region": "bigint"}, kernel, size)
    inside = cut_lineage(inside)
    near = with_neighbours(inside, ["region"], size=size)
    pairs = near.select(
        F.col("region").alias("u"), F.explode(F.array(*[F.col(f"lower_{a}_region") for a in AXES])).alias("v")
    ).where("v IS NOT NULL AND u <> v").distinct()
    stars = components.star_forest(pairs)
    return inside.join(stars, F.col("region") == F.col("child"), "left").select(
        *AXES, F.coalesce("parent", "region").alias("region")
    )


def _contacts(voxels: DataFrame, label: str, size: Size, context: Size, extent: Box | None, layers: Layers | None = None) -> DataFrame:
    """``bz, by, bx, u, v, aff, n, first``: faces between labels in each block's read box, counted.

    A face lies in a read box with both its voxels; the block of its upper voxel owns it and sees it
    even without context. ``first`` is the place in the block of the pair's first own face, null if
    the block owns none.
    Faces are found in one shuffle and counted before the next.
    """
    # a face needs the voxel below
    voxels = voxels.where(near_layers(size[0], context[0] + 1, layers))
    near = with_neighbours(voxels.select(*AXES, label, "az", "ay", "ax"), [label], size=size)
    face = [
        F.when(
            (F.col(label) != 0) & (F.col(f"lower_{a}_{label}") != 0) & (F.col(label) != F.col(f"lower_{a}_{label}")),
            F.struct(
                F.lit(i).alias("axis"), F.least(label, f"lower_{a}_{label}").alias("u"), F.greatest(label, f"lower_{a}_{label}").alias("v"),
                F.col(aff).alias("aff"),
            ),
        )
        for i, (a, aff) in enumerate(zip(AXES, ("az", "ay", "ax")))
    ]
    faces = near.select(*AXES, F.explode(F.array_compact(F.array(*face))).alias("f")).select(*AXES, "f.*")
    own = F.lit(True)
    for i, (a, s, c) in enumerate(zip(AXES, size, context)):
        home = F.floor(F.col(a) / F.lit(s)).cast("bigint")
        rest = F.col(a) - home * F.lit(s)
        down, up = rest < c, rest >= s - c + (F.col("axis") == i).cast("int")
        if extent is not None:
            down, up = down & (home > extent.begin[i] // s), up & (home < (extent.end[i] - 1) // s)
        options = [home, F.when(down, home - 1), F.when(up, home + 1)] if c else [home]
        faces = faces.select("*", F.explode(F.array_compact(F.array(*options))).alias(BLOCK[i]))
        own = own & (home == F.col(BLOCK[i]))
    inside = F.lit(0).cast("bigint")
    for a, s in zip(AXES, size):
        inside = inside * s + F.pmod(F.col(a), F.lit(s))
    place = F.when(own, inside * 3 + F.col("axis"))
    return faces.where(in_layers(layers)).groupBy(*BLOCK, "u", "v", "aff").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def merge_trees(
    voxels: DataFrame, label: str, size: Size, merge_function: str = "hist_quant_75", context: Size = (0, 0, 0), extent: Box | None = None,
    layers: Layers | None = None,
) -> DataFrame:
    """Hierarchical agglomeration of each block's read box, up to the end: one tree a block.

    ``bz, by, bx, step, u, v, merge_score, level, first``. Rows with a ``step`` are merges of region
    ``v`` into ``u``; ``level`` is the largest score so far, so all merges up to a level are those
    that an agglomeration with that threshold would make. Rows without one are pairs of touching
    labels with the score of the merge that joins them and their first own face.
    """
    if any(c > s for c, s in zip(context, size)):
        raise ValueError("context may not exceed the block size")
    ship_package(voxels.sparkSession)
    score, first = kernels.named_score(merge_function)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merges = kernels.agglomerate(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["aff"].to_numpy(), score, first, pdf["n"].to_numpy())
        pairs, at = np.unique(pdf[["u", "v"]].to_numpy(), axis=0, return_inverse=True)
        none = 3 * size[0] * size[1] * size[2]  # behind every face
        own = np.full(len(pairs), none)
        np.minimum.at(own, at.ravel(), pdf["first"].fillna(none).astype("int64").to_numpy())
        levels = kernels.merge_levels(merges, [tuple(p) for p in pairs.tolist()])
        edges = pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1], "merge_score": levels, "first": own})
        tree = pd.DataFrame(merges, columns=["merge_score", "u", "v"])
        tree["step"], tree["level"], tree["first"] = np.arange(len(tree)), tree["merge_score"].cummax(), none
        out = pd.concat([tree, edges])
        out["step"], out["first"] = out["step"].astype("Int64"), out["first"].astype("Int64").mask(out["first"] == none)
        for name, k in zip(BLOCK, key):
            out[name] = int(k)
        return out[[*BLOCK, "step", "u", "v", "merge_score", "level", "first"]]

    schema = "bz bigint, by bigint, bx bigint, step bigint, u bigint, v bigint, merge_score double, level double, first bigint"
    trees = _contacts(voxels, label, size, context, extent, layers).groupBy(*BLOCK).applyInPandas(run, schema)
    parts = (("z", 3 * size[1] * size[2], size[0]), ("y", 3 * size[2], size[1]), ("x", 3, size[2]))
    place = [(F.col(b) * s + F.floor(F.col("first") / unit) % s).alias(a) for b, (a, unit, s) in zip(BLOCK, parts)]
    return trees.withColumn("first", F.when(F.col("first").isNotNull(), F.struct(*place, (F.col("first") % 3).alias("axis"))))


def owned_edges(trees: DataFrame) -> DataFrame:
    """``u, v, merge_score`` of every touching pair, as seen by the block that owns its first face."""
    pairs = trees.where("step IS NULL AND first IS NOT NULL")
    return pairs.groupBy("u", "v").agg(F.min_by("merge_score", "first").alias("merge_score"))


def agglomerated_edges(
    voxels: DataFrame, label: str, size: Size, merge_function: str = "hist_quant_75", context: Size = (0, 0, 0), extent: Box | None = None,
) -> DataFrame:
    """Score RAG edges by hierarchical agglomeration of blocks with context: ``u, v, merge_score``.

    The score is that at which the two fragments first end up in one region, where regions are
    re-scored after every merge.
    """
    return owned_edges(merge_trees(voxels, label, size, merge_function, context, extent))


def segmentations(trees: DataFrame, voxels: DataFrame, label: str, size: Size, thresholds: list[int], scale: float = 100.0) -> DataFrame:
    """``bz, by, bx, threshold, fragment, segment`` of the labels in each block, at whole thresholds over ``scale``.

    All thresholds are cuts of the one tree; a segment is named after its smallest fragment in the
    read box.
    """
    ship_package(voxels.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["u", "v"]].to_numpy())
        parent, level = np.arange(len(ids)), np.full(len(ids), np.inf)
        absorbed = np.searchsorted(ids, pdf["v"].to_numpy())
        parent[absorbed], level[absorbed] = np.searchsorted(ids, pdf["u"].to_numpy()), pdf["level"].to_numpy()
        cuts = [pd.DataFrame({"threshold": t, "fragment": ids, "segment": ids[kernels.cut_tree(parent, level, t / scale)]}) for t in thresholds]
        out = pd.concat(cuts)
        for name, k in zip(BLOCK, key):
            out[name] = int(k)
        return out[[*BLOCK, "threshold", "fragment", "segment"]]

    merges = trees.where("step IS NOT NULL").select(*BLOCK, "u", "v", "level")
    cut = merges.groupBy(*BLOCK).applyInPandas(run, "bz bigint, by bigint, bx bigint, threshold int, fragment bigint, segment bigint")
    present = voxels.where(F.col(label) != 0).select(*block_of(size), F.col(label).alias("fragment")).distinct()
    each = present.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    keys = [*BLOCK, "threshold", "fragment"]
    return each.join(cut, keys, "left").select(*keys, F.coalesce("segment", "fragment").alias("segment"))


def epsilon_fragments(voxels: DataFrame, label: str, size: Size, epsilon: float) -> DataFrame:
    """Join fragments inside each block up to a small first-quartile score: ``fragment, segment``."""
    pairs = merge_trees(voxels, label, size, "hist_quant_25").where("step IS NULL")
    low = pairs.where(F.col("merge_score") <= F.lit(epsilon))
    nodes = voxels.where(F.col(label) != 0).select(F.col(label).alias("id")).distinct()
    return components.connected_components(nodes, low.select("u", "v")).toDF("fragment", "segment")


def gaussian(sigma: float, reach: int) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def shape_descriptors(
    voxels: DataFrame, label: str, size: Size, sigma: float = 2.0, reach: int = 6, extent: Box | None = None
) -> DataFrame:
    """Ten local shape descriptors per voxel; all are 0 for background voxels.

    Mean offset (3), variance (3) and correlation (3) of the voxel's own label under a
    truncated gaussian, mapped to about [0, 1], and its size (1). ``reach`` is the halo.
    """
    kernel_1d = gaussian(sigma, reach)
    names = ["off_z", "off_y", "off_x", "var_z", "var_y", "var_x", "cov_zy", "cov_zx", "cov_yx", "size"]

    def kernel(arrays, _):
        labels = arrays[label]
        m = kernels.label_moments(labels, [kernel_1d] * 3, labels != 0)
        n = np.where(labels != 0, m["n"], 1.0)
        at = np.indices(labels.shape)
        mean = {a: m[a] / n for a in AXES}
        out = {f"off_{a}": (mean[a] - at[i]) / sigma * 0.5 + 0.5 for i, a in enumerate(AXES)}
        var = {a: np.maximum(m[a + a] / n - mean[a] ** 2, 1e-3) for a in AXES}
        out |= {f"var_{a}": var[a] / sigma**2 for a in AXES}
        for pair in ("zy", "zx", "yx"):
            cov = m[pair] / n - mean[pair[0]] * mean[pair[1]]
            out[f"cov_{pair}"] = cov / np.sqrt(var[pair[0]] * var[pair[1]]) * 0.5 + 0.5
        out["size"] = m["n"]
        return {k: np.where(labels != 0, np.clip(v, 0.0, 1.0), 0.0) for k, v in out.items()}

    return map_blocks(
        voxels, [label], {n: "double" for n in names}, kernel, size, (reach,) * 3, extent
    )
