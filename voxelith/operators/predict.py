"""Pluggable model application: to voxels in Arrow batches, or to dense blocks with context."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from voxelith.operators.blockops import map_blocks
from voxelith.operators.grid import Box, context_of
from voxelith.session import ship_package

Model = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class BlockModel:
    """A model that sees a neighbourhood: ``apply`` maps (channels, z, y, x) to the same.

    Its output covers the whole input, or only what is left after ``context`` on every side.
    """

    apply: Model
    context: tuple[int, int, int]


def load_symbol(path: str) -> Callable:
    """Resolve ``package.module.name``; models, losses and merge functions are named this way."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def linear_model(scale: list[float], shift: list[float]) -> Model:
    """Deterministic one-channel-in linear model for dry runs without weights."""

    def apply(batch: np.ndarray) -> np.ndarray:
        return batch[:, :1] * np.asarray(scale) + np.asarray(shift)

    return apply


def predict_batches(df: DataFrame, model: Model, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Apply a voxel-wise model to ``inputs`` and append ``outputs`` as doubles.

    ``model`` maps (rows, inputs) to (rows, outputs). It sees one Arrow batch at a time, so
    memory is bounded by the batch size whatever the partition holds.
    """
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in outputs]])

    def run(batches):
        for pdf in batches:
            out = model(pdf[inputs].to_numpy(dtype="float64"))
            yield pdf.assign(**{name: out[:, i] for i, name in enumerate(outputs)})

    return df.mapInPandas(run, schema)


def box_mean_model(reach: int = 1) -> BlockModel:
    """Mean over the cube around each voxel: the smallest model with a neighbourhood."""

    def apply(block: np.ndarray) -> np.ndarray:
        out = block
        for axis in (1, 2, 3):
            windows = np.lib.stride_tricks.sliding_window_view(out, 2 * reach + 1, axis=axis)
            out = windows.sum(axis=-1)
        return out / (2 * reach + 1) ** 3

    return BlockModel(apply, (reach, reach, reach))


def predict_blocks(
    voxels: DataFrame, model: BlockModel, inputs: list[str], outputs: list[str], size: tuple[int, int, int], extent: Box | None = None
) -> DataFrame:
    """Apply a block model: ``z, y, x`` and the ``outputs`` as doubles.

    A task holds one block of ``size`` with the model's context; absent cells are 0.
    """

    def kernel(arrays, _):
        block = np.stack([arrays[n].astype("float64") for n in inputs])
        out = model.apply(block)
        missing = context_of(block.shape[1:], out.shape[1:])
        padded = np.pad(out, [(0, 0), *[(m, m) for m in missing]])
        return {name: padded[i] for i, name in enumerate(outputs)}

    return map_blocks(voxels, inputs, {n: "double" for n in outputs}, kernel, size, model.context, extent)
