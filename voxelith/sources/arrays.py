"""Chunked arrays (zarr v2 and N5) as a Spark data source that reads and writes chunks.

    arrays.register(spark)
    spark.read.format("chunked_array").load(path).where("z >= 10 AND z < 20")
    arrays.write_array(voxels, "v", path, shape, chunk)

Rows are ``[c,] z, y, x, v``. Partitions are runs of chunks. Bounds on the axes are taken from the
pushed filters, so chunks outside a box are never opened and cells outside it never become rows.

A write fills whole chunks. Each is written under a temporary name and then moved to its own, so a
repeated or a second attempt at a task replaces it by the same bytes; the metadata, without which
there is no array, follows when all tasks are done. In an array that exists, cells that no row
names keep their values.

Defined results: a chunk without a file holds the fill value; a null or missing value is the fill
value; a null axis, a cell outside the shape, two rows of one cell and a value that the element
type can't hold are errors. Files are opened with the Arrow file systems (local, HDFS, object
stores), not with Spark's: ``volumes.read_zarr`` reads any store that Spark reads.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

from voxelith.session import ship_package

NAME = "chunked_array"
ROWS = 1 << 16  # of a batch
CELLS = 1 << 24  # of a partition, unless there would be too many partitions
PARTITIONS = 100_000
BEGUN = ".begun"  # marks a folder whose array isn't finished: the next write may clear it
METADATA = {"zarr": ".zarray", "n5": "attributes.json"}


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The Arrow file system of a path and the path in it; ``file:`` may have any number of slashes."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        return pyarrow.fs.LocalFileSystem(), posixpath.abspath(local)
    return pyarrow.fs.FileSystem.from_uri(local)


def read_bytes(fs: pyarrow.fs.FileSystem, path: str) -> bytes | None:
    """A file's content, None if there is no such file."""
    try:
        with fs.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _replace(fs: pyarrow.fs.FileSystem, source: str, target: str) -> None:
    try:
        fs.move(source, target)
    except OSError:  # stores whose rename doesn't replace
        fs.delete_file(target)
        fs.move(source, target)


def _compress(data: bytes, kind: str | None) -> bytes:
    if kind is None:
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31 if kind == "gzip" else 15)
    return packer.compress(data) + packer.flush()


def _decompress(data: bytes, kind: str | None) -> bytes:
    if kind is None:
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zlib.decompress(data, wbits=47)


@dataclass(frozen=True)
class Layout:
    """Shape, chunks and encoding of one array, axes slowest first."""

    kind: str
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: str
    compressor: str | None = None
    order: str = "C"
    separator: str = "."
    fill: float | int = 0

    def __post_init__(self):
        if self.kind not in METADATA:
            raise ValueError(f"unknown array format {self.kind!r}")
        if self.compressor not in (None, "zlib", "gzip", "zstd"):
            raise ValueError(f"unsupported compressor {self.compressor!r}")
        if len(self.shape) not in (3, 4) or len(self.chunk) != len(self.shape) or min(self.chunk) < 1:
            raise ValueError(f"shape {self.shape} and chunks {self.chunk} don't make a volume")
        if np.dtype(self.dtype).kind not in "iuf":
            raise ValueError(f"unsupported element type {self.dtype!r}")

    @property
    def axes(self) -> tuple[str, ...]:
        return ("c", "z", "y", "x")[-len(self.shape) :]

    @property
    def floating(self) -> bool:
        return np.dtype(self.dtype).kind == "f"

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunk))

    def extent(self, key: tuple[int, ...]) -> tuple[int, ...]:
        """Size of a chunk's part inside the array."""
        return tuple(min(c, s - k * c) for k, c, s in zip(key, self.chunk, self.shape))

    def file(self, key: tuple[int, ...]) -> str:
        return "/".join(map(str, reversed(key))) if self.kind == "n5" else self.separator.join(map(str, key))

    def empty(self, key: tuple[int, ...]) -> np.ndarray:
        return np.full(self.extent(key), self.fill, self.dtype)

    def decode(self, content: bytes, key: tuple[int, ...]) -> np.ndarray:
        """Cells of a chunk inside the array; an N5 block may be smaller and leaves the rest to the fill value."""
        if self.kind == "n5":
            mode, rank = struct.unpack_from(">HH", content)
            if mode not in (0, 1) or rank != len(self.shape):
                raise ValueError(f"block {key}: mode {mode} with {rank} axes is not supported")
            size = struct.unpack_from(f">{rank}I", content, 4)[::-1]
            content = content[4 + 4 * rank + 4 * mode :]
            stored = np.frombuffer(_decompress(content, self.compressor), self.dtype).reshape(size)
        else:
            stored = np.frombuffer(_decompress(content, self.compressor), self.dtype).reshape(self.chunk, order=self.order)
        cells = self.empty(key)
        inside = tuple(slice(0, min(n, m)) for n, m in zip(stored.shape, cells.shape))
        cells[inside] = stored[inside]
        return cells

    def encode(self, cells: np.ndarray) -> bytes:
        if self.kind == "n5":
            head = struct.pack(f">HH{cells.ndim}I", 0, cells.ndim, *reversed(cells.shape))
            return head + _compress(cells.tobytes(), self.compressor)
        whole = np.full(self.chunk, self.fill, self.dtype)
        whole[tuple(slice(0, n) for n in cells.shape)] = cells
        return _compress(whole.tobytes(order=self.order), self.compressor)

    def metadata(self) -> dict:
        if self.kind == "n5":
            return {
                "dimensions": list(reversed(self.shape)), "blockSize": list(reversed(self.chunk)), "dataType": np.dtype(self.dtype).name,
                "compression": {"type": self.compressor or "raw", **({"useZlib": True} if self.compressor == "zlib" else {})},
            }
        fill = self.fill if np.isfinite(self.fill) else str(self.fill).replace("inf", "Infinity").replace("nan", "NaN")
        return {
            "zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunk), "dtype": np.dtype(self.dtype).str, "order": self.order,
            "compressor": None if self.compressor is None else {"id": self.compressor, "level": 1}, "fill_value": fill, "filters": None,
            "dimension_separator": self.separator,
        }


def stored_layout(fs: pyarrow.fs.FileSystem, root: str) -> Layout | None:
    """Layout of the array at a path, None if there is none."""
    text = read_bytes(fs, f"{root}/{METADATA['zarr']}")
    if text is not None:
        meta = json.loads(text)
        if meta.get("filters"):
            raise ValueError(f"{root}: filters are not supported")
        return Layout(
            "zarr", tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], (meta.get("compressor") or {}).get("id"),
            meta.get("order", "C"), meta.get("dimension_separator", "."), _number(meta.get("fill_value"), meta["dtype"]),
        )
    text = read_bytes(fs, f"{root}/{METADATA['n5']}")
    meta = json.loads(text) if text is not None else {}
    if "dimensions" not in meta:
        return None
    # older containers name the compression by a word
    packing = meta.get("compression", meta.get("compressionType", "raw"))
    packing = packing if isinstance(packing, str) else packing["type"]
    dtype = np.dtype(meta["dataType"]).newbyteorder(">").str
    return Layout("n5", tuple(meta["dimensions"][::-1]), tuple(meta["blockSize"][::-1]), dtype, None if packing == "raw" else packing)


def _number(fill, dtype: str) -> float | int:
    if fill is None:
        return 0
    return float(fill) if np.dtype(dtype).kind == "f" else int(fill)



class ChunkedArray(DataSource):
    """Options: ``path``; reading ``keepzero`` (true); writing ``array`` (layout as JSON), ``attributes`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _layout(self) -> Layout:
        layout = stored_layout(*open_store(self.options["path"]))
        if layout is None:
            raise FileNotFoundError(f"no array at {self.options['path']}")
        return layout

    def schema(self) -> str:
        layout = self._layout()
        return ", ".join(f"{a} bigint" for a in layout.axes) + f", v {'double' if layout.floating else 'bigint'}"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self._layout(), str(self.options.get("keepzero", "true")).lower() == "true")

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), schema.names, overwrite)


@dataclass
class Chunks(InputPartition):
    """A run of the chunks in reach, numbered in their order."""

    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, keep_zero: bool):
        self.path, self.layout, self.keep_zero = path, layout, keep_zero
        self.begin, self.end = [0] * len(layout.shape), list(layout.shape)

    def pushFilters(self, filters):
        """Narrows the box by bounds on axes; all filters stay with Spark, which also sees nulls."""
        for f in filters:
            axis = self.layout.axes.index(f.attribute[0]) if getattr(f, "attribute", ("",))[0] in self.layout.axes else None
            if axis is not None:
                low, high = self.begin[axis], self.end[axis]
                if isinstance(f, EqualTo):
                    low, high = f.value, f.value + 1
                elif isinstance(f, In) and f.value:
                    low, high = min(f.value), max(f.value) + 1
                elif isinstance(f, GreaterThanOrEqual):
                    low = f.value
                elif isinstance(f, GreaterThan):
                    low = f.value + 1
                elif isinstance(f, LessThan):
                    high = f.value
                elif isinstance(f, LessThanOrEqual):
                    high = f.value + 1
                self.begin[axis], self.end[axis] = max(self.begin[axis], low), min(self.end[axis], high)
            yield f

    def _reach(self) -> tuple[list[int], list[int]]:
        """First chunk and number of chunks of every axis."""
        if any(b >= e for b, e in zip(self.begin, self.end)):
            return [0] * len(self.begin), [0] * len(self.begin)
        low = [b // c for b, c in zip(self.begin, self.layout.chunk)]
        return low, [-(-e // c) - k for e, c, k in zip(self.end, self.layout.chunk, low)]

    def partitions(self):
        _, counts = self._reach()
        total = int(np.prod(counts, dtype=object))
        each = max(1, CELLS // int(np.prod(self.layout.chunk)), -(-total // PARTITIONS))
        return [Chunks(n, min(n + each, total)) for n in range(0, total, each)] or [Chunks(0, 0)]

    def read(self, partition: Chunks):
        fs, root = open_store(self.path)
        low, counts = self._reach()
        for number in range(partition.first, partition.last):
            key = tuple(int(k) + b for k, b in zip(np.unravel_index(number, counts), low))
            content = read_bytes(fs, f"{root}/{self.layout.file(key)}")
            if content is None and not self.keep_zero and self.layout.fill == 0:
                continue
            cells = self.layout.empty(key) if content is None else self.layout.decode(content, key)
            origin = [k * c for k, c in zip(key, self.layout.chunk)]
            start = [max(0, b - o) for b, o in zip(self.begin, origin)]
            cells = cells[tuple(slice(s, e - o) for s, e, o in zip(start, self.end, origin))]
            yield from self._rows(cells, [o + s for o, s in zip(origin, start)])

    def _rows(self, cells: np.ndarray, origin: list[int]):
        flat = cells.ravel()
        if not self.layout.floating and flat.size and int(flat.max()) > np.iinfo(np.int64).max:
            raise OverflowError(f"{self.path}: a value doesn't fit a bigint")
        picked = np.arange(flat.size) if self.keep_zero else np.flatnonzero(flat)
        for at in range(0, len(picked), ROWS):
            now = picked[at : at + ROWS]
            columns = [pa.array(i + o, pa.int64()) for i, o in zip(np.unravel_index(now, cells.shape), origin)]
            values = pa.array(flat[now].astype(np.float64 if self.layout.floating else np.int64))
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*self.layout.axes, "v"])


@dataclass
class Written(WriterCommitMessage):
    """First and last chunk number that a task wrote; none of an empty task."""

    first: int | None
    last: int | None


class ArrayWriter(DataSourceArrowWriter):
    """Takes rows in ascending order of their chunks, all rows of a chunk in one task."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names = options["path"], names
        given = json.loads(options["array"]) if "array" in options else None
        self.attributes = json.loads(options.get("attributes", "{}"))
        fs, root = open_store(self.path)
        stored = stored_layout(fs, root)
        self.layout = stored if given is None else Layout(**{**given, "shape": tuple(given["shape"]), "chunk": tuple(given["chunk"])})
        if self.layout is None:
            raise FileNotFoundError(f"no array at {self.path}, and none described")
        self.exists = stored is not None and not overwrite
        if self.exists and stored != self.layout:
            raise ValueError(f"{self.path} holds {stored}, not {self.layout}")
        if {*self.layout.axes, "v"} != set(names):
            raise ValueError(f"columns {names} are not {[*self.layout.axes, 'v']}")
        if not self.exists:
            begun = read_bytes(fs, f"{root}/{BEGUN}") is not None
            if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
                if stored is None and not begun and fs.get_file_info(pyarrow.fs.FileSelector(root)):
                    raise FileExistsError(f"{self.path} is no array and not empty")
                fs.delete_dir_contents(root)
            fs.create_dir(root, recursive=True)
            fs.open_output_stream(f"{root}/{BEGUN}").close()
        self.staging = f"_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, root = open_store(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        counts, first, now = self.layout.counts, None, None
        held: list[tuple[np.ndarray, pa.Array]] = []
        for batch in iterator:
            if not batch.num_rows:
                continue
            axes = [batch.column(self.names.index(a)) for a in self.layout.axes]
            if any(a.null_count for a in axes):
                raise ValueError("a cell without a place")
            place = np.stack([a.to_numpy() for a in axes]).astype(np.int64)
            if (place.min(axis=1) < 0).any() or (place.max(axis=1) >= self.layout.shape).any():
                raise ValueError(f"a cell outside the shape {self.layout.shape}")
            chunk = np.array(self.layout.chunk)[:, None]
            numbers = np.ravel_multi_index(tuple(place // chunk), counts)
            values = batch.column(self.names.index("v"))
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:]):
                number = int(numbers[low])
                if now is not None and number < now:
                    raise ValueError("rows aren't sorted by chunk: use write_array")
                if number != now and now is not None:
                    self._put(fs, root, now, held)
                    held = []
                first, now = number if first is None else first, number
                held.append((place[:, low:high] % chunk, values.slice(low, high - low)))
        if now is not None:
            self._put(fs, root, now, held)
        return Written(first, now)

    def _put(self, fs, root: str, number: int, held: list) -> None:
        layout = self.layout
        key = tuple(int(k) for k in np.unravel_index(number, layout.counts))
        target = f"{root}/{layout.file(key)}"
        old = read_bytes(fs, target) if self.exists else None
        cells = layout.empty(key) if old is None else layout.decode(old, key)
        flat = np.ravel_multi_index(tuple(np.concatenate([p for p, _ in held], axis=1)), cells.shape)
        if len(np.unique(flat)) != len(flat):
            raise ValueError(f"chunk {key}: two rows of one cell")
        values = pa.concat_arrays([v for _, v in held])
        known = values.is_valid().to_numpy(zero_copy_only=False)
        exact = values.filter(pa.array(known)).to_numpy(zero_copy_only=False)
        if not layout.floating and len(exact):
            limits = np.iinfo(layout.dtype)
            if exact.dtype.kind not in "iu" or int(exact.min()) < limits.min or int(exact.max()) > limits.max:
                raise ValueError(f"chunk {key}: a value doesn't fit {layout.dtype}")
        cells = cells.reshape(-1)
        cells[flat] = layout.fill
        cells[flat[known]] = exact
        part = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(layout.encode(cells.reshape(layout.extent(key))))
        fs.create_dir(posixpath.dirname(target), recursive=True)
        _replace(fs, part, target)

    def commit(self, messages) -> None:
        runs = sorted((m.first, m.last) for m in messages if m is not None and m.first is not None)
        fs, root = open_store(self.path)
        if any(a[1] >= b[0] for a, b in zip(runs, runs[1:])):
            self.abort(messages)
            raise ValueError("two tasks wrote to one run of chunks: use write_array")
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        if not self.exists:
            meta = self.layout.metadata()
            texts = {METADATA[self.layout.kind]: meta | self.attributes if self.layout.kind == "n5" else meta}
            if self.layout.kind == "zarr":
                texts = {".zattrs": self.attributes} | texts  # what makes it an array comes last
            for name, content in texts.items():
                part = f"{root}/{self.staging}/{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(json.dumps(content).encode())
                _replace(fs, part, f"{root}/{name}")
            fs.delete_file(f"{root}/{BEGUN}")
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages) -> None:
        fs, root = open_store(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed to it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedArray)


def read_array(spark: SparkSession, path: str, keep_zero: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("keepzero", str(keep_zero).lower()).load(path)


def write_array(
    voxels: DataFrame, value: str, path: str, layout: Layout | None = None, mode: str = "append", attributes: dict | None = None
) -> None:
    """Write voxels as a chunked array, or (without a layout) into the array that is there.

    ``append`` makes the array or fills into an equal one, ``overwrite`` replaces it. Each chunk's
    rows meet in one task, a chunk at a time; there are at most as many as the chunk has cells.
    """
    register(voxels.sparkSession)
    array = layout or stored_layout(*open_store(path))
    if array is None:
        raise FileNotFoundError(f"no array at {path}, and none described")
    number = F.lit(0).cast("bigint")
    for axis, size, count in zip(array.axes, array.chunk, array.counts):
        number = number * count + F.floor(F.col(axis) / size)
    rows = voxels.select(*[F.col(a).cast("bigint").alias(a) for a in array.axes], F.col(value).alias("v"), number.alias("_chunk"))
    writer = (
        rows.repartitionByRange("_chunk").sortWithinPartitions("_chunk").drop("_chunk").write.format(NAME).mode(mode)
        .option("attributes", json.dumps(attributes or {}))
    )
    if layout is not None:
        writer = writer.option("array", json.dumps(layout.__dict__))
    writer.save(path)
