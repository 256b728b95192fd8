"""Token ids in patched frame-of-reference blocks.

File format of a shard (little endian):

* ``PFR1``, then as unsigned 64-bit integers: number of ids, ids per block, number of blocks;
* for each block: its start in the payload (u64), its smallest id (u32), its width in bits (u8)
  and its number of exceptions (u8);
* the payload. A block holds its ids minus the smallest one, each cut to ``width`` bits and
  packed low bit first into ``ids per block * width / 8`` bytes, then the places of the
  exceptions (u8 each) and their whole differences (u32 each).

The width is the one that ``percentile`` of the differences fit, so a few outliers don't widen
a block: they go to the exception list. The last block is filled up with its smallest id.

Shards are rows of a Parquet table (``shard``, document ids and lengths, ``content``), so that
every store Spark can write works and a lost task is simply repeated. Reading any block needs
the index entry and that block alone (``read_block``).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.text import LOWER_LETTERS, blanked, parts_for, piece_memo, prepare, ragged, row_sums, sliced, split_words, text_bytes, texts, tokenizer_json, with_pieces
from voxelith.session import cut_lineage

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.9
SHARD_IDS = 1 << 21  # a shard ends with the document that reaches so many ids
HEAD = struct.Struct("<4sQQQ")
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("exceptions", "u1")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values of ``width`` bits as rows of bytes."""
    words = np.zeros((len(values), BLOCK * width // 64), np.uint64)
    for k in range(BLOCK):
        word, shift = divmod(k * width, 64)
        words[:, word] |= values[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= values[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed).view("<u8")
    values = np.zeros((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(BLOCK):
        word, shift = divmod(k * width, 64)
        part = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            part = part | (words[:, word + 1] << np.uint64(64 - shift))
        values[:, k] = part & mask
    return values


def encode_ids(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One shard's file content."""
    count = -(-len(ids) // BLOCK)
    index = np.zeros(count, INDEX)
    if not count:
        return HEAD.pack(MAGIC, 0, BLOCK, 0)
    padded = np.zeros(count * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    blocks = padded.reshape(count, BLOCK)
    if len(ids) % BLOCK:
        blocks[-1, len(ids) % BLOCK :] = blocks[-1, : len(ids) % BLOCK].min()
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    bits = np.array([int(x).bit_length() for x in range(1 << 8)], np.uint8)
    fits = np.partition(rest, at, axis=1)[:, at].astype(np.uint32)
    width = np.zeros(count, np.uint8)
    for shift in (24, 16, 8, 0):
        byte = (fits >> np.uint32(shift)) & np.uint32(0xFF)
        width = np.where((width == 0) & (byte > 0), bits[byte] + shift, width).astype(np.uint8)
    over = rest >> width.astype(np.uint64)[:, None] > 0
    exceptions = over.sum(axis=1)
    packed = width.astype(np.int64) * (BLOCK // 8)
    sizes = packed + 5 * exceptions
    start = np.cumsum(sizes) - sizes
    index["start"], index["low"], index["width"], index["exceptions"] = start, low, width, exceptions
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        cut = rest[rows] & np.uint64((1 << int(w)) - 1)
        payload[start[rows][:, None] + np.arange(int(w) * (BLOCK // 8))] = _pack(cut, int(w))
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        begin = (start + packed)[row]
        payload[begin + nth] = place
        values = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        payload[(begin + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return HEAD.pack(MAGIC, len(ids), BLOCK, count) + index.tobytes() + payload.tobytes()


def _open(content: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    magic, total, block, count = HEAD.unpack_from(content)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token block shard")
    index = np.frombuffer(content, INDEX, count, HEAD.size)
    return total, index, np.frombuffer(content, np.uint8, offset=HEAD.size + index.nbytes)


def _decode(index: np.ndarray, payload: np.ndarray) -> np.ndarray:
    out = np.zeros((len(index), BLOCK), np.uint64)
    start = index["start"].astype(np.int64)
    for w in np.unique(index["width"]):
        rows = np.flatnonzero(index["width"] == w)
        if w:
            out[rows] = _unpack(payload[start[rows][:, None] + np.arange(int(w) * (BLOCK // 8))], int(w))
    exceptions = index["exceptions"].astype(np.int64)
    if exceptions.any():
        begin = start + index["width"].astype(np.int64) * (BLOCK // 8)
        place = payload[ragged(begin, exceptions)]
        row = np.repeat(np.arange(len(index)), exceptions)
        raw = payload[ragged(begin + exceptions, 4 * exceptions)]
        out[row, place] = np.ascontiguousarray(raw).view("<u4")
    return (out + index["low"].astype(np.uint64)[:, None]).astype(np.uint32)


def decode_ids(content: bytes) -> np.ndarray:
    """All ids of a shard."""
    total, index, payload = _open(content)
    return _decode(index, payload).reshape(-1)[:total]


def read_block(content: bytes, number: int) -> np.ndarray:
    """The ids of one block, found through the index."""
    total, index, payload = _open(content)
    return _decode(index[number : number + 1], payload).reshape(-1)[: max(0, total - number * BLOCK)]


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    partition_bytes: int = 16 << 20,
) -> DataFrame:
    """Shards of all documents in ascending id order: ``part, shard, ids, lengths, content``.

    Texts are range partitioned by id, so order is global and no task sees more than its share.
    A null text is empty; equal ids keep together in the order of their text's hash; null ids
    come first. Other columns are not read. The tokenizer must drop white space and treat words
    alone, as it is asked word by word; texts with a special token's name are given to it whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    content = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = parts_for(text_bytes(rows), partition_bytes)
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        memo, part, shard = piece_memo(content.value, LOWER_LETTERS), TaskContext.get().partitionId(), 0
        held_ids, held_lengths, held_tokens, size = [], [], [], 0

        def flush():
            tokens = np.concatenate(held_tokens) if held_tokens else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                    pa.array([[x for ids in held_ids for x in ids]], pa.list_(pa.int64())),
                    pa.array([np.concatenate(held_lengths)], pa.list_(pa.int64())),
                    pa.array([encode_ids(tokens)], pa.binary()),
                ],
                names=["part", "shard", "ids", "lengths", "content"],
            )

        for batch in sliced(batches, "text", 6 << 20):
            text = texts(batch.column("text"))
            marked = memo.encode.marked(text)
            plain = blanked(text, marked)
            # for a tokenizer that lower-cases anyway: fewer distinct words
            codes, offsets, words = split_words(pc.ascii_lower(plain) if memo.encode.caseless else plain)
            ids, starts, counts = memo.table(words)
            if len(marked):
                codes, offsets = with_pieces(codes, offsets, marked, len(words))
                whole = [memo.encode.own.encode(text[k].as_py(), add_special_tokens=False).ids for k in marked.tolist()]
                sizes = np.array([len(x) for x in whole], np.int64)
                starts, counts = np.concatenate([starts, len(ids) + np.cumsum(sizes) - sizes]), np.concatenate([counts, sizes])
                ids = np.concatenate([ids, *(np.array(x, np.uint32) for x in whole)])
            of_word = counts[codes]
            lengths = row_sums(of_word, offsets) + 1
            tokens = np.full(int(lengths.sum()), end_id, np.uint32)
            # every word's ids go behind what precedes it; one end id for each earlier row
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            tokens[ragged(np.cumsum(of_word) - of_word + row, of_word)] = ids[ragged(starts[codes], of_word)]
            held_ids.append(batch.column("id").to_pylist())
            held_lengths.append(lengths)
            held_tokens.append(tokens)
            size += len(tokens)
            if size >= SHARD_IDS:
                yield flush()
                held_ids, held_lengths, held_tokens, size, shard = [], [], [], 0, shard + 1
        if held_ids:
            yield flush()

    return cut_lineage(ordered.mapInArrow(run, "part int, shard int, ids array<bigint>, lengths array<bigint>, content binary"))


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards' contents."""
    prepare(shards.sparkSession)
    # one row a shard: of a size that the number of files bounds, not the number of documents
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sizes = shards.select("part", "shard", total.alias("total"))
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("part").agg(F.sum("total").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(by_part), F.lit(0)).alias("before")
    )
    base = sizes.join(before, "part").select(
        "part", "shard", (F.col("before") + F.coalesce(F.sum("total").over(in_part), F.lit(0))).alias("base")
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = np.asarray(batch.column("lengths")[k].values)
                tokens = decode_ids(batch.column("content")[k].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("part")[k].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column("shard")[k].as_py(), np.int32)),
                        batch.column("ids")[k].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    documents = shards.mapInArrow(run, "part int, shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return documents.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
