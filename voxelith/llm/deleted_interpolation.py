"""Deleted interpolation: n-gram estimates mixed by context frequency, weights from held-out counts.

The probability of a token is a mixture of the maximum-likelihood estimates of all orders up to
``order`` and the uniform distribution. The mixture weights depend on how often the longest
context was seen (buckets of powers of two). They are learned by expectation maximisation on one
part of the training documents, with estimates from which that part's counts are deleted; the
final estimates use all training documents.

How it runs: texts are encoded once into chunks (codes into the chunk's own vocabulary). A chunk
cuts its sorted distinct n-grams into slices of the key range and asks for the corpus counts of a
slice with one row: packed differences of the keys, and its own counts. A task merges the rows of one
slice and order, and answers each with the counts that differ from the chunk's own. So no count table
is ever broadcast or collected, a frequent n-gram has at most one entry a chunk, and documents don't
move until their answers join them. Slices grow in number with the text, not in size; one that holds a
very frequent n-gram has besides an entry a chunk of it. N-grams are identified by 61-bit hashes. EM
works on a grid (buckets and estimates rounded to eighths of a power of two), a bucket in a task, whose
cells are bounded by the estimates' range. What reaches the driver are three corpus totals and a row of
weights for each bucket.

Defined results: a null or empty text is its end token alone; repeated rows are scored, and
counted, one by one; without training documents every estimate is uniform; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.text import mix64, parts_for, prepare, release_memory, row_sums, sliced, split_words, text_bytes, texts
from voxelith.session import cut_lineage

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 25
TURNS = 2  # in which counts are asked for and answers are used: less disk at a time, for more reading
CHUNK_BITS = 12  # chunks of a partition; each but the last two has megabytes of text
SLICE_BYTES = 16 << 20  # of text, whose n-grams of one order a task merges
KEY_BITS = 61
STEPS = 8  # estimates are rounded to this part of a power of two for EM
TRAINED, DELETED, HELD_OUT = 0, 1, 2


def _squeeze(values: np.ndarray) -> bytes:
    """32-bit values by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _restore(data: bytes, count: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * count, codec="zstd", asbytes=True) if count else b""
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed: planes of zeros cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, count: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=8 * count, codec="zstd", asbytes=True) if count else b""
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def encode_chunks(rows: DataFrame, order: int, chunk_bytes: int | None = None) -> DataFrame:
    """``chunk, deleted, ids, parts, lengths, codes, vocabulary`` from ``id, text, part``.

    ``codes`` holds ``order - 1`` start marks, the words and the end mark of each document; the
    vocabulary is that of several batches, one after the other. Documents of the deleted part have
    chunks of their own. A chunk's n-grams take memory in proportion to the order, so its text is
    bounded in inverse proportion.
    """
    chunk_bytes = chunk_bytes or (20 << 20) // max(2, order)

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << CHUNK_BITS
        behind = chunk + (1 << CHUNK_BITS)
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(deleted: bool):
            nonlocal chunk
            if chunk == behind:  # would take the next partition's numbers
                raise OverflowError(f"a partition with more than {1 << CHUNK_BITS} chunks: read it in more partitions")
            ids, parts, lengths, codes, vocabularies = zip(*held[deleted])
            base = np.cumsum([0, *map(len, vocabularies)])
            chunk += 1
            held[deleted], size[deleted] = [], 0
            release_memory()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk - 1], pa.int64()), pa.array([deleted]), pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())),
                    pa.array([np.concatenate(parts)], pa.list_(pa.int32())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                    pa.array([_squeeze(np.concatenate([c + b for c, b in zip(codes, base)]))], pa.binary()),
                    pa.array([np.concatenate(vocabularies).tobytes()], pa.binary()),
                ],
                names=["chunk", "deleted", "ids", "parts", "lengths", "codes", "vocabulary"],
            )

        for whole in sliced(batches, "text"):
            is_deleted = pc.equal(whole.column("part"), DELETED)
            for deleted in (False, True):
                batch = whole.filter(is_deleted if deleted else pc.invert(is_deleted))
                if not batch.num_rows:
                    continue
                codes, offsets, words = split_words(pc.ascii_lower(texts(batch.column("text"))))
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
                count = np.diff(offsets)
                length = count + order
                out = np.full(int(length.sum()), len(words), np.int32)  # start marks
                row = np.repeat(np.arange(len(count)), count)
                out[np.arange(len(codes)) + (row + 1) * (order - 1) + row] = codes
                out[np.cumsum(length) - 1] = len(words) + 1
                held[deleted].append((batch.column("id").to_pylist(), batch.column("part").to_numpy(), length, out, np.concatenate([hashes, [START, END]])))
                size[deleted] += sum(map(len, (codes, length))) * 6  # about the bytes of text
                if size[deleted] >= chunk_bytes:
                    yield flush(deleted)
        for deleted in (False, True):
            if held[deleted]:
                yield flush(deleted)

    return rows.mapInArrow(
        run, "chunk bigint, deleted boolean, ids array<bigint>, parts array<int>, lengths array<bigint>, codes binary, vocabulary binary"
    )


class Chunk:
    """N-grams of one encoded chunk: a place among the chunk's distinct keys for every token."""

    def __init__(self, batch: pa.RecordBatch, row: int, order: int):
        value = lambda name: batch.column(name)[row]
        self.chunk, self.deleted = value("chunk").as_py(), value("deleted").as_py()
        self.ids = value("ids").values
        self.lengths = np.asarray(value("lengths").values)
        self.parts = np.asarray(value("parts").values)
        total = int(self.lengths.sum())
        vocabulary = np.frombuffer(value("vocabulary").as_py(), np.uint64)
        token = mix64(vocabulary)[_restore(value("codes").as_py(), total)]
        place = np.arange(total) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.scored = place >= order - 1  # words and end marks
        last_start = place == order - 2  # counted as a context only
        del place
        part = np.repeat(self.parts.astype(np.int8), self.lengths)
        self.keys, self.n, self.d, self.slots = [], [], [], []
        base = 0
        gram = np.zeros(total, np.uint64)
        for k in range(1, order + 1):
            before = np.concatenate([[np.uint64(0)], gram[:-1]])
            gram = mix64(before * FACTOR + token) if k > 1 else token
            real = self.scored | last_start if k < order else self.scored
            keys, slot = np.unique(gram[real] >> np.uint64(64 - KEY_BITS), return_inverse=True)
            n = np.bincount(slot[part[real] != HELD_OUT], minlength=len(keys))
            d = np.bincount(slot[part[real] == DELETED], minlength=len(keys))
            where = np.full(total, -1, np.int32)
            where[real] = slot + base
            self.keys.append(keys)
            self.n.append(n)
            self.d.append(d)
            self.slots.append(where)
            base += len(keys)
        self.n, self.d = np.concatenate(self.n), np.concatenate(self.d)


def start_key() -> int:
    return int(mix64(np.array([START]))[0] >> np.uint64(64 - KEY_BITS))


def requests(chunks: DataFrame, order: int, slices: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """``slice, k, chunk, place, size, keys, n, deleted``: a chunk's distinct n-grams of order ``k`` in a slice.

    ``place`` is that of the first among all of the chunk's n-grams; ``n`` are its own counts. Of the
    slices only every ``turns``-th is asked for.
    """
    width = np.uint64((1 << KEY_BITS) // slices + 1)
    names = ["slice", "k", "chunk", "place", "size", "keys", "n", "deleted"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]

    def cells(c: Chunk):
        base = 0
        for k, keys in enumerate(c.keys, 1):
            own = (keys // width).astype(np.int64)
            cuts = np.flatnonzero(np.diff(own)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                number = int(own[low]) if len(keys) else -1
                if len(keys) and number % turns == turn:
                    steps = np.diff(keys[low:high], prepend=np.uint64(0))
                    counts = c.n[base + low : base + high]
                    yield number, k, c.chunk, base + low, high - low, _pack(steps), _pack(counts), c.deleted
            base += len(keys)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                c = Chunk(batch, row, order)
                held, size = [], 0
                for cell in cells(c):
                    held.append(cell)
                    size += len(cell[5]) + len(cell[6])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
                del c, held
                release_memory()

    return chunks.mapInArrow(run, "slice bigint, k int, chunk bigint, place bigint, size int, keys binary, n binary, deleted boolean")


def answers(asked: DataFrame) -> DataFrame:
    """``chunk, place, size, differs, n, d``: corpus counts where they differ from the chunk's own.

    ``differs`` has a bit for each of the ``size`` n-grams from ``place`` on; ``d`` is told to deleted
    chunks only. A slice of words has one more row, without a chunk: ``word_n, word_v, word_d``, the
    tokens, the distinct ones and the tokens of the deleted part.
    """
    fields = [
        ("chunk", pa.int64()), ("place", pa.int64()), ("size", pa.int32()), ("differs", pa.binary()), ("n", pa.binary()), ("d", pa.binary()),
        ("word_n", pa.int64()), ("word_v", pa.int64()), ("word_d", pa.int64()),
    ]
    start = np.uint64(start_key())

    def merge(key, table):
        sizes = table["size"].to_numpy()
        ends = np.cumsum(sizes)
        deleted = table["deleted"].to_pylist()
        keys, n = np.empty(int(sizes.sum()), np.uint64), np.empty(int(sizes.sum()), np.int64)
        for row, (low, high) in enumerate(zip(ends - sizes, ends)):
            keys[low:high] = np.cumsum(_unpack(table["keys"][row].as_py(), high - low), dtype=np.uint64)
            n[low:high] = _unpack(table["n"][row].as_py(), high - low)
        words, slot = np.unique(keys, return_inverse=True)
        del keys
        all_n = np.bincount(slot, n, len(words)).astype(np.int64)
        of_deleted = np.repeat(deleted, sizes)
        all_d = np.bincount(slot[of_deleted], n[of_deleted], len(words)).astype(np.int64)
        out = []
        for row, (low, high) in enumerate(zip(ends - sizes, ends)):
            at = slot[low:high]
            differs = all_n[at] != n[low:high]
            if deleted[row]:
                differs |= all_d[at] != n[low:high]
            if differs.any():
                told = at[differs]
                out.append((
                    table["chunk"][row].as_py(), table["place"][row].as_py(), high - low, np.packbits(differs).tobytes(),
                    _pack(all_n[told]), _pack(all_d[told]) if deleted[row] else None, None, None, None,
                ))
        if key[1].as_py() == 1:
            real = words != start
            out.append((*[None] * 6, int(all_n[real].sum()), int((all_n[real] > 0).sum()), int(all_d[real].sum())))
        release_memory()
        return pa.table([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(fields)], names=[name for name, _ in fields])

    return asked.groupBy("slice", "k").applyInArrow(
        merge, "chunk bigint, place bigint, size int, differs binary, n binary, d binary, word_n bigint, word_v bigint, word_d bigint"
    )


def _counts(own: np.ndarray, table: pa.Table, column: str) -> np.ndarray:
    """Corpus counts of a chunk's n-grams: its own ones, but for those that were answered."""
    own = own.copy()
    for row in range(table.num_rows):
        bits = np.frombuffer(table["differs"][row].as_py(), np.uint8)
        at = np.flatnonzero(np.unpackbits(bits, count=table["size"][row].as_py())) + table["place"][row].as_py()
        own[at] = _unpack(table[column][row].as_py(), len(at))
    return own


def _estimates(chunk: Chunk, counts: np.ndarray, total: float, order: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context counts of the longest context and the estimates of every order, for token rows."""
    estimates = np.zeros((len(rows), order))
    context = np.full(len(rows), total, np.float64)
    for k in range(1, order + 1):
        if k > 1:
            context = counts[chunk.slots[k - 2][rows - 1]].astype(np.float64)
        own = counts[chunk.slots[k - 1][rows]]
        np.divide(own, context, out=estimates[:, k - 1], where=context > 0)
    return context, estimates


def buckets(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)


def learn_weights(grid: np.ndarray, counts: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """EM on rows of bucket and rounded estimates relative to the uniform one: weights by bucket."""
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    relative = np.ones((len(grid), order + 1))
    relative[:, 1:] = np.where(grid[:, 1:] == NONE, 0.0, 2.0 ** (grid[:, 1:] / STEPS))
    bucket = grid[:, 0]
    for _ in range(rounds):
        # one event's worth of the even mixture keeps every weight above zero
        mass = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
        for low in range(0, len(grid), 1 << 18):
            cut = slice(low, low + (1 << 18))
            share = weights[bucket[cut]] * relative[cut]
            share *= (counts[cut] / share.sum(axis=1))[:, None]
            for k in range(order + 1):
                mass[:, k] += np.bincount(bucket[cut], share[:, k], BUCKETS)
        weights = mass / mass.sum(axis=1, keepdims=True)
    return weights


NONE = -10_000  # estimate of 0


def score(
    docs: DataFrame, train: Column, deleted: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train`` marks the training documents, ``deleted`` those of them that the weights are learned
    on.
    """
    prepare(docs.sparkSession)
    part = F.when(~train, HELD_OUT).when(deleted, DELETED).otherwise(TRAINED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.alias("part"))
    slices = min(parts_for(text_bytes(docs, text_col), SLICE_BYTES), 1 << 31)
    chunks = cut_lineage(encode_chunks(rows, order))
    # in turns: the shuffle of one is gone before the next begins
    turns = [cut_lineage(answers(requests(chunks, order, slices, t, TURNS))) for t in range(TURNS)]
    told = turns[0]
    for other in turns[1:]:
        told = told.unionByName(other)
    totals = told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("word_n", "word_v", "word_d")]).first()
    told = told.where("chunk IS NOT NULL").select("chunk", "place", "size", "differs", "n", "d")
    n_total, v_total, d_total = totals
    uniform = 1.0 / (v_total + 1)

    def events(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"cell": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64())})
        c = Chunk(left.combine_chunks().to_batches()[0], 0, order)
        n, d = _counts(c.n, right, "n"), _counts(c.d, right, "d")
        rows = np.flatnonzero(c.scored & (np.repeat(c.parts, c.lengths) == DELETED))
        context, estimates = _estimates(c, n - d, float(n_total - d_total), order, rows)
        steps = np.full(estimates.shape, NONE, np.int64)
        seen = estimates > 0
        steps[seen] = np.round(np.log2(estimates[seen] / uniform) * STEPS)
        release_memory()
        cells, count = np.unique(np.column_stack([buckets(context), steps]), axis=0, return_counts=True)
        return pa.table({"cell": pa.array(list(cells), pa.list_(pa.int64())), "n": pa.array(count)})

    cells = (
        chunks.where("deleted").groupBy("chunk").cogroup(told.where("d IS NOT NULL").groupBy("chunk"))
        .applyInArrow(events, "cell array<bigint>, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    )
    def learn(key, table):
        bucket = key[0].as_py()
        grid = np.concatenate([c.flatten().to_numpy() for c in table["cell"].chunks]).reshape(-1, order + 1)
        found = learn_weights(grid, table["n"].to_numpy().astype(np.float64), order)[bucket]
        release_memory()
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "weights": pa.array([found], pa.list_(pa.float64()))})

    # a bucket's weights depend on its own cells alone; a row a bucket reaches the driver
    learned = cells.withColumn("bucket", F.col("cell")[0]).groupBy("bucket").applyInArrow(learn, "bucket bigint, weights array<double>")
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    for row in learned.collect():
        weights[row["bucket"]] = row["weights"]

    def final(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f: pa.array([], t) for f, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        c = Chunk(left.combine_chunks().to_batches()[0], 0, order)
        n = _counts(c.n, right, "n")
        rows = np.flatnonzero(c.scored)
        chance = np.zeros(len(rows))
        for low in range(0, len(rows), 1 << 18):
            cut = slice(low, low + (1 << 18))
            context, estimates = _estimates(c, n, float(n_total), order, rows[cut])
            by_bucket = weights[buckets(context)]
            chance[cut] = by_bucket[:, 0] * uniform + (by_bucket[:, 1:] * estimates).sum(axis=1)
        own = n[c.slots[0][rows]]
        release_memory()
        ends = np.concatenate([[0], np.cumsum(c.lengths - (order - 1))])
        return pa.table({
            "doc_id": c.ids, "held_out": pa.array(c.parts == HELD_OUT), "n_tokens": pa.array(np.diff(ends)),
            "n_known": pa.array(row_sums((own > 0).astype(np.int64), ends)),
            "base_score": pa.array(_row_logs((own + 1.0) / (n_total + 1.0 * (v_total + 1)), ends)),
            "score": pa.array(_row_logs(chance, ends)),
        })

    # in turns of the chunks, as above
    scored = None
    for t in range(TURNS):
        now = F.col("chunk") % TURNS == t
        part = cut_lineage(
            chunks.where(now).groupBy("chunk").cogroup(told.where(now).drop("d").groupBy("chunk")).applyInArrow(
                final, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
            )
        )
        scored = part if scored is None else scored.unionByName(part)
    return scored.withColumn("train_tokens", F.lit(n_total).cast("bigint"))


def _row_logs(chances: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the decimal logarithms of each row's tokens; no row is empty."""
    return np.add.reduceat(np.log10(chances), ends[:-1])
