"""Importance resampling towards a target corpus, with features found by an Aho-Corasick dictionary.

Texts are taken in blocks of a few megabytes. A block's distinct words, each between two
delimiters, make up an automaton; every word carries the CRC-32 and the length of its UTF-8 bytes
as payload. One scan over the block emits the payloads of all its words in order. The CRC of a run
of words follows from its parts' payloads alone: the CRC of what comes first is shifted by the
length of what comes behind it and added to that one's CRC. No run of words is ever built as a
text. A run's CRC modulo the number of buckets is its feature.

A text is searched once: the buckets of its features are stored, two bytes each, and both what follows
reads them. ``bucket_counts`` counts features of a corpus (one row a bucket), ``score`` sums the logarithmic
gains of a document's features and adds Gumbel noise from its id, ``draw`` ranks the highest
scores: with that noise, drawing the highest is sampling without replacement in proportion to the
exponential weight. Ranks come from the counts of every score (scores are whole thousandths of a
logarithm, so there are at most some hundred thousand different ones) and an order inside each
score; nothing is sorted in one place.

What bounds memory: a block of ``BLOCK_BYTES`` (or one longer text), its automaton, and one table
of counts. Words longer than ``LONGEST`` characters stay out of the automaton and get their
payloads straight from their bytes.

Defined results: null and empty texts and texts without a word have no features and weight 0; they
are never drawn as long as ``least_words`` is positive. A null id counts as an empty text in the
noise and comes last among ties. Repeated rows are drawn separately. Other columns are not read.
An empty target gives every bucket the gain of its count in the corpus alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.text import prepare, row_sums, sliced, texts
from voxelith.session import cut_lineage

BUCKETS = 10_000
ORDER = 2
LONGEST = 256
BLOCK_BYTES = 4 << 20
# bytes of a text: ASCII capitals become small, all other ASCII but digits and letters becomes a space
PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest bit first
LONG_WORD = re.compile(rf"[^ ]{{{LONGEST + 1},}}")


def _shift(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _shift_tables() -> list[np.ndarray]:
    """For 1, 2, 4, ... zero bytes behind a text: what each byte of its CRC becomes."""
    step = np.arange(256, dtype=np.int64)
    for _ in range(8):
        step = step >> 1 ^ np.where(step & 1, POLYNOMIAL, 0)
    byte = np.arange(256, dtype=np.int64)
    tables = [np.stack([step, byte, byte << 8, byte << 16])]
    while len(tables) < 31:
        tables.append(_shift(tables[-1], tables[-1]))
    return tables


SHIFTS = _shift_tables()


def crc_behind(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two texts in a row, from the CRC of each and the second's length in bytes."""
    out = first.copy()
    for bit in range(int(length.max()).bit_length() if len(length) else 0):
        at = np.flatnonzero(length >> bit & 1)
        out[at] = _shift(SHIFTS[bit], out[at])
    return out ^ second


def run_crcs(crc: np.ndarray, length: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1 to ``order`` neighbouring words, joined by a space."""
    space = np.full(1, zlib.crc32(b" "), np.int64)
    runs = crc
    yield runs
    for n in range(1, order):
        runs = crc_behind(_shift(SHIFTS[0], runs[:-1]) ^ space, crc[n:], length[n:])
        yield runs


def payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word, and the first word of every row (one entry more than rows)."""
    if not column.buffers()[2]:
        column = pa.array([" "] * len(column), pa.large_string())
    data = pa.py_buffer(PLAIN[np.frombuffer(column.buffers()[2], np.uint8)])
    plain = pa.Array.from_buffers(column.type, len(column), [None, column.buffers()[1], data], offset=column.offset)
    rows = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    starts = np.cumsum(rows) - rows + 1
    block = f" {' '.join(plain.to_pylist())} "
    automaton = ahocorasick.Automaton()
    for word in set(block.split(" ")):
        if 0 < len(word) <= LONGEST:
            data = word.encode()
            automaton.add_word(f" {word} ", zlib.crc32(data) << 16 | len(data))
    found = np.zeros((0, 2), np.int64)
    if len(automaton):
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(block)), np.int64).reshape(-1, 2)
    at, crc, length = found[:, 0] - 1, found[:, 1] >> 16, found[:, 1] & 0xFFFF
    long = [(m.end() - 1, zlib.crc32(data), len(data)) for m in LONG_WORD.finditer(block) for data in [m[0].encode()]]
    if long:
        more = np.array(long, np.int64)
        at, crc, length = (np.concatenate([a, b]) for a, b in zip((at, crc, length), more.T))
        order = np.argsort(at, kind="stable")
        at, crc, length = at[order], crc[order], length[order]
    return crc, length, np.searchsorted(at, np.append(starts, len(block)))


def features(column: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``order`` words: buckets of all runs inside a row, and the rows' offsets."""
    crc, length, offsets = payloads(column)
    last = np.repeat(offsets[1:], np.diff(offsets))
    for n, runs in enumerate(run_crcs(crc, length, order), 1):
        inside = np.arange(len(runs)) + n <= last[: len(runs)]
        kept = np.concatenate([[0], np.cumsum(inside)])
        yield runs[inside] % buckets, kept[np.minimum(offsets, len(runs))]


def stored_kind(buckets: int) -> str:
    """Little-endian numbers that hold any bucket."""
    return "<u2" if buckets <= 1 << 16 else "<i8"


def found_features(docs: DataFrame, id_col: str | None, text_col: str, order: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, found``: the buckets of a text's features, as bytes of ``stored_kind`` numbers."""
    prepare(docs.sparkSession)
    kind = np.dtype(stored_kind(buckets))

    def run(batches):
        for batch in sliced(batches, "text", BLOCK_BYTES):
            parts, words = [], None
            for found, offsets in features(texts(batch.column("text")), order, buckets):
                data = [None, pa.py_buffer(offsets * kind.itemsize), pa.py_buffer(found.astype(kind))]
                parts.append(pa.Array.from_buffers(pa.large_binary(), batch.num_rows, data))
                words = np.diff(offsets) if words is None else words
            whole = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), whole.cast(pa.binary())], names=["doc_id", "n_words", "found"])

    doc_id = F.lit(None).cast("bigint") if id_col is None else F.col(id_col)
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, found binary")


def found_in(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows, and the rows' offsets."""
    kind = np.dtype(stored_kind(buckets))
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.concatenate([[0], np.cumsum(sizes)])


def count_buckets(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of ``found_features`` fall in each bucket; one row a bucket comes to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, "found", BLOCK_BYTES):
            total += np.bincount(found_in(batch.column("found"), buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    counted = found.select("found").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def bucket_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    return count_buckets(found_features(docs, None, text_col, order, buckets), buckets)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target frequency over corpus frequency, one more counted in each bucket."""
    all_corpus, all_target = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(all_corpus) / (float(s + 1) * float(all_target))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def score_found(found: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` from ``found_features``."""
    prepare(found.sparkSession)

    def run(batches):
        for batch in sliced(batches, "found", BLOCK_BYTES):
            hit, offsets = found_in(batch.column("found"), len(gains))
            count = np.diff(offsets)
            weight = np.where(count > 0, row_sums(gains[hit], offsets) // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(count), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    weighed = found.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def score(
    docs: DataFrame, gains: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``; the weight is the floored mean of the gains."""
    return score_found(found_features(docs, id_col, text_col, order, len(gains)), gains, seed)


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... for the highest scores among texts long enough, else null."""
    eligible = F.col("n_words") >= least_words
    per_score = cut_lineage(scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")))
    wanted = (per_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    # one row a score, and scores are few: see the module's text
    above = per_score.select(
        "score", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above")
    ).where(F.col("above") < wanted)
    among = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features")
    ranked = (
        scored.where(eligible).join(above, "score")
        .withColumn("rank", F.col("above") + F.row_number().over(among))
        .withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    )
    columns = [*scored.columns, "rank"]
    rest = scored.join(above, "score", "left_anti").unionByName(scored.where(~eligible).join(above, "score", "left_semi"))
    return ranked.select(columns).unionByName(rest.withColumn("rank", F.lit(None).cast("bigint")).select(columns))


def resample(
    docs: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS,
) -> DataFrame:
    """Every document with its score, and the rank of those drawn for their likeness to the target."""
    found = cut_lineage(found_features(docs, id_col, text_col, order, buckets))
    gains = bucket_gains(count_buckets(found, buckets), bucket_counts(target, target_text_col, order, buckets))
    return draw(cut_lineage(score_found(found, gains, seed)), percent, least_words)
