"""Helpers shared by the text operators: Arrow word splitting, bounded memos, sizes, tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import string
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.session import ship_package

BATCH_BYTES = 8 << 20  # text that one step of an Arrow loop works on


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches in bytes unless the session has its own bound.

    Batches are otherwise bounded in rows only, and long texts would make them any size.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, str(BATCH_BYTES))


def release_memory() -> None:
    """Give back what a finished task leaves in the Python worker's allocators.

    Workers are reused; what they keep would add up with the next stage's needs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text: decides held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one narrow pass, used only to choose numbers of partitions."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def parts_for(total_bytes: int, target: int = 16 << 20) -> int:
    return max(1, math.ceil(total_bytes / target))


def sliced(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts stay near ``limit`` bytes; a row is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(lo, hi - lo)
    release_memory()


def texts(column: pa.Array) -> pa.Array:
    """Null texts become empty; 64-bit offsets, so that long batches don't overflow.

    Copied, so that the result never is a slice: compute kernels have misread the values of sliced
    string arrays.
    """
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([whole.slice(0, 0), whole])


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, as codes into distinct words.

    Returns the code of every word, the first word of every row (one entry more than rows) and
    the distinct words.
    """
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # leading and trailing white space
        real = codes != empty
        kept = np.concatenate([[0], np.cumsum(real)])
        offsets, codes = kept[offsets], codes[real]
    return codes, offsets, words


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's range; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length`` of every entry, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
TAIL = string.punctuation.replace("'", "")  # after a letter these begin a new word for the tokenizers here


class PieceMemo:
    """Token ids of text pieces, remembered up to ``limit`` pieces and ``limit_bytes`` bytes.

    When it is full, long pieces and those asked for only once since the last time are forgotten.
    """

    LONG = 256  # bytes

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000, limit_bytes: int = 64 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.known = pa.array([], pa.large_string())
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        short = pc.binary_length(self.known).to_numpy(zero_copy_only=False) <= self.LONG
        keep = np.flatnonzero((self.used > 1) & short)
        if len(keep) > self.limit // 2:
            keep = keep[:0]
        self.known = self.known.take(pa.array(keep))
        self.ids = self.ids[ragged(self.starts[keep], self.lengths[keep])]
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.used = np.zeros(len(keep), np.int64)

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is; encodes those not known."""
        if len(self.known) + len(pieces) > self.limit or self.known.nbytes + self.ids.nbytes > self.limit_bytes:
            self._forget()
        found = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh = pieces.take(pa.array(missing))
            ids, lengths = self.encode(fresh.to_pylist())
            found[missing] = len(self.known) + np.arange(len(missing))
            self.known = pa.concat_arrays([self.known, fresh])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used = np.concatenate([self.used, np.zeros(len(missing), np.int64)])
        self.used[found] += 1
        return found

    def table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all these distinct pieces, one after the other, with starts and lengths.

        A word with punctuation behind it is looked up as these two.
        """
        two = pc.match_substring_regex(pieces, rf"^ ?[{LETTERS}]+[{re.escape(TAIL)}]+$")
        empty = pa.scalar("", pieces.type)
        stem = pc.if_else(two, pc.ascii_rtrim(pieces, characters=TAIL), pieces)
        tail = pc.if_else(two, pc.replace_substring_regex(pc.if_else(two, pieces, empty), rf"^ ?[{LETTERS}]+", ""), empty)
        parts = pa.concat_arrays([stem, tail]).dictionary_encode()
        slot = self._slots(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
        both = slot.reshape(2, -1).T.reshape(-1)
        lengths = self.lengths[both]
        ids = self.ids[ragged(self.starts[both], lengths)]
        lengths = lengths.reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(lengths) - lengths, lengths


# Runs of letters that normalising leaves as they are, and that are one word to the tokenizer.
SPACED_LETTERS = rf" ?[{LETTERS}]+"  # byte-level, with case: a leading space belongs to the word
LOWER_LETTERS = r"[a-zß-öø-ÿ]+"  # words in lower case


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the rest as code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceEncoder:
    """Ids of many short pieces.

    Pieces that match ``letters`` go straight to the tokenizer's model, in its byte characters;
    all others through the whole tokenizer. The tokenizer reads its special tokens' names in a text
    as these tokens, wherever they stand; ``own`` encodes such texts whole (``marked`` finds them),
    and pieces of other texts hold no such name.
    """

    def __init__(self, content: str, letters: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(content)
        self.marks = [token.content for token in self.own.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True  # lower-casing may make a name of what is none
        self.model = self.tokenizer.model
        self.letters, self.characters = re.compile(letters), byte_characters()
        alphabet = [chr(c) for c in range(ord("a"), ord("z") + 1)]
        self.caseless = self._ids(alphabet) == self._ids([c.upper() for c in alphabet])

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, simple, table, space = self.model.tokenize, self.letters.fullmatch, self.characters, self.characters[32]
        ids = [
            [t.id for t in tokenize(p.replace(" ", space) if p.isascii() else p.encode().decode("latin-1").translate(table))] if simple(p) else None
            for p in pieces
        ]
        others = [k for k, found in enumerate(ids) if found is None]
        for k, found in zip(others, self._ids([pieces[k] for k in others])):
            ids[k] = found
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


    def marked(self, column: pa.Array) -> np.ndarray:
        """Rows whose text holds the name of a special token."""
        found = np.zeros(len(column), bool)
        for mark in self.marks:
            found |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)


def blanked(column: pa.Array, rows: np.ndarray) -> pa.Array:
    """The same texts, those of ``rows`` empty."""
    if not len(rows):
        return column
    empty = np.zeros(len(column), bool)
    empty[rows] = True
    return pc.if_else(pa.array(empty), pa.scalar("", column.type), column)


def with_pieces(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and offsets with one more piece in each of these empty rows: ``first``, ``first + 1``, ..."""
    more = np.zeros(len(offsets), np.int64)
    more[rows + 1] = 1
    return np.insert(codes, offsets[rows], first + np.arange(len(rows))), offsets + np.cumsum(more)


def tokenizer_json(path: str) -> str:
    """The tokenizer file's content, read once on the driver and shipped to the tasks."""
    return Path(path).read_text(encoding="utf-8")


_MEMOS: dict[int, PieceMemo] = {}


def piece_memo(content: str, letters: str) -> PieceMemo:
    """One tokenizer and memo per Python worker and tokenizer file; survives from task to task."""
    key = hash((content, letters))
    if key not in _MEMOS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _MEMOS[key] = PieceMemo(PieceEncoder(content, letters))
    return _MEMOS[key]


def forget_pieces() -> None:
    """Drop the tokenizers and memos that tasks of another operator left in this Python worker.

    Spark reuses workers: beside a stage that needs none of them, they would take their memory all along.
    """
    if _MEMOS:
        _MEMOS.clear()
        release_memory()
