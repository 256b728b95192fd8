"""Periodic runs of words, proposed by a dictionary of basic factors.

The words of a text are numbered from 0. A run is a stretch of words with smallest period ``q``
(words ``q`` apart are identical), at least ``exponent`` times as long as ``q`` and at least
``least`` words, that no neighbouring word extends.

For lengths 1, 2, 4, ... every factor (stretch of that many words) gets a name: a word's own
number, then the number of the pair of its halves' names. For each length ``m``, the next
occurrence of a place's factor is looked up if it is at most ``2 * m`` away. Places whose next
occurrence follows at the same distance once more begin an arithmetic progression of three and
propose that distance as a period. A stretch of neighbouring places with one distance proposes it
once. Proposals are extended to both sides as far as the words agree; those too short go, and of
proposals for the same stretch the smallest period stays.

Nothing is missed from exponent 4 on: for a run of period ``q`` take the length ``m`` with
``q <= m < 2 * q``. A factor of the run that is no shorter than ``q`` next occurs ``q`` places on,
neither earlier (the run would have a smaller period) nor later, and the run holds three
occurrences of its first factor as ``2 * q + m < 4 * q``.

Only places whose factor occurs twice in their text go on to the next length, so ordinary prose is
done after a few. A task holds one block of texts and some arrays of one number a word.

Defined results: null and empty texts have no words and no runs, and collapse to an empty text;
a row is a text of its own, whatever its id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.text import prepare, ragged, sliced, split_words, texts

LEAST = 6
EXPONENT = 4
BLOCK_BYTES = 4 << 20


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and which entries have a key that occurs twice."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def proposals(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of stretches that propose a period, and the periods; several texts side by side."""
    count = len(codes)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    names, repeated = _named(row * (int(codes.max(initial=0)) + 1) + codes)
    place = np.flatnonzero(repeated)
    name = np.full(count, -1)
    name[place] = names[place]
    found, m = [], 1
    while len(place):
        order = place[np.argsort(name[place], kind="stable")]
        gap = np.diff(order)
        near = (np.diff(name[order]) == 0) & (gap <= 2 * m)
        step = np.zeros(count, np.int64)
        step[order[:-1][near]] = gap[near]
        at = np.flatnonzero(step)
        at = at[step[at + step[at]] == step[at]]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(step[at]) != 0)
        found.append((at[fresh], step[at[fresh]]))
        place = place[place + 2 * m <= ends[place]]
        place = place[name[place + m] >= 0]
        names, repeated = _named(name[place] * count + name[place + m])
        place = place[repeated]
        name = np.full(count, -1)
        name[place] = names[repeated]
        m *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, periods = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort([starts, periods])
    return starts[order], periods[order]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries from the start on are equal; looks at ever longer pieces."""
    done, step = 0, 64
    while done < len(a):
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return len(a)


def repetitions(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """``start, end, period`` of all runs in several texts side by side, by start, then period."""
    if exponent < 4:
        raise ValueError("runs shorter than four periods may have no proposal")
    runs: dict[tuple[int, int], int] = {}
    low = high = last = 0
    for start, period in zip(*(x.tolist() for x in proposals(codes, offsets))):
        if period == last and low <= start <= high - period:
            continue  # proposed by the stretch extended last
        text = int(np.searchsorted(offsets, start, side="right"))
        begin, end = int(offsets[text - 1]), int(offsets[text])
        high = start + period + _agreeing(codes[start : end - period], codes[start + period : end])
        low = start - _agreeing(codes[begin:start][::-1], codes[begin + period : start + period][::-1])
        last = period
        if high - low >= max(least, exponent * period):
            runs.setdefault((low, high), period)  # periods ascend
    out = np.array([(low, high, q) for (low, high), q in runs.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort([out[:, 2], out[:, 0]])]


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT,
) -> DataFrame:
    """``doc_id, runs, collapsed``: runs as structs of start, length, period in order of start.

    ``collapsed`` has the words that no run contains behind its first period, joined by spaces.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in sliced(batches, "text", BLOCK_BYTES):
            codes, offsets, words = split_words(texts(batch.column("text")))
            found = repetitions(codes, offsets, least, exponent)
            start, end, period = found.T
            row = np.searchsorted(offsets, start, side="right") - 1
            kept = np.ones(len(codes), bool)
            kept[ragged(start + period, end - start - period)] = False
            before = np.concatenate([[0], np.cumsum(kept)])[offsets]
            left = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.take(pa.array(codes[kept])))
            structs = pa.StructArray.from_arrays([pa.array(start - offsets[row]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
            per_row = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(per_row), structs), pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the greatest length; of equally long ones the first, then the smallest period."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"])))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["shorter"]).alias("length"), best["period"].alias("period")))
