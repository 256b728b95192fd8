"""Order-preserving packing: dynamic programming over the places where a window may end.

Documents in ascending id order form one stream of token ids. It is cut into windows of at most
``size`` ids; a cut may fall at a document's end (free), at a sentence's end (``SENTENCE``) or,
inside a sentence longer than a window, anywhere (``HARD``). Sentence ends are found in whole texts,
line feeds among them, and count where an id ends too. The cuts minimise

    sum over windows of  padding + penalty of the window's end + ``OPEN``

where a window is padded to ``size`` unless its length is a power of two. The best window that
ends at a place comes from the least ``cost + place`` among the starts within reach, kept in a
monotone queue, and from the at most twelve starts a power of two away: linear time.

Every partition of the id range is solved by itself, so only its last window can't be filled by
what follows. ``sequence_id`` is the partition times 2**32 plus the window's number.

Defined results: special tokens' names in a text are these tokens, as the tokenizer reads them; a null text is an empty document and gives its end id alone; equal ids stay
together; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.text import SPACED_LETTERS, PieceMemo, blanked, parts_for, piece_memo, prepare, ragged, row_sums, sliced, text_bytes, texts, tokenizer_json, with_pieces

SIZE = 2048
SENTENCE, HARD, OPEN = 1, 64, 64  # in ids of padding
FREE, AT_SENTENCE, ANYWHERE = 0, 1, 2
RUN_IDS = 1 << 23  # ids solved at a time; bounds a task's memory

# White space next to a space, or any that isn't space or line feed, lets the tokenizer's own
# rules look across a space, as does other white space next to a line feed; such texts are encoded
# whole.
UNUSUAL = r"\t\x00-\x08\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}"
ODD = rf"[\s{UNUSUAL}] | [\s{UNUSUAL}]|[{UNUSUAL}]\n|\n[{UNUSUAL}]"

# A sentence ends with a mark before white space or the text's end, with an ideographic mark (and
# the closing marks behind it) anywhere, and with every line feed.
WHITE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
IDEOGRAPHIC = "[。！？｡]+[」』】》）”’]*"
SENTENCE_END = re.compile(rf"[.!?](?=[{WHITE}]|\Z)|{IDEOGRAPHIC}|\n")
ENDS_PIECE = rf"(?:[.!?\n]|{IDEOGRAPHIC})$"
INSIDE_PIECE = rf"(?s)[.!?][{WHITE}]|\n.|[。！？｡].*[^」』】》）”’。！？｡]"


def best_cuts(places: np.ndarray, kinds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Ends of the cheapest windows over the stream ``[0, places[-1])``.

    ``places`` ascend strictly; neighbours (and 0 and the first) are at most ``size`` apart. Of
    equally cheap choices the longest window is taken.
    """
    places = np.concatenate([[0], places])
    count = len(places)
    penalty = np.array([0, SENTENCE, HARD])[kinds] + OPEN
    # starts from which a window of 2**k ids reaches a place, as (end, start) pairs by end
    ends, starts = [], []
    k = 1
    while k <= size:
        found = np.searchsorted(places, places - k)
        hit = (places >= k) & (places[np.minimum(found, count - 1)] == places - k)
        ends.append(np.flatnonzero(hit))
        starts.append(found[hit])
        k *= 2
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    starts = starts[order].tolist()
    first = np.searchsorted(ends[order], np.arange(count + 1)).tolist()
    at, pen = places.tolist(), [0, *penalty.tolist()]
    cost, back = [0] * count, [0] * count
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + place, place, index
    for j in range(1, count):
        here = at[j]
        while queue[0][1] < here - size:
            queue.popleft()
        key, _, source = queue[0]
        best = key + size - here
        for s in starts[first[j] : first[j + 1]]:
            if cost[s] < best or (cost[s] == best and s < source):
                best, source = cost[s], s
        best += pen[j]
        cost[j], back[j] = best, source
        key = best + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, here, j))
    cuts = []
    j = count - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """All places where a window may end, with their kinds; gaps over ``size`` get hard cuts."""
    places = np.union1d(doc_ends, sentence_ends)
    kinds = np.where(np.isin(places, doc_ends), FREE, AT_SENTENCE)
    before = np.concatenate([[0], places[:-1]])
    extra = np.maximum(0, -(-(places - before) // size) - 1)
    if extra.any():
        nth = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        # both the windows filled from the gap's start and those that end with it
        hard = np.concatenate([np.repeat(before, extra) + size * nth, np.repeat(places, extra) - size * nth])
        hard = np.setdiff1d(hard, places)
        kinds = np.concatenate([kinds, np.full(len(hard), ANYWHERE)])
        places = np.concatenate([places, hard])
        order = np.argsort(places, kind="stable")
        places, kinds = places[order], kinds[order]
    return places, kinds


def pieces_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts as pieces that the tokenizer treats alone: codes, row offsets, distinct pieces.

    Pieces begin at spaces, at runs of line feeds, at a run's last one and behind it; a run at a
    text's end is one piece, as it is for the tokenizer.
    """
    rows = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(rows[0]), int(rows[-1])
    rows = rows - low
    data = np.frombuffer(column.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    begins = np.zeros(len(data) + 1, bool)  # of a row
    begins[rows] = True
    feed = np.append(data == ord("\n"), False)
    starts = np.append(data == ord(" "), False)
    starts[1:] |= feed[1:] & ~feed[:-1]
    last = np.flatnonzero(feed[:-1] & ~feed[1:] & ~begins[1:])
    starts[last] = True
    starts[last + 1] = True
    for odd in np.flatnonzero(pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)):
        starts[rows[odd] : rows[odd + 1]] = False
    at = np.flatnonzero(starts | begins)
    flat = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, rows), encoded.dictionary


def sentence_places(encoding, text: str) -> np.ndarray:
    """Numbers of ids after which a sentence of ``text`` ends; ends inside an id have none."""
    ends = np.fromiter((m.end() for m in SENTENCE_END.finditer(text)), np.int64)
    spans = np.array(encoding.offsets, np.int64).reshape(-1, 2)
    places = np.searchsorted(spans[:, 0], ends)
    whole = (places > 0) & (spans[places - 1, 1] <= ends) if len(spans) else np.zeros(len(ends), bool)
    return np.unique(places[whole])


def encode_pieces(memo: PieceMemo, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all these distinct pieces with starts and lengths; places of sentence ends and their numbers."""
    inside = pc.match_substring_regex(pieces, INSIDE_PIECE).to_numpy(zero_copy_only=False)
    alone = np.flatnonzero(~inside)
    plain = pieces.take(pa.array(alone))
    found, begins, counts = memo.table(plain)
    starts, lengths, n_places = (np.zeros(len(pieces), np.int64) for _ in range(3))
    starts[alone], lengths[alone] = begins, counts
    closes = pc.match_substring_regex(plain, ENDS_PIECE).to_numpy(zero_copy_only=False) & (counts > 0)
    n_places[alone] = closes
    ids, places, total = [found], {}, len(found)
    for k in np.flatnonzero(inside).tolist():
        text = pieces[k].as_py()
        encoding = memo.encode.tokenizer.encode(text, add_special_tokens=False)
        ids.append(np.array(encoding.ids, np.uint32))
        starts[k], lengths[k] = total, len(ids[-1])
        total += len(ids[-1])
        places[k] = sentence_places(encoding, text)
        n_places[k] = len(places[k])
    flat = np.repeat(lengths, n_places)
    first = np.cumsum(n_places) - n_places
    for k, inner in places.items():
        flat[first[k] : first[k] + len(inner)] = inner
    return np.concatenate(ids), starts, lengths, flat, n_places


def encode_texts(memo: PieceMemo, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Codes and offsets of all texts' pieces, then what ``encode_pieces`` gives for the pieces.

    A text that holds a special token's name is one piece, as the tokenizer itself reads it.
    """
    marked = memo.encode.marked(column)
    codes, offsets, pieces = pieces_of(texts(blanked(column, marked)))
    ids, starts, counts, inner, n_inner = encode_pieces(memo, pieces)
    if len(marked):
        codes, offsets = with_pieces(codes, offsets, marked, len(pieces))
        for k in marked.tolist():
            text = column[k].as_py()
            encoding = memo.encode.own.encode(text, add_special_tokens=False)
            found, places = np.array(encoding.ids, np.uint32), sentence_places(encoding, text)
            starts, counts, n_inner = np.append(starts, len(ids)), np.append(counts, len(found)), np.append(n_inner, len(places))
            ids, inner = np.concatenate([ids, found]), np.concatenate([inner, places])
    return codes, offsets, ids, starts, counts, inner, n_inner


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
    partition_bytes: int = 16 << 20,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    prepare(spark)
    content = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = parts_for(text_bytes(rows), partition_bytes)
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        memo, sequence = piece_memo(content.value, SPACED_LETTERS), TaskContext.get().partitionId() << 32
        held, size_held = [], 0
        for batch in sliced(batches, "text", 6 << 20):
            codes, offsets, ids, starts, counts, inner, n_inner = encode_texts(memo, texts(batch.column("text")))
            lengths = counts[codes]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            doc_tokens = row_sums(lengths, offsets) + 1
            tokens = np.full(int(doc_tokens.sum()), end_id, np.uint32)
            tokens[ragged(np.cumsum(lengths) - lengths + row, lengths)] = ids[ragged(starts[codes], lengths)]
            before, n_ends = np.cumsum(lengths) - lengths + row, n_inner[codes]
            ends = np.repeat(before, n_ends) + inner[ragged((np.cumsum(n_inner) - n_inner)[codes], n_ends)]
            held.append((batch.column("id"), doc_tokens, tokens, ends))
            size_held += len(tokens)
            if size_held >= RUN_IDS:
                out, used = _solve(held, sequence, size)
                yield out
                sequence, held, size_held = sequence + used, [], 0
        if held:
            yield _solve(held, sequence, size)[0]

    return ordered.mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def _solve(held: list, sequence: int, size: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of the documents held, and the number of windows used."""
    ids = pa.concat_arrays([h[0] for h in held])
    doc_tokens = np.concatenate([h[1] for h in held])
    tokens = np.concatenate([h[2] for h in held]).astype("<u4")
    base = np.cumsum([0, *(len(h[2]) for h in held)])
    sentences = np.concatenate([h[3] + b for h, b in zip(held, base)])
    doc_ends = np.cumsum(doc_tokens)
    cuts = best_cuts(*cut_places(doc_ends, sentences, size), size)
    ends = np.union1d(doc_ends, cuts)  # a piece ends with its document or its window
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, begins, side="right")
    window = np.searchsorted(cuts, begins, side="right")
    window_begin = np.concatenate([[0], cuts])[window]
    raw = memoryview(tokens.tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(doc)), pa.array(begins - (doc_ends - doc_tokens)[doc]), pa.array(ends - begins),
            pa.array(crc, pa.int64()), pa.array(doc_tokens[doc]), pa.array(window + sequence), pa.array(begins - window_begin),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    ), len(cuts)
