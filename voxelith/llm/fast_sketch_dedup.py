"""Near-copy groups by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct shingles of some words (five, unless asked
otherwise). Its sketch has ``BINS``
coordinates, filled in rounds: round ``i`` hashes every element to one bin and a value, and a bin
keeps the least ``(round, value)``. Rounds go on until every bin is filled; after ``BINS`` of
them, round ``BINS + b`` puts all elements into bin ``b``, so filling is certain. Coordinates of
two sets agree with the probability of their similarity, and are concentrated as in sampling
without replacement.

1. Documents with the same set (by a 128-bit signature) are one node, named by its smallest id.
2. Sketches are cut into ``BANDS`` bands of ``ROWS`` coordinates. Two sets of similarity 0.8 miss
   each other in all bands with a probability below 1e-7.
3. Every bucket's members are compared with its hub only (the member of least hashed id, mostly
   the same one in all bands of a group). That is linear in the bucket, and joins most groups.
4. What is still apart in a bucket of three or more is compared exactly, in blocks: members
   outside the bucket's largest component with all others. No link between different sets is
   lost, and pairs inside a joined component are never listed.
5. Connected components over all confirmed links.

Links are confirmed on whole sets, computed again from the texts. Nothing is capped: hubs and
blocks are salted into groups of bounded size, and sets travel to the groups as texts.

Defined results: a null or empty text, or one without words, has an empty set, is linked with
nothing and kept; with fewer words than a shingle, all of them are one; repeated rows are copies of each other; a
row with a null id is a group of its own unless its text has copies. Ids are expected to be
unique: rows that share one but differ in text count as one node where that id names both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.text import forget_pieces, mix64, prepare, ragged, release_memory, sliced, split_words, texts
from voxelith.operators.components import connected_components
from voxelith.session import cut_lineage

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
PERCENT = 80
GROUP = 256  # sets that one comparison holds on each side
SKETCH_BYTES = 2 << 20  # text sketched at a time; its hashes take some twenty times as much


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``size``-word shingles of every text, one after the other, and row offsets.

    A text of fewer words is one shingle of them all.
    """
    codes, offsets, words = split_words(pc.ascii_lower(texts(column)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[codes]
    grams = mix64(hashes)
    short = np.zeros(len(offsets) - 1, np.uint64)  # of texts with fewer words: all of them
    count = np.diff(offsets)
    for length in range(1, size):
        only = np.flatnonzero(count == length)
        short[only] = grams[offsets[:-1][only]]
        if len(hashes) <= length:
            grams = np.zeros(0, np.uint64)
            break
        grams = mix64(grams[: len(hashes) - length] * np.uint64(0x9E3779B97F4A7C15) + hashes[length:])
    sets = []
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        sets.append(np.unique(grams[lo : hi - size + 1]) if hi - lo >= size else short[row : row + (hi > lo)])
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(lengths)])


def signature(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed 64-bit integers."""
    value = np.frombuffer(xxhash.xxh3_128_digest(elements.astype("<u8").tobytes()), "<i8")
    return int(value[0]), int(value[1])


def sketches(elements: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates for every set; empty sets keep the largest value."""
    rows = len(offsets) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((rows, bins), empty, np.uint64)
    flat = out.reshape(-1)
    lengths = np.diff(offsets)
    open_ = np.flatnonzero(lengths)
    for turn in range(2 * bins):
        if not len(open_):
            break
        part = elements[ragged(offsets[open_], lengths[open_])]
        row = np.repeat(open_, lengths[open_])
        hashed = mix64(part ^ mix64(np.array([turn + 1], np.uint64)))
        value = (np.uint64(turn) << np.uint64(56)) | (hashed >> np.uint64(8))
        place = (hashed % np.uint64(bins)).astype(np.int64) if turn < bins else np.full(len(row), turn - bins)
        np.minimum.at(flat, row * bins + place, value)
        open_ = open_[(out[open_] == empty).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    rows = sketch.shape[1] // bands
    for band in range(bands):
        key = np.full(len(sketch), band + 1, np.uint64)
        for k in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, band * rows + k])
        keys[:, band] = key
    return keys.view(np.int64)


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, n, s1, s2, bands`` of every document; no signature and bands for an empty set."""

    def run(batches):
        forget_pieces()
        for batch in sliced(batches, "text", SKETCH_BYTES):
            elements, offsets = shingle_sets(batch.column("text"), size)
            n = np.diff(offsets)
            keys = band_keys(sketches(elements, offsets))
            signs = [signature(elements[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            blank = pa.array(n == 0)
            none = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(n),
                    pc.if_else(blank, none, pa.array([s[0] for s in signs], pa.int64())),
                    pc.if_else(blank, none, pa.array([s[1] for s in signs], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.reshape(-1))),
                ],
                names=["id", "n", "s1", "s2", "bands"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _grouped(batches, names: list[str]):
    """Runs of rows with equal ``names``, whole, from batches sorted by them."""
    forget_pieces()
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(k[lo] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    release_memory()


def _sets_of(table: pa.Table, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sets of a group's rows; rows whose text isn't the one meant are left out."""
    elements, offsets = shingle_sets(table["text"].combine_chunks(), size)
    sets = [elements[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    meant = table["s1"].to_pylist()
    keep = [k for k, s in enumerate(sets) if signature(s)[0] == meant[k]]
    return table["id"].to_numpy()[keep], [sets[k] for k in keep]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, as products of incidence matrices."""
    sizes = np.array([len(s) for s in (*left, *right)])
    _, index = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    often = np.bincount(index) > 1
    dense = np.cumsum(often) - 1
    real = often[index]
    row = np.repeat(np.arange(len(sizes)), sizes)[real]
    column = dense[index[real]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        matrix = np.zeros((len(sizes), width), np.float32)
        matrix[row[a:b], column[a:b] - low] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out.astype(np.int64)


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _attach_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")


def _star_links(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Confirmed links among ``hub, hub_s1, id, s1``: a hub's members in salted groups."""
    salts = pairs.groupBy("hub", "hub_s1").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    spokes = pairs.join(salts.drop("hub_s1"), "hub").select(
        "hub", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.lit(1).alias("role"), "id", "s1"
    )
    hubs = salts.select(
        "hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"),
        F.col("hub").alias("id"), F.col("hub_s1").alias("s1"),
    )
    rows = _attach_texts(docs, spokes.unionByName(hubs), id_col, text_col)

    def run(batches):
        for table in _grouped(batches, ["hub", "salt"]):
            table = table.sort_by([("role", "ascending")])
            ids, sets = _sets_of(table, size)
            hub = table["hub"][0].as_py()
            if not len(ids) or ids[0] != hub or len(ids) < 2:
                continue
            sizes = np.array([len(s) for s in sets])
            every = np.concatenate(sets[1:])
            at = np.minimum(np.searchsorted(sets[0], every), len(sets[0]) - 1)
            hit = np.concatenate([[0], np.cumsum(sets[0][at] == every)])
            ends = np.cumsum(sizes[1:])
            common = hit[ends] - hit[ends - sizes[1:]]
            linked = ids[1:][similar(common, sizes[1:], sizes[0])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), hub)), pa.array(linked)], names=["u", "v"])

    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt").mapInArrow(run, "u bigint, v bigint")


def _block_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Links across components among ``key, id, s1, component``, members of the same bucket.

    ``rest`` members (outside the largest component) meet each other and all ``main`` ones in
    blocks of about ``GROUP`` each; blocks of main members never meet each other.
    """
    by_component = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = by_component.groupBy("key").agg(
        F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all")
    ).select(
        "key", F.col("top.component").alias("largest"),
        F.when(F.col("all") <= 2 * GROUP, 0).otherwise(F.ceil(F.col("top.c") / GROUP)).alias("mains"),
        F.when(F.col("all") <= 2 * GROUP, 1).otherwise(F.ceil((F.col("all") - F.col("top.c")) / GROUP)).alias("rests"),
    )
    # a bucket of up to two blocks is one block of "rest"; beyond, see above
    tagged = members.join(largest, "key").withColumn("main", (F.col("component") == F.col("largest")) & (F.col("mains") > 0))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    zero = F.lit(0).cast("bigint")

    def task(x, y, side):
        return F.struct(x.alias("x"), y.alias("y"), side.alias("side"))

    # tasks (x, y): rest block x against rest block y >= x, or against main block -1 - y
    as_main = F.transform(F.sequence(zero, F.col("rests") - 1), lambda x: task(x, -1 - F.col("own"), F.lit(1)))
    with_rest = F.transform(
        F.sequence(zero, F.col("rests") - 1),
        lambda k: task(F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.when(k < F.col("own"), 1).otherwise(0)),
    )
    with_main = F.when(
        F.col("mains") > 0, F.transform(F.sequence(zero, F.col("mains") - 1), lambda k: task(F.col("own"), -1 - k, F.lit(0)))
    ).otherwise(F.array().cast("array<struct<x:bigint,y:bigint,side:int>>"))
    tasks = F.when(F.col("main"), as_main).otherwise(F.concat(with_rest, with_main))
    wanted = tagged.withColumn("own", own).select("key", "id", "s1", "component", F.inline(tasks))
    rows = _attach_texts(docs, wanted, id_col, text_col)

    def run(batches):
        for table in _grouped(batches, ["key", "x", "y"]):
            table = table.sort_by([("side", "ascending")])
            ids, sets = _sets_of(table, size)
            if len(ids) < 2:
                continue
            component = dict(zip(table["id"].to_pylist(), table["component"].to_pylist()))
            label = np.array([component[i] for i in ids.tolist()])
            side = dict(zip(table["id"].to_pylist(), table["side"].to_pylist()))
            first = np.array([side[i] == 0 for i in ids.tolist()])
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(b):
                b = a
            sizes = np.array([len(s) for s in sets])
            common = _common([sets[k] for k in a], [sets[k] for k in b])
            u, v = np.nonzero(similar(common, sizes[a][:, None], sizes[b][None, :]) & (label[a][:, None] != label[b][None, :]))
            # one link for each pair of components suffices
            pair = np.stack([np.minimum(label[a][u], label[b][v]), np.maximum(label[a][u], label[b][v])], axis=1)
            _, kept = np.unique(pair, axis=0, return_index=True) if len(pair) else (None, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a][u[kept]]), pa.array(ids[b][v[kept]])], names=["u", "v"])

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    prepare(docs.sparkSession)
    marked = cut_lineage(sketch_documents(docs, id_col, text_col, shingle_words))
    names = marked.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    # a null id can't name a node: such a row joins its copies' node, or stays alone
    nodes = cut_lineage(
        marked.alias("m").join(names.alias("r"), ["s1", "s2"]).where("id = rep").dropDuplicates(["s1", "s2"])
        .select("id", "n", "s1", "bands")
    )
    members = nodes.select("id", "s1", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id").alias("order"), "id", "s1", "n")).alias("hub")
    ).where("size > 1")
    shared = cut_lineage(members.join(buckets, "key"))
    close = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * PERCENT
    pairs = cut_lineage(
        shared.where((F.col("id") != F.col("hub.id")) & close)
        .select(F.col("hub.id").alias("hub"), F.col("hub.s1").alias("hub_s1"), "id", "s1").distinct()
    )
    stars = cut_lineage(_star_links(docs, pairs, id_col, text_col, shingle_words))
    joined = connected_components(nodes.select("id"), stars)

    left = shared.where("size > 2").join(joined, "id").select("key", "id", "s1", "size", "component")
    left = cut_lineage(left)
    apart = left.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.first("size").alias("size")
    ).where("low <> high")
    once = apart.groupBy("who", "size").agg(F.min("key").alias("key")).select("key")  # the same members in several bands
    blocks = cut_lineage(_block_links(docs, left.join(once, "key"), id_col, text_col, shingle_words))
    final = connected_components(nodes.select("id"), stars.unionByName(blocks))

    return (
        marked.select("id", "n", "s1", "s2").join(names, ["s1", "s2"], "left")
        .join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.coalesce("component", "rep", "id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
