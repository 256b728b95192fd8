"""Benchmark decontamination by winnowing.

Every document and item is a sequence of words. Its ``k``-grams are hashed; of every ``w``
consecutive k-gram hashes the smallest is kept as a fingerprint. A span of at least ``k + w - 1``
words that two texts share covers the same ``w`` hashes in both, hence shares a fingerprint. With
``k = 5`` and windows of 10 words, ``w = 6``: no shared window can be missed. An item of fewer
words than a window is one window of its own length ``m``; for each such length all ``m``-grams
are fingerprints (``k = m``, ``w = 1``).

Fingerprints of documents are joined with those of the items. In documents with a hit, every hit
place is extended: the windows that contain it are compared word for word with the items'
windows, and all words inside a window that occurs are marked.

Only DataFrame functions are used. The items' side of each join is small as a rule, and Spark
broadcasts it only below its own limit; otherwise the join is a sort-merge join whose document
side can be split.

Defined results: null and empty texts have no words and no hits, an item without words has no
window; repeated documents and items are judged alike (items of equal text are all reported);
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.session import cut_lineage

WINDOW = 10
GRAM = 5

# ASCII letters lower-cased, all other ASCII but digits made a space
_FROM = "".join(chr(c) for c in range(128) if not ("0" <= chr(c) <= "9" or "a" <= chr(c) <= "z" or chr(c) == " "))
_TO = "".join(chr(c).lower() if "A" <= chr(c) <= "Z" else " " for c in map(ord, _FROM))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A column used inside another lambda would be evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def _range(n: Column) -> Column:
    """1 to ``n``; empty below 1."""
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)


def gram_hashes(words_: Column, k: int) -> Column:
    """Hash of the k-gram at every place."""
    return _let(
        F.transform(words_, lambda w: F.xxhash64(w)),
        lambda h: F.transform(_range(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))),
    )


def fingerprints(grams: Column, w: int) -> Column:
    """Distinct smallest hashes of all runs of ``w`` k-grams."""
    if w == 1:
        return F.array_distinct(grams)
    return _let(
        grams, lambda g: F.array_distinct(F.transform(_range(F.size(g) - (w - 1)), lambda i: F.array_min(F.slice(g, i, w))))
    )


def windows_of_items(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, size, words`` of every distinct window of every item."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    cut = _let(
        F.struct(F.col("words").alias("w"), size.alias("size")),
        lambda s: F.array_distinct(F.transform(
            _range(F.size(s["w"]) - s["size"] + 1), lambda i: F.array_join(F.slice(s["w"], i, s["size"]), " ")
        )),
    )
    return rows.select("item", size.alias("size"), F.explode(cut).alias("words"))


def hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Occurrences ``doc, mark, at, size, item``: item windows found in documents.

    ``doc, mark`` name a document: its id and a hash of its text, as ids may be repeated. Places
    count words from 1.
    """
    item_windows = cut_lineage(windows_of_items(items, item_col, item_text_col, window))
    short = [r[0] for r in item_windows.where(F.col("size") < window).select("size").distinct().collect()]  # at most 9
    plans = [(window, gram, window - gram + 1)] + [(m, m, 1) for m in sorted(short)]

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), words(F.col(text_col)).alias("words"))
    found = None
    for size, k, w in plans:
        of_items = (
            item_windows.where(F.col("size") == size)
            .select(F.explode(fingerprints(gram_hashes(F.split("words", " "), k), w)).alias("print")).distinct()
        )
        part = (
            rows.where(F.size("words") >= size).select("doc", "mark", F.explode(fingerprints(gram_hashes(F.col("words"), k), w)).alias("print"))
            .join(of_items, "print").select("doc", "mark", F.lit(size).alias("size"), "print")
        )
        found = part if found is None else found.unionByName(part)
    # repeated rows give the same prints once
    candidates = cut_lineage(found.groupBy("doc", "mark", "size").agg(F.collect_set("print").alias("prints")))

    same = F.col("r.doc").eqNullSafe(F.col("c.doc")) & (F.col("r.mark") == F.col("c.mark"))
    near = rows.alias("r").join(candidates.alias("c"), same).select("r.doc", "r.mark", "r.words", "c.size", "c.prints")
    places = None
    for size, k, _ in plans:

        def extended(s: Column) -> Column:
            """Windows that contain a k-gram with a shared print: their places and words."""
            grams = F.transform(gram_hashes(s["words"], k), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at")))
            shared = F.filter(grams, lambda g: F.array_contains(s["prints"], g["h"]))
            starts = F.transform(
                shared, lambda g: F.sequence(F.greatest(g["at"] - (size - k), F.lit(1)), F.least(g["at"], F.size(s["words"]) - (size - 1)))
            )
            return F.transform(
                F.array_distinct(F.flatten(starts)),
                lambda i: F.struct(i.alias("at"), F.array_join(F.slice(s["words"], i, size), " ").alias("words")),
            )

        at = _let(F.struct("words", "prints"), extended)
        part = near.where(F.col("size") == size).select("doc", "mark", "size", F.inline(at))
        places = part if places is None else places.unionByName(part)
    # before the join: a repeated row would repeat its places
    places = places.dropDuplicates(["doc", "mark", "size", "at"])
    return places.join(item_windows, ["size", "words"]).select("doc", "mark", "at", "size", "item")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc, mark, n_hit, items`` of every document with a hit; ``items`` sorted as strings."""
    found = cut_lineage(hits(docs, items, id_col, text_col, item_col, item_text_col))
    spans = found.groupBy("doc", "mark", "at").agg(F.max("size").alias("size"))
    # places of one document: no more than it has words
    union = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "size"))),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], (x["at"] + x["size"]).cast("bigint")).alias("end"),
            (s["n"] + F.greatest(x["at"] + x["size"] - F.greatest(s["end"], x["at"].cast("bigint")), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )
    n_hit = spans.groupBy("doc", "mark").agg(union.alias("n_hit"))
    of_items = found.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = F.col("h.doc").eqNullSafe(F.col("i.doc")) & (F.col("h.mark") == F.col("i.mark"))
    return n_hit.alias("h").join(of_items.alias("i"), same).select("h.doc", "h.mark", "n_hit", "items")
