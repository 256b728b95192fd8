"""Cross-document line frequency.

Lines are normalised (lower case, everything but letters made one space; a line without letters
keeps its digits and marks) and hashed. For each host the distinct documents of each line are
counted. A line of any length that more than ``limit`` documents of its host hold is boilerplate
and removed; a document whose words are depleted by that, below ``least_words`` words or ``least_share`` of what it had,
is rejected.

Counts cover all documents. Lines of a document count once; repeated rows of a document count as
that document. Counting combines before the shuffle, and only lines above the limit are joined
back, with the document side free to be split where a line is very frequent. Only DataFrame
functions are used.

Also here: the per-document rules on words, symbols and repetition.

Defined results: a null or empty text has no words and no lines (and is rejected as too short);
a null host is a host of its own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.session import cut_lineage

LIMIT = 20  # documents of a host
LEAST_SHARE = 0.3
LEAST_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\f\r "


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def normalised(line: Column) -> Column:
    """Letters in lower case; a line without letters keeps its digits and marks."""
    return _let(
        F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " ")),
        lambda letters: F.when(letters != "", letters).otherwise(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))),
    )


def repeated_words(words_: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows that occur at least twice in the text."""

    def count(hashes: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        windows = F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, window)))
        return F.when(F.size(hashes) <= window, 0).otherwise(_let(windows, covered))

    def covered(windows: Column) -> Column:
        # most texts repeat nothing, and need no sorting
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at")))), union)
        )

    def union(places: Column) -> Column:
        # equal windows are neighbours; get() gives null beyond the ends
        twice = F.filter(places, lambda p, i: (
            F.coalesce(F.get(places, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(places, i + 1)["h"] == p["h"], F.lit(False))
        ))
        at = F.sort_array(F.transform(twice, lambda p: p["at"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda s, a: F.struct(
            (a + window).alias("end"), (s["n"] + a + window - F.greatest(s["end"], a)).alias("n")
        ), lambda s: s["n"])

    return _let(F.transform(words_, lambda w: F.xxhash64(w)), count).cast("bigint")


def base_rules(text: Column) -> Column:
    """Struct ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    dup_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return _let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(whole, SPACES, "")).cast("bigint").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            dup_lines.cast("bigint").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def lines_of(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """``doc, mark, host, line, words``: distinct normalised lines of every document.

    ``mark`` is a hash of the text, as ids may repeat; ``words`` counts all words of the lines that
    are this one.
    """
    each = (
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(host_col).alias("host"), F.explode(F.split(text_col, "\n")).alias("raw"))
        .select("doc", "mark", "host", normalised(F.col("raw")).alias("norm"), F.size(words(F.col("raw"))).alias("w"))
        .where(F.col("norm") != "")
    )
    return each.select("doc", "mark", "host", F.xxhash64("norm").alias("line"), "w")


def frequent_lines(lines: DataFrame, limit: int) -> DataFrame:
    """``host, line`` of lines in more than ``limit`` distinct documents of a host."""
    return (
        lines.select("host", "line", "doc", "mark").distinct()
        .groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limit)
    )


def judge(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: int = LIMIT,
    least_share: float = LEAST_SHARE, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Per row of ``docs``: its id, the base rules, ``removed_words``, ``base_failed`` and ``kept``."""
    lines = cut_lineage(lines_of(docs, id_col, host_col, text_col))  # read for the counts and for the join
    common = frequent_lines(lines, limit)
    same_line = F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.line") == F.col("c.line"))
    # identical rows hold the same lines: a row's own count is the sum over them by their number
    removed = (
        lines.alias("l").join(common.alias("c"), same_line)
        .groupBy("l.doc", "l.mark", "l.host").agg(F.sum("w").alias("removed"))
    )
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("mark"), base_rules(F.col(text_col)).alias("r")
    ).select("doc_id", "host", "mark", "r.*")
    copies = base.groupBy("doc_id", "mark", "host").agg(F.count("*").alias("copies")).where("copies > 1")
    key = F.col("b.doc_id").eqNullSafe(F.col("x.doc")) & (F.col("b.mark") == F.col("x.mark")) & F.col("b.host").eqNullSafe(F.col("x.host"))
    again = removed.alias("x").join(
        copies.alias("y"),
        F.col("x.doc").eqNullSafe(F.col("y.doc_id")) & (F.col("x.mark") == F.col("y.mark")) & F.col("x.host").eqNullSafe(F.col("y.host")), "left",
    ).select("x.doc", "x.mark", "x.host", (F.col("removed") / F.coalesce("copies", F.lit(1))).cast("bigint").alias("removed"))
    judged = base.alias("b").join(again.alias("x"), key, "left").select(
        "b.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("removed", F.lit(0).cast("bigint")).alias("removed_words")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    left = F.col("n_words") - F.col("removed_words")
    enough = (left >= least_words) & (left >= F.col("n_words") * least_share)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)
