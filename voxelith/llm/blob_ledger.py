"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content (the blob id). A ledger
remembers which blob was scanned under which rule version, and what was found. A scan looks only
at (blob, rule version) pairs that the ledger hasn't seen, one text for each blob, and findings
are joined back to all paths and versions that hold the blob.

Rules are regular expressions over the whole text, leftmost and not overlapping for each kind,
with a least length for one group; a match that is too short is dropped after it was consumed.
Spans are in code points, end exclusive. Only DataFrame functions are used.

Defined results: a null text is the empty blob; repeated rows share a blob and its findings; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    base: bool = True

    @property
    def version(self) -> str:
        return f"{self.kind}/{self.group}/{self.least}/{self.pattern}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")

BASE_RULES = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # a run that starts at its first place can only be too short as a whole, so the least length
    # may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Rule("bearer", rf"{either_case('bearer')}\x20+[A-Za-z0-9._~+/-]{{20,}}=*", base=False),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]{3,}@", base=False),
]
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"
LEDGER = "blob string, rule string, spans array<struct<start:bigint,stop:bigint>>"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of ``start, stop`` of a rule's matches.

    The gaps between matches come from ``split``, the matches themselves from
    ``regexp_extract_all``: their lengths add up to the places.
    """
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        grown = F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"))))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(F.length(x["part"]) >= rule.least, grown).otherwise(state["out"]).alias("out"))

    placed = F.aggregate(found, start, step, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), placed).otherwise(start["out"])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def address(versions: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, blob, text`` of every version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(*keys, F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_unseen(addressed: DataFrame, keys: list[str], rules: list[Rule], ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs that the ledger lacks.

    One version stands for each blob: which one is agreed on ids alone, so texts move once.
    """
    first = addressed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("first"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        todo = first.withColumn("todo", wanted)
    else:
        known = ledger.where(F.col("rule").isin([r.version for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        todo = first.join(known, "blob", "left").withColumn(
            "todo", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
        ).where(F.size("todo") > 0).drop("known")
    same = F.col("a.blob") == F.col("f.blob")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"f.first.{k}"))
    text = F.col("a.text")
    nothing = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    results = [
        F.struct(F.lit(r.version).alias("rule"), F.when(F.array_contains("f.todo", r.version), spans_of(text, r)).otherwise(nothing).alias("spans"))
        for r in rules
    ]
    return (
        addressed.alias("a").join(todo.alias("f"), same)
        .select(F.col("a.blob").alias("blob"), F.array(*results).alias("results"))
        # only rows repeated with all their keys can still give a blob twice
        .dropDuplicates(["blob"])
        .select("blob", F.inline(F.filter("results", lambda x: x["spans"].isNotNull())))
    )


def update_ledger(ledger_path: str, versions: DataFrame, keys: list[str], rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Scan what a stored ledger lacks, append it there, and return the whole ledger.

    Rows are first stored, so the scan never appends to the table it reads; a repeated append
    after a failure adds nothing, as its pairs are then known.
    """
    spark = versions.sparkSession
    addressed = address(versions, keys, text_col)
    try:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = None
    cut_lineage(scan_unseen(addressed, keys, rules, ledger)).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def blob_spans(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """``blob, found``: all spans of a blob under these rule versions, by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    rows = ledger.where(F.col("rule").isin([r.version for r in rules]) & (F.size("spans") > 0))
    tagged = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("rank"), kind[F.col("rule")].alias("kind"), s["stop"].alias("stop")))
    # as many rows a blob as there are rules
    return rows.select("blob", tagged.alias("tagged")).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("tagged"))).alias("found"))


def findings(addressed: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings joined back to every version: its columns and ``found`` (empty where nothing was)."""
    none = F.array().cast(f"array<{SPAN}>")
    return addressed.join(blob_spans(ledger, rules), "blob", "left").withColumn("found", F.coalesce("found", none))


def written(found: Column) -> Column:
    """Spans as text ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by ``[kind]``; overlapping spans become one."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        add = F.when(x["start"] >= s["at"], F.concat(gap, F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.concat(s["out"], add).alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(
        F.aggregate(found, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    )
