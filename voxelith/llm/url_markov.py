"""URL filter: rules first, then the ratio of two character language models.

Rules name a host with its subdomains and the start of the path; the longest that fits decides.
URLs that a rule decides are the models' examples: accepted and rejected ones. Each model is a
variable-order Markov chain over characters: the probability of a character after up to
``ORDER`` others is the count in the longest context smoothed towards that of the next shorter
one, down to single characters and the uniform distribution, so contexts never seen leave the
word to shorter ones.

A URL's score is the difference of the two log-likelihoods by its number of characters. A quarter
of the examples, chosen by a hash, isn't learned from; on it the score's threshold is calibrated
to the largest sum of the shares of accepted URLs above and rejected ones below.

Counts cover all URLs. Work is done once for each distinct URL; the model is worked out on
distinct character n-grams, which grow far slower than URLs, and is joined to the positions of
the URLs. Only DataFrame functions are used.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is scored as the empty text; without examples of both kinds the threshold is 0 (what is not less
likely to be accepted is allowed); repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.session import cut_lineage

ORDER = 3
WEIGHT = 2.0  # of the shorter context, in counts
ALPHABET = 128
BINS_PER_UNIT, LARGEST_BIN = 100, 1000
CALIBRATION = "4"  # first digit of the URL's MD5 below this: held for the calibration
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(url: Column, order: int) -> Column:
    """Every character with the ``order`` before it, and an end mark."""
    text = F.concat(F.lit("\x02" * order), F.translate(rest(url), UPPER, LOWER), F.lit("\x03"))
    return F.transform(F.array(text), lambda t: F.transform(
        F.sequence(F.lit(1), F.length(t) - order), lambda i: F.substring(t, i, F.lit(order + 1))
    ))[0]


def log_ratios(counts: DataFrame, order: int, weight: float = WEIGHT) -> DataFrame:
    """``gram, ratio`` from ``gram, accepted, rejected`` over all distinct grams."""
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    model = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
        )
        if k == 0:
            of_context = [F.lit(float(total["a"] or 0)), F.lit(float(total["r"] or 0))]
            shorter = [F.lit(1.0 / ALPHABET)] * 2
        else:
            contexts = level.groupBy(F.substring("gram", 1, k).alias("context")).agg(F.sum("accepted").alias("ca"), F.sum("rejected").alias("cr"))
            level = (
                level.withColumn("context", F.substring("gram", 1, k)).join(contexts, "context")
                .withColumn("suffix", F.substring("gram", 2, k)).join(model.select(F.col("gram").alias("suffix"), "pa", "pr"), "suffix")
            )
            of_context = [F.col("ca"), F.col("cr")]
            shorter = [F.col("pa"), F.col("pr")]
        model = level.select(
            "gram", ((F.col("accepted") + weight * shorter[0]) / (of_context[0] + weight)).alias("pa"),
            ((F.col("rejected") + weight * shorter[1]) / (of_context[1] + weight)).alias("pr"),
        )
    return model.select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def judge(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", order: int = ORDER
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score_bin`` of every page (the bin where no rule fits)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    url = F.col("url")
    name, verdict = rule_of(host(url), path(url), rules)
    text = F.coalesce(url, F.lit(""))
    distinct = rows.select(text.alias("url")).groupBy("url").agg(F.count("*").alias("n")).select("url", verdict.alias("label"), (F.substring(F.md5("url"), 1, 1) < CALIBRATION).alias("held"))
    learned = F.col("label").isNotNull() & ~F.col("held")
    scored = F.col("label").isNull() | F.col("held")
    places = distinct.select("url", "label", "held", F.explode(grams(url, order)).alias("gram"))
    counts = places.groupBy("gram").agg(
        F.sum(F.when(learned & (F.col("label") == "allow"), 1).otherwise(0)).alias("accepted"),
        F.sum(F.when(learned & (F.col("label") == "block"), 1).otherwise(0)).alias("rejected"),
    )
    ratios = log_ratios(counts, order)
    score = F.round(F.sum("ratio") / F.count("*"), 9)
    limit = F.lit(LARGEST_BIN)
    scores = cut_lineage(
        places.where(scored).join(ratios, "gram").groupBy("url").agg(score.alias("score"), F.first("label").alias("label"))
        .select("url", "label", F.greatest(-limit, F.least(limit, F.floor(F.col("score") * BINS_PER_UNIT))).cast("bigint").alias("bin"))
    )
    # as many rows as there are bins
    bins = scores.where("label IS NOT NULL").groupBy("bin").agg(
        F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r")
    ).collect()
    threshold = calibrated({b["bin"]: (b["a"], b["r"]) for b in bins})
    judged = rows.select("page_id", "url", host(url).alias("host"), path(url).alias("path"), name.alias("rule"), verdict.alias("by_rule"))
    found = scores.where("label IS NULL").select(F.col("url").alias("own"), "bin")
    return judged.join(found, F.coalesce("url", F.lit("")) == F.col("own"), "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("by_rule", F.when(F.col("bin") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.col("bin").alias("score_bin"),
    )


def calibrated(bins: dict[int, tuple[int, int]]) -> int:
    """The bin from which on URLs are allowed; of equally good ones the nearest to 0, then the smaller.

    ``bins`` has the numbers of accepted and rejected URLs by bin.
    """
    accepted, rejected = sum(a for a, _ in bins.values()), sum(r for _, r in bins.values())
    if not accepted or not rejected:
        return 0
    best, below_a, below_r, before = None, 0, 0, None
    for bin_ in sorted(bins):
        gain = (accepted - below_a) / accepted + below_r / rejected
        # thresholds from behind the bin before to this one are equally good
        at = min(bin_, 0) if before is None else max(before + 1, min(bin_, 0))
        if best is None or (-gain, abs(at), at) < best:
            best = (-gain, abs(at), at)
        below_a, below_r, before = below_a + bins[bin_][0], below_r + bins[bin_][1], bin_
    return best[2]
