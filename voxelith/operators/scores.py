"""Score-store operators: best rows, threshold transfer, ranks, spreads, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# For these metrics smaller is better, for the rest larger is.
SMALLER_IS_BETTER = ("voi", "voi_split", "voi_merge")


def best_points(scores: DataFrame, metric: str, keys: list[str], point: str = "pct") -> DataFrame:
    """``keys, point, metric``: best row of every key in one aggregate, without a sort."""
    sign = 1 if metric in SMALLER_IS_BETTER else -1
    best = F.min(F.struct((F.col(metric) * sign).alias("v"), F.col(point).alias("p"))).alias("b")
    return scores.groupBy(*keys).agg(best).select(
        *keys, F.col("b.p").alias(point), (F.col("b.v") * sign).alias(metric)
    )


def running_best(scores: DataFrame, metric: str, keys: list[str], point: str = "pct") -> DataFrame:
    """Best value so far along the sweep; a window holds one setup's sweep points only."""
    window = Window.partitionBy(*keys).orderBy(point).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min if metric in SMALLER_IS_BETTER else F.max
    return scores.select(*keys, point, metric, best(metric).over(window).alias(f"best_{metric}"))


def transfer(
    scores: DataFrame,
    tuning: str,
    metrics: list[str],
    tune_split: str = "val",
    report_split: str = "test",
) -> DataFrame:
    """Tune the threshold on one split and report the other split's metrics at that threshold."""
    chosen = best_points(scores.where(F.col("split") == tune_split), tuning, ["setup"]).select("setup", "pct")
    report = scores.where(F.col("split") == report_split).select("setup", "pct", *metrics)
    return chosen.join(report, ["setup", "pct"])


def summary_rows(scores: DataFrame, tuning: str = "voi") -> DataFrame:
    """Long form of the tuned summary document: ``setup, metric, split, value``.

    ``val``/``test`` hold the best threshold per split, ``test_best_val_threshold`` the test
    score at the tuned validation threshold.
    """
    rows = None
    for metric in ("voi", "erl"):
        part = best_points(scores, metric, ["setup", "split"]).select(
            "setup", F.lit(metric).alias("metric"), "split", F.col("pct").cast("double").alias("value")
        )
        rows = part if rows is None else rows.unionByName(part)
    metrics = ["voi", "voi_split", "voi_merge", "erl"]
    tuned = transfer(scores, tuning, metrics)
    flat = tuned.select(
        "setup",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("e"),
    )
    return rows.unionByName(
        flat.select("setup", "e.metric", F.lit("test_best_val_threshold").alias("split"), "e.value")
    )


def nested_summary(rows: DataFrame) -> DataFrame:
    """Document form: ``setup, doc MAP<metric, MAP<split, value>>``; a few entries per setup."""
    inner = rows.groupBy("setup", "metric").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "value")))).alias("m")
    )
    return inner.groupBy("setup").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "m"))).alias("doc")
    )


def ingroup_rank(results: DataFrame, group: str = "group_name", metric: str = "erl") -> DataFrame:
    """1 + number of strictly better runs of the same group."""
    window = Window.partitionBy(group).orderBy(F.desc(metric))
    return results.withColumn("ingroup_rank", F.rank().over(window).cast("bigint"))


def group_std(results: DataFrame, metrics: list[str], group: str = "group_name") -> DataFrame:
    """Sample standard deviation (ddof 1) per group, null for single runs."""
    return results.groupBy(group).agg(*[F.round(F.stddev_samp(m), 3).alias(f"{m}_std") for m in metrics])


def mean_report(reports: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column; other columns are skipped."""
    numeric = [
        c for c, t in reports.dtypes
        if c not in (keys or []) and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    ]
    return reports.groupBy(*(keys or [])).agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in numeric])


def per_cube(reports: DataFrame, metric: str, cube: str, cubes: list[str]) -> DataFrame:
    """One column ``metric_cube`` per named cube."""
    wide = reports.groupBy().pivot(cube, cubes).agg(F.round(F.avg(metric), 6))
    return wide.select(*[F.col(c).alias(f"{metric}_{c}") for c in cubes])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace whole rows by key (null keys are equal), insert the rest.

    Of several new rows with one key the last counts.
    """
    every = new.withColumn("__order", F.monotonically_increasing_id())
    new = every.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*new.columns), "__order").alias("row")).select("row.*")
    same = None
    for k in keys:
        test = F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = test if same is None else same & test
    kept = existing.alias("e").join(new.select(*keys).alias("n"), same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def latex_row(group: str = "group_name") -> Column:
    """``group\\textsubscript{rank} & erl & voi & voi_merge & voi_split \\\\`` with two decimals."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    return F.concat(
        F.col(group), F.lit("\\textsubscript{"), F.col("ingroup_rank").cast("string"), F.lit("} & "),
        F.concat_ws(" & ", *[two(F.col(c)) for c in ("erl", "voi", "voi_merge", "voi_split")]),
        F.lit(" \\\\"),
    )
