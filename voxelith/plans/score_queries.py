"""Queries over the score store, run catalogue, names and configuration values."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions import strings
from voxelith.operators import scores
from voxelith.plans import domain
from voxelith.plans.domain import sql
from voxelith.plans.registry import query
from voxelith.session import cut_lineage
from voxelith.sources.tables import table


@query(
    "best_voi_threshold",
    sql("reports", body="""SELECT setup, pct, voi FROM reports WHERE split = 'val'
      QUALIFY row_number() OVER (PARTITION BY setup ORDER BY voi, pct) = 1"""),
)
def best_voi_threshold(spark, root):
    return scores.best_points(domain.reports(spark, root).where("split = 'val'"), "voi", ["setup"])


@query(
    "best_erl_threshold",
    sql("reports", body="""SELECT setup, pct, erl FROM reports WHERE split = 'val'
      QUALIFY row_number() OVER (PARTITION BY setup ORDER BY erl DESC, pct) = 1"""),
)
def best_erl_threshold(spark, root):
    return scores.best_points(domain.reports(spark, root).where("split = 'val'"), "erl", ["setup"])


@query(
    "running_best",
    sql("reports", body="""SELECT setup, split, pct, voi,
      min(voi) OVER (PARTITION BY setup, split ORDER BY pct ROWS UNBOUNDED PRECEDING) AS best_voi FROM reports"""),
)
def running_best(spark, root):
    return scores.running_best(domain.reports(spark, root), "voi", ["setup", "split"])


TRANSFER = """tuned AS (SELECT r.setup, r.pct, r.erl, r.voi, r.voi_split, r.voi_merge FROM reports r JOIN
  (SELECT setup, pct FROM reports WHERE split = 'val'
   QUALIFY row_number() OVER (PARTITION BY setup ORDER BY {order}, pct) = 1) b
  ON b.setup = r.setup AND b.pct = r.pct WHERE r.split = 'test')"""
METRICS = ["erl", "voi", "voi_split", "voi_merge"]


@query("val_to_test_transfer", sql("reports", TRANSFER.format(order="erl DESC"), body="SELECT * FROM tuned"))
def val_to_test_transfer(spark, root):
    return scores.transfer(domain.reports(spark, root), "erl", METRICS)


@query("val_to_test_transfer_voi", sql("reports", TRANSFER.format(order="voi"), body="SELECT * FROM tuned"))
def val_to_test_transfer_voi(spark, root):
    return scores.transfer(domain.reports(spark, root), "voi", METRICS)


@query(
    "tuned_summary",
    sql("reports", TRANSFER.format(order="voi"), body="""
      SELECT setup, 'voi' AS metric, split, pct::DOUBLE AS value FROM reports
        QUALIFY row_number() OVER (PARTITION BY setup, split ORDER BY voi, pct) = 1
      UNION ALL SELECT setup, 'erl', split, pct::DOUBLE FROM reports
        QUALIFY row_number() OVER (PARTITION BY setup, split ORDER BY erl DESC, pct) = 1
      UNION ALL SELECT setup, 'voi', 'test_best_val_threshold', voi FROM tuned
      UNION ALL SELECT setup, 'voi_split', 'test_best_val_threshold', voi_split FROM tuned
      UNION ALL SELECT setup, 'voi_merge', 'test_best_val_threshold', voi_merge FROM tuned
      UNION ALL SELECT setup, 'erl', 'test_best_val_threshold', erl::DOUBLE FROM tuned"""),
)
def tuned_summary(spark, root):
    return scores.summary_rows(cut_lineage(domain.reports(spark, root)), "voi")


@query(
    "scores_nested_field",
    sql("reports", TRANSFER.format(order="voi"), body="""SELECT e.setup, e.pct::DOUBLE AS erl_val, t.erl::DOUBLE AS erl_test
      FROM (SELECT setup, pct FROM reports WHERE split = 'val'
        QUALIFY row_number() OVER (PARTITION BY setup ORDER BY erl DESC, pct) = 1) e
      LEFT JOIN tuned t ON t.setup = e.setup"""),
)
def scores_nested_field(spark, root):
    """Nested document fields projected by path."""
    docs = scores.nested_summary(scores.summary_rows(cut_lineage(domain.reports(spark, root)), "voi"))
    return docs.select(
        "setup",
        F.col("doc")["erl"]["val"].alias("erl_val"),
        F.col("doc")["erl"]["test_best_val_threshold"].alias("erl_test"),
    ).where("erl_val IS NOT NULL")


GROUPED = """grouped AS (SELECT c.group_name, c.run_name, t.setup, t.pct, t.erl / 1000.0 AS erl, t.voi, t.voi_merge, t.voi_split
  FROM catalogue c JOIN tuned t ON t.setup = c.setup WHERE c.setup IS NOT NULL)"""
GROUP_PARTS = ("reports", "catalogue", TRANSFER.format(order="erl DESC"), GROUPED)


def grouped(spark, root):
    """Tuned test scores with their group; runs without a score database are skipped."""
    runs = domain.run_catalogue(spark, root).where("setup IS NOT NULL")
    tuned = scores.transfer(domain.reports(spark, root), "erl", METRICS)
    return runs.join(tuned, "setup").select(
        "group_name", "run_name", "setup", "pct", (F.col("erl") / 1000.0).alias("erl"), "voi", "voi_merge", "voi_split"
    )


@query("group_catalogue_flatten", sql("catalogue", body="SELECT * FROM catalogue WHERE setup IS NOT NULL"))
def group_catalogue_flatten(spark, root):
    """Catalogue held as group -> {run -> score db}: exploded back to rows, nulls skipped.

    A group holds at most three runs, so the nested form is small per row.
    """
    nested = domain.run_catalogue(spark, root).groupBy("group_name").agg(
        F.map_from_entries(F.collect_list(F.struct("run_name", "setup"))).alias("runs")
    )
    return nested.select("group_name", F.explode("runs").alias("run_name", "setup")).where("setup IS NOT NULL")


@query("grouped_scores", sql(*GROUP_PARTS, body="SELECT * FROM grouped"))
def grouped_scores(spark, root):
    return grouped(spark, root)


@query(
    "ingroup_rank",
    sql(*GROUP_PARTS, body="""SELECT group_name, setup, erl,
      (SELECT 1 + count(*) FROM grouped o WHERE o.group_name = g.group_name AND o.erl > g.erl) AS ingroup_rank FROM grouped g"""),
)
def ingroup_rank(spark, root):
    return scores.ingroup_rank(grouped(spark, root)).select("group_name", "setup", "erl", "ingroup_rank")


@query(
    "group_std",
    sql(*GROUP_PARTS, body="""SELECT group_name, round(stddev_samp(erl), 3) AS erl_std, round(stddev_samp(voi), 3) AS voi_std
      FROM grouped GROUP BY group_name"""),
)
def group_std(spark, root):
    return scores.group_std(grouped(spark, root), ["erl", "voi"])


def _two(c: str) -> str:
    return f"printf('%.2f', round(CAST({c} AS DECIMAL(20,6)), 2)::DOUBLE)"


@query(
    "latex_rows",
    sql(*GROUP_PARTS, body=f"""SELECT setup, group_name || '\\textsubscript{{' ||
      (SELECT 1 + count(*) FROM grouped o WHERE o.group_name = g.group_name AND o.erl > g.erl) || '}} & ' ||
      {_two('erl')} || ' & ' || {_two('voi')} || ' & ' || {_two('voi_merge')} || ' & ' || {_two('voi_split')} || ' \\\\' AS line
      FROM grouped g"""),
)
def latex_rows(spark, root):
    ranked = scores.ingroup_rank(grouped(spark, root))
    return ranked.select("setup", scores.latex_row().alias("line"))


@query(
    "mean_report",
    sql("reports", body="""SELECT split, round(avg(setup), 6) AS mean_setup, round(avg(pct), 6) AS mean_pct, round(avg(erl), 6) AS mean_erl,
      round(avg(voi), 6) AS mean_voi, round(avg(voi_split), 6) AS mean_voi_split, round(avg(voi_merge), 6) AS mean_voi_merge
      FROM reports GROUP BY split"""),
)
def mean_report(spark, root):
    return scores.mean_report(domain.reports(spark, root), ["split"])


@query(
    "per_cube_pivot",
    sql("reports", body="""SELECT round(avg(voi) FILTER (split = 'val'), 6) AS voi_val,
      round(avg(voi) FILTER (split = 'test'), 6) AS voi_test FROM reports"""),
)
def per_cube_pivot(spark, root):
    return scores.per_cube(domain.reports(spark, root), "voi", "split", ["val", "test"])


@query(
    "per_cube_metric_rows",
    sql("reports", body="SELECT 'voi_' || setup AS metric_cube, round(avg(voi), 6) AS value FROM reports GROUP BY setup"),
)
def per_cube_metric_rows(spark, root):
    return domain.reports(spark, root).groupBy("setup").agg(F.round(F.avg("voi"), 6).alias("value")).select(
        F.concat(F.lit("voi_"), F.col("setup").cast("string")).alias("metric_cube"), "value"
    )


@query("scores_projection", sql("reports", body="SELECT pct, voi, erl FROM reports WHERE split = 'val'"))
def scores_projection(spark, root):
    return domain.reports(spark, root).where("split = 'val'").select("pct", "voi", "erl")


@query("scores_regex", "SELECT s_suppkey AS setup, s_name AS name FROM supplier WHERE regexp_matches(s_name, '#0*[1-4][0-9]?$')")
def scores_regex(spark, root):
    return table(spark, root, "supplier", "s_suppkey", "s_name").where(F.col("s_name").rlike("#0*[1-4][0-9]?$")).select(
        F.col("s_suppkey").alias("setup"), F.col("s_name").alias("name")
    )


@query("scores_at_threshold", sql("reports", body="SELECT setup, split, erl, voi FROM reports WHERE pct = 29"))
def scores_at_threshold(spark, root):
    """Equality on the integer point, not on a float; the filter reaches the scan."""
    return domain.reports(spark, root).where("pct = 29").select("setup", "split", "erl", "voi")


@query("min_over_run", sql("reports", body="SELECT setup, min(voi) AS min_voi, min(voi_split) AS min_voi_split FROM reports GROUP BY setup"))
def min_over_run(spark, root):
    return domain.reports(spark, root).groupBy("setup").agg(
        F.min("voi").alias("min_voi"), F.min("voi_split").alias("min_voi_split")
    )


@query(
    "upsert_scores",
    """SELECT o_orderkey AS id, o_orderstatus AS run_type, o_totalprice AS value FROM orders
       WHERE o_orderpriority NOT LIKE '1%'
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice / 2 FROM orders WHERE o_orderpriority LIKE '1%'
       UNION ALL SELECT -1 - o_orderkey, NULL, o_totalprice / 2 FROM orders WHERE o_orderpriority LIKE '1%'""",
)
def upsert_scores(spark, root):
    """Half-price documents replace the urgent orders; new ids (with a null key part) are added."""
    existing = table(spark, root, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").toDF("id", "run_type", "value")
    urgent = table(spark, root, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").where(
        F.col("o_orderpriority").startswith("1")
    )
    half = (F.col("o_totalprice") / 2).alias("value")
    new = urgent.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("run_type"), half).unionByName(
        urgent.select((-1 - F.col("o_orderkey")).alias("id"), F.lit(None).cast("string").alias("run_type"), half)
    )
    return scores.upsert(existing, new, ["id", "run_type"])


# --- names and configuration values -----------------------------------------------------------

PATHS = """paths AS (SELECT s_suppkey, 'runs/' || lower(replace(s_name, '#', '_')) || '_nation_' || s_nationkey || '/model_' ||
  (s_suppkey * 500) || '.pth' AS path FROM supplier)"""


def model_paths(spark, root):
    return table(spark, root, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        "s_suppkey",
        F.concat(
            F.lit("runs/"), F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))), F.lit("_nation_"), F.col("s_nationkey").cast("string"),
            F.lit("/model_"), (F.col("s_suppkey") * 500).cast("string"), F.lit(".pth"),
        ).alias("path"),
    )


@query(
    "setup_name",
    sql(PATHS, body="""SELECT s_suppkey AS id,
      CASE WHEN s_suppkey * 500 % 1000 = 0 AND s_suppkey > 0 THEN
        substring(split_part(path, '/', 2), 1, 20) || '__' || (s_suppkey // 2) || 'k' END AS setup,
      split_part(path, '/', 2) || '__' || split_part(path, '/', 3) AS long_setup,
      split_part(path, '/', 2) AS run_name FROM paths"""),
)
def setup_name(spark, root):
    return model_paths(spark, root).select(
        F.col("s_suppkey").alias("id"),
        strings.setup_name(F.col("path")).alias("setup"),
        strings.full_setup_name(F.col("path")).alias("long_setup"),
        strings.run_name(F.col("path")).alias("run_name"),
    )


@query(
    "merge_function_strip",
    """SELECT c_custkey AS id, trim('edges_' || lower(c_mktsegment) || '_quant_75', 'edges_') AS stripped,
       lower(c_mktsegment) || '_quant_75' AS without_prefix FROM customer""",
)
def merge_function_strip(spark, root):
    name = F.concat(F.lit("edges_"), F.lower("c_mktsegment"), F.lit("_quant_75"))
    return table(spark, root, "customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("id"),
        strings.strip_chars(name, "edges_").alias("stripped"),
        strings.strip_prefix(name, "edges_").alias("without_prefix"),
    )


@query(
    "name_slices",
    """SELECT c_custkey AS id, substring(n, 1, length(n) - 10) AS model, right(n, 9) AS roi,
       list_extract(string_split(n, '_'), -1) AS split
       FROM (SELECT c_custkey, c_name || '_' || c_mktsegment || '_val' AS n FROM customer)""",
)
def name_slices(spark, root):
    name = F.concat_ws("_", F.col("c_name"), F.col("c_mktsegment"), F.lit("val"))
    return table(spark, root, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.col("c_custkey").alias("id"),
        strings.model_part(name).alias("model"),
        strings.roi_part(name).alias("roi"),
        strings.last_token(name).alias("split"),
    )


@query(
    "csv_cleanup",
    """SELECT p_partkey AS id, replace(p_brand || ' *', ' *', '') AS group_name,
       CASE p_size % 5 WHEN 1 THEN 'blue' WHEN 2 THEN 'orange' WHEN 3 THEN 'green' WHEN 4 THEN 'red' END AS rank_color
       FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD') AND NOT (p_brand IS NULL AND p_size IS NULL)""",
)
def csv_cleanup(spark, root):
    """Drop all-null rows, literal replace, membership filter, and dictionary lookup."""
    colors = F.create_map(*[F.lit(v) for v in (1, "blue", 2, "orange", 3, "green", 4, "red")])
    parts = table(spark, root, "part", "p_partkey", "p_brand", "p_type", "p_size").na.drop("all", subset=["p_brand", "p_size"])
    return parts.where(F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD")).select(
        F.col("p_partkey").alias("id"),
        F.replace(F.concat("p_brand", F.lit(" *")), F.lit(" *"), F.lit("")).alias("group_name"),
        F.try_element_at(colors, F.col("p_size") % 5).alias("rank_color"),
    )


@query(
    "threshold_keys",
    "SELECT l_discount AS threshold, CAST(round(l_discount * 100) AS INTEGER) AS key, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def threshold_keys(spark, root):
    lines = table(spark, root, "lineitem", "l_discount").groupBy("l_discount").agg(F.count("*").alias("n"))
    return lines.select(
        F.col("l_discount").alias("threshold"), strings.threshold_key(F.col("l_discount")).alias("key"), "n"
    )


@query(
    "cube_ids",
    """SELECT p_partkey AS id, CASE WHEN regexp_matches(right(stem, 2), '^[0-9]{2}$') THEN CAST(right(stem, 2) AS INTEGER) END AS cube_id,
       CASE WHEN substring(long, 41, 1) = '0' AND regexp_matches(substring(long, 42, 2), '^[0-9]{2}$') THEN substring(long, 42, 2) END AS old_id
       FROM (SELECT p_partkey, p_brand || '_' || p_size AS stem, lpad(p_name, 40, 'x') || lpad(CAST(p_size AS VARCHAR), 3, '0') AS long FROM part)""",
)
def cube_ids(spark, root):
    parts = table(spark, root, "part", "p_partkey", "p_brand", "p_size", "p_name")
    stem = F.concat_ws("_", F.col("p_brand"), F.col("p_size").cast("string"))
    long = F.concat(F.lpad("p_name", 40, "x"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    return parts.select(
        F.col("p_partkey").alias("id"),
        strings.cube_id_from_stem(stem).alias("cube_id"),
        strings.cube_id_from_name(long).alias("old_id"),
    )


@query("suffix_filter", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE '%bolt'")
def suffix_filter(spark, root):
    return table(spark, root, "part", "p_partkey", "p_name").where(
        strings.ends_with_any(F.col("p_name"), ["ring", "bolt"])
    ).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(
    "run_time_format",
    """SELECT o_orderkey AS id, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' ||
       lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS run_time FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)""",
)
def run_time_format(spark, root):
    return table(spark, root, "orders", "o_orderkey", "o_totalprice").select(
        F.col("o_orderkey").alias("id"), strings.run_time(F.floor("o_totalprice")).alias("run_time")
    )


@query(
    "timestamp_format",
    "SELECT event_id AS id, strftime(ts, '%y-%m-%d_%H-%M-%S') AS stamp FROM events",
)
def timestamp_format(spark, root):
    return table(spark, root, "events", "event_id", "ts").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yy-MM-dd_HH-mm-ss").alias("stamp")
    )


@query(
    "config_hash_md5",
    "SELECT o_orderkey AS id, md5(o_orderkey || o_orderstatus || o_orderpriority) AS hash FROM orders",
)
def config_hash_md5(spark, root):
    return table(spark, root, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"),
        strings.config_hash(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("hash"),
    )


@query(
    "prefixed_metrics",
    """SELECT event_id AS id, 'eval_' || k AS key, v AS value FROM (
         SELECT event_id, 'value' AS k, value AS v FROM events UNION ALL SELECT event_id, 'user', user_id % 3 FROM events) WHERE v <> 0""",
)
def prefixed_metrics(spark, root):
    """Metric maps with zero terms dropped and keys prefixed."""
    metrics = F.create_map(F.lit("value"), F.col("value"), F.lit("user"), (F.col("user_id") % 3).cast("double"))
    return table(spark, root, "events", "event_id", "value", "user_id").select(
        F.col("event_id").alias("id"), F.explode(strings.prefix_keys(strings.non_zero_terms(metrics), "eval_")).alias("key", "value")
    )


@query(
    "config_sections_override",
    """SELECT o_orderkey AS id, o_orderstatus AS a, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE o_orderstatus END AS b FROM orders""",
)
def config_sections_override(spark, root):
    common = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderstatus"))
    urgent = F.create_map(F.lit("b"), F.lit("urgent"))
    nothing = F.map_filter(urgent, lambda k, v: F.lit(False))
    section = F.when(F.col("o_orderpriority").startswith("1"), urgent).otherwise(nothing)
    return table(spark, root, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), strings.merge_sections(common, section).alias("m")
    ).select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))
