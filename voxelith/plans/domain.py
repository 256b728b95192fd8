"""Domain relations derived from the given tables.

The tables hold no volume, so a sparse label volume is laid out from ``lineitem``: the order
key and line number give a position on a 32 x 32 lattice that grows along z with the data.
Every relation exists twice: as a DataFrame function and as SQL text (``SQL``) from which the
reference queries are assembled with ``sql()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import rag
from voxelith.operators.grid import Box
from voxelith.session import TASK_ROWS, cut_lineage, parts
from voxelith.sources.tables import table

VOXEL_SIZE = (20, 9, 9)  # nm, zyx
SWEEP = list(range(0, 52, 2))  # hundredths: 0.00, 0.02, ... 0.50
EXTENT = Box((0, 0, 0), (1 << 40, 32, 32))  # the lattice is open along z


def voxels(spark: SparkSession, root: str, sections: tuple[int, int] | None = None) -> DataFrame:
    """``z, y, x`` with 8-bit affinities and raw intensity, ``frag`` and ``gt`` labels.

    Line items that share a position are combined by a partial aggregate before the shuffle,
    so a single over-represented order cannot fill one task. ``sections`` keeps a range of z: it
    grows with the order key, so the range of keys it implies reaches the scan.
    """
    lines = table(
        spark, root, "lineitem",
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_extendedprice",
    ).withColumn("p", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    if sections is not None:
        low, high = sections[0] * 1024, sections[1] * 1024
        # line numbers are positive, hence the lower keys that can still reach the first section
        lines = lines.where((F.col("l_orderkey") >= (low - 1023) // 8) & (F.col("l_orderkey") < -(-high // 8)))
        lines = lines.where((F.col("p") >= low) & (F.col("p") < high))
    whole = lambda c, f=1: F.sum(F.round(F.col(c) * f).cast("bigint"))
    grid = lines.groupBy("p").agg(
        (whole("l_discount", 100) % 11 * 25).alias("az"),
        (whole("l_tax", 100) % 9 * 31).alias("ay"),
        (whole("l_quantity") % 51 * 5).alias("ax"),
        (whole("l_extendedprice") % 256).alias("raw"),
    )
    # the number gives the place, and one key makes the smaller table
    placed = grid.select(F.expr("p div 1024").alias("z"), F.expr("(p div 32) % 32").alias("y"), F.expr("p % 32").alias("x"), "az", "ay", "ax", "raw")
    return placed.select(
        "*",
        F.expr(
            "CASE WHEN az + ay + ax <= 150 THEN 0L"
            " ELSE 1 + ((z div 4) * 8 + y div 4) * 8 + x div 4 END"
        ).alias("frag"),
        F.expr(
            "CASE WHEN raw % 8 = 0 THEN 0L ELSE 1 + ((z div 8) * 4 + y div 8) * 4 + x div 8 END"
        ).alias("gt"),
    )


def stored_voxels(spark: SparkSession, root: str, *columns: str, where: str = "TRUE") -> DataFrame:
    """Columns of the voxels as a stored table, so that they are derived once and can be counted.

    A task combines line items in a table of its own, before and after the shuffle, so there are as many as
    the rows need. Each writes a file; as small ones they are also read by as many tasks as later rows need.
    """
    lines = table(spark, root, "lineitem").count()  # from the files' footers
    return cut_lineage(
        voxels(spark, root).where(where).select(*columns), scans=parts(lines, 4 * TASK_ROWS), shuffles=parts(lines)
    )


def fragment_voxels(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """Voxels of fragments, stored: places, affinities, ``frag`` and what else is named."""
    return stored_voxels(spark, root, "z", "y", "x", "az", "ay", "ax", "frag", *more, where="frag <> 0")


def rag_edges(spark: SparkSession, root: str, name: str = "mean", voxels: DataFrame | None = None) -> DataFrame:
    """Scored edges of the volume, or of ``voxels`` that are stored already, as a stored table.

    A task that reads voxels holds them, as wide rows, until they are sorted by partition, so a scan is as
    many tasks as the rows need; that can only be asked for while something is written.
    """
    stored = fragment_voxels(spark, root) if voxels is None else voxels
    rows = stored.count()
    tasks = parts(rows, 4 * TASK_ROWS)
    return cut_lineage(rag.edges(rag.faces(stored, rows=rows), name), scans=tasks, shuffles=tasks)


def fragment_ids(stored: DataFrame) -> DataFrame:
    """Distinct fragments of stored voxels, stored by as many tasks as the voxels need."""
    tasks = parts(stored.count(), 4 * TASK_ROWS)
    return cut_lineage(stored.select(F.col("frag").alias("id")).distinct(), scans=tasks, shuffles=tasks)


def skeleton_nodes(spark: SparkSession, root: str) -> DataFrame:
    """One skeleton per user; ``seg`` plays the segmentation, 0 is background."""
    return table(spark, root, "events", "event_id", "user_id", "ts", "value").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("component"),
        F.col("value").alias("z"),
        (F.col("event_id") / F.lit(100.0)).alias("y"),
        F.lit(0.0).alias("x"),
        F.expr(
            "CASE WHEN event_id % 97 = 0 THEN 0L"
            " WHEN user_id % 5 = 0 THEN 1 + CAST(floor(value / 20) AS BIGINT)"
            " ELSE user_id * 100 + 50 + CAST(floor(value / 20) AS BIGINT) END"
        ).alias("seg"),
        "ts",
    )


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Score reports per ``setup, split, pct``; sums of whole numbers, so totals are exact."""
    return (
        table(spark, root, "lineitem", "l_suppkey", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        .groupBy(
            F.col("l_suppkey").alias("setup"),
            F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split"),
            F.col("l_quantity").cast("bigint").alias("pct"),
        )
        .agg(
            F.sum(F.round("l_extendedprice").cast("bigint")).alias("erl"),
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("s"),
            F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("m"),
            F.count("*").alias("n"),
        )
        .select(
            "setup", "split", "pct", "erl",
            F.round((F.col("s") + F.col("m")) / F.col("n"), 6).alias("voi"),
            F.round(F.col("s") / F.col("n"), 6).alias("voi_split"),
            F.round(F.col("m") / F.col("n"), 6).alias("voi_merge"),
        )
    )


def run_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Runs in groups of three; some runs have no score database (null)."""
    return table(spark, root, "supplier", "s_suppkey", "s_name").select(
        F.concat(F.lit("group_"), F.expr("s_suppkey div 3").cast("string")).alias("group_name"),
        F.col("s_name").alias("run_name"),
        F.expr("CASE WHEN s_suppkey % 7 <> 6 THEN s_suppkey END").alias("setup"),
    )


def volume_box(spark: SparkSession, root: str) -> Box:
    """Bounding box of the volume: one min/max row from column statistics."""
    top = table(spark, root, "lineitem", "l_orderkey", "l_linenumber").agg(
        F.max(F.expr("(l_orderkey * 8 + l_linenumber) div 1024"))
    ).first()[0]
    return Box((0, 0, 0), (int(top) + 1, 32, 32))


SQL: dict[str, str] = {}

SQL["vox"] = """vox AS (
  SELECT *,
    CAST(CASE WHEN az + ay + ax <= 150 THEN 0
         ELSE 1 + ((z // 4) * 8 + y // 4) * 8 + x // 4 END AS BIGINT) AS frag,
    CAST(CASE WHEN raw % 8 = 0 THEN 0
         ELSE 1 + ((z // 8) * 4 + y // 8) * 4 + x // 8 END AS BIGINT) AS gt
  FROM (
    SELECT p // 1024 AS z, (p // 32) % 32 AS y, p % 32 AS x,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 11 * 25 AS BIGINT) AS az,
      CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) % 9 * 31 AS BIGINT) AS ay,
      CAST(sum(CAST(round(l_quantity) AS BIGINT)) % 51 * 5 AS BIGINT) AS ax,
      CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) % 256 AS BIGINT) AS raw
    FROM (SELECT l_orderkey * 8 + l_linenumber AS p, * FROM lineitem) GROUP BY 1, 2, 3))"""

SQL["faces"] = """faces AS (
  SELECT least(a.frag, b.frag) AS u, greatest(a.frag, b.frag) AS v, a.az AS aff
  FROM vox a JOIN vox b ON b.z = a.z - 1 AND b.y = a.y AND b.x = a.x
  WHERE a.frag <> 0 AND b.frag <> 0 AND a.frag <> b.frag
  UNION ALL
  SELECT least(a.frag, b.frag), greatest(a.frag, b.frag), a.ay
  FROM vox a JOIN vox b ON b.z = a.z AND b.y = a.y - 1 AND b.x = a.x
  WHERE a.frag <> 0 AND b.frag <> 0 AND a.frag <> b.frag
  UNION ALL
  SELECT least(a.frag, b.frag), greatest(a.frag, b.frag), a.ax
  FROM vox a JOIN vox b ON b.z = a.z AND b.y = a.y AND b.x = a.x - 1
  WHERE a.frag <> 0 AND b.frag <> 0 AND a.frag <> b.frag)"""

SQL["rag"] = """rag AS (
  SELECT u, v, 1 - sum(aff) / count(*) / 255 AS merge_score, count(*) AS n_faces
  FROM faces GROUP BY u, v)"""

SQL["frags"] = "frags AS (SELECT DISTINCT frag AS id FROM vox WHERE frag <> 0)"

SQL["skel"] = """skel AS (
  SELECT event_id AS id, user_id AS component, value AS z, event_id / 100.0 AS y,
    CAST(0 AS DOUBLE) AS x, ts,
    CASE WHEN event_id % 97 = 0 THEN 0
         WHEN user_id % 5 = 0 THEN 1 + CAST(floor(value / 20) AS BIGINT)
         ELSE user_id * 100 + 50 + CAST(floor(value / 20) AS BIGINT) END AS seg
  FROM events)"""

SQL["skel_edges"] = """skel_edges AS (
  SELECT id AS source, target FROM (
    SELECT id, lead(id) OVER (PARTITION BY component ORDER BY ts, id) AS target FROM skel)
  WHERE target IS NOT NULL)"""

SQL["skel_attr"] = """skel_attr AS (
  SELECT a.component, a.seg AS su, b.seg AS sv,
    sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS length
  FROM skel_edges e JOIN skel a ON a.id = e.source JOIN skel b ON b.id = e.target)"""

SQL["merging"] = """merging AS (
  SELECT seg FROM skel GROUP BY seg HAVING count(DISTINCT component) > 1)"""

SQL["reports"] = """reports AS (
  SELECT l_suppkey AS setup, CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END AS split,
    CAST(l_quantity AS BIGINT) AS pct,
    CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS erl,
    round((sum(CAST(round(l_discount * 100) AS BIGINT)) + sum(CAST(round(l_tax * 100) AS BIGINT))) / count(*), 6) AS voi,
    round(sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*), 6) AS voi_split,
    round(sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*), 6) AS voi_merge
  FROM lineitem GROUP BY 1, 2, 3)"""

SQL["catalogue"] = """catalogue AS (
  SELECT 'group_' || CAST(s_suppkey // 3 AS VARCHAR) AS group_name, s_name AS run_name,
    CASE WHEN s_suppkey % 7 <> 6 THEN s_suppkey END AS setup
  FROM supplier)"""

# Components at one threshold / for the sweep; ``ed`` holds both directions.
SQL["ed"] = """ed AS (
  SELECT t, u AS n, v AS o FROM rag JOIN points ON merge_score <= t / 100.0
  UNION ALL SELECT t, v, u FROM rag JOIN points ON merge_score <= t / 100.0)"""

SQL["cc"] = """cc(t, n, m) USING KEY (t, n) AS (
  SELECT DISTINCT t, n, n FROM ed
  UNION
  SELECT ed.t, ed.n, min(r.m) FROM ed
    JOIN recurring.cc r ON r.t = ed.t AND r.n = ed.o
    JOIN recurring.cc me ON me.t = ed.t AND me.n = ed.n
  GROUP BY ed.t, ed.n, me.m HAVING min(r.m) < me.m)"""

SQL["lut"] = """lut AS (
  SELECT points.t AS threshold_pct, frags.id AS fragment, coalesce(cc.m, frags.id) AS segment
  FROM frags CROSS JOIN points LEFT JOIN cc ON cc.t = points.t AND cc.n = frags.id)"""


def points(values: list[int]) -> str:
    return f"points AS (SELECT unnest({values!r}) AS t)"


def sql(*names: str, body: str) -> str:
    """Assemble ``WITH ...`` from named relations; a name not in ``SQL`` is used verbatim."""
    parts = [SQL.get(n, n) for n in names]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


GRAPH = ("vox", "faces", "rag", "frags")


def sweep_sql(values: list[int], body: str, *more: str) -> str:
    return sql(*GRAPH, points(values), "ed", "cc", "lut", *more, body=body)


def sites(spark: SparkSession, root: str) -> DataFrame:
    """Skeleton nodes inside the volume in world units, 50 to a skeleton, placed along x."""
    return table(spark, root, "events", "event_id").selectExpr(
        "event_id AS id",
        "event_id div 50 AS component",
        "(event_id * 12) div 1024 * 20 + 7 AS z",
        "((event_id * 12) div 32) % 32 * 9 + 4 AS y",
        "(event_id * 12) % 32 * 9 + 2 AS x",
    )


def site_edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events", "event_id").where("(event_id + 1) % 50 <> 0").selectExpr(
        "event_id AS source", "event_id + 1 AS target"
    )


def minute_of(ts: str):
    """Minutes since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)


SQL["sites"] = """sites AS (
  SELECT event_id AS id, event_id // 50 AS component, (event_id * 12) // 1024 * 20 + 7 AS z,
    ((event_id * 12) // 32) % 32 * 9 + 4 AS y, (event_id * 12) % 32 * 9 + 2 AS x FROM events)"""

SQL["site_edges"] = """site_edges AS (
  SELECT event_id AS source, event_id + 1 AS target FROM events WHERE (event_id + 1) % 50 <> 0)"""

SQL["located"] = """located AS (
  SELECT s.*, coalesce(v.frag, 0) AS fragment FROM sites s
  LEFT JOIN vox v ON v.z = s.z // 20 AND v.y = s.y // 9 AND v.x = s.x // 9)"""


def unit_sql(key: str, seed: int) -> str:
    """SQL of ``sampling.unit_hash`` for non-negative keys."""
    return f"((((({key}) % 2147483647) * 48271 + {seed * 69621}) % 2147483647 * 16807 + 12345) % 2147483647 / 2147483647.0::DOUBLE)"
