"""Queries over volumes: boxes, blocks, crops, masks, neighbours, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.operators import grid, locations, neighbours, volumes
from voxelith.operators.grid import Box
from voxelith.plans import domain
from voxelith.plans.domain import sql, unit_sql
from voxelith.plans.registry import query
from voxelith.sources.tables import table

DEPTH = "(SELECT max((l_orderkey * 8 + l_linenumber) // 1024) + 1 FROM lineitem)"


@query("roi_box_scan", sql("vox", body="SELECT z, y, x, raw FROM vox WHERE z >= 10 AND z < 60 AND y >= 4 AND y < 20 AND x >= 8 AND x < 31"))
def roi_box_scan(spark, root):
    """World box over a dataset with an offset: nm -> voxel indices -> comparisons."""
    world = Box((1200, 136, 172), (1000, 144, 207))
    box = world.to_voxels((20, 9, 9), (1000, 100, 100))
    return domain.voxels(spark, root, (box.begin[0], box.end[0])).where(box.contains()).select("z", "y", "x", "raw")


@query(
    "block_grid",
    f"""SELECT (bz * 4 + "by") * 4 + bx AS block_id, bz, "by", bx, bz * 160 AS write_z0, least(bz * 160 + 160, d * 20) AS write_z1,
        bz * 160 - 40 AS read_z0, least(bz * 160 + 160, d * 20) + 40 AS read_z1,
        "by" * 72 AS write_y0, "by" * 72 + 72 AS write_y1, "by" * 72 - 18 AS read_y0, "by" * 72 + 72 + 18 AS read_y1,
        bx * 72 AS write_x0, bx * 72 + 72 AS write_x1, bx * 72 - 18 AS read_x0, bx * 72 + 72 + 18 AS read_x1
      FROM (SELECT {DEPTH} AS d) c, range((d + 7) // 8) a(bz), range(4) b("by"), range(4) e(bx)""",
)
def block_grid(spark, root):
    box = domain.volume_box(spark, root)
    total = Box((0, 0, 0), tuple(s * v for s, v in zip(box.shape, domain.VOXEL_SIZE)))
    return grid.block_grid(spark, total, (160, 72, 72), (40, 18, 18))


@query(
    "block_grid_overhang",
    f"""SELECT bz AS block_id, bz * 10 AS write_z0, bz * 10 + 10 AS write_z1 FROM (SELECT {DEPTH} AS d) c, range((d + 9) // 10) a(bz)""",
)
def block_grid_overhang(spark, root):
    blocks = grid.block_grid(spark, domain.volume_box(spark, root), (10, 32, 32), fit="overhang")
    return blocks.select("block_id", "write_z0", "write_z1")


@query(
    "voxels_per_block",
    f"""SELECT bz AS block_id, (least(bz * 160 + 160, d * 20) - bz * 160) // 20 * 32 * 32 AS num_voxels
      FROM (SELECT {DEPTH} AS d) c, range((d + 7) // 8) a(bz)""",
)
def voxels_per_block(spark, root):
    box = domain.volume_box(spark, root)
    total = Box((0, 0, 0), tuple(s * v for s, v in zip(box.shape, domain.VOXEL_SIZE)))
    blocks = grid.block_grid(spark, total, (160, 288, 288))
    count = F.lit(1).cast("bigint")
    for a, v in zip("zyx", domain.VOXEL_SIZE):
        count = count * F.floor((F.col(f"write_{a}1") - F.col(f"write_{a}0")) / F.lit(v)).cast("bigint")
    return blocks.select("block_id", count.alias("num_voxels"))


@query(
    "block_halo_counts",
    sql("vox", body="""SELECT bz, "by", bx, count(*) AS n_read,
        CAST(sum(CASE WHEN z // 8 = bz AND y // 8 = "by" AND x // 8 = bx THEN 1 ELSE 0 END) AS BIGINT) AS n_own FROM (
        SELECT z, y, x, z // 8 + dz AS bz, y // 8 + dy AS "by", x // 8 + dx AS bx
        FROM vox, (SELECT unnest([-1, 0, 1]) AS dz), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))
      WHERE z >= bz * 8 - 2 AND z < bz * 8 + 10 AND y >= "by" * 8 - 2 AND y < "by" * 8 + 10 AND x >= bx * 8 - 2 AND x < bx * 8 + 10
      GROUP BY 1, 2, 3 HAVING n_own > 0"""),
)
def block_halo_counts(spark, root):
    halo = grid.with_halo(domain.voxels(spark, root).select("z", "y", "x"), (8, 8, 8), (2, 2, 2), (2, 2, 2), domain.EXTENT)
    return halo.groupBy("bz", "by", "bx").agg(
        F.count("*").alias("n_read"), F.count_if("own").alias("n_own")
    ).where("n_own > 0")


@query(
    "blocks_pending_anti",
    sql("vox", f"""done AS (SELECT (z // 8 * 4 + y // 8) * 4 + x // 8 AS block_id FROM vox GROUP BY 1 HAVING count(*) > 200)""",
        body=f"""SELECT block_id FROM (SELECT unnest(range((({DEPTH} + 7) // 8) * 16)) AS block_id) b
      WHERE block_id NOT IN (SELECT block_id FROM done)"""),
)
def blocks_pending_anti(spark, root):
    done = (
        domain.voxels(spark, root)
        .groupBy(F.expr("(z div 8 * 4 + y div 8) * 4 + x div 8").alias("block_id")).count().where("count > 200")
    )
    blocks = grid.block_grid(spark, domain.volume_box(spark, root), (8, 8, 8))
    return grid.pending_blocks(blocks, done).select("block_id")


@query(
    "scan_shifts",
    f"""SELECT least(a * 8, d - 10) AS shift_z, least(b * 12, 12) AS shift_y, least(c * 10, 22) AS shift_x
      FROM (SELECT {DEPTH} AS d) q, range((d - 10 + 7) // 8 + 1) t(a), range(2) u(b), range(4) w(c)""",
)
def scan_shifts(spark, root):
    return grid.scan_shifts(spark, domain.volume_box(spark, root), Box((0, 0, 0), (10, 20, 10)), (8, 12, 10))


@query(
    "roi_intersection",
    sql("vox",
        "f AS (SELECT frag AS id, min(z) z0, max(z) + 1 z1, min(y) y0, max(y) + 1 y1, min(x) x0, max(x) + 1 x1 FROM vox WHERE frag <> 0 GROUP BY 1)",
        "g AS (SELECT gt AS id, min(z) z0, max(z) + 1 z1, min(y) y0, max(y) + 1 y1, min(x) x0, max(x) + 1 x1 FROM vox WHERE gt <> 0 GROUP BY 1)",
        body="""SELECT f.id AS left_id, g.id AS right_id, greatest(f.z0, g.z0) AS z0, least(f.z1, g.z1) AS z1,
      greatest(f.y0, g.y0) AS y0, least(f.y1, g.y1) AS y1, greatest(f.x0, g.x0) AS x0, least(f.x1, g.x1) AS x1
      FROM f JOIN g ON f.z0 < g.z1 AND g.z0 < f.z1 AND f.y0 < g.y1 AND g.y0 < f.y1 AND f.x0 < g.x1 AND g.x0 < f.x1"""),
)
def roi_intersection(spark, root):
    voxels = domain.voxels(spark, root)
    return grid.box_overlaps(bounding_boxes(voxels, "frag"), bounding_boxes(voxels, "gt"), (8, 8, 8))


def bounding_boxes(voxels, label):
    spans = []
    for a in "zyx":
        spans += [F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1")]
    return voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(*spans)


@query(
    "array_shapes_min_max",
    sql("vox", body="""SELECT max(dz) AS max_z, min(dz) AS min_z, max(dy) AS max_y, min(dy) AS min_y, max(dx) AS max_x, min(dx) AS min_x
      FROM (SELECT max(z) - min(z) + 1 AS dz, max(y) - min(y) + 1 AS dy, max(x) - min(x) + 1 AS dx FROM vox WHERE gt <> 0 GROUP BY gt)"""),
)
def array_shapes_min_max(spark, root):
    boxes = bounding_boxes(domain.voxels(spark, root), "gt")
    return boxes.agg(
        *[f(F.col(f"{a}1") - F.col(f"{a}0")).alias(f"{n}_{a}") for a in "zyx" for n, f in (("max", F.max), ("min", F.min))]
    )


@query(
    "array_stats",
    sql("vox", body="""SELECT 'raw' AS name, min(raw) AS lo, max(raw) AS hi, count(DISTINCT raw) AS n_unique FROM vox
      UNION ALL SELECT 'gt', min(gt), max(gt), count(DISTINCT gt) FROM vox
      UNION ALL SELECT 'frag', min(frag), max(frag), count(DISTINCT frag) FROM vox"""),
)
def array_stats(spark, root):
    """Min, max and number of distinct values per array: one long-form pass, no distinct expand."""
    names = ["raw", "gt", "frag"]
    long = domain.voxels(spark, root).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("e")
    )
    return long.select("e.name", "e.v").distinct().groupBy("name").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n_unique")
    )


CROP = f"""dim AS (SELECT {DEPTH} AS d),
cropped AS (SELECT z - (d - d // 2) // 2 AS z, y - 7 AS y, x - 8 AS x, raw FROM vox, dim
  WHERE z >= (d - d // 2) // 2 AND z < (d - d // 2) // 2 + d // 2 AND y >= 7 AND y < 24 AND x >= 8 AND x < 24)"""


def cropped(spark, root):
    depth = domain.volume_box(spark, root).shape[0]
    shape = (depth // 2, 17, 16)
    box = volumes.center_box((depth, 32, 32), shape)
    voxels = domain.voxels(spark, root, (box.begin[0], box.end[0])).select("z", "y", "x", "raw")
    return volumes.crop(voxels, box), shape


@query("center_crop", sql("vox", CROP, body="SELECT * FROM cropped"))
def center_crop(spark, root):
    return cropped(spark, root)[0]


@query(
    "pad_to_shape",
    sql("vox", CROP, body="""SELECT a.z, b.y, c.x, coalesce(raw, 0) AS raw
      FROM dim, range(d // 2 + 3) a(z), range(20) b(y), range(17) c(x)
      LEFT JOIN cropped k ON k.z + 1 = a.z AND k.y + 1 = b.y AND k.x = c.x"""),
)
def pad_to_shape(spark, root):
    voxels, shape = cropped(spark, root)
    return volumes.pad(voxels, "raw", shape, (shape[0] + 3, 20, 17))


@query(
    "import_center_crop",
    sql("vox", f"dim AS (SELECT {DEPTH} AS d)", body="""SELECT z - (d // 2 - 10) AS z, y - 9 AS y, x - 6 AS x, raw FROM vox, dim
      WHERE z >= d // 2 - 10 AND z < d // 2 + 10 AND y >= 9 AND y < 23 AND x >= 6 AND x < 26"""),
)
def import_center_crop(spark, root):
    box = volumes.even_center_box(domain.volume_box(spark, root).shape, (20, 15, 21))
    return volumes.crop(domain.voxels(spark, root, (box.begin[0], box.end[0])).select("z", "y", "x", "raw"), box)


@query(
    "label_offset",
    sql("vox", f"dim AS (SELECT {DEPTH} AS d)", body="""SELECT gt AS id, (d // 2 - (max(z) - min(z) + 1) // 2) * 20 AS offset_z,
      (16 - (max(y) - min(y) + 1) // 2) * 9 AS offset_y, (16 - (max(x) - min(x) + 1) // 2) * 9 AS offset_x
      FROM vox, dim WHERE gt <> 0 GROUP BY gt, d"""),
)
def label_offset(spark, root):
    shape = domain.volume_box(spark, root).shape
    boxes = bounding_boxes(domain.voxels(spark, root), "gt")
    return boxes.select(
        "id",
        *volumes.label_offset([F.lit(s) for s in shape], [F.col(f"{a}1") - F.col(f"{a}0") for a in "zyx"], domain.VOXEL_SIZE),
    )


@query("slice_mid_z", sql("vox", f"dim AS (SELECT {DEPTH} AS d)", body="SELECT y, x, raw FROM vox, dim WHERE z = d // 2"))
def slice_mid_z(spark, root):
    """Middle section, with the sliced dimension projected away."""
    depth = domain.volume_box(spark, root).shape[0]
    return domain.voxels(spark, root, (depth // 2, depth // 2 + 1)).select("y", "x", "raw")


@query("subsample_z", sql("vox", body="SELECT z, y, x, raw FROM vox WHERE z % 4 = 0"))
def subsample_z(spark, root):
    return domain.voxels(spark, root).where("z % 4 = 0").select("z", "y", "x", "raw")


@query(
    "split_volume_z",
    sql("vox", f"dim AS (SELECT {DEPTH} AS d)", body="""SELECT CASE WHEN z < d * 4 // 5 THEN 'train' ELSE 'val' END AS split, count(*) AS n,
      CAST(sum(raw) AS BIGINT) AS total FROM vox, dim GROUP BY 1"""),
)
def split_volume_z(spark, root):
    depth = domain.volume_box(spark, root).shape[0]
    side = F.when(F.col("z") < depth * 4 // 5, "train").otherwise("val").alias("split")
    return domain.voxels(spark, root).groupBy(side).agg(F.count("*").alias("n"), F.sum("raw").alias("total"))


@query("single_segment", sql("vox", body="SELECT z, y, x, CAST(gt = 7 AS BIGINT) AS hit FROM vox"))
def single_segment(spark, root):
    return domain.voxels(spark, root).select("z", "y", "x", (F.col("gt") == 7).cast("bigint").alias("hit"))


@query("boundary_labels", sql("vox", body="SELECT z, y, x, CAST(gt = 0 AS BIGINT) AS boundary, CAST(gt > 0 AS BIGINT) AS foreground, CAST(1 AS BIGINT) AS ones FROM vox"))
def boundary_labels(spark, root):
    return domain.voxels(spark, root).select(
        "z", "y", "x", volumes.boundary().alias("boundary"), (F.col("gt") > 0).cast("bigint").alias("foreground"),
        F.lit(1).cast("bigint").alias("ones"),
    )


@query("axis_transpose", sql("vox", body="SELECT x AS z, y, z AS x, raw FROM vox"))
def axis_transpose(spark, root):
    """xyz file order to zyx."""
    return domain.voxels(spark, root).select(F.col("x").alias("z"), "y", F.col("z").alias("x"), "raw")


@query("voxel_to_world", sql("vox", body="SELECT z * 20 + 1000 AS wz, y * 9 + 100 AS wy, x * 9 + 100 AS wx, raw / 1000.0 AS raw_scaled FROM vox"))
def voxel_to_world(spark, root):
    return domain.voxels(spark, root).select(
        *[(F.col(a) * v + o).alias(f"w{a}") for a, v, o in zip("zyx", domain.VOXEL_SIZE, (1000, 100, 100))],
        (F.col("raw") / F.lit(1000.0)).alias("raw_scaled"),
    )


@query(
    "gt_affinities",
    sql("vox", body="""SELECT a.z, a.y, a.x,
      CAST(a.gt <> 0 AND coalesce(p.gt = a.gt, FALSE) AS BIGINT) AS gt_az,
      CAST(a.gt <> 0 AND coalesce(q.gt = a.gt, FALSE) AS BIGINT) AS gt_ay,
      CAST(a.gt <> 0 AND coalesce(r.gt = a.gt, FALSE) AS BIGINT) AS gt_ax
      FROM vox a LEFT JOIN vox p ON p.z = a.z - 1 AND p.y = a.y AND p.x = a.x
      LEFT JOIN vox q ON q.z = a.z AND q.y = a.y - 1 AND q.x = a.x
      LEFT JOIN vox r ON r.z = a.z AND r.y = a.y AND r.x = a.x - 1"""),
)
def gt_affinities(spark, root):
    voxels = domain.stored_voxels(spark, root, "z", "y", "x", "gt")
    return neighbours.label_affinities(voxels, rows=voxels.count())


@query(
    "grow_boundary_xy",
    sql("vox", body="""SELECT a.z, a.y, a.x, CASE WHEN bool_or(b.gt <> a.gt) THEN 0 ELSE a.gt END AS eroded
      FROM vox a LEFT JOIN vox b ON b.z = a.z AND abs(b.y - a.y) + abs(b.x - a.x) = 1
        AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
      GROUP BY a.z, a.y, a.x, a.gt"""),
)
def grow_boundary_xy(spark, root):
    voxels = domain.stored_voxels(spark, root, "z", "y", "x", "gt")
    return neighbours.grow_boundary_xy(voxels, rows=voxels.count())


@query("mean_aff_boundary_mask", sql("vox", body="SELECT z, y, x, (az + ay + ax) / 3.0 > 127.5 AS inside FROM vox"))
def mean_aff_boundary_mask(spark, root):
    return domain.voxels(spark, root).select("z", "y", "x", volumes.affinity_mask().alias("inside"))


@query(
    "fragment_filter_low_aff",
    sql("vox", """keep AS (SELECT frag FROM vox WHERE frag <> 0 GROUP BY frag HAVING sum(az + ay + ax) / (3.0::DOUBLE * count(*)) >= 0.5::DOUBLE * 255)""",
        body="SELECT z, y, x, CASE WHEN frag IN (SELECT frag FROM keep) THEN frag ELSE 0 END AS frag FROM vox"),
)
def fragment_filter_low_aff(spark, root):
    return volumes.low_affinity_fragments(domain.voxels(spark, root), 0.5).select("z", "y", "x", "frag")


@query("replace_sections", sql("vox", body="SELECT z, y, x, CASE WHEN z IN (3, 4, 9, 60) THEN 0 ELSE az END AS az FROM vox"))
def replace_sections(spark, root):
    return volumes.replace_sections(domain.voxels(spark, root).select("z", "y", "x", "az"), [3, 4, 9, 60], ["az"])


@query(
    "masked_affinities",
    sql("vox", "m AS (SELECT z, y, x, CAST(raw > 40 AS BIGINT) AS mask FROM vox WHERE raw % 3 <> 0)",
        body="""SELECT z, y, x, CASE WHEN mask > 0 THEN az ELSE 0 END AS az, CASE WHEN mask > 0 THEN ay ELSE 0 END AS ay,
      CASE WHEN mask > 0 THEN ax ELSE 0 END AS ax FROM vox LEFT JOIN m USING (z, y, x)"""),
)
def masked_affinities(spark, root):
    voxels = domain.voxels(spark, root)
    mask = voxels.where("raw % 3 <> 0").select("z", "y", "x", (F.col("raw") > 40).cast("bigint").alias("mask"))
    return volumes.apply_mask(voxels.select("z", "y", "x", "az", "ay", "ax"), mask, ["az", "ay", "ax"])


@query(
    "global_fragment_ids",
    sql("vox", body="""SELECT z, y, x, ((z // 8 * 4 + y // 8) * 4 + x // 8) * 512 + d AS fragment_id FROM (
      SELECT *, dense_rank() OVER (PARTITION BY z // 8, y // 8, x // 8 ORDER BY frag) AS d FROM vox WHERE frag <> 0)"""),
)
def global_fragment_ids(spark, root):
    """Block-local consecutive ids made unique by block id times voxels per block."""
    from pyspark.sql import Window

    count = grid.voxels_per_block((160, 72, 72), domain.VOXEL_SIZE)
    local = F.dense_rank().over(Window.partitionBy("block_id").orderBy("frag"))
    return (
        domain.voxels(spark, root).where("frag <> 0")
        .withColumn("block_id", F.expr("(z div 8 * 4 + y div 8) * 4 + x div 8"))
        .select("z", "y", "x", (F.col("block_id") * count + local).alias("fragment_id"))
    )


@query(
    "max_filter_maxima",
    sql("vox", "v AS (SELECT z, y, x, az + ay + ax AS s FROM vox)",
        "m1 AS (SELECT *, max(s) OVER (PARTITION BY y, x ORDER BY z RANGE BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS p FROM v)",
        "m2 AS (SELECT * EXCLUDE (p), max(p) OVER (PARTITION BY z, x ORDER BY y RANGE BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS p FROM m1)",
        "m3 AS (SELECT * EXCLUDE (p), max(p) OVER (PARTITION BY z, y ORDER BY x RANGE BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS p FROM m2)",
        body="SELECT z, y, x, s FROM m3 WHERE p = s"),
)
def max_filter_maxima(spark, root):
    sums = domain.voxels(spark, root).select("z", "y", "x", (F.col("az") + F.col("ay") + F.col("ax")).alias("s"))
    return volumes.max_filter(sums, "s", 10, (16, 16, 16), extent=domain.EXTENT).where("peak = s").select("z", "y", "x", "s")


SCAN_CHUNKS = f"""dim AS (SELECT {DEPTH} AS d), chunks AS (
  SELECT least(a * 8, d - 10) AS sz, least(b * 12, 16) AS sy, least(c * 12, 16) AS sx,
    a + ((d - 10 + 7) // 8 + 1) * (b + 3 * c) AS chunk
  FROM dim, range((d - 10 + 7) // 8 + 1) t(a), range(3) u(b), range(3) w(c))"""


@query(
    "chunk_stitch_last_wins",
    sql("vox", SCAN_CHUNKS, body="""SELECT z, y, x, arg_max(raw + chunk, chunk) AS value FROM vox JOIN chunks
      ON z >= sz AND z < sz + 10 AND y >= sy AND y < sy + 16 AND x >= sx AND x < sx + 16 GROUP BY z, y, x"""),
)
def chunk_stitch_last_wins(spark, root):
    voxels = domain.voxels(spark, root).select("z", "y", "x", "raw")
    chunks = volumes.scan_chunks(voxels, domain.volume_box(spark, root), (10, 16, 16), (8, 12, 12))
    return volumes.stitch(chunks.withColumn("value", F.col("raw") + F.col("chunk")), "value", "chunk")


@query(
    "line_sample",
    sql("vox", "sites",
        """ends AS (SELECT component AS id, arg_min(z, s.id) // 20 AS z0, arg_min(y, s.id) // 9 AS y0, arg_min(x, s.id) // 9 AS x0,
          arg_max(z, s.id) // 20 AS z1, arg_max(y, s.id) // 9 AS y1, arg_max(x, s.id) // 9 AS x1 FROM sites s GROUP BY component)""",
        """n AS (SELECT *, greatest(ceil(sqrt(CAST((z1 - z0) * (z1 - z0) + (y1 - y0) * (y1 - y0) + (x1 - x0) * (x1 - x0) AS DOUBLE)))::BIGINT, 1) AS steps FROM ends)""",
        """p AS (SELECT id, step, floor(z0 + (z1 - z0) * step / steps)::BIGINT AS z, floor(y0 + (y1 - y0) * step / steps)::BIGINT AS y,
          floor(x0 + (x1 - x0) * step / steps)::BIGINT AS x FROM (SELECT *, unnest(range(steps + 1)) AS step FROM n))""",
        body="SELECT id, step, p.z, p.y, p.x, coalesce(raw, -1) AS raw FROM p LEFT JOIN vox USING (z, y, x)"),
)
def line_sample(spark, root):
    at = lambda a, v: F.floor(F.col(a) / F.lit(v)).cast("bigint").alias(a)
    points = domain.sites(spark, root).select("id", "component", at("z", 20), at("y", 9), at("x", 9))
    ends = points.groupBy(F.col("component").alias("cid")).agg(
        F.min_by(F.struct("z", "y", "x"), "id").alias("a"), F.max_by(F.struct("z", "y", "x"), "id").alias("b")
    )
    lines = ends.select(
        F.col("cid").alias("id"), *[F.col(f"a.{a}").alias(f"{a}0") for a in "zyx"], *[F.col(f"b.{a}").alias(f"{a}1") for a in "zyx"]
    )
    found = volumes.line_samples(lines).join(domain.voxels(spark, root).select("z", "y", "x", "raw"), ["z", "y", "x"], "left")
    return found.select("id", "step", "z", "y", "x", F.coalesce("raw", F.lit(-1).cast("bigint")).alias("raw"))


@query(
    "values_around_sites",
    sql("vox", "sites", body="""SELECT s.id, count(v.raw) AS n, CAST(coalesce(sum(v.raw), 0) AS BIGINT) AS total FROM sites s
      LEFT JOIN (SELECT v.raw, v.z + dz AS z, v.y + dy AS y, v.x + dx AS x FROM vox v, (SELECT unnest([-1, 0, 1]) AS dz),
        (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) v
      ON v.z = s.z // 20 AND v.y = s.y // 9 AND v.x = s.x // 9 GROUP BY s.id"""),
)
def values_around_sites(spark, root):
    """Box of one voxel around each site: the small side is expanded, never the volume."""
    at = lambda a, v: F.floor(F.col(a) / F.lit(v)).cast("bigint").alias(a)
    points = domain.sites(spark, root).select("id", at("z", 20), at("y", 9), at("x", 9))
    near = volumes.neighbourhood(points).join(domain.voxels(spark, root).select("z", "y", "x", "raw"), ["z", "y", "x"], "left")
    return near.groupBy("id").agg(F.count("raw").alias("n"), F.coalesce(F.sum("raw"), F.lit(0)).alias("total"))


@query(
    "augment_flip_transpose",
    sql("vox", f"dim AS (SELECT {DEPTH} AS d)", body="SELECT d - 1 - z AS z, x AS y, 31 - y AS x, raw FROM vox, dim"),
)
def augment_flip_transpose(spark, root):
    box = domain.volume_box(spark, root)
    return volumes.transpose_xy(volumes.flip(domain.voxels(spark, root).select("z", "y", "x", "raw"), box, ("z", "y")))


@query(
    "augment_intensity",
    sql("vox", "m AS (SELECT z, avg(raw / 255.0::DOUBLE) AS m FROM vox GROUP BY z)",
        body=f"""SELECT vox.z, y, x, round(m + (raw / 255.0::DOUBLE - m) * (0.9 + {unit_sql('vox.z', 14)} * 0.2) + -0.1 + {unit_sql('vox.z', 15)} * 0.2, 6) AS augmented
      FROM vox JOIN m ON m.z = vox.z"""),
)
def augment_intensity(spark, root):
    voxels = domain.voxels(spark, root).select("z", "y", "x", (F.col("raw") / F.lit(255.0)).alias("v"))
    out = volumes.intensity_augment(voxels, "v", seed=7)
    return out.select("z", "y", "x", F.round("augmented", 6).alias("augmented"))


@query(
    "candidate_locations_masked",
    sql("vox", body="""SELECT cz // 4 AS bz, cy // 4 AS "by", cx // 4 AS bx, round(count(*) / 64.0::DOUBLE, 6) AS share
      FROM (SELECT DISTINCT z // 2 AS cz, y // 2 AS cy, x // 2 AS cx FROM vox WHERE gt <> 0)
      GROUP BY 1, 2, 3 HAVING count(*) / 64.0::DOUBLE >= 0.5::DOUBLE"""),
)
def candidate_locations_masked(spark, root):
    """Locations a random sampler accepts: at least half of the box is masked in.

    The mask is the labels at half resolution: a mask cell is set when any of its voxels is labelled.
    """
    cells = domain.voxels(spark, root).where("gt <> 0").select(*[F.floor(F.col(a) / 2).alias(a) for a in grid.AXES]).distinct()
    share = F.count("*") / F.lit(64.0)
    return (
        cells.groupBy(*grid.block_of((4, 4, 4))).agg(share.alias("s"))
        .where("s >= 0.5D").select("bz", "by", "bx", F.round("s", 6).alias("share"))
    )


@query(
    "random_locations_masked",
    sql("vox", "mask AS (SELECT DISTINCT z // 2 AS z, y // 2 AS y, x // 2 AS x FROM vox WHERE gt <> 0)",
        "tried AS (SELECT o_orderkey AS id, t.a AS attempt, md5('5:' || o_orderkey || ':' || t.a) AS m FROM orders, range(8) t(a))",
        f"""placed AS (SELECT id, attempt,
      ('0x' || m[1:8])::BIGINT * (({DEPTH} + 1) // 2 - 4) // 4294967296 AS z, ('0x' || m[9:16])::BIGINT * 10 // 4294967296 AS y,
      ('0x' || m[17:24])::BIGINT * 8 // 4294967296 AS x FROM tried)""",
        """counted AS (SELECT p.id, p.attempt, p.z, p.y, p.x, count(*) AS inside
      FROM placed p, range(5) i(dz), range(7) j(dy), range(9) k(dx)
      JOIN mask ON mask.z = p.z + dz AND mask.y = p.y + dy AND mask.x = p.x + dx
      GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 300)""",
        body="""SELECT o_orderkey AS id, attempt, z, y, x, inside FROM orders LEFT JOIN counted ON id = o_orderkey
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY attempt) = 1"""),
)
def random_locations_masked(spark, root):
    """A box of 5 x 7 x 9 for every order, drawn until 95 % of it are masked in, at most eight times.

    The mask is that of ``candidate_locations_masked``: labels at half resolution.
    """
    whole = domain.volume_box(spark, root)
    box = grid.Box(whole.begin, tuple(-(-s // 2) for s in whole.shape))
    cells = domain.voxels(spark, root).where("gt <> 0").select(*[F.floor(F.col(a) / 2).alias(a) for a in grid.AXES])
    summed = locations.summed_volume(cells, box, piece=8)
    return locations.random_locations(
        table(spark, root, "orders", "o_orderkey"), summed, box, (5, 7, 9), least=0.95, attempts=8, seed=5, id_col="o_orderkey"
    )


@query(
    "block_durations",
    """SELECT o_orderstatus AS stage, count(*) AS blocks, round(sum(d), 4) AS total_seconds, round(avg(d), 6) AS mean_seconds
       FROM (SELECT o_orderstatus, floor(o_totalprice) / 1000 AS d FROM orders) GROUP BY 1""",
)
def block_durations(spark, root):
    log = table(spark, root, "orders", "o_orderstatus", "o_totalprice").select(
        F.col("o_orderstatus").alias("stage"), (F.floor("o_totalprice") / F.lit(1000)).alias("d")
    )
    return log.groupBy("stage").agg(
        F.count("*").alias("blocks"), F.round(F.sum("d"), 4).alias("total_seconds"), F.round(F.avg("d"), 6).alias("mean_seconds")
    )
