"""Queries that run dense helpers per block."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.operators import blockops, distances, predict, volumes
from voxelith.operators.grid import AXES
from voxelith.plans import domain
from voxelith.plans.domain import sql
from voxelith.plans.registry import query
from voxelith.session import cut_lineage

SIZE = (16, 16, 16)

# Squared distance to the nearest cell of the other kind in the 16-cube, axis by axis.
DENSE = """dense AS (
  SELECT a.z, b.y, c.x, coalesce({inside}, FALSE) AS inside
  FROM (SELECT DISTINCT z // 16 AS bz, y // 16 AS "by", x // 16 AS bx FROM vox) k,
    range(16) p(dz), range(16) q(dy), range(16) r(dx),
    LATERAL (SELECT bz * 16 + dz AS z) a, LATERAL (SELECT "by" * 16 + dy AS y) b, LATERAL (SELECT bx * 16 + dx AS x) c
  LEFT JOIN vox v ON v.z = a.z AND v.y = b.y AND v.x = c.x)"""


def edt_parts(inside: str) -> list[str]:
    parts = [DENSE.format(inside=inside)]
    for name, wanted in (("far_out", "FALSE"), ("far_in", "TRUE")):
        parts += [
            f"""{name}1 AS (SELECT a.z, a.y, a.x, min((a.z - b.z) * (a.z - b.z)) AS d FROM dense a JOIN dense b
              ON b.inside = {wanted} AND b.y = a.y AND b.x = a.x AND b.z // 16 = a.z // 16 GROUP BY 1, 2, 3)""",
            f"""{name}2 AS (SELECT a.z, a.y, a.x, min(b.d + (a.y - b.y) * (a.y - b.y)) AS d FROM dense a JOIN {name}1 b
              ON b.z = a.z AND b.x = a.x AND b.y // 16 = a.y // 16 GROUP BY 1, 2, 3)""",
            f"""{name} AS (SELECT a.z, a.y, a.x, min(b.d + (a.x - b.x) * (a.x - b.x)) AS d FROM vox a JOIN {name}2 b
              ON b.z = a.z AND b.y = a.y AND b.x // 16 = a.x // 16 GROUP BY 1, 2, 3)""",
        ]
    return parts


MASK = "az + ay + ax > 382"


def masked(spark, root):
    inside = volumes.affinity_mask().cast("int")
    return domain.voxels(spark, root).withColumn("inside", inside)


@query(
    "edt_squared",
    sql("vox", *edt_parts(MASK), body="""SELECT v.z, v.y, v.x, CASE WHEN az + ay + ax > 382 THEN f.d ELSE 0 END AS dist2
      FROM vox v LEFT JOIN far_out f ON f.z = v.z AND f.y = v.y AND f.x = v.x"""),
)
def edt_squared(spark, root):
    return blockops.squared_edt(masked(spark, root), "inside", SIZE)


@query(
    "vector_distmap_norm",
    sql("vox", *edt_parts(MASK), body="""SELECT v.z, v.y, v.x, CASE WHEN az + ay + ax > 382 THEN f.d ELSE 0 END AS dist2
      FROM vox v LEFT JOIN far_out f ON f.z = v.z AND f.y = v.y AND f.x = v.x"""),
)
def vector_distmap_norm(spark, root):
    """Length of the offset vectors; the vectors themselves depend on how ties are broken."""
    vectors = blockops.vector_distmap(masked(spark, root), "inside", SIZE)
    return vectors.select(*AXES, F.expr("dz * dz + dy * dy + dx * dx").alias("dist2"))


@query(
    "signed_tanh_distmap",
    sql("vox", *edt_parts("gt > 0"), body="""SELECT v.z, v.y, v.x, round(CASE WHEN gt > 0 THEN coalesce(tanh(sqrt(o.d) / 50), 1)
        ELSE coalesce(-tanh(sqrt(i.d) / 50), -1) END, 6) AS distmap
      FROM vox v LEFT JOIN far_out o ON o.z = v.z AND o.y = v.y AND o.x = v.x
      LEFT JOIN far_in i ON i.z = v.z AND i.y = v.y AND i.x = v.x"""),
)
def signed_tanh_distmap(spark, root):
    out = blockops.signed_distmap(domain.voxels(spark, root), "gt", SIZE)
    return out.select(*AXES, F.round("distmap", 6).alias("distmap"))


# Along z the nearer end of a run of inside voxels, then every cell of the line along y and x.
WHOLE_EDT = [
    "top AS (SELECT max(z) AS z FROM vox)",
    f"vm AS MATERIALIZED (SELECT z, y, x FROM vox WHERE {MASK})",
    """z1 AS MATERIALIZED (
      SELECT z, y, x, nullif(least(CASE WHEN a > 0 THEN z - a + 1 ELSE 1000000000 END, CASE WHEN b < (SELECT z FROM top) THEN b + 1 - z ELSE 1000000000 END), 1000000000) AS d
      FROM (SELECT *, min(z) OVER r AS a, max(z) OVER r AS b
            FROM (SELECT *, z - row_number() OVER (PARTITION BY y, x ORDER BY z) AS run FROM vm) WINDOW r AS (PARTITION BY y, x, run)))""",
    """y1 AS MATERIALIZED (
      SELECT v.z, v.y, v.x, min((v.y - l.y) * (v.y - l.y) + CASE WHEN o.z IS NULL THEN 0 ELSE o.d * o.d END) AS d
      FROM vm v, range(32) l(y) LEFT JOIN z1 o ON o.z = v.z AND o.y = l.y AND o.x = v.x GROUP BY v.z, v.y, v.x)""",
]


@query(
    "edt_whole_volume",
    sql("vox", *WHOLE_EDT, body="""SELECT v.z, v.y, v.x, CAST(min((v.x - l.x) * (v.x - l.x) + CASE WHEN o.z IS NULL THEN 0 ELSE o.d END) AS BIGINT) AS dist2
      FROM vm v, range(32) l(x) LEFT JOIN y1 o ON o.z = v.z AND o.y = v.y AND o.x = l.x GROUP BY v.z, v.y, v.x"""),
)
def edt_whole_volume(spark, root):
    """Distances that no block border ends."""
    return distances.exact_squared_distance(masked(spark, root), "inside", domain.volume_box(spark, root))


REGIONS = """vm AS (SELECT z, y, x, (z * 32 + y) * 32 + x AS id FROM vox WHERE az + ay + ax > 382),
vp AS (SELECT a.id AS u, b.id AS v FROM vm a JOIN vm b ON b.z = a.z - 1 AND b.y = a.y AND b.x = a.x
  UNION ALL SELECT a.id, b.id FROM vm a JOIN vm b ON b.z = a.z AND b.y = a.y - 1 AND b.x = a.x
  UNION ALL SELECT a.id, b.id FROM vm a JOIN vm b ON b.z = a.z AND b.y = a.y AND b.x = a.x - 1),
ed AS (SELECT 0 AS t, u AS n, v AS o FROM vp UNION ALL SELECT 0, v, u FROM vp)"""


@query(
    "seed_components",
    sql("vox", REGIONS, "cc", body="SELECT z, y, x, coalesce(cc.m, id) AS region FROM vm LEFT JOIN cc ON cc.n = vm.id"),
)
def seed_components(spark, root):
    return blockops.label_volume(masked(spark, root), "inside", SIZE, (32, 32))


def watershed_sql(context: tuple[int, int, int], width: int, per_section: bool) -> str:
    """Distances, seeds and flood in every block's read box, one relation a step.

    ``b`` numbers a block, ``k`` a cell in its read box in scan order. A cell's ``at`` is the rank
    of its height times a million plus the round in which it is taken: the least over its labelled
    neighbours of the same round's successor, or of the first round at the cell's own height.
    """
    low = [f"g.b{a} * 16 - {c}" for a, c in zip("zyx", context)]
    shape = [16 + 2 * c for c in context]
    axes = "yx" if per_section else "zyx"
    lines = {"z": "y = b.y AND a.x = b.x", "y": "z = b.z AND a.x = b.x", "x": "z = b.z AND a.y = b.y"}
    parts = [
        """g AS MATERIALIZED (SELECT DISTINCT z // 16 AS bz, y // 16 AS "by", x // 16 AS bx, (z // 16 * 2 + y // 16) * 2 + x // 16 AS b FROM vox)""",
        f"""box AS (SELECT g.b, g.bz, g."by", g.bx, d.dz, d.dy, d.dx, (d.dz * {shape[1]} + d.dy) * {shape[2]} + d.dx AS k, {low[0]} + d.dz AS z, {low[1].replace("by", '"by"')} + d.dy AS y, {low[2]} + d.dx AS x
          FROM g, (SELECT i AS dz, j AS dy, l AS dx FROM range({shape[0]}) p(i), range({shape[1]}) q(j), range({shape[2]}) r(l)) d)""",
        f"""d0 AS MATERIALIZED (SELECT box.*, CASE WHEN coalesce({MASK}, FALSE) THEN 1000000000000000 ELSE 0 END AS d
          FROM box LEFT JOIN vox v ON v.z = box.z AND v.y = box.y AND v.x = box.x)""",
    ]
    for n, axis in enumerate(axes):
        parts.append(f"""d{n + 1} AS MATERIALIZED (
          SELECT * FROM d{n} WHERE d = 0
          UNION ALL SELECT * EXCLUDE (m) REPLACE (m AS d) FROM (
            SELECT a.*, (SELECT min(b.d + (a.{axis} - b.{axis}) * (a.{axis} - b.{axis})) FROM d{n} b WHERE a.b = b.b AND a.{lines[axis]}) AS m FROM d{n} a WHERE a.d > 0))""")
    up, down = width // 2, (width - 1) // 2
    window = " AND ".join(f"o.{a} BETWEEN c.{a} - {up} AND c.{a} + {down}" for a in axes) + (" AND o.z = c.z" if per_section else "")
    steps = [(s, a) for a in axes for s in (1, -1)]
    stride = {"z": shape[1] * shape[2], "y": shape[2], "x": 1}
    edge = {a: n for a, n in zip("zyx", shape)}
    inside = {(s, a): f"c.d{a} < {edge[a] - 1}" if s > 0 else f"c.d{a} > 0" for s, a in steps}
    near = " UNION ALL ".join(f"SELECT c.b, c.k, c.k + {s * stride[a]} AS k2 FROM c WHERE {inside[s, a]}" for s, a in steps)
    size = {a: stride[a] * edge[a] for a in axes}
    runs = [(f"k % {size[a]} // {stride[a]}", f"k // {size[a]} * {stride[a]} + k % {stride[a]}") for a in reversed(axes)]
    own = " AND ".join(f"d{a} BETWEEN {c} AND {c + 15}" for a, c in zip("zyx", context))
    return sql(
        "vox", *parts,
        f"c AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY d DESC) AS h FROM d{len(axes)} WHERE d > 0)",
        f"e AS MATERIALIZED (SELECT n.b, n.k, n.k2, c.h AS h2 FROM ({near}) n JOIN c ON c.b = n.b AND c.k = n.k2)",
        f"s AS MATERIALIZED (SELECT b, k FROM c ANTI JOIN c o ON o.b = c.b AND {window} AND o.d > c.d)",
        # a start that shortens the search: the least of the runs along each axis
        *[
            f"""run{n} AS (
              SELECT b, k, min(m) OVER (PARTITION BY b, other, stretch) AS m
              FROM (SELECT *, place - row_number() OVER (PARTITION BY b, other ORDER BY k) AS stretch
                    FROM (SELECT b, k, m, {place} AS place, {other} AS other FROM {"(SELECT b, k, k AS m FROM s)" if n == 0 else f"run{n - 1}"})))"""
            for n, (place, other) in enumerate(runs)
        ],
        f"""seed(b, k, m) USING KEY (b, k) AS (
          SELECT b, k, m FROM run{len(runs) - 1}
          UNION
          SELECT e.b, e.k2, min(a.m) FROM seed a JOIN e ON e.b = a.b AND e.k = a.k JOIN recurring.seed t ON t.b = e.b AND t.k = e.k2
          GROUP BY e.b, e.k2, t.m HAVING min(a.m) < t.m)""",
        """arrive(b, k, t) USING KEY (b, k) AS (
          SELECT b, k, CAST(0 AS BIGINT) FROM s
          UNION
          SELECT e.b, e.k2, min(CASE WHEN a.t // 1000000 >= e.h2 THEN a.t + 1 ELSE e.h2 * 1000000 + 1 END)
          FROM arrive a JOIN e ON e.b = a.b AND e.k = a.k LEFT JOIN recurring.arrive t ON t.b = e.b AND t.k = e.k2
          GROUP BY e.b, e.k2, t.t
          HAVING t.t IS NULL OR min(CASE WHEN a.t // 1000000 >= e.h2 THEN a.t + 1 ELSE e.h2 * 1000000 + 1 END) < t.t)""",
        """flow AS MATERIALIZED (
          SELECT e.b, e.k, e.k2 FROM e JOIN arrive f ON f.b = e.b AND f.k = e.k JOIN arrive t ON t.b = e.b AND t.k = e.k2
          WHERE t.t = CASE WHEN f.t // 1000000 >= e.h2 THEN f.t + 1 ELSE e.h2 * 1000000 + 1 END)""",
        """flooded(b, k, m) USING KEY (b, k) AS (
          SELECT b, k, m FROM seed
          UNION
          SELECT e.b, e.k2, min(a.m) FROM flooded a JOIN flow e ON e.b = a.b AND e.k = a.k LEFT JOIN recurring.flooded t ON t.b = e.b AND t.k = e.k2
          GROUP BY e.b, e.k2, t.m HAVING t.m IS NULL OR min(a.m) < t.m)""",
        f"named AS (SELECT c.z, c.y, c.x, f.b * 4096 + dense_rank() OVER (PARTITION BY f.b ORDER BY f.m) AS fragment FROM flooded f JOIN c ON c.b = f.b AND c.k = f.k WHERE {own})",
        body="SELECT v.z, v.y, v.x, CAST(coalesce(n.fragment, 0) AS BIGINT) AS fragment FROM vox v LEFT JOIN named n ON n.z = v.z AND n.y = v.y AND n.x = v.x",
    )


@query("watershed_fragments", watershed_sql((4, 4, 4), 4, False))
def watershed_fragments(spark, root):
    return blockops.watershed(masked(spark, root), "inside", SIZE, (2, 2), (4, 4, 4), min_seed_distance=4, extent=domain.EXTENT)


@query("watershed_fragments_xy", watershed_sql((0, 4, 4), 4, True))
def watershed_fragments_xy(spark, root):
    return blockops.watershed(
        masked(spark, root), "inside", SIZE, (2, 2), (0, 4, 4), 4, per_section=True, extent=domain.EXTENT
    )


CONTEXT = (4, 4, 4)  # voxels that agglomeration sees around a block


def agglomeration_sql(name: str, context: tuple[int, int, int] = (0, 0, 0)) -> list[str]:
    """One row per block and step: contacts with their affinities, the pairs' and the nodes' regions so far.

    A step merges the contact of least (score, u, v) into its smaller region; contacts that meet
    are pooled and scored anew, and a pair whose ends meet takes the step's score. ``top`` is the
    largest score of all steps so far.
    """
    def score(h: str) -> str:
        if name == "mean":
            return f"1 - list_sum({h}) / len({h}) / 255.0::DOUBLE"
        q = int(name.removesuffix("_initmax").rsplit("_", 1)[1])
        return f"1 - list_sort({h})[({q} * len({h}) + 99) // 100] / 255.0::DOUBLE"

    first = "1 - list_max(h) / 255.0::DOUBLE" if name.endswith("_initmax") else score("h")
    axes = [("z", "az"), ("y", "ay"), ("x", "ax")]
    faces = " UNION ALL ".join(
        f"""SELECT a.z, a.y, a.x, {i} AS axis, least(a.frag, b.frag) AS u, greatest(a.frag, b.frag) AS v, a.{aff} AS aff
          FROM vox a JOIN vox b ON {" AND ".join(f"b.{c} = a.{c}" + (" - 1" if c == axis else "") for c, _ in axes)}
          WHERE a.frag <> 0 AND b.frag <> 0 AND a.frag <> b.frag"""
        for i, (axis, aff) in enumerate(axes)
    )
    seen = " AND ".join(
        f"(d{a} = 0 OR (d{a} < 0 AND {a} % 16 < {c}) OR (d{a} > 0 AND {a} % 16 >= 16 - {c} + CASE WHEN axis = {i} THEN 1 ELSE 0 END))"
        for i, (a, c) in enumerate(zip("zyx", context))
    )
    return [
        f"af AS MATERIALIZED ({faces})",
        """ob AS (SELECT DISTINCT z // 16 AS bz, y // 16 AS "by", x // 16 AS bx FROM af)""",
        f"""bf AS (
          SELECT ob.bz, ob."by", ob.bx, u, v, aff
          FROM (SELECT af.*, dz, dy, dx FROM af, range(-1, 2) p(dz), range(-1, 2) q(dy), range(-1, 2) r(dx) WHERE {seen}) f
          JOIN ob ON ob.bz = z // 16 + dz AND ob."by" = y // 16 + dy AND ob.bx = x // 16 + dx)""",
        """owner AS (
          SELECT u, v, o.bz AS bz, o."by" AS "by", o.bx AS bx
          FROM (SELECT u, v, arg_min({'bz': z // 16, 'by': y // 16, 'bx': x // 16}, (z, y, x, axis)) AS o FROM af GROUP BY u, v))""",
        """contacts AS (SELECT bz, "by", bx, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, list(CAST(aff AS BIGINT)) AS h FROM bf GROUP BY ALL)""",
        f"""steps(bz, "by", bx, n, top, edges, pairs, nodes) AS (
          SELECT bz, "by", bx, 0, CAST('-infinity' AS DOUBLE), list({{'s': {first}, 'u': u, 'v': v, 'h': h}}),
            list({{'u': u, 'v': v, 'cu': u, 'cv': v, 'level': CAST(NULL AS DOUBLE)}}),
            list_transform(list_distinct(flatten(list([u, v]))), lambda i: {{'id': i, 'root': i}})
          FROM contacts GROUP BY bz, "by", bx
          UNION ALL
          SELECT bz, "by", bx, n + 1, greatest(top, m.s),
            list_transform(
              list_transform(list_distinct(list_transform(moved, lambda e: {{'u': e.u, 'v': e.v}})),
                             lambda p: list_filter(moved, lambda e: e.u = p.u AND e.v = p.v)),
              lambda x: CASE WHEN len(x) = 1 THEN x[1] ELSE
                {{'s': {score("flatten(list_transform(x, lambda e: e.h))")}, 'u': x[1].u, 'v': x[1].v, 'h': flatten(list_transform(x, lambda e: e.h))}} END)
              || list_filter(edges, lambda e: e.u NOT IN (m.u, m.v) AND e.v NOT IN (m.u, m.v)),
            list_transform(
              list_transform(pairs, lambda p: {{'u': p.u, 'v': p.v, 'cu': CASE WHEN p.cu = m.v THEN m.u ELSE p.cu END,
                                               'cv': CASE WHEN p.cv = m.v THEN m.u ELSE p.cv END, 'level': p.level}}),
              lambda p: {{'u': p.u, 'v': p.v, 'cu': p.cu, 'cv': p.cv, 'level': CASE WHEN p.level IS NULL AND p.cu = p.cv THEN m.s ELSE p.level END}}),
            list_transform(nodes, lambda i: {{'id': i.id, 'root': CASE WHEN i.root = m.v THEN m.u ELSE i.root END}})
          FROM (SELECT *, list_transform(
                  list_filter(edges, lambda e: NOT (e.u = m.u AND e.v = m.v) AND (e.u IN (m.u, m.v) OR e.v IN (m.u, m.v))),
                  lambda e: {{'s': e.s, 'u': least(CASE WHEN e.u = m.v THEN m.u ELSE e.u END, CASE WHEN e.v = m.v THEN m.u ELSE e.v END),
                              'v': greatest(CASE WHEN e.u = m.v THEN m.u ELSE e.u END, CASE WHEN e.v = m.v THEN m.u ELSE e.v END), 'h': e.h}}) AS moved
                FROM (SELECT *, list_sort(edges)[1] AS m FROM steps WHERE len(edges) > 0)))""",
        """scored AS (SELECT bz, "by", bx, p.u AS u, p.v AS v, p.level AS merge_score
          FROM (SELECT bz, "by", bx, unnest(pairs) AS p FROM steps WHERE len(edges) = 0))""",
    ]


def agglomeration_oracle(name: str) -> str:
    return sql(
        "vox", *agglomeration_sql(name, CONTEXT),
        body="SELECT s.u, s.v, round(s.merge_score, 6) AS merge_score FROM scored s JOIN owner o ON o.u = s.u AND o.v = s.v AND o.bz = s.bz AND o.\"by\" = s.\"by\" AND o.bx = s.bx",
    )


def block_edges(spark, root, name: str):
    edges = blockops.agglomerated_edges(domain.voxels(spark, root), "frag", SIZE, name, CONTEXT, domain.EXTENT)
    return edges.withColumn("merge_score", F.round("merge_score", 6))


@query("agglomerate_block_edges", agglomeration_oracle("hist_quant_75"))
def agglomerate_block_edges(spark, root):
    return block_edges(spark, root, "hist_quant_75")


@query("agglomerate_block_edges_initmax", agglomeration_oracle("hist_quant_75_initmax"))
def agglomerate_block_edges_initmax(spark, root):
    return block_edges(spark, root, "hist_quant_75_initmax")


@query("agglomerate_block_edges_mean", agglomeration_oracle("mean"))
def agglomerate_block_edges_mean(spark, root):
    return block_edges(spark, root, "mean")


CUTS = [10, 20, 30, 40, 50]  # hundredths


@query(
    "agglomerate_segmentations",
    sql("vox", *agglomeration_sql("hist_quant_50"), f"cuts AS (SELECT unnest({CUTS!r}) AS threshold)",
        """best AS (
          SELECT bz, "by", bx, threshold, unnest(nodes) AS i
          FROM (SELECT bz, "by", bx, threshold, arg_max(nodes, n) AS nodes FROM steps JOIN cuts ON top <= threshold / 100.0::DOUBLE GROUP BY bz, "by", bx, threshold))""",
        body="""SELECT f.bz, f."by", f.bx, CAST(f.threshold AS INTEGER) AS threshold, f.fragment, coalesce(best.i.root, f.fragment) AS segment
          FROM (SELECT DISTINCT z // 16 AS bz, y // 16 AS "by", x // 16 AS bx, frag AS fragment, threshold FROM vox, cuts WHERE frag <> 0) f
          LEFT JOIN best ON best.bz = f.bz AND best."by" = f."by" AND best.bx = f.bx AND best.threshold = f.threshold AND best.i.id = f.fragment"""),
)
def agglomerate_segmentations(spark, root):
    """Each block as a cube of its own, segmented at five thresholds from one merge tree."""
    vox = cut_lineage(domain.voxels(spark, root))
    return blockops.segmentations(blockops.merge_trees(vox, "frag", SIZE, "hist_quant_50"), vox, "frag", SIZE, CUTS)


@query(
    "epsilon_agglomeration",
    sql("vox", *agglomeration_sql("hist_quant_25"),
        "ed AS (SELECT 0 AS t, u AS n, v AS o FROM scored WHERE merge_score <= 0.3::DOUBLE UNION ALL SELECT 0, v, u FROM scored WHERE merge_score <= 0.3::DOUBLE)",
        "cc", body="""SELECT f.id AS fragment, coalesce(cc.m, f.id) AS segment
          FROM (SELECT DISTINCT frag AS id FROM vox WHERE frag <> 0) f LEFT JOIN cc ON cc.n = f.id"""),
)
def epsilon_agglomeration(spark, root):
    return blockops.epsilon_fragments(cut_lineage(domain.voxels(spark, root)), "frag", SIZE, 0.3)


def _moment_sql() -> str:
    weight = "exp(-0.5 * power(d / 1.0, 2)) / (SELECT sum(exp(-0.5 * power(k / 1.0, 2))) FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS k))"
    offsets = f"o AS (SELECT d, {weight} AS w FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d))"
    near = """m AS (SELECT a.z, a.y, a.x, sum(w) AS n, sum(w * dz) / sum(w) AS mz, sum(w * dy) / sum(w) AS my, sum(w * dx) / sum(w) AS mx,
      sum(w * dz * dz) / sum(w) AS zz, sum(w * dy * dy) / sum(w) AS yy, sum(w * dx * dx) / sum(w) AS xx,
      sum(w * dz * dy) / sum(w) AS zy, sum(w * dz * dx) / sum(w) AS zx, sum(w * dy * dx) / sum(w) AS yx
      FROM (SELECT z, y, x, gt, p.d AS dz, q.d AS dy, r.d AS dx, p.w * q.w * r.w AS w FROM vox, o p, o q, o r WHERE gt <> 0) a
      JOIN vox b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.gt = a.gt GROUP BY 1, 2, 3)"""
    var = """s AS (SELECT *, greatest(zz - mz * mz, 0.001) AS vz, greatest(yy - my * my, 0.001) AS vy, greatest(xx - mx * mx, 0.001) AS vx FROM m)"""
    clip = lambda e, n: f"round(least(greatest({e}, 0.0), 1.0), 5) AS {n}"
    cols = [clip(f"m{a} * 0.5 + 0.5", f"off_{a}") for a in "zyx"] + [clip(f"v{a}", f"var_{a}") for a in "zyx"]
    cols += [clip(f"({p} - m{p[0]} * m{p[1]}) / sqrt(v{p[0]} * v{p[1]}) * 0.5 + 0.5", f"cov_{p}") for p in ("zy", "zx", "yx")]
    cols += [clip("n", "size")]
    zero = ", ".join("0.0::DOUBLE" for _ in cols)
    return sql("vox", offsets, near, var, body=f"SELECT z, y, x, {', '.join(cols)} FROM s UNION ALL SELECT z, y, x, {zero} FROM vox WHERE gt = 0")


@query("lsd_moments", _moment_sql())
def lsd_moments(spark, root):
    lsd = blockops.shape_descriptors(domain.voxels(spark, root), "gt", SIZE, sigma=1.0, reach=2, extent=domain.EXTENT)
    return lsd.select(*AXES, *[F.round(c, 5).alias(c) for c in lsd.columns if c not in AXES])


@query(
    "predict_block_box_mean",
    sql("vox", body="""SELECT a.z, a.y, a.x, round(sum(b.raw) / 27.0::DOUBLE, 6) AS mean
      FROM (SELECT z, y, x, z + p.d AS bz, y + q.d AS "by", x + r.d AS bx FROM vox,
              (SELECT unnest([-1, 0, 1]) AS d) p, (SELECT unnest([-1, 0, 1]) AS d) q, (SELECT unnest([-1, 0, 1]) AS d) r) a
      JOIN vox b ON b.z = a.bz AND b.y = a."by" AND b.x = a.bx GROUP BY 1, 2, 3"""),
)
def predict_block_box_mean(spark, root):
    """A model with a 3 x 3 x 3 neighbourhood, applied block by block with context."""
    out = predict.predict_blocks(domain.voxels(spark, root), predict.box_mean_model(), ["raw"], ["mean"], SIZE, domain.EXTENT)
    return out.select(*AXES, F.round("mean", 6).alias("mean"))
