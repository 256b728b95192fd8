"""Queries over the region graph: edge scores, components, sweeps, lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.operators import components, contingency, rag, relabel, spans
from voxelith.plans import domain
from voxelith.plans.domain import SWEEP, sql, sweep_sql
from voxelith.plans.registry import query
from voxelith.session import cut_lineage

VOI_SQL = """tab AS (
  SELECT threshold_pct, gt, segment AS seg, sum(n)::DOUBLE AS n
  FROM (SELECT gt, frag, count(*) AS n FROM vox WHERE gt <> 0 AND frag <> 0 GROUP BY 1, 2) c
  JOIN lut ON lut.fragment = c.frag GROUP BY 1, 2, 3),
tot AS (SELECT threshold_pct, sum(n) AS total, sum(n * log2(n)) AS hj, sum(n * n) AS qj FROM tab GROUP BY 1),
mg AS (SELECT threshold_pct, sum(a * log2(a)) AS h, sum(a * a) AS q
  FROM (SELECT threshold_pct, gt, sum(n) AS a FROM tab GROUP BY 1, 2) GROUP BY 1),
ms AS (SELECT threshold_pct, sum(b * log2(b)) AS h, sum(b * b) AS q
  FROM (SELECT threshold_pct, seg, sum(n) AS b FROM tab GROUP BY 1, 2) GROUP BY 1),
voi AS (SELECT threshold_pct, round(qj / mg.q, 6) + 0 AS rand_split, round(qj / ms.q, 6) + 0 AS rand_merge,
  round((mg.h - hj) / total, 6) + 0 AS voi_split, round((ms.h - hj) / total, 6) + 0 AS voi_merge,
  round((mg.h - hj) / total + (ms.h - hj) / total, 6) + 0 AS voi
  FROM tot JOIN mg USING (threshold_pct) JOIN ms USING (threshold_pct))"""


def sweep_scores(spark, root, points=SWEEP, forest=False):
    """RAND/VOI at every sweep point.

    Voxels are reduced once to (gt, fragment) counts; these meet the spans of points over which a
    fragment keeps its segment, instead of relabelling the volume once per threshold.
    """
    voxels = domain.fragment_voxels(spark, root, "gt")
    overlap = contingency.contingency(voxels, "gt", "frag", ignore_truth_zero=True)
    lut = components.sweep(domain.fragment_ids(voxels), domain.rag_edges(spark, root, voxels=voxels), points, forest)
    held = spans.at_spans(overlap, spans.spans(lut), points, ["seg"])
    table = contingency.contingency(held, "gt", "seg", ["first", "last"], weight="n")
    return contingency.rand_voi(table, points=points)


@query(
    "flagship_sweep_voi",
    sweep_sql(SWEEP, """SELECT CAST(threshold_pct AS BIGINT) AS threshold_pct, rand_split, rand_merge, voi_split, voi_merge, voi,
      voi = (SELECT min(voi) FROM voi) AND threshold_pct =
        (SELECT min(threshold_pct) FROM voi WHERE voi = (SELECT min(voi) FROM voi)) AS best
      FROM voi""", VOI_SQL),
)
def flagship_sweep_voi(spark, root):
    # one row per sweep point from here on, so the best point is looked up on a stored table
    scores = cut_lineage(sweep_scores(spark, root))
    best = scores.agg(F.min(F.struct("voi", "threshold_pct"))["threshold_pct"]).scalar()
    return scores.select(
        F.col("threshold_pct").cast("bigint"),
        "rand_split", "rand_merge", "voi_split", "voi_merge", "voi",
        (F.col("threshold_pct") == best).alias("best"),
    )


def _score_sql(expr: str) -> str:
    return sql("vox", "faces", body=f"SELECT u, v, round(1 - {expr} / 255.0::DOUBLE, 6) AS merge_score, count(*) AS n_faces FROM faces GROUP BY u, v")


def rounded(edges, *columns: str):
    """Scores to six digits, as far as two engines agree on them; operators keep them whole."""
    return edges.withColumns({c: F.round(c, 6) for c in ("merge_score", *columns)})


def _register_scores() -> None:
    def make(name):
        return lambda spark, root: rounded(domain.rag_edges(spark, root, name))

    query("rag_mean_affinity", _score_sql("(sum(aff)::DOUBLE / count(*))"))(make("mean"))
    for q in rag.QUANTILES:
        query(f"rag_quantile_{q}", _score_sql(f"quantile_cont(aff, {q / 100})"))(make(f"quantile_{q}"))
        query(f"rag_hist_quant_{q}", _score_sql(f"quantile_disc(aff, {q / 100})"))(make(f"hist_quant_{q}"))
    query("rag_initmax", _score_sql("max(aff)"))(make("hist_quant_75_initmax"))


_register_scores()


@query(
    "rag_edge_list_both_directions",
    sql("vox", "faces", "rag", body="SELECT u, v, round(merge_score, 6) AS merge_score FROM rag UNION ALL SELECT v, u, round(merge_score, 6) FROM rag"),
)
def rag_edge_list_both_directions(spark, root):
    return rounded(rag.both_directions(domain.rag_edges(spark, root).select("u", "v", "merge_score")))


@query(
    "fragment_centers",
    sql("vox", body="""SELECT frag AS id, CAST(floor(sum(z) * 20 / count(*)) AS BIGINT) AS center_z,
      CAST(floor(sum(y) * 9 / count(*)) AS BIGINT) AS center_y, CAST(floor(sum(x) * 9 / count(*)) AS BIGINT) AS center_x,
      count(*) AS n_voxels FROM vox WHERE frag <> 0 GROUP BY frag"""),
)
def fragment_centers(spark, root):
    return rag.nodes(domain.voxels(spark, root))


AT = 36  # hundredths: the single threshold of the one-point queries


def lut_at(spark, root, points=(AT,)):
    """Lookup table at a few points; nodes and edges share one stored volume."""
    voxels = domain.fragment_voxels(spark, root)
    return components.sweep(domain.fragment_ids(voxels), domain.rag_edges(spark, root, voxels=voxels), list(points))


@query(
    "cc_at_threshold",
    sweep_sql([AT], "SELECT fragment AS id, segment AS component FROM lut"),
)
def cc_at_threshold(spark, root):
    voxels = domain.fragment_voxels(spark, root)
    edges = domain.rag_edges(spark, root, voxels=voxels).where(F.col("merge_score") <= AT / 100)
    return components.connected_components(domain.fragment_ids(voxels), edges)


@query(
    "fragment_segment_lut",
    sweep_sql(SWEEP, "SELECT CAST(threshold_pct AS BIGINT) AS threshold_pct, fragment, segment FROM lut"),
)
def fragment_segment_lut(spark, root):
    return lut_at(spark, root, SWEEP).withColumn("threshold_pct", F.col("threshold_pct").cast("bigint"))


@query(
    "cc_sweep_counts",
    sweep_sql(SWEEP, """SELECT CAST(threshold_pct AS BIGINT) AS threshold_pct, count(*) AS fragments,
      count(DISTINCT segment) AS segments FROM lut GROUP BY 1"""),
)
def cc_sweep_counts(spark, root):
    lut = lut_at(spark, root, SWEEP)
    # a component is named after its smallest member, so segments are the fixed points
    return lut.groupBy(F.col("threshold_pct").cast("bigint").alias("threshold_pct")).agg(
        F.count("*").alias("fragments"), F.count_if(F.col("fragment") == F.col("segment")).alias("segments")
    )


@query(
    "cc_sweep_via_spanning_forest",
    sweep_sql(SWEEP, """SELECT CAST(threshold_pct AS BIGINT) AS threshold_pct, count(*) AS fragments,
      count(DISTINCT segment) AS segments, CAST(sum(segment) AS BIGINT) AS label_sum FROM lut GROUP BY 1"""),
)
def cc_sweep_via_spanning_forest(spark, root):
    voxels = domain.fragment_voxels(spark, root)
    lut = components.sweep(
        domain.fragment_ids(voxels), domain.rag_edges(spark, root, voxels=voxels), SWEEP, forest=True
    )
    return lut.groupBy(F.col("threshold_pct").cast("bigint").alias("threshold_pct")).agg(
        F.count("*").alias("fragments"),
        F.count_if(F.col("fragment") == F.col("segment")).alias("segments"),
        F.sum("segment").alias("label_sum"),
    )


@query(
    "segment_sizes",
    sweep_sql([AT], """SELECT segment, count(DISTINCT fragment) AS fragments, count(*) AS n_voxels
      FROM vox JOIN lut ON lut.fragment = vox.frag GROUP BY segment"""),
)
def segment_sizes(spark, root):
    sizes = domain.voxels(spark, root).where("frag <> 0").groupBy(F.col("frag").alias("fragment")).agg(
        F.count("*").alias("n")
    )
    return sizes.join(lut_at(spark, root), "fragment").groupBy("segment").agg(
        F.count("*").alias("fragments"), F.sum("n").alias("n_voxels")
    )


@query(
    "relabel_volume",
    sweep_sql([AT], "SELECT z, y, x, frag, coalesce(segment, frag) AS segment FROM vox LEFT JOIN lut ON lut.fragment = vox.frag"),
)
def relabel_volume(spark, root):
    voxels = domain.voxels(spark, root).select("z", "y", "x", "frag")
    return relabel.relabel(voxels, lut_at(spark, root), "frag")


@query(
    "relabel_default_zero",
    sweep_sql([AT], """SELECT z, y, x, coalesce(segment, 0) AS segment FROM vox
      LEFT JOIN (SELECT * FROM lut WHERE segment <> fragment) l ON l.fragment = vox.frag"""),
)
def relabel_default_zero(spark, root):
    merged = lut_at(spark, root).where("segment <> fragment")
    return relabel.relabel(domain.voxels(spark, root), merged, "frag", missing="zero").select("z", "y", "x", "segment")


@query(
    "segment_fragments_reverse",
    sweep_sql([AT], """SELECT segment, fragment FROM lut WHERE segment IN
      (SELECT segment FROM lut GROUP BY segment HAVING count(*) > 1)"""),
)
def segment_fragments_reverse(spark, root):
    lut = cut_lineage(lut_at(spark, root).select("segment", "fragment"))
    return lut.join(lut.groupBy("segment").count().where("count > 1"), "segment", "left_semi")


@query(
    "segment_rag",
    sweep_sql([AT], """SELECT a.segment, u, v, round(merge_score, 6) AS merge_score, round(1.0::DOUBLE - merge_score, 6) AS weight FROM rag
      JOIN lut a ON a.fragment = u JOIN lut b ON b.fragment = v AND b.segment = a.segment WHERE merge_score <= 0.36"""),
)
def segment_rag(spark, root):
    voxels = domain.fragment_voxels(spark, root)
    edges = domain.rag_edges(spark, root, voxels=voxels)
    lut = components.sweep(domain.fragment_ids(voxels), edges, [AT])
    return rounded(rag.segment_graph(edges, lut, AT / 100), "weight")


@query(
    "edges_of_nodes_semi",
    sql("vox", "faces", "rag", body="""SELECT u, v, round(merge_score, 6) AS merge_score FROM rag
      WHERE u IN (SELECT frag FROM vox WHERE gt <> 0 AND frag <> 0 GROUP BY frag HAVING count(*) >= 16)"""),
)
def edges_of_nodes_semi(spark, root):
    voxels = domain.fragment_voxels(spark, root, "gt")
    chosen = voxels.where("gt <> 0").groupBy(F.col("frag").alias("u")).count().where("count >= 16")
    return rounded(domain.rag_edges(spark, root, voxels=voxels).select("u", "v", "merge_score").join(chosen, "u", "left_semi"))


@query(
    "densify_labels",
    sql("vox", body="""SELECT z, y, x, frag, d - 1 AS dense FROM vox
      JOIN (SELECT f, dense_rank() OVER (ORDER BY f) AS d FROM (SELECT DISTINCT frag AS f FROM vox)) r ON r.f = vox.frag"""),
)
def densify_labels(spark, root):
    return relabel.densify(domain.voxels(spark, root).select("z", "y", "x", "frag"), "frag")


@query(
    "site_fragment_lut",
    sql("vox", "sites", "located", body="SELECT id AS site, fragment FROM located WHERE fragment <> 0"),
)
def site_fragment_lut(spark, root):
    return relabel.foreground_lut(located_sites(spark, root))


@query("bg_site_count", sql("vox", "sites", "located", body="SELECT count(*) AS num_bg_sites FROM located WHERE fragment = 0"))
def bg_site_count(spark, root):
    return relabel.background_sites(located_sites(spark, root))


def located_sites(spark, root):
    """Sites with world coordinates, their component, and the fragment they fall into."""
    return relabel.site_fragments(
        domain.sites(spark, root), domain.voxels(spark, root), domain.VOXEL_SIZE
    )
