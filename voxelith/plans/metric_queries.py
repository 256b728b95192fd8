"""Queries over label overlap tables and skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.operators import components, contingency, ordering, rag, relabel, skeletons, spans, volumes
from voxelith.plans import domain
from voxelith.plans.domain import SWEEP, sql, sweep_sql
from voxelith.plans.graph_queries import AT, located_sites, lut_at
from voxelith.plans.registry import query
from voxelith.session import cut_lineage
from voxelith.sources.tables import table

TAB = """tab AS (SELECT p_brand AS gt, l_suppkey AS seg, count(*)::DOUBLE AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
VOX_TAB = "tab AS (SELECT gt, frag AS seg, count(*)::DOUBLE AS n FROM vox {where} GROUP BY 1, 2)"
VOI = """SELECT round(qj / qg, 6) + 0 AS rand_split, round(qj / qs, 6) + 0 AS rand_merge,
  round((hg - hj) / total, 6) + 0 AS voi_split, round((hs - hj) / total, 6) + 0 AS voi_merge,
  round((hg - hj) / total + (hs - hj) / total, 6) + 0 AS voi
FROM (SELECT sum(n) AS total, sum(n * log2(n)) AS hj, sum(n * n) AS qj FROM tab),
  (SELECT sum(a * log2(a)) AS hg, sum(a * a) AS qg FROM (SELECT sum(n) AS a FROM tab GROUP BY gt)),
  (SELECT sum(b * log2(b)) AS hs, sum(b * b) AS qs FROM (SELECT sum(n) AS b FROM tab GROUP BY seg))"""


def overlap(spark, root):
    """Brand against supplier over all line items.

    Line items are first counted per (part, supplier), so the join moves counts, not items.
    """
    counts = table(spark, root, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("c")
    )
    brands = table(spark, root, "part", "p_partkey", "p_brand")
    joined = counts.join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return contingency.contingency(joined, "p_brand", "l_suppkey", weight="c")


@query("rand_voi", sql(TAB, body=VOI))
def rand_voi(spark, root):
    return contingency.rand_voi(overlap(spark, root))


@query("rand_voi_volume", sql("vox", VOX_TAB.format(where=""), body=VOI))
def rand_voi_volume(spark, root):
    return contingency.rand_voi(contingency.contingency(domain.voxels(spark, root), "gt", "frag"))


@query("rand_voi_ignore_background", sql("vox", VOX_TAB.format(where="WHERE gt <> 0"), body=VOI))
def rand_voi_ignore_background(spark, root):
    return contingency.rand_voi(
        contingency.contingency(domain.voxels(spark, root), "gt", "frag", ignore_truth_zero=True)
    )


def _cluster_sql(by: str, name: str, tail: str = "") -> str:
    return sql(TAB, body=f"""SELECT {by} AS cluster,
      round((sum(n) * log2(sum(n)) - sum(n * log2(n))) / (SELECT sum(n) FROM tab), 6) + 0 AS {name}
      FROM tab GROUP BY {by} {tail}""")


@query("voi_per_gt_cluster", _cluster_sql("gt", "voi_split_i"))
def voi_per_gt_cluster(spark, root):
    return contingency.cluster_voi(overlap(spark, root), "gt")


@query("voi_per_seg_cluster", _cluster_sql("seg", "voi_merge_j"))
def voi_per_seg_cluster(spark, root):
    return contingency.cluster_voi(overlap(spark, root), "seg")


@query("worst_splits_top10", _cluster_sql("gt", "voi_split_i", "ORDER BY 2 DESC, 1 DESC LIMIT 10"))
def worst_splits_top10(spark, root):
    return contingency.worst(contingency.cluster_voi(overlap(spark, root), "gt"), "voi_split_i")


@query("worst_merges_top10", _cluster_sql("seg", "voi_merge_j", "ORDER BY 2 DESC, 1 DESC LIMIT 10"))
def worst_merges_top10(spark, root):
    return contingency.worst(contingency.cluster_voi(overlap(spark, root), "seg"), "voi_merge_j")


@query(
    "synaptic_sites",
    sql("site_edges", body="SELECT source AS id FROM site_edges WHERE source % 3 = 0 UNION SELECT target FROM site_edges WHERE source % 3 = 0"),
)
def synaptic_sites(spark, root):
    return relabel.endpoints(synapses(spark, root))


def synapses(spark, root):
    """Synapse edges: the site edges that start at every third site."""
    return domain.site_edges(spark, root).where("source % 3 = 0")


@query(
    "synaptic_voi_subset",
    sql("vox", "sites", "located", "site_edges", """syn AS (SELECT source AS id FROM site_edges WHERE source % 3 = 0
        UNION SELECT target FROM site_edges WHERE source % 3 = 0)""",
        "tab AS (SELECT component AS gt, fragment AS seg, count(*)::DOUBLE AS n FROM located WHERE id IN (SELECT id FROM syn) GROUP BY 1, 2)",
        body=VOI),
)
def synaptic_voi_subset(spark, root):
    chosen = located_sites(spark, root).join(relabel.endpoints(synapses(spark, root)), "id", "left_semi")
    return contingency.rand_voi(contingency.contingency(chosen, "component", "fragment"))


# --- skeletons -------------------------------------------------------------------------------


def skeleton(spark, root):
    """Nodes and edges of the per-user skeletons; edges follow time order within a user."""
    nodes = domain.skeleton_nodes(spark, root)
    chained = ordering.next_in_group(
        nodes.select("id", "component", "ts"), "component", ["ts", "id"], domain.minute_of("ts"), "id", "target"
    )
    edges = chained.where("target IS NOT NULL").select(F.col("id").alias("source"), "target")
    return nodes.drop("ts"), edges


def attributed(spark, root):
    nodes, edges = skeleton(spark, root)
    return nodes, skeletons.attribute_edges(nodes, edges)


@query("skeleton_edges", sql("skel", "skel_edges", body="SELECT source, target FROM skel_edges"))
def skeleton_edges(spark, root):
    return skeleton(spark, root)[1]


SKEL = ("skel", "skel_edges", "skel_attr", "merging")
ERL = """SELECT round(run2 / len, 6) AS erl, round(len2 / len, 6) AS max_erl, round(run2 / len2, 6) AS normalized_erl,
  round(len, 6) AS total_path_length
FROM (SELECT sum(r * r) AS run2 FROM (SELECT sum(length) AS r FROM skel_attr
    WHERE su = sv AND {bg} su NOT IN (SELECT seg FROM merging) GROUP BY component, su)),
  (SELECT sum(l * l) AS len2, sum(l) AS len FROM (SELECT sum(length) AS l FROM skel_attr GROUP BY component))"""


@query(
    "skeleton_lengths",
    sql(*SKEL, body="SELECT component, round(sum(length), 6) AS length FROM skel_attr GROUP BY component"),
)
def skeleton_lengths(spark, root):
    return skeletons.lengths(attributed(spark, root)[1])


@query("expected_run_length", sql(*SKEL, body=ERL.format(bg="su <> 0 AND")))
def expected_run_length(spark, root):
    nodes, edges = attributed(spark, root)
    return skeletons.expected_run_length(edges, skeletons.merging_segments(nodes))


@query("expected_run_length_with_background", sql(*SKEL, body=ERL.format(bg="")))
def expected_run_length_with_background(spark, root):
    nodes, edges = attributed(spark, root)
    return skeletons.expected_run_length(edges, skeletons.merging_segments(nodes), omit_background=False)


@query(
    "max_erl_perfect_labelling",
    sql(*SKEL, body="""SELECT round(sum(l * l) / sum(l), 6) AS erl
      FROM (SELECT sum(length) AS l FROM skel_attr GROUP BY component)"""),
)
def max_erl_perfect_labelling(spark, root):
    """The general ERL run on the perfect lookup table (segment = component)."""
    nodes, edges = skeleton(spark, root)
    perfect = nodes.withColumn("seg", F.col("component") + 1)
    scored = skeletons.expected_run_length(
        skeletons.attribute_edges(perfect, edges), skeletons.merging_segments(perfect)
    )
    return scored.select("erl")


@query("split_stats", sql(*SKEL, body="SELECT DISTINCT component, su, sv FROM skel_attr WHERE su <> sv"))
def split_stats(spark, root):
    return skeletons.split_pairs(attributed(spark, root)[1])


@query(
    "merge_stats",
    sql(*SKEL, body="SELECT DISTINCT seg, component FROM skel WHERE seg IN (SELECT seg FROM merging)"),
)
def merge_stats(spark, root):
    return skeletons.merge_pairs(domain.skeleton_nodes(spark, root))


@query(
    "split_documents",
    sql(*SKEL, body="""SELECT component AS comp_id, su AS a, sv AS b, count(*) OVER (PARTITION BY component) AS n_pairs
      FROM (SELECT DISTINCT component, su, sv FROM skel_attr WHERE su <> sv)"""),
)
def split_documents(spark, root):
    return skeletons.split_documents(skeletons.split_pairs(attributed(spark, root)[1]))


@query(
    "merge_documents",
    sql(*SKEL, body="""SELECT seg AS seg_id, component AS comp_id, component = max(component) OVER (PARTITION BY seg) AS is_last
      FROM (SELECT DISTINCT seg, component FROM skel WHERE seg IN (SELECT seg FROM merging))"""),
)
def merge_documents(spark, root):
    """Merge statistics entry by entry, with the last one of each list marked."""
    return skeletons.merge_documents(skeletons.merge_pairs(domain.skeleton_nodes(spark, root)))


@query(
    "annotation_points",
    sql("sites", body="SELECT id, z, y, x FROM sites"),
)
def annotation_points(spark, root):
    """Flat id and location arrays, as annotation files hold them, back to one row per point.

    A run of 50 sites makes one pair of arrays, so their length is fixed.
    """
    by_run = domain.sites(spark, root).groupBy("component").agg(
        F.sort_array(F.collect_list(F.struct("id", "z", "y", "x"))).alias("p")
    )
    flat = by_run.select(
        F.col("p.id").alias("ids"),
        F.flatten(F.transform("p", lambda s: F.array(s["z"], s["y"], s["x"]))).alias("locations"),
    )
    return volumes.points_from_arrays(flat, "ids", "locations")


@query(
    "error_counts",
    sql(*SKEL, body="""SELECT (SELECT count(DISTINCT seg) FROM skel) AS number_of_segments,
      (SELECT count(DISTINCT component) FROM skel) AS number_of_components,
      (SELECT count(*) FROM merging) AS number_of_merging_segments,
      (SELECT count(DISTINCT component) FROM skel_attr WHERE su <> sv) AS number_of_split_skeletons"""),
)
def error_counts(spark, root):
    nodes, edges = attributed(spark, root)
    per_segment = nodes.groupBy("seg").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    tall = (
        per_segment.select(F.lit("s").alias("k"), F.when(F.col("lo") != F.col("hi"), 1).otherwise(0).alias("hit"))
        .unionByName(
            edges.groupBy("component").agg(F.max(F.when(F.col("su") != F.col("sv"), 1).otherwise(0)).alias("hit"))
            .select(F.lit("e").alias("k"), "hit")
        )
        .unionByName(nodes.select("component").distinct().select(F.lit("c").alias("k"), F.lit(0).alias("hit")))
    )
    return tall.agg(
        F.count_if(F.col("k") == "s").alias("number_of_segments"),
        F.count_if(F.col("k") == "c").alias("number_of_components"),
        F.count_if((F.col("k") == "s") & (F.col("hit") == 1)).alias("number_of_merging_segments"),
        F.count_if((F.col("k") == "e") & (F.col("hit") == 1)).alias("number_of_split_skeletons"),
    )


@query(
    "merges_needed",
    sql(*SKEL, body="""SELECT CAST(sum(n - 1) AS BIGINT) AS total_merges_needed,
      round(sum(n - 1) / (SELECT count(DISTINCT component) FROM skel), 6) AS average_merges_needed
      FROM (SELECT component, count(*) AS n FROM (SELECT DISTINCT component, su, sv FROM skel_attr WHERE su <> sv)
      GROUP BY component)"""),
)
def merges_needed(spark, root):
    nodes, edges = attributed(spark, root)
    per_skeleton = skeletons.split_pairs(edges).groupBy("component").agg((F.count("*") - 1).alias("n"))
    every = nodes.select("component").distinct().join(per_skeleton, "component", "left")
    return every.agg(
        F.sum("n").alias("total_merges_needed"),
        F.round(F.sum("n") / F.count("*"), 6).alias("average_merges_needed"),
    )


@query(
    "unsplittable_fragments",
    sweep_sql([AT], """SELECT segment AS seg, fragment FROM located JOIN lut USING (fragment)
      WHERE fragment <> 0 GROUP BY 1, 2 HAVING count(DISTINCT component) > 1""", "sites", "located"),
)
def unsplittable_fragments(spark, root):
    sites = located_sites(spark, root).join(lut_at(spark, root), "fragment").withColumnRenamed("segment", "seg")
    return skeletons.unsplittable_fragments(sites)


@query(
    "node_attribute_join",
    sql("sites", body="""SELECT s.id, z, y, x, event_id // 50 AS component_id FROM sites s
      JOIN (SELECT event_id, event_id % 4 <> 0 AS masked FROM events WHERE event_type <> 'error') e ON e.event_id = s.id
      WHERE masked AND z >= 100 AND z < 1500 AND y >= 0 AND y < 200 AND x >= 0 AND x < 288"""),
)
def node_attribute_join(spark, root):
    from voxelith.operators.grid import Box

    mask = table(spark, root, "events", "event_id", "event_type").where("event_type <> 'error'").selectExpr(
        "event_id AS id", "event_id % 4 <> 0 AS masked"
    )
    component = table(spark, root, "events", "event_id").selectExpr("event_id AS id", "event_id div 50 AS component_id")
    read = skeletons.read_skeletons(
        domain.sites(spark, root).drop("component"), mask, component, Box((100, 0, 0), (1400, 200, 288)).contains()
    )
    return read.select("id", "z", "y", "x", "component_id")


@query(
    "comp_to_coordinates",
    sql("sites", body="""SELECT component, id, z, y, x FROM sites
      QUALIFY row_number() OVER (PARTITION BY component ORDER BY id) = 1"""),
)
def comp_to_coordinates(spark, root):
    """First node of every component with its coordinates, as one aggregate."""
    return (
        domain.sites(spark, root).groupBy("component")
        .agg(F.min_by(F.struct("id", "z", "y", "x"), "id").alias("n"))
        .select("component", "n.id", "n.z", "n.y", "n.x")
    )


@query(
    "graph_points_in_roi",
    sql("sites", "site_edges", """inside AS (SELECT * FROM sites WHERE z >= 200 AND z < 1200 AND y >= 50 AND y < 250)""",
        body="""SELECT source, target FROM site_edges WHERE source IN (SELECT id FROM inside)
      AND target IN (SELECT id FROM inside)"""),
)
def graph_points_in_roi(spark, root):
    """Edges whose two ends lie in a box; dangling edges drop out of the semi joins."""
    inside = domain.sites(spark, root).where("z >= 200 AND z < 1200 AND y >= 50 AND y < 250").select("id")
    return (
        domain.site_edges(spark, root)
        .join(inside.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(inside.withColumnRenamed("id", "target"), "target", "left_semi")
    )


@query(
    "evaluate_annotations_sweep",
    sweep_sql(
        SWEEP,
        """SELECT CAST(t.t AS BIGINT) AS threshold_pct, round(coalesce(run2, 0) / len, 6) AS erl, round(len2 / len, 6) AS max_erl,
          round(len, 6) AS total_path_length, voi_split, voi_merge, n_segments AS number_of_segments
        FROM points t JOIN lens USING (t) LEFT JOIN runs2 USING (t) JOIN voi USING (t) JOIN seg_counts USING (t)""",
        "sites", "site_edges", "located",
        """site_seg AS (SELECT t, id, component, z, y, x, coalesce(l.segment, located.fragment) AS seg
          FROM located CROSS JOIN points LEFT JOIN lut l ON l.fragment = located.fragment AND l.threshold_pct = t)""",
        """attr AS (SELECT a.t, a.component, a.seg AS su, b.seg AS sv,
          sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS length
          FROM site_edges e JOIN site_seg a ON a.id = source JOIN site_seg b ON b.id = target AND b.t = a.t)""",
        "merg AS (SELECT t, seg FROM site_seg GROUP BY 1, 2 HAVING count(DISTINCT component) > 1)",
        """runs2 AS (SELECT t, sum(r * r) AS run2 FROM (SELECT t, sum(length) AS r FROM attr
          WHERE su = sv AND su <> 0 AND NOT EXISTS (SELECT 1 FROM merg WHERE merg.t = attr.t AND merg.seg = su)
          GROUP BY t, component, su) GROUP BY t)""",
        "lens AS (SELECT t, sum(l * l) AS len2, sum(l) AS len FROM (SELECT t, sum(length) AS l FROM attr GROUP BY t, component) GROUP BY t)",
        "tab AS (SELECT t, component AS gt, seg, count(*)::DOUBLE AS n FROM site_seg GROUP BY 1, 2, 3)",
        """voi AS (SELECT t, round((hg - hj) / total, 6) + 0 AS voi_split, round((hs - hj) / total, 6) + 0 AS voi_merge
          FROM (SELECT t, sum(n) AS total, sum(n * log2(n)) AS hj FROM tab GROUP BY t)
          JOIN (SELECT t, sum(a * log2(a)) AS hg FROM (SELECT t, sum(n) AS a FROM tab GROUP BY t, gt) GROUP BY t) USING (t)
          JOIN (SELECT t, sum(a * log2(a)) AS hs FROM (SELECT t, sum(n) AS a FROM tab GROUP BY t, seg) GROUP BY t) USING (t))""",
        "seg_counts AS (SELECT t, count(DISTINCT seg) AS n_segments FROM site_seg GROUP BY t)",
    ),
)
def evaluate_annotations_sweep(spark, root):
    return annotation_scores(spark, root, SWEEP)


def annotation_scores(spark, root, points):
    """ERL and VOI of skeleton sites at every sweep point.

    Sites and edges are reduced to fragments once, and meet the spans of points over which a fragment keeps
    its segment; only fragments under a site are mapped.
    """
    key = ["threshold_pct"]
    voxels = domain.stored_voxels(spark, root, "z", "y", "x", "az", "ay", "ax", "frag")
    located = cut_lineage(relabel.site_fragments(domain.sites(spark, root), voxels, domain.VOXEL_SIZE))
    sites = cut_lineage(skeletons.fragment_sites(located))
    fragments = sites.where("seg <> 0").select(F.col("seg").alias("id")).distinct()
    lut = components.sweep(fragments, domain.rag_edges(spark, root, voxels=voxels), points, False)
    held = cut_lineage(spans.spans(lut))
    nodes = cut_lineage(
        spans.at_spans(sites, held, points, ["seg"]).groupBy("component", "seg", "first", "last").agg(F.sum("n").alias("n"))
    )
    pieces = skeletons.fragment_edges(located, domain.site_edges(spark, root))
    edges = cut_lineage(spans.at_spans(pieces, held, points, ["su", "sv"]))
    erl = skeletons.expected_run_length_at(edges, skeletons.merging_at(nodes, points), points)
    table_ = contingency.contingency(nodes, "component", "seg", ["first", "last"], weight="n")
    voi = contingency.rand_voi(table_, points=points)
    count = contingency.segment_counts(table_, points)
    return erl.join(voi, key).join(count, key).select(
        F.col("threshold_pct").cast("bigint"), "erl", "max_erl", "total_path_length", "voi_split", "voi_merge", "number_of_segments"
    )
