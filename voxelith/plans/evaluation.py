"""The large-volume evaluation as Spark stages over a workspace folder.

predict -> fragments -> agglomerate -> segments -> evaluate -> relabel. Each stage reads the
tables of earlier stages and writes its own, so any subset can be run again on its own. The flood and
the merge trees go by layers of blocks; with ``resume`` a run takes the layers that a killed run with
equal settings has finished, which is right as long as the stages before it weren't run again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import blockops, components, contingency, predict, rag, relabel, scores, skeletons, volumes
from voxelith.operators.grid import AXES, Box
from voxelith.sources import stores
from voxelith.sources.specs import exists
from voxelith.sources.volumes import write_volume
from voxelith.streaming.resume import process_layers

STAGES = ("predict", "fragments", "agglomerate", "segments", "evaluate", "relabel")


@dataclass
class Config:
    setup: str
    workspace: str
    grid_yx: tuple[int, int]
    block: tuple[int, int, int] = (32, 32, 32)
    context: tuple[int, int, int] = (4, 4, 4)
    fragment_threshold: float = 0.5
    min_seed_distance: int = 10
    per_section: bool = False
    filter_fragments: float = 0.0
    epsilon: float = 0.0
    merge_function: str = "mean"
    hierarchical: bool = False
    points: list[int] = field(default_factory=lambda: components.thresholds_pct(0, 52, 2))
    tuning_metric: str = "voi"
    relabel_threshold: str | float = "best_voi"
    voxel_size: tuple[int, int, int] = (20, 9, 9)
    layers: int = 64  # of blocks, done and logged together
    resume: bool = False

    def at(self, name: str) -> str:
        return f"{self.workspace.rstrip('/')}/{name}"

    def parts(self, stage: str, *more) -> str:
        """Folder of a stage's layers under the settings they depend on: other settings have another."""
        settings = (
            self.setup, self.block, self.layers, self.context, self.grid_yx, self.fragment_threshold, self.min_seed_distance, self.per_section, *more,
        )
        return self.at(f"layers/{stage}-{hashlib.sha256(repr(settings).encode()).hexdigest()[:16]}")


def run_predict(spark: SparkSession, cfg: Config, raw: DataFrame, model: predict.Model | predict.BlockModel) -> None:
    """8-bit affinities from raw intensities through a pluggable model, voxel by voxel or in blocks."""
    scaled = raw.withColumn("unit", F.col("raw") / 255.0 * 2 - 1)
    names = ["pz", "py", "px"]
    if isinstance(model, predict.BlockModel):
        out = predict.predict_blocks(scaled, model, ["unit"], names, cfg.block, bounds(raw))
    else:
        out = predict.predict_batches(scaled, model, ["unit"], names)
    eight = lambda c: F.greatest(F.least((F.col(c) * 255).cast("bigint"), F.lit(255)), F.lit(0))
    affinities = out.select("z", "y", "x", eight("pz").alias("az"), eight("py").alias("ay"), eight("px").alias("ax"))
    write_volume(affinities, cfg.at("affinities"), cfg.block, "overwrite")


def bounds(voxels: DataFrame) -> Box:
    """Smallest box around all voxels; one row."""
    row = voxels.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if row["lo_z"] is None:
        return Box((0, 0, 0), (0, 0, 0))
    return Box(tuple(row[f"lo_{a}"] for a in AXES), tuple(row[f"hi_{a}"] - row[f"lo_{a}"] + 1 for a in AXES))


def block_layers(cfg: Config, extent: Box) -> tuple[int, int]:
    return extent.begin[0] // cfg.block[0], -(-extent.end[0] // cfg.block[0])


def run_fragments(spark: SparkSession, cfg: Config, mask: DataFrame | None = None) -> None:
    """Watershed fragments and RAG nodes; optional mask, epsilon joining and low-affinity filter."""
    voxels = spark.read.parquet(cfg.at("affinities"))
    if mask is not None:
        voxels = volumes.apply_mask(voxels, mask, ["az", "ay", "ax"])
    voxels = voxels.withColumn("inside", volumes.affinity_mask(cfg.fragment_threshold).cast("int"))
    extent = bounds(voxels)
    cut = process_layers(
        spark, block_layers(cfg, extent), cfg.layers, cfg.parts("flood", mask is not None),
        lambda layers: blockops.watershed(
            voxels, "inside", cfg.block, cfg.grid_yx, cfg.context, cfg.min_seed_distance, cfg.per_section, extent=extent,
            carry=("az", "ay", "ax"), layers=layers,
        ),
        cfg.resume,
    )
    out = cut.withColumnRenamed("fragment", "frag")
    if cfg.epsilon > 0:
        out.write.mode("overwrite").parquet(cfg.at("fragments_raw"))
        out = spark.read.parquet(cfg.at("fragments_raw"))
        lut = blockops.epsilon_fragments(out, "frag", cfg.block, cfg.epsilon)
        out = relabel.relabel(out, lut, "frag").drop("frag").withColumnRenamed("segment", "frag")
    if cfg.filter_fragments > 0:
        out = volumes.low_affinity_fragments(out, cfg.filter_fragments)
    write_volume(out.select("z", "y", "x", "az", "ay", "ax", "frag"), cfg.at("fragments"), cfg.block, "overwrite")
    rag.nodes(spark.read.parquet(cfg.at("fragments")), voxel_size=cfg.voxel_size).write.mode("overwrite").parquet(cfg.at("nodes"))


def run_agglomerate(spark: SparkSession, cfg: Config) -> None:
    voxels = spark.read.parquet(cfg.at("fragments"))
    if cfg.hierarchical:
        trees = process_layers(
            spark, block_layers(cfg, bounds(voxels)), cfg.layers, cfg.parts("trees", cfg.merge_function, cfg.epsilon, cfg.filter_fragments),
            lambda layers: blockops.merge_trees(voxels, "frag", cfg.block, cfg.merge_function, cfg.context, layers=layers),
            cfg.resume,
        )
        edges = blockops.owned_edges(trees)
    else:
        edges = rag.edges(rag.faces(voxels, size=cfg.block), cfg.merge_function).drop("n_faces")
    edges.write.mode("overwrite").parquet(cfg.at(f"edges_{cfg.merge_function}"))


def run_segments(spark: SparkSession, cfg: Config) -> bool:
    """Lookup tables of all sweep points; False (and nothing written) without nodes."""
    nodes = spark.read.parquet(cfg.at("nodes")).select("id")
    if nodes.isEmpty():
        return False
    edges = spark.read.parquet(cfg.at(f"edges_{cfg.merge_function}"))
    stores.write_lut(components.sweep(nodes, edges, cfg.points), cfg.at("lut"))
    return True


def run_evaluate(
    spark: SparkSession, cfg: Config, split: str, nodes: DataFrame, edges: DataFrame, synapses: DataFrame | None = None
) -> None:
    """Score one annotation split at every sweep point and upsert the reports.

    ``nodes`` are skeleton sites ``id, component, z, y, x`` in world units.
    """
    key = ["threshold_pct"]
    if nodes.isEmpty():
        raise LookupError(f"no skeleton nodes for {split}")
    fragments = spark.read.parquet(cfg.at("fragments"))
    located = relabel.site_fragments(nodes, fragments, cfg.voxel_size)
    located.write.mode("overwrite").parquet(cfg.at(f"sites_{split}"))
    located = spark.read.parquet(cfg.at(f"sites_{split}"))
    lut = stores.read_lut(spark, cfg.at("lut")).join(located.select("fragment"), "fragment", "left_semi")
    points = list(cfg.points)
    labelled = skeletons.at_points(skeletons.fragment_sites(located), lut, points, ["seg"])
    labelled.write.mode("overwrite").parquet(cfg.at(f"labelled_{split}"))
    labelled = spark.read.parquet(cfg.at(f"labelled_{split}"))
    attributed = skeletons.at_points(skeletons.fragment_edges(located, edges), lut, points, ["su", "sv"])
    merging = skeletons.merging_segments(labelled, key)
    erl = skeletons.expected_run_length(attributed, merging, key)
    overlap = contingency.contingency(labelled, "component", "seg", key, weight="n")
    report = erl.join(contingency.rand_voi(overlap, key), key)
    counts = overlap.select(*key, "seg").distinct().groupBy(*key).agg(F.count("*").alias("number_of_segments"))
    wrong = merging.groupBy(*key).agg(F.count("*").alias("number_of_merging_segments"))
    split_skeletons = attributed.where("su <> sv").select(*key, "component").distinct().groupBy(*key).agg(
        F.count("*").alias("number_of_split_skeletons")
    )
    report = report.join(counts, key).join(wrong, key, "left").join(split_skeletons, key, "left").na.fill(
        0, ["number_of_merging_segments", "number_of_split_skeletons"]
    )
    if synapses is not None:
        at_synapse = located.join(relabel.endpoints(synapses), "id", "left_semi")
        at_synapse = skeletons.at_points(skeletons.fragment_sites(at_synapse), lut, points, ["seg"])
        part = contingency.rand_voi(contingency.contingency(at_synapse, "component", "seg", key, weight="n"), key)
        report = report.join(part.select(*key, *[F.col(c).alias(f"synapse_{c}") for c in ("voi_split", "voi_merge", "voi")]), key, "left")
    report = report.select(
        F.lit(cfg.setup).alias("network_configuration"),
        F.lit(cfg.merge_function).alias("merge_function"),
        F.col("threshold_pct").alias("pct"),
        (F.col("threshold_pct") / 100).alias("threshold"),
        F.lit(split).alias("split"),
        *[c for c in report.columns if c not in key],
    )
    stores.VersionedTable(spark, cfg.at("scores")).upsert(report, ["network_configuration", "merge_function", "pct", "split"])


def tune(spark: SparkSession, cfg: Config) -> DataFrame:
    """Best thresholds per split and the test scores at the tuned one; upserted and returned."""
    if cfg.tuning_metric not in ("voi", "erl"):
        raise ValueError(f"cannot tune on {cfg.tuning_metric!r}")
    table = stores.VersionedTable(spark, cfg.at("scores")).read().withColumn("setup", F.col("network_configuration"))
    rows = scores.summary_rows(table, cfg.tuning_metric)
    store = stores.VersionedTable(spark, cfg.at("tuned"))
    store.upsert(rows, ["setup", "metric", "split"])
    return store.read()


def resolve_threshold(spark: SparkSession, cfg: Config) -> float:
    """A number, or ``best_voi`` / ``best_erl`` looked up from the tuned validation results."""
    if not isinstance(cfg.relabel_threshold, str):
        return float(cfg.relabel_threshold)
    metric = cfg.relabel_threshold.removeprefix("best_")
    row = stores.VersionedTable(spark, cfg.at("tuned")).read().where(
        (F.col("setup") == cfg.setup) & (F.col("metric") == metric) & (F.col("split") == "val")
    ).first()
    if row is None:
        raise LookupError(f"no tuned {metric} threshold for {cfg.setup}")
    return row["value"] / 100


def run_relabel(spark: SparkSession, cfg: Config) -> None:
    lut = stores.read_lut(spark, cfg.at("lut"), resolve_threshold(spark, cfg))
    fragments = spark.read.parquet(cfg.at("fragments")).select("z", "y", "x", "frag")
    write_volume(relabel.relabel(fragments, lut, "frag").drop("frag"), cfg.at("segmentation"), cfg.block, "overwrite")


def run(
    spark: SparkSession,
    cfg: Config,
    stages: list[str],
    raw: DataFrame | None = None,
    model: predict.Model | predict.BlockModel | None = None,
    annotations: dict[str, tuple[DataFrame, DataFrame]] | None = None,
    mask: DataFrame | None = None,
    synapses: dict[str, DataFrame] | None = None,
) -> None:
    """Run the named stages in order; an unknown name is an error before anything starts.

    ``mask`` zeroes voxels before the fragments; ``synapses`` has edges for some of the annotation
    splits, whose sites are scored besides.
    """
    if not stages or not set(stages) <= set(STAGES):
        raise ValueError(f"stages must be a subset of {STAGES}")
    if "predict" in stages:
        run_predict(spark, cfg, raw, model)
    if "fragments" in stages:
        run_fragments(spark, cfg, mask)
    if "agglomerate" in stages:
        run_agglomerate(spark, cfg)
    if "segments" in stages and not run_segments(spark, cfg):
        return
    if "evaluate" in stages:
        for split, (nodes, edges) in (annotations or {}).items():
            run_evaluate(spark, cfg, split, nodes, edges, (synapses or {}).get(split))
        if exists(spark, cfg.at("scores")):
            tune(spark, cfg)
    if "relabel" in stages:
        run_relabel(spark, cfg)
