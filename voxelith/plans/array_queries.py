"""Queries over channel arrays, losses, sampling and split lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions import arrays, losses
from voxelith.operators import neighbours, sampling
from voxelith.plans import domain
from voxelith.plans.domain import sql, unit_sql
from voxelith.plans.registry import query
from voxelith.sources.tables import table

E = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS a FROM embeddings)"


def vectors(spark, root):
    return table(spark, root, "embeddings", "vec_id", "label", "embedding").select(
        F.col("vec_id").alias("id"), "label", arrays.as_double(F.col("embedding")).alias("a")
    )


@query(
    "scale_shift_quantize",
    sql("vox", body="""SELECT z, y, x, round(raw / 255.0::DOUBLE * 2 - 1, 6) AS shifted, round((raw / 255.0::DOUBLE * 2 - 1) * 0.5 + 0.5, 6) AS back,
      CAST(trunc((raw / 128.0::DOUBLE - 1) / 2 * 255 + 127.5) AS INTEGER) AS quantised FROM vox"""),
)
def scale_shift_quantize(spark, root):
    unit = arrays.normalise_uint8(F.col("raw"))
    signed = arrays.scale_shift(unit, 2, -1)
    return domain.voxels(spark, root).select(
        "z", "y", "x", F.round(signed, 6).alias("shifted"), F.round(arrays.scale_shift(signed, 0.5, 0.5), 6).alias("back"),
        arrays.rescale_signed(F.col("raw") / F.lit(128.0) - 1).alias("quantised"),
    )


@query(
    "softmax_channels",
    sql(E, body="""SELECT id, c - 1 AS channel, round(exp(a[c] - m) / list_sum(list_transform(a[1:4], lambda v: exp(v - m))), 6) AS p
      FROM (SELECT *, list_max(a[1:4]) AS m, unnest([1, 2, 3, 4]) AS c FROM e)"""),
)
def softmax_channels(spark, root):
    soft = vectors(spark, root).select("id", arrays.softmax(F.slice("a", 1, 4)).alias("s"))
    rows = arrays.split_channels(soft, ["id"], "s")
    return rows.select("id", F.col("channel").cast("int"), F.round("value", 6).alias("p"))


@query("argmax_channels", sql(E, body="SELECT id, CAST(list_position(a, list_max(a)) - 1 AS BIGINT) AS best FROM e"))
def argmax_channels(spark, root):
    return vectors(spark, root).select("id", arrays.argmax(F.col("a")).alias("best"))


@query("take_channel", sql(E, body="SELECT id, round(a[6], 6) AS value FROM e"))
def take_channel(spark, root):
    return vectors(spark, root).select("id", F.round(arrays.take(F.col("a"), 5), 6).alias("value"))


@query("channel_split", sql(E, body="SELECT id, c AS channel, round(a[c + 1], 6) AS value FROM (SELECT *, unnest(range(64)) AS c FROM e)"))
def channel_split(spark, root):
    rows = arrays.split_channels(vectors(spark, root), ["id"], "a")
    return rows.select("id", F.col("channel").cast("bigint"), F.round("value", 6).alias("value"))


# Weights of the test heads: any fixed matrix will do, these follow a rule.
HEAD = [[((7 * o + i) % 5 - 2) / 4 for i in range(64)] for o in range(13)]
BIAS = [(o % 3 - 1) / 8 for o in range(13)]


@query(
    "sigmoid_head",
    sql(E, body="SELECT id, o AS channel, round(1 / (1 + exp(-(list_dot_product(a, list_transform(range(64), lambda i: ((7 * o + i) % 5 - 2) / 4)::DOUBLE[]) + (o % 3 - 1) / 8))), 6) AS p "
        "FROM (SELECT *, unnest(range(13)) AS o FROM e)"),
)
def sigmoid_head(spark, root):
    """Descriptor (10) and affinity (3) heads: 13 output channels."""
    heads = vectors(spark, root).select("id", arrays.sigmoid_heads(F.col("a"), HEAD, BIAS).alias("h"))
    return arrays.split_channels(heads, ["id"], "h").select(
        "id", F.col("channel").cast("bigint"), F.round("value", 6).alias("p")
    )


@query(
    "dummy_model",
    sql("vox", body="SELECT z, y, x, CAST(floor(raw * 0.5::DOUBLE) AS BIGINT) AS p0, CAST(floor(raw * 0.25::DOUBLE + 10) AS BIGINT) AS p1 FROM vox"),
)
def dummy_model(spark, root):
    """Deterministic linear model applied through the pluggable block predictor."""
    from voxelith.operators.predict import linear_model, predict_batches

    voxels = domain.voxels(spark, root).select("z", "y", "x", "raw")
    out = predict_batches(voxels, linear_model([0.5, 0.25], [0.0, 10.0]), ["raw"], ["p0", "p1"])
    return out.select("z", "y", "x", *[F.floor(c).alias(c) for c in ("p0", "p1")])


HARD = "h AS (SELECT id, label, 1 / (1 + exp(-a[1])) + 0.1::DOUBLE AS h FROM e)"


def _register_hardness() -> None:
    forms = {
        "none": "h",
        "original_batchsum": "h / (SELECT sum(h) FROM h)",
        "batchsum": "h / sum(h) OVER (PARTITION BY label)",
        "sum_numel": "h / avg(h) OVER (PARTITION BY label)",
        "sum10k": "h / (sum(h) OVER (PARTITION BY label) / 10000)",
    }
    for mode, form in forms.items():
        def run(spark, root, mode=mode):
            pre = vectors(spark, root).select("id", "label", F.element_at("a", 1).alias("raw"))
            return losses.finalize_hardness(pre, "raw", "label", mode).select("id", F.round("hardness", 6).alias("hardness"))

        query(f"hardness_norm_{mode}", sql(E, HARD, body=f"SELECT id, round({form}, 6) AS hardness FROM h"))(run)


_register_hardness()

# Prediction = first channels, target = the following ones, weight 0, 1 or 2 by position.
LOSS = """loss AS (SELECT id, c, a[c] AS p, a[c + 13] AS t, CAST((id + c) % 3 AS DOUBLE) AS w, CASE WHEN c <= 10 THEN 'lsd' ELSE 'aff' END AS term
  FROM (SELECT *, unnest(range(1, 14)) AS c FROM e))"""


def loss_inputs(spark, root):
    weight = lambda lo, n: F.transform(F.sequence(F.lit(lo), F.lit(lo + n - 1)), lambda c: ((F.col("id") + c) % 3).cast("double"))
    return vectors(spark, root).select(
        "id", "label", "a",
        F.slice("a", 1, 10).alias("p_lsd"), F.slice("a", 14, 10).alias("t_lsd"), weight(1, 10).alias("w_lsd"),
        F.slice("a", 11, 3).alias("p_aff"), F.slice("a", 24, 3).alias("t_aff"), weight(11, 3).alias("w_aff"),
    )


@query(
    "weighted_mse",
    sql(E, LOSS, body="""SELECT round((SELECT avg(w * (p - t) * (p - t)) FROM loss WHERE w > 0 AND term = 'lsd') +
      (SELECT avg(w * (p - t) * (p - t)) FROM loss WHERE w > 0 AND term = 'aff'), 6) AS loss"""),
)
def weighted_mse(spark, root):
    """Both terms in one pass: channels become rows tagged with their term."""
    rows = loss_inputs(spark, root).select(F.inline(F.concat(_tagged("lsd"), _tagged("aff"))))
    per_term = rows.groupBy("term").agg(losses.weighted_mse("p", "t", "w").alias("l"))
    return per_term.agg(F.round(F.sum("l"), 6).alias("loss"))


def _tagged(term):
    zipped = F.arrays_zip(F.col(f"p_{term}").alias("p"), F.col(f"t_{term}").alias("t"), F.col(f"w_{term}").alias("w"))
    return F.transform(
        zipped, lambda z: F.struct(F.lit(term).alias("term"), z["p"].alias("p"), z["t"].alias("t"), z["w"].alias("w"))
    )


@query(
    "scaled_mse_map",
    sql(E, LOSS, body="""SELECT id, round(avg(CASE WHEN term = 'lsd' THEN w * (p - t) * (p - t) END), 6) AS lsd,
      round(avg(CASE WHEN term = 'aff' THEN w * (p - t) * (p - t) END), 6) AS aff FROM loss GROUP BY id"""),
)
def scaled_mse_map(spark, root):
    maps = loss_maps()
    return loss_inputs(spark, root).select("id", F.round(maps["lsd"], 6).alias("lsd"), F.round(maps["aff"], 6).alias("aff"))


def loss_maps():
    return {
        "lsd": losses.scaled_mse_map(F.col("p_lsd"), F.col("t_lsd"), F.col("w_lsd")),
        "aff": losses.scaled_mse_map(F.col("p_aff"), F.col("t_aff"), F.col("w_aff")),
        "bce": losses.cross_entropy_map(F.slice("a", 30, 2), F.col("id") % 2, (F.col("label") > 2).cast("double")),
        "bdt": losses.scaled_mse_map(F.slice("a", 40, 1), F.slice("a", 41, 1), F.array((F.col("label") > 2).cast("double"))),
    }


MAPS = """maps AS (SELECT id, label, 1 / (1 + exp(-any_value(a[1]))) + 0.1::DOUBLE AS h,
  avg(CASE WHEN term = 'lsd' THEN w * (p - t) * (p - t) END) AS lsd, avg(CASE WHEN term = 'aff' THEN w * (p - t) * (p - t) END) AS aff,
  (ln(exp(any_value(a[30])) + exp(any_value(a[31]))) - any_value(a[30 + id % 2])) * CAST(label > 2 AS INTEGER) AS bce,
  (any_value(a[40]) - any_value(a[41])) * (any_value(a[40]) - any_value(a[41])) * CAST(label > 2 AS INTEGER) AS bdt
  FROM loss JOIN e USING (id) GROUP BY id, label)"""
WEIGHTS = losses.normalised_weights({"lsd": 2.0, "aff": 4.0, "bce": 1.0, "bdt": 1.0, "hardness": 2.0})


@query("cross_entropy_map", sql(E, LOSS, MAPS, body="SELECT id, round(bce, 6) AS bce FROM maps"))
def cross_entropy_map(spark, root):
    return loss_inputs(spark, root).select("id", F.round(loss_maps()["bce"] + F.lit(0.0), 6).alias("bce"))


def _hardness():
    return arrays.sigmoid(F.element_at("a", 1)) + F.lit(0.1)


@query("hardness_loss_ohl", sql(E, LOSS, MAPS, body="SELECT id, round(-h * bce * 0.2, 6) + 0 AS loss FROM maps"))
def hardness_loss_ohl(spark, root):
    value = losses.hardness_loss(_hardness(), loss_maps()["bce"], "ohl", WEIGHTS["hardness"])
    # adding 0 turns the negative zero of a masked row into 0
    return loss_inputs(spark, root).select("id", (F.round(value, 6) + F.lit(0.0)).alias("loss"))


@query("hardness_loss_mse", sql(E, LOSS, MAPS, body="SELECT id, round((h - bce) * (h - bce) * 0.2, 6) AS loss FROM maps"))
def hardness_loss_mse(spark, root):
    value = losses.hardness_loss(_hardness(), loss_maps()["bce"], "mse", WEIGHTS["hardness"])
    return loss_inputs(spark, root).select("id", F.round(value, 6).alias("loss"))


@query("hardness_weighted_map", sql(E, LOSS, MAPS, body="SELECT id, round(h * aff, 6) AS weighted FROM maps"))
def hardness_weighted_map(spark, root):
    return loss_inputs(spark, root).select("id", F.round(_hardness() * loss_maps()["aff"], 6).alias("weighted"))


@query(
    "combined_loss",
    sql(E, LOSS, MAPS, body="""SELECT round(avg(h * (lsd * 0.2 + aff * 0.4 + bce * 0.1 + bdt * 0.1) + -h * (h * (bce * 0.1 + bdt * 0.1)) * 0.2), 6) AS total,
      round(coalesce(avg(CASE WHEN label < 5 THEN h * (lsd * 0.2 + aff * 0.4 + bce * 0.1 + bdt * 0.1) END), 0), 6) AS masked FROM maps"""),
)
def combined_loss(spark, root):
    """Total = weighted hardness-scaled maps plus the hardness term, which skips lsd and aff."""
    hardness = _hardness()
    maps = {k: hardness * m for k, m in loss_maps().items()}
    segmentation = losses.combine(maps, WEIGHTS)
    relevant = losses.combine(maps, WEIGHTS, exclude=("lsd", "aff"))
    total = segmentation + losses.hardness_loss(hardness, relevant, "ohl", WEIGHTS["hardness"])
    rows = loss_inputs(spark, root).select(total.alias("total"), segmentation.alias("seg"), "label")
    return rows.agg(
        F.round(F.avg("total"), 6).alias("total"),
        F.round(losses.masked_total(F.col("seg"), F.col("label") < 5), 6).alias("masked"),
    )


@query(
    "loss_term_maps",
    sql(E, LOSS, MAPS, body="""SELECT id, 'lsd' AS term, round(h * lsd, 6) AS value FROM maps UNION ALL SELECT id, 'aff', round(h * aff, 6) FROM maps
      UNION ALL SELECT id, 'bdt', round(h * bdt, 6) FROM maps
      UNION ALL SELECT id, 'bce', round(h * bce, 6) + 0 FROM maps
      UNION ALL SELECT id, 'hardness', round(-h * (h * (bce * 0.1 + bdt * 0.1)) * 0.2, 6) + 0 FROM maps
      UNION ALL SELECT id, 'total_seg_loss', round(h * (lsd * 0.2 + aff * 0.4 + bce * 0.1 + bdt * 0.1), 6) FROM maps"""),
)
def loss_term_maps(spark, root):
    maps = {k: _hardness() * m for k, m in loss_maps().items()}
    relevant = losses.combine(maps, WEIGHTS, exclude=("lsd", "aff"))
    terms = {
        **maps,
        "hardness": losses.hardness_loss(_hardness(), relevant, "ohl", WEIGHTS["hardness"]),
        "total_seg_loss": losses.combine(maps, WEIGHTS),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("term"), (F.round(v, 6) + F.lit(0.0)).alias("value")) for k, v in terms.items()])
    return loss_inputs(spark, root).select("id", F.inline(entries))


@query(
    "mask_and_or",
    sql(E, LOSS, body="SELECT id, bool_and(w > 0) AS all_in, bool_or(w > 0) AS any_in FROM loss WHERE term = 'aff' GROUP BY id"),
)
def mask_and_or(spark, root):
    return loss_inputs(spark, root).select(
        "id", arrays.all_positive(F.col("w_aff")).alias("all_in"), arrays.any_positive(F.col("w_aff")).alias("any_in")
    )


@query(
    "balance_weights",
    sql("vox", """g AS (SELECT a.z // 8 AS batch, CAST(a.gt <> 0 AND coalesce(r.gt = a.gt, FALSE) AS BIGINT) AS aff
      FROM vox a LEFT JOIN vox r ON r.z = a.z AND r.y = a.y AND r.x = a.x - 1)""",
        body="""SELECT batch, aff, n, round(1 / (2 * least(greatest(n / sum(n) OVER (PARTITION BY batch), 0.05), 0.95)), 6) AS weight
      FROM (SELECT batch, aff, count(*) AS n FROM g GROUP BY 1, 2)"""),
)
def balance_weights(spark, root):
    affinities = neighbours.label_affinities(domain.voxels(spark, root)).select(
        F.expr("z div 8").alias("batch"), F.col("gt_ax").alias("aff")
    )
    return losses.balance_weights(affinities, "aff", ["batch"])


@query(
    "label_color_lut",
    sql("vox", body=f"""SELECT label, CASE WHEN label = 0 THEN 0 ELSE CAST(floor({unit_sql('label', 0)} * 255) AS INTEGER) END AS r,
      CASE WHEN label = 0 THEN 0 ELSE CAST(floor({unit_sql('label', 1)} * 255) AS INTEGER) END AS g,
      CASE WHEN label = 0 THEN 0 ELSE CAST(floor({unit_sql('label', 2)} * 255) AS INTEGER) END AS b,
      CASE WHEN label = 0 THEN 0 ELSE 255 END AS a FROM (SELECT DISTINCT gt AS label FROM vox)"""),
)
def label_color_lut(spark, root):
    from voxelith.functions.strings import label_color

    return domain.voxels(spark, root).select(F.col("gt").alias("label")).distinct().select("label", *label_color(F.col("label")))


@query(
    "sampling_oversample",
    "SELECT s_suppkey AS id, unnest(range(1 + s_nationkey % 2)) AS copy FROM supplier",
)
def sampling_oversample(spark, root):
    rows = table(spark, root, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("id"), (1 + F.col("s_nationkey") % 2).alias("ratio")
    )
    return sampling.oversample(rows, "ratio").select("id", F.col("copy").cast("bigint"))


@query(
    "weighted_source_choice",
    f"SELECT o_orderkey, CASE WHEN {unit_sql('o_orderkey', 11)} < 2.0::DOUBLE / 3 THEN 'real' ELSE 'synthetic' END AS source FROM orders",
)
def weighted_source_choice(spark, root):
    requests = table(spark, root, "orders", "o_orderkey")
    return sampling.weighted_choice(requests, "o_orderkey", [("real", 2.0), ("synthetic", 1.0)], seed=11)


@query(
    "source_weight_default",
    """SELECT d.doc_id AS id, coalesce(l.quality * 2 + 1, 1) AS weight FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def source_weight_default(spark, root):
    """Sampling weight by name with default 1."""
    weights = table(spark, root, "labels", "doc_id", "quality").select("doc_id", (F.col("quality") * 2 + 1).alias("w"))
    return table(spark, root, "documents", "doc_id").join(weights, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.coalesce("w", F.lit(1)).alias("weight")
    )


SPLITS = {"training": list(range(27)), "validation": [27, 28], "testing": []}  # fixed values: shipped split lists


@query(
    "cube_split_assign",
    """SELECT c_custkey AS id, c_custkey % 31 AS cube_id, CASE WHEN c_custkey % 31 < 27 THEN 'training' WHEN c_custkey % 31 < 29 THEN 'validation' END AS split
       FROM customer""",
)
def cube_split_assign(spark, root):
    cubes = table(spark, root, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 31).alias("cube_id"))
    return sampling.assign_split(cubes, sampling.split_table(spark, SPLITS)).select("id", "cube_id", "split")


@query(
    "split_lists_disjoint",
    """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)) AS in_several,
       (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing,
       (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unexpected""",
)
def split_lists_disjoint(spark, root):
    lists = table(spark, root, "orders", "o_orderstatus", "o_custkey").toDF("split", "cube_id")
    return sampling.validate_lists(lists, table(spark, root, "customer", "c_custkey").toDF("cube_id"))


@query(
    "halfsynth_names",
    """SELECT p_partkey AS id, v AS version, 'cube_gt_v_' || v || '_' || p_name || '.npy' AS source,
       'halfsynth_v' || v || '_' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.h5' AS target
       FROM part, (SELECT unnest(['1', '2', '3']) AS v) WHERE p_size < 27""",
)
def halfsynth_names(spark, root):
    """Training cubes times a fixed version list; the list is an array on the row, not a join."""
    cubes = table(spark, root, "part", "p_partkey", "p_name", "p_size")
    training = sampling.split_table(spark, SPLITS).where("split = 'training'").select(F.col("cube_id").alias("p_size"))
    return (
        cubes.join(training, "p_size", "left_semi")
        .withColumn("version", F.explode(F.array(*[F.lit(v) for v in ("1", "2", "3")])))
        .select(
            F.col("p_partkey").alias("id"), "version",
            F.concat(F.lit("cube_gt_v_"), "version", F.lit("_"), "p_name", F.lit(".npy")).alias("source"),
            F.concat(F.lit("halfsynth_v"), "version", F.lit("_"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".h5")).alias("target"),
        )
    )
