"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import time

from voxelith.plans.catalogue import QUERIES
from voxelith.session import local_session

HEADLINE = [
    "rag_mean_affinity",
    "rag_hist_quant_75",
    "cc_at_threshold",
    "cc_sweep_counts",
    "flagship_sweep_voi",
    "relabel_volume",
    "densify_labels",
    "rand_voi",
    "voi_per_seg_cluster",
    "expected_run_length",
    "split_stats",
    "evaluate_annotations_sweep",
    "gt_affinities",
    "max_filter_maxima",
    "chunk_stitch_last_wins",
    "block_halo_counts",
    "edt_squared",
    "seed_components",
    "watershed_fragments",
    "agglomerate_block_edges",
    "agglomerate_segmentations",
    "edt_whole_volume",
    "val_to_test_transfer",
    "ingroup_rank",
    "upsert_scores",
    "softmax_channels",
    "combined_loss",
    "site_fragment_lut",
    "cc_sweep_via_spanning_forest",
    "lsd_moments",
    "vector_distmap_norm",
    "signed_tanh_distmap",
    "watershed_fragments_xy",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # first use of the JVM and of the Python workers is not part of any query
    QUERIES["rand_voi"](spark, root).write.format("noop").mode("overwrite").save()
    QUERIES["dummy_model"](spark, root).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
