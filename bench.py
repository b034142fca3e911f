"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Two queries are run unmeasured on the smallest data set next to it, to start the JVM and
the Python workers; then each query is measured once, building included. The result
goes to the noop sink: every row and column is computed, none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from itemnorm import build_session  # noqa: E402
from itemnorm.queries import QUERIES  # noqa: E402

HEADLINE = [
    "m1_clean_catalogue", "prj2_clean_rows", "prj3_clean_stats", "src3_row_index", "win2_batches", "scl1_lookup_key",
    "scl3_standardize", "scl5_render_template", "scl16_extract_json", "emb1_embed_texts", "emb3_best_neighbour", "agg1_average_linkage", "agg2_leader_groups",
    "agg3_group_value_merge", "agg4_collapse_rows", "jn1_alias_match", "jn2_nearest_match", "jn5_overlay_rows", "exp1_export_rows",
    "enr2_extract_values", "pip2_normalize_rows", "pip1_clusterize", "srt2_batch_search", "pip7_merge_rows", "pip8_split_aliases", "snk1_memory_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("itemnorm-bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    for name in ("m1_clean_catalogue", "jn2_nearest_match"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
