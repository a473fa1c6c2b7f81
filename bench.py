"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the cores. Every query writes all its rows to the
noop sink. The item stage, which all of them read, is built once before and timed as its own entry.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from keyfold.registry import QUERIES
from keyfold.registry.base import item_stage
from keyfold.session import build_session

# The long stage chains (stage3_features, stage5_features, pipeline_all_stages) take minutes each on
# one machine, mostly in planning and compiling; name them in BENCH_QUERIES to time them.
HEADLINE = [
    "freq_count_col", "freq_user_category", "span_9key", "uq_span_pair", "distinct_price_by_user",
    "count_1key", "count_3key", "minmax_fill_minus1", "stage3_part1",
    "std_by_key", "std_by_rounded_key", "std_calendar_by_user",
    "population_union", "region_macro_join", "label_encode", "mean_impute",
    "text_clean", "word_count", "vocab_topn", "text_to_sequence", "oov_rate",
    "fold_average", "oof_attach", "submission",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("keyfold-bench", cpus=cpus, shuffle_partitions=max(int(cpus), 2)
                          if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    start = time.perf_counter()
    item_stage(spark, sf_dir)
    times["item_stage"] = round(time.perf_counter() - start, 3)
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        consume(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
