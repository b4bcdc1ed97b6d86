"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the no-op sink (every row computed, nothing
collected to the driver) after one untimed warm-up; each is timed ``REPEATS``
times and the best time is reported (single local runs vary with JIT and GC).
Prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "class_report", "overall_metrics", "confusion_matrix", "confidence_slices", "length_error_rate",
    "error_term_frequency", "keyword_share_predicted", "refine_impact", "variant_delta", "consensus_label",
    "dataset_catalog", "dedup_text", "three_way_split", "stratified_split", "random_deletion_sentence",
    "negation_antonym", "pad_truncate_tokens", "split_sentences", "articles_in_window", "window_sentiment",
    "roi_per_trading_day", "layer_attention_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tonality.plans import load_all
    from tonality.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    reg = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    reg["overall_metrics"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    times = {}
    for n in names:
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            reg[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
