"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

import json
import os
import statistics
import time

from tamarind.plans import catalogue
from tamarind.session import local_session

HEADLINE = [
    "funnel_counts", "latest_event_per_user", "fact_pivot", "outcome_lead_join", "training_latest_join", "funnel_segments", "funnel_rates_wilson", "segment_posterior_mean",
    "daily_sender_counts", "cusum_reply_rate", "channel_cooldown", "contact_policy_decision", "lifecycle_fold", "median_price", "feature_vector", "evidence_fusion",
    "category_nb", "match_key", "canonical_url", "email_extract", "auc_with_ties", "blocking_pairs", "fs_decisions", "qualification_gates", "mmr_batch", "work_queue",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in (n for n in HEADLINE if n in catalogue.QUERIES):
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
