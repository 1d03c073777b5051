"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

#: Queries of the engine's own operators, one or more for each family.
HEADLINE = """corpus_summary topic_distribution cooccurrence_pairs top_country_pairs grouping_sets_counts mine_windows association_rules mine_countries
emerging_patterns lifecycles fp_itemsets_mllib incremental_equals_full topic_country_year country_growth location_quotient rank_emerging find_gaps
publications_by_year first_collab_year link_heuristics auc_rank vector_topk topic_centroids knn_links hash_embed token_counts ndcg_at_10
stratified_sample""".split()


def main() -> None:
    from weftlake.plans.registry import QUERIES
    from weftlake.session import session

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            t = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(median(times[1:] or times), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
