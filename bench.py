"""Time the headline queries on $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from counterpoise.plans.catalog import QUERIES  # noqa: E402
from counterpoise.session import clear_scratch, local_session  # noqa: E402

HEADLINE = [
    "feat_lengths", "onehot_category", "lookup_hot_keys", "split_assign", "cross_fold", "balance_table", "logit_shift",
    "ipw_stabilized", "block_standardize", "knn_exact", "gcomp_knn", "aipw_all", "aipw_subgroup", "cf_distribution",
    "weighted_resample", "vocab", "token_encode", "weighted_unigram_lm", "doc_perplexity", "wasserstein_rating",
    "divergence_frontier", "covariance", "propensity_logistic", "knn_ivf", "json_roundtrip", "knn_vectors", "evaluation_table",
    "weighted_bigram_lm", "tune_propensity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "12g"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # A first small job, so the first query does not pay for starting the engine.
    spark.range(1000).groupBy("id").count().count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        # Every row and column is produced and dropped.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    clear_scratch(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
