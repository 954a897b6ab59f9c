"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featherloom.catalog import QUERIES  # noqa: E402
from featherloom.session import build_session  # noqa: E402

HEADLINE = (
    "prj_4_minmax_signed", "prj_9_bin_label", "prj_31_declared_flow",
    "agg_1_column_stats", "agg_3_value_counts", "agg_4_one_hot", "agg_7_target_encode", "agg_7_target_encode_auc",
    "agg_8_impute", "agg_10_nested_records", "agg_11_nested_by_date", "agg_15_word_frequency", "agg_20_script_census",
    "win_1_rank_average", "win_3_normalized_gini", "win_4_roc_auc", "win_5_stratified_folds", "win_6_frequency_codes",
    "win_7_grouped_fold", "set_4_oversample", "set_6_quota_fill", "evl_4_best_f1", "ens_3_geometric_mean",
    "ens_4_majority_vote", "jon_11_common_neighbours", "jon_13_model_agreement", "mlf_1_tfidf_word", "mlf_9_nearest_words",
    "jon_6_contained_in_any", "mlf_11_knn_probability", "agg_22_cascade_report", "mlf_4_oof_gbt", "mlf_9_pruned_neighbours",
    "str_1_clean_comment", "str_14_count_features", "str_20_topic_ranges", "src_10_sparse_rows", "arr_10_mean_word_vectors",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm up
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
