"""Times headline queries and prints one JSON line."""

import importlib
import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = (
    "validate_summary_by_source", "normalize_text", "body_checksum", "canonical_url", "rule_errors", "shingle_counts", "minhash_signature", "lsh_candidate_pairs", "dedup_first_wins",
    "html_title", "histogram_buckets", "op1_topk_search", "op2_decontaminate", "op4_jaccard_join", "op7_mix_sources", "op9_automata_dedup",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, took = importlib.import_module("__spark_entry__").queries(), {}
    for name in (q for q in QUERIES if q in known):
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
