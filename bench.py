"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is fully computed (``write.format('noop')``), nothing is collected to the driver.
Queries run in one session, in order, each built from the parquet tables of the scale dir.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fbrank import catalog  # noqa: E402
from fbrank.session import local_session  # noqa: E402

SPARSE = ("bm25_topk", "prf_sparse_rocchio_run", "sweep_sparse")
HEADLINE = ("dense_topk", "bm25_topk", "prf_dense_rocchio_run", "prf_sparse_rocchio_run", "sweep_dense",
            "sweep_sparse")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=max(4, int(cpus) * 2) if cpus.isdigit() else 8, app="fbrank-bench")
    # warm the JVM and the Arrow Python workers once (not timed)
    spark.range(1000).selectExpr("sum(id)").collect()
    catalog.topk_search(spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qv array<double>"),
                        spark.createDataFrame([(1, [0.0, 1.0])], "docid long, vec array<double>"), 1).collect()
    times: dict[str, float] = {}
    if any(n in SPARSE for n in names):
        # the text index (postings, statistics, BM25 weights) is built once and shared
        t0 = time.time()
        idx, weights = catalog.shared_index(spark, sf_dir)
        weights.write.format("noop").mode("overwrite").save()
        times["index_build"] = round(time.time() - t0, 3)
        print(f"# index_build: {times['index_build']} s", file=sys.stderr, flush=True)
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
