"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from askwell import plans
from askwell.session import build_session

HEADLINE = [
    "r01_topk_inner_product",
    "r04_nest_results",
    "c12_assemble_context",
    "c12_assemble_retrieved",
    "v10_consolidate",
    "t02_normalize_answer",
    "t10_clean_sections",
    "e06_token_f1",
    "e09_hits_at_k",
    "e21_ir_report",
    "e22_weighted_mean",
    "d13_encode_completion",
    "d12_sample_mixture",
    "p10_match_flags",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cores, shuffle_partitions=int(cores))
    # Start the Python workers before the clock does.
    spark.range(int(cores)).mapInPandas(lambda batches: batches, "id long").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
