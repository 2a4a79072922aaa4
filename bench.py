"""Benchmark: run every registered query over $BENCH_SF_DIR on
local[$BENCH_CPUS] and print one JSON line with per-query wall seconds.

Each query is fully materialised through the ``noop`` sink (all rows are
computed, nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


TRAINING = {"network_model_training", "model_comparison"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from ioclens.plans import registry
    from ioclens.session import build_local
    spark = build_local(app="ioclens-bench", cores=cpus, shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    # warm the JVM and codegen caches on a tiny table (not timed)
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in registry.QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep benchmarking the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {times.get(name, 'FAILED')}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    # model selection (cross-validated grids) is part of the total, and also shown apart
    training = {k: v for k, v in times.items() if k in TRAINING}
    queries = times
    out = {"metric": "total_query_wall_time", "value": round(sum(queries.values()), 3), "unit": "sec",
           "queries": queries, "training": training, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus), "n_queries": len(queries)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
