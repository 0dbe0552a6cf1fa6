"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through Spark's ``noop`` sink (every row is
computed, nothing is collected to the driver); the warm time (second run) is
reported per query (best of ``$BENCH_REPS`` runs, default 2), the first run
as ``cold``.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["parse_full", "contract_factors", "schedule", "pam_fixed", "pam_floating", "pam_full",
            "asof_fx", "events_nested", "events_text", "cash_by_currency_month"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from flowbook.plans.session import local_session
    from flowbook.plans import queries as Q

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        t = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    reps = int(os.environ.get("BENCH_REPS", "2"))
    cold, warm = {}, {}
    for n in names:
        cold[n] = round(run(n), 3)
    for _ in range(reps):  # warm: best of ``reps`` runs after JIT warm-up
        for n in names:
            t = round(run(n), 3)
            warm[n] = min(warm.get(n, t), t)
    n_contracts = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    n_events = Q.QUERIES["pam_full"](spark, sf_dir).count()
    total = round(sum(warm.values()), 3)
    flagship = warm.get("pam_full")
    out = {
        "metric": "sum of warm wall times of the headline queries",
        "value": total,
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
        "contracts": n_contracts,
        "events_reported": n_events,
    }
    if flagship:
        out["contracts_per_sec_pam_full"] = round(n_contracts / flagship, 1)
        out["events_per_sec_pam_full"] = round(n_events / flagship, 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
