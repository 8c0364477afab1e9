"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3). Each query is executed in full with the ``noop``
sink (no result is pulled to the driver); after one warm-up pass the median
of BENCH_REPEAT runs is reported. Nothing is kept between runs: the master
view and the reports include reducing the logs and building every mart.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.registry import QUERIES  # noqa: E402
from tidemark.session import get_session  # noqa: E402

HEADLINE = [f"scn_{i:02d}" for i in range(1, 17)] + [
    "master_account", "alerts_by_stage", "bridge_coverage", "latest_contract", "date_dim",
    "event_daily_rollup", "arr_by_account_month", "profile_inventory"]


def refresh_all(spark, sf_dir: str) -> None:
    """End-to-end refresh: profiles, 16 marts, master, report — written to a
    fresh scratch folder (as on a cluster, to the shared store)."""
    import contextlib
    import io
    import uuid
    from tidemark.plans.refresh import run_all
    from tidemark.session import checkpoint_dir
    from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, roles
    out = f"{checkpoint_dir(spark)}/bench-refresh-{uuid.uuid4().hex}"
    with contextlib.redirect_stdout(io.StringIO()):
        run_all(spark, roles(spark, sf_dir), ORDERS_AS_OF, out, events_as_of=EVENTS_AS_OF)


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    if name == "refresh_all":
        refresh_all(spark, sf_dir)
    else:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                        extra={"spark.driver.memory": "16g"})
    names = [n for n in HEADLINE if n in QUERIES] + ["refresh_all"]
    for n in names:
        run_once(spark, n, sf_dir)
    times = {n: round(statistics.median(run_once(spark, n, sf_dir) for _ in range(repeat)), 3)
             for n in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
