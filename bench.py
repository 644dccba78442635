"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores, ``BENCH_RUNS`` the timed runs per
query (median counts) after one run to warm up. Results go to the ``noop`` sink, so every row is computed and nothing
is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyhouse.checks.registry import queries
from tallyhouse.checks.standins import StandIns
from tallyhouse.session import local_session

# Name in the report -> registered query.
HEADLINES = {
    "r01_identity_reviews": "r01_all",
    "r03_users": "r03_all",
    "r04_figures": "r04_figures",
    "r04_new_users_daily": "r04_new_users_daily",
    "r04_active_users_daily": "r04_active_users_daily",
    "r05_coin_ledger": "r05_all",
    "r05_coin_ledger_page": "r05_page",
    "r05_coin_ledger_total": "r05_total",
    "r09_order_sales": "r09_all",
    "r09_order_sales_page": "r09_page",
    "r09_order_lines": "r09_lines",
    "r10_finance_flow": "r10_all",
    "r10_finance_flow_page": "r10_page",
    "r10_finance_flow_total": "r10_total",
    "r11_purchases": "r11_all",
    "r13_stock_ledger": "r13_all",
    "r13_stock_ledger_page": "r13_page",
    "r13_stock_items": "r13_items",
    "r14_learn_tasks": "r14_all",
    "r23_invited_friends": "r23_all",
    "k4_number_every_order": "k4_orders",
    "j02_grant_coins_users": "j02_users",
    "j02_grant_coins_ledger": "j02_ledger",
    "j16_add_companies": "j16_companies",
    "j25_decode_images": "j25_images",
}


def timed(build: Callable[[], DataFrame], runs: int) -> float:
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return statistics.median(seconds[1:])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=cores, app="tallyhouse-bench")
    registered = queries()
    results = {}
    for name, query in HEADLINES.items():
        results[name] = round(timed(lambda query=query: registered[query](spark, folder), runs), 4)
    rows = StandIns(spark, folder)["order_products"].count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(results.values()), 3), "unit": "sec",
                "queries": results, "sf": os.path.basename(folder.rstrip("/")), "order_lines": rows, "cores": cores,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
