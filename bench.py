"""Time the headline queries on local Spark and print one JSON line.

Each query runs once to warm up (class loading, code generation) and is then timed three times, of which the median is
reported; rows go to the no-op sink, so a query is computed whole without being collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeloom.plans.catalog import run
from tapeloom.plans.queries import QUERIES
from tapeloom.session import build_session

HEADLINE = (
    "q05_last_n", "q07_exclude_entity", "q11_completeness", "q12_fill", "q13_weekly", "q14_minutes", "q15_qfq",
    "j04_valid_join", "j10_merge", "j14_fill", "j17_asof", "a05_weighted_mean", "a06_dup_keys",
    "w01_prev_close", "w02_sma", "w04_macd", "w05_rsi", "w08_kdj", "w09_boll", "w10_technical", "w14_ratios", "w16_gaps",
    "t8_quotes", "c13_ohlc", "c17_minute_session", "h_contract_metrics", "s1_stream_bars",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = [name for name in wanted.split(",") if name] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB"},  # one box: keep small shuffles on all its cores
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        assert name in QUERIES, name
        took = []
        for _ in range(4):
            start = time.perf_counter()
            run(name, spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
