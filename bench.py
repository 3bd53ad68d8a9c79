"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.  The fixed cost of a first query is paid by a warm-up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "risk_tiers agg_churn agg_cochange agg_coupling agg_cluster agg_health agg_hotspot agg_spearman joi_rundiff joi_omitted joi_call joi_contract joi_chain "
    "win_trend win_median win_drift map_pivot det_antipattern det_history rul_evalstatus gra_upstream gra_blast gra_cycles gra_closure stm_tumbling stm_lifecycle src_tree agg_hash"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quarryline import catalogue

    queries = catalogue.queries()

    def run(name: str) -> float:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    run("agg_churn")
    took = {name: run(name) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
