"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of threads. Raw and
aggregated tables are stored first, untimed, as the chain and the dashboard start
from stored tables. Each query runs once to warm up and then three times; the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from factmill.operators import aggregate, clean, features, outliers, quality  # noqa: E402
from factmill.plans.dashboard import TAGS  # noqa: E402
from factmill.session import build_session, clear_settled, settle, settled_folder  # noqa: E402
from factmill.sources import writers  # noqa: E402
from workload import tables  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402
from workload.tables import SPEC, TRAIN_UNTIL, YEARS  # noqa: E402

REPEATS = 3


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "8g",
            "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods -XX:+UseParallelGC",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    raw = settle(tables.facts(spark, folder).repartition(cpus), "raw")
    dirty = settle(tables.dirty_facts(spark, folder).repartition(cpus), "dirty")
    # five areas for one: three million rows at sf0.1, the size of the published runs
    areas = F.explode(F.sequence(F.lit(0), F.lit(4)))
    larger = settle(
        raw.withColumn("area", areas)
        .withColumn("lsoa_code", F.concat_ws("-", "lsoa_code", "area"))
        .drop("area"),
        "larger",
    )
    totals = settle(clean.clean(raw, SPEC), "totals")
    rows, groups, larger_rows = raw.count(), totals.count(), larger.count()
    out = f"{settled_folder(spark)}/bench"

    timed = {
        "clean_and_total": lambda: run(clean.clean(raw, SPEC)),
        "clean_and_total_five_areas": lambda: run(clean.clean(larger, SPEC)),
        "clean_and_total_dirty": lambda: run(clean.clean(dirty, SPEC)),
        "clean_and_total_keep_copies": lambda: run(clean.clean(raw, SPEC.but(dedup="none"))),
        "step_counts": lambda: clean.step_counts(dirty, SPEC).collect(),
        "hard_validation": lambda: quality.check(totals, SPEC),
        "local_save": lambda: writers.save_strict(totals, out, "totals", SPEC),
        "by_district": lambda: aggregate.ranking(totals, "borough", spec=SPEC).collect(),
        "trend": lambda: aggregate.monthly_trend(totals, SPEC).collect(),
        "matrix": lambda: aggregate.matrix(totals, "borough", "year", YEARS, SPEC).collect(),
        "top10_minor": lambda: aggregate.ranking(totals, "minor_category", 10, SPEC).collect(),
        "leader": lambda: aggregate.leader(totals, "borough", SPEC).collect(),
        "filtered_total": lambda: aggregate.grand_total(
            aggregate.filter_facts(totals, "Nation_7", "Economy", 1997, SPEC), SPEC
        ).collect(),
        "page": lambda: aggregate.page(totals, SPEC.keys, 3, 100).collect(),
        "export_aggregated": lambda: aggregate.summary_union(totals, TAGS, spec=SPEC).collect(),
        "outlier_summary": lambda: outliers.outlier_summary(totals, "iqr", SPEC).collect(),
        "outliers_zscore": lambda: run(outliers.outlier_rows(totals, "zscore", SPEC)),
        "target_median": lambda: run(features.add_target(totals, "median", spec=SPEC)),
        "split": lambda: [
            side.count() for side in features.temporal_split(totals, TRAIN_UNTIL, spec=SPEC)
        ],
    }
    for name in (
        "clean_full",
        "agg_facts",
        "dedup_exact",
        "null_counts",
        "class_metrics",
        "auc_gini",
        "roc_points",
        "price_quantiles",
        "sample_facts",
        "run_entries",
        "run_kpis",
    ):
        timed[name] = lambda query=REGISTRY[name]: run(query(spark, folder))

    seconds = {}
    for name, action in timed.items():
        action()
        spent = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            action()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spent), 3)
    clear_settled(spark)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "raw_rows": rows,
                "groups": groups,
                "five_areas_rows": larger_rows,
                "clean_rows_per_sec": round(
                    larger_rows / seconds["clean_and_total_five_areas"]
                ),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
