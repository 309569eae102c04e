"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidelog.catalog import queries

#: tc_cycle and same_generation are left out: over whole tables their results have 20 and 90 million rows at sf0.1.
HEADLINE = ("tc_linear", "tc_nonlinear", "tc_seeded", "magic_set", "triangle", "square", "neg_edb", "neg_idb", "agg_filtered", "agg_over_idb", "incremental_two_phase", "leap_intersect", "text_order")


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    own = queries()
    own["tc_seeded"](spark, d).count()  # the JVM compiles
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        own[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
