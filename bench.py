"""Times the headline queries and prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Queries over the tables that grow with the scale.
HEADLINE = ["sumifs_lineitem", "aggregates_lineitem", "conditional_by_group", "math_lineitem", "dates_orders", "finance_orders", "approximate_vlookup", "match_place", "rank_parts", "recalculate_lanes", "number_formats", "document_statistics", "innermost_section", "list_labels"]


def main() -> None:
    from pyspark.sql import SparkSession

    from gridloom.queries import QUERIES

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
    QUERIES["sumifs_lineitem"](spark, sf_dir).collect()  # starts the JVM's pools; not timed
    took = {}
    for name in HEADLINE:
        at = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - at, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
