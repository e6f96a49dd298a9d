"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ["page_text", "sub_lines", "box_iou", "localization", "text_match", "table_assign", "layout_labels", "kie_group", "encode_decode", "ctc_decode", "nms_keep", "export_html"]


def main() -> None:
    from pagequarry.queries import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
