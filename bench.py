"""Times every banking query, stream replays included, and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the sample folder, BENCH_CPUS the threads.
Each query is run to its last row once; results go to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caudal.catalog import STREAM_QUERIES, all_queries  # noqa: E402
from caudal.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "caudal-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = sys.argv[1:]
    if wanted:
        queries = {k: q for k, q in queries.items() if any(w in k for w in wanted)}
    # One untimed query so that starting the JVM is not charged to the first one.
    all_queries()["kpi_resumen"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of all batch queries",
        "value": round(sum(s for k, s in seconds.items() if k not in STREAM_QUERIES), 3),
        "streams": round(sum(s for k, s in seconds.items() if k in STREAM_QUERIES), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
