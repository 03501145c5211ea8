"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query runs to completion through the ``noop`` sink (the
whole plan executes, nothing is collected to the driver).  One untimed pass over all
queries first (JVM JIT, generated code, Python workers), then the timed pass.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import CATALOG  # noqa: E402
from trawl.session import local_session, ship_package  # noqa: E402

HEADLINE = [
    "search_documents",
    "search_literal_ci",
    "search_literal_cs",
    "search_regex_ci",
    "search_regex_multiline",
    "search_regex_unicode_word",
    "search_pages",
    "search_conversations",
    "search_batch",
    "search_query_table",
    "search_incremental",
    "finding_markdown",
    "elab_prompt",
    "scan_files",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in HEADLINE if n in CATALOG] + [n for n in os.environ.get("BENCH_EXTRA", "").split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    ship_package(spark)
    for name in names:  # warm-up pass
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
