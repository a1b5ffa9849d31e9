"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is run to completion with the ``noop`` sink (all rows computed,
nothing collected to the driver), twice on the same data: the first (cold)
run pays the one-time costs - plan construction, code generation, JIT - which
are fixed per query and do not grow with the data; the second (warm) run is
the steady-state execution. ``value`` is the warm total; the cold timings, and
the time the warm run took to build its plan, are reported next to it. Prints one
JSON line.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from baitline.plans import registry  # noqa: E402
from baitline.session import get_spark  # noqa: E402
from baitline.sources.tables import SCAN_PARTITIONS  # noqa: E402

HEADLINE = [
    "verdict_by_event_type",   # flagship: messages -> full report -> aggregate
    "document_redaction",      # R6 over whole documents
    "conversation_signals",    # redaction + signals over every conversation turn
    "page_links",              # link extraction over raw HTML
    "domain_dimension",        # distinct domains scored once (shuffle on domain)
    "risk_scores",             # K13 per message
    "case_packets",            # G3 + R7 guardrail per message
    "investigation_trace",     # G4 trace rows
    "campaigns",               # A7 aggregate per domain
    "recent_cases",            # A5 newest-8 per user (window group limit)
    "lite_agreement",          # Q9
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", partitions=int(cpus) * 2)
    # the bench tables are single-row-group files: ask for a task per core
    spark.conf.set(SCAN_PARTITIONS, cpus)
    queries = registry.spark_queries()
    names = [n for n in HEADLINE if n in queries]
    # warm-up: JVM start, class loading and codegen caches
    queries["message_links"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold, warm, build = {}, {}, {}
    for name in names:
        for timings in (cold, warm):
            t0 = time.time()
            df = queries[name](spark, sf_dir)
            build[name] = round(time.time() - t0, 3)  # of the second run: calls and analysis, before any row
            df.write.format("noop").mode("overwrite").save()
            timings[name] = round(time.time() - t0, 3)
    n_msgs = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    total = round(sum(warm.values()), 3)
    full = warm.get("verdict_by_event_type")
    out = {
        "metric": "total_headline_seconds_warm",
        "value": total,
        "unit": "sec",
        "queries": warm,
        "cold_total": round(sum(cold.values()), 3),
        "cold_queries": cold,
        "build_queries": build,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "messages": n_msgs,
        "full_report_messages_per_sec": round(n_msgs / full, 1) if full else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
