"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query runs three times and its best time counts, so neither the warm-up nor tables that several queries share weigh on it.
"""

from __future__ import annotations

import json
import os
import time

from firmledger.checks import all_queries
from firmledger.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "X4_folded_tokens",
    "J1_profiles_for_manifest",
    "W3_filer_sample",
    "W1_newest_awards",
    "P15_award_claims",
    "W2_newest_changes",
    "A11_change_reach",
    "J21_raw_occurrences",
    "S8_account_records",
    "A1_footprints",
    "A2_company_sentiment",
    "S15_page_events",
    "F5_contract_violations",
    "J15_headline_mentions",
    "S14_feed_entries",
    "W14_business_descriptions",
)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    for name in HEADLINE:
        took = []
        for _ in range(3):
            started = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        seconds[name] = round(min(took), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
