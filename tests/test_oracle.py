"""A quick cut of the registered queries against their SQL; tools/check_oracle.py runs all of them."""

from __future__ import annotations

import duckdb
import pytest
from check_oracle import TABLES, rows_of

from firmledger.checks import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "X1_org_check_digit", "X4_folded_tokens", "X12_award_dates", "X13_award_amounts", "X16_canonical_row_hash", "X17_strata",
    "S4_award_rows", "W1_newest_awards", "P15_award_claims", "W2_newest_changes", "W3_filer_sample", "W6_stress_sample",
    "A1_footprints", "A2_company_sentiment", "A10_latency_percentiles", "F3_observation_reasons", "F5_contract_violations",
    "J15_headline_mentions", "J21_raw_occurrences", "S14_feed_entries", "F10_precision_guard", "W19_channels",
    "T1_deduplicated_stream", "T2_newest_events_stream", "T3_refresh_stream", "T4_daily_ledger_stream",
)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, db, name):
    result = all_queries()[name](spark, FOLDER)
    got = rows_of(result.columns, [tuple(row) for row in result.collect()])
    cursor = db.execute(all_sql()[name])
    assert got == rows_of([item[0] for item in cursor.description], cursor.fetchall())


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
