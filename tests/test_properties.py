"""Input order never changes a result, and projections can be repeated."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from firmledger.checks import bindings as b
from firmledger.checks.awards import targets
from firmledger.operators import awards, cohorts
from firmledger.operators.claims import replace_managed
from firmledger.operators.matching import similarity
from firmledger.operators.awards import AWARD_FIELD
from firmledger.sources.awards import normalize_award_rows

FOLDER = "/root/testdata/sf0.001"


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_sample_ignores_input_order(spark):
    entities = b.entity(spark, FOLDER)
    shuffled = entities.repartition(5).orderBy(F.rand(3))
    pick = ["org", "sample_slice", "evaluation_split"]
    assert same(cohorts.filer_sample(entities, 20, "2025").select(pick), cohorts.filer_sample(shuffled, 20, "2025").select(pick))


def test_newest_awards_with_one_hot_company(spark):
    """A company with most of the awards still gives its newest five, and the others keep theirs."""
    rows = normalize_award_rows(b.award_rows(spark, FOLDER))
    hot = rows.withColumn("recipient_orgs", F.when(F.col("measure_number").cast("int") % 3 > 0, F.array(F.lit("974760673"))).otherwise(F.col("recipient_orgs")))
    wanted = targets(spark, FOLDER).unionByName(spark.createDataFrame([("974760673",)], "org string"))
    picked = awards.newest_awards(hot, wanted, "2001-08-01", lookback_days=4000).groupBy("org").count().collect()
    counts = {row["org"]: row["count"] for row in picked}
    assert counts["974760673"] == 5 and max(counts.values()) == 5


def test_award_projection_is_idempotent(spark):
    rows = normalize_award_rows(b.award_rows(spark, FOLDER))
    pair = awards.award_claims(awards.newest_awards(rows, targets(spark, FOLDER), "2001-08-01", 4000), b.RETRIEVED_AT)
    managed = F.col("field") == AWARD_FIELD
    once = replace_managed(*pair, managed, *pair)
    twice = replace_managed(*once, managed, *pair)
    assert same(once[0], twice[0]) and same(once[1], twice[1]) and same(once[0], pair[0])


def test_name_similarity_equals_matching_blocks(spark):
    """Against the standard library's ratio on names below the length from which it passes over frequent characters."""
    rng = random.Random(11)
    names = [None, "", "a", "kunde 100001 handel", "butikk 100001", "æøå as", *("".join(rng.choices("abc d", k=rng.randint(1, 40))) for _ in range(60))]
    pairs = [(n, x, y) for n, (x, y) in enumerate((x, y) for x in names[:12] for y in names)] + [(10_000, "x" * 150, "yx" * 80)]
    rows = spark.createDataFrame(pairs, "n int, x string, y string").select("x", "y", similarity(F.col("x"), F.col("y")).alias("got")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        want = difflib.SequenceMatcher(None, r.x, r.y, autojunk=False).ratio() if r.x and r.y else 0.0
        assert abs(r.got - want) < 1e-12, (r.x, r.y)
