"""Plans of the filtering stages: a filter on a verdict copies none of the array work into its lambdas."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from firmledger.llm import quality_gbt, quality_rules


def lambdas(plan):
    """Bodies of the lambda functions of a plan's text."""
    for found in re.finditer(r"lambdafunction\(", plan):
        depth, end = 1, found.end()
        while depth and end < len(plan):
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        yield plan[found.end() : end]


@pytest.mark.parametrize("stage", ["classifier", "rules"])
def test_no_array_is_made_anew_for_each_element(spark, stage):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality_gbt.keep(docs, spark.read.parquet(f"{sf}/labels.parquet")) if stage == "classifier" else quality_rules.keep(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    bodies = list(lambdas(plan))
    assert bodies and not [b for b in bodies if "split(" in b or "sort_array(" in b or "array_remove(" in b]


def test_long_repeating_texts_pass_both_stages(spark):
    text = F.repeat(F.lit("the same five words again and again, and so on. "), 20_000)  # a million characters
    docs = spark.range(3).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert quality_rules.keep(docs).count() == 0
    assert quality_gbt.keep(docs, labels).count() in (0, 3)
