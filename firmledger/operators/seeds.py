"""Verified-site seeds (S17): reviewed home pages that override the registry's, before the usual crawl and identity gate.

A seed never proves a site by itself; it only says which address is to be looked at first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED_SOURCE = "independently_verified_exact_entity"


def _absolute(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike("^https?://"), F.lit(False))


def judged_seeds(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every seed with the first rule it breaks as ``rule``, null for the one that is applied and exact repeats of it.

    ``seeds`` holds org, website, proof_url, proof and position. Rules in order: unknown_company, relative_website, relative_proof, and
    repeated_seed for all usable seeds of a company but the last one (of equal positions, the one with the greatest address).
    """
    known = entities.select("org").distinct().withColumn("_known", F.lit(True))
    rows = seeds.join(known, "org", "left")
    rows = rows.withColumn(
        "rule",
        F.when(F.col("_known").isNull(), "unknown_company")
        .when(~_absolute(F.col("website")), "relative_website")
        .when(~_absolute(F.col("proof_url")), "relative_proof"),
    )
    # Only usable seeds compete, so a broken one never hides a good one. A company may have any number: no window over them.
    seed = F.struct("position", F.trim("website").alias("website"), F.trim("proof_url").alias("proof_url"), F.coalesce("proof", F.lit("")).alias("proof"))
    last = rows.filter(F.col("rule").isNull()).groupBy("org").agg(F.max(seed).alias("_last"))
    rows = rows.join(last, "org", "left").withColumn("_seed", seed)
    repeated = F.col("rule").isNull() & (F.col("_seed") != F.col("_last"))
    return rows.withColumn("rule", F.when(repeated, "repeated_seed").otherwise(F.col("rule"))).drop("_known", "_last", "_seed")


def apply_seeds(entities: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with their seeded website, its source and proof, and the table of seeds that were not applied.

    Companies without a seed keep their website and have no source. Both results are lazy: whoever must not go on with a broken
    seed list looks at the second one.
    """
    judged = judged_seeds(entities, seeds)
    used = judged.filter(F.col("rule").isNull()).select(
        "org", F.trim("website").alias("_website"), F.trim("proof_url").alias("website_proof_url"), F.coalesce("proof", F.lit("")).alias("website_proof")
    ).distinct()
    rows = entities.join(used, "org", "left")
    seeded = F.col("_website").isNotNull()
    rows = rows.withColumns({"website": F.coalesce("_website", "website"), "website_seed_source": F.when(seeded, F.lit(SEED_SOURCE))}).drop("_website")
    return rows, judged.filter(F.col("rule").isNotNull()).select("org", "rule", "position", "website", "proof_url")
