"""Entity filters, manifest joins and hash-ranked samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered, smallest, tree_digest
from ..functions.values import filer_stratum, stratum
from ..functions.web import bare_host, normalize_homepage

# Forms that always owe accounts, and forms where it depends on size or activity.
ALWAYS_OBLIGED_FORMS = ("AS", "ASA", "BRL", "BBL", "STI", "SF", "VPFO")
CONDITIONAL_FORMS = ("ENK", "ANS", "DA", "SA", "FLI", "ESEK", "NUF", "UTLA", "ORGL", "SAM", "SPA", "KS", "BO")


def eligible_filers(entities: DataFrame, latest_year: str, active_only: bool = True) -> DataFrame:
    """Entities whose latest accounts are of the given year and that are neither bankrupt nor liquidating."""
    keep = F.coalesce(F.col("latest_submitted_accounts"), F.lit("")) == str(latest_year)
    if active_only:
        keep = keep & ~F.coalesce("bankrupt", F.lit(False)) & ~F.coalesce("liquidating", F.lit(False))
    return entities.filter(keep)


def accounting_obligation(legal_form: Column, latest_accounts: Column) -> Column:
    """Rule path of the accounting obligation; an observed filing wins over the legal form."""
    form = F.upper(F.coalesce(legal_form, F.lit("")))
    return (
        F.when(F.coalesce(latest_accounts, F.lit("")) != "", F.lit("filing_observed"))
        .when(form.isin(*ALWAYS_OBLIGED_FORMS), F.lit("required_by_legal_form"))
        .when(form.isin(*CONDITIONAL_FORMS), F.lit("threshold_or_activity_dependent"))
        .otherwise(F.lit("special_rule_or_review_required"))
    )


def profiles_for_manifest(manifest: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per requested number; a number missing from the registry is an explicit ``not_found``.

    Plain left join: the optimiser broadcasts whichever side is small enough, else it shuffles on the number.
    """
    found = entities.withColumn("_present", F.lit(True))
    present = F.coalesce("_present", F.lit(False))
    return (
        manifest.join(found, "org", "left")
        .withColumn("registry_status", F.when(present, F.lit("available")).otherwise(F.lit("not_found")))
        .withColumn(
            "note",
            F.when(~present, F.lit("Organisation number is absent from the supplied registry snapshot.")),
        )
        .withColumn(
            "accounting_obligation",
            F.when(present, accounting_obligation(F.col("legal_form"), F.col("latest_submitted_accounts"))),
        )
        .drop("_present")
    )


def disjoint_cohort(universe: DataFrame, excluded: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Universe rows outside the excluded set and, when a registry is given, present in it."""
    cohort = universe.join(excluded.select("org").distinct(), "org", "left_anti")
    if registry is not None:
        cohort = cohort.join(registry.select("org"), "org", "left_semi")
    return cohort


def exclusion_chain(cohorts: list[DataFrame]) -> DataFrame:
    """Cumulative exclusion set with the position of the first cohort that touched each number."""
    tagged = [cohort.select("org", F.lit(index).alias("cohort")) for index, cohort in enumerate(cohorts)]
    return reduce(DataFrame.unionByName, tagged).groupBy("org").agg(
        F.min("cohort").alias("first_cohort"), F.count(F.lit(1)).alias("touches")
    )


def hash_rank(seed: int | str, org: Column, label: str = "") -> Column:
    """Order key of a seeded sample; hex digests of equal length sort like the numbers they spell."""
    prefix = f"{seed}:{label}:" if label else f"{seed}:"
    return F.sha2(F.concat(F.lit(prefix), org), 256)


def _in_order(rows: DataFrame, key: Column) -> DataFrame:
    """Positions of the rows of a sample by a key."""
    placed = numbered(rows.withColumns({"_all": F.lit(0), "_key": key}), "_all", "_key")
    return placed.withColumnRenamed("pos", "_position").drop("_all", "_key", "members")


def half_even(value: float) -> int:
    """Integer rounding with halves to even, as Python's own ``round``."""
    return round(value)


def split_by_position(position: Column, count: int, names: tuple[str, str, str]) -> Column:
    development, validation = half_even(count * 0.6), half_even(count * 0.2)
    return (
        F.when(position < development, F.lit(names[0]))
        .when(position < development + validation, F.lit(names[1]))
        .otherwise(F.lit(names[2]))
    )


def filer_sample(
    entities: DataFrame,
    count: int,
    latest_year: str,
    preserved: DataFrame | None = None,
    excluded: DataFrame | None = None,
    seed: int = 20260825,
) -> DataFrame:
    """Seeded sample of eligible filers: preserved rows first, then by hash rank; splits 60/20/20 by hash order."""
    eligible = eligible_filers(entities, latest_year)
    if excluded is not None:
        eligible = eligible.join(excluded.select("org").distinct(), "org", "left_anti")
    if preserved is None:
        ranked = eligible.withColumn("_preserved", F.lit(False))
    else:
        marks = preserved.select("org").distinct().withColumn("_mark", F.lit(True))
        ranked = eligible.join(marks, "org", "left").withColumn("_preserved", F.coalesce("_mark", F.lit(False))).drop("_mark")
    rank = F.when(F.col("_preserved"), hash_rank(seed, F.col("org"), "preserved")).otherwise(hash_rank(seed, F.col("org")))
    # Preserved rows sort first: 0 before 1.
    chosen, _ = smallest(ranked, count, F.concat(F.when(F.col("_preserved"), "0").otherwise("1"), rank))
    return _in_order(chosen, hash_rank(seed, F.col("org"), "order")).select(
        *entities.columns,
        F.when(F.col("_preserved"), F.lit("preserved_eligible"))
        .otherwise(F.lit("financial_filer_population"))
        .alias("sample_slice"),
        split_by_position(F.col("_position"), count, ("development", "validation", "held_out")).alias("evaluation_split"),
    )


def extension_sample(entities: DataFrame, count: int, excluded: DataFrame, seed: int = 20260824) -> DataFrame:
    """Seeded holdout of entities outside an excluded set."""
    rest = entities.join(excluded.select("org").distinct(), "org", "left_anti")
    return smallest(rest, count, hash_rank(seed, F.col("org")))[0].select(
        *entities.columns,
        F.lit("extension").alias("sample_slice"),
        F.lit("extension_holdout").alias("evaluation_split"),
    )


def website_audit_sample(
    entities: DataFrame, count: int, excluded: DataFrame, excluded_hosts: DataFrame | None = None, seed: int = 20260823
) -> DataFrame:
    """First company per website host in hash order, without excluded companies and hosts."""
    host = bare_host(normalize_homepage(F.col("website")))
    rows = (
        entities.join(excluded.select("org").distinct(), "org", "left_anti")
        .withColumn("host", host)
        .filter(F.coalesce("host", F.lit("")) != "")
        .withColumn("_rank", hash_rank(seed, F.col("org")))
    )
    if excluded_hosts is not None:
        rows = rows.join(excluded_hosts.select("host").distinct(), "host", "left_anti")
    # min_by combines on the map side, so a host with most of the rows costs one row per task.
    first = rows.groupBy("host").agg(
        F.min_by(F.struct(*entities.columns, "_rank"), F.col("_rank")).alias("row")
    )
    return smallest(first, count, F.col("row._rank"))[0].select(
        *[F.col(f"row.{name}").alias(name) for name in entities.columns],
        "host",
        F.lit("fresh_website_audit").alias("sample_slice"),
        F.lit("independent_final").alias("evaluation_split"),
    )


def entity_stratum(rows: DataFrame) -> Column:
    return stratum(
        F.col("legal_form"), F.col("employees"), F.col("bankrupt") | F.col("liquidating"), F.col("website")
    )


def stress_sample(entities: DataFrame, count: int, seed: int = 20260822) -> DataFrame:
    """70 % population sample plus a stress sample with a minimum per stratum.

    Every draw is a seeded hash rank instead of a sequential random generator,
    which does not depend on the input order.
    """
    population_count = half_even(count * 0.7)
    stress_count = count - population_count
    rows = entities.withColumn("stratum", entity_stratum(entities)).withColumn("_rank", hash_rank(seed, F.col("org")))
    population, picked = smallest(rows, population_count, F.col("_rank"))
    population = population.withColumn("sample_slice", F.lit("population"))
    rest = rows.filter(F.lit(False) if picked is None else ~picked)
    # The filter on row_number lets every task keep only the few leading rows of a stratum.
    strata = rows.select(F.col("stratum").alias("_stratum")).distinct().withColumn("_at", F.row_number().over(Window.orderBy("_stratum")))  # forms x bands x states x web: at most 96
    minimum = max(1, min(3, stress_count // max(1, strata.count())))
    stress_rank = hash_rank(seed, F.col("org"), "stress")
    within = F.row_number().over(Window.partitionBy("stratum").orderBy(stress_rank))
    floor = rest.withColumn("_within", within).filter(F.col("_within") <= minimum).select(F.col("org").alias("_floor"))
    # Rows of the minimum first, stratum by stratum, then all others: two digits of the stratum before the hash. At most three rows of each
    # of at most 96 strata are broadcast.
    tagged = rest.join(F.broadcast(strata), F.col("stratum").eqNullSafe(F.col("_stratum")))
    tagged = tagged.join(F.broadcast(floor), F.col("org") == F.col("_floor"), "left")
    lead = F.when(F.col("_floor").isNotNull(), F.concat(F.lit("0"), F.lower(F.lpad(F.hex("_at"), 2, "0")))).otherwise("100")
    stress, _ = smallest(tagged, stress_count, F.concat(lead, stress_rank))
    chosen = population.unionByName(stress.select(*rows.columns).withColumn("sample_slice", F.lit("stress")))
    return _in_order(chosen, F.col("_rank")).select(
        *entities.columns,
        "stratum",
        "sample_slice",
        split_by_position(F.col("_position"), count, ("development", "validation", "held_out")).alias("evaluation_split"),
    )


def seeded_batch(universe: DataFrame, count: int, seed: int, split: str, sample_slice: str) -> DataFrame:
    """k rows of a universe by seed."""
    return smallest(universe, count, hash_rank(seed, F.col("org")))[0].select(
        *universe.columns, F.lit(split).alias("evaluation_split"), F.lit(sample_slice).alias("sample_slice")
    )


def sample_counts(sample: DataFrame) -> DataFrame:
    """Split, legal-form and stratum counts of a sample as (dimension, label, companies)."""
    known_form = F.when(F.coalesce("legal_form", F.lit("")) == "", F.lit("missing")).otherwise(F.col("legal_form"))
    strata = filer_stratum(
        F.col("legal_form"), F.col("employees"), F.col("industry_code"), F.col("municipality_number"), F.col("website")
    )
    labels = F.array(
        F.struct(F.lit("evaluation_split").alias("dimension"), F.col("evaluation_split").alias("label")),
        F.struct(F.lit("legal_form").alias("dimension"), known_form.alias("label")),
        F.struct(F.lit("stratum").alias("dimension"), strata.alias("label")),
    )
    return (
        sample.select(F.explode(labels).alias("item"))
        .groupBy("item.dimension", "item.label")
        .agg(F.count(F.lit(1)).alias("companies"))
    )


def membership_hash(sample: DataFrame, fan: int = 1024) -> DataFrame:
    """Number and digest of the sorted numbers of a sample, as a tree of runs of ``fan``: (selected, selected_sha256).

    Up to ``fan`` members it is the plain digest of the joined numbers. An empty sample gives no row.
    """
    found = tree_digest(sample.select(F.lit(0).alias("_all"), "org"), "_all", "org", "org", fan)
    return found.select(F.col("members").alias("selected"), F.col("digest").alias("selected_sha256"))
