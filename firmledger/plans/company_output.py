"""The whole company output as one lazy plan: claims of all families, one guard pass, facts and briefs once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import written
from ..operators import activity, awards, canonical, changes, claims, observations, reports, serving, site_surface


@dataclass(frozen=True)
class CompanyInputs:
    """Input tables of a run; the optional ones may stay out."""

    entities: DataFrame
    modules: DataFrame
    financials: DataFrame
    selected_awards: DataFrame | None = None
    selected_changes: DataFrame | None = None
    observations: DataFrame | None = None
    careers: tuple[DataFrame, DataFrame] | None = None
    activity: tuple[DataFrame, DataFrame] | None = None


@dataclass(frozen=True)
class CompanyOutput:
    claims: DataFrame
    evidence: DataFrame
    facts: DataFrame
    briefs: DataFrame
    violations: DataFrame


def company_output(inputs: CompanyInputs, retrieved_at: str, change_url: str, refresh: DataFrame | None = None) -> CompanyOutput:
    """Project every claim family, guard once, and derive facts, briefs and violations from the same claim tables."""
    current, evidence = claims.base_claims(inputs.entities, inputs.modules, inputs.financials)
    steps: list[tuple[Column, tuple[DataFrame, DataFrame]]] = [
        (claims.owns_live_claim(), claims.live_registry_claims(inputs.modules)),
        (claims.owns_narrative_claim(), claims.narrative_claims(current, inputs.modules)),
    ]
    if inputs.selected_changes is not None:
        pair = changes.change_claims(inputs.selected_changes, retrieved_at, change_url)
        steps.append((F.col("field") == changes.CHANGE_FIELD, pair))
    if inputs.selected_awards is not None:
        steps.append((F.col("field") == awards.AWARD_FIELD, awards.award_claims(inputs.selected_awards, retrieved_at)))
    if inputs.observations is not None:
        checked = observations.validated(inputs.observations)
        steps += [
            (F.col("field").isin("external.profile_handle", "social_links"), site_surface.handle_claims(checked)),
            (F.col("field") == "external.contact_email", site_surface.contact_claims(checked)),
            (F.col("field") == "external.workforce_snapshot", reports.workforce_claims(checked)),
        ]
    if inputs.careers is not None:
        steps.append((F.col("field") == activity.CAREERS_FIELD, inputs.careers))
    if inputs.activity is not None:
        steps.append((F.col("field").isin(activity.JOB_FIELD, activity.UPDATE_FIELD), inputs.activity))
    current, evidence = claims.replace_families(current, evidence, steps)
    current, evidence = activity.precision_guard(current, evidence)
    # Facts, briefs and violations all read these two tables: cut the lineage here once.
    current, evidence = written(current, "claims"), written(evidence, "evidence")
    facts = canonical.project_facts(current)
    return CompanyOutput(
        claims=current,
        evidence=evidence,
        facts=facts,
        briefs=serving.company_briefs(inputs.entities, facts, refresh),
        violations=canonical.fact_violations(facts, evidence),
    )
