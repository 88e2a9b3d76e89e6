"""Long tables of the engine.

Every record family is a flat table keyed by organisation number; nothing is nested per company,
so a company with a third of all rows is just many rows and never one huge record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _D, _I = T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ENTITY = _schema(
    org=_S, name=_S, legal_form=_S, employees=_I, bankrupt=_B, liquidating=_B, municipality=_S,
    municipality_number=_S, industry_code=_S, industry_label=_S, website=_S, latest_submitted_accounts=_S,
)
MODULE_EVIDENCE = _schema(
    org=_S, module=_S, status=_S, source_type=_S, source_url=_S, retrieved_at=_S, value=_S, as_of=_S, note=_S,
    content_sha256=_S, source_row_key=_S, effective_at=_S,
)
OBSERVATION = _schema(
    id=_S, org=_S, platform=_S, signal_type=_S, source_url=_S, retrieved_at=_S, content_sha256=_S, exact_entity=_B,
    identity_proof=T.ArrayType(T.MapType(_S, _S)), acquisition_mode=_S, rights_status=_S, source_class=_S,
    evidence_span=_S, effective_at=_S, metrics=T.MapType(_S, _S), strategy=_S, event_kind=_S, event_awarded_at=_S,
    sentiment_label=_S, sentiment_model_version=_S, reviewer_id=_S, profile_url=_S, contact_email=_S,
)
# claim_order sorts the claims of one company: projector first, then position inside the projector.
CLAIM = _schema(
    org=_S, claim_order=_S, field=_S, value=_S, availability=_S, confidence=_D, evidence_ids=T.ArrayType(_S),
    currency=_S, reporting_period=_S, platform=_S, signal_type=_S, observation_id=_S, claim_scope=_S,
)
EVIDENCE = _schema(
    org=_S, id=_S, source_url=_S, source_class=_S, retrieved_at=_S, content_sha256=_S, claim_span=_S, as_of=_S,
    effective_at=_S, source_row_key=_S, source_field=_S, identity_proof=_S, extraction_method=_S,
)
FACT = _schema(
    org=_S, fact_order=_S, type=_S, canonical_field=_S, source_field=_S, value=_S, availability=_S, confidence=_D,
    evidence_ids=T.ArrayType(_S), currency=_S, reporting_period=_S, platform=_S, claim_scope=_S, signal_type=_S,
    observation_id=_S, ordinal=_I,
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of a table, cast, with nulls for the missing ones."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schema.fields
        ]
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    result = first
    for other in others:
        result = result.unionByName(other)
    return result
