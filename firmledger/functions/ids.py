"""Deterministic identifiers and canonical hashes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staging import bound, unless


def material_id(prefix: str, length: int, *parts: Column | str) -> Column:
    """``prefix`` plus the first hex digits of sha256 over ``|``-joined parts; null counts as empty."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    material = F.concat_ws("|", *[F.coalesce(column.cast("string"), F.lit("")) for column in columns])
    return F.concat(F.lit(prefix), F.substring(F.sha2(material, 256), 1, length))


def canonical_json(fields: dict[str, Column] | list[str]) -> Column:
    """Compact JSON object with sorted keys that keeps nulls."""
    named = {name: F.col(name) for name in fields} if isinstance(fields, list) else fields
    return F.to_json(
        F.struct(*[named[name].alias(name) for name in sorted(named)]),
        {"ignoreNullFields": "false"},
    )


def canonical_hash(fields: dict[str, Column] | list[str]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def json_value(value: Column) -> Column:
    """JSON text of one scalar, so that claim values of all kinds share a column."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"^\{\"v\":(.*)\}$", 1))


def json_text(value: Column) -> Column:
    """Plain text of a JSON scalar column made by :func:`json_value`."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def literal_map(mapping: dict[str, Any]) -> Column:
    """A map column from a small fixed dictionary."""
    return F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])


def variant_json(value: Column) -> Column:
    """Any JSON text in one canonical form: compact, keys sorted at every depth. Null when it is no JSON.

    Trailing zeros of a decimal fraction are not kept: ``30000.0`` reads ``30000``.
    """
    return F.to_json(F.try_parse_json(value))


def json_member(value: Column, path: str) -> Column:
    """JSON text of a member with its type kept; null for a missing member, JSON null and empty content."""
    return variant_member(F.try_parse_json(value), path)


def variant_member(variant: Column, path: str) -> Column:
    """As :func:`json_member`, over JSON that was parsed once into a variant column."""
    return unless(F.to_json(F.try_variant_get(variant, path, "variant")), "null", '""', "[]", "{}")


def variant_text(variant: Column, path: str) -> Column:
    """Trimmed text of a scalar member; null for a missing or empty one."""
    return unless(F.trim(F.try_variant_get(variant, path, "string")), "")


def json_object(members: dict[str, Column]) -> Column:
    """Object of the non-null JSON members in key order; null when none is left."""
    pieces = [F.concat(F.lit(f'"{name}":'), members[name]) for name in sorted(members)]
    return bound(F.concat_ws(",", *pieces), lambda body: F.when(body != "", F.concat(F.lit("{"), body, F.lit("}"))))
