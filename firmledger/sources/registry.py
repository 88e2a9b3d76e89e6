"""National registry bulk file and organisation-number manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orgnum import digits
from .quoted_csv import read_quoted_csv

# Header variants of the registry export, short form first.
REGISTRY_HEADERS = {
    "org": ("organisasjonsnummer", "Organisasjonsnummer"),
    "name": ("navn", "Navn"),
    "legal_form": ("organisasjonsform.kode", "Organisasjonsform.kode"),
    "employees": ("antallAnsatte", "Antall ansatte"),
    "bankrupt": ("konkurs", "Konkurs"),
    "liquidating": ("underAvvikling", "Under avvikling"),
    "municipality": ("forretningsadresse.kommune", "Forretningsadresse.kommune"),
    "municipality_number": ("forretningsadresse.kommunenummer", "Forretningsadresse.kommunenummer"),
    "industry_code": ("naeringskode1.kode", "Næringskode1.kode"),
    "industry_label": ("naeringskode1.beskrivelse", "Næringskode1.beskrivelse"),
    "website": ("hjemmeside", "Hjemmeside"),
    "latest_submitted_accounts": ("sisteInnsendteAarsregnskap", "Siste innsendte årsregnskap"),
}


def sniff_separator(first_line: str, candidates: str = ";,\t|") -> str:
    """The candidate that occurs most often outside quotes in the header line."""
    outside = re.sub(r'"[^"]*"', "", first_line)
    return max(candidates, key=lambda mark: (outside.count(mark), -candidates.index(mark)))


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_registry_rows(rows: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Typed entity columns from either header variant; dirty counts become null, only nine-character numbers stay."""
    present = set(rows.columns)

    def text(field: str) -> Column:
        found = [F.nullif(quoted(name), F.lit("")) for name in REGISTRY_HEADERS[field] if name in present]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    columns = []
    for field in REGISTRY_HEADERS:
        if field == "employees":
            columns.append(F.trim(text(field)).try_cast("int").alias(field))
        elif field in ("bankrupt", "liquidating"):
            columns.append((F.lower(text(field)) == "true").alias(field))
        else:
            columns.append(text(field).alias(field))
    if keep_raw:
        pairs = [item for name in rows.columns for item in (F.lit(name), quoted(name))]
        columns.append(F.create_map(*pairs).alias("raw"))
    return rows.select(*columns).filter(F.length("org") == 9)


def read_registry_bulk(spark: SparkSession, path: str, keep_raw: bool = False) -> DataFrame:
    """Registry CSV (plain or gzip, UTF-8 with or without a byte-order mark); the separator is read off the header.

    A plain file is read by many tasks, quoted line breaks or not; a gzip file is one task by nature: convert it once to Parquet.
    """
    header = spark.read.text(path).first()
    first_line = (header[0] if header else "").lstrip("﻿")
    rows = read_quoted_csv(spark, path, sniff_separator(first_line, ";,\t"))
    return normalize_registry_rows(rows, keep_raw)


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """Rows that make a manifest unusable: wrong length, or the same number twice."""
    wrong = manifest.filter(F.length("org") != 9).select("org", F.lit("invalid organisation number").alias("problem"))
    twice = (
        manifest.groupBy("org").count().filter("count > 1").select("org", F.lit("duplicate organisation number").alias("problem"))
    )
    return wrong.unionByName(twice)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of organisation numbers from .json, .jsonl or .txt, with its split annotations.

    Raises when a number is not nine digits long or occurs twice.
    """
    if path.endswith(".json"):
        body = spark.read.text(path, wholetext=True)
        raw = F.trim("value")
        listed = F.when(
            F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")
        ).otherwise(F.from_json(F.get_json_object(raw, "$.organisation_numbers"), "array<string>"))
        lines = body.select(F.explode(listed).alias("value"))
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    is_object = F.startswith(F.trim("value"), F.lit("{"))

    def member(name: str) -> Column:
        return F.when(is_object, F.get_json_object("value", f"$.{name}"))

    manifest = lines.select(
        digits(F.when(is_object, member("organisation_number")).otherwise(F.col("value"))).alias("org"),
        member("evaluation_split").alias("evaluation_split"),
        member("sample_slice").alias("sample_slice"),
    )
    problem = manifest_problems(manifest).first()
    if problem is not None:
        raise ValueError(f"{problem['problem']}: {problem['org']!r}")
    return manifest
