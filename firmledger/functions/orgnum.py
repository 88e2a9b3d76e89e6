"""Organisation numbers: check digit and extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mod-11 weights of the first eight digits.
CHECK_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)

_GAP = r"[\s\u00A0\u2007\u202F.\-]"
# Three groups of three, optionally prefixed, bounded by non-digits on both sides.
FREE_TEXT_PATTERN = (
    r"(?i)(?<![0-9])(?:NO\s*)?([0-9]{3}" + _GAP + r"?[0-9]{3}" + _GAP + r"?[0-9]{3})(?![0-9])"
)
_NINE = r"((?:[0-9]" + _GAP + r"?){8}[0-9])"
LABELLED_PATTERN = (
    r"(?i)\b(?:organisasjons(?:nummer|nr)|org(?:anisasjons)?\.?\s*(?:nr|nummer)\.?"
    r"|organi[sz]ation\s*(?:number|no\.?))\s*[:#-]?\s*" + _NINE + r"\b"
)
VAT_LABELLED_PATTERN = r"(?i)\bNO\s*[:#-]?\s*" + _NINE + r"\s*MVA\b"


def digits(value: Column) -> Column:
    """Only the ASCII digits of a value."""
    return F.regexp_replace(value.cast("string"), r"[^0-9]", "")


def has_valid_check_digit(value: Column) -> Column:
    """Mod-11 check: nine digits, a remainder of 11 checks as 0 and one of 10 never checks."""
    number = digits(value)
    weighted = sum(
        (F.substring(number, position + 1, 1).try_cast("int") * weight for position, weight in enumerate(CHECK_WEIGHTS)),
        F.lit(0),
    )
    control = F.pmod(F.lit(11) - F.pmod(weighted, F.lit(11)), F.lit(11))
    last = F.substring(number, 9, 1).try_cast("int")
    return F.coalesce((F.length(number) == 9) & (control != 10) & (control == last), F.lit(False))


def extract_org_numbers(text: Column) -> Column:
    """Distinct checksum-valid organisation numbers found anywhere in free text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FREE_TEXT_PATTERN), F.lit(1))
    bare = F.transform(found, digits)
    return F.array_distinct(F.filter(bare, has_valid_check_digit))


def extract_labelled_org_numbers(text: Column) -> Column:
    """Nine-digit numbers that the text itself labels as organisation numbers (no checksum needed)."""
    body = F.coalesce(text, F.lit(""))
    labelled = F.regexp_extract_all(body, F.lit(LABELLED_PATTERN), F.lit(1))
    vat = F.regexp_extract_all(body, F.lit(VAT_LABELLED_PATTERN), F.lit(1))
    bare = F.transform(F.array_union(labelled, vat), digits)
    return F.array_distinct(F.filter(bare, lambda number: F.length(number) == 9))
