"""Text folding, tokens, dates and amounts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staging import bound

# Stop words of the three tokenisers.
IDENTITY_STOP = (
    "as", "asa", "ans", "da", "enk", "iks", "sa", "sam", "sti", "stiftelsen",
    "nuf", "ab", "b", "v", "limited", "ltd", "inc", "plc", "the", "og", "and",
)
LEGAL_NAME_STOP = (
    "as", "asa", "ans", "da", "enk", "iks", "sa", "sam", "sti", "stiftelsen",
    "nuf", "ab", "limited", "ltd", "inc", "plc",
)
SEARCH_STOP = ("as", "asa", "ans", "da", "enk", "sa", "nuf", "company", "norge", "norway", "gruppen", "group")

# Month names that may spell a date in running text.
MONTH_NAMES = (
    "jan(?:uar)?|feb(?:ruar)?|mar(?:s|ch)?|apr(?:il)?|mai|may|jun(?:i|e)?|jul(?:i|y)?|aug(?:ust)?"
    "|sep(?:tember)?|okt(?:ober)?|oct(?:ober)?|nov(?:ember)?|des(?:ember)?|dec(?:ember)?"
)
WORD_PATTERN = r"[\p{L}\p{N}_\-]+"


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Accent map of lower-case letters and two-letter replacements, derived from Unicode decompositions."""
    source, target, multi = [], [], []
    special = {"ø": "o", "å": "a"}
    for code in range(0x00A0, 0x0250):
        char = chr(code)
        if char != char.lower() or char == "æ":
            continue
        plain = special.get(char) or unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode().lower()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif char.isalpha() and plain.isalpha():
            multi.append((char, plain))
    return "".join(source), "".join(target), multi


_ACCENTED, _PLAIN, _MULTI = _fold_tables()


def fold(value: Column) -> Column:
    """Lower-case ASCII form: Nordic letters mapped, accents removed, the rest of non-ASCII dropped."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    plain = F.translate(F.replace(text, F.lit("æ"), F.lit("ae")), _ACCENTED, _PLAIN)
    for char, letters in _MULTI:
        plain = F.replace(plain, F.lit(char), F.lit(letters))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def tokens(value: Column) -> Column:
    """All folded ``[a-z0-9]+`` tokens in order."""
    return F.regexp_extract_all(fold(value), F.lit(r"([a-z0-9]+)"), F.lit(1))


def _without(array: Column, stop: tuple[str, ...], minimum: int) -> Column:
    return F.filter(array, lambda token: (F.length(token) >= minimum) & ~token.isin(*stop))


def identity_tokens(value: Column) -> Column:
    """Tokens for the page-identity gate: legal forms and generic words out, two letters at least."""
    return _without(tokens(value), IDENTITY_STOP, 2)


def legal_name_tokens(value: Column) -> Column:
    """Distinctive legal-name tokens; single letters stay."""
    return _without(tokens(value), LEGAL_NAME_STOP, 1)


def search_tokens(value: Column) -> Column:
    """Tokens for search-result scoring: two letters at least, no stop words removed."""
    return F.filter(tokens(value), lambda token: F.length(token) > 1)


def compact_name(value: Column) -> Column:
    """Distinctive legal-name tokens joined without a separator."""
    return F.array_join(legal_name_tokens(value), "")


def acronym_aliases(name_tokens: Column) -> Column:
    """Aliases of a legal name: compact, initials, and first three or four letters plus initials."""
    initials = F.array_join(F.transform(name_tokens, lambda token: F.substring(token, 1, 1)), "")
    first = F.coalesce(F.try_element_at(name_tokens, F.lit(1)), F.lit(""))
    rest = F.substring(initials, F.lit(2), F.length(initials))
    many = F.size(name_tokens) >= 2
    candidates = F.array(
        F.array_join(name_tokens, ""),
        initials,
        F.when(many, F.concat(F.substring(first, 1, 3), rest)).otherwise(F.lit("")),
        F.when(many, F.concat(F.substring(first, 1, 4), rest)).otherwise(F.lit("")),
    )
    return F.array_distinct(F.filter(candidates, lambda alias: F.length(alias) >= 3))


def squash(value: Column) -> Column:
    """Trimmed text with inner runs of white space (also non-breaking) as one blank."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\s\u00A0\u2007\u202F]+", " "))


def squash_lower(value: Column) -> Column:
    return F.lower(squash(value))


def word_count(value: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(f"({WORD_PATTERN})"), F.lit(1)))


def parse_award_date(value: Column) -> Column:
    """First ten characters in ISO, d.m.y, d/m/y, d-m-y or y/m/d order; else null."""
    head = F.substring(squash(value), 1, 10)
    formats = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    )
    parsed = None
    for shape, pattern in formats:
        attempt = F.when(head.rlike(shape), F.try_to_date(head, pattern))
        parsed = attempt if parsed is None else F.coalesce(parsed, attempt)
    return parsed


def parse_amount(value: Column) -> Column:
    """Locale amount: the right-most of comma and point is the decimal mark when both occur."""
    raw = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\s\u00A0\u2007\u202F]+", "")
    comma, point = F.instr(raw, ",") > 0, F.instr(raw, ".") > 0
    last_comma = F.instr(F.reverse(raw), ",")
    last_point = F.instr(F.reverse(raw), ".")
    european = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(raw, F.lit(","), F.lit(""))
    plain = (
        F.when(comma & point & (last_comma < last_point), european)
        .when(comma & point, english)
        .when(comma, F.replace(raw, F.lit(","), F.lit(".")))
        .otherwise(raw)
    )
    return F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast("decimal(38,6)")


# A part of a longer dotted chain of numbers (an address, a version) is no date.
_SHORT_DATE = r"(?<!\d\.)\b([0-3]?\d[./-][01]?\d[./-]\d{2})\b(?!\.\d)"
_ISO_DATE = r"\b(20\d{2}-[01]\d-[0-3]\d)(?!\d)"
_LONG_DATE = r"(?<!\d\.)\b([0-3]?\d[./-][01]?\d[./-]20\d{2})\b(?!\.\d)"
_NAMED_DATE = r"(?i)\b([0-3]?\d\s+(?:" + MONTH_NAMES + r")\s+20\d{2})\b"
_DAY_FIRST = r"^([0-3]?\d)[./-]([01]?\d)[./-](\d{2,4})$"


def _day_first_date(raw: Column) -> Column:
    """ISO text of a day-first numeric date; two-digit years are 20yy; impossible dates are null."""
    year = F.regexp_extract(raw, _DAY_FIRST, 3)
    iso = F.concat_ws(
        "-",
        F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year),
        F.regexp_extract(raw, _DAY_FIRST, 2),
        F.regexp_extract(raw, _DAY_FIRST, 1),
    )
    return F.try_to_date(iso, "yyyy-M-d").cast("string")


def _first_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def first_text_date(text: Column) -> Column:
    """First date of a text: short numeric, ISO, long numeric, then a month name (kept as written)."""
    body = F.coalesce(text, F.lit(""))
    short = _day_first_date(_first_match(body, _SHORT_DATE))
    iso, long, named = (_first_match(body, pattern) for pattern in (_ISO_DATE, _LONG_DATE, _NAMED_DATE))
    return F.coalesce(
        short,
        F.when(iso.isNotNull(), iso).when(long.isNotNull(), _day_first_date(long)).otherwise(named),
    )


def all_text_dates(text: Column) -> Column:
    """Distinct normalised dates visible in a text; no numeric date counts in two shapes."""
    body = F.coalesce(text, F.lit(""))

    def every(pattern: str) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))

    short = F.transform(every(_SHORT_DATE), _day_first_date)
    long = F.transform(every(_LONG_DATE), _day_first_date)
    found = F.flatten(F.array(short, every(_ISO_DATE), long, every(_NAMED_DATE)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda item: item.isNotNull())))


def parse_deadline(raw: Column) -> Column:
    """Application deadline: ISO first, then day-first with four- and two-digit years."""
    text = squash(raw)
    iso = _first_match(text, r"\b(20\d{2}-[01]?\d-[0-3]?\d)\b")
    long, short = _first_match(text, _LONG_DATE), _first_match(text, _SHORT_DATE)
    return (
        F.when(iso.isNotNull(), F.try_to_date(iso, "yyyy-M-d"))
        .when(long.isNotNull(), F.to_date(_day_first_date(long)))
        .otherwise(F.to_date(_day_first_date(short)))
    )


def specific_title(title: Column, generic: tuple[str, ...], minimum_words: int = 2) -> Column:
    """A title that is not a section name, also not in its part before a separator."""
    folded = squash_lower(title)
    head = F.trim(F.element_at(F.split(folded, r"\s*(?:\||–|—|:)\s*|\s+-\s+", 2), 1))
    return (
        (folded != "")
        & ~folded.isin(*generic)
        & ~((head != folded) & head.isin(*generic))
        & (word_count(title) >= minimum_words)
    )


def norwegian_phone(value: Column) -> Column:
    """Last eight digits of a phone number without the country prefix."""
    number = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^0-9]", "")
    number = F.when((F.length(number) > 8) & number.startswith("47"), F.substring(number, F.lit(3), F.length(number))).otherwise(number)
    return F.right(number, F.lit(8))


# --- places in a text -------------------------------------------------------------------------------

MARK = "\u0001"


def running_totals(values: Column) -> Column:
    """Sum of all values before each place of an array of whole numbers.

    Appending to an array copies it, so the totals are made in blocks as long as the root of the array: sums of the blocks, their own
    totals, then each block from its base. A hundred thousand places take some ten million steps, not some billions.
    """
    def of_blocks(v: Column, width: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, F.lit(0)))
        add = lambda total, x: total + x
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(v, b * width + 1, width), F.lit(0), add))
        bases = bound(sums, lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), add)))
        start = lambda base: F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda state, x: F.struct((state["at"] + x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.flatten(F.transform(bases, lambda base, b: F.aggregate(F.slice(v, b * width + 1, width), start(base), step, lambda state: state["out"])))

    return bound(values, lambda v: bound(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda width: of_blocks(v, width)))


def pieces_between(text: Column, pattern: str) -> Column:
    """A text cut around all matches of a pattern: plain pieces at even places, matches at odd ones. A mark in the text reads as a space."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), pattern, MARK + "$0" + MARK), MARK, -1)


def occurrences(text: Column, pattern: str) -> Column:
    """Array of (start, written) of every match in order; starts count characters from zero."""
    def places(pieces: Column) -> Column:
        def matches(starts: Column) -> Column:
            odd = F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))
            return F.transform(odd, lambda at: F.struct(F.get(starts, at).alias("start"), F.get(pieces, at).alias("written")))

        found = bound(running_totals(F.transform(pieces, lambda piece: F.length(piece))), matches)
        return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast("array<struct<start:int,written:string>>"))

    return bound(pieces_between(text, pattern), places)


def last_at_most(starts: Column, value: Column) -> Column:
    """Place (from zero) of the last of some ascending numbers that is not above a value, by halving; the first is taken to be so."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step) <= value, at + step).otherwise(at))
