"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The text tokens a pandas CSV reader turns into a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Pieces removed from an incident street, in this order; then everything from '#' on.
STREET_NOISE = (", PGH", ", P", ",")
UNIT_PATTERN = r"#[^\n]*"

# Fixed value: block group digit and tract number in a census geography label.
GEOGRAPHY_PATTERN = r"Block Group (\d), Census Tract (\d+\.?\d*)"

# Fixed value: the separator between the labels of one multi-label value.
LABEL_SEPARATOR = " :: "


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove all Unicode white space at both ends (plain ``trim`` only removes blanks)."""
    return F.btrim(_col(value), F.lit(WHITESPACE))


def missing_to_null(value: Column | str, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    value = _col(value)
    return F.when(~value.isin(*tokens), value)


def replace_all(value: Column | str, find: str, new: str = "") -> Column:
    """Literal replacement of every occurrence."""
    return F.replace(_col(value), F.lit(find), F.lit(new))


def normalise_code(value: Column | str) -> Column:
    """Collapse the double blank before the dash of an old-style incident code."""
    return replace_all(value, "  -", " -")


def normalise_street_type(value: Column | str, whole_word: bool = False) -> Column:
    """``AV`` becomes ``AVE``; unless ``whole_word`` the letters are replaced inside words too."""
    if whole_word:
        return F.regexp_replace(_col(value), r"\bAV\b", "AVE")
    return replace_all(value, "AV", "AVE")


def clean_street(value: Column | str) -> Column:
    """Drop city suffixes, commas and unit numbers from a street, then strip it."""
    cleaned = _col(value)
    for noise in STREET_NOISE:
        cleaned = replace_all(cleaned, noise)
    return strip(F.regexp_replace(cleaned, UNIT_PATTERN, ""))


def first_part(value: Column | str, separator: str) -> Column:
    """Text before the first separator; the whole text if there is none."""
    return F.substring_index(_col(value), separator, 1)


def join_strict(separator: str, *parts: Column | str) -> Column:
    """Concatenate with a separator; null as soon as one part is null."""
    columns: list[Column] = []
    for part in parts:
        if columns:
            columns.append(F.lit(separator))
        columns.append(_col(part))
    return F.concat(*columns)


def extract_groups(value: Column | str, pattern: str, groups: int) -> list[Column]:
    """One column per capture group, null where the pattern does not match."""
    value = _col(value)
    return [
        F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))
        for group in range(1, groups + 1)
    ]


def first_char(value: Column | str) -> Column:
    return F.substring(_col(value), 1, 1)


def target_flag(code: Column | str, prefix: str = "1") -> Column:
    """1 where the code starts with ``prefix``, else 0 (also for a missing code)."""
    return F.when(_col(code).startswith(prefix), F.lit(1)).otherwise(F.lit(0))


def matches_from_start(value: Column | str, pattern: str) -> Column:
    """True where the pattern matches at the first character."""
    return _col(value).rlike(f"^(?:{pattern})")


def split_labels(value: Column | str, separator: str = LABEL_SEPARATOR) -> Column:
    """Distinct non-empty labels of a multi-label text."""
    parts = F.split(_col(value), f"\\Q{separator}\\E", -1)
    return F.array_distinct(F.filter(parts, lambda label: label != ""))
