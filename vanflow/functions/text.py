"""String clean-up, slugs and fixed-width formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(c: Column | str) -> Column:
    """Codes are compared as trimmed strings everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string"))


def prompt_safe(c: Column) -> Column:
    """Quote marks become inches; apostrophes vanish; line breaks become spaces."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.replace(text, F.lit('"'), F.lit("inch"))
    text = F.replace(text, F.lit("'"), F.lit(""))
    for mark in "\n\r":  # a translation goes through every character, a replacement only seeks the mark
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return text


def fixed(c: Column, digits: int) -> Column:
    """Plain decimal text with a set number of digits and no grouping commas."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


# fixed patterns of the holiday-name normaliser, applied in this order
_PARENTHESES = r"\s*\([^)]*\)"
_HOLIDAY_SUFFIX = r"(?i)\s*holiday\s*$"
_APOSTROPHES = "['\u2019]"
_NON_SLUG = "[^a-z0-9]+"


def slug(c: Column) -> Column:
    """Lower-case name with runs of other characters collapsed to underscores."""
    text = F.coalesce(c, F.lit(""))
    for pattern in (_PARENTHESES, _HOLIDAY_SUFFIX, _APOSTROPHES):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.lower(text), _NON_SLUG, "_")
    return F.btrim(text, F.lit("_"))


def slug_text(name: str) -> str:
    """The same slug for a configured (non-column) name."""
    for pattern in (_PARENTHESES, _HOLIDAY_SUFFIX, _APOSTROPHES):
        name = re.sub(pattern, "", name)
    return re.sub(_NON_SLUG, "_", name.lower()).strip("_")
