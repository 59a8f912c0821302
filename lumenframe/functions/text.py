"""Text normalisation expressions. Missing text stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Capital after every non-letter, as ``o'neil`` -> ``O'Neil``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda s: F.initcap(s)), "")


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


OPERATIONS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "title": title,
    "strip": strip,
    "remove_special": remove_special,
    "collapse_whitespace": collapse_whitespace,
    "capitalize_first": capitalize_first,
}

# Patterns that decide a value's kind.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://.+"
PHONE = r"^[\d\s\-+()]+$"
PHONE_LONG = r"^[\d\s\-+()]{7,}$"
CURRENCY = r"^[$€£¥₹][\d,]+\.?\d*$"


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def is_url(c: Column) -> Column:
    return c.rlike("(?i)" + URL)


def is_phone(c: Column) -> Column:
    return c.rlike(PHONE)
