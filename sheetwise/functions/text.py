"""Column expressions over the text of tokens, blocks and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_digits(t: Column) -> Column:
    return t.rlike(r"^\d[\d.,]*$")


#: What a header ends with if it continues another one, and what tells so anywhere in it.
CONTINUED = r"\s*\((?:CONT['\u2019]?D|CONTINUED)\)\s*:?\s*$|\s*(?:CONT['\u2019]?D|CONTINUED)\s*:?\s*$"
CONTINUES = r"\((?:CONT['\u2019]?D|CONTINUED)\)|(?:CONT['\u2019]?D|CONTINUED)\s*:"


def is_digit_group(t: Column, ratio: float = 0.5) -> Column:
    """Text that begins with a digit, or is digits and points by at least that ratio; an empty one isn't."""
    marks = F.length(t) - F.length(F.regexp_replace(t, r"[0-9.]", ""))
    return (F.length(t) > 0) & (t.rlike("^[0-9]") | (marks >= F.length(t) * ratio))


def base_header(t: Column) -> Column:
    """A header in capitals without its colon and without a note at its end that it continues another."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(t), CONTINUED, ""), r":+$", ""))


def is_continuation(t: Column) -> Column:
    return F.upper(t).rlike(CONTINUES)


def ends_incomplete(t: Column) -> Column:
    return (F.length(F.trim(t)) > 0) & ~F.right(F.trim(t), F.lit(1)).isin(".", "!", "?", ":", ";")


MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTH_NAMES = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def parse_date(t: Column) -> Column:
    """Year-month-day, then month/day/year with / or -, then a month's name beside a day and a year; years under 100 are from 2000 on.

    The first reading that is a real date counts, else null. With a month's name the first number is the day, and the year is the last
    number if that is over 31, else the second.
    """
    iso, slash, dash = (r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})/(\d{1,2})/(\d{2,4})", r"(\d{1,2})-(\d{1,2})-(\d{2,4})")

    def made(year: Column, month: Column, day: Column, below: int = 100) -> Column:
        full = F.when(year < below, year + 2000).otherwise(year)
        return F.format_string("%04d-%02d-%02d", full, month, day).try_cast("date")

    def dated(pattern: str, y: int, m: int, d: int) -> Column:
        return made(*[F.regexp_extract(t, pattern, k).try_cast("int") for k in (y, m, d)])

    parts = F.regexp_extract_all(F.upper(t), F.lit(r"[A-Z]+|\d+"), F.lit(0))
    names = F.array(*[F.lit(m) for m in MONTHS]), F.array(*[F.lit(m) for m in MONTH_NAMES])
    month_of = lambda p: F.greatest(F.array_position(names[0], p), F.array_position(names[1], p)).cast("int")
    months = F.filter(F.transform(parts, month_of), lambda m: m > 0)
    numbers = F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda n: n.isNotNull())
    last = F.element_at(numbers, -1)
    year = F.when(last > 31, last).otherwise(F.get(numbers, 1))
    named = F.when((F.size(months) > 0) & (F.size(numbers) >= 2), made(year, F.get(months, 0), F.get(numbers, 0), 101))
    return F.coalesce(dated(iso, 1, 2, 3), dated(slash, 3, 1, 2), dated(dash, 3, 1, 2), named)


def starts_as_continuation(t: Column) -> Column:
    """Text that begins with a small letter, after spaces."""
    return F.trim(t).rlike("^[a-z]")


def extra_symbols(found: Column, known: Column, allowed: str) -> Column:
    """Allowed symbols of found that known lacks, in order and with repeats."""
    return F.array_join(F.filter(F.split(found, ""), lambda c: F.lit(allowed).contains(c) & (c != "") & ~F.contains(known, c)), "")


def producer_name(t: Column) -> Column:
    """Lower case, without what follows the first version number."""
    return F.trim(F.regexp_replace(F.lower(F.trim(t)), r"[\s/]*v?\d+(\.\d+)*.*$", ""))


def font_name(t: Column) -> Column:
    return F.regexp_replace(t, r"^[A-Z]{6}\+", "")


def severity(base: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """One step down where the mean confidence is under the threshold."""
    lower = F.when(base == "error", "warning").when(base == "warning", "info").otherwise(base)
    return F.when(confidence < threshold, lower).otherwise(base)


def token_estimate(t: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4).cast("int"))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """The share of keywords that the answer holds, in any case; 1 without keywords."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(hits / F.size(keywords))


def content_hash(page: Column, t: Column) -> Column:
    return F.substring(F.sha2(F.concat(page.cast("string"), F.lit(":"), t), 256), 1, 16)


def slug(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def detail_references(t: Column) -> Column:
    """References to sheet details such as 3/A-101, each once."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b\d{1,2}/[A-Z]-?\d{1,4}\b"), F.lit(0)))


def page_quality(density: Column, regions: Column, errors: Column) -> Column:
    one = F.lit(1.0)
    return F.round(F.greatest(F.lit(0.0), (0.4 * F.least(one, density / 2) + 0.4 * F.least(one, regions / 3)) * (1 - F.least(one, errors * 10)) + 0.2), 3)
