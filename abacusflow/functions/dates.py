"""Dates and periods as written in statements, names and forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats by priority, day first; month names in Spanish.
FORMATS = ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "d-M-yyyy", "dd.MM.yyyy")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def parse_date(raw: Column) -> Column:
    """The first format that fits; a bare number is a day count from 1899-12-30; else null."""
    text = F.trim(raw.cast("string"))
    known = [F.when(text.rlike(f"^{shape(f)}$"), F.try_to_timestamp(text, F.lit(f)).cast("date")) for f in FORMATS]
    serial = F.when(text.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), text.try_cast("int")))
    return F.coalesce(*known, serial)


def shape(form: str) -> str:
    """A regular expression for a format: so many digits for its letters (one letter: one or two)."""
    digits = lambda m: r"\d{1,2}" if len(m[0]) == 1 else rf"\d{{{len(m[0])}}}"
    return re.sub(r"([dMy])\1*", digits, re.escape(form))


def parse_scanned_date(raw: Column) -> Column:
    """Quotes, stars, commas and dots between digits are read as slashes."""
    return parse_date(F.regexp_replace(F.regexp_replace(raw, r"\s", ""), r"['`*,.]", "/"))


def month_start(value: Column) -> Column:
    return F.trunc(value, "MM")


def parse_period(raw: Column) -> Column:
    """First of month from YYYYMM, MM/YYYY or YYYY-MM, by that priority; else null."""
    of = lambda pattern, form: F.when(F.regexp_extract(raw, pattern, 0) != "", F.try_to_timestamp(F.concat(F.regexp_extract(raw, pattern, 1), F.lit("-"), F.regexp_extract(raw, pattern, 2)), F.lit(form)).cast("date"))
    return F.coalesce(of(r"\b(20\d{2})(0[1-9]|1[0-2])\b", "yyyy-MM"), of(r"\b(0[1-9]|1[0-2])/(20\d{2})\b", "MM-yyyy"), of(r"\b(20\d{2})-(0[1-9]|1[0-2])\b", "yyyy-MM"))


def period_label(value: Column) -> Column:
    return F.date_format(value, "MM/yyyy")


def month_name(value: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(value) - 1)


def within_days_or_month(a: Column, b: Column, days: int = 7) -> Column:
    """Within so many days, or in the same month; a missing side passes."""
    return F.coalesce((F.abs(F.datediff(a, b)) <= days) | (F.trunc(a, "MM") == F.trunc(b, "MM")), F.lit(True))


def whole_years(start: Column, as_of: Column) -> Column:
    """Completed years, by month and day, not below 0."""
    early = (F.date_format(as_of, "MMdd") < F.date_format(start, "MMdd")).cast("int")
    return F.greatest(F.lit(0), F.year(as_of) - F.year(start) - early)


def fiscal_months(first: Column, last: Column) -> Column:
    """The months from one date to another as first-of-month dates."""
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
