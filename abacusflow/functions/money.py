"""Money as exact decimals: parsing of written amounts, rounding half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(value: Column | str) -> Column:
    """A number as decimal(18,2), rounded half up; null stays null."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("decimal(28,8)"), 2).cast(MONEY)


def part_of(total: Column, weight: Column, whole: Column) -> Column:
    """total * weight / whole to the cent, half up, from whole cents, so that nothing is rounded twice; null where the whole is 0."""
    cents = lambda c: (c.cast(MONEY) * 100).cast("decimal(18,0)")
    product, below = cents(total) * cents(weight), F.abs(cents(whole)).cast("decimal(18,0)")
    size = F.when(below != 0, F.call_function("div", F.abs(product) * 2 + below, below * 2))
    sign = F.signum(product.cast("double") * F.signum(cents(whole).cast("double"))).cast("int")
    return (size.cast("decimal(18,0)") * sign * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def _text(raw: Column) -> Column:
    text = F.regexp_replace(raw.cast("string"), r"[\s$]", "")
    return F.when(F.lower(text).isin("", "nan", "none"), None).otherwise(text)


def parse_decimal(raw: Column) -> Column:
    """Both separators: the later one is decimal; only commas: decimal; only a dot: decimal point. Unreadable or missing: 0."""
    text = _text(raw)
    comma = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    point = F.replace(text, F.lit(","), F.lit(""))
    both = text.contains(",") & text.contains(".")
    comma_last = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
    plain = F.when(both & comma_last, comma).when(both, point).when(text.contains(","), comma).otherwise(text)
    return F.coalesce(money(plain.try_cast("decimal(28,8)")), F.lit(0).cast(MONEY))


def parse_last_separator(raw: Column) -> Column:
    """Scanned amounts: letters read for digits are mended; one or two digits after the last separator are decimals, else all separators are thousands."""
    text = F.translate(F.regexp_replace(raw.cast("string"), r"[\s$]", ""), "oOl|", "0011")
    text = F.regexp_replace(text, r"[^0-9.,]", "")
    tail = F.regexp_extract(text, r"[.,](\d{1,2})$", 1)
    digits = F.regexp_replace(F.when(tail != "", F.regexp_replace(text, r"[.,]\d{1,2}$", "")).otherwise(text), r"[.,]", "")
    whole = F.when(digits == "", "0").otherwise(digits)
    number = F.when(tail != "", F.concat_ws(".", whole, tail)).otherwise(whole)
    return F.coalesce(money(number.try_cast("decimal(28,8)")), F.lit(0).cast(MONEY))


def parse_tolerant(raw: Column) -> Column:
    """Parentheses mean negative, several dots are thousands, a comma after the dots is decimal; null if unreadable."""
    text = _text(raw)
    negative = text.rlike(r"^\(.*\)$") | text.startswith("-")
    body = F.regexp_replace(text, r"[()\-+]", "")
    dots = F.size(F.split(body, r"\.")) - 1
    comma_last = F.instr(F.reverse(body), ",") < F.instr(F.reverse(body), ".")
    comma = F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = (
        F.when(body.contains(",") & body.contains("."), F.when(comma_last, comma).otherwise(F.replace(body, F.lit(","), F.lit(""))))
        .when(body.contains(","), comma)
        .when(dots > 1, F.replace(body, F.lit("."), F.lit("")))
        .otherwise(body)
    )
    value = plain.try_cast("decimal(28,8)")
    return money(F.when(negative, -value).otherwise(value))


MODES = {"decimal": parse_decimal, "last_separator": parse_last_separator, "tolerant": parse_tolerant}


def parse(raw: Column, mode: str) -> Column:
    """A written amount by one of the modes; there is no general default, as "1.234" means something else in each."""
    return MODES[mode](raw)


def percent(value: Column, default: float) -> Column:
    """A rate as a fraction: above 1 it is a percentage; unreadable or missing: the default."""
    number = F.coalesce(value.try_cast("decimal(18,6)"), F.lit(default).cast("decimal(18,6)"))
    return F.when(number > 1, (number / 100).cast("decimal(18,6)")).otherwise(number)


def rate_label(rate: Column) -> Column:
    """10.5 -> "10,5%", 21 -> "21%"."""
    text = F.regexp_replace(F.format_string("%.2f", rate.cast("double")), r"\.?0+$", "")
    return F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit("%"))
