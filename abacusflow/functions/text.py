"""Text: folding of accents and blanks, identifiers, vouchers, fields, line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented Latin letters and what they fold to.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"


def fold(text: Column) -> Column:
    """No accents, upper case, runs of blanks as one; null is ""."""
    plain = F.upper(F.translate(F.coalesce(text.cast("string"), F.lit("")), ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))


def fold_words(text: Column) -> Column:
    """As ``fold``, and all but letters, digits and blanks become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[^A-Z0-9 ]", " "), " +", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^0-9]", "")


def tax_id(text: Column) -> Column:
    """Eleven digits, else null."""
    found = digits(text)
    return F.when(F.length(found) == 11, found)


def near_equal_id(a: Column, b: Column) -> Column:
    """Eleven digits that differ in one place at most; an empty side is compatible."""
    differ = F.aggregate(F.sequence(F.lit(1), F.lit(11)), F.lit(0), lambda n, k: n + (F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))).cast("int"))
    missing = F.coalesce(a == "", F.lit(True)) | F.coalesce(b == "", F.lit(True))
    return missing | ((F.length(a) == 11) & (F.length(b) == 11) & (differ <= 1))


def voucher(point: Column, number: Column) -> Column:
    """Point of sale and number as 00000-00000000; longer numbers keep all digits."""
    return F.format_string("%05d-%08d", point.cast("long"), number.cast("long"))


def voucher_in(text: Column) -> Column:
    """The first voucher in free text in the form of ``voucher``, else null. Runs of digits count whole, up to 18 digits."""
    at = lambda k: F.regexp_extract(text, r"(?<!\d)(\d{1,18})\s*-\s*(\d{1,18})(?!\d)", k)
    return F.when(at(1) != "", voucher(at(1), at(2)))


def second_field(text: Column, separator: str = "/") -> Column:
    """The second field, trimmed; the whole text where there is none."""
    parts = F.split(text, F.lit(separator))
    return F.trim(F.coalesce(F.get(parts, F.lit(1)), text))


def payment_number(text: Column, label: str = "VEP") -> Column:
    """Digits after a label, "" if there are none."""
    return F.regexp_extract(text, rf"(?i){label}\s*(\d+)", 1)


def issuer_and_receiver(text: Column, known: Column, placeholders: tuple[str, ...] = ("00000000000",)) -> Column:
    """(issuer, receiver) from the ids in a text: a known id is the receiver and the first other one the issuer; else the first and the second."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{2}-?\d{8}-?\d)\b"), F.lit(1)), lambda x: F.regexp_replace(x, "-", "")))
    ids = F.filter(ids, lambda x: ~x.isin(*placeholders))
    others = F.array_except(ids, F.array(known))
    has = F.coalesce(F.array_contains(ids, known), F.lit(False))
    return F.struct(F.when(has, F.get(others, F.lit(0))).otherwise(F.get(ids, F.lit(0))).alias("issuer"), F.when(has, known).otherwise(F.get(ids, F.lit(1))).alias("receiver"))


def safe_name(text: Column, most: int = 31) -> Column:
    """A name for a sheet or file: reserved characters become blanks, at most ``most`` characters."""
    return F.left(F.trim(F.translate(text, "\\/*?:[]<>|\"", "           ")), F.lit(most))


# Company forms that end a name.
COMPANY_FORMS = "S\\.?A\\.?S?|S\\.?R\\.?L|S\\.?C\\.?A?|S\\.?H|COOP|LTDA"


def person_type(name: Column) -> Column:
    """"juridica" if the name ends with a company form, else "fisica"."""
    return F.when(fold(name).rlike(rf"(^|[ ,.])({COMPANY_FORMS})\.?$"), "juridica").otherwise("fisica")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line): a row per line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def account_in(text: Column, path: Column) -> Column:
    """An account number: the last 13 digits but one of a 22-digit bank code in the text, else the longest run of five digits or more in the path."""
    code = F.regexp_extract(text, r"\b(\d{22})\b", 1)
    runs = F.sort_array(F.transform(F.regexp_extract_all(path, F.lit(r"(\d{5,})"), F.lit(1)), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False)
    return F.when(code != "", F.substr(code, F.lit(9), F.lit(13))).otherwise(F.get(runs, F.lit(0))["x"])


def from_file_name(name: Column) -> Column:
    """(tax_id, kind, voucher) of a name such as 20111111112_006_00003_00000045.pdf; nulls where it is none."""
    pattern = r"(\d{11})_(\d{1,3})_(\d{1,5})_(\d{1,8})"
    at = lambda k: F.regexp_extract(name, pattern, k)
    return F.struct(F.when(at(1) != "", at(1)).alias("tax_id"), F.when(at(2) != "", at(2)).alias("kind"), F.when(at(3) != "", voucher(at(3), at(4))).alias("voucher"))


def date_in(text: Column, not_after: str = "inicio de actividades|vencimiento|vto", within: int = 40) -> Column:
    """The first dd/mm/yyyy in a text that does not follow one of some words closely."""
    day = r"\d{2}/\d{2}/\d{4}\b"
    # what stands before is only looked at where a date begins
    found = F.regexp_extract(text, rf"(?is)\b(?={day})(?<!(?:{not_after}).{{0,{within}}})({day})", 1)
    return F.try_to_timestamp(F.when(found != "", found), F.lit("dd/MM/yyyy")).cast("date")
