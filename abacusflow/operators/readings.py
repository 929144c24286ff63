"""Forms, schedules, sheets and lines, read from the text that was taken out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.text import fold, voucher
from ..sources.scratch import stored
from ..sources.tables import spread
from .extract import first_of
from .figures import signed_total


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


# How a line may write a date, by priority, with what stands between its parts; and the years that count.
LINE_DATES = (("yyyy-MM-dd", " \t-"), ("dd-MM-yyyy", "/-"), ("yyyyMMdd", ""))
YEARS = (2000, 2040)


def date_in_line(line: Column) -> Column:
    """The first date of a line as yyyy-mm-dd (or with blanks), dd/mm/yyyy (or with dashes), yyyymmdd, in this order, of the years 2000 to 2040; else null."""

    def written(form: str, between: str) -> Column:
        same = F.translate(line, between, "-" * len(between)) if between else line
        beside = r"[\d_\p{L}]" if between else r"\d"  # what may not stand next to it
        found = F.regexp_extract(same, rf"(?<!{beside}){dates.shape(form)}(?!{beside})", 0)
        day = F.when(found != "", F.try_to_timestamp(found, F.lit(form)).cast("date"))
        return F.when(F.year(day).between(*YEARS), day)

    return F.coalesce(*[written(form, between) for form, between in LINE_DATES])


def _amount_shape() -> str:
    """A number as statements write it: whole or with two decimals after a point or a comma; before a comma thousands may be set off by points."""
    run, cents = r"\d+", r"\d{2}"
    thousands = r"\d{1,3}(?:\.\d{3})+"
    return rf"(?:{thousands}|{run}),{cents}|{run}(?:\.{cents})?"


_NUMBER = rf"(?<!\d)({_amount_shape()})(?!\d)"


def movement_numbers(text: Column) -> Column:
    """(units, price, amount) of a movement's line, after its date: positive numbers that are no bare years.

    Three or more: the first, the second and the last. Two: the second is the
    amount if it is over one and a half times the first, else the price. One: units.
    """
    plain = F.filter(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda x: ~(x.rlike(r"^\d{4}$") & x.try_cast("int").between(1900, 2100)))
    return _let(F.filter(F.transform(plain, lambda x: money.parse_decimal(x)), lambda x: x > 0), _roles)


def _roles(numbers: Column) -> Column:
    first, second, last = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.get(numbers, F.size(numbers) - 1)
    rate = lambda c: F.round(c.cast("decimal(38,12)"), 6).cast("decimal(18,6)")
    by_amount = last > first * F.lit("1.5").cast("decimal(2,1)")
    price = F.when(F.size(numbers) >= 3, rate(second)).when(F.size(numbers) == 2, F.when(by_amount, rate(F.try_divide(last, first))).otherwise(rate(last)))
    amount = F.when(F.size(numbers) >= 3, last).when(F.size(numbers) == 2, F.when(by_amount, last).otherwise(F.round(first * last, 2).cast(money.MONEY)))
    return F.when(F.size(numbers) > 0, F.struct(first.alias("units"), price.alias("price"), amount.alias("amount")))


def month_of(day: Column, below: Column) -> Column:
    """The month that a movement counts for: that of a label such as "Abril 2025" in the lines below it, else that of its day."""
    told = fold(below)
    label = F.regexp_extract(told, rf"\b({'|'.join(m.upper() for m in dates.MONTHS)})\b(?:\s+(20\d{{2}}))?", 1)
    year = F.regexp_extract(told, r"\b(20\d{2})\b", 1).try_cast("int")
    number = F.array_position(F.array(*[F.lit(m.upper()) for m in dates.MONTHS]), label)
    return F.when(label != "", F.make_date(F.coalesce(year, F.year(day)), number.cast("int"), F.lit(1))).otherwise(F.trunc(day, "MM"))


def invoice_form(text: Column) -> Column:
    """The fields of the tax authority's simple invoice form; the total of a credit note is negative."""
    at = lambda *patterns: first_of(text, list(patterns))
    kind = _let(fold(text), lambda x: F.when(x.contains("NOTA DE CREDITO"), "Nota de Crédito").when(x.contains("NOTA DE DEBITO"), "Nota de Débito").otherwise("Factura"))
    letter = at(r"(?i)(?:factura|cr[eé]dito|d[eé]bito)\s+([ABC])\b")
    total = _let(at(r"(?i)importe total:\s*\$?\s*([\d.,]+)"), money.parse_decimal)
    return F.struct(
        F.concat_ws(" ", kind, letter).alias("kind"),
        at(r"(?i)c[oó]digo:\s*(\d{3})").alias("code"),
        _let(at(r"(?i)punto de venta:\s*(\d+)"), lambda x: F.when(x.isNotNull(), voucher(x, at(r"(?i)comp\.?\s*nro:\s*(\d+)")))).alias("voucher"),
        _let(at(r"(?i)fecha de emisi[oó]n:\s*(\d{2}/\d{2}/\d{4})"), dates.parse_date).alias("issued"),
        _let(at(r"(?i)desde:\s*(\d{2}/\d{2}/\d{4})"), dates.parse_date).alias("period_from"),
        _let(at(r"(?i)hasta:\s*(\d{2}/\d{2}/\d{4})"), dates.parse_date).alias("period_to"),
        F.trim(at(r"(?i)concepto:\s*([^\n]+)")).alias("concept"),
        signed_total(total, F.when(kind == "Nota de Crédito", "NC").otherwise("F")).alias("total"),
        at(r"(?i)\bCAE:\s*(\d{14})").alias("cae"),
    )


def labelled_amounts(text: Column, labels: dict[str, str], repeated: tuple[str, ...] = ()) -> dict[str, Column]:
    """An amount per label (a pattern with one group): the first that is found, or the sum of all for labels that may repeat; null without any."""
    out = {}
    for name, pattern in labels.items():
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: money.parse_tolerant(x)), lambda x: x.isNotNull())
        total = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("decimal(28,2)"), lambda a, y: (a + y).cast("decimal(28,2)")).cast(money.MONEY))
        out[name] = _let(found, total) if name in repeated else F.get(found, F.lit(0))
    return out


def loan_header(text: Column) -> Column:
    """What the head of a loan's schedule tells: number, capital, installments, rate and the debt at its date."""
    at = lambda *patterns: first_of(text, list(patterns))
    amount = lambda p: _let(at(p), lambda x: F.when(x.isNotNull(), money.parse_decimal(x)))
    return F.struct(
        at(r"(?i)pr[eé]stamo\s*(?:n[°ro.]*)?\s*:?\s*(\d{4,})").alias("number"),
        amount(r"(?i)capital\s*(?:original)?\s*:\s*\$?\s*([\d.,]+)").alias("capital"),
        at(r"(?i)(?:cuotas|plazo)\s*:\s*(\d+)").try_cast("int").alias("installments"),
        amount(r"(?i)t\.?n\.?a\.?\s*:\s*([\d.,]+)").alias("rate"),
        amount(r"(?i)deuda al \d{2}/\d{2}/\d{4}\s*:\s*\$?\s*([\d.,]+)").alias("debt"),
        dates.parse_date(at(r"(?i)deuda al (\d{2}/\d{2}/\d{4})")).alias("debt_date"),
    )


def schedule_lines(docs: DataFrame, key: str, text: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Installments from lines of number, due date and amounts: the first amount is capital, the second interest, the last what is due; repeated numbers keep the first. ``kept``: columns of the document that its installments keep."""
    line = docs.select(key, *kept, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_at", "_line"))
    head = r"^\s*(\d{1,3})\s+(\d{2}/\d{2}/\d{4})\s+(.+)$"
    part = lambda k: F.regexp_extract("_line", head, k)
    # each step is a projection of its own, so that nothing is worked out twice
    rows = line.where(F.col("_line").rlike(head)).select(key, *kept, "_at", part(1).cast("int").alias("n"), part(2).alias("_due"), part(3).alias("_told"))
    rows = rows.select(key, *kept, "_at", "n", "_due", F.regexp_extract_all("_told", F.lit(r"([\d.]+,\d{2})")).alias("_x"))
    amount = lambda x: F.coalesce(money.money(F.translate(x, ",.", ".").try_cast("decimal(28,8)")), F.lit(0).cast(money.MONEY))
    told = F.struct("_at", dates.parse_date(F.col("_due")).alias("due_date"), amount(F.get("_x", F.lit(0))).alias("capital"), amount(F.get("_x", F.lit(1))).alias("interest"), amount(F.get("_x", F.size("_x") - 1)).alias("due"))
    first = rows.groupBy(key, *kept, "n").agg(F.min(F.when(F.size("_x") >= 3, told)).alias("_r")).where("_r is not null")
    return first.select(key, *kept, "n", "_r.due_date", "_r.capital", "_r.interest", "_r.due")


def by_employee(sheet: DataFrame, concept: str, employees: list[str]) -> DataFrame:
    """(employee, concept, amount) from a payroll sheet with a column per employee; empty cells are left out."""
    return sheet.unpivot(concept, employees, "employee", "amount").where("amount is not null and amount <> 0").select("employee", concept, "amount")


def table_lines(docs: DataFrame, key: str, text: str, header: str, columns: list[str]) -> DataFrame:
    """Rows of a table below its header line: cells parted by two blanks or more or by bars, as many as there are columns; the table ends with a line of TOTAL."""
    from .extract import sections
    from ..functions.text import lines

    told = sections(lines(docs, key, text), [key], "line_no", fold(F.col("line")).rlike(header), fold(F.col("line")).startswith("TOTAL"))
    cells = F.filter(F.transform(F.split(F.trim("line"), r"\s*\|\s*|\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    rows = told.where("in_section").select(key, "line_no", cells.alias("_c")).where(F.size("_c") == len(columns))
    return rows.select(key, "line_no", *[F.get("_c", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def resolved_company(asked: DataFrame, companies: DataFrame, name: str = "name", tax_id: str = "tax_id", database: str = "database", least: float = 70.0, sure: float = 92.0) -> DataFrame:
    """Which company's database is asked for: the one named, else the best name of score ``least`` or more (with another tax id: ``sure`` or more), else the one with the tax id.

    Asked rows have an ``ask`` id; names meet on words they share, and each distinct
    name is scored once, however many rows ask for it.
    """
    from ..functions.similarity import token_set_ratio
    from ..functions.text import fold_words

    dim = companies.select(F.col(name).alias("_name"), F.col(tax_id).alias("_tax"), F.col(database).alias("_db"))
    told, theirs = asked.withColumn("_asked", fold_words(F.col(name))), dim.withColumn("_folded", fold_words(F.col("_name")))
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda x: F.length(x) > 1))).alias("_word")
    each = lambda df, c: stored(df.select(c).where(F.length(c) > 1).distinct())
    mine, known = each(told, "_asked"), each(theirs, "_folded")
    pairs = mine.select("_asked", words(F.col("_asked"))).join(known.select("_folded", words(F.col("_folded"))), "_word").drop("_word").distinct()
    scored = stored(spread(pairs).withColumn("_score", token_set_ratio(F.col("_asked"), F.col("_folded"))).where(F.col("_score") >= least))
    place = F.struct((-F.col("_score")).alias("s"), F.col("_db"))
    good = scored.join(theirs, "_folded")
    # a company without a tax id differs from none
    best = stored(good.groupBy("_asked").agg(F.min(place).alias("_any"), F.min(F.when((F.col("_score") >= sure) | F.col("_tax").isNull(), place)).alias("_sure")))
    same = good.where("_tax is not null").groupBy("_asked", "_tax").agg(F.min(place).alias("_same"))
    by_tax = dim.where("_tax is not null").groupBy("_tax").agg(F.min("_db").alias("_by_tax"))
    out = told.withColumn("_tax", F.col(tax_id)).join(best, "_asked", "left").join(same, ["_asked", "_tax"], "left").join(by_tax, "_tax", "left")
    out = out.withColumn("_by_name", F.when(F.coalesce(F.col(tax_id), F.lit("")) == "", F.col("_any")).otherwise(F.least("_sure", "_same"))["_db"])
    out = out.join(dim.select(F.col("_db").alias("_named")).distinct(), F.col(database) == F.col("_named"), "left")
    by = F.when(F.col("_named").isNotNull(), "database").when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_tax").isNotNull(), "tax_id")
    return out.select(*asked.columns, F.coalesce("_named", "_by_name", "_by_tax").alias("found"), by.alias("by"))


def last_amount(line: Column) -> Column:
    """The last amount of a line, such as 1.234,56 or -12,00; null without one."""
    found = F.regexp_extract_all(line, F.lit(r"(-?\d[\d.]*,\d{2}-?)"), F.lit(1))
    return _let(F.get(found, F.size(found) - 1), lambda x: F.when(x.isNotNull(), money.parse_decimal(F.replace(x, F.lit("-"), F.lit(""))) * F.when(x.contains("-"), -1).otherwise(1)))


def template_sums(docs: DataFrame, key: str, text: str, start: str, end: str, labels: dict[str, str]) -> DataFrame:
    """Per document the sum of the last amounts of lines with each label, between the lines of a template's section."""
    from .extract import column_by_kind, sections
    from ..functions.text import lines

    told = sections(lines(docs, key, text), [key], "line_no", fold(F.col("line")).rlike(start), fold(F.col("line")).rlike(end))
    rows = told.where("in_section").select(key, fold(F.col("line")).alias("_label"), last_amount(F.col("line")).alias("_amount")).where("_amount is not null")
    return column_by_kind(rows, [key], "_label", "_amount", labels)
