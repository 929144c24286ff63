"""Payroll: from a scale or a file to net pay, every step rounded to the cent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, money, percent

# What an agreement's rules are where it does not say.
RATES = {"antiguedadPorAnioPct": 0.01, "jubilacionPct": 0.11, "pamiPct": 0.03, "obraSocialPct": 0.03, "aporteSindicalPct": 0.02}
NUMBERS = {"presentismoDivisor": 12.0, "horasMensuales": 200.0, "horasExtras50Multiplicador": 1.5, "diasMes": 30.0}


def _rate(rules: Column, key: str) -> Column:
    return percent(F.element_at(rules, F.lit(key)), RATES[key])


def _number(rules: Column, key: str) -> Column:
    value = F.element_at(rules, F.lit(key)).try_cast("decimal(18,6)")
    return F.when(value > 0, value).otherwise(F.lit(NUMBERS[key]).cast("decimal(18,6)"))


def payroll(rows: DataFrame) -> DataFrame:
    """Rows: base_scale and base_file (decimals, may be null), years, absences, overtime, extra, rules (map<string,string>).

    Adds base, seniority, attendance, hour, overtime_pay, absence_cut, gross,
    other, four deductions, deductions, net and the array ``concepts`` of what is
    not zero. The scale decides, then the file.
    """
    rules = F.col("rules")
    zero = F.lit(0).cast(MONEY)
    out = rows.withColumn("base", money(F.coalesce("base_scale", F.when(F.col("base_file") > 0, F.col("base_file")), zero)))
    out = out.withColumn("absences", F.greatest(F.lit(0), F.coalesce("absences", F.lit(0))))
    out = out.withColumn("seniority", money(F.col("base") * F.coalesce("years", F.lit(0)).cast("decimal(9,0)") * _rate(rules, "antiguedadPorAnioPct")))
    total = (F.col("base") + F.col("seniority")).cast(MONEY)
    out = out.withColumn("attendance", F.when(F.col("absences") == 0, money(total / _number(rules, "presentismoDivisor"))).otherwise(zero))
    out = out.withColumn("hour", money(total / _number(rules, "horasMensuales")))
    hours = F.greatest(F.lit(0).cast("decimal(9,2)"), F.coalesce("overtime", F.lit(0)).cast("decimal(9,2)"))
    out = out.withColumn("overtime_pay", money(F.col("hour") * _number(rules, "horasExtras50Multiplicador").cast("decimal(9,4)") * hours))
    out = out.withColumn("absence_cut", money(total * F.col("absences").cast("decimal(9,0)") / _number(rules, "diasMes")))
    out = out.withColumn("gross", (F.col("base") + F.col("seniority") + F.col("attendance") + F.col("overtime_pay") - F.col("absence_cut")).cast(MONEY))
    out = out.withColumn("other", money(F.greatest(zero, F.coalesce("extra", zero))))
    names = {"pension": "jubilacionPct", "health_fund": "pamiPct", "insurance": "obraSocialPct", "union_fee": "aporteSindicalPct"}
    for name, key in names.items():
        out = out.withColumn(name, money(F.col("gross") * _rate(rules, key)))
    out = out.withColumn("deductions", sum((F.col(n) for n in names), zero).cast(MONEY))
    out = out.withColumn("net", (F.col("gross") + F.col("other") - F.col("deductions")).cast(MONEY))
    listed = ["base", "seniority", "attendance", "overtime_pay", "absence_cut", "other", *names]
    concepts = F.array(*[F.struct(F.lit(n).alias("concept"), F.col(n).alias("amount")) for n in listed])
    return out.withColumn("concepts", F.filter(concepts, lambda x: x["amount"] != 0))
