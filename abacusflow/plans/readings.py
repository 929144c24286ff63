"""Queries that write forms, lines and names from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import text as T
from ..functions.money import MONEY
from ..operators import currency, extract, fiscal, readings, rules, vouchers
from ..sources.tables import spread
from .inputs import read
from .registry import query


def _one_of(texts: list, by: Column) -> Column:
    return F.get(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), by.cast("int"))


def _written(amount: Column) -> Column:
    """An amount as statements write it: 1.234,56."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


@query("select o_orderkey, case when o_orderkey % 6 < 5 then cast(o_orderdate as date) end as day, case when o_orderkey % 6 in (0, 1, 2, 4) then case when year(o_orderdate) between 2000 and 2040 then cast(o_orderdate as date) end end as in_line from orders")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in six ways, read as dates of a cell and as dates within a line; the last way is no date."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    way, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    f = lambda x: F.date_format(day, x)
    text = _one_of([f("dd/MM/yyyy"), f("yyyy-MM-dd"), f("dd-MM-yyyy"), f("d.M.yyyy"), f("dd/MM/yyyy"), f("yyyy-MM 99")], way)
    cell = F.when(way == 3, f("dd.MM.yyyy")).when(way == 4, F.datediff(day, F.lit("1899-12-30")).cast("string")).otherwise(text)
    return o.select("o_orderkey", dates.parse_date(cell).alias("day"), readings.date_in_line(F.concat(F.lit("pago "), text, F.lit(" 12,50"))).alias("in_line"))


@query(
    """
with o as (select o_orderkey, cast(o_orderdate + interval 10 year as date) as day from orders)
select o_orderkey, cast(date_trunc('month', day) as date) as period, strftime(day, '%m/%Y') as label, case when o_orderkey % 2 = 0 then cast(date_trunc('month', day) as date) else make_date(year(day), 4, 1) end as counted from o"""
)
def periods_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods written in three ways, their labels, and the month that a label below a movement moves it to."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    day = F.add_months(F.col("o_orderdate").cast("date"), 120)
    f = lambda x: F.date_format(day, x)
    text = F.concat(F.lit("período "), _one_of([f("yyyyMM"), f("MM/yyyy"), f("yyyy-MM")], F.col("o_orderkey") % 3), F.lit("."))
    below = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("Abril "), F.year(day).cast("string"))).otherwise("comisión mensual")
    period = dates.parse_period(text)
    return o.select("o_orderkey", period.alias("period"), dates.period_label(period).alias("label"), readings.month_of(day, below).alias("counted"))


@query(
    """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, cast(l_extendedprice as decimal(18,2)) as x, cast(l_quantity as decimal(18,2)) as q, l_orderkey % 3 as w from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, cast(q as double) as units, cast(case when w = 0 then 3.5 when w = 1 then cast((2 * cast(x * 100 as hugeint) * 1000000 + cast(q * 100 as hugeint)) // (2 * cast(q * 100 as hugeint)) as double) / 1000000 else 1.25 end as double) as price,
  cast(case when w = 2 then cast(round(q * 1.25, 2) as decimal(18,2)) else x end as double) as amount from l where w <> 1 or x > q * 2"""
)
def movement_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, price and amount of lines that tell three numbers, units and amount, or units and price, beside a year."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    way, q, x = F.col("l_orderkey") % 3, F.col("l_quantity").cast(MONEY), F.col("l_extendedprice").cast(MONEY)
    rows = rows.where((way != 1) | (x > q * 2))
    text = F.concat(F.lit(" Compra 2024 "), _written(q), F.lit(" "), F.when(way == 0, F.concat(F.lit("3,50 "), _written(x))).when(way == 1, _written(x)).otherwise("1,25"))
    told = readings.movement_numbers(text)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", told["units"].cast("double").alias("units"), told["price"].cast("double").alias("price"), told["amount"].cast("double").alias("amount"))


@query(
    """
select o_orderkey, case when o_orderkey % 3 = 0 then 'Nota de Crédito C' else 'Factura C' end as kind, case when o_orderkey % 3 = 0 then '013' else '011' end as code, format('{:05d}-{:08d}', o_orderkey % 90 + 1, o_orderkey + 1) as voucher,
  cast(o_orderdate as date) as issued, cast(date_trunc('month', o_orderdate) as date) as period_from, cast(last_day(o_orderdate) as date) as period_to, '2 - Servicios' as concept,
  cast(case when o_orderkey % 3 = 0 then -1 else 1 end * cast(o_totalprice as decimal(18,2)) as double) as total, lpad(cast(o_orderkey as varchar), 14, '7') as cae from orders"""
)
def invoice_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of invoice and credit note forms."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    note, key, day = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda c: F.date_format(c, "dd/MM/yyyy")
    form = F.concat(
        F.when(note, "  NOTA DE CREDITO C\n  Codigo: 013\n").otherwise("  FACTURA C\n  Codigo: 011\n"), F.lit("  Fecha de Emisión: "), f(day), F.lit("\n  Punto de Venta: "), (key % 90 + 1).cast("string"), F.lit("\n  Comp. Nro: "), (key + 1).cast("string"),
        F.lit("\n  Concepto: 2 - Servicios\n  Período Facturado Desde: "), f(F.trunc(day, "MM")), F.lit(" Hasta: "), f(F.last_day(day)), F.lit("\n  Importe Total: $ "), _written(F.col("o_totalprice").cast(MONEY)), F.lit("\n  CAE: "), F.lpad(key.cast("string"), 14, "7"),
    )
    out = o.select("o_orderkey", readings.invoice_form(form).alias("f")).select("o_orderkey", "f.*")
    return out.withColumn("total", F.col("total").cast("double"))


@query(
    """
select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as double) as fees, case when o_orderkey % 4 > 0 then cast(cast((o_orderkey % 4) * (o_orderkey % 100 + 0.5) as decimal(18,2)) as double) end as rights, case when o_orderkey % 2 = 0 then -12.75 end as withheld from orders"""
)
def sheet_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts of a fee sheet by concept; administrative rights may come several times and add up."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    right = F.concat(F.lit("Derecho administrativo: "), F.format_string("%.2f", (F.col("o_orderkey") % 100).cast("double") + 0.5), F.lit("\n"))
    text = F.concat(F.lit("Honorarios: "), F.format_number(F.col("o_totalprice"), 2), F.lit("\nHonorarios: 1.00\n"), F.repeat(right, (F.col("o_orderkey") % 4).cast("int")), F.when(F.col("o_orderkey") % 2 == 0, "Retencion: (12.75)").otherwise(""))
    labels = {"fees": r"Honorarios:\s*([\d.,()-]+)", "rights": r"Derecho administrativo:\s*([\d.,()-]+)", "withheld": r"Retencion:\s*([\d.,()-]+)"}
    found = readings.labelled_amounts(text, labels, ("rights",))
    return o.select("o_orderkey", *[c.cast("double").alias(n) for n, c in found.items()])


_PART = "cast(p_retailprice as decimal(18,2))"


@query(
    f"""
with r as (select *, unnest(range(1, p_size + 1)) as n from part)
select p_partkey, cast(n as integer) as n, cast(date '2024-01-01' + to_months(cast(n - 1 as integer)) as date) as due_date, cast({_PART} + n as double) as capital, cast(n + 0.25 as double) as interest, cast({_PART} + 2 * n + 0.25 as double) as due,
  cast(p_partkey + 1000 as varchar) as loan, cast({_PART} as double) as debt from r"""
)
def loan_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installments and header of loan sheets; each sheet repeats its first line and has a page footer."""
    p = spread(read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")).withColumn("c", F.col("p_retailprice").cast(MONEY))
    row = lambda n: F.concat(n.cast("string"), F.lit("  "), F.date_format(F.add_months(F.lit("2024-01-01").cast("date"), n - 1), "dd/MM/yyyy"), F.lit(" "), _written(F.col("c") + n.cast(MONEY)), F.lit(" "), _written(n.cast(MONEY) + F.lit("0.25").cast(MONEY)), F.lit(" 0,00 "), _written(F.col("c") + (2 * n).cast(MONEY) + F.lit("0.25").cast(MONEY)))
    head = F.concat(F.lit("Préstamo N°: "), (F.col("p_partkey") + 1000).cast("string"), F.lit("\nCapital: $ "), _written(F.col("c")), F.lit("\nDeuda al 31/12/2024: $ "), _written(F.col("c")), F.lit("\nCuota Vencimiento Capital Interes Seguro Total\n"))
    text = F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), "p_size"), row), "\n"), F.lit("\nPágina 1 de 2\n"), row(F.lit(1)))
    docs = p.where("p_size > 0").select("p_partkey", text.alias("text"))
    headed = docs.select("p_partkey", "text", readings.loan_header(F.col("text")).alias("h")).select("p_partkey", "text", F.col("h.number").alias("loan"), F.col("h.debt").cast("double").alias("debt"))
    out = readings.schedule_lines(headed, "p_partkey", "text", ("loan", "debt"))
    return out.select("p_partkey", "n", "due_date", *[F.col(c).cast("double").alias(c) for c in ("capital", "interest", "due")], "loan", "debt")


@query(
    """
select n_nationkey as doc, 3 + k as line_no, format('2{:010d}', n_nationkey * 7 + k) as tax_id, 'Afiliado ' || cast(k as varchar) as name, cast(n_nationkey * 10 + k as double) as amount from (select n_nationkey, unnest(range(0, 1 + n_nationkey % 4)) as k from nation)"""
)
def dues_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and amounts of union dues from the table between its header and its total."""
    n = read(spark, sf_dir, "nation", "n_nationkey")
    row = lambda k: F.concat(F.format_string("2%010d", F.col("n_nationkey") * 7 + k), F.when(k % 2 == 0, "   ").otherwise(" | "), F.lit("Afiliado "), k.cast("string"), F.lit("    "), _written((F.col("n_nationkey") * 10 + k).cast(MONEY)))
    text = F.concat(F.lit("Sindicato\n\nCUIL   Nombre   Importe\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 4), row), "\n"), F.lit("\nTOTAL   x   9,00\n20123456789   Otro   1,00"))
    out = readings.table_lines(n.select(F.col("n_nationkey").alias("doc"), text.alias("text")), "doc", "text", "^CUIL .*IMPORTE", ["tax_id", "name", "amount"])
    return out.select("doc", F.col("line_no").cast("long").alias("line_no"), "tax_id", "name", money.parse_decimal(F.col("amount")).cast("double").alias("amount"))


@query(
    """
with g as (select o_orderstatus as employee, o_orderpriority as concept, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders where o_orderkey % 10 > 0 or o_orderstatus <> 'P' group by all)
select * from g where amount <> 0"""
)
def payroll_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payroll sheet with a column per employee as a row per employee and concept."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").where("o_orderkey % 10 > 0 or o_orderstatus <> 'P'")
    sheet = o.groupBy(F.col("o_orderpriority").alias("concept")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum(F.col("o_totalprice").cast(MONEY)))
    return readings.by_employee(sheet, "concept", ["F", "O", "P"]).withColumn("amount", F.col("amount").cast("double"))


@query(
    """
select c_custkey, case when c_custkey % 4 in (0, 1) then 'juridica' else 'fisica' end as person, case when c_custkey % 3 = 0 then format('{:013d}', c_custkey + 4000) else cast(c_custkey + 100000 as varchar) end as account,
  case when c_custkey % 2 = 0 then '20111111112' else '30222222223' end as issuer, case when c_custkey % 2 = 0 then '30222222223' else '20111111112' end as receiver, c_custkey % 5 < 3 as near,
  case when c_custkey % 3 = 0 then cast(c_custkey + 7 as varchar) else '' end as payment, 'Hoja ' || cast(c_custkey as varchar) as sheet, 'customer ' || lpad(cast(c_custkey as varchar), 9, '0') as folded from customer"""
    .replace("'customer ' || lpad(cast(c_custkey as varchar), 9, '0') as folded", "'CUSTOMER ' || lpad(cast(c_custkey as varchar), 9, '0') as folded")
)
def names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of persons, accounts, issuers and receivers, near-equal ids, payment numbers, safe and folded names, from written texts."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    key = F.col("c_custkey")
    name = F.concat(F.col("c_name"), _one_of([" S.A.", " SRL", " Gómez", ""], key % 4))
    code = F.concat(F.lit("00700001"), F.lpad((key + 4000).cast("string"), 13, "0"), F.lit("9"))
    account = T.account_in(F.when(key % 3 == 0, F.concat(F.lit("CBU "), code, F.lit(" x"))).otherwise("sin datos"), F.concat(F.lit("/in/12345/cuenta_"), (key + 100000).cast("string"), F.lit(".pdf")))
    ids = T.issuer_and_receiver(F.lit("Emite 20-11111111-2 a 30-22222222-3, 00000000000"), F.when(key % 2 == 0, "30222222223").otherwise("20111111112"))
    near = T.near_equal_id(F.lit("20111111112"), _one_of(["20111111112", "20111111113", "", "20111111123", "2011111111"], key % 5))
    payment = T.payment_number(F.when(key % 3 == 0, F.concat(F.lit("pago vep "), (key + 7).cast("string"), F.lit(" x"))).otherwise("pago 55"))
    folded = T.fold(F.concat(F.lit(" cústömer  "), F.lpad(key.cast("string"), 9, "0"), F.lit("\t")))
    return c.select("c_custkey", T.person_type(name).alias("person"), account.alias("account"), ids["issuer"].alias("issuer"), ids["receiver"].alias("receiver"), near.alias("near"), payment.alias("payment"), T.safe_name(F.concat(F.lit("Hoja/"), key.cast("string"), F.lit("?"))).alias("sheet"), folded.alias("folded"))


@query(
    """
select o_orderkey, format('{:011d}', o_custkey) as tax_id, format('{:03d}', o_orderkey % 200) as kind, format('{:05d}-{:08d}', o_custkey % 100000, o_orderkey) as voucher, cast(o_orderdate as date) as day,
  ['10,5%', '21%', '27%', '2,5%'][1 + o_orderkey % 4] as rate, ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(o_orderdate)] as month,
  greatest(0, 2001 - year(o_orderdate) - case when strftime(o_orderdate, '%m%d') > '0615' then 1 else 0 end) as years from orders"""
)
def file_names_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names tell, the issue date in a text with other dates, rate labels, month names and whole years."""
    o = spread(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    told = T.from_file_name(F.concat(F.format_string("%011d", "o_custkey"), F.lit("_"), F.format_string("%03d", key % 200), F.lit("_"), (F.col("o_custkey") % 100000).cast("string"), F.lit("_"), key.cast("string"), F.lit(".pdf")))
    text = F.concat(F.lit("Inicio de actividades: 01/02/1990\nDomicilio comercial: calle larga y sin número 1234\nFecha: "), F.date_format(day, "dd/MM/yyyy"), F.lit(" Vto 03/03/2003"))
    rate = _one_of([10.5, 21.0, 27.0, 2.5], key % 4)
    return o.select("o_orderkey", told["tax_id"].alias("tax_id"), told["kind"].alias("kind"), told["voucher"].alias("voucher"), T.date_in(text).alias("day"), money.rate_label(rate).alias("rate"), dates.month_name(day).alias("month"), dates.whole_years(day, F.lit("2001-06-15").cast("date")).cast("long").alias("years"))


@query(
    """
select event_id, ['Rescate', 'Suscripcion', 'Venta', 'Compra', 'Movimiento'][1 + event_id % 5] as operation, cast(case when event_id % 2 = 0 then value else 0 end as double) as debit, cast(case when event_id % 2 = 0 then 0 else value end as double) as credit,
  case when event_id % 3 = 0 then 'tarjeta' when event_id % 3 = 1 then 'banco' else 'otro' end as issuer, case when event_id % 3 = 2 then 'bancario' else 'fisico' end as pocket, case when event_id % 4 = 2 or (event_id % 4 = 0 and event_id % 3 > 0) then 'egreso' else 'ingreso' end as direction,
  event_id % 5 > 0 as plausible, cast(greatest(0, event_id % 20 - 10) as double) as levy from (select event_id, cast(cast(value as decimal(18,2)) as double) as value from events)"""
)
def statement_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of statements tell: operation, side, issuer, pocket and direction of dollars, plausible rows and clipped levies."""
    e = read(spark, sf_dir, "events", "event_id", "value")
    key, value = F.col("event_id"), F.col("value").cast(MONEY)
    operation = vouchers.operation_kind(_one_of(["RESCATE parcial", "suscripción fci", "", None, " "], key % 5), F.when(key % 5 == 3, 1), F.when(key % 5 == 2, -1))
    debit, credit = rules.debit_credit(value, F.when(key % 2 == 0, "N/DEB").otherwise("crédito CRED"), F.lit(None).cast(MONEY), F.lit(None).cast(MONEY))
    issuer = rules.most_hits(_one_of(["Liquidación VISA cupones", "Extracto de cuenta, saldo", "nada"], key % 3), {"tarjeta": ("VISA", "CUPONES"), "banco": ("EXTRACTO", "SALDO", "VISA")}, "otro")
    pocket = currency.pocket_of(_one_of(["en efectivo", "Billetes", "cuenta caja de ahorro"], key % 3))
    direction = currency.direction_of(_one_of([None, "Compra", "VENTA", "crédito"], key % 4), _one_of(["Rescate FCI", "Suscripción FCI", "Depósito en efectivo"], key % 3))
    plausible = F.coalesce(extract.first_of(_one_of(["", "cuota 1", "n 2 x", "cuota 3", "n 4"], key % 5), [r"cuota (\d)", r"n (\d)"]).isNotNull(), F.lit(False))
    levy, _ = fiscal.closing_difference((key % 20).cast(MONEY), F.lit(7).cast(MONEY), [F.lit(3).cast(MONEY), F.lit(None).cast(MONEY)], F.lit(None).cast(MONEY))
    return e.select("event_id", operation.alias("operation"), debit.cast("double").alias("debit"), credit.cast("double").alias("credit"), issuer.alias("issuer"), pocket.alias("pocket"), direction.alias("direction"), plausible.alias("plausible"), levy.cast("double").alias("levy"))


@query("select c_custkey as ask, case when c_custkey % 4 = 3 then 'db' || cast((c_custkey + 1) % 100 as varchar) when c_custkey % 4 = 2 then 'db' || cast(c_custkey % 100 as varchar) when c_custkey % 4 = 1 then 'db' || cast(c_custkey % 100 as varchar) else 'db' || cast(c_custkey % 100 as varchar) end as found, ['database', 'name', 'tax_id', 'database'][1 + c_custkey % 4] as by from customer".replace(" as by from", ' as "by" from'))
def company_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which company is asked for: by its database, by a name much like its own, or by its tax id."""
    c = read(spark, sf_dir, "customer", "c_custkey")
    names = ["Norte", "Sur", "Este", "Oeste", "Centro", "Litoral", "Pampa", "Andes", "Delta", "Costa"]
    kinds = ["Molinos", "Aceros", "Viajes", "Textil", "Papel", "Granos", "Lacteos", "Vidrios", "Motores", "Libros"]
    name = lambda k: F.concat(_one_of(kinds, (k / 10).cast("int")), F.lit(" del "), _one_of(names, k % 10))
    dim = spark.range(100).select(F.concat(name(F.col("id")), F.lit(" S.A.")).alias("name"), F.format_string("30%09d", "id").alias("tax_id"), F.concat(F.lit("db"), F.col("id").cast("string")).alias("database"))
    k, way = F.col("c_custkey") % 100, F.col("c_custkey") % 4
    asked = c.select(
        F.col("c_custkey").alias("ask"),
        F.when(way == 1, F.concat(F.upper(name(k)), F.lit(" sa"))).when(way == 2, "zzz").otherwise(name((k + 5) % 100)).alias("name"),
        F.when(way == 2, F.format_string("30%09d", k)).otherwise("").alias("tax_id"),
        F.when(way == 0, F.concat(F.lit("db"), k.cast("string"))).when(way == 3, F.concat(F.lit("db"), ((k + 1) % 100).cast("string"))).alias("database"),
    )
    return readings.resolved_company(asked, dim).select("ask", "found", "by")


@query(
    """
select s_suppkey, cast(cast(abs(s_acctbal) as decimal(18,2)) + 2.5 as double) as fees, cast(case when s_suppkey % 2 = 0 then -10.25 end as double) as vat, 7.0::double as other, 1 as unknown from supplier"""
)
def card_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees and VAT of card summaries: the last amounts of labelled lines of one section."""
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")
    vat = F.when(F.col("s_suppkey") % 2 == 0, "IVA 21% 10,25-\n").otherwise("")
    text = F.concat(F.lit("RESUMEN\nComisión 99,00\nDetalle de cargos\nComisión 1,00 "), _written(F.abs(F.col("s_acctbal")).cast(MONEY)), F.lit("\nComisión plus 2,50\n"), vat, F.lit("sin importe\nCargo extra 7,00\nTotal de cargos 12,00\nIVA 5,00"))
    out = readings.template_sums(s.select("s_suppkey", text.alias("text")), "s_suppkey", "text", "^DETALLE DE CARGOS", "^TOTAL", {"fees": "^COMISION", "vat": "^IVA"})
    return out.select("s_suppkey", *[F.col(c).cast("double").alias(c) for c in ("fees", "vat", "other")], F.col("unknown").cast("int").alias("unknown"))
