"""Queries on invoices, payments and obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import within_days_or_month
from ..functions.money import MONEY
from ..operators import asof, matching, proration, reports, strips
from ..sources.tables import seeded, upserted
from .inputs import read
from .registry import greedy_sql, query


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice, customer, amount, day, supplier name, status."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    rows = o.join(matching.apart(c), o["o_custkey"] == c["c_custkey"])
    return rows.select(F.col("o_orderkey").alias("invoice"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderdate").cast("date").alias("day"), F.col("c_name").alias("name"), F.col("o_orderstatus").alias("status"))


def debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debit for every invoice that is not pending: some days later, some cents off, with the payee in its text."""
    i = invoices(spark, sf_dir).where("status <> 'P'")
    text = F.concat(F.lit("TRF INMED PROVEED / "), F.col("name"), F.lit(" / 00"))
    return i.select(
        (F.col("invoice") * 10 + 1).alias("debit"),
        F.col("customer"),
        (F.col("amount") + ((F.col("invoice") % 7) / 10).cast(MONEY)).cast(MONEY).alias("paid"),
        F.date_add("day", (F.col("invoice") % 5).cast("int") - 1).alias("paid_day"),
        text.alias("text"),
    )


_INVOICES = """inv as (select o_orderkey as invoice, o_custkey as customer, cast(o_totalprice as decimal(18,2)) as amount, cast(o_orderdate as date) as day, o_orderstatus as status from orders join customer on o_custkey = c_custkey),
deb as (select invoice * 10 + 1 as debit, customer, cast(amount + cast((invoice % 7) / 10.0 as decimal(18,2)) as decimal(18,2)) as paid, day + cast(invoice % 5 - 1 as integer) as paid_day from inv where status <> 'P')"""


def by_name(paid: DataFrame, owed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Debits and invoices as ``strips`` takes them: id, amount, day and the folded name, which a debit has in its text."""
    left = paid.select(F.col("debit").alias("id"), F.col("paid").alias("amount"), F.col("paid_day").alias("day"), T.fold(T.second_field(F.col("text"))).alias("name"))
    return left, owed.select(F.col("invoice").alias("id"), "amount", "day", T.fold(F.col("name")).alias("name"))


@query()
def invoice_match_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits in order of date and id, each with its best invoice by name (55 at least) within 1.00, not invoiced later than two days after payment, that no earlier debit took."""
    taken = strips.settled(*by_name(debits(spark, sf_dir), invoices(spark, sf_dir)), 1.0, strips.by_day(55.0, 2))
    return taken.select(F.col("l").alias("debit"), F.col("r").alias("invoice"), F.round("tag", 6).alias("score"))


@query(
    f"""
with {_INVOICES},
pair as (select debit, invoice, abs(amount - paid) as off from deb join inv on abs(amount - paid) <= 1 and abs(date_diff('day', day, paid_day)) <= 3)
select debit, arg_min(invoice, (off, invoice)) as invoice, cast(min(off) as double) as off from pair group by debit""".replace("arg_min(invoice, (off, invoice))", "arg_min(invoice, off * 100000000000 + invoice)")
)
def tax_payment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every debit's closest payment within 1.00 and 3 days; a payment may serve several debits."""
    pairs = matching.amount_band(debits(spark, sf_dir), invoices(spark, sf_dir).drop("customer"), "paid", "amount", 1.0)
    pairs = pairs.where(F.abs(F.datediff("paid_day", "day")) <= 3).withColumn("off", F.abs(F.col("amount") - F.col("paid")))
    return matching.best_of(pairs, "debit", [F.col("off"), F.col("invoice")], ["invoice", "off"]).select("debit", "invoice", F.col("off").cast("double").alias("off"))


def _level(k: int, keys: list[tuple[str, str]]) -> str:
    """The pairs of a level of the cascade: both sides ranked within their key, among what earlier levels left."""
    mine, theirs = ", ".join(x for x, _ in keys), ", ".join(y for _, y in keys)
    left = lambda own: "".join(f" and {own} not in (select {own} from l{j})" for j in range(k))
    on = " and ".join(f"a.{x} = b.{y}" for x, y in keys)
    return (
        f"l{k} as (select debit, invoice, {k} as level from (select *, row_number() over (partition by {mine} order by debit) as n from deb where true{left('debit')}) a "
        f"join (select *, row_number() over (partition by {theirs} order by invoice) as n from inv where true{left('invoice')}) b on {on} and a.n = b.n)"
    )


_LEVELS = [[("customer", "customer"), ("paid_day", "day"), ("paid", "amount")], [("customer", "customer"), ("paid", "amount")], [("customer", "customer"), ("paid_day", "day")]]


@query(
    f"""
with {_INVOICES},
d as (select *, case when debit % 3 = 0 then (debit - 1) // 10 + 1 end as number from deb),
c as (select d.debit, i.invoice, 0 as rank, abs(amount - paid) as off, 0::decimal(18,2) as o from d join inv i on i.invoice = d.number
  union all select debit, invoice, 1, abs(amount - paid), abs(amount - paid) from d join inv on abs(amount - paid) <= 1 and abs(date_diff('day', day, paid_day)) <= 3)
select debit, invoice, case rank when 0 then 'number' else 'amount' end as by_what, cast(off as double) as off from (select *, row_number() over (partition by debit order by rank, o, invoice) as k from c) where k = 1"""
)
def tax_payment_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every debit's payment: the one with the number in its text, whatever its amount and day, else the closest within 1.00 and 3 days."""
    d = debits(spark, sf_dir).drop("customer").withColumn("text", F.when(F.col("debit") % 3 == 0, F.concat(F.lit("Pago VEP "), F.expr("(debit - 1) div 10 + 1").cast("string"))).otherwise("Pago"))
    d = d.withColumn("number", T.payment_number(F.col("text")))
    right = invoices(spark, sf_dir).select("invoice", "amount", "day", F.col("invoice").cast("string").alias("payment"))
    out = matching.payment_match(d, right, "debit", "invoice", "number", "payment", "paid", "amount", "paid_day", "day")
    return out.select("debit", "invoice", F.col("by").alias("by_what"), F.col("off").cast("double").alias("off"))


@query(f"with {_INVOICES}, " + ", ".join(_level(k, keys) for k, keys in enumerate(_LEVELS)) + " select * from l0 union all select * from l1 union all select * from l2")
def cascade_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits and invoices on the first key they share: customer, day and amount; customer and amount; customer and day. One to one."""
    columns = lambda side: [[F.col(pair[side]) for pair in keys] for keys in _LEVELS]
    return matching.cascade(debits(spark, sf_dir), invoices(spark, sf_dir), "debit", "invoice", columns(0), columns(1))


@query(
    f"""
with recursive {_INVOICES},
near as (select inv.customer, invoice, debit, abs(date_diff('day', day, paid_day)) as days, abs(amount - paid) as off from inv join deb on inv.customer = deb.customer and abs(amount - paid) <= 1
  where abs(date_diff('day', day, paid_day)) <= 7 or date_trunc('month', day) = date_trunc('month', paid_day)),
{greedy_sql('took', 'near', 'customer', 'invoice', 'debit', 'days, off, ')}
select inv.invoice, took.debit, case when took.debit is null then 'FALTA' when off = 0 then 'PAGADO' else 'PARCIAL' end as state from inv left join took on took.invoice = inv.invoice"""
)
def obligation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations and debits of a customer within 1.00 and 7 days or the same month, closest days first, one to one; states of all obligations."""
    left, right = invoices(spark, sf_dir), debits(spark, sf_dir)
    pairs = matching.amount_band(left, right, "amount", "paid", 1.0, ["customer"]).where(within_days_or_month(F.col("day"), F.col("paid_day")))
    pairs = pairs.select("invoice", "debit", F.abs(F.datediff("day", "paid_day")).alias("days"), F.abs(F.col("amount") - F.col("paid")).alias("off"))
    taken = matching.one_to_one(pairs, "invoice", "debit", [F.col("days"), F.col("off")])
    state = F.when(F.col("debit").isNull(), "FALTA").when(F.col("off") == 0, "PAGADO").otherwise("PARCIAL")
    return left.select("invoice").join(taken.select("invoice", "debit", "off"), "invoice", "left").select("invoice", "debit", state.alias("state"))


@query(
    f"""
with {_INVOICES},
k as (select distinct customer, day from inv)
select 'invoice_without_debit' as side, invoice as id from inv where not exists (select 1 from deb where deb.customer = inv.customer and deb.paid = inv.amount)
union all select 'debit_without_invoice', debit from deb where not exists (select 1 from inv where deb.customer = inv.customer and deb.paid = inv.amount)"""
)
def missing_on_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = invoices(spark, sf_dir), debits(spark, sf_dir).withColumn("amount", F.col("paid"))
    one = left.join(right.select("customer", "amount"), ["customer", "amount"], "left_anti").select(F.lit("invoice_without_debit").alias("side"), F.col("invoice").alias("id"))
    two = right.join(left.select("customer", "amount"), ["customer", "amount"], "left_anti").select(F.lit("debit_without_invoice").alias("side"), F.col("debit").alias("id"))
    return one.unionByName(two)


@query(
    """
with q as (select cast(date_trunc('week', o_orderdate) as date) as day, cast(max(cast(o_totalprice as decimal(18,2))) as double) as rate from orders group by 1),
p as (select l_orderkey, l_linenumber, l_partkey, l_quantity, cast(l_shipdate as date) as day from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_quantity, p.day, coalesce(q.rate, (select arg_min(rate, day) from q)) as rate from p asof left join q on p.day >= q.day"""
)
def fx_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line the rate in force on its day; a week's quote is its top order, dated Monday."""
    o = read(spark, sf_dir, "orders", "o_totalprice", "o_orderdate")
    quotes = o.select(F.date_trunc("week", "o_orderdate").cast("date").alias("quoted"), F.col("o_totalprice").cast(MONEY).cast("double").alias("rate"))
    probes = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate").withColumn("day", F.col("l_shipdate").cast("date")).drop("l_shipdate")
    return asof.asof(probes, quotes, "day", "quoted", "rate", name="rate").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "day", "rate")


_LINES = """ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, amount, l_shipdate) as k from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_tax, l_returnflag, cast(l_extendedprice as decimal(18,2)) as amount from lineitem))"""
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "amount", "l_shipdate"]


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_tax", "l_returnflag", "l_extendedprice")
    return rows.withColumn("amount", F.col("l_extendedprice").cast(MONEY)).drop("l_extendedprice")


@query(
    f"""
with {_LINES},
s as (select *, sum(amount) over (partition by l_orderkey) as total, max(k) over (partition by l_orderkey) as last from ln),
c as (select *, cast(round(amount - cast(amount as decimal(28,10)) * 100 / total, 2) as decimal(18,2)) as part from (select *, cast(amount as decimal(28,10)) as wide from s)),
d as (select *, sum(part) over (partition by l_orderkey) as done from c)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, cast(amount as double) as amount, cast(part + case when k = last then total - 100 - done else 0 end as double) as net from d"""
)
def discount_prorate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discount of 100 on each invoice, spread over its lines to the cent; the last line takes what rounding leaves."""
    rows = invoice_lines(spark, sf_dir).withColumn("discount", F.lit(100).cast(MONEY))
    done = proration.discounted(rows, ["l_orderkey"], _LINE_ORDER, "amount", "discount")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", *[F.col(c).cast("double").alias(c) for c in ("amount", "net")])


@query(
    """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, cast(net as double) as net, cast(vat as double) as vat, cast(net + vat as double) as total from (
  select *, case when l_returnflag = 'A' then amount - net else cast(round(amount * rate, 2) as decimal(18,2)) end as vat from (
    select *, case when l_returnflag = 'A' then cast(round(cast(amount as decimal(28,12)) / (1 + rate), 2) as decimal(18,2)) else amount end as net from (
      select *, cast(l_extendedprice as decimal(18,2)) as amount, cast(case when l_tax = 0 then 0.105 else 0.21 end as decimal(9,4)) as rate from lineitem)))"""
)
def invoice_vat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net, tax and total of every line; lines returned hold the tax in their amount."""
    rows = invoice_lines(spark, sf_dir)
    rate = F.when(F.col("l_tax") == 0, 10.5).otherwise(21.0)
    net, vat, total = proration.vat_split(F.col("amount"), rate, F.col("l_returnflag") == "A")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", *[c.cast("double").alias(n) for n, c in (("net", net), ("vat", vat), ("total", total))])


@query(
    """
with a as (select o_custkey as customer, date_trunc('month', o_orderdate) as m, sum(cast(o_totalprice as decimal(18,2))) as v from orders where o_orderstatus <> 'F' group by all),
b as (select o_custkey as customer, date_trunc('month', o_orderdate) as m, sum(cast(o_totalprice as decimal(18,2))) as v from orders where o_orderstatus <> 'O' group by all),
e as (select customer, min(m) as x, max(m) as y from (select * from a union all select * from b) group by customer),
s as (select customer, unnest(generate_series(x, y, interval 1 month)) as m from e)
select customer, cast(s.m as date) as period, cast(a.v as double) as one, cast(b.v as double) as two,
  case when a.v is null and b.v is null then 'MISSING_BOTH' when a.v is null then 'MISSING_ONE' when b.v is null then 'MISSING_TWO' when abs(a.v - b.v) <= 1 then 'OK' else 'ERROR' end as state
from s left join a using (customer, m) left join b using (customer, m)"""
)
def period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extracts of the orders of each customer, month by month."""
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderdate")
    rows = o.select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast(MONEY).alias("v"), "o_orderstatus")
    out = reports.compare_periods(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderstatus <> 'O'"), ["customer"], "day", "v")
    return out.select("customer", "period", F.col("one").cast("double").alias("one"), F.col("two").cast("double").alias("two"), "state")


@query(
    """
with old as (select o_orderkey as k, o_custkey as v from orders where o_orderstatus <> 'P'), new as (select o_orderkey as k, -o_custkey as v from orders where o_orderpriority < '3'), seed as (select o_orderkey as k, 0 as v from orders)
, up as (select * from new union all select * from old where k not in (select k from new))
select * from up union all select k, v from seed where k not in (select k from up)"""
)
def upsert_and_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    pairs = lambda rows, v: rows.select(F.col("o_orderkey").alias("k"), v.cast("long").alias("v"))
    merged = upserted(pairs(o.where("o_orderstatus <> 'P'"), F.col("o_custkey")), pairs(o.where("o_orderpriority < '3'"), -F.col("o_custkey")), ["k"])
    return seeded(merged, pairs(o, F.lit(0)), ["k"])


@query(
    f"""
with {_INVOICES},
i as (select customer, date_trunc('month', day) as m, invoice as a, amount as x from inv),
g as (select customer, date_trunc('month', paid_day) as m, sum(paid) as goal, min(debit) as target from deb group by customer, date_trunc('month', paid_day), paid_day),
c as (
  select g.customer, g.m, target, abs(goal - p.x) as off, 1 as n, [p.a] as ids from g join i p using (customer, m) where abs(goal - p.x) <= 2
  union all select g.customer, g.m, target, abs(goal - p.x - q.x), 2, [p.a, q.a] from g join i p using (customer, m) join i q using (customer, m) where p.a < q.a and abs(goal - p.x - q.x) <= 2
  union all select g.customer, g.m, target, abs(goal - p.x - q.x - r.x), 3, [p.a, q.a, r.a] from g join i p using (customer, m) join i q using (customer, m) join i r using (customer, m) where p.a < q.a and q.a < r.a and abs(goal - p.x - q.x - r.x) <= 2),
b as (select customer, m, target, min(struct_pack(off := off, n := n, ids := ids)) as best from c group by all)
select customer, cast(m as date) as month, target, array_to_string(best.ids, ',') as members, cast(best.off as double) as off from b"""
)
def subset_sum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's day, the up to three invoices of the same customer and month that add up to what was paid that day."""
    inv = invoices(spark, sf_dir).withColumn("month", F.trunc("day", "MM"))
    goals = debits(spark, sf_dir).groupBy("customer", F.trunc("paid_day", "MM").alias("month"), "paid_day").agg(F.sum("paid").alias("goal"), F.min("debit").alias("debit"))
    out = matching.subset_sums(inv, goals, ["customer", "month"], "invoice", "amount", "debit", "goal", 2.0)
    return out.select("customer", "month", "target", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.col("off").cast("double").alias("off"))


@query(
    """
select o_orderkey, format('{:05d}-{:08d}', o_custkey, o_orderkey) as voucher, lpad(cast(o_custkey * 1000003 % 100000000000 as varchar), 11, '0') as id,
  case when o_orderkey % 2 = 0 then 'NOTA' else 'PARTY' end as second from orders"""
)
def voucher_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    written = F.concat(F.lit("FC A "), F.col("o_custkey").cast("string"), F.lit(" - "), F.col("o_orderkey").cast("string"), F.lit("."))
    raw_id = F.lpad((F.col("o_custkey") * 1000003 % 100000000000).cast("string"), 11, "0")
    dashed = F.concat(F.left(raw_id, F.lit(2)), F.lit("-"), F.substr(raw_id, F.lit(3), F.lit(8)), F.lit("-"), F.right(raw_id, F.lit(1)))
    line = F.concat(F.lit("X / "), F.when(F.col("o_orderkey") % 2 == 0, "NOTA").otherwise("PARTY"), F.lit(" / Y"))
    return o.select("o_orderkey", T.voucher_in(written).alias("voucher"), T.tax_id(dashed).alias("id"), T.second_field(line).alias("second"))
