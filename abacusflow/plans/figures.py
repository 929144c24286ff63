"""Queries on counts, clusters, checks, numbering and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import fiscal, figures, loans, matching, reports
from .holdings import _loan_rows
from .inputs import MOVEMENTS, movements, read
from .invoices import _INVOICES, debits, invoice_lines, invoices
from .registry import query


def _doubles(*names: str) -> list:
    return [F.col(c).cast("double").alias(c) for c in names]


@query("select o_orderstatus as state, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end as place from orders group by 1")
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by state, pending ones first."""
    rows = invoices(spark, sf_dir).withColumnRenamed("status", "state")
    return figures.state_summary(rows, "state", "amount", ["P", "O"]).select("state", "n", *_doubles("total"), "place")


@query("select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as n_distinct from lineitem group by all")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.value_counts(read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey"), ["l_returnflag", "l_linestatus"], "l_suppkey")


@query(
    """
with c as (select o_custkey, o_orderpriority, count(*) as n from orders group by all)
select o_custkey, o_orderpriority, n from (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as k from c) where k = 1"""
)
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's most common priority."""
    return figures.modal(read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")


@query(
    """
with c as (select o_custkey, min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders group by 1)
select o_custkey, a as first_day, b as last_day, b - a + 1 as days, (select count(*) from events where cast(ts as date) between date '2024-01-10' - 7 and date '2024-01-20' + 7) as n_covered from c"""
)
def coverage_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that each customer's orders cover, and how many events a statement of ten days covers, a week more on both sides."""
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate").withColumn("day", F.col("o_orderdate").cast("date"))
    e = read(spark, sf_dir, "events", "ts")
    inside = figures.covered(F.col("ts").cast("date"), F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    n = e.agg(F.count(F.when(inside, 1)).alias("n_covered"))
    return figures.coverage(rows, ["o_custkey"], "day").withColumn("days", F.col("days").cast("long")).crossJoin(F.broadcast(n))  # one row


_WITHHELD = """wh as (
  select event_id, cast(ts as date) as day, user_id as party, cast(event_id % 3 as varchar) as voucher, cast(value as decimal(18,2)) as amount,
    case when event_type in ('purchase', 'signup') then 'IVA' when event_type = 'click' then 'GAN' else 'SS' end as kind from events)"""


@query(
    f"""
with {_WITHHELD},
g as (select day, party, voucher, coalesce(sum(amount) filter (where kind = 'IVA'), 0) as iva, coalesce(sum(amount) filter (where kind = 'GAN'), 0) as gan, list_sort(list(event_id)) as members from wh where kind <> 'SS' group by all),
r as (select *, row_number() over (partition by day, party order by -(iva + gan), voucher) as k from g),
s as (select day, party, event_id, amount, row_number() over (partition by day, party order by event_id) as k from wh where kind = 'SS')
select coalesce(r.day, s.day) as day, coalesce(r.party, s.party) as party, coalesce(voucher, '') as voucher, cast(coalesce(iva, 0) as double) as iva, cast(coalesce(gan, 0) as double) as gan, cast(coalesce(amount, 0) as double) as ss,
  array_to_string(list_concat(coalesce(members, []), case when event_id is null then [] else [event_id] end), ',') as members
from r full join s on r.day = s.day and r.party = s.party and r.k = s.k"""
)
def withholding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withholdings of a day, party and voucher with their sums; social security rows, which have no voucher, go to the largest clusters of their day and party."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "IVA").when(F.col("event_type") == "click", "GAN").otherwise("SS")
    rows = e.select("event_id", F.col("ts").cast("date").alias("day"), F.col("user_id").alias("party"), F.when(kind != "SS", (F.col("event_id") % 3).cast("string")).alias("voucher"), F.col("value").cast(MONEY).alias("amount"), kind.alias("kind"))
    out = figures.clusters(rows, "day", "party", "voucher", "kind", "amount", "event_id")
    return out.select("day", "party", "voucher", *_doubles("iva", "gan", "ss"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(
    """
select o_custkey, count(*) as n, arg_min(a, o_orderkey) filter (where a is not null) as bank, arg_min(b, o_orderkey) filter (where b is not null) as account
from (select *, case when o_orderstatus <> 'P' then o_orderpriority end as a, case when o_orderkey % 4 = 0 then cast(o_orderkey as varchar) end as b from orders) group by o_custkey"""
)
def group_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of a group tell first of bank and account."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = o.withColumn("bank", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).withColumn("account", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey").cast("string")))
    return figures.first_known(rows, ["o_custkey"], ["o_orderkey"], ["bank", "account"])


@query("select l_orderkey, count(distinct l_suppkey) = 1 as one_l_suppkey, count(distinct l_returnflag) = 1 as one_l_returnflag from lineitem group by 1")
def one_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all lines of an order have one supplier and one flag."""
    return figures.same_throughout(read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag"), ["l_orderkey"], ["l_suppkey", "l_returnflag"])


@query(
    """
with t as (select o_custkey, max(o_orderkey) as last from orders where o_orderstatus <> 'P' group by 1)
select o_orderkey, o_custkey, coalesce(last, -1) + row_number() over (partition by o_custkey order by o_orderkey) as number from orders left join t using (o_custkey) where o_orderstatus = 'P'"""
)
def next_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders numbered on from each customer's largest other one."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    there = o.where("o_orderstatus <> 'P'").withColumn("number", F.col("o_orderkey"))
    new = o.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return figures.numbered_on(there, new, ["o_custkey"], "number", ["o_orderkey"])


@query("select min(doc_id) as doc_id, lang, left(text, 60) as start, count(*) as n from documents group by lang, left(text, 60)")
def truncated_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose language and first 60 characters are the same, as the one with the least id."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return d.groupBy("lang", F.left("text", F.lit(60)).alias("start")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, case when o_orderkey <> min(o_orderkey) over (partition by o_custkey, cast(o_orderdate as date)) then 'duplicado' end as error from orders")
def repeats_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer and day after the first, with an error."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return figures.repeats_apart(o, [F.col("o_custkey"), F.col("o_orderdate").cast("date")], ["o_orderkey"]).select("o_orderkey", "error")


@query(
    """
with n as (select o_orderpriority as s, count(*) as n, least(count(*), 40) as base, case o_orderpriority when '5-LOW' then 0 when '1-URGENT' then 1 else 2 end as place from orders group by 1),
q as (select *, greatest(0, 1000 - sum(base) over ()) as rest, coalesce(sum(n - base) over (order by place, s rows between unbounded preceding and 1 preceding), 0) as gone from n),
k as (select s, base + greatest(0, least(n - base, rest - gone)) as quota from q)
select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as r from orders) join k on s = o_orderpriority where r <= quota"""
)
def sample_with_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 1,000 orders: 40 of each priority at least, the rest from low ones, then urgent ones."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    sizes = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    given = figures.quotas(sizes, "o_orderpriority", "n", 1000, 40, ["5-LOW", "1-URGENT"])
    return figures.by_quota(o, "o_orderpriority", given, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by s desc nulls last, o_totalprice asc nulls first, o_orderkey) as place from (select *, nullif(o_orderstatus, 'F') as s from orders)")
def mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by state from the last, those without one behind, then by amount."""
    from pyspark.sql.window import Window

    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").withColumn("s", F.expr("nullif(o_orderstatus, 'F')"))
    w = Window.partitionBy("o_custkey").orderBy(F.col("s").desc_nulls_last(), F.col("o_totalprice").asc_nulls_first(), "o_orderkey")
    return o.select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("place"))


@query(
    """
with l as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as s from lineitem group by 1),
d as (select l_orderkey, s, case when l_orderkey % 5 = 0 then 'NCA' else 'A' end as kind, cast(s + (l_orderkey % 4) * 0.03 as decimal(18,2)) as total from l)
select l_orderkey, kind, cast(case when kind = 'NCA' then -total else total end as double) as total, case when abs(s - total) <= 0.05 then 'ok' else 'revisar' end as state from d"""
)
def credit_note_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' totals with their sign, and whether their lines add up to them."""
    sums = invoice_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("amount").alias("s"))
    kind = F.when(F.col("l_orderkey") % 5 == 0, "NCA").otherwise("A")
    rows = sums.withColumn("kind", kind).withColumn("total", (F.col("s") + F.col("l_orderkey") % 4 * F.lit("0.03").cast(MONEY)).cast(MONEY))
    return rows.select("l_orderkey", "kind", figures.signed_total(F.col("total"), F.col("kind")).cast("double").alias("total"), figures.lines_check(F.col("s"), F.col("total")).alias("state"))


@query(
    """
with r as (select o_orderkey, cast(o_totalprice as decimal(18,2)) as g, cast(o_orderkey % 50 as decimal(18,2)) as d, case when o_orderkey % 3 > 0 then cast(o_orderkey % 7 as decimal(18,2)) end as e from orders),
v as (select *, cast(round(g * cast(0.105 as decimal(9,4)), 2) as decimal(18,2)) as vat from r)
select o_orderkey, cast(g + vat - d - coalesce(e, 0) as double) as total, cast(g - d - coalesce(e, 0) as double) as net, cast(vat - d - coalesce(e, 0) as double) as interest from v"""
)
def fee_sheet_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee sheets: gross with VAT less deductions, the net of that, and what it is beyond the gross."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumn("g", F.col("o_totalprice").cast(MONEY))
    o = o.withColumn("vat", F.round(F.col("g") * F.lit("0.105").cast("decimal(9,4)"), 2).cast(MONEY))
    total, net = figures.fee_sheet(F.col("g"), F.col("vat"), [(F.col("o_orderkey") % 50).cast(MONEY), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 7).cast(MONEY))])
    out = o.withColumn("total", total).withColumn("net", net).withColumn("interest", figures.interest_in(F.col("total"), F.col("g")))
    return out.select("o_orderkey", *_doubles("total", "net", "interest"))


@query(
    f"""
with {_INVOICES}
select coalesce(inv.invoice, (deb.debit - 1) // 10) as invoice, cast(amount as double) as amount, cast(paid as double) as paid,
  case when amount is null then 'FALTA_UNO' when paid is null then 'FALTA_DOS' when abs(amount - paid) > 0.25 then 'DIFERENCIA' else 'OK' end as state
from (select * from inv where status <> 'O') inv full join deb on deb.debit = inv.invoice * 10 + 1"""
)
def difference_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices that are not open and debits of the same number: which differ by more than 0.25, which lack the other side."""
    one = invoices(spark, sf_dir).where("status <> 'O'").select("invoice", "amount")
    two = debits(spark, sf_dir).select(F.expr("(debit - 1) div 10").alias("invoice"), "paid")
    out = one.join(two, "invoice", "full")
    return out.select("invoice", *_doubles("amount", "paid"), figures.difference_bucket(F.col("amount"), F.col("paid"), 0.25).alias("state"))


@query(
    f"""
with {_INVOICES},
m as (select customer, date_trunc('month', day) as month, sum(amount) as owed from inv group by all),
s as (select customer, date_trunc('month', paid_day) as pm, min(debit) as debit, sum(paid) as paid from deb group by all having count(*) = 1),
c as (select m.customer, m.month, m.owed, s.debit, s.pm <> m.month as later from m join s on s.customer = m.customer and (s.pm = m.month or s.pm = m.month + interval 1 month) and abs(m.owed - s.paid) <= 1),
b as (select customer, month, arg_min(debit, later::int) as debit, min(later::int) = 1 as next_month from c group by all)
select m.customer, cast(m.month as date) as month, cast(m.owed as double) as owed, coalesce(debit, 0) as debit, coalesce(next_month, false) as next_month from m left join b using (customer, month)"""
)
def single_payment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a customer that the only payment of that month, or of the next, settles."""
    out = figures.single_payments(invoices(spark, sf_dir), debits(spark, sf_dir), "customer", "day", "amount", "paid_day", "paid", "debit", 1.0)
    return out.select("customer", "month", *_doubles("owed"), F.coalesce("debit", F.lit(0)).alias("debit"), F.coalesce("next_month", F.lit(False)).alias("next_month"))


@query("select user_id, bool_and(event_type in ('click', 'view', 'purchase')) as only, count(*) filter (where event_id % 4 in (0, 3)) as n_withheld from events group by 1")
def kinds_and_withholdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an account has events of some kinds alone, and how many of its bank lines are withholdings but no perceptions."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    line = F.get(F.array(*map(F.lit, ("Retención IIBB SIRCREB", "Percepcion ret IVA", "transferencia", "RET GANANCIAS"))), (F.col("event_id") % 4).cast("int"))
    n = e.groupBy("user_id").agg(F.count(F.when(figures.comparable_withholding(line), 1)).alias("n_withheld"))
    return figures.only_of(e, ["user_id"], "event_type", ("click", "view", "purchase")).join(n, "user_id")


@query(
    f"""
with {MOVEMENTS}
select event_id, case when (event_id % 6 in (1, 5)) = (amount >= 0) then cast(abs(amount) as double) else 0 end as debe, case when (event_id % 6 in (1, 5)) = (amount >= 0) then 0 else cast(abs(amount) as double) end as haber from mov"""
)
def journal_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debit and credit of each movement by the first digit of its account."""
    debe, haber = figures.journal_side((F.col("event_id") % 6).cast("string"), F.col("amount"))
    return movements(spark, sf_dir).select("event_id", debe.cast("double").alias("debe"), haber.cast("double").alias("haber"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
def not_processed_yet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that an earlier run, which wrote those with an accepted line, has left."""
    done = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return figures.not_yet(read(spark, sf_dir, "orders", "o_orderkey"), done, ["o_orderkey"])


@query(
    """
with k as (select s_nationkey as bank, sum(cast(s_acctbal as decimal(18,2))) as paid from supplier group by 1), n as (select n_nationkey as bank, cast(n_nationkey * 5000 as decimal(18,2)) as opening from nation where n_nationkey % 5 > 0)
select bank, cast(paid as double) as paid, cast(opening as double) as opening, case when opening is not null then cast(greatest(0, opening - paid) as double) end as left from k left join n using (bank)""".replace(" as left from", ' as "left" from')
)
def suggested_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What should be left of each bank's opening balance."""
    paid = read(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal").select(F.col("s_nationkey").alias("bank"), F.col("s_acctbal").cast(MONEY).alias("capital"))
    opening = read(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("bank"), (F.col("n_nationkey") * 5000).cast(MONEY).alias("balance"))
    return reports.suggested_balances(paid, opening, "bank", "capital", "balance").select("bank", *_doubles("paid", "opening", "left"))


@query(
    """
with l as (select l_orderkey, count(*) as n, sum(cast(l_extendedprice as decimal(18,2))) as s from lineitem group by 1),
r as (select l_orderkey, n, s, cast(s + case when l_orderkey % 9 = 0 then 0.02 else 0.01 end as decimal(18,2)) as rs, n as rn from l)
select l_orderkey, cast(rs as double) as sales_reported, cast(s as double) as sales_computed, rn as count_reported, n as count_computed, case when abs(rs - s) <= 0.01 then 'OK' else 'DIFFERENCE' end as state from r"""
)
def reported_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that a settlement reports against what its lines add up to."""
    lines = invoice_lines(spark, sf_dir).select("l_orderkey", "amount")
    off = F.when(F.col("l_orderkey") % 9 == 0, F.lit("0.02")).otherwise(F.lit("0.01")).cast(MONEY)
    told = lines.groupBy("l_orderkey").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("rn")).withColumn("rs", (F.col("s") + off).cast(MONEY)).drop("s")
    rows = lines.join(told, "l_orderkey")
    out = reports.control(rows, ["l_orderkey"], {"sales": "rs", "count": "rn"}, {"sales": F.sum("amount"), "count": F.count(F.lit(1))})
    return out.select("l_orderkey", *_doubles("sales_reported", "sales_computed"), "count_reported", "count_computed", "state")


@query(
    """
with g as (select o_orderstatus as concept, month(o_orderdate) as m, sum(cast(o_totalprice as decimal(18,2))) as v from orders where month(o_orderdate) <> 7 group by all),
p as (select m as month, coalesce(sum(v) filter (where concept in ('F', 'P')), 0) as income, coalesce(sum(v) filter (where concept = 'O'), 0) as cost from g group by m)
select month, cast(income as double) as income, cast(cost as double) as cost, round(cast(cost as double) * 100 / cast(income as double), 4) as cost_share from p"""
)
def grid_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income and cost by month from a grid of concepts, and cost in percent of income; a month without any value is left out."""
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate", "o_totalprice").where(F.month("o_orderdate") != 7)
    rows = o.select(F.col("o_orderstatus").alias("concept"), F.month("o_orderdate").alias("m"), F.col("o_totalprice").cast(MONEY).alias("v"))
    out = reports.from_grid(reports.month_grid(rows, "concept", "m", "v"), "concept", {"income": ["F", "P"], "cost": ["O"]})
    return out.select("month", *_doubles("income", "cost"), reports.share_of(F.col("cost"), F.col("income")).alias("cost_share"))


_INSTALLMENTS = """with recursive l as (select p_partkey, cast(p_retailprice as decimal(18,2)) as cap, p_size as m, cast((2 * cast(round(p_retailprice * 100) as bigint) + p_size) // (2 * p_size) as decimal(18,2)) * cast(0.01 as decimal(3,2)) as part from part where p_size > 0),
r as (select *, unnest(range(1, m + 1)) as n from l),
s as (select *, cap - cast(n - 1 as decimal(9,0)) * part as before from r),
t as (select *, case when n = m then before else part end as capital, cast(round(cast(before as decimal(18,2)) * cast(0.03 as decimal(9,4)), 2) as decimal(18,2)) as interest from s),
u as (select p_partkey, n, capital + interest + cast(round(interest * cast(0.21 as decimal(9,4)), 2) as decimal(18,2)) as due, cast(last_day(date '2024-01-01' + to_months(cast(n - 1 as integer))) as date) as due_date from t)"""


@query(
    f"""
{_INSTALLMENTS}
select p_partkey, cast(n as integer) as n, cast(due as double) as due, case when n % 5 > 0 and n % 7 <> 3 then p_partkey * 100 + n else 0 end as debit, n % 5 > 0 and n % 7 <> 3 as matched from u"""
)
def loan_debit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installments and bank debits of a loan within 0.50 and four days, one to one; every fifth installment has no debit, and some come too late."""
    due = loans.german(_loan_rows(spark, sf_dir), ["p_partkey"], "capital", "n", "rate", "start").select("p_partkey", "n", "due", "due_date").withColumn("installment", F.col("p_partkey") * 100 + F.col("n"))
    paid = due.where("n % 5 > 0").select("p_partkey", F.col("installment").alias("debit"), (F.col("due") + (F.col("n") % 3 / 10).cast(MONEY)).cast(MONEY).alias("paid"), F.date_add("due_date", F.when(F.col("n") % 7 == 3, 9).otherwise(F.col("n") % 4 - 1).cast("int")).alias("paid_day"))
    return fiscal.installments_paid(due, paid, ["p_partkey"]).select("p_partkey", "n", *_doubles("due"), F.coalesce("debit", F.lit(0)).alias("debit"), "matched")
