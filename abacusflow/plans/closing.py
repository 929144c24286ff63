"""Queries on closings, schedules, lists of names, client states and arriving events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import MONEY
from ..operators import attempts, fiscal, matching, names, periods, proration
from ..sources.scratch import run_folder, stored
from ..streaming import incoming
from .inputs import MOVEMENTS, movements, read
from .invoices import _INVOICES, _LINE_ORDER, _LINES, debits, invoice_lines, invoices
from .registry import greedy_sql, query


@query(
    f"""
with {_LINES},
t as (select o_orderkey, cast(cast(o_totalprice * 100 as bigint) // 10 as decimal(18,2)) * cast(0.01 as decimal(3,2)) as tax from orders),
s as (select ln.*, tax, sum(amount) over w as total, max(k) over w as last from ln join t on o_orderkey = l_orderkey window w as (partition by l_orderkey)),
p as (select *, cast((2 * cast(tax * 100 as bigint) * cast(amount * 100 as bigint) + cast(total * 100 as bigint)) // (2 * cast(total * 100 as bigint)) as decimal(18,2)) * cast(0.01 as decimal(3,2)) as part from s),
q as (select *, sum(case when k <> last then part else 0 end) over (partition by l_orderkey) as others from p)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, cast(case when k = last then tax - others else part end as double) as share from q"""
)
def monthly_tax_prorate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each order spread over its lines by amount; the last line takes the cents left."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    tax = o.select(F.col("o_orderkey").alias("l_orderkey"), (F.floor(F.round(F.col("o_totalprice") * 100).cast("long") / 10).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("tax"))
    rows = invoice_lines(spark, sf_dir).join(tax, "l_orderkey")
    out = proration.spread(rows, ["l_orderkey"], _LINE_ORDER, "amount", "tax")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", F.col("share").cast("double").alias("share"))


_CLOSING = """r as (select o_custkey as customer, o_orderstatus as rate, cast(case when o_orderkey % 2 = 0 then o_totalprice else 0 end as decimal(18,2)) as d, cast(case when o_orderkey % 2 = 1 then o_totalprice else 0 end as decimal(18,2)) as c, cast(o_custkey % 5 * 1000 as decimal(18,2)) as p from orders)"""


@query(
    f"""
with {_CLOSING},
g as (select customer, rate, sum(d) as d, sum(c) as c from r group by all),
s as (select customer, sum(d) - sum(c) as due, max(p) as before from r group by customer)
select customer, line, cast(debit as double) as debit, cast(credit as double) as credit from (
  select customer, 'charged ' || rate as line, d as debit, 0 as credit from g union all select customer, 'paid ' || rate, 0, c from g
  union all select customer, 'carried from before', 0, before from s union all select customer, case when due - before >= 0 then 'owed' else 'carried on' end, greatest(before - due, 0), greatest(due - before, 0) from s)
where debit <> 0 or credit <> 0"""
)
def vat_closing_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced closing entry for every customer."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    amount, zero = F.col("o_totalprice").cast(MONEY), F.lit(0).cast(MONEY)
    rows = o.select(
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("rate"),
        F.when(F.col("o_orderkey") % 2 == 0, amount).otherwise(zero).alias("d"),
        F.when(F.col("o_orderkey") % 2 == 1, amount).otherwise(zero).alias("c"),
        (F.col("o_custkey") % 5 * 1000).cast(MONEY).alias("p"),
    )
    out = fiscal.vat_closing(rows, ["customer"], "rate", "d", "c", "p")
    return out.select("customer", "line", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


@query(
    """
with f as (select l_orderkey as loan, l_linenumber as n, arg_min((l_extendedprice, l_quantity), (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) as x from (select *, l_shipdate from lineitem) group by all)
select loan, count(*) as n_installments, cast(coalesce(nullif(max(cast(x[2] as decimal(18,2))), 0), sum(cast(x[1] as decimal(18,2)))) as double) as capital from f group by loan"""
    .replace("arg_min((l_extendedprice, l_quantity), (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) as x", "min(struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_extendedprice, e := l_quantity)) as x")
    .replace("x[2]", "x.e")
    .replace("x[1]", "x.d")
)
def loan_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loans and lines as installments, some told twice."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = rows.withColumn("capital", F.col("l_extendedprice").cast(MONEY)).withColumn("balance", F.col("l_quantity").cast(MONEY)).withColumn("told", F.lit(0).cast(MONEY))
    out = fiscal.consolidated_loans(rows, "l_orderkey", "l_linenumber", ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], "capital", "balance", "told")
    return out.select(F.col("l_orderkey").alias("loan"), "n_installments", F.col("capital").cast("double").alias("capital"))


@query(
    """
select l_orderkey, count(*) as n_rows, case when max(case when l_discount > 0.09 then 1 else 0 end) = 1 then 'NEGATIVE' when avg(case when l_tax = 0 then 1.0 else 0 end) > 0.5 then 'ZERO_AMOUNTS'
  when avg(case when l_returnflag = 'N' then 1.0 else 0 end) > 0.5 then 'MISSING_DATES' else 'OK' end as verdict from lineitem group by l_orderkey"""
)
def schedule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's lines would do as a schedule."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    rows = rows.select("l_orderkey", F.when(F.col("l_discount") > 0.09, -1).otherwise(F.when(F.col("l_tax") == 0, 0).otherwise(1)).cast(MONEY).alias("x"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("d"))
    return fiscal.plausible_schedule(rows, ["l_orderkey"], "x", "d")


@query(
    """
with r as (select o_custkey as doc, row_number() over (partition by o_custkey order by o_orderkey) as n, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) as capital, cast(round(cast(o_totalprice as decimal(18,2)) * 0.05, 2) as decimal(18,2)) as interest from orders)
select doc, n, case when doc % 5 = 4 then null else day end as due_date, cast(case when doc % 5 = 4 then null else capital end as double) as capital, cast(case when doc % 5 = 4 then null else capital + interest end as double) as due,
  ['lines', 'fields', 'scan', 'lines', null][doc % 5 + 1] as strategy, [1, 2, 3, 1, 3][doc % 5 + 1] as attempts, case when doc % 5 = 4 then 'ZERO_AMOUNTS' else 'OK' end as reason from r where doc % 5 < 4
union all select distinct doc, null::bigint, null::date, null::double, null::double, null, 3, 'ZERO_AMOUNTS' from r where doc % 5 = 4"""
)
def schedules_in_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a printed schedule in one of three layouts, or with zeros for amounts, read in up to three attempts."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    capital, layout = F.col("o_totalprice").cast(MONEY), F.col("o_custkey") % 5
    interest = F.round(capital * F.lit("0.05").cast("decimal(3,2)"), 2).cast(MONEY)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    written = lambda x: F.translate(F.format_number(F.when(layout == 4, F.lit(0).cast(MONEY)).otherwise(x), 2), ".,", ",.")
    told = [place.cast("string"), F.date_format("o_orderdate", "dd/MM/yyyy"), *[written(x) for x in (capital, interest, capital + interest)]]
    fields = F.when(layout == 1, F.concat_ws("\n", *told)).otherwise(F.concat_ws(" ", *told))
    # a scan reads noughts as letters and slashes as quotes from the date on
    scan = F.concat(F.regexp_extract(fields, r"^(\d+ )", 1), F.translate(F.regexp_replace(fields, r"^\d+ ", ""), "0/", "O'"))
    lines = o.select(F.col("o_custkey").alias("doc"), place.alias("n"), F.when(layout == 2, scan).otherwise(fields).alias("line"))
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    docs = stored(lines.groupBy("doc").agg(page.alias("text")))
    rows, log = attempts.loan_schedules(docs, "doc", "text")
    out = attempts.outcome(log, "doc").join(rows.select("doc", "n", "due_date", "capital", "due"), "doc", "left")
    return out.select("doc", F.col("n").cast("long").alias("n"), "due_date", F.col("capital").cast("double").alias("capital"), F.col("due").cast("double").alias("due"), "strategy", F.col("attempts").cast("int").alias("attempts"), "reason")


@query(
    """
with o as (select o_custkey as k, count(*) filter (where o_orderstatus = 'P') as p, count(*) filter (where o_orderstatus = 'O') as n, count(*) filter (where o_orderstatus = 'F') as d from orders group by 1)
select c_custkey, n_name, coalesce(n, 0) as n_new, coalesce(d, 0) as n_done, case when coalesce(p, 0) > 5 then 'PENDIENTE' when coalesce(n, 0) > coalesce(d, 0) then 'NOVEDADES' when coalesce(d, 0) > 0 then 'LIQUIDADO' else 'SIN_DATOS' end as state
from customer left join o on c_custkey = k left join nation on c_nationkey = n_nationkey"""
)
def client_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client with its nation, its counts from one pre-aggregation, and one state."""
    count = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count("P").alias("p"), count("O").alias("n_new"), count("F").alias("n_done"))
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    rows = c.join(o, "c_custkey", "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").fillna(0, ["p", "n_new", "n_done"])
    return rows.select("c_custkey", "n_name", "n_new", "n_done", periods.state_priority(F.col("p") > 5, F.col("n_new"), F.col("n_done")).alias("state"))


@query(
    f"""
with {MOVEMENTS},
m as (select account, date_trunc('week', day) as wk, sum(amount) as moved, count(*) as u from mov group by all),
u as (select *, sum(u) over (partition by account order by wk) as close, cast((account % 7 + 1) * 1.5 as decimal(18,6)) as value from m),
c as (select *, cast(round(close * value, 2) as decimal(18,2)) as amount_close from u),
o as (select *, lag(close, 1, 0) over w as units_open, lag(amount_close, 1, 0) over w as amount_open from c window w as (partition by account order by wk))
select account, cast(wk as date) as period, cast(amount_close - amount_open - moved as double) as result, case when abs(units_open + u - close) <= 0.01 then 'OK' else 'ERROR' end as state from o"""
)
def fund_year_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as funds of weekly closings: one unit per movement, at a fixed value."""
    from pyspark.sql.window import Window

    m = movements(spark, sf_dir).groupBy("account", F.date_trunc("week", "ts").cast("date").alias("period")).agg(F.sum("amount").cast(MONEY).alias("moved"), F.count(F.lit(1)).cast("decimal(18,6)").alias("units"))
    w = Window.partitionBy("account").orderBy("period")  # one row per account and week
    rows = m.withColumn("close", F.sum("units").over(w).cast("decimal(18,6)")).withColumn("value", ((F.col("account") % 7 + 1) * 1.5).cast("decimal(18,6)"))
    out = fiscal.fund_year(rows, ["account"], "period", "close", "value", "units", "moved")
    return out.select("account", "period", F.col("result").cast("double").alias("result"), "state")


@query()
def goods_or_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name against two lists of concepts."""
    lists = spark.createDataFrame([("Mercadería", "small ring"), ("Mercadería", "large"), ("Servicio", "flete"), ("Servicio", "medium box")], "kind string, name string")
    return names.by_lists(read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name", lists).select("p_partkey", "label")


@query(
    f"""
with {_INVOICES},
g as (select customer, cast(date_trunc('month', paid_day) as date) as month, sum(paid) as goal, min(debit) as target from deb group by all),
pl as (select * from (select customer, cast(date_trunc('month', day) as date) as month, invoice, amount, row_number() over (partition by customer, date_trunc('month', day) order by day, invoice) as r from inv) where r <= 10),
m as (select customer, month, target, goal, unnest(range(1, 1 << n)) as mask from g join (select customer, month, max(r) as n from pl group by all) using (customer, month)),
s as (select customer, month, target, mask, abs(goal - sum(amount)) as off, list(invoice order by r) as members from m join pl using (customer, month) where bit_count(mask) <= 7 and (mask >> (r - 1)) & 1 = 1 group by customer, month, target, goal, mask)
select customer, month, target, array_to_string(members, ',') as members, cast(off as double) as off from (select *, row_number() over (partition by customer, month, target order by off, len(members), mask) as k from s) where k = 1"""
)
def credit_closest_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's month the invoices, of its first ten, that come closest to what was paid in it."""
    inv = invoices(spark, sf_dir).withColumn("month", F.trunc("day", "MM"))
    goals = debits(spark, sf_dir).groupBy("customer", F.trunc("paid_day", "MM").alias("month")).agg(F.sum("paid").alias("goal"), F.min("debit").alias("debit"))
    out = matching.closest_subset(inv, goals, ["customer", "month"], "invoice", "amount", "debit", "goal", ["day"])
    return out.select("customer", "month", "target", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.col("off").cast("double").alias("off"))


@query(
    f"""
with recursive {_INVOICES},
amt as (select inv.customer, debit, invoice, amount, paid, day, paid_day, abs(date_diff('day', day, paid_day)) as days from inv join deb on inv.customer = deb.customer and abs(amount - paid) <= 1),
one as (select * from amt where amount = paid and days <= 3),
{greedy_sql('first_', 'one', 'customer', 'debit', 'invoice', 'days, ')},
two as (select * from amt where debit not in (select debit from first_) and invoice not in (select invoice from first_) and (days <= 7 or date_trunc('month', day) = date_trunc('month', paid_day))),
{greedy_sql('second_', 'two', 'customer', 'debit', 'invoice', 'days, ')},
rest as (select * from amt where amount = paid and debit not in (select debit from first_ union all select debit from second_) and invoice not in (select invoice from first_ union all select invoice from second_)),
three as (select * from rest where debit in (select debit from rest group by debit having count(*) = 1)),
{greedy_sql('third_', 'three', 'customer', 'debit', 'invoice', '')}
select debit, invoice, 'exact' as stage from first_ union all select debit, invoice, 'near' from second_ union all select debit, invoice, 'only' from third_"""
)
def staged_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits and invoices of a customer in passes, each on what is left: exact amount within 3 days; within 1.00 and 7 days or the month; exact amount at any date if it is the only candidate."""
    near = lambda tolerance: lambda p, q: matching.amount_band(p, q, "paid", "amount", tolerance, ["customer"])
    days = F.abs(F.datediff("paid_day", "day"))
    only = lambda pairs: pairs.join(pairs.groupBy("debit").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("debit"), "debit", "left_semi")
    passes = [
        ("exact", lambda p, q: near(0.0)(p, q).where(days <= 3), [days]),
        ("near", lambda p, q: near(1.0)(p, q).where((days <= 7) | (F.trunc("paid_day", "MM") == F.trunc("day", "MM"))), [days]),
        ("only", lambda p, q: only(near(0.0)(p, q)), []),
    ]
    paid, listed = debits(spark, sf_dir).select("debit", "customer", "paid", "paid_day"), invoices(spark, sf_dir).select("invoice", "customer", "amount", "day")
    return matching.staged(paid, listed, "debit", "invoice", passes)


@query("select event_id, user_id, event_type from (select distinct event_id, user_id, event_type from events)")
def arriving_unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, each event once, written to a table."""
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    once = incoming.without_repeats(stream.withColumn("at", F.col("ts").cast("timestamp")), ["event_id"], "at", "30 days")
    out = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = once.select("event_id", "user_id", "event_type").writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.start(f"{out}/rows").awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{out}/rows")
