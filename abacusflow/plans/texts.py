"""Queries on text lines, events of holdings, vouchers and declared periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import MONEY
from ..operators import dedup, extract, periods, reports, vouchers
from .inputs import MOVEMENTS, movements, read
from .registry import query

_LINES = """ln as (select doc_id, generate_subscripts(p, 1) - 1 as line_no, unnest(p) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents))"""


@query(
    f"""
with {_LINES},
m as (select *, case when line like '%.' and length(line) % 5 = 0 then false when length(line) % 3 = 0 then true end as mark from ln),
s as (select *, coalesce(last_value(mark ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), false) and mark is null as inside from m)
select doc_id, count(*) as n_lines, count(*) filter (where inside) as n_inside, coalesce(sum(length(line)) filter (where inside), 0)::bigint as chars_inside from s group by doc_id"""
)
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document between a start marker and the next end marker."""
    lines = T.lines(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    n = F.length("line")
    out = extract.sections(lines, ["doc_id"], "line_no", n % 3 == 0, F.col("line").endswith(".") & (n % 5 == 0))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("in_section"), 1)).alias("n_inside"), F.coalesce(F.sum(F.when(F.col("in_section"), n)), F.lit(0)).cast("long").alias("chars_inside"))


@query(
    f"""
with {_LINES},
b as (select *, sum(case when length(line) > 60 then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as block from ln)
select doc_id, cast(block as bigint) as block, min(line_no) as first_line, md5(string_agg(line, ' ' order by line_no)) as text_md5 from b group by doc_id, block"""
)
def continuation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long line with the short lines below it as one record."""
    lines = T.lines(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    out = extract.blocks(lines, ["doc_id"], "line_no", "line", F.length("line") > 60)
    return out.select("doc_id", "block", F.col("first_line").cast("long").alias("first_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    """
select page_id, k - 1 as match, href from (select page_id, unnest(h) as href, generate_subscripts(h, 1) as k from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages))"""
)
def pattern_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page as a record."""
    out = extract.records(read(spark, sf_dir, "pages", "page_id", "html"), ["page_id"], "html", 'href="([^"]*)"', ["href"])
    return out.select("page_id", F.col("match").cast("long").alias("match"), "href")


@query(
    """
select event_id, case event_type when 'purchase' then 'entrada' when 'signup' then 'entrada' when 'view' then 'salida' when 'click' then 'ingreso' else 'omitir' end as event,
  case event_type when 'purchase' then 0 when 'signup' then 0 when 'view' then 3 when 'click' then 1 else 4 end as rank from events"""
)
def holding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event does to a holding, told in a bank's words."""
    e = read(spark, sf_dir, "events", "event_id", "event_type")
    kind = F.when(F.col("event_type") == "purchase", "bono").when(F.col("event_type") == "signup", "fci").otherwise("accion")
    words = F.create_map(*[F.lit(x) for p in {"purchase": "Compra de títulos", "signup": "SUSCRIPCIÓN", "view": "venta", "click": "Pago de dividendos"}.items() for x in p])
    event = vouchers.holding_event(kind, F.coalesce(words[F.col("event_type")], F.lit("comisión")))
    return e.select("event_id", event.alias("event"), vouchers.event_rank(event).cast("int").alias("rank"))


@query(
    """
select o_orderkey, ['A', 'NCB', 'TF', 'LQ', 'NCA', 'NDC', ''][1 + o_orderkey % 7] as kind from orders"""
)
def voucher_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array(*map(F.lit, ("Factura A", "Nota de Crédito B", "Tique fiscal", "Liquidación de servicios", "003", "ND C", "otro")))
    o = read(spark, sf_dir, "orders", "o_orderkey")
    return o.select("o_orderkey", vouchers.voucher_kind(F.get(told, (F.col("o_orderkey") % 7).cast("int"))).alias("kind"))


@query(
    f"""
with {MOVEMENTS},
g as (select account, month, sum(case when kind = 'purchase' then amount else 0 end) as w, sum(case when kind = 'purchase' then 0 else abs(amount) end) as p from mov group by all),
d as (select account, cast(month + (account % 3 - 1) * interval 1 month as date) as month, w + case when account % 4 = 0 then p when account % 4 = 1 then 100000 else 0 end as goal from g),
t as (select d.account, d.month, d.goal, g.w, g.p, case when g.month = d.month then 0 when g.month < d.month then 1 else 2 end as rank,
  case when abs(g.w - goal) <= 1 then 'withheld' when abs(g.p - goal) <= 1 then 'perceived' when abs(g.w + g.p - goal) <= 1 then 'both' end as s
  from d join g on d.account = g.account and abs(date_diff('month', d.month, g.month)) <= 1),
b as (select account, month, arg_min(s || case when rank > 0 then '_near' else '' end, rank) as scenario from t where s is not null group by account, month)
select d.account, d.month, cast(goal as double) as goal, scenario from d left join b using (account, month)"""
)
def declared_period_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared totals of every account, some in a neighbouring month, against what its movements add up to."""
    rows = movements(spark, sf_dir).withColumn("amount", F.when(F.col("kind") == "purchase", F.col("amount")).otherwise(F.abs("amount")).cast(MONEY))
    is_purchase = F.col("kind") == "purchase"
    zero = F.lit(0).cast(MONEY)
    sums = rows.groupBy("account", "month").agg(F.sum(F.when(is_purchase, F.col("amount")).otherwise(zero)).alias("w"), F.sum(F.when(is_purchase, zero).otherwise(F.col("amount"))).alias("p"))
    goal = F.col("w") + F.when(F.col("account") % 4 == 0, F.col("p")).when(F.col("account") % 4 == 1, F.lit(100000).cast(MONEY)).otherwise(zero)
    declared = sums.select("account", F.add_months("month", (F.col("account") % 3 - 1).cast("int")).alias("month"), goal.cast(MONEY).alias("goal"))
    out = periods.declared_match(declared, rows, ["account"], "month", "goal", "amount", is_purchase)
    return out.select("account", "month", F.col("goal").cast("double").alias("goal"), "scenario")


@query(
    """
with old as (select o_custkey as k, cast(o_orderdate as date) as d, cast(o_totalprice as decimal(18,2)) as x from orders where o_orderstatus <> 'P'),
new as (select distinct o_custkey as k, cast(o_orderdate as date) as d, cast(o_totalprice as decimal(18,2)) as x from orders where o_orderpriority < '3'),
s as (select k, date_trunc('month', d) as m, sum(x) as s from old group by all)
select k, d, cast(x as double) as x from old
union all select k, d, cast(x as double) from new left join s using (k) where false
union all select n.k, n.d, cast(n.x as double) from new n left join s on s.k = n.k and s.m = date_trunc('month', n.d) where (n.k, n.d, n.x) not in (select k, d, x from old) and coalesce(abs(s.s - n.x) >= 0.02, true)"""
    .replace("union all select k, d, cast(x as double) from new left join s using (k) where false\n", "")
)
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extract of the orders merged into the first without repeats."""
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate", "o_totalprice")
    rows = o.select("o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast(MONEY).alias("x"))
    out = periods.merged(rows.where("o_orderstatus <> 'P'").select("k", "d", "x"), rows.where("o_orderpriority < '3'").select("k", "d", "x"), ["k"], "d", "x")
    return out.select("k", "d", F.col("x").cast("double").alias("x"))


@query(
    """
select l_returnflag, """
    + ", ".join(f"cast(sum(cast(l_extendedprice as decimal(18,2))) filter (where month(l_shipdate) = {m}) as double) as m{m}" for m in range(1, 13))
    + " from lineitem group by l_returnflag"
)
def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_shipdate", "l_extendedprice")
    rows = rows.select("l_returnflag", F.month("l_shipdate").alias("m"), F.col("l_extendedprice").cast(MONEY).alias("v"))
    grid = reports.month_grid(rows, "l_returnflag", "m", "v")
    return grid.select("l_returnflag", *[F.col(f"m{m}").cast("double").alias(f"m{m}") for m in range(1, 13)])


@query(
    """
with p as (select distinct o_custkey as customer, date_trunc('month', o_orderdate) as m from orders),
s as (select customer, unnest(generate_series(timestamp '1996-01-01', timestamp '1996-12-01', interval 1 month)) as m from (select distinct customer from p))
select customer, cast(m as date) as month from s where (customer, m) not in (select customer, m from p)"""
)
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a year in which a customer has no order."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("d"))
    return reports.missing_months(o, ["customer"], "d", "1996-01-01", "1996-12-01")


@query(
    """
select c_custkey, c_name, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as k from customer) where k <= 20"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 customers of every segment (a sampling operator)."""
    return dedup.sample_strata(read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", 20, ["c_custkey"])
