"""Queries on invoices against a listing, credits against sets of invoices, and fund years."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import MONEY
from ..operators import credits, funds, serial
from ..sources.scratch import run_folder, stored
from .holdings import _LOTS
from .inputs import movements, read
from .registry import query


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, code, issuer, kind, number, day, total: every order, under codes and numbers that some orders of a customer share."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    key, issuer = F.col("o_orderkey"), F.col("o_custkey")
    code = F.when(key % 4 == 0, F.format_string("%010d%d", issuer, key % 5))
    return o.select(key.alias("row"), code.alias("code"), issuer.alias("issuer"), F.left("o_orderpriority", F.lit(1)).alias("kind"), F.format_string("%d-%d", issuer, key % 4).alias("number"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast(MONEY).alias("total"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice and the columns of the listing, with what scans lose: codes, numbers, kinds, days, cents and totals."""
    rows, key = listing(spark, sf_dir), F.col("row")
    return rows.select(
        key.alias("invoice"),
        F.when(key % 3 > 0, F.col("code")).alias("code"),
        "issuer",
        F.when(key % 7 > 0, F.col("kind")).alias("kind"),
        F.when(key % 5 > 1, F.col("number")).otherwise(F.when(key % 5 == 1, F.format_string("%d-x%d", "issuer", key % 2))).alias("number"),
        F.when(key % 6 == 5, F.date_add("day", 1)).when(key % 17 > 0, F.col("day")).alias("day"),
        F.when(key % 13 > 0, F.col("total") + ((key % 11) / 100).cast(MONEY) * F.when(key % 29 == 0, 100).otherwise(1)).cast(MONEY).alias("total"),
    )


@query(
    """
with recursive li as (select o_orderkey as row, case when o_orderkey % 4 = 0 then printf('%010d%d', o_custkey, o_orderkey % 5) end as code, o_custkey as issuer, left(o_orderpriority, 1) as kind, printf('%d-%d', o_custkey, o_orderkey % 4) as number,
    cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) as total from orders),
sc as (select row as invoice, case when row % 3 > 0 then code end as code, issuer, case when row % 7 > 0 then kind end as kind, case when row % 5 > 1 then number when row % 5 = 1 then printf('%d-x%d', issuer, row % 2) end as number,
    case when row % 6 = 5 then day + 1 when row % 17 > 0 then day end as day, case when row % 13 > 0 then cast(total + cast((row % 11) / 100.0 as decimal(18,2)) * case when row % 29 = 0 then 100 else 1 end as decimal(18,2)) end as total from li),
lk as (select invoice, issuer, unnest([{'p': 1, 'k': 'code:' || code}, {'p': 2, 'k': 'kind:' || kind || number}, {'p': 3, 'k': 'number:' || number}, {'p': 4, 'k': 'day:' || cast(day as varchar) || '|' || cast(total as varchar)}, {'p': 5, 'k': 'total:' || cast(total as varchar)}]) as x from sc),
rk as (select row, issuer, unnest(['code:' || code, 'kind:' || kind || number, 'number:' || number, 'day:' || cast(day as varchar) || '|' || cast(total as varchar), 'total:' || cast(total as varchar)]) as k from li),
cand as (select invoice, row, x.p as p from lk join rk on lk.issuer = rk.issuer and x.k = rk.k
  union all select invoice, row, 6 from sc join li using (issuer, day) where abs(li.total::double - coalesce(sc.total, 0)::double) <= greatest(0.05, coalesce(sc.total, 0)::double * 0.02) + 1e-9
  union all select invoice, row, 7 from sc join li using (issuer) where sc.total <> 0 and abs(li.total - sc.total) <= 0.05),
wish as (select invoice, list({'r': row, 'p': p} order by p, row) as c from cand group by invoice),
same as (select invoice, list(row) as s from sc join li using (issuer, day) group by invoice),
lf as (select sc.invoice, sc.issuer, coalesce(c, []) as c, coalesce(s, []) as s, row_number() over (partition by sc.issuer order by sc.invoice) as k from sc left join wish using (invoice) left join same using (invoice)),
go as (select distinct issuer, 0::bigint as k, cast([] as bigint[]) as used, null::bigint as invoice, null::bigint as row, null::integer as p from li
  union all select issuer, k, case when x is null then used else list_append(used, x.r) end, invoice, x.r, x.p from (
    select issuer, k, used, invoice, coalesce(x, case when len(y) = 1 then {'r': y[1], 'p': 8} end) as x from (
      select lf.issuer, lf.k, go.used, lf.invoice, list_filter(lf.c, lambda z: not list_contains(go.used, z.r))[1] as x, list_filter(lf.s, lambda z: not list_contains(go.used, z)) as y
      from go join lf on lf.issuer = go.issuer and lf.k = go.k + 1))),
met as (select go.invoice, go.row, p, case when coalesce(sc.total, 0) <= 0 and li.total > 0 then 0 else coalesce(sc.total, 0) - li.total end as d from go join sc on sc.invoice = go.invoice join li on li.row = go.row)
select invoice, row, case when abs(d) > 0.05 then 'DIFERENCIA' else 'OK' end as state, ['code', 'issuer+kind+number', 'issuer+number', 'issuer+day+total', 'issuer+total', 'soft0', 'soft1', 'lone'][p] as rule, cast(d as double) as difference from met
union all select invoice, null, 'REVISAR', null, null from sc where invoice not in (select invoice from met)
union all select null, row, 'FALTA', null, null from li where row not in (select row from met)"""
)
def invoice_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned invoices against the listing, row by row on the best key that is free, then by softer rules; what is left on either side."""
    out = serial.crossed(scanned(spark, sf_dir), listing(spark, sf_dir), "invoice", "row")
    return out.select("invoice", "row", "state", F.split("key", ":")[0].alias("rule"), F.col("difference").cast("double").alias("difference"))


def paid_years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Invoices of a customer's year with what was withheld of them, and one credit for two of three of them."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    total, key = F.col("o_totalprice").cast(MONEY), F.col("o_orderkey")
    part = lambda c, x: F.round(c * F.lit(x).cast("decimal(3,2)"), 2).cast(MONEY)
    items = o.select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").cast("long").alias("year"), key.alias("invoice"), total.alias("total"), part(total, 0.03).alias("withheld"), F.when(key % 2 == 0, part(total, 0.02)).alias("monthly"), F.when(key % 3 > 0, part(total, 0.83)).alias("net"))
    paid = F.sum(F.when(key % 3 > 0, F.col("total") - F.col("withheld") - F.coalesce("monthly", F.lit(0)))).cast(MONEY)
    chosen = items.withColumn("o_orderkey", F.col("invoice")).groupBy("customer", "year").agg(paid.alias("amount"), F.min("invoice").alias("credit"))
    return items, chosen.where("amount is not null")


@query(
    """
with it as (select o_custkey as customer, year(o_orderdate) as year, o_orderkey as invoice, cast(o_totalprice as decimal(18,2)) as total from orders),
f as (select *, cast(round(total * 0.03, 2) as decimal(18,2)) as w, case when invoice % 2 = 0 then cast(round(total * 0.02, 2) as decimal(18,2)) end as m, case when invoice % 3 > 0 then cast(round(total * 0.83, 2) as decimal(18,2)) end as net from it),
cr as (select customer, year, sum(total - w - coalesce(m, 0)) filter (where invoice % 3 > 0) as amount, min(invoice) as credit from f group by all having amount is not null),
e as (select *, cast(round(case when net > 0 then net else cast((200 * cast(total * 100 as hugeint) + 121) // 242 as decimal(18,2)) * 0.01 end * 0.08, 2) as decimal(18,2)) as e, row_number() over (partition by customer, year order by total desc, invoice) as place from f),
pool as (select *, count(*) over (partition by customer, year) as n from e where place <= 10),
m as (select customer, year, n, unnest(range(1, 1 << n)) as mask from (select distinct customer, year, n from pool where n > 1)),
s as (select customer, year, mask, bit_count(mask) as k, sum(total)::double as t, sum(w)::double as w, coalesce(sum(pool.m), 0)::double as m, sum(e)::double as e, list(invoice order by place) as members
  from m join pool using (customer, year, n) where bit_count(mask) between 2 and 7 and (mask >> (n - place)) & 1 = 1 group by all),
q as (select s.*, credit, amount::double as a, greatest(50.0::double, abs(t) * 0.001::double) as tol from s join cr using (customer, year)),
r as (select *, least(abs(a + w + m - t), abs(a + w + e - t), abs(a + w + 0.0::double - t)) as off, round(t - a - w, 2) as miss from q),
z as (select *, case when off <= tol then off when miss >= -tol and miss <= greatest(m * 1.2::double, e * 1.2::double, t * 0.12::double, tol) then least(abs(miss - m), abs(miss - e), abs(miss)) * 0.01::double end + case when a / t < 0.75::double then (0.75::double - a / t) * t * 0.01::double else 0 end as score from r)
select customer, year, credit, array_to_string(members, ',') as members, round(score, 6) as score from (select *, row_number() over (partition by customer, year order by score, t desc, k desc, mask desc) as best from z where score is not null) where best = 1"""
)
def credit_closing_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's year the set of invoices that closes best with its credit, withholdings counted in."""
    items, paid = paid_years(spark, sf_dir)
    out = credits.credit_subset(items, paid, ["customer", "year"], "invoice", "total", "withheld", "monthly", "net", "credit", "amount")
    return out.select("customer", "year", "credit", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.round("score", 6).alias("score"))


def fund_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of accounts as subscriptions and redemptions of fund units."""
    rows = movements(spark, sf_dir)
    units, price = F.abs("amount").cast("decimal(28,6)"), (F.col("event_id") % 13 + 5).cast("decimal(9,0)")
    return rows.select("account", "day", F.col("event_id").alias("seq"), F.when(F.col("amount") >= 0, "S").otherwise("R").alias("side"), units.alias("units"), price.alias("price"), F.round(units * price, 2).cast(MONEY).alias("amount"))


_MID = "2024-01-16"


@query(
    f"""
with {_LOTS.replace('order by ts, event_id', 'order by cast(ts as date), event_id').replace('(event_id % 17) + 1', '(event_id % 13) + 5')},
half as (select account, event_id, ts, entry, leave, cost, sum(entry) over w as cin, sum(leave) over w as cout from ev where cast(ts as date) < date '{_MID}' window w as (partition by account order by cast(ts as date), event_id rows unbounded preceding)),
hlo as (select *, max(greatest(0, cout - cin)) over (partition by account order by cast(ts as date), event_id rows unbounded preceding) as lost from half),
hu as (select account, coalesce(max(cout - lost) filter (where leave > 0), 0) as used from hlo group by account),
hl as (select account, cast(ts as date) as day, cost, greatest(0, least(entry, cin - used)) as rest from hlo join hu using (account) where entry > 0),
op as (select account, sum(c) as opening from (select account, cast(round(sum(rest * cost), 2) as decimal(18,2)) as c from hl where rest > 0 group by account, day, cost) group by account),
e as (select account, ts, event_id, eff, cost as price, lag(eff, 1, 0) over (partition by account order by cast(ts as date), event_id) as from_ from cov where leave > 0),
sl as (select e.account, e.event_id, (least(l.cin, e.eff) - greatest(l.cin - l.entry, e.from_)) * (e.price - l.cost) as i from cov l join e on l.account = e.account and l.entry > 0 and l.cin - l.entry < e.eff and e.from_ < l.cin and e.eff > e.from_ where cast(e.ts as date) >= date '{_MID}'),
inr as (select account, sum(i) as interest from (select account, cast(round(sum(i), 2) as decimal(18,2)) as i from sl group by account, event_id) group by account),
mv as (select account, sum(case when entry > 0 then a end) as s, sum(case when leave > 0 then a end) as r from (select account, entry, leave, cast(round((entry + leave) * cost, 2) as decimal(18,2)) as a from ev where cast(ts as date) >= date '{_MID}') group by account),
u as (select account, coalesce(max(eff) filter (where leave > 0), 0) as used from cov group by account),
l as (select account, cast(ts as date) as day, cost, greatest(0, least(entry, cin - used)) as rest from cov join u using (account) where entry > 0),
g as (select account, cast(round(sum(rest), 4) as decimal(28,4)) as units, cast(round(sum(rest * cost), 2) as decimal(18,2)) as cost from l where rest > 0 group by account, day, l.cost),
h as (select account, sum(units) as units, cast(round(sum(units) * 11, 2) as decimal(18,2)) as v, sum(cost) as c from g group by account),
a as (select distinct account from ev),
x as (select account, coalesce(units, 0) as units, coalesce(opening, 0) as opening, coalesce(s, 0) as s, coalesce(r, 0) as r, coalesce(interest, 0) as i, coalesce(v - c, 0) as hold, case when account % 5 = 0 then 1000 else coalesce(v, 0) end as val from a left join op using (account) left join mv using (account) left join inr using (account) left join h using (account))
select account, cast(units as double) as units, cast(opening as double) as opening, cast(s as double) as subscriptions, cast(r as double) as redemptions, cast(i as double) as interest, cast(hold as double) as holding,
  cast(val - (opening + s + i + hold - r) as double) as adjustment, cast(hold + val - (opening + s + i + hold - r) as double) as to_book, cast(val as double) as valuation from x"""
)
def fund_year_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of every account's year as a fund, from the lots that the first half has stored: the closing equation with its adjustment."""
    moves = stored(fund_moves(spark, sf_dir))
    keys, mid = ["account"], F.lit(_MID).cast("date")
    end = lambda first: (F.lit("1900-01-01").cast("date"), F.date_sub(mid, 1)) if first else (mid, F.lit("9999-12-31").cast("date"))
    nothing = spark.createDataFrame([], "account long, day date, seq long, units decimal(28,6), unit_value decimal(9,0), origin string")
    _, half = funds.period(moves, nothing, keys, *end(True))
    folder = f"{run_folder(spark)}/funds-{uuid.uuid4().hex}"
    funds.hand_on(half, folder, "first")
    opening = funds.taken_over(spark, folder, "first")
    exits, left = funds.period(moves, opening, keys, *end(False))
    closings = moves.select("account").distinct().select("account", F.lit(11).cast("decimal(9,2)").alias("value"), F.when(F.col("account") % 5 == 0, 1000).cast(MONEY).alias("stated"))
    out = funds.control(moves, opening, exits, stored(left), closings, keys, *end(False), "value", "stated")
    return out.select("account", *[F.col(c).cast("double").alias(c) for c in ("units", "opening", "subscriptions", "redemptions", "interest", "holding", "adjustment", "to_book", "valuation")])


def withheld_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Invoices of 50 parties with net and VAT, and a group of withholdings for every 25th run of two to four of them."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    total = F.col("o_totalprice").cast(MONEY)
    items = o.select((F.col("o_custkey") % 50).alias("party"), F.col("o_orderkey").alias("invoice"), F.col("o_orderdate").cast("date").alias("day"), total.alias("total"), F.round(total * F.lit(0.8).cast("decimal(2,1)"), 2).cast(MONEY).alias("net"), F.round(total * F.lit(0.17).cast("decimal(3,2)"), 2).cast(MONEY).alias("vat"))
    w = Window.partitionBy("party").orderBy("day", "invoice")
    k = F.row_number().over(w)
    over = lambda c: F.when(F.col("k") % 3 == 0, F.sum(c).over(w.rowsBetween(-1, 0))).when(F.col("k") % 3 == 1, F.sum(c).over(w.rowsBetween(-2, 0))).otherwise(F.sum(c).over(w.rowsBetween(-3, 0)))
    runs = items.withColumn("k", k).withColumn("_n", over("net")).withColumn("_v", over("vat")).where("k % 25 = 0")
    share = lambda c, x: F.round(F.col(c) * F.lit(x).cast("decimal(3,2)"), 2).cast(MONEY)
    return items, runs.select("party", F.col("invoice").alias("group"), F.date_add("day", (F.col("k") % 9).cast("int")).alias("withheld_day"), share("_n", 0.01).alias("social"), share("_v", 0.80).alias("withheld_vat"))


@query(
    """
with it as (select o_custkey % 50 as party, o_orderkey as invoice, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) as total from orders),
iv as (select *, cast(round(total * 0.8, 2) as decimal(18,2)) as net, cast(round(total * 0.17, 2) as decimal(18,2)) as vat, row_number() over (partition by party order by day, invoice) as k from it),
ru as (select *, case k % 3 when 0 then sum(net) over a when 1 then sum(net) over b else sum(net) over c end as n, case k % 3 when 0 then sum(vat) over a when 1 then sum(vat) over b else sum(vat) over c end as v from iv
  window a as (partition by party order by day, invoice rows 1 preceding), b as (partition by party order by day, invoice rows 2 preceding), c as (partition by party order by day, invoice rows 3 preceding)),
gr as (select party, invoice as g, day + cast(k % 9 as integer) as until, cast(round(n * 0.01, 2) as decimal(18,2)) * 100 as gn, cast(round(v * 0.80, 2) as decimal(18,2)) * 1.25 as gv from ru where k % 25 = 0),
pl as (select * from (select g, gn, gv, invoice, net, vat, row_number() over (partition by g order by until - day, total desc, invoice) as i from gr join iv using (party) where day <= until and until - day <= 45) where i <= 18),
pa as (select x.g, x.gn, x.gv, x.i as a, y.i as b, x.net + y.net as n, x.vat + y.vat as v from pl x join pl y on x.g = y.g and x.i < y.i),
al as (select g, [a, b] as p, abs(gn - n) + abs(gv - v) as off from pa
  union all select pa.g, [a, b, i], abs(pa.gn - n - net) + abs(pa.gv - v - vat) from pa join pl on pa.g = pl.g and b < i
  union all select x.g, [x.a, x.b, y.a, y.b], abs(x.gn - x.n - y.n) + abs(x.gv - x.v - y.v) from pa x join pa y on x.g = y.g and x.b < y.a),
be as (select * from (select *, row_number() over (partition by g order by off > 2, case when off > 2 then off end, len(p), p) as z from al where off <= 5) where z = 1)
select g as "group", array_to_string(list_transform(p, lambda k: ids[k]), ',') as members, cast(off as double) as off from be join (select g, list(invoice order by i) as ids from pl group by g) using (g)"""
)
def withholding_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two to four invoices that each group of withholdings was made of, by net and VAT at once."""
    items, groups = withheld_groups(spark, sf_dir)
    out = credits.combined_withholdings(items, groups, "party", "invoice", "day", "total", "net", "vat", "group", "withheld_day", "social", "withheld_vat")
    return out.select("group", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.col("off").cast("double").alias("off"))
