"""Queries on lots, positions, loans and payroll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import currency, loans, lots, payroll
from ..sources.tables import spread
from .inputs import ORDER, movements, read
from .registry import query

_LOTS = """ev as (
  select user_id as account, ts, event_id, cast(case when event_type in ('purchase', 'signup') then value else 0 end as decimal(28,6)) as entry,
    cast(case when event_type in ('purchase', 'signup') then 0 else value end as decimal(28,6)) as leave, (event_id % 17) + 1 as cost from events),
cum as (select *, sum(entry) over w as cin, sum(leave) over w as cout from ev window w as (partition by account order by ts, event_id rows unbounded preceding)),
los as (select *, max(greatest(0, cout - cin)) over (partition by account order by ts, event_id rows unbounded preceding) as lost from cum),
cov as (select *, cout - lost as eff from los)"""


def lot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements as entries and exits of units, with a cost per unit."""
    rows = movements(spark, sf_dir)
    units = lambda c: F.greatest(c, F.lit(0).cast(MONEY)).cast(lots.UNITS)
    return rows.select("account", "month", *ORDER, "kind", units(F.col("amount")).alias("entry"), units(-F.col("amount")).alias("exit"), (F.col("event_id") % 17 + 1).cast("decimal(9,0)").alias("cost"))


@query(
    f"""
with {_LOTS},
e as (select account, event_id, eff, lag(eff, 1, 0) over (partition by account order by ts, event_id) as from_ from cov where leave > 0)
select l.account, l.event_id as lot, e.event_id as exit_event, cast(least(l.cin, e.eff) - greatest(l.cin - l.entry, e.from_) as double) as quantity
from cov l join e on l.account = e.account and l.entry > 0 and l.cin - l.entry < e.eff and e.from_ < l.cin and e.eff > e.from_"""
)
def fifo_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which exit takes how many units of which lot."""
    out = lots.applications(lot_events(spark, sf_dir), ["account"], "month", ORDER)
    return out.select("account", F.col("lot.event_id").alias("lot"), F.col("exit_row.event_id").alias("exit_event"), F.col("quantity").cast("double").alias("quantity"))


@query(
    f"""
with {_LOTS},
u as (select account, coalesce(max(eff) filter (where leave > 0), 0) as used from cov group by account),
l as (select account, greatest(0, least(entry, cin - used)) as rest, cost from cov join u using (account) where entry > 0)
select account, cast(sum(rest) as double) as units, cast(cast(round(sum(rest * cost), 2) as decimal(18,2)) as double) as cost, count(*) filter (where rest > 0) as open_lots from l group by account"""
)
def fifo_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units left, their cost and the open lots of every account."""
    out = lots.positions(lot_events(spark, sf_dir), ["account"], "month", ORDER, "cost")
    return out.select("account", F.col("units").cast("double").alias("units"), F.col("cost").cast("double").alias("cost"), "open_lots")


def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot events with a price for exits, the exit's amount in cents, and the day."""
    price = (F.col("event_id") % 13 + 5).cast("decimal(9,0)")
    return lot_events(spark, sf_dir).withColumns({"price": price, "day": F.col("ts").cast("date"), "amount": F.round(F.col("exit") * price, 2).cast(MONEY)})


_SLICES = f"""{_LOTS},
e as (select account, ts, event_id, leave, eff, lag(eff, 1, 0) over (partition by account order by ts, event_id) as from_, (event_id % 13 + 5) as price, cast(round(leave * (event_id % 13 + 5), 2) as decimal(18,2)) as amount from cov where leave > 0),
sl as (select l.account, l.ts as lot_ts, l.event_id as lot, e.event_id as exit_event, e.amount, l.cost, e.price, least(l.cin, e.eff) - greatest(l.cin - l.entry, e.from_) as q
  from cov l join e on l.account = e.account and l.entry > 0 and l.cin - l.entry < e.eff and e.from_ < l.cin and e.eff > e.from_)"""


@query(
    f"""
with {_SLICES},
p as (select *, cast(round(q * price, 2) as decimal(18,2)) as plain, row_number() over (partition by account, exit_event order by lot_ts desc, lot desc) as k, sum(cast(round(q * price, 2) as decimal(18,2))) over (partition by account, exit_event) as total from sl)
select account, lot, exit_event, cast(q as double) as quantity, cast(cast(round(q * cost, 2) as decimal(18,2)) as double) as cost, cast(cast(round(q * (price - cost), 2) as decimal(18,2)) as double) as interest,
  cast(case when k = 1 then amount - (total - plain) else plain end as double) as amount from p"""
)
def exit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slice of a lot that an exit takes: its cost, its interest over the lot's unit value, and its amount; the last slice takes the rest of the exit's amount."""
    out = lots.slices(priced_events(spark, sf_dir), ["account"], "month", ORDER, "cost", "price", "amount")
    return out.select("account", F.col("lot.event_id").alias("lot"), F.col("exit_row.event_id").alias("exit_event"), *[F.col(c).cast("double").alias(c) for c in ("quantity", "cost", "interest", "amount")])


@query(
    f"""
with {_SLICES},
g as (select account, exit_event, sum(q) as covered, sum(q * cost) as c, sum(q * (price - cost)) as i from sl group by all),
j as (select e.account, e.event_id, e.leave, e.amount, coalesce(g.covered, 0) as covered, coalesce(g.c, 0) as c, coalesce(g.i, 0) as i from e left join g on e.account = g.account and e.event_id = g.exit_event)
select account, event_id, cast(covered as double) as covered, cast(cast(round(c, 2) as decimal(18,2)) as double) as cost, cast(cast(round(i, 2) as decimal(18,2)) as double) as interest,
  case when covered = 0 then 0 else cast(cast(round(amt - c, 2) as decimal(18,2)) as double) end as result,
  cast(amount - cast(round(c, 2) as decimal(18,2)) as double) as full_result,
  case when covered < leave then 'SIN_STOCK' else 'SALIDA' end as state
from (select *, case when covered < leave then cast((2 * cast(amount * 100 as hugeint) * cast(covered * 1000000 as hugeint) + cast(leave * 1000000 as hugeint)) // (2 * cast(leave * 1000000 as hugeint)) as decimal(18,2)) * cast(0.01 as decimal(3,2)) else amount end as amt from j)"""
)
def exit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exit: units that lots cover, their cost, interest, the result on what is covered and on the full exit, and whether units were missing."""
    out = lots.exit_results(priced_events(spark, sf_dir), ["account"], "month", ORDER, "cost", "price", "amount")
    return out.select("account", "event_id", *[F.col(c).cast("double").alias(c) for c in ("covered", "cost", "interest", "result", "full_result")], "state")


@query(
    f"""
with {_LOTS},
u as (select account, coalesce(max(eff) filter (where leave > 0), 0) as used from cov group by account),
l as (select account, cast(ts as date) as day, cost, greatest(0, least(entry, cin - used)) as rest from cov join u using (account) where entry > 0)
select account, day, cast(cost as double) as unit_value, case when cost < 3 then 'Saldo inicial' else 'Suscripción' end as origin, cast(cast(round(sum(rest), 4) as decimal(28,4)) as double) as units, cast(cast(round(sum(rest * cost), 2) as decimal(18,2)) as double) as cost
from l where rest > 0 group by account, day, l.cost"""
)
def open_lots_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lots of a day, unit value and origin as one row."""
    return _consolidated(spark, sf_dir).select("account", "day", F.col("unit_value").cast("double").alias("unit_value"), "origin", F.col("units").cast("double").alias("units"), F.col("cost").cast("double").alias("cost"))


def _consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots.open_lots(priced_events(spark, sf_dir), ["account"], "month", ORDER).withColumn("origin", F.when(F.col("cost") < 3, "Saldo inicial").otherwise("Suscripción"))
    return lots.consolidated(rows, ["account"], "day", "cost", "origin")


@query(
    f"""
with {_LOTS},
u as (select account, coalesce(max(eff) filter (where leave > 0), 0) as used from cov group by account),
l as (select account, cast(ts as date) as day, cost, greatest(0, least(entry, cin - used)) as rest from cov join u using (account) where entry > 0),
g as (select account, cast(round(sum(rest), 4) as decimal(28,4)) as units, cast(round(sum(rest * cost), 2) as decimal(18,2)) as cost from l where rest > 0 group by account, day, l.cost),
h as (select account, sum(units) as units, sum(cost) as cost, cast(round(sum(units) * cast(9.25 as decimal(9,2)), 2) as decimal(18,2)) as value from g group by account)
select account, cast(units as double) as units, cast(cost as double) as cost, cast(value as double) as value, cast(value - cost as double) as result from h"""
)
def holding_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the open lots of an account are worth at a closing value of 9.25 a unit, and the result of holding them."""
    out = lots.holding_result(_consolidated(spark, sf_dir), ["account"], F.lit("9.25").cast("decimal(9,2)"))
    return out.select("account", *[F.col(c).cast("double").alias(c) for c in ("units", "cost", "value", "result")])


def _rounded(n: str, d: str) -> str:
    """n / d to the nearest whole number, halves away from 0, as integers."""
    return f"(sign({n}) * ((2 * abs({n}) + ({d})) // (2 * ({d}))))"


def _average(keys: str) -> str:
    """States of positions at moving average cost, step by step: units in cents, rates in units of 1e-10."""
    e4, e10 = "10000::hugeint", "10000000000::hugeint"
    return f"""mv as (
  select user_id as account, event_type in ('purchase', 'login') as physical, ts, event_id, event_type in ('purchase', 'signup') as is_in, cast(cast(value as decimal(18,2)) * 100 as hugeint) as m, cast((event_id % 17 + 1) * 100000000 as hugeint) as r from events where cast(value as decimal(18,2)) > 0),
nu as (select *, row_number() over (partition by {keys} order by ts, event_id) as k from mv),
st as (
  select {keys}, 0::bigint as k, 0::bigint as event_id, 0::hugeint as units, 0::hugeint as rate, 0::hugeint as result from (select distinct {keys} from nu)
  union all
  select {", ".join(f"nu.{x.strip()}" for x in keys.split(","))}, nu.k, nu.event_id, case when is_in then units + m else units - m end,
    case when not is_in then rate when units > 0 and rate > 0 then {_rounded(f"(units * rate + m * r * {e4})", "units + m")} else r * {e4} end,
    case when is_in then 0::hugeint else {_rounded(f"(m * (r * {e4} - rate))", e10)} end
  from st join nu on {" and ".join(f"st.{x.strip()} = nu.{x.strip()}" for x in keys.split(","))} and nu.k = st.k + 1)"""


@query(
    f"""
with recursive {_average("account")}
select account, event_id, cast(units as double) / 100 as units, cast({_rounded("rate", "10000::hugeint")} as double) / 1000000 as rate, cast(result as double) / 100 as result from st where k > 0"""
)
def average_cost_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every account at moving average cost, after each movement."""
    out = currency.average_cost(_dollar_moves(spark, sf_dir), ["account"], ORDER, "amount", "rate", "is_entry", "month")
    return out.select("account", "event_id", *[F.col(c).cast("double").alias(c) for c in ("units", "rate", "result")])


def _dollar_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    physical = F.col("kind").isin("purchase", "login").alias("physical")
    return lot_events(spark, sf_dir).select("account", "month", *ORDER, (F.col("entry") + F.col("exit")).cast(MONEY).alias("amount"), (F.col("cost") * 100).cast("decimal(18,6)").alias("rate"), (F.col("entry") > 0).alias("is_entry"), physical)


@query(
    f"""
with recursive {_average("account, physical")},
c as (select st.account, st.physical, nu.ts, st.event_id, cast(st.units as hugeint) * cast({_rounded("st.rate", "10000::hugeint")} as hugeint) as worth from st join nu on st.account = nu.account and st.physical = nu.physical and st.k = nu.k where st.k > 0),
w as (select *, coalesce(last_value(case when physical then worth end ignore nulls) over o, 0) as a, coalesce(last_value(case when not physical then worth end ignore nulls) over o, 0) as b from c window o as (partition by account order by ts, event_id rows unbounded preceding))
select account, event_id, physical, cast({_rounded("(a + b)", "1000000::hugeint")} as double) / 100 as cost from w"""
)
def pockets_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost in pesos of both dollar pockets of an account, physical and bank, after each movement of either."""
    moves = _dollar_moves(spark, sf_dir)
    done = currency.average_cost(moves, ["account", "physical"], ORDER, "amount", "rate", "is_entry", "month")
    out = currency.both_pockets(done.withColumn("month", F.trunc("ts", "MM")), ["account"], "month", ORDER, "physical", "units", "rate")
    return out.select("account", "event_id", "physical", F.col("cost").cast("double").alias("cost"))


_OUT = ("interest", "capital", "vat", "due", "balance")


def _loan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice"))
    return p.select("p_partkey", F.col("p_retailprice").cast(MONEY).alias("capital"), F.col("p_size").alias("n"), F.lit(0.36).alias("rate"), F.lit("2024-01-31").cast("date").alias("start"))


@query(
    """
with recursive l as (select p_partkey, cast(p_retailprice as decimal(18,2)) as cap, p_size as m,
  cast(round(cast(cast(cast(p_retailprice as decimal(18,2)) as double) * (0.36::double / 12) / (1 - pow(1 + 0.36::double / 12, -p_size)) as decimal(28,10)), 8) as decimal(28,8)) as pay from part where p_size > 0),
s as (
  select p_partkey, m, pay, 0 as n, cast(0 as decimal(18,2)) as interest, cast(0 as decimal(18,2)) as capital, cap as balance from l
  union all
  select p_partkey, m, pay, n + 1, i, cast(case when n + 1 = m then balance else round(pay - i, 2) end as decimal(18,2)), cast(balance - case when n + 1 = m then balance else round(pay - i, 2) end as decimal(18,2))
  from (select *, cast(round(balance * cast(0.03 as decimal(9,4)), 2) as decimal(18,2)) as i from s where n < m)),
v as (select *, cast(round(interest * cast(0.21 as decimal(9,4)), 2) as decimal(18,2)) as vat from s where n > 0)
select p_partkey, n, cast(interest as double) as interest, cast(capital as double) as capital, cast(vat as double) as vat, cast(capital + interest + vat as double) as due, cast(greatest(balance, 0) as double) as balance,
  cast(last_day(date '2024-01-01' + to_months(cast(n - 1 as integer))) as date) as due_date from v"""
)
def french_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loan for every part: its price over its size in months, in equal payments."""
    out = loans.french(_loan_rows(spark, sf_dir), ["p_partkey"], "capital", "n", "rate", "start")
    return out.select("p_partkey", "n", *[F.col(c).cast("double").alias(c) for c in _OUT], "due_date")


@query(
    """
with l as (select p_partkey, cast(p_retailprice as decimal(18,2)) as cap, p_size as m, cast((2 * cast(round(p_retailprice * 100) as bigint) + p_size) // (2 * p_size) as decimal(18,2)) * cast(0.01 as decimal(3,2)) as part from part where p_size > 0),
r as (select *, unnest(range(1, m + 1)) as n from l),
s as (select *, cap - cast(n - 1 as decimal(9,0)) * part as before from r),
t as (select *, case when n = m then before else part end as capital, cast(round(cast(before as decimal(18,2)) * cast(0.03 as decimal(9,4)), 2) as decimal(18,2)) as interest from s),
u as (select *, cast(round(interest * cast(0.21 as decimal(9,4)), 2) as decimal(18,2)) as vat from t)
select p_partkey, cast(n as integer) as n, cast(interest as double) as interest, cast(capital as double) as capital, cast(vat as double) as vat, cast(capital + interest + vat as double) as due, cast(greatest(before - capital, 0) as double) as balance,
  cast(last_day(date '2024-01-01' + to_months(cast(n - 1 as integer))) as date) as due_date from u"""
)
def german_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loan for every part: its price over its size in months, in equal parts of capital."""
    out = loans.german(_loan_rows(spark, sf_dir), ["p_partkey"], "capital", "n", "rate", "start")
    return out.select("p_partkey", "n", *[F.col(c).cast("double").alias(c) for c in _OUT], "due_date")


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as employees: base from the balance or a scale by segment, years and absences from the key."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    scale = F.when(F.col("c_mktsegment") == "BUILDING", 1000).when(F.col("c_mktsegment") == "MACHINERY", 1500)
    rules = F.create_map(F.lit("antiguedadPorAnioPct"), F.when(F.col("c_custkey") % 2 == 0, "1").otherwise("2"), F.lit("jubilacionPct"), F.when(F.col("c_custkey") % 3 == 0, "bad").otherwise("11"))
    return c.select(
        "c_custkey",
        scale.cast(MONEY).alias("base_scale"),
        F.col("c_acctbal").cast(MONEY).alias("base_file"),
        (F.col("c_custkey") % 31).cast("int").alias("years"),
        (F.col("c_custkey") % 4).cast("int").alias("absences"),
        (F.col("c_custkey") % 9).cast("decimal(9,2)").alias("overtime"),
        (F.col("c_custkey") % 5 * 10).cast(MONEY).alias("extra"),
        rules.alias("rules"),
    )


def _div(amount: str, by: int) -> str:
    """An amount that is not negative by a whole number, half up, in whole cents."""
    return f"cast((2 * cast(({amount}) * 100 as bigint) + {by}) // {2 * by} as decimal(18,2)) * cast(0.01 as decimal(3,2))"


_R = "cast(round({0}, 2) as decimal(18,2))"


@query(
    f"""
with e as (select c_custkey, cast(coalesce(case c_mktsegment when 'BUILDING' then 1000 when 'MACHINERY' then 1500 end, case when c_acctbal > 0 then cast(c_acctbal as decimal(18,2)) end, 0) as decimal(18,2)) as base,
  c_custkey % 31 as y, c_custkey % 4 as ab, cast(c_custkey % 9 as decimal(9,2)) as he, cast(c_custkey % 5 * 10 as decimal(18,2)) as other,
  cast(case when c_custkey % 2 = 0 then 1 else 0.02 end as decimal(18,6)) as ant from customer),
a as (select *, {_R.format("base * cast(y as decimal(9,0)) * ant")} as seniority from e),
b as (select *, base + seniority as t, {_div("base + seniority", 12)} as att, {_div("base + seniority", 200)} as hour, {_div("(base + seniority) * ab", 30)} as cut from a),
c as (select *, case when ab = 0 then att else 0 end as attendance, {_R.format("hour * cast(1.5 as decimal(9,4)) * he")} as ot from b),
g as (select *, cast(t + attendance + ot - cut as decimal(18,2)) as gross from c),
d as (select *, {_R.format("gross * cast(0.11 as decimal(18,6))")} as p1, {_R.format("gross * cast(0.03 as decimal(18,6))")} as p2, {_R.format("gross * cast(0.02 as decimal(18,6))")} as p4 from g)
select c_custkey, cast(base as double) as base, cast(seniority as double) as seniority, cast(gross as double) as gross, cast(p1 + 2 * p2 + p4 as double) as deductions, cast(gross + other - p1 - 2 * p2 - p4 as double) as net from d"""
)
def payroll_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payroll.payroll(employees(spark, sf_dir))
    return out.select("c_custkey", *[F.col(c).cast("double").alias(c) for c in ("base", "seniority", "gross", "deductions", "net")])
