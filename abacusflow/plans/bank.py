"""Queries on bank movements: classification, running balances, monthly control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import MONEY, MODES
from ..operators import dedup, ledger, reports, rules
from .inputs import MOVEMENTS, ORDER, STATEMENT, movements, read, statement
from .registry import query

#: Rules over the words of part names: pattern, category, kind, rank, active.
RULES = [
    ("ring", "Joyas", "DEBITO_FIJO", 3, True),
    ("small", "Menudencias", "DEBITO_FIJO", 1, True),
    ("LARGE", "Bultos", "DEBITO_PROVEEDOR", 2, True),
    ("", "Nada", "DEBITO_FIJO", 0, True),
    ("a", "Inactiva", "DEBITO_FIJO", 0, False),
    ("é", "Con e", "INGRESO", 9, True),
]
_RULES_SQL = ", ".join(f"('{p}', '{c}', '{k}', {r})" for p, c, k, r, a in RULES if a and p)
HINTS = [("Joyas", "11301"), ("Bultos", "21101")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "pattern string, category string, kind string, rank int, active boolean")


@query(
    f"""
with r(p, category, kind, rank) as (values {_RULES_SQL}),
hit as (select p_partkey, arg_min(r.category, rank) as category, arg_min(r.kind, rank) as kind from part, r where contains(upper(strip_accents(p_name)), upper(strip_accents(r.p))) group by p_partkey)
select p.p_partkey, coalesce(category, 'Otros gastos (sin clasificar)') as category, coalesce(kind, 'DEBITO_REVISAR') as kind,
  case category when 'Joyas' then '11301' when 'Bultos' then '21101' else '99999' end as account
from part p left join hit using (p_partkey)"""
)
def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name by ordered rules, and the account its category hints at."""
    done = rules.classify(read(spark, sf_dir, "part", "p_partkey", "p_name"), rule_table(spark), "p_name")
    done = rules.account_hint(done, spark.createDataFrame(HINTS, "category string, account string"))
    return done.select("p_partkey", "category", "kind", "account")


@query(
    f"""
with {MOVEMENTS}
select coalesce(kind, 'TOTAL') as category, count(*) as n, cast(sum(greatest(amount, 0)) as double) as credits, cast(sum(greatest(-amount, 0)) as double) as debits, cast(sum(amount) as double) as net
from mov group by rollup(kind)"""
)
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    rows = movements(spark, sf_dir).select(F.col("kind").alias("category"), F.greatest("amount", zero).alias("credit"), F.greatest(-F.col("amount"), zero).alias("debit"))
    out = reports.by_category(rows, "category", "credit", "debit")
    return out.select("category", "n", *[F.col(c).cast("double").alias(c) for c in ("credits", "debits", "net")])


@query(
    f"""
with {STATEMENT},
judged as (select *, abs(prev + amount - balance) > 0.05 as bad from known)
select account, count(*) as n_rows, count(*) filter (where bad) as n_bad, arg_min(event_id, ts) filter (where bad) as first_bad from judged group by account"""
)
def balance_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.validate(statement(spark, sf_dir), ["account"], "month", ORDER, "amount", "balance")
    return out.select("account", "n_rows", "n_bad", F.col("first_bad.event_id").alias("first_bad"))


_REPAIRED = (
    STATEMENT
    + """,
rep as (select *, case when balance is null then amount when prev is null then amount when abs(balance - prev) < 0.005 then 0
  when abs(amount - (balance - prev)) > 0.05 then balance - prev else amount end as repaired from known)"""
)


@query(f"with {_REPAIRED} select event_id, cast(repaired as double) as repaired, coalesce(repaired <> amount, false) as changed from rep")
def balance_chain_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.repair_chain(statement(spark, sf_dir), ["account"], "month", ORDER, "amount", "balance")
    return out.select("event_id", F.col("repaired").cast("double").alias("repaired"), (F.col("repaired") != F.col("amount")).alias("changed"))


_CONTROL = (
    _REPAIRED
    + """,
place as (select *, row_number() over (partition by account, month order by ts, event_id) as k from rep),
ctl as (select account, month, arg_min(balance - repaired, k) filter (where balance is not null) as opening,
  sum(greatest(repaired, 0)) as credits, sum(greatest(-repaired, 0)) as debits,
  arg_max(balance, k) filter (where balance is not null) as closing, count(*) as n_rows from place group by account, month),
full_ctl as (select *, opening + credits - debits as computed, closing - (opening + credits - debits) as difference from ctl)"""
)


@query(
    f"""
with {STATEMENT},
u as (select *, abs(amount) as plain from known)
select account, event_id, coalesce(case when abs(balance - prev - plain) <= 0.05 then true when abs(balance - prev + plain) <= 0.05 then false end, kind in ('purchase', 'signup')) as is_credit from u"""
)
def sides_from_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each unsigned amount of a statement came in, from the balances around it, else from its kind."""
    rows = statement(spark, sf_dir).withColumn("plain", F.abs("amount"))
    out = rules.sides_from_balance(rows, ["account"], "month", ORDER, "plain", "balance", F.col("kind").isin("purchase", "signup"))
    return out.select("account", "event_id", "is_credit")


@query("select o_orderkey, o_orderpriority || case when k = 1 then '' else ' (' || k || ')' end as unique_name from (select *, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as k from orders)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders named after their priority, told apart by numbers."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate").withColumn("month", F.trunc("o_orderdate", "MM"))
    return dedup.unique_names(o, "o_orderpriority", ["o_orderdate", "o_orderkey"], "month").select("o_orderkey", "unique_name")


def _control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.repair_chain(statement(spark, sf_dir), ["account"], "month", ORDER, "amount", "balance")
    return ledger.monthly_control(rows, ["account"], "month", ORDER, "repaired", "balance")


_AMOUNTS = ("opening", "credits", "debits", "closing", "computed", "difference")
_AMOUNTS_SQL = ", ".join(f"cast({c} as double) as {c}" for c in _AMOUNTS)


@query(f"with {_CONTROL} select account, month, {_AMOUNTS_SQL}, n_rows, case when abs(difference) <= 0.05 then 'OK' else 'ERROR' end as state from full_ctl")
def monthly_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control(spark, sf_dir).select("account", "month", *[F.col(c).cast("double").alias(c) for c in _AMOUNTS], "n_rows", "state")


@query(
    f"""
with {_CONTROL},
near as (select *, case when lag(month) over w = month - interval 1 month and month(month) > 1 then opening - lag(closing) over w end as gap from full_ctl window w as (partition by account order by month))
select account, month, cast(gap as double) as gap, case when abs(gap) > 0.05 or difference is null or abs(difference) > 0.05 then 'ERROR' else 'OK' end as state from near"""
)
def month_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.continuity(_control(spark, sf_dir), ["account"], "month")
    return out.select("account", "month", F.col("gap").cast("double").alias("gap"), "state")


@query(
    f"""
with {_CONTROL},
r as (select *, coalesce(lag(closing) over (partition by account order by month), opening) as op from full_ctl)
select account, month, cast(op as double) as opening, cast(op + credits - debits as double) as computed, case when abs(closing - (op + credits - debits)) <= 0.05 then 'OK' else 'ERROR' end as state from r"""
)
def month_reinforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.reinforce(_control(spark, sf_dir), ["account"], "month")
    return out.select("account", "month", F.col("opening").cast("double").alias("opening"), F.col("computed").cast("double").alias("computed"), "state")




@query(
    """
with c as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c from orders)
select o_orderkey, cast(c as double) / 100 as argentine, cast(c as double) / 100 as english, cast(c as double) / 100 as scanned, cast(-c as double) / 100 as negative, cast((c // 100) as double) as thousands from c"""
)
def money_parse_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's total, written in several ways and read back."""
    cents = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    whole = F.format_number((F.col("c") / 100).cast("long"), 0)
    part = F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    swapped = F.translate(F.concat(whole, F.lit(";"), part), ",;", ".,")
    scanned = F.translate(F.concat(F.lit("$ "), F.replace(whole, F.lit(","), F.lit(".")), F.lit("."), part), "01", "ol")
    value = lambda raw, mode: MODES[mode](raw).cast("double")
    return cents.select(
        "o_orderkey",
        value(swapped, "decimal").alias("argentine"),
        value(F.concat(whole, F.lit("."), part), "decimal").alias("english"),
        value(scanned, "last_separator").alias("scanned"),
        value(F.concat(F.lit("("), swapped, F.lit(")")), "tolerant").alias("negative"),
        value(F.replace(whole, F.lit(","), F.lit(".")), "last_separator").alias("thousands"),
    )


@query(
    """
select doc_id, md5(trim(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as folded, length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits from documents"""
)
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without accents, in capitals, blanks collapsed."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"), F.length(T.digits(F.col("text"))).cast("long").alias("n_digits"))


@query(
    """
select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_extendedprice desc) as k
  from (select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice from lineitem)) where k = 1"""
)
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    return dedup.keep_one(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"])


@query(
    """
select l_returnflag, l_linestatus, cast(year(l_shipdate) as bigint) as ship_year, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total, grouping(l_returnflag, l_linestatus, ship_year) as level
from (select *, year(l_shipdate) as ship_year from lineitem) group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag, ship_year), (ship_year), ())"""
    .replace("cast(year(l_shipdate) as bigint) as ship_year", "cast(ship_year as bigint) as ship_year")
)
def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice")
    rows = rows.select("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("ship_year"), F.col("l_extendedprice").cast(MONEY).alias("v"))
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag", "ship_year"], ["ship_year"], []]
    return reports.in_sets(rows, sets, [F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total")]).select("l_returnflag", "l_linestatus", "ship_year", "n", "total", F.col("level").cast("long").alias("level"))


@query(
    """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(cast(json_extract_string(props, '$.k') as bigint) > 50, false) as high from events"""
)
def json_rules_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "props").withColumn("m", F.from_json("props", "map<string,string>"))
    k = F.element_at("m", F.lit("k")).try_cast("long")
    return rows.select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("high"))
