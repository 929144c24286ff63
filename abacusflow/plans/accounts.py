"""Queries on charts of accounts and on securities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import accounts, securities
from ..sources.scratch import stored
from .inputs import read
from .registry import query

_CHART = """ch as (select cast(r_regionkey as varchar) as code, r_name as name, false as postable from region
  union all select cast(n_regionkey as varchar) || lpad(cast(n_nationkey as varchar), 2, '0'), n_name, false from nation
  union all select cast(n_regionkey as varchar) || lpad(cast(n_nationkey as varchar), 2, '0') || lpad(cast(c_custkey as varchar), 8, '0'), c_name, true from customer join nation on c_nationkey = n_nationkey),
en as (select o_orderkey as entry, cast(o_totalprice as decimal(18,2)) as total, cast(n_regionkey as varchar) || lpad(cast(n_nationkey as varchar), 2, '0') || case when o_orderkey % 50 = 0 then '' else lpad(cast(c_custkey as varchar), 8, '0') end as code
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, postable: regions, nations below them, customers below these; only customers take entries."""
    nation = F.concat(F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    r, n = read(spark, sf_dir, "region", "r_regionkey", "r_name"), read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    out = r.select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"), F.lit(False).alias("postable"))
    out = out.unionByName(n.select(nation.alias("code"), F.col("n_name").alias("name"), F.lit(False).alias("postable")))
    return out.unionByName(c.select(F.concat(nation, F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("code"), F.col("c_name").alias("name"), F.lit(True).alias("postable")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, code, total: every order on its customer's account, each fiftieth on the nation's."""
    o, n = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    nation = F.concat(F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    code = F.concat(nation, F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.lpad(F.col("c_custkey").cast("string"), 8, "0")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("entry"), code.alias("code"), F.col("o_totalprice").cast(MONEY).alias("total"))


@query(
    f"""
with recursive {_CHART},
pa as (select a.code, arg_max(b.code, length(b.code)) as parent from ch a join ch b on starts_with(a.code, b.code) and a.code <> b.code group by a.code),
up as (select code, code as ancestor, 0 as steps from ch union all select up.code, pa.parent, steps + 1 from up join pa on up.ancestor = pa.code),
lv as (select code, max(steps) as level from up group by code),
ow as (select code, sum(total) as own from en group by code),
to_ as (select ancestor as code, sum(own) as total from up join ow using (code) group by ancestor)
select ch.code, ch.name, level, ch.code not in (select parent from pa) as leaf, cast(coalesce(own, 0) as double) as own, cast(coalesce(to_.total, 0) as double) as total from ch join lv using (code) left join ow using (code) left join to_ using (code)"""
)
def account_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's balance by its own entries, and with all accounts below it."""
    lines = entries(spark, sf_dir).withColumn("credit", F.lit(0).cast(MONEY))
    out = accounts.rolled_up(lines, stored(accounts.with_parents(chart(spark, sf_dir))), "code", "total", "credit")
    return out.withColumns({"own": F.col("own").cast("double"), "total": F.col("total").cast("double")})


@query(
    f"""
with {_CHART},
li as (select entry, code, total, total - case when entry % 11 = 0 then 9 when entry % 7 = 0 then 0.03 else 0 end as credit from en)
select entry, case when entry % 50 = 0 then 'NO IMPUTABLE' when entry % 11 = 0 then 'DESBALANCEADO' else 'LISTO' end as state,
  cast(case when entry % 50 > 0 and entry % 11 > 0 then credit else total end as double) as debit, cast(credit as double) as credit from li"""
)
def entries_for_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two lines as they may be exported: closed accounts stop them, cents are taken off the heavier side."""
    rows = stored(entries(spark, sf_dir))
    zero, key = F.lit(0).cast(MONEY), F.col("entry")
    less = F.when(key % 11 == 0, F.lit("9")).when(key % 7 == 0, F.lit("0.03")).otherwise(F.lit("0")).cast(MONEY)
    lines = rows.select("entry", F.lit(1).alias("line"), "code", F.col("total").alias("debit"), zero.alias("credit"))
    lines = lines.unionByName(rows.select("entry", F.lit(2).alias("line"), F.lit("sales").alias("code"), zero.alias("debit"), (F.col("total") - less).cast(MONEY).alias("credit")))
    out = accounts.exported(lines, chart(spark, sf_dir), ["entry"], ["line"], "code", "debit", "credit")
    return out.groupBy("entry").agg(F.min("state").alias("state"), F.sum("debit").cast("double").alias("debit"), F.sum("credit").cast("double").alias("credit"))


@query(
    """
with p as (select p_partkey, p_size, p_name, case p_partkey % 6 when 0 then 'AX' || p_size || 'D 2030' when 1 then 'bono AX' || p_size when 2 then p_name || ' cedear' when 3 then 'Fima ' || p_name when 4 then p_brand || ' 1' else '' end as name from part),
tk as (select distinct 'AX' || p_size as t from part union select distinct 'AX' || p_size || 'D' from part where p_size % 2 = 0),
b as (select name, arg_max(t, length(t)) as t from (select distinct name, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as bare from p) join tk on starts_with(bare, t) or list_contains(string_split(upper(name), ' '), t) group by name)
select p_partkey, case p_partkey % 6 when 0 then b.t when 1 then b.t when 2 then p.name when 3 then case when contains(lower(p_name), 'ring') then 'ANILLOS' else upper(p.name) end when 4 then p.name else 'USD' end as canonical,
  case p_partkey % 6 when 0 then 'bono' when 1 then 'bono' when 2 then 'accion' when 3 then 'fci' when 4 then 'otro' else 'usd_mep' end as kind,
  case when p_partkey % 6 = 4 then 'revisar' else 'alta' end as confidence,
  case p_partkey % 6 when 0 then 'Título público ' || b.t when 1 then 'Título público ' || b.t when 2 then 'Cedear' when 3 then 'Alias FIMA / FCI' when 4 then 'No identificado' else 'Operación MEP — usar Caja USD' end as reason
from p left join b on b.name = p.name"""
)
def security_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which security each part's line is about, by tickers and aliases that the table itself gives, and by words."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(key % 6 == 0, F.concat(F.lit("AX"), size, F.lit("D 2030"))).when(key % 6 == 1, F.concat(F.lit("bono AX"), size)).when(key % 6 == 2, F.concat("p_name", F.lit(" cedear"))).when(key % 6 == 3, F.concat(F.lit("Fima "), "p_name")).when(key % 6 == 4, F.concat("p_brand", F.lit(" 1"))).otherwise("")
    rows = p.select("p_partkey", name.alias("name"), F.lit(None).cast("string").alias("description"), F.when(key % 6 == 5, "Compra MEP").alias("operation"), F.lit("ARS").alias("currency"))
    catalogue = p.select(F.concat(F.lit("AX"), size).alias("ticker")).unionByName(p.where("p_size % 2 = 0").select(F.concat(F.lit("AX"), size, F.lit("D")).alias("ticker")))
    aliases = p.select(F.lit(1).alias("priority"), F.array(F.lit("ring"), F.lit("fima")).alias("words"), F.lit("ANILLOS").alias("name")).distinct()
    out = securities.identified(rows, "name", "description", "operation", "currency", catalogue, aliases)
    return out.select("p_partkey", "security.canonical", "security.kind", "security.confidence", "security.reason")
