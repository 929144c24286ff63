"""A query on tables that are read from the places of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import grids
from ..sources.scratch import stored
from .inputs import read
from .registry import query


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line, x0, x1, text: orders printed as tables of ten papers, numbers to the right, some cells empty, some so wide that they run into the next column."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    key, doc = F.col("o_orderkey"), F.col("o_custkey") % 10
    rows = o.select(doc.alias("doc"), F.row_number().over(Window.partitionBy(doc).orderBy("o_orderkey")).cast("long").alias("line"), key.alias("key"), "o_custkey", "o_orderdate")
    units, value = F.col("key") % 1000 + 1, F.col("o_custkey") % 9 + F.lit("2.5").cast("decimal(3,1)")
    at = lambda x0, x1, text: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), text.alias("text"))
    to_right = lambda x1, text: F.struct((x1 - 5.0 * F.length(text)).alias("x0"), F.lit(float(x1)).alias("x1"), text.alias("text"))
    wide = F.col("key") % 9 == 0
    cells = F.array(
        at(20, 70, F.date_format("o_orderdate", "dd/MM/yyyy")),
        at(100, 152, F.when(F.col("key") % 2 == 0, "Suscripción").otherwise("Rescate")),
        at(156, 170, F.lit("FCI")),
        F.when(wide, at(174, 230, F.lit("extraordinario"))),
        F.when(~wide, to_right(260.0, units.cast("string"))),
        to_right(330.0, value.cast("decimal(9,2)").cast("string")),
        F.when((F.col("key") % 7 > 0) | wide, to_right(425.0, (units * value).cast("decimal(18,2)").cast("string"))),
    )
    body = rows.select("doc", "line", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("w")).select("doc", "line", "w.*")
    head = F.array(*[at(a, b, F.lit(t)) for a, b, t in ((20, 50, "Fecha"), (100, 150, "Concepto"), (200, 255, "Cuotapartes"), (300, 325, "Valor"), (380, 420, "Importe"))])
    return body.unionByName(rows.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("line"), F.explode(head).alias("w")).select("doc", "line", "w.*"))


@query(
    """
with r as (select o_custkey % 10 as doc, row_number() over (partition by o_custkey % 10 order by o_orderkey) as line, o_orderkey as key, o_orderkey % 1000 + 1 as u, cast(o_custkey % 9 + 2.5 as decimal(9,2)) as v, o_orderdate from orders)
select doc, line, strftime(o_orderdate, '%d/%m/%Y') as day, case when key % 2 = 0 then 'Suscripción' else 'Rescate' end || ' FCI' || case when key % 9 = 0 then ' extraordinario' else '' end as concept, cast(u as double) as units, cast(v as double) as unit_value, cast(u * v as double) as total from r"""
)
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of printed tables, their columns told by the gaps between words and their names by the header; units or totals that are missing worked out."""
    words = stored(printed(spark, sf_dir))
    cells = stored(grids.cells_of(words, grids.columns_of(words, ["doc"], "line", "x0", "x1"), ["doc"], "line", "x0", "x1", "text"))
    header = grids.header_map(cells, ["doc"], "line", grids.FUND_HEADERS, "date")
    rows = grids.mapped(cells, header, ["doc"], "line", ["date", "concept", "units", "value", "total"])
    number = lambda c, kind: F.col(c).try_cast(kind)
    units, total = grids.completed(number("units", "decimal(18,4)"), number("value", "decimal(18,2)"), number("total", "decimal(18,2)"))
    return rows.select("doc", "line", F.col("date").alias("day"), "concept", units.cast("double").alias("units"), number("value", "decimal(18,2)").cast("double").alias("unit_value"), total.cast("double").alias("total"))
