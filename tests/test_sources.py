"""A database, learned rates, numbers within keys."""

import random
import uuid

from pyspark.sql import functions as F

from abacusflow.operators import figures, proration, running
from abacusflow.sources import tables


def test_database_in_ranges_with_filters_pushed(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(k, k % 7, f"n{k}") for k in range(200)], "ID long, KIND int, NAME string")
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "T").option("createTableColumnTypes", "NAME varchar(20)").save()
    found = tables.read_jdbc(spark, url, "T", "ID", 0, 200, 4, driver=driver)
    assert found.rdd.getNumPartitions() == 4
    wanted = found.where("KIND = 3 and ID < 100").select("NAME")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(KIND,3)" in plan.replace("*", "") and "ReadSchema: struct<NAME:string>" in plan
    assert sorted(r["NAME"] for r in wanted.collect()) == sorted(f"n{k}" for k in range(100) if k % 7 == 3)


def test_the_last_rate_that_is_known(spark):
    rows = spark.createDataFrame([("a", 1, 21.0), ("a", 2, 10.5), ("a", 3, None), ("b", 1, None), (None, 1, 27.0), ("c", 1, 27.0)], "code string, day int, rate double")
    assert {r["code"]: r["rate"] for r in proration.learned_rates(rows, "code", "rate", ["day"]).collect()} == {"a": 10.5, "c": 27.0}


def test_numbers_within_keys_of_any_size(spark):
    r = random.Random(2)
    rows = [(None if k % 50 == 0 else "hot" if r.random() < 0.6 else r.choice("abc"), r.randrange(40), k) for k in range(600)]
    found = running.numbered(spark.createDataFrame(rows, "k string, x int, id int").repartition(3), ["k"], [F.col("x").desc(), "id"], "n")
    wanted = {}
    for key in {k for k, *_ in rows}:
        for n, row in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (-x[1], x[2])), 1):
            wanted[row[2]] = n
    assert {q["id"]: q["n"] for q in found.collect()} == wanted
    assert found.columns == ["k", "x", "id", "n"]


def test_numbers_go_on(spark):
    there = spark.createDataFrame([("a", 4), ("b", 0)], "k string, number long")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("c", 9)], "k string, o int")
    assert {(r["k"], r["o"]): r["number"] for r in figures.numbered_on(there, new, ["k"], "number", ["o"]).collect()} == {("a", 1): 5, ("a", 2): 6, ("c", 9): 0}
