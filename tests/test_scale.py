"""Findings on larger tables: work per distinct value, small files dealt to all tasks, no whole side sent to every executor."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from abacusflow.functions import similarity, text
from abacusflow.operators import matching, readings
from abacusflow.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_name_is_scored_once_however_many_ask(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    def counted(a, b):
        def score(x, y):
            scored.add(1)
            return similarity.token_set(x, y)

        return F.udf(score, "double")(a, b)

    monkeypatch.setattr(similarity, "token_set_ratio", counted)
    dim = spark.createDataFrame([("Molinos del Sur SA", "1", "db1"), ("Aceros del Norte SA", "2", "db2"), ("Casa del Norte", None, "db3")], "name string, tax_id string, database string")
    told = [(k, "ACEROS DEL NORTE sa", ("", "1", "2", None)[k % 4], None) for k in range(400)] + [(400, "molinos", "2", None), (401, None, "2", None), (402, "casa norte", "9", "db1"), (403, "casa norte", "9", None), (404, "aceros norte del oeste", "2", None)]
    asked = spark.createDataFrame(told, "ask int, name string, tax_id string, database string")
    found = {r["ask"]: (r["found"], r["by"]) for r in readings.resolved_company(asked, dim).collect()}
    assert len(found) == 405 and all(found[k] == ("db2", "name") for k in range(400))
    assert found[400] == ("db1", "name") and found[401] == ("db2", "tax_id") and found[402] == ("db1", "database") and found[403] == ("db3", "name") and found[404] == ("db2", "name")
    assert 0 < scored.value <= 30, scored.value  # twelve pairs of names, each at most twice; 400 rows ask


def test_sheets_of_a_small_file_are_dealt_to_all_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(registry.queries()["loan_sheets"](spark, FOLDER))


def test_a_document_keeps_its_columns(spark):
    docs = spark.createDataFrame([(1, "a", "1 01/02/2024 1.000,00 2,50 0,00 1.002,50\n2 31/02/2024 1,00 2,00 3,00\n3 01/03/2024 1,00 2,00\n1 01/02/2024 9,00 9,00 9,00")], "d int, x string, t string")
    rows = [tuple(map(str, r)) for r in readings.schedule_lines(docs, "d", "t", ("x",)).orderBy("n").collect()]
    assert rows == [("1", "a", "1", "2024-02-01", "1000.00", "2.50", "1002.50"), ("1", "a", "2", "None", "1.00", "2.00", "3.00")]


def test_long_vouchers_keep_all_digits(spark):
    told = ["FC A 123456 - 7.", "3-123456789", "3 - 45 x", "1234567890123456789-1 y 2-3", "none"]
    rows = spark.createDataFrame(list(enumerate(told)), "k int, t string").select("k", text.voucher_in(F.col("t")).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in rows] == ["123456-00000007", "00003-123456789", "00003-00000045", "00002-00000003", None]


@pytest.mark.parametrize("name", ["loan_debit_match", "obligations_settled"])
def test_rows_of_few_bytes_are_not_sent_to_all(spark, name):
    told = plan(registry.queries()[name](spark, FOLDER))
    assert "SortMergeJoin" in told
    sent = [line for line in told.split("== Initial Plan ==")[-1].splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sent if "installment" in line or "obligation" in line or "debit" in line], sent


def test_pairs_meet_by_key_and_not_by_sending_a_side_to_all(spark):
    left, right = spark.createDataFrame([(1, 1.0)], "a int, x double"), spark.createDataFrame([(2, 1.5)], "b int, y double")
    pairs = matching.amount_band(left, right, "x", "y", 1.0)
    assert "BroadcastHashJoin" not in plan(pairs) and pairs.count() == 1


def test_schedules_of_a_small_file_are_dealt_to_all_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(registry.queries()["french_schedule"](spark, FOLDER))


def test_equal_pairs_of_names_are_scored_once_a_batch(monkeypatch):
    asked, real = [], similarity.token_set
    monkeypatch.setattr(similarity, "token_set", lambda a, b: asked.append((a, b)) or real(a, b))
    found = similarity._scores(pd.Series(["A B", "A B", None, "A B"]), pd.Series(["A C", "A C", "A", "A B"]))
    assert asked == [("A B", "A C"), ("", "A"), ("A B", "A B")] and found.tolist() == [real("A B", "A C")] * 2 + [0.0, 100.0]


def test_sets_of_a_pool_are_tried_where_it_lies(spark):
    told = plan(registry.queries()["withholding_combinations"](spark, FOLDER))
    assert "MapInArrow" in told and "_bn" not in told


def test_only_what_ranks_a_pair_goes_through_the_rounds(spark, monkeypatch):
    seen, real = [], matching.one_to_one
    monkeypatch.setattr(matching, "one_to_one", lambda pairs, *more: seen.append(pairs.columns) or real(pairs, *more))
    left, right = spark.createDataFrame([(1, 5.0, "x"), (2, 5.0, "y")], "a int, x double, t string"), spark.createDataFrame([(7, 5.0, "z")], "b int, y double, u string")
    passes = [("same", lambda p, q: matching.amount_band(p, q, "x", "y", 0.0), [-F.col("a")])]
    assert [tuple(r) for r in matching.staged(left, right, "a", "b", passes).collect()] == [(2, 7, "same")]
    assert seen == [["a", "b", "_order0"]]


def test_equal_amounts_meet_without_copies(spark):
    left, right = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "a int, x double"), spark.createDataFrame([(4, 1.0), (5, 1.005), (6, None), (7, float("nan"))], "b int, y double")
    pairs = matching.amount_band(left, right, "x", "y", 0.0)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 4)] and "Generate explode" not in plan(pairs)
