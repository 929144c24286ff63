import random
import time
from datetime import datetime, timedelta
from decimal import Decimal as D

from abacusflow.sources import versions
from abacusflow.streaming import incoming

SCHEMA = "id int, acc string, at timestamp, x double, balance double"


def rows(*told):
    return [(i, acc, datetime(2024, 1, day, hour), float(x), float(b)) for i, acc, day, hour, x, b in told]


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    first = rows((1, "a", 1, 1, 5, 5), (2, "a", 1, 2, 5, 10), (1, "a", 1, 1, 5, 5), (3, "b", 1, 3, 2, 2))
    second = rows((4, "a", 9, 1, 1, 11), (5, "b", 9, 1, 1, 30), (2, "a", 9, 2, 5, 16))
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = incoming.arriving(spark, path, SCHEMA)
    once = run(spark, incoming.without_repeats(stream, ["id"], "at"), "once")
    assert sorted(r["id"] for r in once) == [1, 2, 3, 4, 5]
    spark.createDataFrame(rows((9, "z", 28, 1, 0, 0)), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    days = run(spark, incoming.totals(incoming.arriving(spark, path, SCHEMA, 1), "at", ["acc"], "x"), "days")
    assert {(r["start"].day, r["acc"], r["n"]) for r in days} >= {(1, "a", 3), (1, "b", 1)}


def test_balances_that_break(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows((1, "a", 1, 1, 5, 5), (2, "a", 1, 2, 5, 10), (3, "b", 1, 3, 2, 2), (4, "a", 2, 1, 1, 11), (5, "b", 2, 1, 1, 30)), SCHEMA).coalesce(1).write.parquet(path)
    found = run(spark, incoming.breaks(incoming.arriving(spark, path, SCHEMA), "acc", "at", "x", "balance"), "broken")
    assert [(r["key"], r["expected"], r["told"]) for r in found] == [("b", 3.0, 30.0)]


def test_balances_in_any_order_of_arrival(spark, tmp_path):
    r = random.Random(3)
    schema = "acc string, at timestamp, n long, x decimal(18,2), balance decimal(18,2)"
    told, wanted = [], []
    for acc in "abc":
        balance = last = None
        for n in range(40):
            when, x = datetime(2024, 1, 1) + timedelta(hours=6 * n), D(r.randint(-500, 500)) / 100
            balance = (balance or D(0)) + x + (D("1.00") if r.random() < 0.15 and n else D(0))
            if last is not None and last + x != balance:
                wanted.append((acc, n, int((last + x) * 100), int(balance * 100)))
            told.append((acc, when, n, x, balance))
            last = balance
    told.sort(key=lambda t: t[1] + timedelta(hours=r.randrange(40)))  # at most 40 hours late
    told.append(("z", datetime(2024, 6, 1), 0, D(0), D(0)))
    path = str(tmp_path / "in")
    for k in range(0, len(told), 13):
        spark.createDataFrame(told[k : k + 13], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    stream = incoming.arriving(spark, path, schema, 1)
    found = run(spark, incoming.ordered_breaks(stream, "acc", "at", "n", "x", "balance"), "ordered")
    assert sorted((q["key"], q["number"], q["expected"], q["told"]) for q in found) == sorted(wanted)


def test_batches_are_merged_once(spark, tmp_path):
    folder, schema = str(tmp_path / "table"), "k long, at long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = lambda v=None: {r["k"]: r["v"] for r in versions.read_table(spark, folder, frame([]).schema, v).collect()}
    assert table() == {}
    assert versions.merge_batch(frame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c"), (9, 1, "z")]), 0, folder, ["k"], ["at"], 4)
    assert table() == {1: "c", 2: "b", 9: "z"}
    assert versions.merge_batch(frame([(2, 5, "new"), (3, 1, "d")]), 1, folder, ["k"], ["at"], 4)
    assert not versions.merge_batch(frame([(2, 5, "again")]), 1, folder, ["k"], ["at"], 4)
    assert not versions.merge_batch(frame([(2, 5, "old")]), 0, folder, ["k"], ["at"], 4)
    assert table() == {1: "c", 2: "new", 3: "d", 9: "z"} and table(0) == {1: "c", 2: "b", 9: "z"}
    # a batch that failed before its manifest was complete is as if it had never been
    frame([(7, 7, "half")]).write.parquet(f"{folder}/data/v2/bucket=0")
    assert table() == {1: "c", 2: "new", 3: "d", 9: "z"}
    assert versions.merge_batch(frame([(7, 7, "whole")]), 2, folder, ["k"], ["at"], 4)
    assert table()[7] == "whole"
    for v in (3, 4):
        versions.merge_batch(frame([(k, v, f"v{v}") for k in range(20)]), v, folder, ["k"], ["at"], 4)
    assert versions.vacuum(spark, folder, 1) == [0, 1, 2, 3] and versions.versions(spark, folder) == [4]
    assert set(table().values()) == {"v4"} and len(table()) == 20


def test_a_stream_that_starts_again_merges_nothing_twice(spark, tmp_path):
    path, folder, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    schema = "k long, at long, v string"
    for k in range(3):
        spark.createDataFrame([(1, k, f"{k}"), (k + 10, k, "own")], schema).coalesce(1).write.mode("append").parquet(path)
    for again in range(2):
        stream = incoming.arriving(spark, path, schema, 1)
        # the second time the stream has forgotten what it did
        q = stream.writeStream.foreachBatch(versions.merging(folder, ["k"], ["at"], 2)).option("checkpointLocation", f"{log}{again}").start()
        q.processAllAvailable()
        q.stop()
        assert versions.versions(spark, folder) == [0, 1, 2]
        rows = versions.read_table(spark, folder, spark.createDataFrame([], schema).schema).collect()
        assert {r["k"]: r["v"] for r in rows} == {1: "2", 10: "own", 11: "own", 12: "own"}
