"""Incoming files and movements as streams: repeats dropped, totals by window, balances kept per account."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def totals(stream: DataFrame, at: str, keys: list[str], amount: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum per key and window, once the window is over."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def breaks(stream: DataFrame, key: str, at: str, amount: str, balance: str, tolerance: float = 0.05) -> DataFrame:
    """Rows whose balance is not the account's last balance plus their amount; the state of an account is one number."""
    kind = stream.schema[key].dataType.simpleString()

    def check(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(at)
        last = state.get[0] if state.exists else None
        out = []
        for when, x, told in zip(rows[at], rows[amount].astype(float), rows[balance].astype(float), strict=True):
            if last is not None and abs(last + x - told) > tolerance:
                out.append((name[0], when, last + x, told))
            last = told
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "expected", "told"])

    return stream.groupBy(key).applyInPandasWithState(check, f"key {kind}, at timestamp, expected double, told double", "last double", "append", GroupStateTimeout.NoTimeout)


def ordered_breaks(stream: DataFrame, key: str, at: str, number: str, amount: str, balance: str, late: str = "2 days", idle: str = "400 days", tolerance: str = "0.05") -> DataFrame:
    """As ``breaks``, for rows that arrive in any order within ``late``: (key, at, number, expected, told), in cents.

    Rows wait in their account's state until the watermark has passed their time, and
    are then checked in order of time and number, so the result is that of one
    batch over all rows, however they arrive. What comes after the watermark is
    late and is left out, as in every windowed sum. An account's state is its last
    balance and the rows that wait; after ``idle`` without rows it is forgotten.
    """
    kind = stream.schema[key].dataType.simpleString()
    cents = int(round(float(tolerance) * 100))
    quiet = pd.Timedelta(idle)
    told = stream.select(key, F.col(at).cast("timestamp").alias("_at"), F.col(number).cast("long").alias("_n"), (F.col(amount) * 100).cast("long").alias("_x"), (F.col(balance) * 100).cast("long").alias("_b"))

    def check(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (None, []) if not state.exists else (state.get[0], json.loads(state.get[1]))
        mark = state.getCurrentWatermarkMs()
        for rows in batches:
            when = rows["_at"].astype("datetime64[ms]").astype("int64")
            waiting += [w for w in map(list, zip(when.tolist(), rows["_n"].tolist(), rows["_x"].tolist(), rows["_b"].tolist(), strict=True)) if w[0] > mark]
        waiting.sort()
        due = [w for w in waiting if w[0] <= mark]
        out = []
        for when, n, x, b in due:
            if last is not None and abs(last + x - b) > cents:
                out.append((name[0], pd.Timestamp(when, unit="ms"), n, last + x, b))
            last = b
        waiting = waiting[len(due) :]
        if state.hasTimedOut and not waiting and not due:
            state.remove()
        else:
            state.update((last, json.dumps(waiting)))
            # wake up when the first that waits is due, else when the account has been idle for long
            state.setTimeoutTimestamp(max(mark + 1, waiting[0][0] if waiting else mark + int(quiet.total_seconds() * 1000)))
        yield pd.DataFrame(out, columns=["key", "at", "number", "expected", "told"])

    return told.withWatermark("_at", late).groupBy(key).applyInPandasWithState(check, f"key {kind}, at timestamp, number long, expected long, told long", "last long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
