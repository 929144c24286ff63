"""Extraction that checks itself: what fails is read again in another way, chosen by how it failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..sources.scratch import stored
from .fiscal import plausible_schedule
from .readings import schedule_lines

MOST = 3
OK = "OK"


def attempted(docs: DataFrame, key: str, first: Column, strategies: dict[str, Callable[[DataFrame], DataFrame]], verdicts: Callable[[DataFrame], DataFrame], following: Callable[[Column, Column], Column], most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, log): what was read of every document that could be read, with ``strategy``; and each attempt (key, attempt, strategy, rows, reason).

    ``first`` names a document's first strategy; a strategy reads rows (with the
    key) from documents; ``verdicts`` gives (key, reason) of rows, "OK" where they
    will do; a document that gives no rows is EMPTY. ``following`` (reason, attempt
    so far) names the next strategy, null to give up. A strategy only sees documents
    that ask for it, and none that has failed with it is asked to try it again. A
    document's attempts are at most ``most``, so is the number of rounds. The key is
    distinct and not null.
    """
    asking = stored(docs.select(key, first.alias("strategy"), F.array().cast("array<string>").alias("tried")).where("strategy is not null"))
    kept, log = None, None
    for attempt in range(1, most + 1):
        read = None
        for name, read_with in strategies.items():
            mine = docs.join(asking.where(F.col("strategy") == name).select(key), key, "left_semi")
            rows = read_with(mine).withColumn("strategy", F.lit(name))
            read = rows if read is None else read.unionByName(rows)
        read = stored(read)
        counted = read.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        told = asking.join(counted, key, "left").join(verdicts(read).select(key, "reason"), key, "left")
        reason = F.when(F.coalesce("rows", F.lit(0)) == 0, "EMPTY").otherwise(F.coalesce("reason", F.lit(OK)))
        told = stored(told.withColumn("reason", reason).withColumn("rows", F.coalesce("rows", F.lit(0))))
        done = read.join(told.where(F.col("reason") == OK).select(key), key, "left_semi")
        line = told.select(key, F.lit(attempt).alias("attempt"), "strategy", "rows", "reason")
        kept, log = (done, line) if kept is None else (kept.unionByName(done), log.unionByName(line))
        tried = F.concat("tried", F.array("strategy"))
        again = told.where(F.col("reason") != OK).select(key, following(F.col("reason"), F.lit(attempt)).alias("strategy"), tried.alias("tried"))
        asking = stored(again.where(F.col("strategy").isNotNull() & ~F.array_contains("tried", F.col("strategy"))))
        if asking.isEmpty():
            break
    return kept, log


def outcome(log: DataFrame, key: str) -> DataFrame:
    """(key, attempts, strategy, reason) of each document: its last attempt; the strategy is null where none did."""
    last = log.groupBy(key).agg(F.max(F.struct("attempt", "strategy", "reason")).alias("_l"))
    return last.select(key, F.col("_l.attempt").alias("attempts"), F.when(F.col("_l.reason") == OK, F.col("_l.strategy")).alias("strategy"), F.col("_l.reason").alias("reason"))


def _one_a_line(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Installments of which every field stands on a line of its own: number, date, then amounts until the next number."""
    flat = docs.select(key, F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]*+\n[ \t]*+(?!\d{1,3}[ \t]*\n[ \t]*\d{2}/)", " ").alias("_flat"))
    return schedule_lines(flat, key, "_flat")


def _scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Installments from a scan: letters that stand for digits in dates and amounts, amounts with any separators."""
    line = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_at", "_line"))
    head = r"^\s*(\d{1,3})\s+([\dOolI|]{2}[/.'][\dOolI|]{2}[/.'][\dOolI|]{4})\s+(.+)$"
    amounts = F.transform(F.regexp_extract_all(F.regexp_extract("_line", head, 3), F.lit(r"([\dOol|][\dOol|.,]*[.,][\dOol|]{2})(?=\s|$)"), F.lit(1)), money.parse_last_separator)
    day = dates.parse_scanned_date(F.translate(F.regexp_extract("_line", head, 2), "OolI|", "00111"))
    rows = line.where(F.col("_line").rlike(head)).select(key, F.regexp_extract("_line", head, 1).cast("int").alias("n"), "_at", day.alias("due_date"), amounts.alias("_x")).where(F.size("_x") >= 3)
    first = rows.groupBy(key, "n").agg(F.min(F.struct("_at", "due_date", F.get("_x", F.lit(0)).alias("capital"), F.get("_x", F.lit(1)).alias("interest"), F.element_at("_x", -1).alias("due"))).alias("_r"))
    return first.select(key, "n", "_r.due_date", "_r.capital", "_r.interest", "_r.due")


def loan_strategies(key: str, text: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Ways to read a schedule of installments: a line each, a field a line, a scan."""
    return {"lines": lambda docs: schedule_lines(docs, key, text), "fields": lambda docs: _one_a_line(docs, key, text), "scan": lambda docs: _scanned(docs, key, text)}


def next_loan_strategy(reason: Column, attempt: Column) -> Column:
    """No installments: another layout, then a scan; amounts or dates that are missing or wrong: a scan at once, then the other layout."""
    return F.when(reason == "EMPTY", F.when(attempt == 1, "fields").otherwise("scan")).otherwise(F.when(attempt == 1, "scan").otherwise("fields"))


def loan_schedules(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(installments, log) of schedules in any of three layouts, each checked by ``plausible_schedule``."""
    checked = lambda rows: plausible_schedule(rows, [key], "due", "due_date").select(key, F.col("verdict").alias("reason"))
    return attempted(docs, key, F.lit("lines"), loan_strategies(key, text), checked, next_loan_strategy)
