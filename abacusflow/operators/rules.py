"""Ordered rules: the first rule whose pattern occurs in a text decides.

Rules are rows, not code: (pattern, category, kind, rank, active). A rule table
is a dimension kept by people; it is read to the driver up to ``MOST_RULES`` rows
and becomes one expression, so the texts are classified in their scan without a
join. A larger table goes through a join on pieces of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .running import previous_known

MOST_RULES = 2_000
UNKNOWN = ("Otros gastos (sin clasificar)", "DEBITO_REVISAR")


def classify(rows: DataFrame, rules: DataFrame, text: str, unknown: tuple[str, str] = UNKNOWN) -> DataFrame:
    """Add ``category`` and ``kind`` by the first active rule whose folded pattern is in the folded text; empty patterns never match."""
    live = rules.where(F.coalesce("active", F.lit(True)) & (fold(F.col("pattern")) != "")).select(fold(F.col("pattern")).alias("_pattern"), "category", "kind", F.coalesce("rank", F.lit(0)).alias("_rank"))
    head = live.orderBy("_rank", "_pattern").limit(MOST_RULES + 1).collect()
    if len(head) <= MOST_RULES:
        folded = fold(F.col(text))
        hit = F.coalesce(*[F.when(folded.contains(r["_pattern"]), F.struct(F.lit(r["category"]).alias("c"), F.lit(r["kind"]).alias("k"))) for r in head], _pair(unknown)) if head else _pair(unknown)
        return rows.withColumn("_hit", hit).withColumn("category", F.col("_hit.c")).withColumn("kind", F.col("_hit.k")).drop("_hit")
    return classify_by_join(rows, live, text, unknown)


def _pair(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("c"), F.lit(pair[1]).alias("k"))


def classify_by_join(rows: DataFrame, live: DataFrame, text: str, unknown: tuple[str, str] = UNKNOWN) -> DataFrame:
    """As ``classify`` for any number of rules: distinct texts and patterns meet on pieces of three letters, shorter patterns on pieces of their length."""
    keyed = rows.withColumn("_folded", fold(F.col(text)))
    texts = keyed.select("_folded").distinct()
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_folded") - 2)), lambda k: F.substr("_folded", k, F.lit(3))))
    left = texts.select("_folded", F.explode(pieces).alias("_piece"))
    right = live.withColumn("_piece", F.left("_pattern", F.lit(3)))
    long = left.join(right.where(F.length("_pattern") >= 3), "_piece").where("contains(_folded, _pattern)").drop("_piece")
    # one or two letters: every piece of a text that starts with them, so this is an equi-join too
    starts = lambda n: texts.select("_folded", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_folded") - (n - 1))), lambda k: F.substr("_folded", k, F.lit(n))))).alias("_pattern"))
    hits = long.select("_folded", "_rank", "_pattern", "category", "kind")
    for n in (1, 2):
        hits = hits.unionByName(starts(n).join(live.where(F.length("_pattern") == n), "_pattern").select(*hits.columns))
    best = hits.groupBy("_folded").agg(F.min_by(F.struct(F.col("category").alias("c"), F.col("kind").alias("k")), F.struct("_rank", "_pattern")).alias("_hit"))
    out = keyed.join(best, "_folded", "left").withColumn("_hit", F.coalesce("_hit", _pair(unknown)))
    return out.withColumn("category", F.col("_hit.c")).withColumn("kind", F.col("_hit.k")).drop("_hit", "_folded")


def account_hint(rows: DataFrame, hints: DataFrame, default: str = "99999") -> DataFrame:
    """Add ``account`` from (category, account) hints; unknown categories get the default."""
    return rows.join(hints.select("category", "account"), "category", "left").withColumn("account", F.coalesce("account", F.lit(default)))


def first_kind(text: Column, patterns: dict[str, str], default: str | None = None) -> Column:
    """The name of the first pattern (regular expression on folded text) that fits."""
    folded = fold(text)
    return F.coalesce(*[F.when(folded.rlike(p), name) for name, p in patterns.items()], F.lit(default))


def most_hits(text: Column, keywords: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The name with the most keywords in the text; the earlier name on a tie, the default without any."""
    folded = fold(text)
    scores = [F.struct(sum((folded.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("name")) for k, (name, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))


def overridden(*choices: Column) -> Column:
    """The first choice that is there: user's, forced, automatic."""
    return F.coalesce(*choices)


def event_of(kind: Column, operation: Column, table: dict[tuple[str, str], str], default: str = "review") -> Column:
    """What an operation means for a kind of holding, from a small table."""
    return F.coalesce(*[F.when((kind == k) & (operation == o), e) for (k, o), e in table.items()], F.lit(default))


def debit_credit(amount: Column, kind: Column, debit: Column, credit: Column) -> tuple[Column, Column]:
    """(debit, credit): as given, or from a signed amount and a kind; a kind of credit or a positive amount that is no debit is a credit."""
    given = (F.coalesce(debit, F.lit(0)) != 0) | (F.coalesce(credit, F.lit(0)) != 0)
    told = F.upper(F.coalesce(kind, F.lit("")))
    value = F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))
    is_credit = told.contains("CRED") | ((value > 0) & ~told.contains("DEB"))
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        F.when(given, F.coalesce(debit, zero)).when(is_credit, zero).otherwise(F.abs(value)),
        F.when(given, F.coalesce(credit, zero)).when(is_credit, F.abs(value)).otherwise(zero),
    )


def sides_from_balance(rows: DataFrame, keys: list[str], cell: str, order: list[str], amount: str, balance: str, guess: Column) -> DataFrame:
    """Add ``is_credit``: from the change of the balance since the last known one, else from ``guess``. ``cell`` cuts long histories, see ``running``."""
    known = previous_known(rows, keys, cell, order, balance, "_before")
    change = F.col(balance) - F.col("_before")
    by_balance = F.when(F.abs(change - F.col(amount)) <= 0.05, True).when(F.abs(change + F.col(amount)) <= 0.05, False)
    return known.withColumn("is_credit", F.coalesce(by_balance, guess)).drop("_before")
