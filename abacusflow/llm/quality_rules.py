"""Quality rules as weak supervision.

Each rule looks at one aspect of a document (its alphabet, function words, case,
variety of words, their length, stops, emphasis, lines, repeats) and votes good
(1), bad (-1) or abstains (0); no two rules read the same sign. How far each rule
can be trusted is not given: expectation-maximisation estimates the share of good
documents and every rule's vote rates among good and among bad documents from how
the rules agree over the whole corpus. A document's verdict is the posterior
probability that it is good, so one odd measure does not throw a document out
and several weak signs together do; a good vote that bad documents get as often
weighs nothing.

Everything per document is a DataFrame expression. EM needs only the histogram
of vote vectors, at most 3 ** 9 rows whatever the corpus size, which is the only
thing that reaches the driver. Documents that the base checks reject have no part
in it: the model is for those that these checks let through.

``keep_good`` filters by the posterior. It has no least length: in texts of fewer
than ``MIN_WORDS`` words an abstention says nothing and is left out of the odds.

Defined cases: a null or blank text has no words, all counts 0, base_failed and
not kept; repeated rows are each judged; an empty table gives no rows. Only the
text column is read; ``judged`` replaces input columns that bear the name of a
measure, vote or verdict, ``keep_good`` carries every column through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
ROUNDS = 50
#: Vote rates to start with, by class, alike for all rules, and the documents that this belief weighs.
START = {1: {1: 0.58, 0: 0.4, -1: 0.02}, -1: {1: 0.25, 0: 0.4, -1: 0.35}}
PSEUDO = 10.0

# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that it was for de la el que los las del un una en y le les des et est pour "
    "der die das und ist von nicht mit ein eine zu den"
).split()

#: The measures that the rules read.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_emphasis", "n_function", "n_odd", "n_upper", "n_distinct")


def _covered(starts: Column) -> Column:
    """How many words 3-word windows at these ascending places cover."""
    steps = F.transform(starts, lambda x, k: F.coalesce(F.least(F.get(starts, k + 1) - x, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each whole text. Windows are told apart by 64-bit hashes of their words."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    n = F.size("_words")
    out = out.withColumn("_word", F.transform("_words", lambda x: F.xxhash64(x)))
    out = out.withColumn("_hash", F.transform(F.slice("_word", 1, F.greatest(n - 2, F.lit(0))), lambda x, k: F.xxhash64(x, F.get("_word", k + 1), F.get("_word", k + 2))))
    out = out.withColumn("_twice", F.size(F.array_distinct("_hash")) < F.size("_hash"))
    placed = F.when(F.col("_twice"), F.sort_array(F.transform("_hash", lambda x, k: F.struct(x.alias("h"), k.alias("k")))))
    out = out.withColumn("_placed", placed)
    place = lambda k: F.get("_placed", k)["h"]
    again = F.filter("_placed", lambda x, k: (F.coalesce(place(k - 1) == x["h"], F.lit(False))) | (F.coalesce(place(k + 1) == x["h"], F.lit(False))))
    out = out.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["k"])))
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_twice"), _covered(F.col("_starts"))).otherwise(0).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_stops": F.regexp_count(t, F.lit(r"[.!?]")).cast("long"),
            "n_emphasis": F.regexp_count(t, F.lit(r"[!?]")).cast("long"),
            "n_odd": F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()-]")).cast("long"),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_distinct": F.size(F.array_distinct("_word")).cast("long"),
            "n_function": F.size(F.array_intersect("_words", F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long"),
        }
    ).drop("_words", "_lines", "_word", "_hash", "_twice", "_placed", "_starts")


def _vote(bad: Column, good: Column | None = None) -> Column:
    """-1 on a sign of poor quality, 1 on a sign of good quality, else an abstention."""
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0).cast("byte")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """name -> vote over the measures."""
    long = F.col("n_words") >= MIN_WORDS
    odd, upper, distinct = _share("n_odd", "word_chars"), _share("n_upper", "word_chars"), _share("n_distinct", "n_words")
    length, stops, repeats, lines = (F.col("word_chars") - F.col("n_odd")) / F.greatest("n_words", F.lit(1)), _share("n_stops", "n_words"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    emphasis = _share("n_emphasis", "n_stops")
    return {
        "rule_alphabet": _vote(odd > 0.06, odd < 0.02),
        "rule_function_words": _vote(long & (F.col("n_function") <= 1), F.col("n_function") >= 5),
        "rule_case": _vote(upper > 0.3, upper < 0.1),
        "rule_variety": _vote(distinct < 0.4, distinct > 0.6),
        "rule_word_length": _vote((length < 2.5) | (length > 13), length.between(4, 8)),
        "rule_stops": _vote((long & (F.col("n_stops") == 0)) | (stops > 0.5), stops.between(0.02, 0.25)),
        "rule_emphasis": _vote(emphasis > 0.5, (F.col("n_stops") > 0) & (emphasis < 0.2)),
        "rule_lines": _vote((lines > 0.3) & (F.col("n_dup_lines") >= 3), lines < 0.1),
        "rule_repeats": _vote(repeats > 0.2, repeats < 0.05),
    }


def too_repetitive() -> Column:
    return 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | too_repetitive()


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """EM over the histogram of vote vectors.

    Two hidden classes; given the class, rules vote independently (naive
    Bayes). The start (START) is a weak belief that rules seldom accuse good
    documents; it also fixes which class is the good one, and stays in the
    estimates as pseudo-counts. An empty corpus keeps that start.
    """
    histogram = sorted((tuple(r[n] for n in names), r["n"]) for r in votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())
    prior = 0.85
    rate = {c: {n: dict(START[c]) for n in names} for c in (1, -1)}
    for _ in range(rounds if histogram else 0):
        mass = {1: 0.0, -1: 0.0}
        seen = {c: {n: {v: PSEUDO * p for v, p in START[c].items()} for n in names} for c in (1, -1)}
        for vector, count in histogram:
            p = posterior(dict(zip(names, vector, strict=True)), prior, rate)
            for c, w in ((1, p * count), (-1, (1 - p) * count)):
                mass[c] += w
                for n, v in zip(names, vector, strict=True):
                    seen[c][n][v] += w
        prior = (mass[1] + 8) / (mass[1] + mass[-1] + 10)
        rate = {c: {n: {v: x / sum(s.values()) for v, x in s.items()} for n, s in seen[c].items()} for c in (1, -1)}
    return {"prior": prior, "rate": rate}


def posterior(vote: dict[str, int], prior: float, rate: dict) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1][n][v] / rate[-1][n][v]) for n, v in vote.items())
    return 1 / (1 + math.exp(min(700.0, -odds)))


def probability(model: dict) -> Column:
    """The posterior probability of being good, over the vote columns; abstentions of short texts do not count."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for n in model["rate"][1]:
        weight = {v: math.log(model["rate"][1][n][v] / model["rate"][-1][n][v]) for v in (-1, 0, 1)}
        odds = odds + F.when(F.col(n) == 1, weight[1]).when(F.col(n) == -1, weight[-1]).when(F.col("n_words") >= MIN_WORDS, weight[0]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def with_verdict(rows: DataFrame, names: list[str], keep_at: float) -> DataFrame:
    """Fit the model to the measured ``rows`` and add posterior, base check and verdict."""
    model = fit(rows.where(~base_failed()), names)
    return rows.withColumn("quality", probability(model)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))


def judged(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Add measures, votes, ``quality`` (posterior), ``base_failed`` and ``kept``; the measured rows are written once."""
    votes = rules()
    docs = docs.drop(*(c for c in (*MEASURES, *votes, "quality", "base_failed", "kept") if c != text))
    rows = cut(measured(docs, text).withColumns(votes))
    return with_verdict(rows, list(votes), keep_at)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the posterior calls good, of any length but without much repetition, with their own columns, whatever these are called."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    good = (F.col("n_words") > 0) & ~too_repetitive() & (F.col("quality") >= KEEP_AT)
    return judged(packed, "_text").where(good).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures, votes, posterior and verdict."""
    votes = rules()
    rows = cut(measured(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text").withColumns(votes))
    out = with_verdict(rows, list(votes), KEEP_AT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", *votes)
