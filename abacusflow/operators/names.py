"""Names and concepts against lists that people keep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import partial, token_set
from ..functions.text import fold, fold_words
from ..sources.scratch import stored

#: Names of a block that meet texts in one task, and texts that meet them there, about.
NAMES, TEXTS = 2_000, 4_000
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct runs of three characters; of a shorter text nothing."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda k: F.substring(text, k, F.lit(GRAM))))).otherwise(F.array())


def _rarest(rows: DataFrame, parts: Column, among: DataFrame) -> DataFrame:
    """Add ``_part``: of each row's parts the one that the fewest rows of ``among`` (_part, n) have; rows with a part that none has are left out."""
    each = rows.withColumn("_all", F.size(parts)).withColumn("_part", F.explode(parts)).join(among, "_part")
    least = each.groupBy(*rows.columns).agg(F.min(F.struct("n", "_part")).alias("_m"), F.count(F.lit(1)).alias("_had"), F.first("_all").alias("_all"))
    return least.where("_had = _all").select(*rows.columns, F.col("_m._part").alias("_part"))


def _holding(short: DataFrame, long: DataFrame, parts, test: Column) -> DataFrame:
    """Pairs (_s, _l) of short and long rows that meet on the rarest part of the short one and pass the test."""
    indexed = stored(long.select("_l", F.explode(parts(F.col("_l"))).alias("_part")))
    counts = stored(indexed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")))
    return _rarest(short, parts(F.col("_s")), counts).join(indexed, "_part").where(test).select("_s", "_l").distinct()


def full_scores(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(t, name) of folded texts and names that score 100: one holds the other, or the words of one are all in the other.

    All of these are found by equi-joins: what is held has all its runs of three
    characters (its words) in what holds it, so it is looked up by the rarest of
    them. Runs and words that most texts have are never a join's key.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    inside, all_words = F.expr("instr(_l, _s) > 0"), F.size(F.array_except(words(F.col("_s")), words(F.col("_l")))) == 0
    t, n = texts.select(F.col("t").alias("_s")), names.select(F.col("name").alias("_s")).distinct()
    lt, ln = texts.select(F.col("t").alias("_l")), names.select(F.col("name").alias("_l")).distinct()
    long = F.length("_s") >= GRAM
    name_in_text = _holding(n.where(long), lt, _grams, inside).unionByName(_holding(n, lt, words, all_words)).select(F.col("_l").alias("t"), F.col("_s").alias("name"))
    text_in_name = _holding(t.where(long), ln, _grams, inside).unionByName(_holding(t, ln, words, all_words)).select(F.col("_s").alias("t"), F.col("_l").alias("name"))
    return stored(name_in_text.unionByName(text_in_name).distinct())


def _profiles(texts: list[str]) -> np.ndarray:
    """How often each text has each letter and digit; blanks and all else are one."""
    out = np.zeros((len(texts), 37), np.int16)
    for k, text in enumerate(texts):
        for c in text:
            at = ord(c) - 55 if "A" <= c <= "Z" else ord(c) - 48 if "0" <= c <= "9" else 36
            out[k, at] += 1
    return out


def best_of_block(texts: list[str], names: list[str], with_parts: bool) -> list[float]:
    """The best score of each folded text among the names: of their word sets, and ``with_parts`` of the best-aligned part.

    Names are tried in the order of what their characters allow at most, until
    none can be better than the best found.
    """
    sets = lambda all_of: [" ".join(sorted(set(x.split()))) for x in all_of]
    own_sets, name_sets = sets(texts), sets(names)
    mine, theirs, mine_set, their_set = (_profiles(x) for x in (texts, names, own_sets, name_sets))
    sizes, set_sizes = (np.array([len(n) for n in x]) for x in (names, name_sets))
    words = [set(n.split()) for n in names]
    out = []
    for k, text in enumerate(texts):
        own = set(text.split())
        most = 200.0 * np.minimum(mine_set[k], their_set).sum(axis=1) / np.maximum(1, set_sizes + len(own_sets[k]))
        common = np.minimum(mine[k], theirs).sum(axis=1)
        part = 200.0 * common / np.maximum(1, np.minimum(sizes, len(text)) + common)
        most = np.maximum(most, part if with_parts else np.where(part >= 100.0, part, 0.0))  # what is held has all its characters in what holds it
        # with a common word, the shared words alone may be compared
        most = np.where([bool(own & w) for w in words], 100.0, most)
        best = 0.0
        for at in np.argsort(-most, kind="stable").tolist():
            if most[at] <= best:
                break
            name = names[at]
            if text and (name in text or text in name):
                best = 100.0
                break
            best = max(best, token_set(text, name))
            if with_parts:
                best = max(best, partial(text, name, best))
        out.append(best)
    return out


def list_scores(rows: DataFrame, text: str, lists: DataFrame, with_parts: bool = True) -> DataFrame:
    """(text, kind, score) of every distinct text and kind of list (kind, name): 100 if one holds the other, else the best word-set ratio and, ``with_parts``, the best-aligned part's.

    Scores of 100 come from an index (``full_scores``). Only texts that some kind does
    not score 100 are compared, with the names of such kinds, a block of names
    and a block of texts in a task; lists of any length will do.
    """
    told = stored(lists.select("kind", fold_words(F.col("name")).alias("name")).where("name <> ''").distinct())
    own = rows.select(F.col(text).alias("_text")).distinct().withColumn("t", fold_words(F.regexp_replace("_text", r"\[\d+\]", "")))
    own = stored(own)
    texts = stored(own.select("t").where("t <> ''").distinct())
    kinds = stored(told.select("kind").distinct())
    full = full_scores(texts, told).join(told, "name").select("t", "kind").distinct().withColumn("score", F.lit(100.0))
    full = stored(full)
    n, k = texts.count(), told.count()
    blocks, parts = max(1, -(-k // NAMES)), max(1, -(-n // TEXTS))
    open_ = texts.select("t", F.explode(F.lit([r["kind"] for r in kinds.collect()])).alias("kind")) if k else texts.select("t", F.lit(None).cast("string").alias("kind")).limit(0)  # a row per kind of list
    open_ = open_.join(full, ["t", "kind"], "left_anti")
    asking = open_.withColumn("_part", F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asking.select("kind", "_part", "_block", "t", F.lit(None).cast("string").alias("name"))
    met = told.withColumn("_block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = asking.unionByName(met.select("kind", "_part", "_block", F.lit(None).cast("string").alias("t"), "name"))

    def compared(table: pa.Table) -> pa.Table:
        mine = [x for x in table.column("t").to_pylist() if x is not None]
        names = sorted(x for x in table.column("name").to_pylist() if x is not None)
        scores = best_of_block(mine, names, with_parts) if mine and names else []
        kind = table.column("kind")[0].as_py()
        return pa.table({"t": pa.array(mine if names else [], pa.string()), "kind": pa.array([kind] * len(scores), pa.string()), "score": pa.array(scores, pa.float64())})

    rest = both.groupBy("kind", "_part", "_block").applyInArrow(compared, "t string, kind string, score double").groupBy("t", "kind").agg(F.max("score").alias("score"))
    return own.join(full.unionByName(rest), "t").select(F.col("_text").alias(text), "kind", "score")


def by_lists(rows: DataFrame, text: str, lists: DataFrame, least: float = 85.0) -> DataFrame:
    """Add ``label``: the kind with the best score if it is high enough, else "PENDIENTE (probable kind n%)", else "PENDIENTE". Of equal scores the first kind by name."""
    best = list_scores(rows, text, lists).groupBy(text).agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("_b"))
    score = -F.col("_b.s")
    label = F.when(score >= least, F.col("_b.kind")).when(score > 0, F.format_string("PENDIENTE (probable %s %.0f%%)", F.col("_b.kind"), score)).otherwise("PENDIENTE")
    scored = best.select(F.col(text).alias("_t"), label.alias("label"))
    joined = rows.join(scored, rows[text].eqNullSafe(scored["_t"]), "left").drop("_t")
    return joined.withColumn("label", F.coalesce("label", F.lit("PENDIENTE")))


# Words that tell services and goods where no list does.
SERVICE_WORDS = ("ABONO", "HONORARIO", "SERVICIO", "ASESOR", "MANTENIMIENTO", "ALQUILER")
GOODS_WORDS = ("PRODUCTO", "MERCADER", "ARTICULO", "UNIDAD", "REPUESTO")


def by_lists_or_words(rows: DataFrame, text: str, lists: DataFrame, least: float = 60.0, goods: str = "Mercadería", services: str = "Servicio") -> DataFrame:
    """Add ``label``: the kind whose names score at least ``least`` by word sets, the better one, goods on a tie; else by words that tell; else "Sin clasificar"."""
    scores = list_scores(rows, text, lists, with_parts=False).groupBy(F.col(text).alias("_t")).agg(*[F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(name) for kind, name in ((goods, "_g"), (services, "_s"))])
    out = rows.join(scores, rows[text].eqNullSafe(scores["_t"]), "left")
    g, s, told = F.coalesce("_g", F.lit(0.0)), F.coalesce("_s", F.lit(0.0)), fold(F.col(text))
    has = lambda words: told.rlike("|".join(words))
    label = F.when((g >= least) & (g >= s), goods).when((s >= least) & (s > g), services).when(has(SERVICE_WORDS), services).when(has(GOODS_WORDS), goods).otherwise("Sin clasificar")
    return out.withColumn("label", label).drop("_t", "_g", "_s")


def canonical(text: Column, aliases: dict[str, str], stems: dict[str, tuple[str, str]]) -> Column:
    """A pay category's own name: by alias, else by a stem in the text with a letter at its end (stem -> (name, letters)), else null."""
    told = F.lower(fold_words(text))
    letter = F.upper(F.regexp_extract(told, r"\b([a-z])$", 1))
    known = [F.when(told == a.lower(), n) for a, n in aliases.items()]
    by_stem = [F.when(told.contains(s) & (letter != "") & F.lit(letters).contains(letter), F.concat(F.lit(f"{name} "), letter)) for s, (name, letters) in stems.items()]
    return F.coalesce(*known, *by_stem, F.lit(None).cast("string"))


def by_ticker(rows: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """Add ``security`` (ticker, name, kind) of the longest ticker that is a word of the text: an equi-join on words."""
    words = rows.select(text).distinct().withColumn("ticker", F.explode(F.array_distinct(F.split(fold_words(F.col(text)), " "))))
    met = words.join(catalogue.select(fold_words(F.col("ticker")).alias("ticker"), "name", "kind"), "ticker")
    best = met.groupBy(F.col(text).alias("_t")).agg(F.max_by(F.struct("ticker", "name", "kind"), F.struct(F.length("ticker"), F.col("ticker"))).alias("security"))
    return rows.join(best, rows[text].eqNullSafe(best["_t"]), "left").drop("_t")
