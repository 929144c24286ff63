"""Which security a movement is about: its name, kind, group, how sure that is and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.scratch import stored
from .names import GRAM, _grams, _holding

# Kinds with their groups, and the words that tell of a kind.
FUND, BOND, SHARE, DOLLAR, OTHER = "fci", "bono", "accion", "usd_mep", "otro"
GROUPS = {FUND: "FCI", BOND: "Bonos / Títulos públicos", SHARE: "Acciones / Cedears", DOLLAR: "Dólar / MEP", OTHER: "Otros"}
SURE, REVIEW = "alta", "revisar"
FUND_HINTS = ("FIMA", "FCI", "FONDO")
FUND_WORDS = ("FCI", "FONDO COMUN", "CUOTAPARTE", "MONEY MARKET", "FIMA")
DOLLAR_NAMES = ("USD", "US", "USS", "DOLAR", "DOLARES", "U$S", "U$D")
DOLLAR_ACCOUNT = ("CAJA DE AHORRO EN DOLAR",)
BOND_WORDS = ("TITULO PUBLICO", "LECAP", "LETRA DEL TESORO", "BOPREAL", "BONAR")
DOLLAR_TRADES = ("DOLAR MEP", "COMPRA MEP", "VENTA MEP")
SHARE_WORDS = ("ACCION", "EQUITY", "ADR")
NOTE_WORDS = ("OBLIGACION NEGOCIABLE",)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def bare(name: Column) -> Column:
    """A name's letters and digits, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9]", ""))


def fund_name(name: Column) -> Column:
    """A fund's name without a leading "Fondo -"; without a name "FCI"."""
    told = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "), r"(?i)^\s*fondo\s*[-–:]\s*", ""))
    return F.when(told == "", "FCI").otherwise(told)


def alias_of(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(t, alias): of the aliases (priority, words, name) all of whose words a folded text holds, the one of least priority.

    An alias is looked up by the rarest run of three characters of its longest word,
    so neither side is compared as a whole. Words need three characters at least.
    """
    told = aliases.select("priority", "name", F.transform("words", fold).alias("words"))
    told = stored(told.withColumn("_s", F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).where(F.length("_s") >= GRAM))
    met = _holding(told.select("_s").distinct(), texts.select(F.col("t").alias("_l")).distinct(), _grams, F.expr("instr(_l, _s) > 0"))
    full = met.join(told, "_s").where(F.forall("words", lambda w: F.col("_l").contains(w)))
    return full.groupBy(F.col("_l").alias("t")).agg(F.min_by("name", F.struct("priority", "name")).alias("alias"))


def ticker_of(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, ticker): the longest ticker of a catalogue that is a word of the name or that its letters and digits begin with.

    A name is looked up by its words and by the beginnings of its bare form, as long
    as tickers get: an equi-join. Of equally long tickers the first in order.
    """
    known = stored(catalogue.select(F.upper("ticker").alias("ticker")).where("ticker <> ''").distinct())
    longest = known.agg(F.max(F.length("ticker"))).first()[0] or 0
    token = bare(F.col("name"))
    starts = F.when(F.length(token) > 0, F.transform(F.sequence(F.lit(1), F.least(F.length(token), F.lit(max(1, longest)))), lambda k: F.substring(token, F.lit(1), k))).otherwise(F.array())
    words = F.filter(F.split(F.upper("name"), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & (F.length(w) <= max(1, longest)))
    asked = names.select("name").distinct().withColumn("ticker", F.explode(F.array_distinct(F.concat(starts, words))))
    return asked.join(known, "ticker").groupBy("name").agg(F.min(F.struct((-F.length("ticker")).alias("n"), "ticker")).alias("_b")).select("name", F.col("_b.ticker").alias("ticker"))


def identified(rows: DataFrame, name: str, description: str, operation: str, currency: str, catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``security``: (canonical, kind, group, confidence, reason), by the first of twelve rules that holds.

    Funds come first (a fixed-income fund in dollars is no dollar), then dollars by
    name or account, then tickers of public bonds (a bond traded for dollars stays a
    bond), words that tell of bonds, dollar trades, certificates, shares, any other short
    ticker, and corporate notes, which are for review as all that is left.
    """
    original = F.trim(F.coalesce(F.col(name), F.lit("")))
    own = stored(rows.select(F.col(name).alias("_n"), F.col(description).alias("_d")).distinct().withColumn("t", fold(F.concat_ws(" ", F.trim(F.coalesce("_n", F.lit(""))), F.col("_d")))).withColumn("name", F.trim(F.coalesce("_n", F.lit("")))))
    named = own.join(alias_of(own.where(_has(F.col("t"), FUND_HINTS)).select("t"), aliases), "t", "left").join(ticker_of(own, catalogue), "name", "left")
    named = named.select(F.col("_n").alias("_nn"), F.col("_d").alias("_dd"), F.col("t").alias("_told"), "alias", "ticker")
    out = rows.join(named, rows[name].eqNullSafe(named["_nn"]) & rows[description].eqNullSafe(named["_dd"]), "left")
    blob = fold(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (name, description, operation, currency)]))
    token, told = bare(original), F.col("_told")
    or_else = lambda fallback: F.upper(F.when(original != "", original).otherwise(fallback))
    clean = fund_name(original)
    certificate = F.trim(F.regexp_replace(original, r"(?i)^cedear\s+", "CEDEAR "))

    def told_as(canonical: Column, kind: str, reason, confidence: str = SURE) -> Column:
        return F.struct(canonical.alias("canonical"), F.lit(kind).alias("kind"), F.lit(GROUPS[kind]).alias("group"), F.lit(confidence).alias("confidence"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    rules = [
        (F.col("alias").isNotNull(), told_as(F.col("alias"), FUND, "Alias FIMA / FCI")),
        (told.contains("FIMA"), told_as(F.upper(fund_name(F.concat_ws(" ", original, F.col(description)))), FUND, "Alias FIMA / FCI")),
        (_has(blob, FUND_WORDS), told_as(F.when(fold(clean).contains("FIMA"), F.upper(clean)).otherwise(clean), FUND, "Fondo común")),
        (token.isin(*DOLLAR_NAMES) | F.upper(original).isin(*DOLLAR_NAMES), told_as(F.lit("USD"), DOLLAR, "Moneda / caja USD")),
        (_has(blob, DOLLAR_ACCOUNT), told_as(F.lit("USD"), DOLLAR, "Extracto CA en dólares")),
        (F.col("ticker").isNotNull(), told_as(F.col("ticker"), BOND, F.concat(F.lit("Título público "), F.col("ticker")))),
        (_has(blob, BOND_WORDS), told_as(or_else(F.lit("BONO")), BOND, "Texto de título público")),
        (blob.rlike(r"\bBONO\b") & ~blob.contains("CARBONO"), told_as(or_else(F.lit("BONO")), BOND, "Texto de bono")),
        (_has(blob, DOLLAR_TRADES), told_as(F.lit("USD"), DOLLAR, "Operación MEP — usar Caja USD")),
        (blob.contains("CEDEAR"), told_as(F.when(certificate != "", certificate).otherwise(F.upper(original)), SHARE, "Cedear")),
        (_has(blob, SHARE_WORDS), told_as(or_else(F.lit("ACCION")), SHARE, "Acción")),
        (token.rlike("^[A-Z]{3,5}$"), told_as(token, SHARE, "Ticker corto")),
        (_has(blob, NOTE_WORDS) | blob.rlike(r"\bON\b"), told_as(F.when(original != "", original).otherwise("ON"), OTHER, "ON — confirmar tipo", REVIEW)),
    ]
    security = None
    for holds, value in rules:
        security = F.when(holds, value) if security is None else security.when(holds, value)
    security = security.otherwise(told_as(F.when(original != "", original).otherwise("Sin especie"), OTHER, "No identificado", REVIEW))
    return out.withColumn("security", security).drop("_nn", "_dd", "_told", "alias", "ticker")
