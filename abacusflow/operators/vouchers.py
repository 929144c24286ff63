"""Kinds of vouchers and investment movements in the words and codes people use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold

# What the tax authority's voucher codes stand for, in the two tables in use.
MATCHER_CODES = {1: "A", 2: "B", 3: "C", 4: "M", 6: "NCA", 7: "NCB", 8: "NCC", 11: "C", 51: "M", 63: "LQ", 81: "TF", 82: "TF"}
EXTRACTOR_CODES = {1: "A", 3: "NCA", 6: "B", 8: "NCB", 11: "C", 13: "NCC"}

# What an operation does to a holding, by kind of holding and words, the first that fits.
EVENTS = (
    ("accion", r"DIVIDENDO|RENTA", "ingreso"),
    ("bono", r"RENTA|CUPON", "ingreso"),
    ("bono", r"AMORTIZ", "amortizacion"),
    ("fci", r"SUSCRIP|APORTE|COMPRA", "entrada"),
    ("bono", r"COMPRA", "entrada"),
    ("accion", r"COMPRA", "entrada"),
    ("fci", r"RESCATE|VENTA", "salida"),
    ("bono", r"VENTA", "salida"),
    ("accion", r"VENTA", "salida"),
)
EVENT_ORDER = ("entrada", "ingreso", "amortizacion", "salida", "omitir", "omitir_usd", "revisar")


def voucher_kind(text: Column, codes: dict[int, str] | None = None) -> Column:
    """A, B, C or M, with NC or ND in front for credit and debit notes, LQ, TF; from words, else from a code; "" if neither tells."""
    told = fold(text)
    letter = F.regexp_extract(told, r"\b([ABCM])\b", 1)
    number = F.regexp_extract(told, r"\b0*(\d{1,3})\b", 1).try_cast("int")
    table = codes or EXTRACTOR_CODES
    coded = F.coalesce(*[F.when(number == k, v) for k, v in table.items()], F.lit(""))
    return (
        F.when(told.contains("LIQUIDACION") | told.rlike(r"\bLQ\b"), "LQ")
        .when(told.rlike("TIQUE|CONTROLADOR"), "TF")
        .when(told.contains("NOTA DE CREDITO") | told.rlike(r"\bNC\b"), F.concat(F.lit("NC"), letter))
        .when(told.contains("NOTA DE DEBITO") | told.rlike(r"\bND\b"), F.concat(F.lit("ND"), letter))
        .when(letter != "", letter)
        .otherwise(coded)
    )


def holding_event(kind: Column, operation: Column) -> Column:
    """What an operation does to a holding: entrada, salida, ingreso, amortizacion, omitir, omitir_usd or revisar."""
    told = fold(operation)
    known = [F.when((kind == k) & told.rlike(p), e) for k, p, e in EVENTS]
    return F.coalesce(F.when(kind == "usd_mep", "omitir_usd"), F.when(F.coalesce(kind, F.lit("otro")) == "otro", "revisar"), *known, F.lit("omitir"))


def event_rank(event: Column) -> Column:
    """Entries before exits on the same day."""
    return F.coalesce(*[F.when(event == e, k) for k, e in enumerate(EVENT_ORDER)], F.lit(9))


def operation_kind(text: Column, units: Column, amount: Column) -> Column:
    """The name of an operation from its words, else from the signs of units and amount, else its own text."""
    told = fold(text)
    return (
        F.when(told.contains("RESCATE"), "Rescate")
        .when(told.contains("SUSCRIP"), "Suscripcion")
        .when(told.rlike("COMPRA|APORTE") & ~told.contains("VENTA"), "Compra")
        .when(told.contains("VENTA"), "Venta")
        .when(told.contains("DIVIDENDO"), "Dividendo")
        .when(told.rlike("CUPON|RENTA"), "Renta")
        .when(told.contains("AMORTIZ"), "Amortizacion")
        .when((units < 0) | (amount < 0), "Venta")
        .when(units > 0, "Compra")
        .otherwise(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "Movimiento").otherwise(F.trim(text)))
    )


def derived(units: Column, price: Column, amount: Column) -> tuple[Column, Column, Column]:
    """(units, price, amount), a missing one from the other two; by nothing is nothing."""
    return (
        F.coalesce(units, F.try_divide(amount, price)),
        F.coalesce(price, F.try_divide(amount, units)),
        F.coalesce(amount, units * price),
    )
