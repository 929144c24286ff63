"""Every query of the library, by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def greedy_sql(name: str, pairs: str, group: str, left: str, right: str, order: str) -> str:
    """CTEs for ``name``: the rows of ``pairs`` that a pass in this order takes, each left and right once; rows meet within a group only."""
    free = f"not list_contains(g.used_left, p.{left}) and not list_contains(g.used_right, p.{right})"
    return f"""{name}_pairs as (select *, row_number() over (partition by {group} order by {order}{left}, {right}) as place from {pairs}),
{name}_pass as (select distinct {group}, 0::bigint as place, cast([] as bigint[]) as used_left, cast([] as bigint[]) as used_right, false as taken from {name}_pairs
  union all select p.{group}, p.place, case when {free} then list_append(g.used_left, p.{left}) else g.used_left end, case when {free} then list_append(g.used_right, p.{right}) else g.used_right end, {free}
  from {name}_pass g join {name}_pairs p on p.{group} = g.{group} and p.place = g.place + 1),
{name} as (select p.* from {name}_pairs p join {name}_pass g on g.{group} = p.{group} and g.place = p.place and g.taken)"""


def _load() -> None:
    """Import the modules that register queries."""
    from . import accounts, bank, closing, crossing, figures, grids, holdings, invoices, obligations, readings, texts  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank movements of every account: balances repaired, months controlled."""
    _load()
    return QUERIES["monthly_control"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE
