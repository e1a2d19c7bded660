"""Registry of bound queries. Every entry is an operator, its output columns and, where SQL can say it, a check."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

from satbill.plans.bind import Tables, with_tables
from satbill.plans.derived import DERIVED
from satbill.session import tune


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shape_spark(self.run(Tables(tune(spark), sf_dir)), self.columns)

    def check(self) -> str | None:
        if self.sql is None:
            return None
        shaped = f"SELECT {', '.join(_shape_sql(n, t) for n, t in self.columns)} FROM ({self.sql.strip()}) AS result"
        return with_tables(shaped, extra=DERIVED)


REGISTRY: dict[str, Query] = {}


def register(name: str, columns: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """``columns``: names with a type letter: text (none), i whole, d decimal (4 digits), e decimal (6 digits), b flag, D day, t time."""
    pairs = tuple((part.split(":")[0], part.split(":")[1] if ":" in part else "s") for part in columns.split())
    assert name not in REGISTRY, name
    REGISTRY[name] = Query(name, pairs, run, sql)


def _as_double(value: Column, kind: DataType, digits: int) -> Column:
    """A double of so many digits. Rounding a double goes through its text; numbers that have no more digits need none of it."""
    whole = isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale <= digits)
    return value.cast("double") if whole else F.round(value.cast("double"), digits) + F.lit(0.0)


def _shape_spark(df: DataFrame, columns) -> DataFrame:
    """Common result types, so that both engines return the same kinds of values."""
    cast = {
        "s": lambda c, kind: c.cast("string"),
        "i": lambda c, kind: c.cast("bigint"),
        "d": lambda c, kind: _as_double(c, kind, 4),
        "e": lambda c, kind: _as_double(c, kind, 6),
        "b": lambda c, kind: c.cast("boolean"),
        "D": lambda c, kind: F.date_format(c.cast("date"), "yyyy-MM-dd"),
        "t": lambda c, kind: F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
    }
    kinds = {field.name: field.dataType for field in df.schema}
    return df.select(*[cast[t](F.col(n), kinds[n]).alias(n) for n, t in columns])


def _shape_sql(name: str, kind: str) -> str:
    return {
        "s": f"CAST({name} AS VARCHAR) AS {name}",
        "i": f"CAST({name} AS BIGINT) AS {name}",
        "d": f"round(CAST({name} AS DOUBLE), 4) + 0.0 AS {name}",
        "e": f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}",
        "b": f"CAST({name} AS BOOLEAN) AS {name}",
        "D": f"strftime(CAST({name} AS DATE), '%Y-%m-%d') AS {name}",
        "t": f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {name}",
    }[kind]


MODULES = [
    "q_costs", "q_revenue", "q_services", "q_quality", "q_ingest", "q_rating", "q_joins", "q_monitor",
    "q_expr", "q_text",

]


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"satbill.plans.{module}")
    return REGISTRY
