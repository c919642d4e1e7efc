"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) ->
DataFrame`` over the driver's tables, plus the DuckDB SQL that must give the same
rows. Outputs are normalised (integers as BIGINT, doubles rounded to 6 places) on
both sides so the value hashes compare exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_INTS = (T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.BooleanType)
_FLOATS = (T.DoubleType, T.FloatType, T.DecimalType)


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _INTS):
            c = c.cast("long")
        elif isinstance(f.dataType, _FLOATS):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str, **sizes) -> DataFrame:
            return finalize(fn(spark, sf_dir, **sizes))
        run.__wrapped__ = fn  # its signature shows the sizes a query takes
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries_features, queries_eda, queries_ranking  # noqa: F401
    from . import queries_text, queries_prep, queries_models, queries_io  # noqa: F401
