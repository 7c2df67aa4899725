"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.star import prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as 64-bit, so that engines agree on the types of counts and ranks."""
    small = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int")]
    return df.withColumns({c: F.col(c).cast("long") for c in small}) if small else df


def query(oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function (spark, sf_dir) under its name; ``uses`` names derived inputs of the SQL twin."""
    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: wide(fn(spark, sf_dir))
        QUERIES[name].__name__ = name
        if oracle:
            sql = oracle.strip()
            if uses:
                sql = f"{prelude(*uses)},\n{sql[5:].lstrip()}" if sql.upper().startswith("WITH ") else f"{prelude(*uses)}\n{sql}"
            ORACLES[name] = sql
        return fn

    return add
