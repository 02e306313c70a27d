"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result computed by plain SQL."""

    def register(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def derived(spark: SparkSession, folder: str, sql: str, *tables: str, dealt: bool = False) -> DataFrame:
    """Input that SQL derives from the given tables.

    ``dealt`` spreads it over the cores: sources that SQL puts together are few
    bytes to adaptive execution, which leaves them in one partition, and much work.
    The tables all grow, so joins between them are shuffled ones.
    """
    read = {name: read_table(spark, folder, name, dealt=False).hint("merge") for name in tables}
    frame = spark.sql(sql, **read)
    return frame.repartition(spark.sparkContext.defaultParallelism) if dealt else frame


def for_spark(sql: str, *tables: str) -> str:
    """Derivation SQL with its table names as query parameters."""
    import re

    for name in tables:
        sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
    return sql


def text_of(alias: str, order: str, spark_dialect: bool) -> str:
    """Lines of a group as one text, in the dialect's spelling."""
    if spark_dialect:
        return f"listagg({alias}, chr(10)) within group (order by {order})"
    return f"string_agg({alias}, chr(10) order by {order})"


from checks import code, documents, markup, pages, search, trees  # noqa: E402,F401
