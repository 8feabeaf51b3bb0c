"""Operators as SQL over named relations, views that bind them to tables, and the registry of queries with their oracles.

An operator is a function of a dialect, and of its own parameters, that returns SQL in which ``{name}`` stands for an input
relation.  :func:`run` applies one to DataFrames of any origin.  A query binds each relation to a view of the tables and gives the
parameters; the views are SQL too, so the whole query is one logical plan for Catalyst, and its DuckDB spelling is the oracle.
Operators hold rules alone: whatever a query makes up for want of such tables is in the views.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tallyport.functions.dialect import DUCK, SPARK, Spark
from tallyport.functions.workers import reachable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Sql = Callable[..., str]


class Operator(NamedTuple):
    name: str
    sql: Sql
    doc: str


OPERATORS: dict[str, Operator] = {}
VIEWS: dict[str, Sql] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, Callable[[], str]] = {}

_NAME = re.compile(r"\{([a-z_][a-z_0-9]*)\}")


def operator(name: str, bind: dict[str, str] | None = None, given: dict | None = None) -> Callable[[Sql], Sql]:
    """Registers an operator and its query; ``bind`` gives the view of a relation whose name is not that of the view, ``given`` the query's parameters."""

    def register(sql: Sql) -> Sql:
        OPERATORS[name] = Operator(name, sql, (sql.__doc__ or "").strip())
        names, parameters = bind or {}, given or {}
        QUERIES[name] = lambda spark, sf_dir: _query(spark, sf_dir, sql(SPARK, **parameters), names)
        _ORACLES[name] = lambda: oracle(sql(DUCK, **parameters), names)
        return sql

    return register


def oracles() -> dict[str, str]:
    """The DuckDB SQL of every query that has it."""
    return {name: sql() for name, sql in _ORACLES.items()}


def view(name: str) -> Callable[[Sql], Sql]:
    """Registers a view over tables and other views."""

    def register(sql: Sql) -> Sql:
        VIEWS[name] = sql
        return sql

    return register


def run(name: str, spark: SparkSession, parameters: dict | None = None, **relations: DataFrame) -> DataFrame:
    """The operator ``name``, with its parameters, applied to DataFrames, one for each relation that it reads."""
    return _run(reachable(spark), OPERATORS[name].sql(SPARK, **(parameters or {})), relations)


def _run(spark: SparkSession, sql: str, relations: dict[str, DataFrame]) -> DataFrame:
    """SQL over DataFrames: they have names only while the query is analysed."""
    tag = uuid.uuid4().hex
    for name, df in relations.items():
        df.createOrReplaceTempView(f"{name}_{tag}")
    try:
        return spark.sql(_NAME.sub(lambda m: f"{m[1]}_{tag}", sql))
    finally:
        for name in relations:
            spark.catalog.dropTempView(f"{name}_{tag}")


def frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or view as a DataFrame."""
    known = {} if known is None else known
    if name not in known:
        if name in TABLES:
            known[name] = reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = VIEWS[name](SPARK)
            known[name] = _run(spark, sql, {x: frame(spark, sf_dir, x, known) for x in dict.fromkeys(_NAME.findall(sql))})
    return known[name]


def _query(spark: SparkSession, sf_dir: str, sql: str, names: dict[str, str]) -> DataFrame:
    known: dict[str, DataFrame] = {}
    return _run(spark, sql, {x: frame(spark, sf_dir, names.get(x, x), known) for x in dict.fromkeys(_NAME.findall(sql))})


def oracle(sql: str, names: dict[str, str]) -> str:
    """The DuckDB query: the views that are needed as common table expressions, then the operator."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in TABLES or name in parts:
            return
        text = VIEWS[name](DUCK)
        for x in _NAME.findall(text):
            need(x)
        parts[name] = f"{name} AS ({_NAME.sub(lambda m: m[1], text)})"

    body = _NAME.sub(lambda m: names.get(m[1], m[1]), sql)
    for x in _NAME.findall(sql):
        need(names.get(x, x))
    if not parts:
        return body
    head = "WITH " + ",\n".join(parts.values())
    return head + ("," + body.strip()[4:] if body.strip().upper().startswith("WITH") else "\n" + body)
