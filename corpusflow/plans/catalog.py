"""Catalogue of relational operators: name, inputs and SQL in the common dialect.

`apply(name, **tables)` runs an operator on any DataFrames with the named columns; nothing is collected and Catalyst
plans the whole. `query(name)` binds its inputs to engine tables made from the driver's (module `adapters`).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans import registry
from corpusflow.plans.dialect import duck_sql, spark_sql
from corpusflow.plans.durable import written


@dataclass
class Operator:
    name: str
    sql: str
    #: input name -> engine table
    inputs: dict[str, str] = field(default_factory=dict)
    doc: str = ""
    oracle: str | None = None


OPERATORS: dict[str, Operator] = {}
#: Operators that are programs over DataFrames, by name.
PROGRAMS: dict[str, Callable[..., DataFrame]] = {}
#: engine table -> (SQL, DuckDB text where it differs)
TABLES: dict[str, tuple[str, str | None]] = {}
DRIVER = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _holes(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z][a-z_0-9]*)\}", sql)))


def _fill(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\{([a-z][a-z_0-9]*)\}", lambda m: names.get(m[1], m[1]), sql)


def table(name: str, sql: str, duck: str | None = None) -> None:
    TABLES[name] = (sql, duck)


def operator(name: str, sql: str, doc: str = "", oracle: str | None = None, **inputs: str) -> None:
    """Register an operator and its query; inputs not named are engine tables of the same name."""
    op = Operator(name, sql, {h: inputs.get(h, h) for h in _holes(sql)}, doc, oracle)
    OPERATORS[name] = op
    registry.QUERIES[name] = query(name)
    registry.ORACLES[name] = oracle_of(op)


def rows_only(name: str) -> Callable:
    """Register a query that SQL does not express."""

    def put(f):
        registry.QUERIES[name] = f
        return f

    return put


def program(name: str, oracle: str | None = None, first: dict[str, str] | None = None, **inputs: str) -> Callable:
    """Register an operator that is a program over DataFrames, with its inputs by engine table, and its query.

    first: engine tables that its query writes before others are made from them, as Catalyst plans each use of a table anew, and the tables that they are written from."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            for t, form in (first or {}).items():
                made[t] = written(engine_table(spark, sf_dir, form, made), t)
            return f(**{h: engine_table(spark, sf_dir, t, made) for h, t in inputs.items()})

        run.__name__, run.__doc__ = name, f.__doc__
        PROGRAMS[name] = f
        registry.QUERIES[name] = run
        if oracle:
            registry.ORACLES[name] = oracle_of(Operator(name, "", inputs, oracle=oracle))
        return f

    return put


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    text = spark_sql(sql)
    holes = {h: tables[h] for h in _holes(sql)}
    if not holes:
        return spark.sql(text)
    # braces of patterns are doubled for the formatter
    text = re.sub(r"\{([a-z][a-z_0-9]*)\}", "\x01\\1\x02", text).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("\x01", "{").replace("\x02", "}"), **holes)


def apply(name: str, **tables: DataFrame) -> DataFrame:
    """An operator on the given inputs."""
    if name in PROGRAMS:
        return PROGRAMS[name](**tables)
    op = OPERATORS[name]
    spark = next(iter(tables.values())).sparkSession
    return run_sql(spark, op.sql, tables)


def engine_table(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """An engine table over the driver's tables of a folder."""
    made = {} if made is None else made
    if name not in made:
        if name in DRIVER:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = TABLES[name][0]
            made[name] = run_sql(spark, sql, {h: engine_table(spark, sf_dir, h, made) for h in _holes(sql)}) if _holes(sql) else spark.sql(spark_sql(sql))
    return made[name]


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        op, made = OPERATORS[name], {}
        if not op.inputs:
            return spark.sql(spark_sql(op.sql))
        return run_sql(spark, op.sql, {h: engine_table(spark, sf_dir, t, made) for h, t in op.inputs.items()})

    run.__name__ = name
    run.__doc__ = OPERATORS[name].doc
    return run


def _needs(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in DRIVER and n not in seen:
            sql, duck = TABLES[n]
            _needs(_holes(duck or sql), seen)
            seen.append(n)
    return seen


def oracle_of(op: Operator) -> str:
    needed = _needs(list(op.inputs.values()), [])
    ctes = [f"{n} AS (\n{_fill(duck_sql(TABLES[n][1] or TABLES[n][0]), {}).strip()}\n)" for n in needed]
    body = _fill(op.oracle or duck_sql(op.sql), op.inputs).strip()
    if not ctes:
        return body
    m = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if m and m[1] or any("RECURSIVE" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(ctes) + (",\n" + body[m.end() :] if m else "\n" + body)
