"""Small literal inputs that read the same in Spark and in DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck_type(kind: str) -> str:
    kind = kind.strip().lower()
    if kind.startswith("array<"):
        return duck_type(kind[6:-1]) + "[]"
    return DUCK[kind]


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {literal(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    """Rows under a Spark DDL schema of plain and array columns: `df` for Spark, `sql` (a parenthesised subquery) for DuckDB."""

    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    @property
    def sql(self) -> str:
        fields = [f.split(maxsplit=1) for f in self.schema.split(", ")]
        cols = ", ".join(f"CAST(c{i} AS {duck_type(kind)}) AS {name}" for i, (name, kind) in enumerate(fields))
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(SELECT {cols} FROM (VALUES {values}) v({', '.join(f'c{i}' for i in range(len(fields)))}))"
