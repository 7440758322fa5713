"""Literal tables that both engines read: small cases of what the test data doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


class Cases:
    """A named table: ``frame`` for Spark, ``sql`` as a common table expression."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        cols = [c.rsplit(" ", 1) for c in self.schema.split(", ")]
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {', '.join(f'CAST({c} AS {_SQL[t]}) AS {c}' for c, t in cols)} FROM (VALUES {values}) t({', '.join(c for c, _ in cols)}))"
