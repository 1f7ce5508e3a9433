"""Rule rows as relations: inline tables for joins, literal arrays for per-row evaluation.

An inline table is planned as a local relation with exact statistics, so Catalyst
decides from its real size whether a join broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value, engine: str = "spark") -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        inner = ", ".join(sql_literal(v, engine) for v in value)
        return f"array({inner})" if engine == "spark" else f"[{inner}]"
    text = str(value).replace("'", "''")
    return "'" + (text.replace("\\", "\\\\") if engine == "spark" else text) + "'"


def inline_table(rows: list[dict], types: dict[str, str], engine: str = "spark") -> str:
    """`select ... from (values ...)` with every column cast to its declared type."""
    body = ",\n ".join("(" + ", ".join(sql_literal(r.get(c), engine) for c in types) + ")" for r in rows)
    names = ", ".join(types)
    cast = ", ".join(f"cast({c} as {_type(t, engine)}) as {c}" for c, t in types.items())
    return f"select {cast} from (values {body}) as t({names})"


def _type(spark_type: str, engine: str) -> str:
    if engine == "spark":
        return spark_type
    return {"string": "varchar", "array<string>": "varchar[]"}.get(spark_type, spark_type)


def frame(spark: SparkSession, rows: list[dict], types: dict[str, str]) -> DataFrame:
    return spark.sql(inline_table(rows, types))


def literal_array(rows: list[dict], types: dict[str, str]) -> str:
    """SQL text of one constant array of structs; Catalyst folds it once at planning."""
    structs = (
        "named_struct(" + ", ".join(f"'{c}', cast({sql_literal(r.get(c))} as {t})" for c, t in types.items()) + ")"
        for r in rows
    )
    return "array(" + ", ".join(structs) + ")"
