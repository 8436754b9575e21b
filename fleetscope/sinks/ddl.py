"""Output schemas as table definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def schema_ddl(df: DataFrame, table: str, partition: str | None = None) -> str:
    """``CREATE TABLE`` text for the columns of ``df``."""
    columns = ",\n  ".join(
        f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields
    )
    tail = f"\nPARTITIONED BY (`{partition}`)" if partition else ""
    return f"CREATE TABLE {table} (\n  {columns}\n)\nUSING PARQUET{tail}"
