"""Registry of queries and the adapter views they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetscope.runtime import freeze_dealt
from harness.adapters import ADAPTERS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_WORD = re.compile(r"\b[a-z_][a-z0-9_]*\b")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Adapter views and tables of one data directory, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in ADAPTERS:
                for needed in references(ADAPTERS[name]):
                    self(needed)
                df = self.spark.sql(ADAPTERS[name])
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            df.createOrReplaceTempView(name)
            self._made[name] = df
        return self._made[name]

    def dealt(self, **tables: list[str]) -> Views:
        """Views that read these columns of tables from copies in buckets by the first of them, so that each table moves once."""
        views = Views(self.spark, self.sf_dir)
        for name, columns in tables.items():
            views._made[name] = freeze_dealt(self(name).select(*columns), columns[0])
        for name, df in views._made.items():
            df.createOrReplaceTempView(name)
        return views


def references(sql: str) -> list[str]:
    """Tables and adapters named in ``sql``, in order of first mention."""
    seen: dict[str, None] = {}
    for word in _WORD.findall(sql):
        if word in ADAPTERS or word in TABLES:
            seen.setdefault(word)
    return list(seen)


def with_adapters(sql: str) -> str:
    """``sql`` preceded by the adapters it uses as common table expressions."""
    ordered: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in references(text):
            if name in ADAPTERS and name not in ordered:
                visit(ADAPTERS[name])
                ordered.setdefault(name)

    visit(sql)
    heads = [f"{name} AS ({ADAPTERS[name].strip()})" for name in ordered]
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    if not heads:
        return body
    if re.match(r"WITH\b", body, re.I):
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
        return f"WITH {recursive}" + ",\n".join(heads) + ",\n" + body
    return "WITH " + ",\n".join(heads) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_adapters(oracle)
        return fn

    return register
