"""Registry of this subpackage's queries; ``__spark_entry__`` merges it with the library's own."""

from __future__ import annotations

from featherloom.session import ship_package

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``plan(spark, folder) -> DataFrame`` under ``name``, with its checking SQL where there is one."""

    def register(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, folder):
            ship_package(spark)
            return plan(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return register


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")
