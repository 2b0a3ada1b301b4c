"""Registration of queries together with their DuckDB check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatelens.registry.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Lazy access to base tables and views of one folder: ``t.v_calls``, ``t.events``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def sql(self, body: str) -> DataFrame:
        from gatelens.registry.views import sql

        return sql(self.spark, self.sf_dir, body)


def query(name: str, check: str | None = None, **extra: str):
    """Register ``fn(tables)`` as a query; ``check`` is SQL over the same views.

    ``extra`` holds further common tables for the check.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(check, extra).replace("WITH ", "WITH RECURSIVE ", 1)
        return fn

    return register
