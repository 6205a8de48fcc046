"""All queries by name, for callers that don't know the modules: what there is, what it says, and its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog


def names() -> list[str]:
    return sorted(catalog.queries())


def sql(name: str) -> str | None:
    """The same query as SQL, if it has one."""
    return catalog.oracle_sql().get(name)


def call(spark: SparkSession, folder: str, name: str, limit: int | None = None) -> dict:
    """The result of a query as a service answers it: result, n_results, successful; an unknown name is no failure of ours."""
    query = catalog.queries().get(name)
    if query is None:
        return {"result": [{"error": f"there is no query {name}"}], "n_results": 0, "successful": False}
    df: DataFrame = query(spark, folder)
    rows = [r.asDict(recursive=True) for r in (df.limit(limit) if limit is not None else df).collect()]
    return {"result": rows, "n_results": len(rows), "successful": True}
