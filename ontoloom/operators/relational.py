"""Joins, normalisations and orderings that the other operators are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, tanh_scale


def keep(df: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    """Rows of df whose key is among ids."""
    return df.join(ids.select(*on), list(on), "left_semi")


def drop(df: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    """Rows of df whose key is not among ids."""
    return df.join(ids.select(*on), list(on), "left_anti")


def where_given(df: DataFrame, **conditions) -> DataFrame:
    """Equality or membership for every condition that is not None."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in conditions.items() if v is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def induced(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges with both ends among nodes(id)."""
    for end in (source, target):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def touching(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges with at least one end among nodes(id): two semi joins instead of a disjunctive one."""
    ids = nodes.select("id").distinct()
    first = edges.join(ids.withColumnRenamed("id", source), source, "left_semi").select(edges.columns)
    rest = edges.join(ids.withColumnRenamed("id", source), source, "left_anti")
    return first.unionByName(rest.join(ids.withColumnRenamed("id", target), target, "left_semi").select(edges.columns))


def share(value: str, *by: str) -> Column:
    """value over its sum in the group: L1 normalisation."""
    return safe_div(F.col(value), F.sum(value).over(Window.partitionBy(*by)))


def unit(value: str, *by: str) -> Column:
    """value over the euclidean norm of its group."""
    return safe_div(F.col(value), F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*by))))


def of_max(value: str, *by: str) -> Column:
    """value over the greatest of its group."""
    return safe_div(F.col(value), F.max(value).over(Window.partitionBy(*by)))


def strong(df: DataFrame, value: str, by: list[str], ratio: float = 0.05) -> DataFrame:
    """Rows whose value is at least a share of the greatest in their group."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn("_top", top).where(F.col(value) >= ratio * F.col("_top")).drop("_top")


def top_n(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of every group; the order has to be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of every group, the first in the order."""
    return top_n(df, 1, by, *order)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return drop(old, new, *key).unionByName(new)


def in_ranges(df: DataFrame, *order: Column) -> tuple[DataFrame, dict[int, int]]:
    """(df with _range and _place, rows in each range): sorted by ranges, the place of a row within its own counted from 0.

    Written aside, since the bounds of ranges are sampled; the second has one entry for each partition.
    """
    from ..sources.store import stash

    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stash(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_place", place), "ranges")
    return placed, {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}


def median(df: DataFrame, value: str) -> DataFrame:
    """_median: one row with the exact median of a column, null without values; no task sees all values."""
    placed, sizes = in_ranges(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")), F.col("_v"))
    n, before, middle = sum(sizes.values()), 0, F.lit(False)
    for k in sorted(sizes):
        for rank in {(n - 1) // 2, n // 2}:
            if before <= rank < before + sizes[k]:
                middle = middle | ((F.col("_range") == k) & (F.col("_place") == rank - before))
        before += sizes[k]
    return placed.where(middle).agg(F.avg("_v").alias("_median"))


def tanh_normalised(df: DataFrame, value: str, name: str = "score", epsilon: float = 0.01) -> DataFrame:
    """df with tanh-scaled values; rows that score zero or less go.  The median is one row, joined by broadcast."""
    scaled = df.crossJoin(F.broadcast(median(df, value))).withColumn(name, tanh_scale(F.col(value), F.col("_median"), epsilon))
    return scaled.drop("_median").where(F.col(name) > 0)


def densified(df: DataFrame, ids: DataFrame, steps: DataFrame, value: str) -> DataFrame:
    """A row for every id and step, zero where df has none.  steps has a bounded number of rows."""
    on = [*ids.columns, *steps.columns]
    return ids.crossJoin(F.broadcast(steps)).join(df, on, "left").fillna(0, [value]).select(*on, value)


def both_scored(a: DataFrame, b: DataFrame, on: list[str], value: str = "score") -> DataFrame:
    """Full outer join of two scored tables, zero where one has no row: columns value_1 and value_2."""
    a, b = a.withColumnRenamed(value, f"{value}_1"), b.withColumnRenamed(value, f"{value}_2")
    return a.join(b, on, "full_outer").fillna(0, [f"{value}_1", f"{value}_2"])


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: by, value, start, length."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    return marked.groupBy(*by, "_run", value).agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_run")


def top_share(df: DataFrame, ratio: float, *order: Column) -> DataFrame:
    """The first floor(ratio * rows) rows: sorted by ranges, each cut where the sizes of those before it say."""
    placed, sizes = in_ranges(df, *order)
    left, quota = int(sum(sizes.values()) * ratio), []
    for k in sorted(sizes):
        quota.append((k, min(left, sizes[k])))
        left -= quota[-1][1]
    if not quota:
        return df.limit(0)
    cut = F.create_map(*(F.lit(x) for pair in quota for x in pair))
    return placed.where(F.col("_place") < cut[F.col("_range")]).select(df.columns)


def of_greatest(df: DataFrame, *values: str) -> DataFrame:
    """df with each of the columns divided by its greatest value: one aggregated row joined by broadcast, no global sort.

    df is written aside first, since it is read twice.
    """
    from ..sources.store import stash

    df = stash(df, "scored")
    top = df.agg(*(F.max(c).alias(f"_top_{c}") for c in values))
    scaled = df.crossJoin(F.broadcast(top))
    for c in values:
        scaled = scaled.withColumn(c, safe_div(F.col(c), F.col(f"_top_{c}")))
    return scaled.select(df.columns)
