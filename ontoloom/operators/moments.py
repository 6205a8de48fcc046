"""Yearly moments of amounts, re-scaled to a later window without the raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import date_position


def yearly(df: DataFrame, by: list[str], date: str, amount: str) -> DataFrame:
    """count, min, max, median, sum and the four moments of each group and year.

    A row's position is where its date lies in its year, from 0 to 1; the moments sum the position and its square, alone
    and times the amount.
    """
    year = F.year(date)
    p = date_position(F.col(date), F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(1), F.lit(1)))
    return (
        df.withColumn("year", year)
        .withColumn("_p", p)
        .groupBy(*by, "year")
        .agg(
            F.count(amount).alias("count_amount"),
            F.min(amount).alias("min_amount"),
            F.max(amount).alias("max_amount"),
            F.median(amount).alias("median_amount"),
            F.sum(amount).alias("sum_amount"),
            F.sum("_p").alias("lin_count"),
            F.sum(F.col("_p") * F.col(amount)).alias("lin_amount"),
            F.sum(F.col("_p") * F.col("_p")).alias("quad_count"),
            F.sum(F.col("_p") * F.col("_p") * F.col(amount)).alias("quad_amount"),
        )
    )


def rescaled(df: DataFrame, first: str, last: str) -> DataFrame:
    """The moments of yearly() over the window from the date `first` to the date `last`.

    present is a year's share of the window, past the share of the window before it; a position p of a year becomes
    past + present * p, so sums of it and of its square follow from the stored moments.  Years before the window go.
    """
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    days = F.datediff(end, start)
    opens = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    present = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), opens) / days
    past = F.datediff(opens, start) / days
    df = df.where(F.col("year") >= F.year(start)).withColumn("_q", present).withColumn("_p", past)
    for kind, total in (("count", "count_amount"), ("amount", "sum_amount")):
        df = df.withColumn(
            f"quad_{kind}", F.expr(f"_p * _p * {total} + 2 * _p * _q * lin_{kind} + _q * _q * quad_{kind}")
        ).withColumn(f"lin_{kind}", F.expr(f"_p * {total} + _q * lin_{kind}"))
    return df.drop("_p", "_q")


def over_years(df: DataFrame, by: list[str]) -> DataFrame:
    """Yearly rows added up."""
    sums = ("count_amount", "sum_amount", "lin_count", "lin_amount", "quad_count", "quad_amount")
    return df.groupBy(*by).agg(F.min("min_amount").alias("min_amount"), F.max("max_amount").alias("max_amount"), *(F.sum(c).alias(c) for c in sums))
