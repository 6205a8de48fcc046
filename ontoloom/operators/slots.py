"""Columns that models make: embedding, translation, recognition and the like, with any model behind them.

A model is a name, a function that loads it and one that applies it to a list of inputs.  A worker loads a model when it
first needs it, keeps the ones used last and drops others.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Models that a worker keeps, at most.
KEPT = 2
_LOADED: OrderedDict[str, Any] = OrderedDict()


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """The model of a name in this worker."""
    if name not in _LOADED:
        while len(_LOADED) >= KEPT:
            _LOADED.popitem(last=False)
        _LOADED[name] = load()
    _LOADED.move_to_end(name)
    return _LOADED[name]


def with_model(
    df: DataFrame, column: str, out: str, kind: T.DataType, name: str, load: Callable[[], Any], apply: Callable[[Any, list], list], batch: int = 64
) -> DataFrame:
    """df with `out`: what the model makes of a column, in lists of at most `batch`.  A null input has a null result."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            values = rows.column(at).to_pylist()
            known = [k for k, v in enumerate(values) if v is not None]
            made: list = [None] * len(values)
            if known:
                model = model or loaded(name, load)
            for k in range(0, len(known), batch):
                part = known[k : k + batch]
                for i, v in zip(part, apply(model, [values[i] for i in part]), strict=True):
                    made[i] = v
            yield pa.record_batch([*rows.columns, pa.array(made, to_arrow_type(kind))], names=[*rows.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def limited(df: DataFrame, column: str, size: Column, most: int) -> DataFrame:
    """df with error, and the column null, where its size is more than a model takes."""
    long = F.coalesce(size > most, F.lit(False))
    return df.withColumn("error", F.when(long, F.lit(f"text over token limit of {most}"))).withColumn(column, F.when(~long, F.col(column)))


def translatable(df: DataFrame, column: str, source: Column, target: Column, pairs: set[tuple[str, str]], most: int) -> DataFrame:
    """df with error, and the column null, where a text can't be translated: one language, an unknown pair, too long."""
    known = F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in sorted(pairs)])
    error = (
        F.when(source == target, "source and target languages are the same")
        .when(~F.coalesce(known, F.lit(False)), "languages are not supported")
        .when(F.length(column) > most, "text too long")
    )
    return df.withColumn("error", error).withColumn(column, F.when(error.isNull(), F.col(column)))


def confident(segments: Column, least: float = -1.0) -> Column:
    """The segments of a transcript whose mean logarithmic probability is high enough."""
    return F.filter(segments, lambda s: s["avg_logprob"] >= least)


def language_of_segments(df: DataFrame, key: str, language: str) -> DataFrame:
    """key, language: what most segments speak, the first by name among equals; null ones don't vote."""
    n = df.where(F.col(language).isNotNull()).groupBy(key, language).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(language).alias("language")))["language"].alias("language"))


def segments(duration: Column, n: int = 5, length: float = 30.0) -> Column:
    """Starts of n segments spread over a recording; one from the beginning if it is short."""
    step = duration / n
    return F.when(duration <= n * length, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * step))
