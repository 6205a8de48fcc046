"""Content fingerprints, nearest earlier matches and expiring rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import whole_days
from ..functions.udf import lcs_ratio

#: Fixed values of the fingerprint format: windows by length of the text, base and size of the rolling hash, hashes kept.
WINDOWS, BASE, MODULUS, KEPT = (1, 4, 10, 20, 50), 10, 256, 32


def text_fingerprint(text: str | None) -> str | None:
    """32 rolling hashes of the letters and digits of a text as hex, with the window and the width of a hash.

    The window is the widest that is no wider than a 32nd of the text, all its characters counted; an empty text has the
    widest.  In a window the least hash stands for all (winnowing).  Fewer hashes than 32 are filled up with zeros; of
    more, 31 spread evenly from the first on and the last are taken.
    """
    if text is None:
        return None
    letters = [ord(c) for c in text if c.isalnum()]
    want = -(-len(text) // KEPT)
    window = max((w for w in WINDOWS if w <= want), default=WINDOWS[-1])
    k = -(-window // 2)
    hashes, h = [], 0
    for i, c in enumerate(letters):
        h = h * BASE + c if i < k else (h - letters[i - k] * BASE**k + c) * BASE % MODULUS
        if i >= k - 1:
            hashes.append(h % MODULUS)
    if window > 1:
        span = window - k + 1
        chosen, last = [], None
        for i in range(len(hashes) - span + 1):
            part = hashes[i : i + span]
            low = min(part)
            at = i + max(j for j, x in enumerate(part) if x == low)
            if at != last:
                chosen.append(low)
                last = at
        hashes = chosen
    if len(hashes) > KEPT:
        step = (len(hashes) - 1) / (KEPT - 1)
        hashes = [hashes[int(i * step)] for i in range(KEPT - 1)] + [hashes[-1]]
    hashes += [0] * (KEPT - len(hashes))
    return "".join(f"{x:02x}" for x in hashes) + f"_{window:02d}_{k:02d}"


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column fingerprint, made in Arrow batches."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([text_fingerprint(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.record_batch([*batch.columns, prints], names=[*batch.schema.names, "fingerprint"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fingerprint", T.StringType())]))


def earliest(df: DataFrame, key: str, fingerprint: str, date: str) -> DataFrame:
    """key, closest, score: the first other row with the same fingerprint and no later date; itself with -1 if there is none.

    One pass over each fingerprint's rows in order of date: the first row of all is the match of every later one.
    """
    w = Window.partitionBy(fingerprint).orderBy(date, key)
    first = F.first(key).over(w)
    rows = df.where(F.col(fingerprint).isNotNull()).select(key, first.alias("closest"))
    own = F.col("closest") == F.col(key)
    rows = rows.select(key, "closest", F.when(own, -1.0).otherwise(1.0).alias("score"))
    return rows.union(df.where(F.col(fingerprint).isNull()).select(key, F.col(key).alias("closest"), F.lit(-1.0)))


def similar(df: DataFrame, key: str, fingerprint: str, block: str, least: float) -> DataFrame:
    """key, closest, score: the row of the same block with the most similar fingerprint, at least `least`, the first by key
    among equals.  Equal fingerprints are compared once."""
    kinds = df.groupBy(block, fingerprint).agg(F.min(key).alias("first"), F.collect_list(key).alias("keys"))
    a = kinds.select(block, F.col(fingerprint).alias("x"), F.col("keys").alias("own"))
    b = kinds.select(block, F.col(fingerprint).alias("y"), F.col("first").alias("closest"))
    pairs = a.join(b, block).where("x < y or x > y").withColumn("score", lcs_ratio(F.col("x"), F.col("y"))).where(F.col("score") >= least)
    best = pairs.groupBy("own").agg(F.max(F.struct("score", (-F.col("closest")).alias("k"))).alias("b"))
    return best.select(F.explode("own").alias(key), (-F.col("b.k")).alias("closest"), F.col("b.score").alias("score"))


def expired(df: DataFrame, date: str, now, days: int = 7) -> DataFrame:
    return df.where(whole_days(F.col(date), now) >= days)


def purged(df: DataFrame, group: str, date: str, now, days: int = 7) -> DataFrame:
    """df without groups of which any row has expired."""
    return df.join(expired(df, date, now, days).select(group), group, "left_anti")


def cached(asked: DataFrame, store: DataFrame, closest: DataFrame, key: str, value: str) -> DataFrame:
    """asked(key) with the value stored for it, or else for its closest row; null where neither has one."""
    own = store.select(key, F.col(value).alias("own"))
    near = store.select(F.col(key).alias("closest"), F.col(value).alias("near"))
    out = asked.join(own, key, "left").join(closest.select(key, "closest"), key, "left").join(near, "closest", "left")
    return out.select(key, F.coalesce("own", "near").alias(value), F.col("own").isNull().alias("through_closest"))


def mismatched(stored: DataFrame, key: str, fingerprint: str, date: str) -> DataFrame:
    """key, closest of stored(key, fingerprint, date, closest) whose closest row differs in fingerprint or is younger."""
    other = stored.select(F.col(key).alias("closest"), F.col(fingerprint).alias("_fp"), F.col(date).alias("_date"))
    both = stored.where(F.col("closest") != F.col(key)).join(other, "closest")
    return both.where(~F.col(fingerprint).eqNullSafe(F.col("_fp")) | (F.col("_date") > F.col(date))).select(key, "closest")


def repaired(stored: DataFrame, key: str, fingerprint: str, date: str) -> DataFrame:
    """key, closest: what is stored, but for mismatched rows, which get the first row with their fingerprint."""
    right = earliest(stored, key, fingerprint, date).select(key, F.col("closest").alias("right"))
    wrong = mismatched(stored, key, fingerprint, date).select(key, F.lit(True).alias("wrong"))
    both = stored.join(right, key).join(wrong, key, "left")
    return both.select(key, F.when(F.coalesce("wrong", F.lit(False)), F.col("right")).otherwise(F.col("closest")).alias("closest"))


def written_through(results: DataFrame, closest: DataFrame, key: str, value: str, date: str) -> DataFrame:
    """key, value, date: results(key, value, date) stored under their own key and under that of their closest row.

    What is asked of a key itself goes before what came through another; of several the latest counts, then the least.
    """
    own = results.select(key, value, date, F.lit(0).alias("through"))
    near = results.join(closest.select(key, "closest"), key).select(F.col("closest").alias(key), value, date, F.lit(1).alias("through"))
    w = Window.partitionBy(key).orderBy("through", F.desc(date), value)
    return own.union(near).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, value, date)


def outcomes(results: DataFrame, value: str) -> DataFrame:
    """results with successful, and status as a reader of results sees it."""
    done = F.col(value).isNotNull()
    return results.withColumn("successful", done).withColumn("status", F.when(done, "SUCCESS").otherwise("FAILURE"))


def settled(store: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """store after a batch: successes replace rows or are added, failures (null values) delete theirs."""
    kept = store.join(results.select(key), key, "left_anti")
    return kept.unionByName(results.where(F.col(value).isNotNull()).select(store.columns))


def same_source(df: DataFrame, key: str, source: str, length: str, date: str, decimals: int = 2) -> DataFrame:
    """key, closest: the first row of the same source and length, rounded; itself if it is the first."""
    w = Window.partitionBy(source, F.round(length, decimals)).orderBy(date, key)
    return df.select(key, F.first(key).over(w).alias("closest"))


def batches(df: DataFrame, group: str, order: str, size: str, budget: int, span: int = 10_000) -> DataFrame:
    """df with batch: rows of a group in order, as many to a batch as the sum of their sizes stays within budget.

    A row larger than the budget is a batch alone.  Batches also end where the order passes a multiple of `span`, so that
    one large group is the work of many tasks; batch is that multiple and a number from 0.
    """
    columns = [df.columns.index(c) for c in (group, order, size)]
    part = F.floor(F.col(order) / span).cast("long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, full, number = object(), 0, 0
        for batch in rows:
            out = []
            for g, k, n in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (g, k // span) != at:
                    at, full, number = (g, k // span), 0, 0
                elif full + n > budget:
                    full, number = 0, number + 1
                full += n
                out.append(number)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch"])

    dealt = df.repartition(F.col(group), part).sortWithinPartitions(group, part, order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).withColumn("span", part)


def stale(roots: DataFrame, parts: DataFrame, uses: DataFrame, date: str, cutoff) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, parts, leaves) that an old root takes along: its parts, and the leaves that only such parts use.

    roots(root, date), parts(part, root), uses(part, leaf).
    """
    old = roots.where(F.col(date) < cutoff).select("root")
    gone = parts.join(old, "root", "left_semi").select("part").distinct()
    used = uses.join(gone, "part", "left_anti").select("leaf").distinct()
    leaves = uses.join(gone, "part", "left_semi").select("leaf").distinct().join(used, "leaf", "left_anti")
    return old, gone, leaves


def under_flags(asked: DataFrame, store: DataFrame, key: str, **flags: bool) -> DataFrame:
    """asked with origin: "stored" where the store has the key under all the flags, else "made".  A null flag is none."""
    match = store.where(" and ".join(f"`{c}` <=> {str(v).lower()}" for c, v in flags.items()) or "true").select(key).distinct()
    found = match.withColumn("origin", F.lit("stored"))
    return asked.join(found, key, "left").withColumn("origin", F.coalesce("origin", F.lit("made")))


def closest(df: DataFrame, key: str, fingerprint: str, date: str, block: str, least: float) -> DataFrame:
    """key, closest, score: by equality where `least` is one, else by similarity within a block, or equality where nothing
    is similar enough.  Which of the two it is, is decided before anything is read."""
    exact = earliest(df, key, fingerprint, date)
    if least >= 1:
        return exact
    near = similar(df, key, fingerprint, block, least).toDF(key, "_closest", "_score")
    both = exact.join(near, key, "left")
    own = (F.col("score") < 0) & F.col("_closest").isNotNull()
    return both.select(key, F.when(own, F.col("_closest")).otherwise(F.col("closest")).alias("closest"), F.when(own, F.col("_score")).otherwise(F.col("score")).alias("score"))
