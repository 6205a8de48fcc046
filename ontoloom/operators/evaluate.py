"""Accuracy of ranked predictions, splits and access rights."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy_at(predictions: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """k, accuracy: how often the true category is among the first k of predictions(entity, category, rank)."""
    hit = truth.join(predictions, ["entity", "category"], "left").select("entity", F.coalesce("rank", F.lit(1 << 30)).alias("rank"))
    one = hit.agg(*(F.avg((F.col("rank") <= k).cast("double")).alias(str(k)) for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("accuracy")) for k in ks))).alias("x")).select("x.*")


def error_ratio(predictions: DataFrame, truth: DataFrame, training: DataFrame, k: int) -> DataFrame:
    """category, errors, ratio: test entities of a category missed in the first k, over its training members."""
    hit = predictions.where(F.col("rank") <= k).select("entity", "category").distinct()
    missed = truth.join(hit, ["entity", "category"], "left_anti").groupBy("category").agg(F.count("*").alias("errors"))
    n = training.groupBy("category").agg(F.count("*").alias("n"))
    return missed.join(n, "category").select("category", "errors", (F.col("errors") / F.col("n")).alias("ratio"))


def hash_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """df with test: whether the hash of the key falls into the test share; the same at every run and size."""
    return df.withColumn("test", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(1000)) < int(share * 1000))


def weighted_sample(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """n rows, heavier ones likelier: the least -ln(u) / weight, with u from the hash of the key."""
    u = (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(1_000_003)) + 1) / 1_000_004
    return df.withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", key).limit(n).drop("_k")


def allowed(users: DataFrame, grants: DataFrame, aliases: DataFrame) -> DataFrame:
    """user, index: what each user may read.

    grants(user, index) name an index, an alias or ANY; aliases(alias, index) resolve the second.
    """
    indexes = aliases.select("index").distinct()
    direct = grants.join(indexes, "index", "left_semi").select("user", "index")
    through = grants.select("user", F.col("index").alias("alias")).join(aliases, "alias").select("user", "index")
    anything = grants.where("index = 'ANY'").select("user").distinct().crossJoin(indexes)
    return direct.union(through).union(anything).distinct().join(users.select("user"), "user", "left_semi")


def over_rounds(df: DataFrame, category: str, round_: str, wrong: str) -> DataFrame:
    """category, rounds, mean, deviation: the share of wrong rows of each category, over rounds."""
    each = df.groupBy(category, round_).agg(F.avg(F.col(wrong).cast("double")).alias("error"))
    return each.groupBy(category).agg(F.count("*").alias("rounds"), F.round(F.avg("error"), 6).alias("mean"), F.round(F.stddev_pop("error"), 6).alias("deviation"))


def scopes(text: Column) -> Column:
    """The scopes that a text lists between commas, each once; a null text lists none."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), " *, *"), lambda s: F.length(s) > 0))


def overridden(base: Column, own: Column) -> Column:
    """Limits by name: own ones, which have to be in the base, in place of those of all."""
    return F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(own, e["key"]), e["value"]).alias("value"))))


def weight_errors(scores: DataFrame, columns: list[str], target: str, steps: int) -> DataFrame:
    """weight_<column>..., error: the sum of squared differences from a target under every mix of the columns whose weights
    are multiples of 1 / steps and sum to one.  The mixes are few; each row meets all of them before anything is shuffled."""
    mixes = [[]]
    for k in range(len(columns)):
        mixes = [[*m, n] for m in mixes for n in (range(steps - sum(m) + 1) if k + 1 < len(columns) else [steps - sum(m)])]
    each = F.array(*(F.struct(*(F.lit(n / steps).alias(f"weight_{c}") for c, n in zip(columns, m))) for m in mixes))
    rows = scores.withColumn("w", F.explode(each))
    mixed = sum((F.col(f"w.weight_{c}") * F.col(c) for c in columns), F.lit(0.0))
    return rows.groupBy("w").agg(F.sum((mixed - F.col(target)) * (mixed - F.col(target))).alias("error")).select("w.*", "error")


def tree_features(trees: DataFrame, least: int = 0) -> DataFrame:
    """feature, uses, trees; of trees(id, tree) that are JSON splits {feature, left, right} down to leaves {value}.

    A split of which a side is a leaf and that lies deeper than `least` levels, if there is such a limit, is pruned away.
    A null or broken tree has no features.
    """
    import json

    def splits(node: object, depth: int = 1) -> Iterator[str]:
        if isinstance(node, dict) and "feature" in node and (not least or depth <= least):
            yield str(node["feature"])
            yield from splits(node.get("left"), depth + 1)
            yield from splits(node.get("right"), depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(i, f) for f in splits(json.loads(text or "null"))]
                except ValueError:
                    continue
            yield pa.record_batch([pa.array([i for i, _ in out], pa.int64()), pa.array([f for _, f in out], pa.string())], names=["id", "feature"])

    used = trees.select(F.col("id").cast("long"), F.col("tree").cast("string")).mapInArrow(run, "id long, feature string")
    return used.groupBy("feature").agg(F.count("*").alias("uses"), F.countDistinct("id").alias("trees"))
