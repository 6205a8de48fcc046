"""Concept detection: scores of search results (keywords, concept_id, concept_name, search_score), blended and filtered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.strings import common_letters
from ..sources.store import stash
from .graph import graph_score
from .relational import induced, of_greatest
from .vectors import sums

#: Weights of the mixed score, which sum to one.
WEIGHTS = {
    "search_score": 0.15,
    "levenshtein_score": 0.15,
    "embedding_local_score": 0.05,
    "embedding_global_score": 0.25,
    "graph_score": 0.05,
    "ontology_local_score": 0.1,
    "ontology_global_score": 0.1,
    "embedding_keywords_score": 0.0,
    "graph_keywords_score": 0.0,
    "ontology_keywords_score": 0.15,
}


def search_scores(found: DataFrame, n: int = 10) -> DataFrame:
    """found(keywords, concept_id, concept_name, relevance) to its n best by keywords, with rank and linear search score."""
    w = Window.partitionBy("keywords")
    best = found.withColumn("searchrank", F.row_number().over(w.orderBy(F.desc("relevance"), "concept_id"))).where(F.col("searchrank") <= n)
    return best.withColumn("search_score", 1 - (F.col("searchrank") - 1) / F.count("*").over(w)).drop("relevance")


def levenshtein_scores(results: DataFrame) -> DataFrame:
    """How alike keywords and concept name read.  Each pair of strings is compared once."""
    plain = lambda c: F.lower(F.translate(c, "_", " "))
    pairs = results.select("keywords", "concept_name").distinct()
    a, b = plain("keywords"), plain("concept_name")
    ratio = F.coalesce(F.try_divide(2 * common_letters(a, b), F.length(a) + F.length(b)), F.lit(1.0))
    pairs = pairs.withColumn("levenshtein_score", X.ratio_s_curve(ratio))
    return results.join(pairs, ["keywords", "concept_name"])


def _curve(x: np.ndarray, pivot: float = 0.3) -> np.ndarray:
    """X.power_s_curve() of degree 2 over numbers from 0 to 1."""
    return np.where(x <= pivot, x * x / pivot, 1 - (1 - x) ** 2 / (1 - pivot))


def embedding_scores(results: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean similarity to the other concepts of the keywords, and to all others; concepts without vector count as zero.

    vectors is (concept_id, vector).  The local means come from pairs within keywords, of which each has the ten best at
    most.  For the global means every concept meets all others, since negative products become zero before they are
    averaged: in blocks, without a row for a pair.
    """
    results = stash(results, "results")
    ids = results.select("concept_id").distinct()
    v = stash(ids.join(vectors, "concept_id"), "vectors")
    curve = lambda x: np.where(x > 0, _curve(np.clip(x, 0, 1)), 0.0)
    overall = sums(v.select(F.lit(0).alias("group"), F.col("concept_id").alias("id"), "vector"), curve).toDF("concept_id", "total")
    n = ids.agg((F.count("*") - 1).alias("n"))
    kc = results.select("keywords", "concept_id").distinct()
    of = kc.join(v, "concept_id")
    near = of.select("keywords", F.col("concept_id").alias("a"), F.col("vector").alias("x")).join(of.select("keywords", F.col("concept_id").alias("b"), F.col("vector").alias("y")), "keywords")
    sim = X.power_s_curve(F.greatest(F.lit(0.0), X.dot(F.col("x"), F.col("y"))))
    local = near.where("a <> b").groupBy("keywords", F.col("a").alias("concept_id")).agg(F.sum(sim).alias("near"))
    mates = (F.count("*").over(Window.partitionBy("keywords")) - 1).alias("mates")
    own = kc.select("keywords", "concept_id", mates).join(local, ["keywords", "concept_id"], "left").join(overall, "concept_id", "left").crossJoin(F.broadcast(n))
    own = own.fillna(0, ["near", "total"]).select(
        "keywords", "concept_id",
        F.when(F.col("mates") == 0, 1.0).otherwise(X.safe_div(F.col("near"), F.col("mates"))).alias("local"),
        X.safe_div(F.col("total"), F.col("n")).alias("overall"),
    )
    own = of_greatest(own.toDF("keywords", "concept_id", "embedding_local_score", "embedding_global_score"), "embedding_local_score", "embedding_global_score")
    return results.join(own, ["keywords", "concept_id"])


def ontology_scores(results: DataFrame, edges: DataFrame, categories: DataFrame, smoothing: bool = True) -> DataFrame:
    """Whether the concepts of the same keywords, and of all, fall into the same categories.

    edges is the symmetric concept graph (src, dst, score), categories (concept, level_4, level_3).  A concept without a
    category gets those of its neighbours among the results, in proportion to the edges; one without such neighbours goes.
    """
    results = stash(results, "results")
    kc = results.select("keywords", "concept_id").distinct()
    ids = kc.select(F.col("concept_id").alias("id")).distinct()
    known = categories.join(ids.withColumnRenamed("id", "concept"), "concept", "left_semi").distinct()
    inside = induced(edges, ids).join(known.select(F.col("concept").alias("src")).distinct(), "src", "left_anti")
    votes = inside.join(known.withColumnRenamed("concept", "dst"), "dst")
    coef = F.col("score") / F.sum("score").over(Window.partitionBy("src"))
    votes = votes.withColumn("coef", coef).groupBy(F.col("src").alias("concept"), "level_4", "level_3").agg(F.sum("coef").alias("coef"))
    rows = known.select("concept", "level_4", "level_3").withColumn("coef", F.lit(1.0)).unionByName(votes)
    rows = kc.join(rows.withColumnRenamed("concept", "concept_id"), "concept_id")
    rows = stash(rows, "categories")
    # sums by group are joined back: no window has to hold a category that most rows fall into
    groups = {"local_4": ["keywords", "level_4"], "local_3": ["keywords", "level_3"], "global_4": ["level_4"], "global_3": ["level_3"], "local": ["keywords"]}
    sums = {k: rows.groupBy(*by).agg(F.sum("coef").alias(k)) for k, by in groups.items()}
    total = rows.agg(F.sum("coef").alias("global"))
    for k, by in groups.items():
        rows = rows.join(sums[k].withColumnRenamed(k, f"{k}_x"), by)
    rows = rows.crossJoin(F.broadcast(total))
    counts = {"local_4": ("local_x", 2), "local_3": ("local_x", 2), "global_4": ("global", 8), "global_3": ("global", 8)}
    for k, (size, degree) in counts.items():
        x, n = F.col(f"{k}_x"), F.col(size)
        rows = rows.withColumn(k, X.count_s_curve(x, n, 3, degree) if smoothing else x / n)
    rows = of_greatest(rows.select("keywords", "concept_id", "coef", *counts), *counts)
    mixed = lambda kind: F.sum(F.col("coef") * (0.75 * F.col(f"{kind}_4") + 0.25 * F.col(f"{kind}_3"))).alias(f"ontology_{kind}_score")
    scored = rows.groupBy("keywords", "concept_id").agg(mixed("local"), mixed("global"))
    none = known.agg((F.count("*") == 0).alias("none"))
    out = results.join(scored, ["keywords", "concept_id"], "left").crossJoin(F.broadcast(none))
    for c in ("ontology_local_score", "ontology_global_score"):
        out = out.withColumn(c, F.when(F.col("none"), 1.0).otherwise(F.col(c)))
    return out.where("ontology_local_score is not null").drop("none")


def keywords_scores(results: DataFrame, smoothing: bool = True) -> DataFrame:
    """How much the concepts of the same keywords score together, as a sign of good keywords."""
    for name, of in (("embedding", "embedding_global_score"), ("graph", "graph_score"), ("ontology", "ontology_global_score")):
        results = results.withColumn(f"{name}_keywords_score", F.sum(of).over(Window.partitionBy("keywords")))
    names = [f"{name}_keywords_score" for name in ("embedding", "graph", "ontology")]
    results = of_greatest(results, *names)
    for name in names if smoothing else ():
        results = results.withColumn(name, X.concave(F.col(name)))
    return results


def aggregated(results: DataFrame, coefficient: float = 0.5) -> DataFrame:
    """One row for each concept: the coefficient times the sum over keywords, relative to the greatest, plus the rest times
    the maximum."""
    if not 0 <= coefficient <= 1:
        raise ValueError(f"the coefficient has to be in [0, 1], not {coefficient}")
    both = [f(c).alias(f"{c}_{k}") for c in WEIGHTS for k, f in (("sum", F.sum), ("max", F.max))]
    rows = results.groupBy("concept_id").agg(F.min("concept_name").alias("concept_name"), *both)
    rows = of_greatest(rows, *(f"{c}_sum" for c in WEIGHTS))
    blend = lambda c: coefficient * F.col(f"{c}_sum") + (1 - coefficient) * F.col(f"{c}_max")
    return rows.select("concept_id", "concept_name", *(blend(c).alias(c) for c in WEIGHTS))


def mixed(results: DataFrame) -> DataFrame:
    return results.withColumn("mixed_score", sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)))


def detect(
    results: DataFrame, edges: DataFrame, categories: DataFrame, vectors: DataFrame, only_ontology: bool = False,
    smoothing: bool = True, coefficient: float = 0.5, threshold: float = 0.15, refresh: bool = True,
) -> DataFrame:
    """Scored concepts with a mixed score of at least `threshold`.

    With refresh, the scores are computed a second time over what passed, without a threshold.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"the threshold has to be in [0, 1], not {threshold}")
    if only_ontology:
        results = results.join(categories.select(F.col("concept").alias("concept_id")).distinct(), "concept_id", "left_semi")
    scored = embedding_scores(levenshtein_scores(results), vectors)
    edges = stash(edges, "edges")
    scored = ontology_scores(graph_score(scored, edges, smoothing), edges, categories, smoothing)
    scored = stash(keywords_scores(scored, smoothing), "scored")
    out = mixed(aggregated(scored, coefficient)).where(F.col("mixed_score") >= threshold)
    if not refresh:
        return out
    kept = scored.join(out.select("concept_id"), "concept_id", "left_semi").select("keywords", "concept_id", "concept_name", "search_score")
    return detect(stash(kept, "kept"), edges, categories, vectors, False, smoothing, coefficient, 0.0, False)
