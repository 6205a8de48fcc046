"""Similarity of concepts, clusters and categories over a symmetric concept graph.

A group is any set of concepts, given by a table (group, concept).  The sum of edge scores between two entities is
one join and one aggregation; how it is averaged over group sizes is left to the caller's mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import averaged, blended
from .relational import top_n


def present(groups: DataFrame, graph: DataFrame) -> DataFrame:
    """The members that the graph knows."""
    return groups.join(graph.select(F.col("src").alias("concept")).distinct(), "concept", "left_semi").select("group", "concept").distinct()


def sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group").agg(F.count("*").alias("size"))


def to_groups(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """concept, group, total, size: edge scores between every concept and every group it has an edge into."""
    into = graph.join(groups.withColumnRenamed("concept", "dst"), "dst").groupBy(F.col("src").alias("concept"), "group")
    return into.agg(F.sum("score").alias("total")).join(sizes(groups), "group").select("concept", "group", "total", "size")


def between(graph: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """first, second, total, size of two kinds of groups; the size is the number of pairs."""
    a = first.select(F.col("group").alias("first"), F.col("concept").alias("src"))
    sums = to_groups(graph, second).select(F.col("concept").alias("src"), F.col("group").alias("second"), "total", "size")
    sums = a.join(sums, "src").groupBy("first", "second").agg(F.sum("total").alias("total"), F.max("size").alias("n2"))
    n1 = sizes(first).select(F.col("group").alias("first"), F.col("size").alias("n1"))
    return sums.join(n1, "first").select("first", "second", "total", (F.col("n1") * F.col("n2")).alias("size"))


def with_both(concepts: DataFrame, categories: DataFrame, anchors: DataFrame, members: DataFrame) -> DataFrame:
    """entity, category, s1, n1 (anchors), s2, n2 (members) for every pair; zero sums where there is no edge.

    concepts has one column, entity; categories has category; the sums are (entity, category, total, size).
    """
    every = concepts.crossJoin(categories)
    for k, sums in ((1, anchors), (2, members)):
        n = sums.groupBy("category").agg(F.max("size").alias(f"n{k}"))
        every = every.join(sums.select("entity", "category", F.col("total").alias(f"s{k}")), ["entity", "category"], "left").join(n, "category", "left")
    return every.fillna(0, ["s1", "s2", "n1", "n2"])


def category_scores(both: DataFrame, mode: str, coefficients: tuple[float, float] | None) -> DataFrame:
    """entity, category, score.  Mode "adaptive" is linear for entities of degree over 20 (column degree), else log."""
    parts = [F.col(c) for c in ("s1", "n1", "s2", "n2")]
    if mode == "adaptive":
        score = F.when(F.col("degree") > 20, blended(*parts, "linear", coefficients)).otherwise(blended(*parts, "log", coefficients))
    else:
        score = blended(*parts, mode, coefficients)
    return both.select("entity", "category", score.alias("score"))


def closest(scores: DataFrame, n: int) -> DataFrame:
    """entity, category, score, rank: the n best categories of each entity; scores that agree in nine decimals are equal."""
    best = Window.partitionBy("entity").orderBy(F.desc(F.round("score", 9)), "category")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def closest_through_parent(scores: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """The same, but children of the parent with the best mean come first; the scores are left as they are."""
    of = scores.join(tree.select(F.col("child").alias("category"), "parent"), "category")
    mean = of.groupBy("entity", "parent").agg(F.avg("score").alias("mean"))
    chosen = top_n(mean, 1, ["entity"], F.desc("mean"), F.col("parent")).select("entity", F.col("parent").alias("chosen"))
    of = of.join(chosen, "entity")
    best = Window.partitionBy("entity").orderBy((F.col("parent") != F.col("chosen")).cast("int"), F.desc("score"), "category")
    return of.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("entity", "category", "score", "rank", "chosen")


def inherited(anchors: DataFrame, tree: DataFrame, depth: int = 4) -> DataFrame:
    """category, concept: anchors of a category and of all below it."""
    from .graph import ancestors

    up = ancestors(tree, depth).select(F.col("node").alias("category"), "ancestor")
    return anchors.join(up, "category").select(F.col("ancestor").alias("category"), "concept").distinct()


def score_of(sums: DataFrame, mode: str) -> DataFrame:
    return sums.withColumn("score", averaged(F.col("total"), F.col("size"), mode))


def move_clusters(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    """clusters(cluster, category) after moves(cluster, target)."""
    return clusters.join(moves, "cluster", "left").select("cluster", F.coalesce("target", "category").alias("category"))


def split_cluster(members: DataFrame, cluster: str, concepts: DataFrame, new_cluster: str) -> DataFrame:
    """members(cluster, concept) with the given concepts of a cluster in a new one."""
    chosen = concepts.select("concept", F.lit(True).alias("chosen"))
    moved = (F.col("cluster") == cluster) & F.coalesce("chosen", F.lit(False))
    return members.join(chosen, "concept", "left").select(F.when(moved, F.lit(new_cluster)).otherwise(F.col("cluster")).alias("cluster"), "concept")


def insert_concepts(members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with the accepted rows, new with processed): a row of new(cluster, concept) is accepted if the cluster exists
    and the concept is in none yet."""
    known = members.select("cluster").distinct().withColumn("has_cluster", F.lit(True))
    taken = members.select("concept").distinct().withColumn("has_concept", F.lit(True))
    judged = new.join(known, "cluster", "left").join(taken, "concept", "left")
    judged = judged.withColumn("processed", F.coalesce("has_cluster", F.lit(False)) & F.col("has_concept").isNull())
    accepted = judged.where("processed").select("cluster", "concept")
    return members.select("cluster", "concept").unionByName(accepted), judged.select("cluster", "concept", "processed")


def closest_clusters(graph: DataFrame, of: DataFrame, n: int = 3, mode: str = "linear") -> DataFrame:
    """concept, category, cluster, score, rank: the n clusters of each category that are closest to each concept.

    of is (cluster, category, concept).  Clusters without an edge to the concept are not among them.
    """
    sums = score_of(to_groups(graph, of.select(F.col("cluster").alias("group"), "concept")), mode)
    sums = sums.join(of.select(F.col("cluster").alias("group"), "category").distinct(), "group").select("concept", "category", F.col("group").alias("cluster"), "score")
    best = Window.partitionBy("concept", "category").orderBy(F.desc(F.round("score", 9)), "cluster")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def similarity(graph: DataFrame, groups: dict[str, DataFrame], source: str, target: str, mode: str = "linear") -> DataFrame:
    """first, second, score between entities of two kinds: "concept" or any name in groups(group, concept).

    A concept is a group of itself, so one rule serves all pairs of kinds.
    """
    alone = graph.select(F.col("src").alias("group"), F.col("src").alias("concept")).distinct()
    of = lambda kind: alone if kind == "concept" else groups[kind]
    named = lambda g: g.select(F.col("group").cast("string").alias("group"), "concept")
    return score_of(between(graph, named(of(source)), named(of(target))), mode).select("first", "second", "score")


def aligned(topics: DataFrame) -> DataFrame:
    """category, topic, score, rank: the topics of each category, the best first; a leading T of a topic's id goes."""
    t = topics.withColumn("topic", F.regexp_replace("topic", "^T", "").cast("long"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "topic")))


def add_category(tree: DataFrame, anchors: DataFrame, clusters: DataFrame, name: str, parent: str, concepts: DataFrame, moved: DataFrame) -> tuple[DataFrame, ...]:
    """(tree, anchors, clusters) with a new category under a parent, anchored to concepts(concept).

    moved(cluster) are clusters that it takes over from other categories.
    """
    spark = tree.sparkSession
    tree = tree.unionByName(spark.createDataFrame([(name, parent)], "child string, parent string")).distinct()
    anchors = anchors.unionByName(concepts.select(F.lit(name).alias("category"), "concept")).distinct()
    taken = moved.select("cluster", F.lit(name).alias("target"))
    return tree, anchors, move_clusters(clusters, taken)


def new_cluster(members: DataFrame, clusters: DataFrame, concepts: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) with the concepts that no cluster has yet in a new one, whose number follows the greatest.

    members(cluster, concept), clusters(cluster, category), with numbers for clusters.
    """
    number = clusters.agg((F.coalesce(F.max("cluster"), F.lit(-1)) + 1).alias("cluster"))
    free = concepts.select("concept").distinct().join(members, "concept", "left_anti")
    added = free.crossJoin(F.broadcast(number)).select("cluster", "concept")
    row = number.select("cluster", F.lit(category).alias("category"))
    return members.select("cluster", "concept").unionByName(added), clusters.select("cluster", "category").unionByName(row)


def statistics(tree: DataFrame, clusters: DataFrame, members: DataFrame, width: int = 20) -> tuple[DataFrame, DataFrame]:
    """(category, clusters, concepts; bin, clusters): sizes of all leaf categories, empty ones included, and a histogram of
    the sizes of clusters in bins of a width."""
    leaves = tree.select(F.col("child").alias("category")).join(tree.select(F.col("parent").alias("category")).distinct(), "category", "left_anti")
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    of = clusters.join(n, "cluster", "left").groupBy("category").agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("concepts"))
    return leaves.join(of, "category", "left").fillna(0, ["clusters", "concepts"]), n.groupBy(F.floor(F.col("n") / width).alias("bin")).agg(F.count("*").alias("clusters"))
