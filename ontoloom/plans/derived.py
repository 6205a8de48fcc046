"""Graph, ontology and investment tables derived from the driver tables, as DataFrames and as SQL.

Suppliers invest in parts through orders; parts are concepts, brands clusters, types categories of depth 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest

#: Parents of the categories of depth 4, then of those of depth 3: fixed values of the derived tree.
PARENTS = {
    "ECONOMY": "PRICE", "PROMO": "PRICE", "LARGE": "SIZE", "MEDIUM": "SIZE", "SMALL": "SIZE", "STANDARD": "PLAIN",
    "PRICE": "GOODS", "SIZE": "GOODS", "PLAIN": "GOODS", "GOODS": "ROOT",
}


class Tables:
    """Readers of the driver tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def facts(self) -> DataFrame:
        """Distinct (order, supplier, part)."""
        return self("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()

    def rounds(self) -> DataFrame:
        """Orders as funding rounds: o, day, amount."""
        return self("orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount"))

    def holdings(self) -> DataFrame:
        """src (supplier), dst (part), score: orders they share, out of one more."""
        facts = self("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).repartition("s", "p").distinct()
        return facts.groupBy(F.col("s").alias("src"), F.col("p").alias("dst")).agg((F.count("*") / (F.count("*") + 1.0)).alias("score"))

    def together(self) -> DataFrame:
        """own: the distinct parts of each order."""
        return self("lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("own")).select("own")

    def bought(self) -> DataFrame:
        """src < dst, n: pairs of parts in one order, with the number of orders."""
        pairs = self.together().select(F.explode("own").alias("src"), "own").select("src", F.explode("own").alias("dst")).where("src < dst")
        return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))

    def part_edges(self) -> DataFrame:
        """src < dst, score of part pairs."""
        return self.bought().select("src", "dst", (F.col("n") / (F.col("n") + 1.0)).alias("score"))

    def clusters(self) -> DataFrame:
        """cluster, category: a brand and the type that most of its parts have, the first by name among equals."""
        n = self("part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"))
        return latest(n, ["cluster"], F.desc("n"), F.col("category")).select("cluster", "category")

    def members(self) -> DataFrame:
        """cluster, concept."""
        return self("part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("concept"))

    def anchors(self, n: int = 20) -> DataFrame:
        """category, concept: the cheapest parts of every type."""
        p = self("part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("concept"), "p_retailprice")
        from ..operators.relational import top_n

        return top_n(p, n, ["category"], F.col("p_retailprice"), F.col("concept")).select("category", "concept")

    def tree(self) -> DataFrame:
        """child, parent of the categories: a handful of rows."""
        return self.spark.createDataFrame(list(PARENTS.items()), "child string, parent string")


_TREE = ", ".join(f"('{c}', '{p}')" for c, p in PARENTS.items())
#: The same tables as common table expressions.
CTE = {
    "facts": "select distinct l_orderkey o, l_suppkey s, l_partkey p from lineitem",
    "rounds": "select o_orderkey o, cast(o_orderdate as date) as day, o_totalprice amount from orders",
    "holdings": "select s src, p dst, count(*) / (count(*) + 1.0) score from facts group by s, p",
    "bought": "select a.p src, b.p dst, count(*) n from (select distinct o, p from facts) a join (select distinct o, p from facts) b on a.o = b.o and a.p < b.p group by a.p, b.p",
    "part_edges": "select src, dst, n / (n + 1.0) score from bought",
    "clusters": "select cluster, category from (select p_brand cluster, p_type category, row_number() over (partition by p_brand order by count(*) desc, p_type) k from part group by p_brand, p_type) where k = 1",
    "members": "select p_brand cluster, p_partkey concept from part",
    "anchors": "select category, concept from (select p_type category, p_partkey concept, row_number() over (partition by p_type order by p_retailprice, p_partkey) k from part) where k <= 20",
    "tree": f"select * from (values {_TREE}) t(child, parent)",
}
_NEEDS = {"holdings": ["facts"], "bought": ["facts"], "part_edges": ["facts", "bought"]}


def sql(body: str, *tables: str, recursive: bool = False, **more: str) -> str:
    """body after the named tables and further expressions, in order."""
    names: list[str] = []
    for t in tables:
        names += [n for n in [*_NEEDS.get(t, []), t] if n not in names]
    parts = [f"{n} as ({CTE[n]})" for n in names] + [f"{n} as ({q})" for n, q in more.items()]
    return f"with {'recursive ' * recursive}{', '.join(parts)} {body}" if parts else body
