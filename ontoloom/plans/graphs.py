"""Graph and configuration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import configuration as C
from ..operators import graph as G
from ..operators import relational as R
from .derived import Tables, sql
from .investment import r6

Q, S = {}, {}


def query(text: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if text is not None:
            S[f.__name__] = text
        return f

    return add


NORMALISED = "select src, dst, avg(score) score from (select src, dst, score from part_edges union all select dst, src, score from part_edges) group by 1, 2 union all select distinct id, id, 1.0 from (select src id from part_edges union all select dst from part_edges)"
MIX = "select s, dst concept, sum(x.score * e.score / size) score from x join (select *, count(*) over (partition by dst) size from normal) e on concept = src group by 1, 2"
PRUNED = "select s, concept, score from (select *, max(score) over (partition by s) top from mix) where score >= 0.05 * top"
X = "select src s, dst concept, score from holdings"


@query(sql("select src, dst, round(score, 6) score from normal", "part_edges", normal=NORMALISED))
def normalise_graph(t: Tables) -> DataFrame:
    """Mean of both directions, with loops."""
    return G.normalised(t.part_edges()).select("src", "dst", *r6("score"))


def _held(t: Tables) -> DataFrame:
    return t.holdings().select(F.col("src").alias("s"), F.col("dst").alias("concept"), "score")


@query(sql("select s, concept, round(score + 1e-9, 6) score from pruned", "part_edges", "holdings", normal=NORMALISED, x=X, mix=MIX, pruned=PRUNED))
def mix(t: Tables) -> DataFrame:
    """The parts of a supplier spread over their neighbours."""
    out = C.mixed_over(_held(t), t.together())
    return out.select("s", "concept", F.round(F.col("score") + 1e-9, 6).alias("score"))  # sums of quotients often end on a five: none is left to chance


def _pairs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = _held(t)
    y = t("part").select(F.col("p_brand").alias("u"), F.col("p_partkey").alias("concept"), (1 / (1 + F.col("p_size"))).alias("score"))
    return x, y, x.select("s").distinct().crossJoin(y.select("u").distinct())


_Y = "select p_brand u, p_partkey concept, 1 / (1.0 + p_size) score from part"
_AFF = """select s, u, round({0}, 6) score from (select distinct s from x) cross join (select distinct u from y)
left join (select s, u, sum(a.score * b.score) d from {1} a join y b using (concept) group by 1, 2) using (s, u)
left join (select s, sum(score * score) nx from {1} group by 1) using (s) left join (select u, sum(score * score) ny from y group by 1) using (u)"""


@query(sql(_AFF.format("coalesce(d / nullif(sqrt(nx) * sqrt(ny), 0), 0)", "pruned"), "part_edges", "holdings", normal=NORMALISED, x=X, mix=MIX, pruned=PRUNED, y=_Y))
def affinity_cosine(t: Tables) -> DataFrame:
    """How alike suppliers, spread over the graph, and brands are."""
    x, y, pairs = _pairs(t)
    return C.affinities(x, y, pairs, t.together(), mix_x=True).select("s", "u", *r6("score"))


@query(sql(_AFF.format("2 / (1 + exp(2 * sqrt(greatest(0, coalesce(nx, 0) + coalesce(ny, 0) - 2 * coalesce(d, 0)))))", "x"), "holdings", x=X, y=_Y))
def affinity_euclidean(t: Tables) -> DataFrame:
    """The same by distance, unspread."""
    x, y, pairs = _pairs(t)
    return C.affinities(x, y, pairs, method="euclidean").select("s", "u", *r6("score"))


@query(sql("select id, count(*) degree, round(sum(score), 6) strength from (select src id, score from part_edges union all select dst, score from part_edges) group by id", "part_edges"))
def degree(t: Tables) -> DataFrame:
    return G.degrees(t.part_edges()).select("id", "degree", *r6("strength"))


@query(sql("select p_partkey id, case when o is null and i is null then 'isolated' when i is null then 'source' else 'sink' end kind from part left join (select distinct src o from part_edges) on o = p_partkey left join (select distinct dst i from part_edges) on i = p_partkey where o is null or i is null", "part_edges"))
def sources_sinks(t: Tables) -> DataFrame:
    """Parts without an edge in or out."""
    return G.sources_and_sinks(t.part_edges(), t("part").select(F.col("p_partkey").alias("id")))


@query(sql("select id, min(d) distance from (select 0 id, 0 d union all select dst, 1 from part_edges where src = 0 union all select b.dst, 2 from part_edges a join part_edges b on a.dst = b.src where a.src = 0 union all select c.dst, 3 from part_edges a join part_edges b on a.dst = b.src join part_edges c on b.dst = c.src where a.src = 0) group by id", "part_edges"))
def balls(t: Tables) -> DataFrame:
    """Parts within three steps of part 0."""
    return G.ball(t.part_edges(), t.spark.range(1), 3)


@query(sql("select start, id, min(d) distance from (select start, id, 0 d from (select p_partkey start, p_partkey id from part where p_partkey < 3) union all select a.src, a.dst, 1 from part_edges a where src < 3 union all select a.src, b.dst, 2 from part_edges a join part_edges b on a.dst = b.src where a.src < 3 union all select a.src, c.dst, 3 from part_edges a join part_edges b on a.dst = b.src join part_edges c on b.dst = c.src where a.src < 3) group by 1, 2", "part_edges"))
def shortest_distance(t: Tables) -> DataFrame:
    """Steps from three parts to all within three."""
    return G.distances(t.part_edges(), t("part").where("p_partkey < 3").select(F.col("p_partkey").alias("id")), 3)


@query(sql("select id, min(spot) component from reach group by id having count(*) >= 3", "bought", recursive=True, both_="select src a, dst b from bought where n >= 2 union select dst, src from bought where n >= 2", reach="select a id, a spot from both_ union select reach.id, b from reach join both_ on spot = a"))
def connected_components(t: Tables) -> DataFrame:
    """Parts that go together in two orders or more, in components of three or more."""
    comp = G.components(t.bought().where("n >= 2").select("src", "dst"))
    big = comp.groupBy("component").agg(F.count("*").alias("n")).where("n >= 3")
    return comp.join(big, "component").select("id", "component")


@query("with recursive up as (select n_nationkey id, 'N' || n_nationkey node, 'R' || n_regionkey parent, 0 steps from nation union all select up.id, up.parent, 'ROOT', steps + 1 from up where parent like 'R%' and parent <> 'ROOT') select id, node, steps from up union all select n_nationkey, 'ROOT', 2 from nation")
def tree_branch(t: Tables) -> DataFrame:
    """Every nation's way to the root of the second tree."""
    n = t("nation")
    tree = n.select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    tree = tree.union(n.select(F.concat(F.lit("R"), "n_regionkey"), F.lit("ROOT")).distinct())
    up = G.ancestors(tree, 2).where("node like 'N%'")
    return up.select(F.substring("node", 2, 9).cast("int").alias("id"), F.col("ancestor").alias("node"), "steps")


@query(sql("select node, path, len(string_split(path, '/')) - 1 as level from (select 'ROOT' node, 'ROOT' path union all select child, path from (with recursive p as (select child, parent, parent || '/' || child path from tree union all select p.child, tree.parent, tree.parent || '/' || path from p join tree on p.parent = tree.child) select child, path from p where parent = 'ROOT'))", "tree"))
def tree_structure(t: Tables) -> DataFrame:
    """Paths of all categories from the root."""
    return G.paths(t.tree(), 4)


@query(sql("select src, dst, round(score, 6) score from (select src, dst, sum(score) score from (select src, dst, score from part_edges union all select dst, src, score from part_edges) group by 1, 2)", "part_edges"))
def symmetric_sum(t: Tables) -> DataFrame:
    """Both directions, scores added."""
    return G.both_ways(t.part_edges()).select("src", "dst", *r6("score"))


@query(sql("select a.p_name src_name, b.p_name dst_name, src, dst, round(score, 6) score from part_edges join part a on src = a.p_partkey join part b on dst = b.p_partkey where score >= 0.6", "part_edges"))
def drawing_edges(t: Tables) -> DataFrame:
    """Edges strong enough to be drawn, with names."""
    e = t.part_edges().where("score >= 0.6 and src < dst")
    name = lambda c: t("part").select(F.col("p_partkey").alias(c), F.col("p_name").alias(f"{c}_name"))
    return e.join(name("src"), "src").join(name("dst"), "dst").select("src_name", "dst_name", "src", "dst", *r6("score"))


@query(sql("select concept_id, round((2 - share) * share, 6) graph_score from (select src concept_id, sum(score) / max(sum(score)) over () share from (select src, dst, score from part_edges union all select dst, src, score from part_edges) where src in (select p_partkey from part where p_size < 10) and dst in (select p_partkey from part where p_size < 10) group by src)", "part_edges"))
def graph_score(t: Tables) -> DataFrame:
    """Strength of small parts among themselves."""
    e = t.part_edges()
    results = t("part").where("p_size < 10").select(F.col("p_partkey").alias("concept_id"))
    return G.graph_score(results, e.union(e.select("dst", "src", "score"))).select("concept_id", *r6("graph_score"))
