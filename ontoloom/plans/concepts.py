"""Ontology and concept-detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import graph as G
from ..operators import ontology as O
from ..operators import relational as R
from ..operators import vectors as V
from ..operators import wikify as K
from ..sources.store import stash
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


GRAPH = "select src, dst, score from part_edges union all select dst, src, score from part_edges"
BASE = {"graph": GRAPH}
#: Groups: anchors of categories, members of categories through clusters, members of clusters.
GROUPS = BASE | {
    "inside": "select distinct src concept from graph",
    "ga": "select category g, concept from anchors semi join inside using (concept)",
    "gm": "select category g, concept from members join clusters using (cluster) semi join inside using (concept)",
    "gc": "select cluster g, concept from members semi join inside using (concept)",
    "na": "select g, count(*) n from ga group by g", "nm": "select g, count(*) n from gm group by g", "nc": "select g, count(*) n from gc group by g",
}
NAMES = ("part_edges", "anchors", "members", "clusters", "tree")


class Onto:
    def __init__(self, t: Tables):
        # read for members, sizes and sums: written aside once
        self.graph = stash(G.both_ways(t.part_edges()), "graph")
        self.anchors = O.present(t.anchors().withColumnRenamed("category", "group"), self.graph)
        self.of = t.members().join(t.clusters(), "cluster")
        self.members = O.present(self.of.select(F.col("category").alias("group"), "concept"), self.graph)
        self.clusters = O.present(t.members().withColumnRenamed("cluster", "group"), self.graph)
        self.categories = t.clusters().select("category").distinct().union(t.anchors().select("category")).distinct()

    def both(self, entities: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
        """Anchor and member sums of concepts, or of groups, with every category."""
        if groups is None:
            named = lambda g: O.to_groups(self.graph, g).select(F.col("concept").alias("entity"), F.col("group").alias("category"), "total", "size")
        else:
            named = lambda g: O.between(self.graph, groups, g).select(F.col("first").alias("entity"), F.col("second").alias("category"), "total", "size")
        entities = self.graph.select(F.col("src").alias("entity")).distinct() if groups is None else groups.select(F.col("group").alias("entity")).distinct()
        return O.with_both(entities, self.categories, named(self.anchors), named(self.members))


_PAIRS = "select e entity, c category, coalesce(a.s, 0) s1, coalesce(na.n, 0) n1, coalesce(m.s, 0) s2, coalesce(nm.n, 0) n2 from (select distinct src e from graph) cross join (select distinct category c from (select category from clusters union select category from anchors)) left join (select src e, g c, sum(score) s from graph join ga on dst = concept group by 1, 2) a using (e, c) left join (select src e, g c, sum(score) s from graph join gm on dst = concept group by 1, 2) m using (e, c) left join na on na.g = c left join nm on nm.g = c"
_ONE = lambda n: f"greatest({n}, case when {n} = 0 then 1 else {n} end)"
_LOG = "({0} * s1 / ln(1 + case when n1 = 0 then 1 else n1 end) + {1} * s2 / ln(1 + case when n2 = 0 then 1 else n2 end)) / ({0} + {1})"
_LIN = "({0} * s1 / case when n1 = 0 then 1 else n1 end + {1} * s2 / case when n2 = 0 then 1 else n2 end) / ({0} + {1})"


@query(sql(f"select entity, category, round((s1 + 4 * s2) / 5, 6) as none, round({_LIN.format(1, 4)}, 6) linear, round({_LOG.format(1, 4)}, 6) log from pairs", *NAMES, **GROUPS, pairs=_PAIRS))
def concept_category_similarity(t: Tables) -> DataFrame:
    """Every part with every type, in three modes of averaging."""
    both = Onto(t).both()
    parts = [F.col(c) for c in ("s1", "n1", "s2", "n2")]
    return both.select("entity", "category", *(F.round(X.blended(*parts, m, (1, 4)), 6).alias(m) for m in ("none", "linear", "log")))


_BEST = "select entity, category, round(score, 6) score, k as rank from (select *, row_number() over (partition by entity order by round(score, 9) desc, category) k from scores) where k <= 3"
_DEG = "select src entity, count(*) degree from graph group by src"
_ADAPT = f"select entity, category, case when degree > 20 then {_LIN.format(1, 10)} else {_LOG.format(1, 10)} end score from pairs join deg using (entity)"


@query(sql(_BEST, *NAMES, **GROUPS, pairs=_PAIRS, deg=_DEG, scores=_ADAPT))
def closest_category(t: Tables) -> DataFrame:
    """The three closest types of every part."""
    o = Onto(t)
    degree = o.graph.groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("degree"))
    return O.closest(O.category_scores(o.both().join(degree, "entity"), "adaptive", (1, 10)), 3).select("entity", "category", *r6("score"), "rank")


@query(
    sql(
        "select entity, category, round(score, 6) score, k as rank, chosen from (select s.*, parent, chosen, row_number() over (partition by entity order by parent <> chosen, score desc, category) k from scores s join tree on child = category join (select entity, parent chosen from (select entity, parent, row_number() over (partition by entity order by avg(score) desc, parent) j from scores join tree on child = category group by 1, 2) where j = 1) using (entity)) where k <= 3",
        *NAMES, **GROUPS, pairs=_PAIRS, scores=f"select entity, category, round({_LOG.format(1, 10)}, 9) score from pairs",
    )
)
def closest_category_depth3(t: Tables) -> DataFrame:
    """The same through the best parent."""
    scores = O.category_scores(Onto(t).both(), "log", (1, 10)).withColumn("score", F.round("score", 9))
    return O.closest_through_parent(scores, t.tree(), 3).select("entity", "category", *r6("score"), "rank", "chosen")


@query(sql("select concept, g \"group\", round(s / n, 6) score from (select src concept, g, sum(score) s from graph join gc on dst = concept group by 1, 2) join nc using (g)", *NAMES, **GROUPS))
def concept_cluster_similarity(t: Tables) -> DataFrame:
    o = Onto(t)
    return O.score_of(O.to_groups(o.graph, o.clusters), "linear").select("concept", "group", *r6("score"))


@query(sql("select a \"first\", b \"second\", round(s / ln(1 + x.n * y.n), 6) score from (select p.g a, q.g b, sum(score) s from graph join gc p on src = p.concept join gc q on dst = q.concept group by 1, 2) join nc x on x.g = a join nc y on y.g = b", *NAMES, **GROUPS))
def cluster_cluster_similarity(t: Tables) -> DataFrame:
    o = Onto(t)
    return O.score_of(O.between(o.graph, o.clusters, o.clusters), "log").select("first", "second", *r6("score"))


@query(sql("select a \"first\", b \"second\", round(s / (x.n * y.n), 6) score from (select p.g a, q.g b, sum(score) s from graph join ga p on src = p.concept join ga q on dst = q.concept group by 1, 2) join na x on x.g = a join na y on y.g = b", *NAMES, **GROUPS))
def category_category_similarity(t: Tables) -> DataFrame:
    """Types by their anchors."""
    o = Onto(t)
    return O.score_of(O.between(o.graph, o.anchors, o.anchors), "linear").select("first", "second", *r6("score"))


_CPAIRS = "select e entity, c category, coalesce(a.s, 0) s1, coalesce(a.n, 0) * 1.0 n1_, coalesce(m.s, 0) s2 from (select distinct g e from gc) cross join (select distinct category c from (select category from clusters union select category from anchors)) left join (select p.g e, q.g c, sum(score) s, 0 n from graph join gc p on src = p.concept join ga q on dst = q.concept group by 1, 2) a using (e, c) left join (select p.g e, q.g c, sum(score) s from graph join gc p on src = p.concept join gm q on dst = q.concept group by 1, 2) m using (e, c)"


@query(sql("select entity, category, round(s, 6) score, k as rank from (select entity, category, (s1 + 10 * s2) / 11 s, row_number() over (partition by entity order by round((s1 + 10 * s2) / 11, 9) desc, category) k from pairs) where k <= 2", *NAMES, **GROUPS, pairs=_CPAIRS))
def cluster_closest_category(t: Tables) -> DataFrame:
    """The two closest types of every brand, without averaging."""
    o = Onto(t)
    return O.closest(O.category_scores(o.both(groups=o.clusters), "none", (1, 10)), 2).select("entity", "category", *r6("score"), "rank")


@query(sql("select src, dst, round(score, 6) score, k as rank from (select *, row_number() over (partition by src order by score desc, dst) k from graph) where k <= 3", "part_edges", **BASE))
def closest_concept(t: Tables) -> DataFrame:
    best = R.Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    g = G.both_ways(t.part_edges()).withColumn("rank", F.row_number().over(best))
    return g.where("rank <= 3").select("src", "dst", *r6("score"), "rank")


@query(sql("with recursive up as (select category node, category anc from anchors union select up.node, parent from up join tree on child = anc) select distinct anc category, concept from up join anchors on category = node", "anchors", "tree").replace("with anchors as", "with recursive anchors as", 1).replace(" with recursive up as", ", up as", 1))
def anchor_inheritance(t: Tables) -> DataFrame:
    """Anchors of every category and of all below it."""
    return O.inherited(t.anchors(), t.tree())


@query(sql("select category, parent, coalesce(n, 0) n_clusters, clusters, coalesce(a, 0) n_anchors from (select child category, parent from tree where child in (select p_type from part)) left join (select category, count(*) n, string_agg(cluster, ',' order by cluster) clusters from clusters group by 1) using (category) left join (select category, count(*) a from anchors group by 1) using (category)", "anchors", "clusters", "tree"))
def info_card(t: Tables) -> DataFrame:
    """What is known of every type."""
    types = t("part").select(F.col("p_type").alias("category")).distinct()
    card = t.tree().withColumnRenamed("child", "category").join(types, "category", "left_semi")
    c = t.clusters().groupBy("category").agg(F.count("*").alias("n_clusters"), F.array_join(F.array_sort(F.collect_list("cluster")), ",").alias("clusters"))
    a = t.anchors().groupBy("category").agg(F.count("*").alias("n_anchors"))
    return card.join(c, "category", "left").join(a, "category", "left").fillna(0, ["n_clusters", "n_anchors"]).select("category", "parent", "n_clusters", "clusters", "n_anchors")


_VEC = "select vec_id, label, embedding from embeddings"
_SIM = "select src, dst, score from (select a.vec_id src, b.vec_id dst, list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) score, row_number() over (partition by a.vec_id order by round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) desc, b.vec_id) k from vec a join vec b on a.label = b.label and a.vec_id <> b.vec_id) where k <= 5"


@query(sql("select src, category, round(total, 6) total from (select src, category, sum(score) total from sim join members on dst = concept join clusters using (cluster) group by 1, 2)", "members", "clusters", vec=_VEC, sim=_SIM))
def embedding_fallback(t: Tables) -> DataFrame:
    """Types of the nearest vectors of every vector: neighbours, their brands, their types."""
    sim = V.nearest(t("embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5)
    out = sim.join(t.members().withColumnRenamed("concept", "dst"), "dst").join(t.clusters(), "cluster")
    return out.groupBy("src", "category").agg(F.round(F.sum("score"), 6).alias("total"))


# Concept detection.  Keywords are the names of parts; they find parts that share a word.

FOUND = "select k.p_name keywords, c.p_partkey concept_id, c.p_name concept_name, (case when split_part(k.p_name, ' ', 1) = split_part(c.p_name, ' ', 1) then 1 else 0 end) + (case when split_part(k.p_name, ' ', 2) = split_part(c.p_name, ' ', 2) then 1 else 0 end) + 1.0 / (1 + c.p_size) relevance from (select distinct p_name from part) k join part c on split_part(k.p_name, ' ', 1) = split_part(c.p_name, ' ', 1) or split_part(k.p_name, ' ', 2) = split_part(c.p_name, ' ', 2)"
RESULTS = "select keywords, concept_id, concept_name, k searchrank, 1 - (k - 1) / cast(count(*) over (partition by keywords) as double) search_score from (select *, row_number() over (partition by keywords order by relevance desc, concept_id) k from found) where k <= 10"


def _results(t: Tables) -> DataFrame:
    p = t("part").withColumn("w1", F.split("p_name", " ")[0]).withColumn("w2", F.split("p_name", " ")[1])
    k = p.select(F.col("p_name").alias("keywords"), F.col("w1").alias("k1"), F.col("w2").alias("k2")).distinct()
    c = p.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), "w1", "w2", "p_size")
    words = lambda df, a, b, keep: df.select(*keep, F.explode(F.array(F.concat(F.lit("1"), a), F.concat(F.lit("2"), b))).alias("word"))
    hits = words(k, "k1", "k2", ["keywords"]).join(words(c, "w1", "w2", ["concept_id", "concept_name", "p_size"]), "word")
    hits = hits.groupBy("keywords", "concept_id", "concept_name", "p_size").agg(F.count("*").alias("n"))
    return K.search_scores(hits.select("keywords", "concept_id", "concept_name", (F.col("n") + 1.0 / (1 + F.col("p_size"))).alias("relevance")))


@query(sql("select keywords, concept_id, concept_name, searchrank, round(search_score, 6) search_score from results", found=FOUND, results=RESULTS))
def search_top10(t: Tables) -> DataFrame:
    return _results(t).select("keywords", "concept_id", "concept_name", "searchrank", *r6("search_score"))


_LCS = "list_extract(list_reduce(list_transform(string_split(lower(keywords), ''), lambda c: [unicode(c)]), lambda prev, c: list_reduce(list_transform(range(1, length(concept_name) + 1), lambda j: [cast(j as integer)]), lambda st, j: list_append(st, case when unicode(substr(lower(concept_name), j[1], 1)) = c[1] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], st[j[1]]) end), [0]), list_transform(range(length(concept_name) + 1), lambda z: 0)), -1)"


_RATIO = f"select keywords, concept_id, 2.0 * {_LCS} / (length(keywords) + length(concept_name)) x from results"


@query(sql("select keywords, concept_id, round(x * x / (x * x + (1 - x) * (1 - x)) + 1e-9, 6) levenshtein_score from ratio", found=FOUND, results=RESULTS, ratio=_RATIO))
def levenshtein_score(t: Tables) -> DataFrame:
    """How alike keywords and names read."""
    score = F.round(F.col("levenshtein_score") + 1e-9, 6).alias("levenshtein_score")
    return K.levenshtein_scores(_results(t)).select("keywords", "concept_id", score)


_V = "select concept_id, embedding from (select distinct concept_id from results) join embeddings on vec_id = concept_id"
_P = "select a, b, case when d <= 0.3 then d * d / 0.3 else 1 - (1 - d) * (1 - d) / 0.7 end sim from (select x.concept_id a, y.concept_id b, greatest(0, least(1, list_inner_product(cast(x.embedding as double[]), cast(y.embedding as double[])))) d from v x join v y on x.concept_id <> y.concept_id)"
_E = "select keywords, concept_id, case when mates = 0 then 1.0 else coalesce(near, 0) / mates end l, coalesce(total, 0) / (select count(distinct concept_id) - 1 from results) g from (select keywords, concept_id, count(*) over (partition by keywords) - 1 mates from results) left join (select keywords, a concept_id, sum(sim) near from (select x.keywords, x.concept_id a, y.concept_id b from results x join results y on x.keywords = y.keywords and x.concept_id <> y.concept_id) join p using (a, b) group by 1, 2) using (keywords, concept_id) left join (select a concept_id, sum(sim) total from p group by a) using (concept_id)"


def _vectors(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector"))


@query(sql("select keywords, concept_id, round(l / max(l) over (), 6) embedding_local_score, round(g / max(g) over (), 6) embedding_global_score from e", found=FOUND, results=RESULTS, v=_V, p=_P, e=_E))
def embedding_scores(t: Tables) -> DataFrame:
    return K.embedding_scores(_results(t), _vectors(t)).select("keywords", "concept_id", *r6("embedding_local_score", "embedding_global_score"))


def _categories(t: Tables) -> DataFrame:
    """Types of depth 4 and 3 of the parts that have any: the small ones."""
    small = t("part").where("p_size <= 25").select(F.col("p_partkey").alias("concept"))
    of = t.members().join(small, "concept", "left_semi").join(t.clusters(), "cluster").withColumnRenamed("category", "level_4")
    return of.join(F.broadcast(t.tree().select(F.col("child").alias("level_4"), F.col("parent").alias("level_3"))), "level_4").select("concept", "level_4", "level_3")


_CAT = "select concept, category level_4, parent level_3 from members join clusters using (cluster) join tree on child = category where concept in (select p_partkey from part where p_size <= 25)"
_H = lambda x, n, d: f"case when {x} / {n} <= greatest(0.5, least(3, {n} - 0.5)) / {n} then pow({x} / {n}, {d}) / pow(greatest(0.5, least(3, {n} - 0.5)) / {n}, {d - 1}) else 1 - pow(1 - {x} / {n}, {d}) / pow(1 - greatest(0.5, least(3, {n} - 0.5)) / {n}, {d - 1}) end"
_ONT = {
    "known": "select c.* from cat c where concept in (select concept_id from results)",
    "votes": "select src concept, level_4, level_3, sum(coef) coef from (select src, level_4, level_3, score / sum(score) over (partition by src) coef from full_graph join known on dst = concept where src in (select concept_id from results) and src not in (select concept from known)) group by 1, 2, 3",
    "rows_": "select keywords, concept_id, level_4, level_3, coef from results join (select concept, level_4, level_3, 1.0 coef from known union all select * from votes) on concept = concept_id",
    "counts": "select *, sum(coef) over (partition by keywords) n, sum(coef) over () total, sum(coef) over (partition by keywords, level_4) l4, sum(coef) over (partition by keywords, level_3) l3, sum(coef) over (partition by level_4) g4, sum(coef) over (partition by level_3) g3 from rows_",
    "curves": f"select keywords, concept_id, coef, {_H('l4', 'n', 2)} l4, {_H('l3', 'n', 2)} l3, {_H('g4', 'total', 8)} g4, {_H('g3', 'total', 8)} g3 from counts",
    "shares": "select keywords, concept_id, coef, l4 / max(l4) over () l4, l3 / max(l3) over () l3, g4 / max(g4) over () g4, g3 / max(g3) over () g3 from curves",
}
_FULL = "select src, dst, score from part_edges union all select dst, src, score from part_edges"


def _full(t: Tables) -> DataFrame:
    e = t.part_edges()
    return e.union(e.select("dst", "src", "score"))


@query(sql("select keywords, concept_id, round(sum(coef * (0.75 * l4 + 0.25 * l3)), 6) ontology_local_score, round(sum(coef * (0.75 * g4 + 0.25 * g3)), 6) ontology_global_score from shares group by 1, 2", "part_edges", "members", "clusters", "tree", found=FOUND, results=RESULTS, full_graph=_FULL, cat=_CAT, **_ONT))
def ontology_scores(t: Tables) -> DataFrame:
    return K.ontology_scores(_results(t), _full(t), _categories(t)).select("keywords", "concept_id", *r6("ontology_local_score", "ontology_global_score"))


@query(sql("select keywords, concept_id, round((2 - x / max(x) over ()) * (x / max(x) over ()), 6) keywords_score from (select keywords, concept_id, sum(search_score) over (partition by keywords) x from results)", found=FOUND, results=RESULTS))
def keywords_scores(t: Tables) -> DataFrame:
    """The keywords score, with search scores in all three places."""
    r = _results(t)
    r = r.withColumn("embedding_global_score", F.col("search_score")).withColumn("graph_score", F.col("search_score")).withColumn("ontology_global_score", F.col("search_score"))
    return K.keywords_scores(r).select("keywords", "concept_id", F.round("graph_keywords_score", 6).alias("keywords_score"))


@query(sql("select concept_id, min(concept_name) concept_name, round(0.5 * sum(search_score) / max(sum(search_score)) over () + 0.5 * max(search_score), 6) mixed_score from results group by concept_id having true", found=FOUND, results=RESULTS))
def aggregate_and_mix(t: Tables) -> DataFrame:
    """Results added up by concept; with one score in all places the mix is that score."""
    r = _results(t)
    r = r.select("concept_id", "concept_name", *(F.col("search_score").alias(c) for c in K.WEIGHTS))
    return K.mixed(K.aggregated(r)).select("concept_id", "concept_name", *r6("mixed_score"))


@query()
def wikify_refresh(t: Tables) -> DataFrame:
    """Detected concepts, scored in two passes."""
    out = K.detect(_results(t), _full(t), _categories(t), _vectors(t))
    return out.select("concept_id", "concept_name", *r6(*K.WEIGHTS, "mixed_score"))


# Edits of the ontology.


@query(sql("select cluster, case when cluster = 'Brand#1' then 'PROMO' else category end category from clusters", "clusters"))
def ontology_move_cluster(t: Tables) -> DataFrame:
    moves = t.spark.createDataFrame([("Brand#1", "PROMO")], "cluster string, target string")
    return O.move_clusters(t.clusters(), moves)


@query(sql("select case when cluster = 'Brand#2' and concept in (select p_partkey from part where p_size > 25) then 'Brand#2b' else cluster end cluster, concept from members", "members"))
def ontology_split_cluster(t: Tables) -> DataFrame:
    return O.split_cluster(t.members(), "Brand#2", t("part").where("p_size > 25").select(F.col("p_partkey").alias("concept")), "Brand#2b")


@query(sql("select cluster, concept, cluster in (select cluster from members) and concept not in (select concept from members) processed from (select 'Brand#' || (o_custkey % 40) cluster, o_orderkey concept from orders)", "members"))
def ontology_insert_concepts(t: Tables) -> DataFrame:
    new = t("orders").select(F.concat(F.lit("Brand#"), F.col("o_custkey") % 40).alias("cluster"), F.col("o_orderkey").alias("concept"))
    return O.insert_concepts(t.members(), new)[1]
