"""Queries over retrieval, caches, slides, edits of the ontology and the stages of the investment pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as TX
from ..operators import cache as CA
from ..operators import configuration as C
from ..operators import evaluate as EV
from ..operators import graph as G
from ..operators import ontology as O
from ..operators import relational as R
from ..operators import search as SE
from ..operators import slides as SL
from ..sources.store import stash
from .concepts import FOUND, GRAPH, RESULTS, _results
from .derived import Tables, sql
from .graphs import MIX, NORMALISED, X as HELD
from .investment import r6
from .texts import _ASK, _POST, _STOPS, _W, _asked, _index

Q, S = {}, {}


def query(text: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if text is not None:
            S[f.__name__] = text
        return f

    return add


# Retrieval.

_BM = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))"


@query(
    f"with p as ({_POST}), q as ({_ASK}), n as (select count(*) docs, avg(length) mean from (select distinct doc_id, length from p)), d as (select term, count(*) df from p group by 1), b as (select query, doc_id, round(sum({_BM}), 6) s from p join q using (term) join d using (term), n group by 1, 2), h as (select query, doc_id, round(s + 2 * coalesce(list_inner_product(cast(x.embedding as double[]), cast(y.embedding as double[])), 0), 6) score from b join documents using (doc_id) left join embeddings x on x.vec_id = doc_id left join embeddings y on y.vec_id = query where lang in ('en', 'fr')) select query, doc_id, score, k as rank from (select *, row_number() over (partition by query order by score desc, doc_id) k from h) where k <= 10"
)
def hybrid_search(t: Tables) -> DataFrame:
    """The ten best English and French documents by words and vectors; a filter that the index does not allow has no effect."""
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    docs = SE.filtered(t("documents"), "documents", {"lang": ["en", "fr"], "n_chars": 7})
    # frequencies are those of all documents; the filter comes after
    found = SE.hybrid(_index(t), _asked(t), vectors, vectors.withColumnRenamed("doc_id", "query"), "doc_id", 2.0, 1 << 30)
    found = found.join(docs.select("doc_id"), "doc_id", "left_semi")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where("rank <= 10").select("query", "doc_id", "score", "rank")


@query(
    f"with p as ({_POST}), q as ({_ASK}), n as (select count(distinct doc_id) docs from p), d as (select term, count(*) df, sum(tf) ttf from p group by 1), x as (select query, doc_id, tf, length, ttf, ln((docs + 1) / (df + 1.0)) + 1 idf from p join q using (term) join d using (term), n) select query, doc_id, count(*) matched, max(length) length, round(min(idf), 6) min_idf, round(max(idf), 6) max_idf, round(avg(idf), 6) avg_idf, round(sum(idf), 6) sum_idf, round(stddev_pop(idf), 6) dev_idf, cast(min(ttf) as bigint) min_ttf, cast(max(ttf) as bigint) max_ttf, round(avg(ttf), 4) avg_ttf, cast(sum(ttf) as bigint) sum_ttf, round(stddev_pop(ttf), 4) dev_ttf from x group by 1, 2"
)
def ranking_features(t: Tables) -> DataFrame:
    """All moments of idf and ttf that a learnt ranking sees."""
    f = SE.rank_features(_index(t), _asked(t), "doc_id")
    idf = r6("min_idf", "max_idf", "avg_idf", "sum_idf", "dev_idf")
    return f.select("query", "doc_id", "matched", F.col("length").cast("long").alias("length"), *idf, "min_ttf", "max_ttf", "sum_ttf", *(F.round(c, 4).alias(c) for c in ("avg_ttf", "dev_ttf")))


@query(sql("select keywords, cast(count(*) filter (b.s is null) as bigint) \"old\", cast(count(*) filter (a.s is null) as bigint) \"new\", cast(count(*) filter (a.s is not null and b.s is not null) as bigint) both_ from (select keywords, concept_id, search_score s from results where searchrank <= 7) a full join (select keywords, concept_id, search_score s from results where search_score < 0.9) b using (keywords, concept_id) group by 1", found=FOUND, results=RESULTS))
def old_new_counts(t: Tables) -> DataFrame:
    """How many concepts of each keyword only one detection has, or both."""
    r = stash(_results(t), "results")
    both = SE.compared(r.where("searchrank <= 7"), r.where("search_score < 0.9"), ["keywords", "concept_id"], "search_score")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return both.groupBy("keywords").agg(n("old").alias("old"), n("new").alias("new"), n("both").alias("both_"))


_PW = "list_filter(regexp_split_to_array(lower({0}), '" + TX.WORDS + "'), lambda w: length(w) > 0)"


@query(f"with w as (select p_partkey, unnest({_PW.format('p_name')}) term, 1 k from part union all select p_partkey, unnest({_PW.format('p_brand')}), 5 from part union all select p_partkey, unnest({_PW.format('p_type')}), 8 from part) select p_partkey, term, cast(sum(k) as bigint) tf, cast(sum(sum(k)) over (partition by p_partkey) as bigint) length from w group by 1, 2")
def weighted_fields(t: Tables) -> DataFrame:
    """Postings of parts over name, brand and type, which count once, five and eight times."""
    p = SE.weighted_postings(t("part"), "p_partkey", SE.settings("parts")["fields"])
    return p.select("p_partkey", "term", F.col("tf").cast("long").alias("tf"), F.col("length").cast("long").alias("length"))


@query(f"with p as ({_POST}) select term, count(*) df, cast(sum(tf) as bigint) ttf from p group by 1")
def index_terms(t: Tables) -> DataFrame:
    """How many documents have a term, and how often it stands in all."""
    return SE.index_tables(_index(t), "doc_id")[0]


_STEM = r"case when regexp_matches(w, '[^aeiou]ies$') then regexp_replace(w, 'ies$', 'y') when regexp_matches(w, '[^aeious]s$|[^o]es$') and not regexp_matches(w, '(ss|us)$') then regexp_replace(w, 's$', '') else w end"
_EN = ", ".join(f"'{w}'" for w in sorted(TX.STOP_WORDS["en"]))


@query(rf"select doc_id, cast(len(a) as bigint) n, md5(array_to_string(a, ' ')) words from (select doc_id, list_transform(list_filter(regexp_split_to_array(translate(regexp_replace(lower(coalesce(text, '')), '[''’]s([^a-z]|$)', ' \1', 'g'), '{TX.ACCENTS[0]}', '{TX.ACCENTS[1]}'), '[^a-z0-9]+'), lambda w: length(w) > 0 and w not in ({_EN})), lambda w: {_STEM}) a from documents)")
def analysed_words(t: Tables) -> DataFrame:
    """Words of documents as an index takes them."""
    a = SE.analysed(F.col("text"))
    return t("documents").select("doc_id", F.size(a).cast("long").alias("n"), F.md5(F.array_join(a, " ")).alias("words"))


@query(sql("select keywords, concept_id, round(a.s, 6) old, round(b.s, 6) as new, case when b.s is null then 'old' when a.s is null then 'new' else 'both' end kind, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) change from (select keywords, concept_id, search_score s from results where searchrank <= 7) a full join (select keywords, concept_id, search_score * search_score s from results where search_score < 0.9) b using (keywords, concept_id)", found=FOUND, results=RESULTS))
def old_and_new(t: Tables) -> DataFrame:
    """Two detections of concepts side by side."""
    r = stash(_results(t), "results")
    old, new = r.where("searchrank <= 7"), r.where("search_score < 0.9").withColumn("search_score", F.col("search_score") * F.col("search_score"))
    return SE.compared(old, new, ["keywords", "concept_id"], "search_score").select("keywords", "concept_id", *r6("old", "new"), "kind", *r6("change"))


@query(
    f"""with t as (select item_id, replace(replace(text, '. ', chr(10)), ', ', chr(10)) t from benchmark union all select 1000000 + item_id, left(text, 9) from benchmark),
l as (select item_id, -1 line, t from t union all select item_id, generate_subscripts(string_split(t, chr(10)), 1), unnest(string_split(t, chr(10))) from t),
c as (select item_id, line, generate_subscripts(p, 1) part, unnest(p) chunk from (select item_id, line, regexp_split_to_array(lower(t), '[^a-z0-9àâäáéèêëíîïñóôöúùûüçß ]+') p from l)),
w as (select item_id, line, part, generate_subscripts(v, 1) pos, unnest(v) word from (select item_id, line, part, regexp_split_to_array(chunk, ' +') v from c)),
r as (select *, sum(case when word in ({_STOPS}) then 1 else 0 end) over (partition by item_id, line, part order by pos) run from w where word <> ''),
ph as (select item_id, line, part, run, list(word order by pos) v from r where word not in ({_STOPS}) group by 1, 2, 3, 4),
x as (select item_id, line, array_to_string(v, ' ') phrase, len(v) n, generate_subscripts(v, 1) i, unnest(v) word from ph),
y as (select distinct item_id, line, phrase, i, word, sum(n) over (partition by item_id, line, word) / cast(count(*) over (partition by item_id, line, word) as double) ratio from x),
z as (select item_id, line, phrase, sum(ratio) score from y group by 1, 2, 3),
f as (select distinct item_id, phrase from (select *, max(score) over (partition by item_id, line) best from z) where score > 0.1 * best)
select item_id, phrase from f union all select item_id, lower(t) from t where length(t) > 1 and length(t) < 50 and item_id not in (select item_id from f)"""
)
def keywords_by_line(t: Tables) -> DataFrame:
    """Phrases of passages and of each of their lines, and of beginnings that may have none."""
    b = t("benchmark")
    cut = F.replace(F.replace("text", F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("\n"))
    docs = b.select("item_id", cut.alias("text")).union(b.select(F.col("item_id") + 1_000_000, F.left("text", F.lit(9))))
    return SE.keywords(docs, "item_id")


# Caches.

_CLAIMED = "select doc_id, md5(text) fp, n_chars, min(doc_id) over (partition by lang, n_chars // 100) closest from documents"


def _claimed(t: Tables) -> DataFrame:
    """Documents with the closest one that a careless cache holds for them: the first of the same language and about the same length."""
    w = Window.partitionBy("lang", F.floor(F.col("n_chars") / 100))
    return t("documents").select("doc_id", F.md5("text").alias("fp"), "n_chars", F.min("doc_id").over(w).alias("closest"))


@query(f"with s as ({_CLAIMED}) select a.doc_id, a.closest from s a join s b on b.doc_id = a.closest where a.closest <> a.doc_id and (a.fp is distinct from b.fp or b.n_chars > a.n_chars)")
def wrong_matches(t: Tables) -> DataFrame:
    """Rows whose closest match has another text or came later, dated by length."""
    return CA.mismatched(_claimed(t), "doc_id", "fp", "n_chars")


@query(f"with s as ({_CLAIMED}), e as (select doc_id, first_value(doc_id) over (partition by fp order by n_chars, doc_id) r from s), w as (select a.doc_id from s a join s b on b.doc_id = a.closest where a.closest <> a.doc_id and (a.fp is distinct from b.fp or b.n_chars > a.n_chars)) select s.doc_id, case when w.doc_id is null then closest else r end closest from s join e using (doc_id) left join w using (doc_id)")
def repaired_matches(t: Tables) -> DataFrame:
    """The same, put right."""
    return CA.repaired(stash(_claimed(t), "claimed"), "doc_id", "fp", "n_chars")


@query("with e as (select event_id, round(value, 6) v, epoch_us(ts) us, first_value(event_id) over (partition by user_id, event_type order by ts, event_id) closest from events), b as (select event_id k, v, us, 0 through from e union all select closest, v, us, 1 from e) select k event_id, v as value from (select *, row_number() over (partition by k order by through, us desc, v) j from b) where j = 1")
def write_through(t: Tables) -> DataFrame:
    """Values stored under their own key and that of the first event of the same user and type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = t("events").select("event_id", F.round("value", 6).alias("value"), "ts", F.first("event_id").over(w).alias("closest"))
    return CA.written_through(e.select("event_id", "value", "ts"), e.select("event_id", "closest"), "event_id", "value", "ts").select("event_id", "value")


@query("select event_id, round(value, 6) as value, 'SUCCESS' status from events where event_type <> 'error' and (event_id in (select event_id from events where value >= 5 and ts >= timestamp '2024-01-15') or ts < timestamp '2024-01-15')")
def settled_results(t: Tables) -> DataFrame:
    """A store after a batch in which small values failed."""
    e = t("events").where("event_type <> 'error'").select("event_id", F.round("value", 6).alias("value"), "ts")
    batch = e.where("ts >= timestamp_ntz '2024-01-15'").select("event_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    store = e.select("event_id", (F.col("value") + F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), 1).otherwise(0)).alias("value"))
    return CA.outcomes(CA.settled(store, batch, "event_id", "value"), "value").select("event_id", F.round("value", 6).alias("value"), "status")


@query("select o_orderkey, first_value(o_orderkey) over (partition by o_custkey, round(o_totalprice, -3) order by o_orderdate, o_orderkey) closest from orders")
def same_source_and_length(t: Tables) -> DataFrame:
    """The first order of a customer of about the same price."""
    return CA.same_source(t("orders"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", -3)


@query()
def token_batches(t: Tables) -> DataFrame:
    """Documents in batches of at most 20,000 letters by language; compared with plain Python in the tests."""
    return CA.batches(t("documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 20_000)


@query("with o as (select o_orderkey root from orders where o_orderdate < timestamp '1998-01-01'), g as (select distinct s_ part from (select l_orderkey root, l_orderkey * 10 + l_linenumber s_ from lineitem) where root in (select root from o)), u as (select distinct l_orderkey * 10 + l_linenumber part, l_partkey leaf from lineitem) select 'roots' kind, count(*) n from o union all select 'parts', count(*) from g union all select 'leaves', count(*) from (select distinct leaf from u where part in (select part from g) and leaf not in (select leaf from u where part not in (select part from g)))")
def stale_cascade(t: Tables) -> DataFrame:
    """What old orders take along: their lines, and the parts in no other line."""
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part")
    parts = t("lineitem").select(line, F.col("l_orderkey").alias("root"))
    uses = t("lineitem").select(line, F.col("l_partkey").alias("leaf")).distinct()
    roots = t("orders").select(F.col("o_orderkey").alias("root"), "o_orderdate")
    gone = CA.stale(roots, parts, uses, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in zip(("roots", "parts", "leaves"), gone)]
    return out[0].union(out[1]).union(out[2])


# Slides.  Labels are videos, their vectors in order frames.

_FRAMES = "select label video, row_number() over (partition by label order by vec_id) frame, cast(embedding as double[]) v from embeddings"


def _frames(t: Tables) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    return t("embeddings").select(F.col("label").alias("video"), at.alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query("with n as (select label video, cast(count(*) as int) n from embeddings group by 1) select video, unnest(list_distinct(list_append(case when n > 12 then range(1, n - 12 + 1, 12) else [] end, n))) frame from n")
def frame_samples(t: Tables) -> DataFrame:
    """Every twelfth frame, and the last."""
    n = t("embeddings").groupBy(F.col("label").alias("video")).agg(F.count("*").cast("int").alias("frames"))
    return SL.samples(n).select("video", F.col("frame").cast("long").alias("frame"))


@query(f"with f as ({_FRAMES}), s as (select video, 1 - list_inner_product(v, lag(v) over (partition by video order by frame)) d from f) select video, round(coalesce(median(d) filter (d > 0.2 and d < 0.9) * 5, 0.05), 6) threshold from s where d is not null group by 1")
def noise_thresholds(t: Tables) -> DataFrame:
    """Five times the median of small steps from frame to frame."""
    return SL.thresholds(SL.steps(_frames(t)), 0.2, 0.9).select("video", *r6("threshold"))


@query()
def slide_transitions(t: Tables) -> DataFrame:
    """Frames at which slides change; compared with plain Python in the tests."""
    frames = _frames(t)
    return SL.detected(frames, frames.select("video").distinct().withColumn("threshold", F.lit(0.6)))


# The ontology.

_CG = {"graph": GRAPH, "inside": "select distinct src concept from graph"}


def _graph(t: Tables) -> DataFrame:
    return stash(G.both_ways(t.part_edges()), "graph")


@query(sql("select concept, category, cluster, round(score, 6) score, k as rank from (select concept, category, cluster, s / n score, row_number() over (partition by concept, category order by round(s / n, 9) desc, cluster) k from (select src concept, cluster, sum(score) s from graph join members on dst = concept group by 1, 2) join (select cluster, count(*) n from members semi join inside using (concept) group by 1) using (cluster) join clusters using (cluster)) where k <= 3", "part_edges", "members", "clusters", **_CG))
def closest_clusters(t: Tables) -> DataFrame:
    """The three closest brands of every type for every part."""
    graph = _graph(t)
    known = graph.select(F.col("src").alias("concept")).distinct()
    of = t.members().join(known, "concept", "left_semi").join(t.clusters(), "cluster")
    return O.closest_clusters(graph, of).select("concept", "category", "cluster", *r6("score"), "rank")


@query(sql("select e category, c closest, round(score, 6) score, k as rank from (select *, row_number() over (partition by e order by round(score, 9) desc, c) k from (select a.category e, b.category c, sum(score) / (max(na.n) * max(nb.n)) score from graph join am a on a.concept = src join am b on b.concept = dst join an na on na.category = a.category join an nb on nb.category = b.category where a.category <> b.category group by 1, 2)) where k <= 2", "part_edges", "anchors", **_CG, am="select * from anchors semi join inside using (concept)", an="select category, count(*) n from am group by 1"))
def category_closest_category(t: Tables) -> DataFrame:
    """The two types whose anchors are closest to those of every type."""
    graph = _graph(t)
    anchors = O.present(t.anchors().withColumnRenamed("category", "group"), graph)
    s = O.score_of(O.between(graph, anchors, anchors), "linear").where("first <> second")
    best = Window.partitionBy("first").orderBy(F.desc(F.round("score", 9)), "second")
    s = s.withColumn("rank", F.row_number().over(best)).where("rank <= 2")
    return s.select(F.col("first").alias("category"), F.col("second").alias("closest"), *r6("score"), "rank")


_KINDS = {
    "g_concept": "select cast(concept as varchar) g, concept from inside",
    "g_cluster": "select cluster g, concept from members semi join inside using (concept)",
    "g_category": "select category g, concept from anchors semi join inside using (concept)",
}
_PAIR = "select '{0}-{1}' kinds, count(*) n, round(sum(s), 4) total from (select a.g, b.g, sum(score) / (max(na.n) * max(nb.n)) s from graph join g_{0} a on a.concept = src join g_{1} b on b.concept = dst join (select g, count(*) n from g_{0} group by 1) na on na.g = a.g join (select g, count(*) n from g_{1} group by 1) nb on nb.g = b.g group by 1, 2)"
_KPAIRS = [(a, b) for a in ("concept", "cluster", "category") for b in ("concept", "cluster", "category")]


@query(sql(" union all ".join(_PAIR.format(a, b) for a, b in _KPAIRS), "part_edges", "members", "anchors", **_CG, **_KINDS))
def entity_similarity(t: Tables) -> DataFrame:
    """Similarities between all pairs of kinds of entities, in number and sum."""
    graph = _graph(t)
    groups = {
        "cluster": O.present(t.members().withColumnRenamed("cluster", "group"), graph),
        "category": O.present(t.anchors().withColumnRenamed("category", "group"), graph),
    }
    out = None
    for a, b in _KPAIRS:
        one = O.similarity(graph, groups, a, b).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))
        one = one.select(F.lit(f"{a}-{b}").alias("kinds"), "n", "total")
        out = one if out is None else out.union(one)
    return out


@query("select p_type category, n_nationkey topic, round(score, 6) score, k as rank from (select *, row_number() over (partition by p_type order by score desc, n_nationkey) k from (select p_type, n_nationkey, round(avg(l_quantity), 6) score from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2))")
def topic_alignment(t: Tables) -> DataFrame:
    """Nations as topics of types, by what is sold on average."""
    l = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))  # noqa: E741
    topics = l.groupBy(F.col("p_type").alias("category"), F.concat(F.lit("T"), "s_nationkey").alias("topic")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    return O.aligned(topics)


@query(sql("select 'tree' kind, child || '>' || parent row from (select * from tree union select 'TINY', 'SIZE') union all select 'anchors', category || '>' || concept from (select * from anchors union select 'TINY', p_partkey from part where p_size = 1) union all select 'clusters', cluster || '>' || case when cluster in ('Brand#3', 'Brand#4') then 'TINY' else category end from clusters", "anchors", "clusters", "tree").replace(" row from", " as edge from"))
def ontology_add_category(t: Tables) -> DataFrame:
    """A new type with anchors and two brands of others: all edges after that."""
    small = t("part").where("p_size = 1").select(F.col("p_partkey").alias("concept"))
    moved = t.clusters().where("cluster in ('Brand#3', 'Brand#4')")
    tables = O.add_category(t.tree(), t.anchors(), t.clusters(), "TINY", "SIZE", small, moved)
    columns = (("child", "parent"), ("category", "concept"), ("cluster", "category"))
    rows = [df.select(F.lit(k).alias("kind"), F.concat_ws(">", *c).alias("edge")) for k, df, c in zip(("tree", "anchors", "clusters"), tables, columns)]
    return rows[0].union(rows[1]).union(rows[2])


@query("with m as (select cast(substr(p_brand, 7) as bigint) cluster, p_partkey concept from part where p_size <= 40), k as (select max(cluster) + 1 k from m) select cluster, concept from m union all select k, p_partkey from k, part where p_size > 40")
def ontology_new_cluster(t: Tables) -> DataFrame:
    """Parts of no cluster in a new one, numbered after the others."""
    number = F.substring("p_brand", 7, 9).cast("long")
    members = t("part").where("p_size <= 40").select(number.alias("cluster"), F.col("p_partkey").alias("concept"))
    clusters = members.select("cluster", F.lit("X").alias("category")).distinct()
    return O.new_cluster(members, clusters, t("part").select(F.col("p_partkey").alias("concept")), "X")[0]


@query(sql("select category, cast(count(cluster) as bigint) clusters, cast(coalesce(sum(n), 0) as bigint) concepts from (select child category from tree where child not in (select parent from tree)) left join clusters using (category) left join (select cluster, count(*) n from members group by 1) using (cluster) group by 1", "members", "clusters", "tree"))
def ontology_statistics(t: Tables) -> DataFrame:
    """Brands and parts of every type, empty ones included."""
    return O.statistics(t.tree(), t.clusters(), t.members())[0].select("category", "clusters", F.col("concepts").cast("long").alias("concepts"))


@query(sql("select cast(floor(n / 20) as bigint) bin, count(*) clusters from (select cluster, count(*) n from members group by 1) group by 1", "members"))
def cluster_histogram(t: Tables) -> DataFrame:
    """How many brands have how many parts, by twenties."""
    return O.statistics(t.tree(), t.clusters(), t.members())[1].select(F.col("bin").cast("long").alias("bin"), "clusters")


@query(sql("select cluster, category, cast(count(*) as bigint) n, md5(string_agg(p_name, '|' order by concept)) names from members join clusters using (cluster) join part on p_partkey = concept group by 1, 2", "members", "clusters"))
def cluster_card(t: Tables) -> DataFrame:
    """What is known of every brand: its type, and the names of its parts in order."""
    m = t.members().join(t.clusters(), "cluster").join(t("part"), F.col("p_partkey") == F.col("concept"))
    m = m.groupBy("cluster", "category").agg(F.array_sort(F.collect_list(F.struct("concept", "p_name"))).alias("m"))
    return m.select("cluster", "category", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: x["p_name"]), "|")).alias("names"))


@query(sql("select p_partkey concept, p_name as name, cluster, category, tree.parent, g.child is not null as rooted from part join members on concept = p_partkey join clusters using (cluster) join tree on tree.child = category left join tree g on g.child = tree.parent", "members", "clusters", "tree"))
def concept_card(t: Tables) -> DataFrame:
    """What is known of every part: its brand, type and parent."""
    c = t("part").select(F.col("p_partkey").alias("concept"), F.col("p_name").alias("name")).join(t.members(), "concept").join(t.clusters(), "cluster")
    c = c.join(t.tree().withColumnRenamed("child", "category"), "category")
    up = t.tree().select(F.col("child").alias("parent"), F.lit(True).alias("rooted"))
    return c.join(up, "parent", "left").select("concept", "name", "cluster", "category", "parent", F.coalesce("rooted", F.lit(False)).alias("rooted"))


@query(sql("select cluster, concept from members", "members").replace("select cluster, concept from members", "select cluster, md5(string_agg(concept || ':' || p_name, ',' order by concept)) members, count(*) n from members join part on p_partkey = concept group by 1"))
def member_lists(t: Tables) -> DataFrame:
    """Keys and names of the members of every brand, as one list."""
    m = t.members().join(t("part"), F.col("p_partkey") == F.col("concept")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("concept", "p_name"))).alias("m"))
    each = F.transform("m", lambda x: F.concat_ws(":", x["concept"], x["p_name"]))
    return m.select("cluster", F.md5(F.array_join(each, ",")).alias("members"), F.size("m").cast("long").alias("n"))


@query(sql("with a as (select src, dst from bought where n >= 2 union select dst, src from bought where n >= 2), s as (select distinct src v from a where src < 5), f as (select v, v u from s union select s.v, a1.dst from s join a a1 on a1.src = s.v union select s.v, a2.dst from s join a a1 on a1.src = s.v join a a2 on a2.src = a1.dst union select s.v, a3.dst from s join a a1 on a1.src = s.v join a a2 on a2.src = a1.dst join a a3 on a3.src = a2.dst), p as (select distinct x.v a, y.v b from f x join f y using (u)) select a, count(*) reached, round(count(*) / (select count(*) from s), 6) as \"share\" from p group by a", "bought").replace(" with a as", ", a as", 1))
def within_six_steps(t: Tables) -> DataFrame:
    """Which of a few parts are within six steps of each other: balls of three steps that meet."""
    edges = t.bought().where("n >= 2").select("src", "dst")
    edges = stash(edges.union(edges.select("dst", "src")).distinct(), "edges")
    starts = edges.where("src < 5").select(F.col("src").alias("id")).distinct()
    near = G.distances(edges, starts, 3).select("start", "id").distinct()
    pairs = near.withColumnRenamed("start", "a").join(near.withColumnRenamed("start", "b"), "id").select("a", "b").distinct()
    n = starts.agg(F.count("*").alias("n"))
    return pairs.groupBy("a").agg(F.count("*").alias("reached")).crossJoin(F.broadcast(n)).select("a", "reached", F.round(F.col("reached") / F.col("n"), 6).alias("share"))


@query(sql("with e as (select src, dst, score from part_edges where score > 0.5), d as (select id from (select src id from e union all select dst from e) group by 1 having count(*) >= 2) select src, dst, round(score, 6) score from e where src in (select id from d) and dst in (select id from d)", "part_edges").replace(" with e as", ", e as", 1))
def pruned_subgraph(t: Tables) -> DataFrame:
    """Strong edges between parts that have two of them."""
    e = t.part_edges().where("score > 0.5")
    nodes = G.degrees(e).where("degree >= 2").select("id")
    return R.induced(e, nodes).select("src", "dst", *r6("score"))


@query(sql("select child id, parent, (select count(*) from tree c where c.parent = t.child) children, 'ROOT' root from tree t", "tree"))
def tree_lookups(t: Tables) -> DataFrame:
    """Parent, number of children and root of every category."""
    tree = t.tree()
    n = tree.groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("children"))
    roots = G.ancestors(tree, 4).where("ancestor = 'ROOT'").select(F.col("node").alias("child"), F.col("ancestor").alias("root"))
    return tree.join(n, "child", "left").join(roots, "child").fillna(0, ["children"]).select(F.col("child").alias("id"), "parent", "children", "root")


@query(sql("select cast(src as bigint) i, cast(dst as bigint) j, sum(w) v from (select src, dst, w from x union all select dst, src, w from x) group by 1, 2", "bought", x="select src, dst, case when n > 1 then n * 1.0 end w from bought where n > 1"))
def adjacency(t: Tables) -> DataFrame:
    """Entries of a symmetric matrix: edges without weight are none."""
    e = t.bought().withColumn("w", F.when(F.col("n") > 1, F.col("n").cast("double"))).where("w is not null and w <> 0")
    return G.both_ways(e.select("src", "dst", F.col("w").alias("score"))).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("score").alias("v"))


# Reports and rights.


@query("with r as (select p_type, p_brand, crc % 5 round, l_returnflag = 'R' wrong from (select *, l_linenumber crc from lineitem) join part on l_partkey = p_partkey), e as (select p_type, round, avg(case when wrong then 1.0 else 0 end) error from r group by 1, 2) select p_type, count(*) rounds, round(avg(error), 6) mean, round(stddev_pop(error), 6) deviation from e group by 1")
def problem_areas(t: Tables) -> DataFrame:
    """Shares of errors by type over five rounds, with mean and deviation."""
    r = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return EV.over_rounds(r.select(F.col("p_type"), (F.col("l_linenumber") % 5).alias("round"), (F.col("l_returnflag") == "R").alias("wrong")), "p_type", "round", "wrong")


@query("select o_orderkey, coalesce(c_name, s_name) holder from orders left join customer on c_custkey = o_custkey left join supplier on s_suppkey = o_custkey where o_orderstatus = 'F'")
def named_holders(t: Tables) -> DataFrame:
    """Names of the holders of orders, from two tables."""
    names = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("k"))
    names = names.unionByName(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("k")))
    first = R.latest(names, ["id"], F.col("k")).select("id", "name")
    o = t("orders").where("o_orderstatus = 'F'").join(first, F.col("o_custkey") == F.col("id"), "left")
    return o.select("o_orderkey", F.col("name").alias("holder"))


@query("select 'u' || c_custkey usr, len(list_distinct(string_split(s, ','))) scopes, list_contains(string_split(s, ','), 'image') image from (select c_custkey, 'text,' || lower(c_mktsegment) || case when c_acctbal > 0 then ',image' else '' end s from customer)")
def user_scopes(t: Tables) -> DataFrame:
    """Scopes of users, listed in one text."""
    s = F.concat(F.lit("text,"), F.lower("c_mktsegment"), F.when(F.col("c_acctbal") > 0, ",image").otherwise(""))
    u = t("customer").select(F.concat(F.lit("u"), "c_custkey").alias("usr"), EV.scopes(s).alias("s"))
    return u.select("usr", F.size("s").cast("long").alias("scopes"), F.array_contains("s", "image").alias("image"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 100 else 10 end text_limit, case when c_acctbal < 0 then 1 else 20 end image_limit, 5 video_limit from customer")
def rate_limits(t: Tables) -> DataFrame:
    """Limits of users: those of all, with what is set for some in their place."""
    base = F.create_map(*(F.lit(x) for x in ("text", 10, "image", 20, "video", 5)))
    own = F.map_filter(
        F.create_map(F.lit("text"), F.when(F.col("c_mktsegment") == "BUILDING", 100), F.lit("image"), F.when(F.col("c_acctbal") < 0, 1)), lambda k, v: v.isNotNull()
    )
    u = t("customer").select("c_custkey", EV.overridden(base, own).alias("m"))
    return u.select("c_custkey", *(F.col("m")[k].alias(f"{k}_limit") for k in ("text", "image", "video")))


# Stages of the investment pipeline.


@query("with t as (select p_partkey id, unnest(string_split(p_name, ' ')) concept from part where p_partkey not in (select l_partkey from lineitem where l_shipdate < timestamp '1995-07-01')), n as (select id, concept, count(*) x from t group by 1, 2) select id, concept, round(x / sqrt(sum(x * x) over (partition by id)), 6) score from n")
def incremental_detection(t: Tables) -> DataFrame:
    """Words of the parts that nothing is known of yet, scaled to length one."""
    known = t("lineitem").where("l_shipdate < timestamp_ntz '1995-07-01'").select(F.col("l_partkey").alias("id"))
    new = R.drop(t("part").select(F.col("p_partkey").alias("id"), "p_name"), known, "id")
    n = new.select("id", F.explode(F.split("p_name", " ")).alias("concept")).groupBy("id", "concept").agg(F.count("*").alias("score"))
    return n.select("id", "concept", F.round(R.unit("score", "id"), 6).alias("score"))


_UNITS = "select p_brand u, p_partkey concept, 1 / (1.0 + p_size) score from part"
_MERGED = "select s, concept, pow(greatest(m, 0.9 * m + 0.1 * n), 1 - n / 2) score from (select src s, dst concept, score m, case when p_size < 20 then 1.0 / p_size else 0 end n from holdings join part on dst = p_partkey)"
_MIXED = "select s, concept, score from (select *, max(score) over (partition by s) top from mix) where score >= 0.05 * top"


def _units(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_brand").alias("u"), F.col("p_partkey").alias("concept"), (1 / (1 + F.col("p_size"))).alias("score"))


@query(sql("with best as (select s, u, score, row_number() over (partition by s order by round(score, 9) desc, u) k from (select s, u, sum(a.score * b.score) / (max(nx) * max(ny)) score from pruned a join y b using (concept) join (select s, sqrt(sum(score * score)) nx from pruned group by 1) using (s) join (select u, sqrt(sum(score * score)) ny from y group by 1) using (u) group by 1, 2)) select s, u, round(score / sqrt(sum(score * score) over (partition by s)), 6) score from best where k <= 10", "part_edges", "holdings", normal=NORMALISED, x=_MERGED, mix=MIX, pruned=_MIXED, y=_UNITS).replace(" with best as", ", best as", 1))
def fundraiser_units(t: Tables) -> DataFrame:
    """Affinities of suppliers with brands: manual and detected scores merged, spread over the graph, the ten best scaled."""
    h = t.holdings().join(t("part"), F.col("dst") == F.col("p_partkey"))
    detected = F.when(F.col("p_size") < 20, 1.0 / F.col("p_size")).otherwise(0.0)
    x = h.select(F.col("src").alias("s"), F.col("dst").alias("concept"), X.manual_blend(F.col("score"), detected).alias("score"))
    y = _units(t)
    pairs = x.select("s").distinct().crossJoin(y.select("u").distinct())
    scored = C.affinities(stash(x, "merged"), y, pairs, t.part_edges(), mix_x=True).where("score > 0")
    best = R.top_n(scored, 10, ["s"], F.desc(F.round("score", 9)), F.col("u"))
    return best.select("s", "u", F.round(R.unit("score", "s"), 6).alias("score"))


@query(sql("with i as (select s, concept, score / sum(score) over (partition by s) score from w), best as (select s, u, score, row_number() over (partition by s order by round(score, 9) desc, u) k from (select s, u, sum(a.score * b.score) / (max(nx) * max(ny)) score from i a join y b using (concept) join (select s, sqrt(sum(score * score)) nx from i group by 1) using (s) join (select u, sqrt(sum(score * score)) ny from y group by 1) using (u) group by 1, 2)) select s, u, round(score / sqrt(sum(score * score) over (partition by s)), 6) score from best where k <= 10", "holdings", w="select src s, dst concept, score / (1 + ln(n)) score from holdings join (select dst, count(*) n from holdings group by 1) using (dst)", y=_UNITS).replace(" with i as", ", i as", 1))
def investor_units(t: Tables) -> DataFrame:
    """The same with rare parts counting more, and scores that add up to one."""
    n = t.holdings().groupBy("dst").agg(F.count("*").alias("n"))
    w = t.holdings().join(n, "dst").select(F.col("src").alias("s"), F.col("dst").alias("concept"), (F.col("score") * X.rarity(F.col("n"))).alias("score"))
    x = w.withColumn("score", R.share("score", "s"))
    y = _units(t)
    pairs = x.select("s").distinct().crossJoin(y.select("u").distinct())
    scored = C.affinities(stash(x, "weighed"), y, pairs).where("score > 0")
    best = R.top_n(scored, 10, ["s"], F.desc(F.round("score", 9)), F.col("u"))
    return best.select("s", "u", F.round(R.unit("score", "s"), 6).alias("score"))


@query(sql("with n as (select s, p concept, year(day) as year, count(*) x from facts join rounds using (o) group by 1, 2, 3), m as (select s, concept, year, x / max(x) over (partition by s, year) score from n), d as (select s, year, u, sum(m.score * y.score) v from m join y using (concept) group by 1, 2, 3), r as (select *, row_number() over (partition by s, year order by round(v, 9) desc, u) k from d) select s, year, u, round(v, 6) score from r where k <= 5", "facts", "rounds", y=_UNITS).replace(" with n as", ", n as", 1))
def investor_units_by_year(t: Tables) -> DataFrame:
    """The five brands that go best with what a supplier did in each year."""
    n = t.facts().join(t.rounds(), "o").groupBy("s", F.col("p").alias("concept"), F.year("day").alias("year")).agg(F.count("*").alias("x"))
    m = n.select("s", "concept", "year", R.of_max("x", "s", "year").alias("score"))
    d = m.join(_units(t).withColumnRenamed("score", "w"), "concept").groupBy("s", "year", "u").agg(F.sum(F.col("score") * F.col("w")).alias("v"))
    return R.top_n(d, 5, ["s", "year"], F.desc(F.round("v", 9)), F.col("u")).select("s", "year", "u", F.round("v", 6).alias("score"))


@query(sql("with y as (select s, p, year(day) as year, count(*) n, sum(amount) amount from facts join rounds using (o) where year(day) between 1998 and 2000 group by 1, 2, 3), r as (select *, row_number() over (partition by s, year order by amount desc, p) k, sum(n) over (partition by s, year) total from y) select s, year, p, p_name as name, n, round(amount, 2) amount, round(n / total, 6) as \"share\" from r join part on p_partkey = p where k <= 3", "facts", "rounds").replace(" with y as", ", y as", 1))
def matchmaking(t: Tables) -> DataFrame:
    """For every supplier and year of a window, the three parts that took most, with names and shares."""
    y = t.facts().join(t.rounds(), "o").where(F.year("day").between(1998, 2000)).groupBy("s", "p", F.year("day").alias("year"))
    y = y.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).withColumn("share", F.round(R.share("n", "s", "year"), 6))
    best = R.top_n(y, 3, ["s", "year"], F.desc("amount"), F.col("p"))
    return best.join(t("part"), F.col("p") == F.col("p_partkey")).select("s", "year", "p", F.col("p_name").alias("name"), "n", F.round("amount", 2).alias("amount"), "share")
