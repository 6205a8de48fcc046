"""Queries over sites, responses of the ontology, projections, and the run of the investment stages."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as TX
from ..operators import cache as CA
from ..operators import cluster as CL
from ..operators import evaluate as EV
from ..operators import links, moments, slots
from ..operators import ontology as O
from ..operators import relational as R
from ..operators import vectors as V
from ..sources import web as WEB
from ..sources.log import Stages
from ..sources.store import replace_table
from .concepts import _BEST, BASE, GROUPS, NAMES, Onto
from .concepts import _ADAPT, _DEG, _PAIRS
from .derived import Tables, sql
from .investment import r6, weighted
from .texts import _PLAIN, _site_pages

Q, S = {}, {}


def query(text: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if text is not None:
            S[f.__name__] = text
        return f

    return add


_KINDS = "case when url = regexp_extract(url, '^https?://[^/]+/?', 0) then 'homepage' " + " ".join(f"when contains(url, '{k}') then '{v}'" for k, v in TX.PAGE_KINDS.items()) + " end"


@query(rf"select page_id, {_KINDS} kind, length({_PLAIN}) n from pages")
def sublinks_processed(t: Tables) -> DataFrame:
    """The kind of every page by its address, and the length of its text."""
    base = F.regexp_extract("url", "^https?://[^/]+/?", 0)
    return t("pages").select("page_id", TX.page_kind(F.col("url"), base).alias("kind"), F.length(TX.plain_html(F.col("html"))).cast("long").alias("n"))


_MAIN = "coalesce(nullif(regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1), ''), nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html)"


@query(rf"select page_id, md5({_PLAIN}) as text from (select page_id, {_MAIN} html from pages)")
def main_text(t: Tables) -> DataFrame:
    """The text of the main part of a page, or else of its body, or of all."""
    return t("pages").select("page_id", F.md5(TX.plain_html(TX.main_part(F.col("html")))).alias("text"))


@query(r"select regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) site, min(page_id) page, count(*) pages from pages group by 1")
def first_of_site(t: Tables) -> DataFrame:
    """One page for every site, the first, and how many there are."""
    return t("pages").groupBy(TX.host(F.col("url")).alias("site")).agg(F.min("page_id").alias("page"), F.count("*").alias("pages"))


@query("select doc_id, case when lang not in ('en', 'fr') then null else md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '<IP>', 'g'), '\\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\\b', '<IBAN>', 'g'), '\\+?[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?[ .-][0-9]{3}[ .-][0-9]{4}', '<PHONE>', 'g')) end as text, case when lang not in ('en', 'fr') then 'language ' || lang || ' is not supported' end error from documents")
def anonymised(t: Tables) -> DataFrame:
    """Documents without personal data, or an error where the language is not known."""
    known = F.col("lang").isin("en", "fr")
    error = F.when(~known, F.concat(F.lit("language "), "lang", F.lit(" is not supported")))
    return t("documents").select("doc_id", F.when(known, F.md5(TX.masked(F.col("text")))).alias("text"), error.alias("error"))


@query("select doc_id, case when lang = 'en' then 'source and target languages are the same' when lang not in ('fr', 'de') then 'languages are not supported' when n_chars > 2000 then 'text too long' end error, lang in ('fr', 'de') and n_chars <= 2000 as translatable from documents")
def translation_errors(t: Tables) -> DataFrame:
    """What stands in the way of translating documents into English."""
    d = t("documents").select("doc_id", "text", "lang")
    d = slots.translatable(d, "text", F.col("lang"), F.lit("en"), {("fr", "en"), ("de", "en")}, 2000)
    return d.select("doc_id", "error", F.col("error").isNull().alias("translatable"))


@query("select doc_id, case when len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) > 300 then 'text over token limit of 300' end error from documents")
def embedding_errors(t: Tables) -> DataFrame:
    """Documents with more words than a model takes."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0)))
    return slots.limited(t("documents").select("doc_id", "text"), "text", words, 300).select("doc_id", "error")


@query("select conv_id, role, n from (select conv_id, role, count(*) n, row_number() over (partition by conv_id order by count(*) desc, role) k from conversations group by 1, 2) where k = 1")
def majority_of_segments(t: Tables) -> DataFrame:
    """Who speaks most turns of a conversation, taken for the language of a recording."""
    c = t("conversations")
    n = c.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return slots.language_of_segments(c, "conv_id", "role").withColumnRenamed("language", "role").join(n, ["conv_id", "role"])


@query("select item_id, cast(count(*) as bigint) words, round(sum(embedding[1]), 5) first, round(sum(embedding[64]), 5) last from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from benchmark) join embeddings on vec_id = (length(w) * 31 + ascii(w)) % 500 group by 1")
def word_vector_sums(t: Tables) -> DataFrame:
    """The sum of the vectors of the words of a passage, element by element."""
    words = t("benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    words = words.withColumn("vec_id", (F.length("w") * 31 + F.ascii("w")) % 500)
    each = words.join(t("embeddings"), "vec_id").select("item_id", F.posexplode("embedding").alias("k", "x"))
    sums = each.groupBy("item_id", "k").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("item_id").agg(F.max("n").alias("words"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    return sums.select("item_id", "words", F.round(F.col("v")[0]["x"], 5).alias("first"), F.round(F.element_at("v", -1)["x"], 5).alias("last"))


# The ontology.


@query(sql(f"select b.entity, b.category, b.score, b.rank, c.category existing, b.category = c.category agrees, false fallback from ({_BEST}) b join members on concept = entity join clusters c using (cluster)", *NAMES, **GROUPS, pairs=_PAIRS, deg=_DEG, scores=_ADAPT))
def category_response(t: Tables) -> DataFrame:
    """The closest types of every part with their ranks, the type that it has, and whether they agree."""
    o = Onto(t)
    degree = o.graph.groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("degree"))
    best = O.closest(O.category_scores(o.both().join(degree, "entity"), "adaptive", (1, 10)), 3)
    existing = o.of.select(F.col("concept").alias("entity"), F.col("category").alias("existing"))
    return best.join(existing, "entity").select("entity", "category", *r6("score"), "rank", "existing", (F.col("category") == F.col("existing")).alias("agrees"), F.lit(False).alias("fallback"))


_CLOSE = "select a.vec_id src, b.vec_id dst, list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id"


@query(f"select src, dst, round(score, 6) score from (select *, row_number() over (partition by src order by round(score, 9) desc, dst) k from ({_CLOSE})) where k = 1")
def closest_by_embedding(t: Tables) -> DataFrame:
    """The nearest vector of the same label for every vector."""
    v = t("embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.nearest(v, 1).select("src", "dst", *r6("score"))


@query(f"select label, min(v) least, max(v) greatest, count(*) n from (select a.label, round(1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) + 0.0 v from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id) group by 1")
def distance_matrix(t: Tables) -> DataFrame:
    """The least and greatest cosine distance within every label."""
    e = t("embeddings")
    d = V.distances(e.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    d = d.join(e.select(F.col("vec_id").alias("i"), "label"), "i")
    return d.groupBy("label").agg((F.min(F.round("v", 6)) + 0.0).alias("least"), F.max(F.round("v", 6)).alias("greatest"), F.count("*").alias("n"))


@query()
def principal_components(t: Tables) -> DataFrame:
    """Shares of the variance of standardised vectors, and the spread of their projections; compared with numpy in the tests."""
    shares, _, projected = V.principal(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5)
    spread = projected.select(F.posexplode("projection").alias("k", "x")).groupBy("k").agg(F.round(F.variance("x"), 6).alias("variance"))
    known = t.spark.createDataFrame([(k, float(np.round(s, 6))) for k, s in enumerate(shares)], "k int, share double")
    return spread.join(known, "k")


@query(sql("select k, n from (select 'concept-cluster' k, count(*) n from (select distinct src, g from graph join gc on dst = concept)) union all select 'concept-anchor', count(*) from (select distinct src, g from graph join ga on dst = concept) union all select 'concept-member', count(*) from (select distinct src, g from graph join gm on dst = concept) union all select 'cluster-cluster', count(*) from (select distinct p.g, q.g h from graph join gc p on src = p.concept join gc q on dst = q.concept)", *NAMES, **GROUPS))
def precalculated_sizes(t: Tables) -> DataFrame:
    """How many pairs the similarity tables hold that are made in advance."""
    o = Onto(t)
    tables = {
        "concept-cluster": O.to_groups(o.graph, o.clusters), "concept-anchor": O.to_groups(o.graph, o.anchors),
        "concept-member": O.to_groups(o.graph, o.members), "cluster-cluster": O.between(o.graph, o.clusters, o.clusters),
    }
    out = None
    for k, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
        out = row if out is None else out.union(row)
    return out


@query(sql("select a.w weight_score, 1 - a.w weight_part, round(sum(pow(a.w * score + (1 - a.w) * p - c, 2)), 4) error from (select score, 1.0 / p_size p, 1 - p_size / 50.0 c from holdings join part on dst = p_partkey), (select unnest(range(9)) / 8.0 w) a group by 1, 2", "holdings"))
def weight_grid(t: Tables) -> DataFrame:
    """How far mixes of two scores are from a third, for nine weights."""
    h = t.holdings().join(t("part"), F.col("dst") == F.col("p_partkey"))
    h = h.select("score", (1.0 / F.col("p_size")).alias("part"), (1 - F.col("p_size") / 50.0).alias("target"))
    return EV.weight_errors(h, ["score", "part"], "target", 8).withColumn("error", F.round("error", 4))


@query(sql("select a, b, kind, round(score, 6) score from (select *, count(*) over (partition by a) na from e) where na >= 2", "holdings", "members", e="select 's' || src a, 'p' || dst b, 'holds' kind, score from (select *, row_number() over (partition by src order by score desc, dst) k from holdings) where k <= 10 union all select 'c' || cluster, 'p' || concept, 'has', 1.0 from members semi join (select p_partkey concept from part where p_size <= 5) using (concept)"))
def startup_graph(t: Tables) -> DataFrame:
    """What is drawn of suppliers, brands and parts: the ten strongest holdings, small parts, and nodes with two edges."""
    h = R.top_n(t.holdings(), 10, ["src"], F.desc("score"), F.col("dst"))
    held = h.select(F.concat(F.lit("s"), "src").alias("a"), F.concat(F.lit("p"), "dst").alias("b"), F.lit("holds").alias("kind"), "score")
    small = t("part").where("p_size <= 5").select(F.col("p_partkey").alias("concept"))
    has = t.members().join(small, "concept", "left_semi")
    has = has.select(F.concat(F.lit("c"), "cluster").alias("a"), F.concat(F.lit("p"), "concept").alias("b"), F.lit("has").alias("kind"), F.lit(1.0).alias("score"))
    e = held.union(has)
    drawn = e.groupBy("a").agg(F.count("*").alias("n")).where("n >= 2")
    return e.join(drawn, "a", "left_semi").select("a", "b", "kind", *r6("score"))


@query(r"with b as (select distinct regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1), '^https?://(www\.)?', '') site from pages), v as (select site, unnest(['https://www.' || site, 'https://' || site, 'http://www.' || site, 'http://' || site]) address, unnest([0, 1, 2, 3]) k from b), k as (select distinct regexp_extract(url, '^(https?://[^/?#]+)', 1) address from pages) select site, address from (select site, address, row_number() over (partition by site order by k) j from v semi join k using (address)) where j = 1")
def url_probing(t: Tables) -> DataFrame:
    """The first of four addresses at which each site is known to answer."""
    start = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    known = t("pages").select(start.alias("address")).distinct()
    site = F.regexp_replace("address", r"^https?://(www\.)?", "")
    asked = known.select(site.alias("site")).distinct().select("site", F.posexplode(WEB.variants(F.col("site"))).alias("k", "address"))
    return R.latest(asked.join(known, "address", "left_semi"), ["site"], F.col("k")).select("site", "address")


@query()
def broken_up_clusters(t: Tables) -> DataFrame:
    """Labels parted into two and into three; compared with plain Python in the tests."""
    v = t("embeddings").select("label", F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return CL.broken_up(v, "label", (2, 3))


# Caches.


@query("select doc_id, case when lang = 'en' and n_chars > 500 then 'stored' else 'made' end origin from documents")
def flagged_cache(t: Tables) -> DataFrame:
    """What a cache has under the wanted flags, and what has to be made."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    store = d.where("lang = 'en'").select("doc_id", (F.col("n_chars") > 500).alias("headers_removed"), F.lit(True).alias("long_patterns_removed"))
    return CA.under_flags(d.select("doc_id"), store, "doc_id", headers_removed=True, long_patterns_removed=True).select("doc_id", "origin")


@query("select doc_id, first_value(doc_id) over w closest, case when first_value(doc_id) over w = doc_id then -1.0 else 1.0 end score from documents window w as (partition by md5(text) order by n_chars, doc_id)")
def closest_match(t: Tables) -> DataFrame:
    """Closest rows under a similarity of one: the plan looks for equal fingerprints only."""
    d = t("documents").select("doc_id", F.md5("text").alias("fp"), "n_chars", "lang")
    return CA.closest(d, "doc_id", "fp", "n_chars", "lang", 1.0)


# Stages of the investment pipeline.


@dataclass(frozen=True)
class Parameters:
    """What a run of the stages is about."""

    prefix: str = "investment"
    first: str = "1998-01-01"
    last: str = "2001-08-01"
    statuses: tuple[str, ...] | None = None
    least_jaccard: float = 0.01
    best: int = 10

    def but(self, **changes) -> Parameters:
        return replace(self, **changes)


def run_stages(spark: SparkSession, folder: str, out: str, parameters: Parameters = Parameters(), log: Stages | None = None) -> dict[str, str]:
    """The stages one after the other over the tables of a folder; returns the paths of what they wrote under `out`.

    Raw tables, moments by year, sums over the recent past, link predictions and affinities; each is read again from what
    was written, so a run can be taken up where another broke off.
    """
    log, t, paths = log or Stages(spark), Tables(spark, folder), {}

    def write(name: str, df: DataFrame, *key: str) -> DataFrame:
        path = f"{out}/{parameters.prefix}_{name}"
        replace_table(df, path, list(key))
        paths[name] = path
        return spark.read.parquet(path)

    with log.stage("graph") as told:
        orders = R.where_given(t("orders"), o_orderstatus=list(parameters.statuses) if parameters.statuses else None)
        rounds = write("rounds", orders.select(F.col("o_orderkey").alias("o"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount")), "o")
        facts = write("facts", R.keep(t.facts(), rounds, "o"), "s", "p")
        raised = facts.select("s", "o").distinct().join(rounds, "o")
        taken = facts.select("p", "o").distinct().join(rounds, "o")
        both = facts.join(rounds, "o")
        by_s = write("supplier_years", moments.yearly(raised, ["s"], "day", "amount"), "s")
        by_p = write("part_years", moments.yearly(taken, ["p"], "day", "amount"), "p")
        by_sp = write("supplier_part_years", moments.yearly(both, ["s", "p"], "day", "amount"), "s", "p")
        told["rows"] = facts.count()
    with log.stage("recent past"):
        for name, df, key in (("supplier_recent", by_s, ["s"]), ("part_recent", by_p, ["p"]), ("supplier_part_recent", by_sp, ["s", "p"])):
            recent = moments.over_years(moments.rescaled(df, parameters.first, parameters.last), key)
            write(name, R.tanh_normalised(recent, "sum_amount"), *key)
    with log.stage("jaccard") as told:
        predicted = links.jaccard_of_groups(*weighted(t), parameters.least_jaccard)
        told["rows"] = write("jaccard", predicted, "src", "dst").count()
    with log.stage("units"):
        recent = spark.read.parquet(paths["supplier_part_recent"])
        units = t("part").select(F.col("p_brand").alias("u"), F.col("p_partkey").alias("p"), (1 / (1 + F.col("p_size"))).alias("w"))
        scored = recent.join(units, "p").groupBy("s", "u").agg(F.sum(F.col("score") * F.col("w")).alias("score"))
        best = R.top_n(scored, parameters.best, ["s"], F.desc(F.round("score", 9)), F.col("u"))
        write("units", best.withColumn("score", R.unit("score", "s")), "s", "u")
    return paths
