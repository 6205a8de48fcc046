"""Text, page, search and cache queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import cache as CA
from ..operators import scrape as SC
from ..operators import search as SE
from ..sources.store import stash
from .derived import Tables
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


_W = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{TX.WORDS}'), lambda w: length(w) > 0)"


@query(f"select doc_id, len(w) n, md5(array_to_string(w, ' ')) words from (select doc_id, {_W} w from documents)")
def word_tokens(t: Tables) -> DataFrame:
    """Words of every document, digested."""
    w = TX.words(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("words"))


@query(
    f"select item_id, md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|')) pairs, cast(greatest(len(w) - 1, 0) as bigint) n from (select item_id, {_W} w from benchmark)"
)
def shingles(t: Tables) -> DataFrame:
    """Pairs of words of the benchmark passages."""
    g = TX.ngrams(TX.words(F.col("text")), 2)
    return t("benchmark").select("item_id", F.md5(F.array_join(g, "|")).alias("pairs"), F.size(g).cast("long").alias("n"))


@query(f"select doc_id, k, md5(array_to_string(w[k * 300 + 1 : k * 300 + 400], ' ')) chunk from (select doc_id, w, unnest(range(cast(greatest(ceil((len(w) - 400) / 300.0), 0) as bigint) + 1)) k from (select doc_id, {_W} w from documents))")
def chunk_words(t: Tables) -> DataFrame:
    """Overlapping windows of 400 words."""
    c = t("documents").select("doc_id", F.posexplode(TX.chunks(TX.words(F.col("text")))).alias("k", "chunk"))
    return c.select("doc_id", F.col("k").cast("long").alias("k"), F.md5("chunk").alias("chunk"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '<IP>', 'g'), '\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b', '<IBAN>', 'g'), '\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}', '<PHONE>', 'g')) masked from documents""")
def pii_mask(t: Tables) -> DataFrame:
    """Personal data masked by kind."""
    return t("documents").select("doc_id", F.md5(TX.masked(F.col("text"))).alias("masked"))


@query(r"""select doc_id, md5(coalesce(nullif(s, ''), text)) clean from (select doc_id, text, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \n\t]+', ' ', 'g'), '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+', ' ', 'g'), '<[^>]*>', ' ', 'g'), '(?m)^[ \t]*[*+•|-][ \t]*', '', 'g')), '[ \n\t\r]+', ' ', 'g')) s from documents)""")
def normalised_text(t: Tables) -> DataFrame:
    """Documents without URLs, addresses, tags and bullets."""
    return t("documents").select("doc_id", F.md5(TX.normalised(F.col("text"))).alias("clean"))


@query(f"select doc_id, md5(left(trim(regexp_replace(regexp_replace(translate(text, '{TX.ACCENTS[0]}', '{TX.ACCENTS[1]}'), '[\"''/\\\\]', '', 'g'), '[ \\n\\t\\r]+', ' ', 'g')), 16384)) folded from documents")
def folded_text(t: Tables) -> DataFrame:
    """Documents with accents folded and quotes gone."""
    return t("documents").select("doc_id", F.md5(TX.folded(F.col("text"))).alias("folded"))


_TYPE = "case " + " ".join(f"when contains(url, '{m}') then '{n}'" for m, n in TX.PAGE_TYPES) + " else 'other' end"


@query(rf"select page_id, regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) host, regexp_replace(url, '^https?://(www\.)?', '') || '___' || left(md5(url), 8) token, {_TYPE} page_type from pages")
def page_tokens(t: Tables) -> DataFrame:
    """Host, token and type of every page."""
    u = F.col("url")
    return t("pages").select("page_id", TX.host(u).alias("host"), TX.sublink_token(TX.base_token(u), u).alias("token"), TX.page_type(u).alias("page_type"))


_PLAIN = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace({_PLAIN}, '(?i)</?(b|i|u|em|strong|span|a|sup|sub|small|font)( [^>]*)?>', ' ', 'g'), '<[^>]*>', chr(10), 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_c}')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(f"select page_id, length(p) n, md5(p) text from (select page_id, {_PLAIN} p from pages)")
def html_clean(t: Tables) -> DataFrame:
    """Visible text of every page."""
    p = TX.plain_html(F.col("html"))
    return t("pages").select("page_id", F.length(p).cast("long").alias("n"), F.md5(p).alias("text"))


@query(r"""select page_id, cast(len(l) as bigint) n, array_to_string(l, ' ') links from (select page_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda u: not regexp_matches(lower(u), '\.(pdf|png|jpg|mp3|mp4)$') and not contains(u, 'wp-admin')), lambda u: regexp_replace(u, '/$', '')))) l from pages)""")
def page_links(t: Tables) -> DataFrame:
    found = TX.links(F.col("html"))
    return t("pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("links"))


def _site_pages(t: Tables) -> DataFrame:
    return t("pages").select(TX.host(F.col("url")).alias("site"), F.col("page_id").alias("page"), TX.plain_html(F.col("html")).alias("content"))


@query(rf"select site, line, count(*) n from (select distinct site, page_id, unnest(string_split(p, chr(10))) line from (select regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) site, page_id, {_PLAIN} p from pages)) where length(line) >= 20 group by 1, 2 having count(*) >= 2")
def site_repeated_lines(t: Tables) -> DataFrame:
    """Lines that pages of one host share."""
    return SC.repeated_lines(_site_pages(t))


_BLANK = "' ' || chr(10) || chr(9) || chr(13)"


def _edge_sql(pages: str, content: str, name: str) -> str:
    """Expressions that find the patterns at one end of contents, and those that take them off, in order."""
    back = "reverse({})".format if content != "content" else "{}".format
    fits = "ends_with" if content != "content" else "starts_with"
    return f"""{name}k as (select distinct site, {content} c from {pages} where content is not null{" and length(content) >= 2" * (name == "h")}),
{name}n as (select site, c, lead(c) over (partition by site order by c) d from {name}k),
{name}l as (select site, c, coalesce(list_position(list_transform(range(1, least(length(c), length(d)) + 1), lambda i: c[i] <> d[i]), true) - 1, least(length(c), length(d))) n from {name}n where d is not null),
{name}p as (select distinct site, {back(f"trim(left(c, n), {_BLANK})")} p from {name}l where n > 32),
{name}s as (select site, list(p order by length(p) desc, p desc) ps from {name}p group by site),
{name}c as (select x.site, page, case when ps is null then content else list_reduce(list_prepend(content, ps), lambda a, p: case when {fits}(a, p) then trim(replace(a, p, ''), {_BLANK}) else a end) end content from {pages} x left join {name}s using (site))"""


_SITES = rf"with p as (select regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) site, page_id page, {_PLAIN} content from pages)"


@query(f"{_SITES}, {_edge_sql('p', 'content', 'h')}, {_edge_sql('hc', 'reverse(content)', 'f')} select page, length(content) n, md5(content) as text from fc")
def site_headers(t: Tables) -> DataFrame:
    """Contents without what neighbouring pages of the host start or end with."""
    return SC.without_headers(_site_pages(t)).select("page", F.length("content").alias("n"), F.md5("content").alias("text"))


@query()
def site_long_patterns(t: Tables) -> DataFrame:
    """Contents without long stretches that pages of the host share; compared with a letter-by-letter version in the tests."""
    return SC.without_long_patterns(_site_pages(t)).select("page", F.length("content").alias("n"), F.md5("content").alias("text"))


_VOTE = ", ".join(f"len(list_filter(w, lambda x: list_contains({v!r}, x))) {k}" for k, v in sorted(TX.STOP_WORDS.items()))


@query(f"select doc_id, case when greatest(de, en, es, fr) = 0 then null when de = greatest(de, en, es, fr) then 'de' when en = greatest(de, en, es, fr) then 'en' when es = greatest(de, en, es, fr) then 'es' else 'fr' end language from (select doc_id, {_VOTE} from (select doc_id, {_W} w from documents))")
def language_vote(t: Tables) -> DataFrame:
    """The language that most frequent words speak for."""
    return t("documents").select("doc_id", TX.words(F.col("text")).alias("w")).select("doc_id", TX.language(F.col("w")).alias("language"))


_POST = f"select doc_id, term, length, count(*) tf from (select doc_id, len(w) length, unnest(w) term from (select doc_id, {_W} w from documents)) group by 1, 2, 3"
_ASK = f"select distinct item_id query, unnest(w) term from (select item_id, {_W} w from benchmark)"


def _index(t: Tables) -> DataFrame:
    """The inverted index as a table: it is read for sizes, for frequencies and for hits."""
    return stash(SE.postings(t("documents"), "doc_id"), "index")


def _asked(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query"), F.explode(TX.words(F.col("text"))).alias("term")).distinct()


@query(
    f"with p as ({_POST}), q as ({_ASK}), n as (select count(*) docs, avg(length) mean from (select distinct doc_id, length from p)), d as (select term, count(*) df from p group by 1) select query, doc_id, score, k as rank from (select *, row_number() over (partition by query order by score desc, doc_id) k from (select query, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) score from p join q using (term) join d using (term), n group by 1, 2)) where k <= 10"
)
def bm25_search(t: Tables) -> DataFrame:
    """The ten best documents for every benchmark passage."""
    return SE.bm25(_index(t), _asked(t), "doc_id", sizes=SE.sizes(t("documents")))


@query(
    f"with p as ({_POST}), q as ({_ASK}), n as (select count(distinct doc_id) docs from p), d as (select term, count(*) df, sum(tf) ttf from p group by 1), x as (select query, doc_id, tf, length, ttf, ln((docs + 1) / (df + 1.0)) + 1 idf from p join q using (term) join d using (term), n) select query, doc_id, count(*) matched, cast(sum(tf) as bigint) tf, max(length) length, round(min(idf), 6) min_idf, round(max(idf), 6) max_idf, round(avg(idf), 6) avg_idf, round(sum(idf), 6) sum_idf, round(stddev_pop(idf), 6) dev_idf, cast(max(ttf) as bigint) max_ttf from x group by 1, 2"
)
def ltr_features(t: Tables) -> DataFrame:
    """Ranking features of queries and documents."""
    f = SE.rank_features(_index(t), _asked(t), "doc_id")
    return f.select("query", "doc_id", "matched", "tf", F.col("length").cast("long").alias("length"), *r6("min_idf", "max_idf", "avg_idf", "sum_idf", "dev_idf"), "max_ttf")


@query(f"with p as ({_POST}), d as (select term, count(*) df from p group by 1 having count(*) >= 2) select doc_id, round(sum(ln((1 + (select count(distinct doc_id) from p)) / (1.0 + df)) + 1), 6) score from p join d using (term) group by 1")
def tfidf_scores(t: Tables) -> DataFrame:
    sets = t("documents").select("doc_id", F.explode(TX.words(F.col("text"))).alias("term"))
    return SE.tfidf(sets, "doc_id", 2).select("doc_id", *r6("score"))


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for v in TX.STOP_WORDS.values() for w in v}))


@query(
    f"""with c as (select item_id, generate_subscripts(p, 1) part, unnest(p) chunk from (select item_id, regexp_split_to_array(lower(text), '[^a-z0-9àâäáéèêëíîïñóôöúùûüçß ]+') p from benchmark)),
w as (select item_id, part, generate_subscripts(v, 1) pos, unnest(v) word from (select item_id, part, regexp_split_to_array(chunk, ' +') v from c)),
r as (select *, sum(case when word in ({_STOPS}) then 1 else 0 end) over (partition by item_id, part order by pos) run from w where word <> ''),
ph as (select item_id, part, run, list(word order by pos) v from r where word not in ({_STOPS}) group by 1, 2, 3),
x as (select item_id, array_to_string(v, ' ') phrase, len(v) n, generate_subscripts(v, 1) i, unnest(v) word from ph),
y as (select distinct item_id, phrase, i, word, sum(n) over (partition by item_id, word) / cast(count(*) over (partition by item_id, word) as double) ratio from x),
z as (select item_id, phrase, sum(ratio) score from y group by 1, 2)
select item_id, phrase, round(score, 6) score from (select *, max(score) over (partition by item_id) best from z) where score > 0.1 * best"""
)
def keywords_rake(t: Tables) -> DataFrame:
    """Key phrases of the benchmark passages."""
    return SE.rake(t("benchmark"), "item_id").select("item_id", "phrase", *r6("score"))


# Fingerprints and caches.


@query()
def text_fingerprint(t: Tables) -> DataFrame:
    """Fingerprints of all documents; golden values are in the tests."""
    return CA.with_fingerprints(t("documents").select("doc_id", "text")).select("doc_id", "fingerprint")


@query("select doc_id, first_value(doc_id) over w closest, case when first_value(doc_id) over w = doc_id then -1.0 else 1.0 end score from documents window w as (partition by md5(text) order by n_chars, doc_id)")
def earliest_match(t: Tables) -> DataFrame:
    """The first document with the same text, dated by length."""
    d = t("documents").select("doc_id", F.md5("text").alias("fingerprint"), "n_chars")
    return CA.earliest(d, "doc_id", "fingerprint", "n_chars")


@query("select min(doc_id) canonical, count(*) n from documents group by md5(text) having count(*) > 1")
def exact_dups(t: Tables) -> DataFrame:
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("h")


@query()
def fuzzy_dups(t: Tables) -> DataFrame:
    """The most similar part name of the same brand; compared with plain Python in the tests."""
    p = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("fp"), "p_brand")
    return CA.similar(p, "p_partkey", "fp", "p_brand", 0.8).select("p_partkey", "closest", *r6("score"))


@query("select event_id from events where user_id not in (select user_id from events where floor((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 86400000000) >= 30)")
def ttl_purge(t: Tables) -> DataFrame:
    """Events of users none of whose events is 30 days old."""
    return CA.purged(t("events"), "user_id", "ts", F.to_timestamp(F.lit("2024-02-01")), 30).select("event_id")


@query("select user_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k from events where ts < timestamp '2024-01-25') where k = 1 and (user_id, event_type) not in (select (user_id, event_type) from events where ts >= timestamp '2024-01-25') union all select user_id, event_type, round(value, 6) from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k from events where ts >= timestamp '2024-01-25') where k = 1")
def upsert_latest(t: Tables) -> DataFrame:
    """The stored state of users and types after a batch of later events."""
    from ..operators import relational as R

    last = lambda df: R.latest(df, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", *r6("value"))
    e = t("events")
    return R.upsert(last(e.where("ts < timestamp_ntz '2024-01-25'")), last(e.where("ts >= timestamp_ntz '2024-01-25'")), ["user_id", "event_type"])


@query("select d.doc_id, coalesce(case when d.lang = 'en' then d.n_chars end, case when o.lang = 'en' then o.n_chars end) n_chars, d.lang <> 'en' through_closest from documents d join (select doc_id, first_value(doc_id) over (partition by md5(text) order by n_chars, doc_id) closest from documents) c using (doc_id) join documents o on o.doc_id = c.closest")
def cache_lookup(t: Tables) -> DataFrame:
    """What a cache that holds the English documents has for all of them, through their first match if need be."""
    d = t("documents").select("doc_id", F.md5("text").alias("fingerprint"), "n_chars", "lang")
    closest = CA.earliest(d, "doc_id", "fingerprint", "n_chars")
    return CA.cached(d.select("doc_id"), d.where("lang = 'en'"), closest, "doc_id", "n_chars")
