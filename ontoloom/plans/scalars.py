"""Queries over scalar functions, parameters, windows of validity and small encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import strings as ST
from ..functions import text as TX
from ..sources import files
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


_CLEAN = r"trim(regexp_replace(translate({0}, '.,;:!?()[]', '          '), '[ \n\t\r]+', ' ', 'g'))"


@query(f"select doc_id, md5({_CLEAN.format('text')}) clean from documents")
def punctuation_free(t: Tables) -> DataFrame:
    """Documents without ten symbols."""
    return t("documents").select("doc_id", F.md5(ST.without_punctuation(F.col("text"))).alias("clean"))


@query(
    "with p as (select a.item_id, left(a.text, n) x, left(b.text, n) y from (select *, least(length(text), length(lead(text) over (order by item_id))) n, lead(item_id) over (order by item_id) nxt from benchmark) a join benchmark b on b.item_id = nxt), q as (select *, right(y, 7 % length(y)) || left(y, length(y) - 7 % length(y)) z from p), s as (select item_id, len(list_filter(range(1, length(x) + 1), lambda i: x[i] = z[i])) same, list_filter(range(length(x)), lambda i: x[i + 1] = ' ') u, list_filter(range(length(z)), lambda i: z[i + 1] = ' ') v from q) select item_id, cast(same as bigint) same, cast(len(u) as bigint) spaces, cast(len(list_intersect(u, v)) as bigint) common from s"
)
def letters_in_common(t: Tables) -> DataFrame:
    """Each passage against the next one turned by seven letters: equal letters, spaces, and spaces at the same place."""
    b = t("benchmark")
    order = Window.orderBy("item_id")  # of the benchmark, which is small by its nature
    p = b.select("item_id", "text", F.lead("text").over(order).alias("next")).where("next is not null")
    p = p.withColumn("n", F.least(F.length("text"), F.length("next")))
    p = p.select("item_id", F.left("text", F.col("n")).alias("x"), ST.shifted(F.left("next", F.col("n")), F.lit(7)).alias("z"))
    same = F.size(F.filter(ST.equal_letters(F.col("x"), F.col("z")), lambda e: e))
    p = p.select("item_id", same.alias("same"), ST.places_of_spaces(F.col("x")).alias("u"), ST.places_of_spaces(F.col("z")).alias("v"))
    return p.select("item_id", F.col("same").cast("long"), F.size("u").cast("long").alias("spaces"), F.size(F.array_intersect("u", "v")).cast("long").alias("common"))


@query("select doc_id, md5(text) || '_' || lang || '_en' token, lower(source) || ':' || doc_id origin, regexp_matches(md5(text) || '_' || lang || '_en', '^[0-9a-f]{32}(_.+)?$') valid from documents")
def text_tokens(t: Tables) -> DataFrame:
    """Tokens of documents to be translated, and where they come from."""
    token = ST.text_token(F.col("text"), F.col("lang"), F.lit("en"))
    return t("documents").select("doc_id", token.alias("token"), ST.origin_token(F.col("source"), F.col("doc_id").cast("string")).alias("origin"), ST.is_token(token).alias("valid"))


@query("select r_name, case when len(n) = 0 then '' when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end listed, cast(len(string_split(array_to_string(n, '|'), '|')) as bigint) parts from (select r_name, list(n_name order by n_name) n from region join nation on r_regionkey = n_regionkey group by r_name)")
def english_lists(t: Tables) -> DataFrame:
    """The nations of each region in words, and joined and split again."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    return n.select("r_name", ST.listed(F.col("n")).alias("listed"), F.size(F.split(F.array_join("n", "|"), r"\|")).cast("long").alias("parts"))


@query("select o_orderkey, coalesce(o_orderpriority, '') || ' ' || coalesce(case when o_orderstatus = 'F' then o_orderstatus end, '') || ' ' || coalesce(c_mktsegment, '') described from orders left join customer on o_custkey = c_custkey")
def descriptions(t: Tables) -> DataFrame:
    """Descriptions of orders, with parts that may be missing."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus"))
    return o.select("o_orderkey", ST.described(F.col("o_orderpriority"), status, F.col("c_mktsegment")).alias("described"))


_KIND = "case e " + " ".join(f"when '{e}' then '{k}'" for e, k in ST.KINDS.items()) + " else 'other' end"


@query(rf"select page_id, e extension, {_KIND} kind, u is_url, e = 'pdf' is_pdf from (select page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]{{1,5}})$', 1)) e, starts_with(url, 'http://') or starts_with(url, 'https://') u from pages)")
def file_kinds(t: Tables) -> DataFrame:
    """What the addresses of pages say of their files."""
    u, e = F.col("url"), ST.extension(F.col("url"))
    return t("pages").select("page_id", e.alias("extension"), ST.kind_of_file(u).alias("kind"), ST.is_url(u).alias("is_url"), (e == "pdf").alias("is_pdf"))


@query("select p_partkey, replace(replace(lower(n), ' ', '_'), '-', '') as name, translate(replace(replace(lower(n), ' ', '_'), '-', ''), '\\/*?\"<>| ,;:#', '') <> replace(replace(lower(n), ' ', '_'), '-', '') invalid from (select p_partkey, p_name || '-' || p_brand n from part)")
def index_names(t: Tables) -> DataFrame:
    """Names of parts as names of indexes."""
    name = ST.index_name(F.concat_ws("-", "p_name", "p_brand"))
    return t("part").select("p_partkey", name.alias("name"), ST.has_invalid_characters(name).alias("invalid"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[ ]*[\n\r]+', '. ', 'g'), '[.!?]+[ ]+'), lambda s: trim(s)), lambda s: length(s) > 0)"


@query(f"select doc_id, cast(len(s) as bigint) n, md5(array_to_string(s, '|')) sentences from (select doc_id, case when length(text) < 4 then [text] else {_SENT} end s from documents)")
def sentence_split(t: Tables) -> DataFrame:
    """Sentences of documents, as a translator takes them."""
    s = ST.sentences(F.col("text"))
    return t("documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences"))


@query(r"""select item_id, md5(trim(regexp_replace(regexp_replace(' ```json' || chr(10) || '{"k": ' || item_id || '}' || chr(10) || '```' || chr(10), '^[ \n]*```(json)?[ ]*\n', ''), '\n[ ]*```[ \n]*$', ''))) json, item_id k from benchmark""")
def fenced_json(t: Tables) -> DataFrame:
    """JSON read out of Markdown fences."""
    text = ST.without_fences(F.concat(F.lit(' ```json\n{"k": '), F.col("item_id").cast("string"), F.lit("}\n```\n")))
    return t("benchmark").select("item_id", F.md5(text).alias("json"), F.get_json_object(text, "$.k").cast("long").alias("k"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as stamp, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') = o_orderdate round_trip, strftime(cast(o_orderdate as date) + interval 3 year, '%Y-%m-%d') later from orders")
def date_texts(t: Tables) -> DataFrame:
    """Dates written, read again, and three years on."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    later = F.date_format(ST.add_years(F.col("o_orderdate").cast("date"), 3), "yyyy-MM-dd")
    return t("orders").select("o_orderkey", stamp.alias("stamp"), (F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd HH:mm:ss")) == F.col("o_orderdate")).alias("round_trip"), later.alias("later"))


@query("select event_id, round(floor(value) + 3600 * (user_id % 24) + 0.25, 2) as \"seconds\" from events")
def durations(t: Tables) -> DataFrame:
    """Durations read from logs that say them twice, the second time for good."""
    e = t("events")
    whole = F.floor("value").cast("long")
    clock = F.format_string("%02d:%02d:%02d.25", F.col("user_id") % 24 + F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    log = F.concat(F.lit("Duration: 00:00:01.00, start: 0\nsize= 1kB time="), clock, F.lit(" bitrate=1"))
    return e.select("event_id", F.round(ST.duration_seconds(log), 2).alias("seconds"))


@query("select vec_id, cast(len(embedding) as bigint) n, round(list_sum(list_transform(cast(embedding as double[]), lambda x: round(x, 9))), 6) total from embeddings")
def vectors_as_json(t: Tables) -> DataFrame:
    """Vectors written as JSON and read again."""
    v = ST.vector_of_json(ST.vector_json(F.col("embedding")))
    return t("embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("select r_name, n_nationkey \"key\", n_name as name from region join nation on r_regionkey = n_regionkey")
def inverted_maps(t: Tables) -> DataFrame:
    """For each region a map from names to keys, turned round and listed."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    maps = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return maps.select("r_name", F.explode(ST.inverted(F.col("m"))).alias("key", "name"))


_TW = "regexp_extract_all(coalesce(text, ''), '[^ ]+')"


@query(f"select conv_id, count(*) n, cast(sum(len(w)) as bigint) words, md5(string_agg(array_to_string(w, ' '), ' ' order by turn) filter (len(w) > 0)) flat from (select conv_id, turn, {_TW} w from conversations) group by conv_id")
def flattened_words(t: Tables) -> DataFrame:
    """The words of all turns of a conversation as one list."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0))
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", w.alias("w")))).alias("t"))
    flat = F.flatten(F.transform("t", lambda x: x["w"]))
    return turns.select("conv_id", F.size("t").cast("long").alias("n"), F.size(flat).cast("long").alias("words"), F.md5(F.array_join(flat, " ")).alias("flat"))


@query("select conv_id, count(*) pages, md5(arg_min(text, turn)) first from conversations where text is not null group by conv_id")
def pages_as_json(t: Tables) -> DataFrame:
    """Turns as a JSON list of pages, counted and read from it."""
    page = F.struct(F.col("turn").alias("page"), F.col("text").alias("content"))
    j = t("conversations").where("text is not null").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(page))).alias("j"))
    return j.select("conv_id", F.json_array_length("j").cast("long").alias("pages"), F.md5(F.get_json_object("j", "$[0].content")).alias("first"))


@query(sql("select src, dst, round(case when score < 0.6 and m = 0 then 0 else score end, 6) score from (select src, dst, score, case when p_size < 10 then 0.5 else 0 end m from holdings join part on dst = p_partkey)", "holdings"))
def masked_scores(t: Tables) -> DataFrame:
    """Weak scores count only where there is a manual one."""
    h = t.holdings().join(t("part"), F.col("dst") == F.col("p_partkey"))
    manual = F.when(F.col("p_size") < 10, 0.5).otherwise(0.0)
    return h.select("src", "dst", F.round(ST.masked_score(F.col("score"), manual, 0.6), 6).alias("score"))


@query("select o_orderkey, count(*) n from orders join lineitem on l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 60 day where o_orderdate <= timestamp '2000-01-01' and o_orderdate + interval 60 day >= timestamp '1999-12-01' group by 1")
def valid_intervals(t: Tables) -> DataFrame:
    """Orders that are valid at one of two moments, with the items shipped while they were."""
    o = t("orders").withColumn("until", F.expr("o_orderdate + interval 60 days"))
    o = o.where("o_orderdate <= timestamp_ntz '2000-01-01' and until >= timestamp_ntz '1999-12-01'")
    items = t("lineitem").join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & ST.valid_at(F.col("l_shipdate"), F.col("o_orderdate"), F.col("until")))
    return items.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("select page, count(*) n, min(o_orderkey) first, max(o_orderkey) last from (select *, o_orderkey // 1000 as page from orders) group by page")
def paged_scan(t: Tables) -> DataFrame:
    """Orders by pages of a thousand keys."""
    return files.paged(t("orders"), "o_orderkey", 1000).groupBy("page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("select p_type, p_size, count(*) n from part where p_type = 'PROMO' and p_size in (1, 7, 23) group by 1, 2")
def parameterised(t: Tables) -> DataFrame:
    """A statement with one value and a list of values as parameters."""
    text = "select p_type, p_size, count(*) n from {part} where p_type = :type and array_contains(:sizes, p_size) group by 1, 2"
    return t.spark.sql(text, args={"type": "PROMO", "sizes": F.array(*(F.lit(k) for k in (1, 7, 23)))}, part=t("part"))


@query("select user_id, cast(count(*) as bigint) n, cast(count(*) filter (ln(value + 1e-9) >= 3) as bigint) kept from events group by 1")
def confident_segments(t: Tables) -> DataFrame:
    """Segments of each user whose logarithmic score is high enough, filtered within their list."""
    s = t("events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", F.log(F.col("value") + 1e-9).alias("score"))).alias("s"))
    return s.select("user_id", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda x: x["score"] >= 3)).cast("long").alias("kept"))


@query("select vec_id, array_to_string(list_transform(list_filter(range(1, 64), lambda k: k % 8 <> 0), lambda k: cast(cast(embedding[k + 1] > embedding[k] as int) as varchar)), '') bits from embeddings")
def image_hashes(t: Tables) -> DataFrame:
    """Difference hashes of vectors taken for images of eight by eight."""
    return t("embeddings").select("vec_id", F.array_join(F.transform(ST.difference_hash(F.col("embedding"), 8), lambda b: b.cast("string")), "").alias("bits"))


@query("select label, md5(string_agg(md5(array_to_string(list_transform(list_filter(range(1, 64), lambda k: k % 8 <> 0), lambda k: cast(cast(embedding[k + 1] > embedding[k] as int) as varchar)), '')), '' order by vec_id)) token, count(*) pages from embeddings group by label")
def document_hashes(t: Tables) -> DataFrame:
    """The hash of a document: that of the hashes of its pages in order."""
    bits = F.array_join(F.transform(ST.difference_hash(F.col("embedding"), 8), lambda b: b.cast("string")), "")
    pages = t("embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.md5(bits).alias("h")))).alias("p"))
    return pages.select("label", F.md5(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("token"), F.size("p").cast("long").alias("pages"))


_NAME = "string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')"


@query(f"select p_partkey, md5(array_to_string(flatten(list_transform(range(1, len(w) + 1), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))), '|')) grams, cast(len(w) * (len(w) + 1) // 2 as bigint) n from (select p_partkey, {_NAME} w from part)")
def all_ngrams(t: Tables) -> DataFrame:
    """Word n-grams of every length of what names a part."""
    g = TX.all_ngrams(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " "))
    return t("part").select("p_partkey", F.md5(F.array_join(g, "|")).alias("grams"), F.size(g).cast("long").alias("n"))


_BW = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '" + TX.WORDS + "'), lambda w: length(w) > 0)"


@query(f"select item_id, cast(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as bigint) n, md5(array_to_string(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))), '|')) shingles from (select item_id, {_BW} w from benchmark)")
def suggest_shingles(t: Tables) -> DataFrame:
    """Words of passages, with their pairs and triples."""
    w = TX.words(F.col("text"))
    g = F.concat(w, TX.ngrams(w, 2), TX.ngrams(w, 3))
    return t("benchmark").select("item_id", F.size(g).cast("long").alias("n"), F.md5(F.array_join(g, "|")).alias("shingles"))


@query("select p_brand, array_to_string(list_sort(list_distinct(flatten(list([p_type, 'size ' || p_size // 10])))), ',') merged from part group by 1")
def merged_lists(t: Tables) -> DataFrame:
    """The distinct entries of all lists of a brand."""
    own = F.array("p_type", F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string")))
    p = t("part").groupBy("p_brand").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("m"))
    return p.select("p_brand", F.array_join("m", ",").alias("merged"))


@query("with s as (select distinct p_brand b, p_name x from part), n as (select b, count(*) n from s group by 1) select a.b first, c.b as second, count(*) common, max(n.n) + max(m.n) - count(*) either from s a join s c on a.x = c.x and a.b < c.b join n on n.b = a.b join n m on m.b = c.b group by 1, 2")
def set_overlaps(t: Tables) -> DataFrame:
    """How many names two brands have in common, and how many either has."""
    s = t("part").select(F.col("p_brand").alias("first"), F.col("p_name").alias("x")).distinct()
    n = s.groupBy("first").agg(F.count("*").alias("n"))
    both = s.join(s.withColumnRenamed("first", "second"), "x").where("first < second").groupBy("first", "second").agg(F.count("*").alias("common"))
    both = both.join(n, "first").join(n.toDF("second", "m"), "second")
    return both.select("first", "second", "common", (F.col("n") + F.col("m") - F.col("common")).alias("either"))


_HREF = r"""list_distinct(list_transform(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda u: not regexp_matches(lower(u), '\.(pdf|png|jpg|mp3|mp4)$') and not contains(u, 'wp-admin')), lambda u: regexp_replace(u, '/$', '')))"""
_HOST = r"regexp_extract({0}, '^https?://(?:www\.)?([^/?#]+)', 1)"


@query(rf"select page_id, cast(len(l) as bigint) n, array_to_string(l, ' ') links from (select page_id, list_sort(list_distinct(list_filter(list_transform({_HREF}, lambda u: case when starts_with(u, '/') and not starts_with(u, '//') then regexp_extract(url, '^(https?://[^/?#]+)', 1) || u else u end), lambda u: {_HOST.format('u')} = {_HOST.format('url')}))) l from pages)")
def sublinks(t: Tables) -> DataFrame:
    """Links of pages that stay on their site."""
    found = TX.same_site_links(F.col("html"), F.col("url"))
    return t("pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("links"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 1900 else year(o_orderdate) end as year from orders")
def years_of_texts(t: Tables) -> DataFrame:
    """Years of dates written as text, some of which are none."""
    text = F.when(F.col("o_orderstatus") == "F", "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", X.year_of_text(text).cast("long").alias("year"))


@query("select doc_id, quality = 1 good from labels where quality is not null")
def truth_values(t: Tables) -> DataFrame:
    """Labels written out and read as truth values."""
    text = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, " OFF")
    return t("labels").where("quality is not null").select("doc_id", X.parse_bool(text).alias("good"))
