"""Relational and investment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import links, moments
from ..operators import relational as R
from ..sources.store import stash
from .derived import Tables, sql

Q, S = {}, {}
FIRST, LAST = "1998-01-01", "2001-08-01"


def query(text: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if text is not None:
            S[f.__name__] = text
        return f

    return add


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


_WEIGHTED = {
    "w_s": "select s id, count(distinct o) / (count(distinct o) + 10.0) weight from facts group by s",
    "w_p": "select p id, count(distinct o) / (count(distinct o) + 10.0) weight from facts group by p",
    "sp": "select src, dst, score from holdings",
    "branded": "select distinct o, s, p_brand b from facts join part on p = p_partkey",
    "ss": "select a.s src, b.s dst, count(*) / (count(*) + 1.0) score from branded a join branded b on a.o = b.o and a.b = b.b and a.s <> b.s group by a.s, b.s",
    "pp": "select src, dst, score from part_edges union all select dst, src, score from part_edges",
}


def weighted(t: Tables) -> tuple[DataFrame, ...]:
    """Weights of suppliers and parts, the edges among suppliers and from them to parts, and the parts of each order;
    suppliers that bring one brand to an order are tied."""
    items = t("lineitem").select(F.col("l_orderkey").alias("o"), F.struct(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).alias("own"))
    orders = stash(items.where("o is not null").groupBy("o").agg(F.collect_set("own").alias("own")), "orders")  # one exchange for all that follows
    weight = lambda c: orders.select(F.explode(F.array_distinct(f"own.{c}")).alias("id")).groupBy("id").agg((F.count("*") / (F.count("*") + 10.0)).alias("weight"))
    sold = orders.select("o", F.explode("own").alias("own")).select("o", "own.*")
    b = t("part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("b")).where("b is not null")
    branded = sold.where("s is not null").join(b, "p").groupBy("o", "b").agg(F.collect_set("s").alias("own")).where("size(own) > 1")
    ss = branded.select(F.explode("own").alias("src"), "own").select("src", F.explode("own").alias("dst")).where("src <> dst")
    ss = ss.groupBy("src", "dst").agg((F.count("*") / (F.count("*") + 1.0)).alias("score"))
    sp = sold.select("s", "p").union(items.where("o is null").select("own.*").distinct())
    sp = sp.groupBy(F.col("s").alias("src"), F.col("p").alias("dst")).agg((F.count("*") / (F.count("*") + 1.0)).alias("score"))
    together = orders.select(F.array_distinct(F.filter("own.p", lambda p: p.isNotNull())).alias("own"))
    return stash(weight("s"), "weights"), weight("p"), ss, sp, together


_PATHS = """
pi as (select a.src, b.dst, sum(sqrt(coalesce(w.weight, 0) * a.score)) i1, sum(sqrt(coalesce(w.weight, 0) * b.score)) c1 from ss a join sp b on a.dst = b.src left join w_s w on w.id = a.dst group by 1, 2),
pc as (select a.src, b.dst, sum(sqrt(coalesce(w.weight, 0) * a.score)) i2, sum(sqrt(coalesce(w.weight, 0) * b.score)) c2 from sp a join pp b on a.dst = b.src left join w_p w on w.id = a.dst group by 1, 2),
pairs as (select src, dst, coalesce(i1, 0) i1, coalesce(c1, 0) c1, coalesce(i2, 0) i2, coalesce(c2, 0) c2 from pi full join pc using (src, dst)),
m1 as (select src, sum(sqrt(weight * score)) m from ss join w_s on id = dst group by 1),
m2 as (select dst, sum(sqrt(weight * score)) m from sp join w_s on id = src group by 1),
m3 as (select src, sum(sqrt(weight * score)) m from sp join w_p on id = dst group by 1),
m4 as (select dst, sum(sqrt(weight * score)) m from pp join w_p on id = src group by 1),
terms as (select pairs.src, pairs.dst, (i1 + c1 + i2 + c2) / 2 inner_, coalesce(sp.score, 0) link, coalesce(ws.weight, 0) ws, coalesce(wp.weight, 0) wp,
  greatest(0, coalesce(m1.m, 0) - i1) + greatest(0, coalesce(m2.m, 0) - c1) + greatest(0, coalesce(m3.m, 0) - i2) + greatest(0, coalesce(m4.m, 0) - c2) outer_
  from pairs left join sp using (src, dst) left join w_s ws on ws.id = pairs.src left join w_p wp on wp.id = pairs.dst
  left join m1 on m1.src = pairs.src left join m2 on m2.dst = pairs.dst left join m3 on m3.src = pairs.src left join m4 on m4.dst = pairs.dst),
scored as (select src, dst, coalesce(inner_ / nullif(inner_ + outer_, 0), 0) j000, sqrt(ws * wp) nodes, (link + 1) / 2 known from terms)
"""


@query(
    sql(
        "select src, dst, round(j000, 6) jaccard_000, round(j000 * nodes, 6) jaccard_100, round(j000 * known, 6) jaccard_010, round(j000 * nodes * known, 6) jaccard_110 from scored where j000 * nodes * known >= 0.01",
        "facts", "holdings", "bought", "part_edges", **_WEIGHTED,
    ).replace(" select src, dst, round(j000", "," + _PATHS + " select src, dst, round(j000", 1)
)
def jaccard_link_prediction(t: Tables) -> DataFrame:
    """Suppliers and the parts that they are likely to take up."""
    return links.jaccard_in_blocks(*weighted(t)).select("src", "dst", *r6("jaccard_000", "jaccard_100", "jaccard_010", "jaccard_110"))


_YEARLY = """select s, year(day) as year, count(amount) count_amount, min(amount) min_amount, max(amount) max_amount, median(amount) median_amount, sum(amount) sum_amount,
  sum(x) lin_count, sum(x * amount) lin_amount, sum(x * x) quad_count, sum(x * x * amount) quad_amount
  from (select distinct s, o, day, amount, (day - make_date(year(day), 1, 1)) / cast(make_date(year(day) + 1, 1, 1) - make_date(year(day), 1, 1) as double) x from facts join rounds using (o)) group by s, year(day)"""
_MOMENTS = ["sum_amount", "lin_count", "lin_amount", "quad_count", "quad_amount"]
_RESCALED = f"""select s, year, count_amount, min_amount, max_amount, sum_amount, past * count_amount + present * lin_count lin_count, past * sum_amount + present * lin_amount lin_amount,
  past * past * count_amount + 2 * past * present * lin_count + present * present * quad_count quad_count,
  past * past * sum_amount + 2 * past * present * lin_amount + present * present * quad_amount quad_amount
  from (select *, (make_date(year + 1, 1, 1) - make_date(year, 1, 1)) / cast(date '{LAST}' - date '{FIRST}' as double) present, (make_date(year, 1, 1) - date '{FIRST}') / cast(date '{LAST}' - date '{FIRST}' as double) past from yearly where year >= year(date '{FIRST}'))"""


def _yearly(t: Tables) -> DataFrame:
    raised = t.facts().select("s", "o").distinct().join(t.rounds(), "o")
    return moments.yearly(raised, ["s"], "day", "amount")


@query(
    sql(
        "select s, year, count_amount, min_amount, max_amount, round(median_amount, 4) median_amount, round(sum_amount, 2) sum_amount, round(lin_count, 6) lin_count, round(lin_amount, 2) lin_amount, round(quad_count, 6) quad_count, round(quad_amount, 2) quad_amount from yearly",
        "facts", "rounds", yearly=_YEARLY,
    )
)
def yearly_moments(t: Tables) -> DataFrame:
    """What every supplier raised by year."""
    two = ("sum_amount", "lin_amount", "quad_amount")
    return _yearly(t).select(
        "s", "year", "count_amount", "min_amount", "max_amount", F.round("median_amount", 4).alias("median_amount"),
        *(F.round(c, 2).alias(c) for c in two), *r6("lin_count", "quad_count"),
    )


@query(
    sql(
        "select s, cast(sum(count_amount) as bigint) count_amount, min(min_amount) min_amount, max(max_amount) max_amount, round(sum(sum_amount), 2) sum_amount, round(sum(lin_count), 6) lin_count, round(sum(lin_amount), 2) lin_amount, round(sum(quad_count), 6) quad_count, round(sum(quad_amount), 2) quad_amount from rescaled group by s",
        "facts", "rounds", yearly=_YEARLY, rescaled=_RESCALED,
    )
)
def rescale_recent_past(t: Tables) -> DataFrame:
    """The moments over the recent window, years added up."""
    out = moments.over_years(moments.rescaled(_yearly(t), FIRST, LAST), ["s"])
    two = ("sum_amount", "lin_amount", "quad_amount")
    return out.select("s", "count_amount", "min_amount", "max_amount", *(F.round(c, 2).alias(c) for c in two), *r6("lin_count", "quad_count"))


@query(
    sql(
        "select s, round(score, 6) score from (select s, tanh(ln(2 / 0.01 - 1) / (4 * (select median(x) from total)) * x) score from total) where score > 0",
        "facts", "rounds", total="select s, sum(amount) / 1e6 x from (select distinct s, o, amount from facts join rounds using (o)) group by s",
    )
)
def tanh_normalise(t: Tables) -> DataFrame:
    """Totals on a scale on which twice the median scores 0.99."""
    total = t.facts().select("s", "o").distinct().join(t.rounds(), "o").groupBy("s").agg((F.sum("amount") / 1e6).alias("x"))
    return R.tanh_normalised(total, "x").select("s", *r6("score"))


_CON = "select s, p, year(day) as year, count(*) n from facts join rounds using (o) group by 1, 2, 3"


@query(sql("select s, p, year, n, round(n / sum(n) over (partition by s, year), 6) concentration from counts", "facts", "rounds", counts=_CON))
def concentration(t: Tables) -> DataFrame:
    """The share of each part in what a supplier did in a year."""
    n = t.facts().join(t.rounds(), "o").groupBy("s", "p", F.year("day").alias("year")).agg(F.count("*").alias("n"))
    return n.select("s", "p", "year", "n", F.round(R.share("n", "s", "year"), 6).alias("concentration"))


@query(sql("select s, p, round(avg(concentration), 6) concentration, min(year) first, max(year) last from shares group by 1, 2", "facts", "rounds", counts=_CON, shares="select s, p, year, n / sum(n) over (partition by s, year) concentration from counts"))
def mean_concentration(t: Tables) -> DataFrame:
    """Concentrations averaged over the years."""
    n = t.facts().join(t.rounds(), "o").groupBy("s", "p", F.year("day").alias("year")).agg(F.count("*").alias("n"))
    n = n.withColumn("concentration", R.share("n", "s", "year"))
    return n.groupBy("s", "p").agg(F.round(F.avg("concentration"), 6).alias("concentration"), F.min("year").alias("first"), F.max("year").alias("last"))


@query(sql("select src, dst, n from bought", "bought"))
def cooccurrence_edges(t: Tables) -> DataFrame:
    """Pairs of parts in one order."""
    return t.bought()


@query(sql("select s, p, n from (select *, row_number() over (partition by s order by n desc, p) k from (select s, p, count(*) n from facts group by 1, 2)) where k <= 5", "facts"))
def top_n_per_group(t: Tables) -> DataFrame:
    """The five parts that every supplier takes most."""
    n = t.facts().groupBy("s", "p").agg(F.count("*").alias("n"))
    return R.top_n(n, 5, ["s"], F.desc("n"), F.col("p"))


@query(
    sql(
        "select p, y.year, coalesce(n, 0) n, round(coalesce(n / nullif(lag(n) over (partition by p order by y.year), 0) - 1, 0), 6) change from (select p_partkey p from part) cross join (select distinct year(o_orderdate) as year from orders) y left join (select p, year(day) as year, count(*) n from facts join rounds using (o) group by 1, 2) c using (p, year)",
        "facts", "rounds",
    ).replace("round(coalesce(n / nullif(lag(n) over (partition by p order by y.year), 0) - 1, 0), 6) change", "round(coalesce(coalesce(n, 0) / nullif(lag(coalesce(n, 0)) over (partition by p order by y.year), 0) - 1, 0), 6) change")
)
def densify_years(t: Tables) -> DataFrame:
    """Orders of every part in every year, zeros included, and the change to the year before."""
    n = t.facts().join(t.rounds(), "o").groupBy("p", F.year("day").alias("year")).agg(F.count("*").alias("n"))
    years = t("orders").select(F.year("o_orderdate").alias("year")).distinct()
    full = R.densified(n, t("part").select(F.col("p_partkey").alias("p")), years, "n")
    before = F.lag("n").over(Window.partitionBy("p").orderBy("year"))
    return full.withColumn("change", F.round(F.coalesce(F.try_divide("n", before) - 1, F.lit(0.0)), 6))


@query(
    sql(
        "select src, dst, round(coalesce(a.score, 0), 6) score_1, round(coalesce(b.score, 0), 6) score_2, round(pow(greatest(coalesce(a.score, 0), 0.9 * coalesce(a.score, 0) + 0.1 * coalesce(b.score, 0)), 1 - coalesce(b.score, 0) / 2), 6) blend from (select * from holdings where dst in (select p_partkey from part where p_size > 15)) a full join (select * from holdings where dst in (select p_partkey from part where p_size < 35)) b using (src, dst)",
        "holdings",
    )
)
def full_outer_blend(t: Tables) -> DataFrame:
    """Two scored edge tables that overlap in part, blended."""
    h = t.holdings()
    sized = lambda test: h.join(t("part").where(test).select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    both = R.both_scored(sized("p_size > 15"), sized("p_size < 35"), ["src", "dst"])
    return both.withColumn("blend", X.manual_blend(F.col("score_1"), F.col("score_2"))).select("src", "dst", *r6("score_1", "score_2", "blend"))


@query(
    sql(
        "select 'bought and sold' kind, count(*) n from part where p_partkey in (select p from facts) union all select 'never sold', count(*) from part where p_partkey not in (select p from facts) union all select 'touching', count(*) from bought where src in (select p_partkey from part where p_size = 1) or dst in (select p_partkey from part where p_size = 1) union all select 'induced', count(*) from bought where src in (select p_partkey from part where p_type = 'PROMO') and dst in (select p_partkey from part where p_type = 'PROMO')",
        "bought",
    )
)
def semi_anti_joins(t: Tables) -> DataFrame:
    """Membership joins, counted."""
    part, sold = t("part").withColumnRenamed("p_partkey", "id"), t.facts().select(F.col("p").alias("id"))
    edges = t.bought()
    counts = [
        ("bought and sold", R.keep(part, sold, "id")),
        ("never sold", R.drop(part, sold, "id")),
        ("touching", R.touching(edges, part.where("p_size = 1"))),
        ("induced", R.induced(edges, part.where("p_type = 'PROMO'"))),
    ]
    one = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in counts]
    return one[0].union(one[1]).union(one[2]).union(one[3])


@query(
    "with a as (select c_nationkey k, c_mktsegment x from customer), b as (select s_nationkey k from supplier) select 'union all' kind, count(*) n from (select k from a union all select k from b) union all select 'union', count(*) from (select k from a union select k from b) union all select 'intersect', count(*) from (select k from a intersect select k from b) union all select 'except', count(*) from (select k from a except select k from b) union all select 'except all', count(*) from (select k from a except all select k from b)"
)
def set_ops(t: Tables) -> DataFrame:
    """Bag and set operations, counted."""
    a, b = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    kinds = {"union all": a.union(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except all": a.exceptAll(b)}
    out = None
    for kind, df in kinds.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.union(row)
    return out


@query(
    sql(
        "select src, dst, round(score / sum(score) over w, 6) l1, round(score / sqrt(sum(score * score) over w), 6) l2, round(score / max(score) over w, 6) of_max from holdings window w as (partition by src)",
        "holdings",
    )
)
def normalisations(t: Tables) -> DataFrame:
    """Scores relative to sum, norm and greatest of their group: one sort for all three."""
    return t.holdings().select(
        "src", "dst", F.round(R.share("score", "src"), 6).alias("l1"), F.round(R.unit("score", "src"), 6).alias("l2"), F.round(R.of_max("score", "src"), 6).alias("of_max")
    )


@query(
    "select c_custkey, case when c_mktsegment is null then 'none' when c_acctbal < 0 then 'debt' else 'credit' end kind, round(coalesce(c_acctbal / nullif(c_nationkey, 0), 0), 6) per_nation from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey >= 3"
)
def conditional_scan(t: Tables) -> DataFrame:
    """Filters that are given, a case and a quotient, all pushed to the scan."""
    df = R.where_given(t("customer").where("c_nationkey >= 3"), c_mktsegment=["BUILDING", "MACHINERY"], c_custkey=None)
    kind = F.when(F.col("c_mktsegment").isNull(), "none").when(F.col("c_acctbal") < 0, "debt").otherwise("credit")
    return df.select("c_custkey", kind.alias("kind"), F.round(X.safe_div(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("per_nation"))


@query("select user_id, event_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k = 1")
def latest_per_key(t: Tables) -> DataFrame:
    """The last event of every user."""
    return R.latest(t("events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", *r6("value"))


@query(
    "select event_type, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) deviation, min(value) least, max(value) greatest, round(median(value), 6) median, round(quantile_cont(value, 0.75), 6) upper, count(distinct user_id) users, round(corr(value, user_id), 6) correlation from events group by event_type"
)
def summary_statistics(t: Tables) -> DataFrame:
    """Moments, quantiles and a correlation for every type of event."""
    return t("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.min("value").alias("least"),
        F.max("value").alias("greatest"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.75), 6).alias("upper"),
        F.countDistinct("user_id").alias("users"), F.round(F.corr("value", "user_id"), 6).alias("correlation"),
    )


@query(
    "select c_mktsegment, round(coalesce(sum(c_acctbal) filter (r_regionkey = 0), 0), 2) region_0, round(coalesce(sum(c_acctbal) filter (r_regionkey = 1), 0), 2) region_1, round(coalesce(sum(c_acctbal) filter (r_regionkey = 2), 0), 2) region_2 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by c_mktsegment"
)
def pivot_wide(t: Tables) -> DataFrame:
    """Balances by segment, a column for each of three regions."""
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy("c_mktsegment").pivot("n_regionkey", [0, 1, 2]).agg(F.sum("c_acctbal"))
    return p.select("c_mktsegment", *(F.round(F.coalesce(str(k), F.lit(0.0)), 2).alias(f"region_{k}") for k in range(3)))


@query(
    "select r_name, n_name, count(*) n, round(sum(s_acctbal), 2) balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)"
)
def rollup_levels(t: Tables) -> DataFrame:
    """Totals for every nation, region and all."""
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query(
    "select user_id, event_type, min(k) as start, count(*) length from (select user_id, event_type, k, k - row_number() over (partition by user_id, event_type order by k) island from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) k from events)) group by user_id, event_type, island"
)
def equal_runs(t: Tables) -> DataFrame:
    """Runs of events of one type in the life of a user."""
    e = t("events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return R.runs(e, ["user_id"], "k", "event_type").select("user_id", "event_type", "start", "length")


@query("select o_orderkey, round(greatest(0, least(1, (epoch_us(o_orderdate) - epoch_us(timestamp '1996-01-01')) / cast(epoch_us(timestamp '2000-01-01') - epoch_us(timestamp '1996-01-01') as double))), 6) position, year(o_orderdate) as year from orders")
def date_positions(t: Tables) -> DataFrame:
    """Where every order lies in four years, clipped."""
    at = lambda d: F.to_timestamp(F.lit(d))
    return t("orders").select("o_orderkey", F.round(X.date_position(F.col("o_orderdate"), at("1996-01-01"), at("2000-01-01")), 6).alias("position"), F.year("o_orderdate").alias("year"))


@query(sql("select src, dst, n from (select *, row_number() over (order by n desc, src, dst) k, count(*) over () total from bought) where k <= floor(0.1 * total)", "bought"))
def top_tenth(t: Tables) -> DataFrame:
    """The strongest tenth of all edges."""
    return R.top_share(t.bought(), 0.1, F.desc("n"), F.col("src"), F.col("dst"))


@query("select user_id, event_id, round(sum(value) over (partition by user_id order by ts range between interval 1 day preceding and current row), 4) recent from events")
def trailing_window(t: Tables) -> DataFrame:
    """What a user's events add up to over the day before each of them."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-86_400_000_000, 0)
    return t("events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("recent"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def json_field(t: Tables) -> DataFrame:
    """A field of JSON text."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select o_custkey, cast(count(*) as bigint) n, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) orders, cast(max(o_orderkey) + 1 as bigint) next_id from orders group by o_custkey")
def collected_lists(t: Tables) -> DataFrame:
    """Keys of a group as one list, and the next free key."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), ids.alias("orders"), (F.max("o_orderkey") + 1).alias("next_id"))
