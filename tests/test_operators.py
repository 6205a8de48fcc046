"""Golden values, invariants and plain-Python comparisons of the operators."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from ontoloom.functions import expr as X
from ontoloom.functions import text as TX
from ontoloom.functions.udf import lcs_length, lcs_similarity
from ontoloom.operators import cache, cluster, configuration, evaluate, graph, moments, ontology, relational, scrape, wikify
from ontoloom.sources import store
from ontoloom.streaming import events

EDGES = [(1, 2, 1.0), (1, 3, 1.0), (3, 4, 1.0)]
FIRST = {"A": {1: 0.7, 2: 0.2}, "B": {1: 0.4, 2: 0.5, 3: 0.5}, "C": {2: 0.6, 3: 0.9}}
SECOND = {"P": {1: 0.2, 2: 0.1, 3: 0.3}, "Q": {3: 0.3, 4: 0.5}}


def values(spark, column, xs):
    return [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(column(F.col("x"))).collect()]


def configurations(spark, name, of):
    return spark.createDataFrame([(k, c, s) for k, cs in of.items() for c, s in cs.items()], f"{name} string, concept long, score double")


def test_curves(spark):
    assert values(spark, X.ratio_s_curve, [0, 0.25, 0.5, 0.75, 1]) == pytest.approx([0, 0.1, 0.5, 0.9, 1])
    assert values(spark, X.concave, [0, 0.25, 0.5, 1]) == pytest.approx([0, 0.4375, 0.75, 1])
    assert values(spark, X.power_s_curve, [-1, 0, 0.3, 1, 2]) == pytest.approx([0, 0, 0.3, 1, 1])
    ten = lambda d: lambda x: X.count_s_curve(x, F.lit(10.0), 3, d)
    assert values(spark, ten(2), [0, 1, 3, 5, 10]) == pytest.approx([0, 0.033333, 0.3, 0.642857, 1], abs=1e-6)
    assert values(spark, ten(8), [1, 3, 5, 10]) == pytest.approx([0.000046, 0.3, 0.952568, 1], abs=1e-6)
    scaled = values(spark, lambda x: X.tanh_scale(x, F.lit(120.0)), [0, 20, 60, 120, 180, 240, 300])
    assert scaled == pytest.approx([0, 0.217, 0.579, 0.868, 0.963, 0.990, 0.997], abs=1e-3)


def test_fingerprints():
    assert cache.text_fingerprint("Hi guys, how's it going?") == "48cae6523a7e1056a67e1a8806561a4c06000000000000000000000000000000_01_01"
    assert cache.text_fingerprint("Mesdames et messieurs, bienvenue.") == "4de0cae07a22b2fef28842f27e7e1af292747ed41af24c9cf24c92f200000000_01_01"
    assert cache.text_fingerprint(None) is None
    assert cache.text_fingerprint("")[:64] == "0" * 64
    assert len(cache.text_fingerprint("word " * 5000)) == 70


def test_lcs():
    assert lcs_similarity("kitten", "sitting") == pytest.approx(0.615385, abs=1e-6)
    assert lcs_similarity("schreier graphs", "cayley graph") == pytest.approx(0.592593, abs=1e-6)
    assert lcs_similarity("", "") == 1 and lcs_similarity("", "a") == 0 and lcs_similarity(None, "a") is None
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]


def test_toy_configurations(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long, score double")
    assert graph.normalised(edges).count() == 10
    x, y = configurations(spark, "k", FIRST), configurations(spark, "l", SECOND)
    mixed = {(r["k"], r["concept"]): r["score"] for r in configuration.mixed(x, graph.normalised(edges)).collect()}
    want = {"A": {1: 0.3, 2: 0.45, 3: 0.233333}, "B": {1: 0.466667, 2: 0.45, 3: 0.3, 4: 0.25}, "C": {1: 0.5, 2: 0.3, 3: 0.3, 4: 0.45}}
    assert mixed == pytest.approx({(k, c): s for k, cs in want.items() for c, s in cs.items()}, abs=1e-6)
    pairs = x.select("k").distinct().crossJoin(y.select("l").distinct())
    for method, golden in (("cosine", (0.841168, 0.318858, 0.977080, 0.609938, 0.982850, 0.793821)), ("euclidean", (0.658056, 0.438306, 0.590830, 0.462621, 0.562336, 0.535058))):
        got = configuration.affinities(x, y, pairs, edges, mix_x=True, mix_y=True, method=method).orderBy("k", "l").collect()
        assert [r["score"] for r in got] == pytest.approx(golden, abs=1e-6)


def test_weights_sum_to_one():
    assert sum(wikify.WEIGHTS.values()) == pytest.approx(1)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2100)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {v: find(v) for a, b in links if a != b for v in (a, b)}


def test_moments_compose(spark):
    rows = [(1, datetime.date(2000 + d // 365, 1 + d % 12, 1 + d % 28), float(d)) for d in range(100, 1500, 37)]
    df = spark.createDataFrame(rows, "k long, day date, amount double")
    got = moments.over_years(moments.rescaled(moments.yearly(df, ["k"], "day", "amount"), "2000-01-01", "2005-01-01"), ["k"]).first()
    span = (datetime.date(2005, 1, 1) - datetime.date(2000, 1, 1)).days
    at = [(d - datetime.date(2000, 1, 1)).days / span for _, d, _ in rows]
    assert got["count_amount"] == len(rows)
    assert got["lin_count"] == pytest.approx(sum(at))
    assert got["quad_amount"] == pytest.approx(sum(p * p * a for p, (_, _, a) in zip(at, rows)))


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 0.0), (2, 0.0), (None, 1.0)], "k long, v double")
    got = df.select("k", relational.share("v", "k").alias("s"), relational.unit("v", "k").alias("u")).collect()
    assert {(r["k"], r["s"], r["u"]) for r in got} == {(1, 1.0, 1.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (None, 1.0, 1.0)}
    empty = df.where("false")
    assert relational.top_n(empty, 3, ["k"], F.desc("v")).count() == 0
    assert relational.tanh_normalised(empty, "v").count() == 0
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), path, ["k"])
    store.upsert_table(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert store.delete_rows(spark, path, spark.createDataFrame([(1,)], "k long"), ["k"]).count() == 2
    store.write_gexf(spark.createDataFrame([(1, "a&b")], "id long, label string"), spark.createDataFrame([(1, 1, 0.5)], "src long, dst long, score double"), str(tmp_path / "g"))
    assert 'label="a&amp;b"' in (tmp_path / "g").read_text()


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>Hi<b>x</b>&amp;</p><script>no</script>", "http://www.a.org/en/1?page=2", None), ("", "https://b.org", "")], "h string, u string, t string")
    got = df.select(TX.plain_html(F.col("h")), TX.host(F.col("u")), TX.page_type(F.col("u")), F.size(TX.words(F.col("t"))), TX.language(TX.words(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [("Hi x &", "a.org", "list", 0, None), ("", "b.org", "other", 0, None)]
    chunks = spark.range(1).select(TX.chunks(F.split(F.lit(" ".join(map(str, range(950)))), " "))).first()[0]
    assert [c.split()[0] for c in chunks] == ["0", "300", "600"] and chunks[-1].split()[-1] == "949"


def test_headers(spark):
    head = "A header that all of the pages of this site share: "
    pages = [("s", k, head + c) for k, c in enumerate(("one", "two", "three"))] + [("t", 9, "other")]
    got = scrape.without_headers(spark.createDataFrame(pages, "site string, page long, content string"))
    assert {r["page"]: r["content"] for r in got.collect()} == {0: "one", 1: "wo", 2: "hree", 9: "other"}


def test_earliest_and_similar(spark):
    rows = [(1, "x", 3), (2, "x", 1), (3, "x", 2), (4, "y", 1), (5, None, 1)]
    got = cache.earliest(spark.createDataFrame(rows, "k long, f string, d long"), "k", "f", "d")
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1.0), (2, 2, -1.0), (3, 2, 1.0), (4, 4, -1.0), (5, 5, -1.0)}
    names = ["red ring", "red rings", "blue bolt", "blue bolts", "zzz"]
    got = {r["k"]: r["closest"] for r in cache.similar(spark.createDataFrame(list(enumerate(names)), "k long, f string").withColumn("b", F.lit(1)), "k", "f", "b", 0.8).collect()}
    assert got == {0: 1, 1: 0, 2: 3, 3: 2}
    assert difflib.SequenceMatcher(None, *names[:2]).ratio() >= 0.8


def test_linkage_and_cover():
    import pandas as pd

    v = [[1, 0], [1, 0.01], [0, 1], [0.01, 1], [-1, 0]]
    got = cluster.linkage(pd.DataFrame({"id": range(5), "vector": v}), 3)["cluster"].tolist()
    assert got == [0, 0, 1, 1, 2]
    taken = cluster.set_cover(pd.DataFrame({"set_id": [1, 1, 1, 2, 3, 3], "element": [1, 2, 3, 3, 3, 4]}))
    assert taken["set_id"].tolist() == [1, 3] and taken["gain"].tolist() == [3, 1]


def test_splits_repeat(spark):
    df = spark.range(1000)
    a = evaluate.hash_split(df, "id", 0.3)
    assert a.where("test").count() == evaluate.hash_split(df.repartition(3), "id", 0.3).where("test").count()
    assert 200 < a.where("test").count() < 400
    assert evaluate.weighted_sample(df.withColumn("w", F.lit(1.0)), "id", "w", 10).count() == 10


def test_edits(spark):
    members = spark.createDataFrame([("a", 1), ("b", 2)], "cluster string, concept long")
    after, judged = ontology.insert_concepts(members, spark.createDataFrame([("a", 3), ("a", 2), ("z", 4)], "cluster string, concept long"))
    assert {tuple(r) for r in after.collect()} == {("a", 1), ("b", 2), ("a", 3)}
    assert {r["concept"]: r["processed"] for r in judged.collect()} == {3: True, 2: False, 4: False}


@pytest.mark.parametrize("name,build", [("tumbling", lambda d: events.tumbling(d, "1 day", "event_type")), ("sliding", lambda d: events.sliding(d, "1 day", "12 hours", "event_type"))])
def test_stream_equals_batch(spark, tmp_path, name, build):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/events.parquet")
    (tmp_path / "in").mkdir()
    table.write.parquet(str(tmp_path / "in" / "part"))
    stream = events.watermarked(events.event_stream(spark, str(tmp_path / "in" / "part"), table.schema))
    out = build(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    key = lambda df: {(str(r["start"]), r["event_type"], r["n"], round(r["total"], 4)) for r in df.collect()}
    assert key(spark.table(f"out_{name}")) == key(build(events.watermarked(table)))


def held(f):
    """(what f returns, most bytes that it held)."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_spectral_holds_no_whole_matrix():
    import numpy as np
    import pandas as pd

    n = 3000  # a circle of 2500 nodes, and one of 500
    at = np.arange(n)
    edges = pd.DataFrame({"src": at, "dst": np.where(at == 2499, 0, np.where(at == n - 1, 2500, at + 1)), "score": 0.5})
    chords = pd.DataFrame({"src": np.arange(2499), "dst": np.random.default_rng(3).integers(0, 2500, 2499), "score": 0.5})
    edges = pd.concat([edges, chords]).query("src != dst").drop_duplicates(["src", "dst"])
    got, most = held(lambda: cluster.spectral(edges, 5))
    w = np.zeros((n, n))
    for s, t in edges[["src", "dst"]].itertuples(index=False):
        w[s, t] = w[t, s] = 0.5
    d = np.sqrt(w.sum(1))
    assert np.allclose(got["eigenvalue"], np.linalg.eigvalsh(np.eye(n) - w / np.outer(d, d))[:5], atol=1e-7)
    assert most < n * n  # a whole matrix has eight times as many bytes


def test_linkage_holds_no_whole_matrix():
    import numpy as np
    import pandas as pd

    rng, n = np.random.default_rng(4), 3000
    of = rng.integers(0, 3, n)
    v = np.eye(8)[of] + rng.normal(0, 0.05, (n, 8))
    v[:100] = v[100:200]
    of[:100] = of[100:200]
    got, most = held(lambda: cluster.linkage(pd.DataFrame({"id": range(n), "vector": list(v)}), 3))
    assert len(set(zip(of, got["cluster"]))) == 3 and most < n * n


def test_groups_are_joined_once_for_several_partings(spark, monkeypatch):
    import pandas as pd

    v = [(1, k, [1.0, k / 9 if k < 5 else 9.0 * k]) for k in range(9)]
    df = spark.createDataFrame(v, "g int, id long, vector array<double>")
    run, out = [], {}
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: type("G", (), {"applyInPandas": lambda s, f, schema: run.append(f)})())
    cluster.broken_up(df, "g", (2, 3))
    calls, whole = [], cluster.merges
    monkeypatch.setattr(cluster, "merges", lambda x: calls.append(len(x)) or whole(x))
    pdf = pd.DataFrame([x[1:] for x in v], columns=["id", "vector"])
    for k, own in run[0](pdf).groupby("k"):
        out[k] = own["cluster"].tolist()
    assert calls == [9] and out == {k: cluster.linkage(pdf, k)["cluster"].tolist() for k in (2, 3)}


def test_cover_of_many_sets():
    import time

    import numpy as np
    import pandas as pd

    n = 8000
    sets = pd.DataFrame({"set_id": np.repeat(np.arange(n), 5), "element": np.arange(5 * n)})
    began = time.process_time()
    assert cluster.set_cover(sets, 0.9)["set_id"].tolist() == list(range(n * 9 // 10))
    assert time.process_time() - began < 4  # looking at all sets again at each step takes several times as long


def test_spread_scores_do_not_hang_on_how_rows_lie(spark, monkeypatch):
    from ontoloom.operators import spread

    monkeypatch.setattr(spread, "KEYS", 2)
    monkeypatch.setattr(spread, "TILE", 8)
    rng = random.Random(3)
    groups = [rng.sample(range(30), rng.randrange(1, 6)) for _ in range(60)] + [[40]]
    shared = {}
    for g in groups:
        for a in g:
            for b in g:
                shared[a, b] = shared.get((a, b), 0) + 1
    edge = {(a, b): 1.0 if a == b else n / (n + 1) for (a, b), n in shared.items() if a != 40}
    rows = list({(rng.choice([None, *range(7)]), rng.randrange(30)): rng.random() for _ in range(80)}.items())
    want = {}
    for (s, c), v in sorted(rows, key=lambda r: r[0][1]):  # sums in order of concepts, to the last bit
        for b in range(30):
            if (c, b) in edge:
                want[s, b] = want.get((s, b), 0.0) + v * edge[c, b] / sum(x[1] == b for x in edge)
    top = {s: max(v for (t, _), v in want.items() if t == s) for s, _ in want}
    want = {k: v for k, v in want.items() if v >= 0.3 * top[k[0]]}
    for _ in range(2):
        rng.shuffle(rows)
        rng.shuffle(groups)
        x = spark.createDataFrame([(s, c, v) for (s, c), v in rows], "s int, concept int, score double").repartition(3)
        own = spark.createDataFrame([(g,) for g in groups], "own array<int>").repartition(3)
        got = configuration.mixed_over(x, own, 0.3)
        assert got.schema.simpleString() == "struct<s:int,concept:int,score:double>"
        assert {(r["s"], r["concept"]): r["score"] for r in got.collect()} == want
    assert None in top and len(want) > 40


def test_pairs_of_groups_are_packed_before_they_are_sent(spark, monkeypatch):
    from ontoloom.operators import spread

    monkeypatch.setattr(spread, "TILE", 16)
    monkeypatch.setattr(spread, "PATHS", 50)
    rng = random.Random(4)
    own = spark.createDataFrame([(rng.sample(range(60), rng.randrange(7)),) for _ in range(80)] + [(None,), (list(range(30)),)], "own array<long>").repartition(3)
    packed = spread.tiles(own)
    assert "Generate" not in packed._jdf.queryExecution().executedPlan().toString()
    graphs = [{r["tile"]: [c.tolist() for c in spread.graph_of(r["tile"], bytes(r["graph"]), 16)] for r in t.collect()} for t in (packed, spread.tiles(configuration.counted(own)))]
    assert graphs[0] == graphs[1] and set(graphs[0]) == {0, 1, 2, 3}
    exchanged = own.mapInArrow(lambda batches: spread._dealt_pairs(batches, 16), "tile long, data binary").count()
    assert exchanged <= 4 * 3 * 2


def test_links_in_blocks_equal_links_by_rows_of_paths(spark, monkeypatch):
    from ontoloom.operators import links, spread

    for name, n in (("KEYS", 4), ("UNIT", 2), ("TILE", 8)):
        monkeypatch.setattr(spread, name, n)
    rng = random.Random(6)
    own = spark.createDataFrame([(rng.sample(range(40), rng.randrange(5)),) for _ in range(60)], "own array<int>")
    table = lambda pairs, kind: spark.createDataFrame([(*k, rng.random()) for k in pairs], kind)
    edge = "src int, dst int, score double"
    left = table({(rng.randrange(20), rng.randrange(20)) for _ in range(30)}, edge).where("src <> dst")
    both = table({(rng.choice([None, *range(20)]), rng.choice([None, *range(45)])) for _ in range(60)}, edge)
    lw, rw = table([(i,) for i in range(1, 20)], "id int, weight double"), table([(i,) for i in range(2, 45)], "id int, weight double")
    edges = configuration.counted(own)
    columns = ["src", "dst", "jaccard_000", "jaccard_100", "jaccard_010", "jaccard_110"]
    for least in (0.001, 0.05):
        want = links.jaccard(lw, rw, left, both, edges.union(edges.select("dst", "src", "score")), least).select(columns)
        got = links.jaccard_in_blocks(lw, rw, left, both, own, least)
        assert got.columns == columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
        assert "Join" not in str(got._jdf.queryExecution().optimizedPlan()).split("MapInArrow")[0]
        rows = [{(r[0], r[1]): tuple(r[2:]) for r in x.collect()} for x in (got, want)]
        assert set(rows[0]) == set(rows[1]) and len(rows[1]) > 20
        assert all(rows[0][k] == pytest.approx(rows[1][k]) for k in rows[1])
    every = links.jaccard_in_blocks(lw, rw, left, both, own, 0.0)
    assert every.count() == links.jaccard(lw, rw, left, both, edges.union(edges.select("dst", "src", "score")), 0.0).count()


def test_spread_scores_stay_in_blocks(spark, monkeypatch):
    from ontoloom.operators import spread

    monkeypatch.setattr(spread, "KEYS", 3)
    monkeypatch.setattr(spread, "TILE", 7)
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), rng.random()) for _ in range(150)], "src long, dst long, score double")
    x = spark.createDataFrame([(rng.randrange(-4, 10), rng.randrange(60), 0.01 ** rng.random()) for _ in range(60)], "s long, concept long, score double")
    y = spark.createDataFrame([(rng.choice("abc"), rng.randrange(45), rng.random()) for _ in range(60)], "u string, concept long, score double")
    got = spread.measured(x, "s", y, "u", edges).collect()
    m = configuration.mixed(x, graph.normalised(edges))
    norms = {r["s"]: r["norm"] for r in configuration.norms(m).collect()}
    dots = m.withColumnRenamed("score", "v").join(y, "concept").groupBy("s", "u").agg(F.sum(F.col("v") * F.col("score")).alias("d")).collect()
    assert {r["s"]: r["norm"] for r in got if r["norm"] is not None} == pytest.approx(norms)
    assert {(r["s"], r["u"]): r["dot"] for r in got if r["dot"] is not None} == pytest.approx({(r["s"], r["u"]): r["d"] for r in dots})
    assert len(norms) > 6 and len(dots) > 6


def test_graph_is_not_sent_to_every_block_of_keys(spark, monkeypatch):
    from ontoloom.operators import spread

    rng = random.Random(8)
    own = spark.createDataFrame([(rng.sample(range(3000), 4),) for _ in range(6000)], "own array<long>")
    x = spark.createDataFrame([(s, c, 0.5) for s in range(64) for c in rng.sample(range(3000), 40)], "s long, concept long, score double")
    y = spark.createDataFrame([(c % 3, c, 1.0) for c in range(3000)], "u int, concept long, score double")
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    monkeypatch.setattr(spread, "UNIT", 4)
    written, rows = [], []
    for keys in (64, 4):
        monkeypatch.setattr(spread, "KEYS", keys)
        before = sent()
        rows.append({(r["s"], r["u"]): r["norm"] if r["u"] is None else r["dot"] for r in spread.measured(x, "s", y, "u", own).collect()})
        written.append(sent() - before)
    assert len(rows[0]) == 64 * 4 and rows[1] == pytest.approx(rows[0])
    assert written[1] < 2 * written[0]  # sixteen blocks of keys instead of one reach all of the graph


def test_links_by_tiles_of_few_nodes_equal_links_by_rows_of_paths(spark, monkeypatch):
    from ontoloom.operators import links, spread

    for module, name, n in ((spread, "KEYS", 4), (spread, "UNIT", 2), (spread, "TILE", 8), (links, "WIDTH", 8), (links, "RANGE", 4), (spread, "CELLS", 16)):
        monkeypatch.setattr(module, name, n, raising=False)
    rng = random.Random(9)
    own = spark.createDataFrame([(rng.sample(range(40), rng.randrange(5)),) for _ in range(60)], "own array<long>")
    table = lambda pairs: spark.createDataFrame([(*k, rng.random()) for k in pairs], "src long, dst long, score double")
    left, both = table({(a, b) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(40)) if a != b}), table({(rng.randrange(20), rng.randrange(45)) for _ in range(90)})
    lw, rw = (spark.createDataFrame([(i, rng.random()) for i in range(1, n)], "id long, weight double") for n in (20, 45))
    edges = configuration.counted(own)
    for least in (0.001, 0.02, 0.05):
        want = links.jaccard(lw, rw, left, both, edges.union(edges.select("dst", "src", "score")), least)
        want = {(r["src"], r["dst"]): r["jaccard_110"] for r in want.collect()}
        got = links.jaccard_in_blocks(lw, rw, left, both, own, least).collect()
        assert {(r["src"], r["dst"]): r["jaccard_110"] for r in got} == pytest.approx(want) and len(got) == len(want) > 2


def test_graph_is_not_sent_to_every_block_of_left_nodes(spark, monkeypatch):
    from ontoloom.operators import links, spread

    rng = random.Random(10)
    own = spark.createDataFrame([(rng.sample(range(3000), 4),) for _ in range(6000)], "own array<long>")
    both = spark.createDataFrame([(s, c, 0.5) for s in range(64) for c in rng.sample(range(3000), 40)], "src long, dst long, score double")
    left = spark.createDataFrame([(s, (s + k) % 64, 0.5) for s in range(64) for k in (1, 2)], "src long, dst long, score double")
    lw, rw = spark.range(64).selectExpr("id", "0.9D weight"), spark.range(3000).selectExpr("id", "0.7D weight")
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    monkeypatch.setattr(spread, "UNIT", 4)
    written, rows = [], []
    for keys in (64, 4):
        monkeypatch.setattr(spread, "KEYS", keys)
        before = sent()
        rows.append({(r["src"], r["dst"]): r["jaccard_110"] for r in links.jaccard_in_blocks(lw, rw, left, both, own, 0.001).collect()})
        written.append(sent() - before)
    assert len(rows[0]) > 100 and rows[1] == pytest.approx(rows[0])
    assert written[1] < 2 * written[0]
