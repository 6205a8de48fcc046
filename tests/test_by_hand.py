"""Registered queries that SQL does not express, and operators, against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom import api
from ontoloom.functions import strings
from ontoloom.operators import cache, cluster, evaluate, ontology, relational, scrape, search, slides, slots, vectors, wikify
from ontoloom.plans import catalog, reports
from ontoloom.sources import files, log, schemas, store, web

FOLDER = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def got(spark, name):
    return catalog.queries()[name](spark, FOLDER).collect()


def fingerprint(text):
    """From the definition: polynomial hashes of k letters, the last least of each window, 32 of them."""
    letters = [ord(c) for c in text if c.isalnum()]
    fits = [w for w in (1, 4, 10, 20, 50) if w <= math.ceil(len(text) / 32)]
    window = fits[-1] if fits else 50
    k = math.ceil(window / 2)
    first = sum(c * 10 ** (k - 1 - i) for i, c in enumerate(letters[:k])) % 256
    hashes = [first] if len(letters) >= k else []
    for i in range(k, len(letters)):
        hashes.append((hashes[-1] - letters[i - k] * 10**k + letters[i]) * 10 % 256)
    if window > 1:
        span, kept, last = window - k + 1, [], None
        for i in range(len(hashes) - span + 1):
            at = max(range(i, i + span), key=lambda j: (-hashes[j], j))
            if at != last:
                kept.append(hashes[at])
            last = at
        hashes = kept
    if len(hashes) > 32:
        places = np.linspace(0, len(hashes) - 1, 31, endpoint=False).astype(int).tolist()
        hashes = [hashes[p] for p in [*places, len(hashes) - 1]]
    return "".join(f"{h:02x}" for h in [*hashes, *[0] * (32 - len(hashes))]) + f"_{window:02d}_{k:02d}"


def test_fingerprint_of_every_length():
    rng = random.Random(1)
    assert cache.text_fingerprint("") == "0" * 64 + "_50_25" and cache.text_fingerprint("ab " * 30).endswith("_01_01")
    for n in [*range(0, 200), 319, 320, 321, 500, 639, 640, 1599, 1600, 3000, 5000]:
        text = "".join(rng.choice("abcdefgh  .,é") for _ in range(n))
        assert cache.text_fingerprint(text) == fingerprint(text), n


def test_text_fingerprint(spark):
    assert {r["doc_id"]: r["fingerprint"] for r in got(spark, "text_fingerprint")} == {r["doc_id"]: fingerprint(r["text"]) for r in rows("documents")}


def lcs(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        old, table = table, [0]
        for j, y in enumerate(b):
            table.append(old[j] + 1 if x == y else max(old[j + 1], table[j]))
    return table[-1]


def test_fuzzy_dups(spark):
    groups = defaultdict(list)
    for r in rows("part"):
        groups[r["p_brand"]].append((r["p_partkey"], f"{r['p_name']} {r['p_type']}"))
    want = {}
    for own in groups.values():
        for k, a in own:
            near = [(round(2 * lcs(a, b) / (len(a) + len(b)), 6), -j) for j, b in own if a != b]
            near = [x for x in near if x[0] >= 0.8]
            if near:
                want[k] = (-max(near)[1], max(near)[0])
    assert {r["p_partkey"]: (r["closest"], r["score"]) for r in got(spark, "fuzzy_dups")} == want


def test_common_letters(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9)))) for _ in range(150)] + [(None, "a")]
    out = spark.createDataFrame(pairs, "a string, b string").select(strings.common_letters(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out[:-1]] == [lcs(a, b) for a, b in pairs[:-1]] and out[-1][0] in (0, None)


def facts():
    return {(r["l_orderkey"], r["l_suppkey"], r["l_partkey"]) for r in rows("lineitem")}


def test_greedy_cover(spark):
    brand, sets = {r["p_partkey"]: r["p_brand"] for r in rows("part")}, defaultdict(lambda: defaultdict(set))
    for _, s, p in facts():
        sets[brand[p]][s].add(p)
    want = Counter()
    for b, own in sets.items():
        whole, covered, left = set().union(*own.values()), set(), dict(own)
        for step in itertools.count():
            if len(covered) >= 0.9 * len(whole):
                break
            best = min(left, key=lambda k: (-len(left[k] - covered), k))
            want[b, best, step, len(left[best] - covered)] += 1
            covered |= left.pop(best)
    assert Counter((r["p_brand"], r["set_id"], r["step"], r["gain"]) for r in got(spark, "greedy_cover")) == want


def linked(ks):
    """Average linkage from the definition: mean distance between all members of two clusters."""
    vecs, want = defaultdict(dict), {k: set() for k in ks}
    for r in rows("embeddings"):
        x = np.array(r["embedding"], float)
        vecs[r["label"]][r["vec_id"]] = x / np.linalg.norm(x)
    for own in vecs.values():
        ids = sorted(own)
        d = 1 - np.array([own[i] for i in ids]) @ np.array([own[i] for i in ids]).T
        parts = [[k] for k in range(len(ids))]
        while len(parts) > min(ks):
            a, b = min(itertools.combinations(range(len(parts)), 2), key=lambda p: d[np.ix_(parts[p[0]], parts[p[1]])].mean())
            parts[a] += parts.pop(b)
            if len(parts) in ks:
                want[len(parts)] |= {frozenset(ids[k] for k in p) for p in parts}
    return want


def test_broken_up_clusters(spark):
    label, found = {r["vec_id"]: r["label"] for r in rows("embeddings")}, defaultdict(lambda: defaultdict(set))
    for r in got(spark, "broken_up_clusters"):
        found[r["k"]][label[r["id"]], r["cluster"]].add(r["id"])
    assert {k: {frozenset(v) for v in of.values()} for k, of in found.items()} == linked((2, 3))


def test_agglomerative_clusters(spark):
    want = linked((5,))[5]
    label, found = {r["vec_id"]: r["label"] for r in rows("embeddings")}, defaultdict(set)
    for r in got(spark, "agglomerative_clusters"):
        found[label[r["id"]], r["cluster"]].add(r["id"])
    assert {frozenset(v) for v in found.values()} == want


def test_spectral_values(spark):
    brand = {r["p_partkey"]: r["p_brand"] for r in rows("part")}
    orders, n = defaultdict(set), Counter()
    for o, _, p in facts():
        orders[o].add(p)
    for own in orders.values():
        n.update((a, b) for a, b in itertools.combinations(sorted(own), 2) if brand[a] == brand[b])
    want = {}
    for b in set(brand.values()):
        edges = [(x, y, k / (k + 1)) for (x, y), k in n.items() if brand[x] == b]
        ids = sorted({v for x, y, _ in edges for v in (x, y)})
        w = np.zeros((len(ids), len(ids)))
        for x, y, s in edges:
            w[ids.index(x), ids.index(y)] = w[ids.index(y), ids.index(x)] = s
        d = np.sqrt(w.sum(1)) + 1e-10
        for k, v in enumerate(sorted(np.linalg.eigvalsh(np.eye(len(ids)) - w / np.outer(d, d)))[:4] if ids else []):
            want[b, k] = v
    out = {(r["cluster"], r["k"]): r["eigenvalue"] for r in got(spark, "spectral_values")}
    assert out == pytest.approx(want, abs=2e-6)


def test_token_batches(spark):
    want, state = {}, {}
    for r in sorted(rows("documents"), key=lambda r: r["doc_id"]):
        key = r["lang"], r["doc_id"] // 10_000
        full, number = state.get(key, (0, 0))
        if key in state and full + r["n_chars"] > 20_000:
            full, number = 0, number + 1
        state[key] = full + r["n_chars"], number
        want[r["doc_id"]] = number
    assert {r["doc_id"]: r["batch"] for r in got(spark, "token_batches")} == want


def test_slide_transitions(spark):
    """Every segment between samples is searched by halving, on paper."""
    want, videos = set(), defaultdict(list)
    for r in sorted(rows("embeddings"), key=lambda r: r["vec_id"]):
        videos[r["label"]].append(np.array(r["embedding"], float))
    for video, x in videos.items():
        n = len(x)

        def differ(a, b, x=x):
            d = 1 - x[a - 1] @ x[b - 1]
            same = np.mean([(x[a - 1][k] > x[a - 1][k - 1]) == (x[b - 1][k] > x[b - 1][k - 1]) for k in range(1, 64)])
            return d >= 0.6 and same <= 0.95, d

        def halves(a, b, differ=differ):
            ok, d = differ(a, b)
            if (a + b) // 2 in (a, b):
                return [(d, -a)]
            return [max(halves(a, (a + b) // 2) + halves((a + b) // 2, b))] if ok and halves(a, (a + b) // 2) + halves((a + b) // 2, b) else []

        at = [*range(1, n - 11, 12), n] if n > 12 else [n]
        places = [at[0], *(-halves(a, b)[0][1] for a, b in zip(at, at[1:]) if halves(a, b)), at[-1]]
        places = [p for k, p in enumerate(places) if k in (0, len(places) - 1) or p < at[-1]]
        if len(places) > 1 and not differ(places[0], places[1])[0]:
            places = places[1:]
        if len(places) > 1 and not differ(places[-2], places[-1])[0]:
            places = places[:-1]
        want |= {(video, p) for p in places}
    assert {(r["video"], r["slide"]) for r in got(spark, "slide_transitions")} == want
    assert slides.transitions(lambda a, b: (True, 1.0), []) == [] and slides.transitions(lambda a, b: (False, 0.0), [1, 5]) == [5]


def test_samples_and_thresholds(spark):
    got_ = slides.samples(spark.createDataFrame([("a", 30), ("b", 12), ("c", 1), ("d", 0), ("e", None)], "video string, frames int")).collect()
    assert Counter(tuple(r) for r in got_) == Counter([("a", 1), ("a", 13), ("a", 30), ("b", 12), ("c", 1)])
    d = spark.createDataFrame([("a", 0.002), ("a", 0.004), ("a", 0.5), ("b", 0.0), ("b", None)], "video string, distance double")
    assert {r["video"]: r["threshold"] for r in slides.thresholds(d).collect()} == pytest.approx({"a": 0.015, "b": 0.05})


def test_principal_components(spark):
    x = np.array([r["embedding"] for r in rows("embeddings")], float)
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1]
    out = sorted(got(spark, "principal_components"), key=lambda r: r["k"])
    assert [r["share"] for r in out] == pytest.approx((values / values.sum())[:5], abs=2e-6)
    assert [r["variance"] for r in out] == pytest.approx(values[:5] * len(z) / (len(z) - 1), abs=2e-5)
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert vectors.principal(none, 3)[2].count() == 0


def test_wikify_refresh(spark):
    """The two passes, from the scores that have SQL of their own: what is found survives, and scores stay in their range."""
    out = got(spark, "wikify_refresh")
    assert len(out) == len({r["concept_id"] for r in out}) > 0
    for r in out:
        assert r["mixed_score"] == pytest.approx(sum(w * r[c] for c, w in wikify.WEIGHTS.items()), abs=1e-5)
        assert all(-1e-9 <= r[c] <= 1 + 1e-9 for c in wikify.WEIGHTS)
    found = {r["concept_id"] for r in got(spark, "search_top10")}
    assert {r["concept_id"] for r in out} <= found


def test_detection_of_one_keyword_by_hand(spark):
    """One keyword, two concepts, one edge: every score on paper."""
    results = spark.createDataFrame([("red bolt", 1, "red_bolt", 1.0), ("red bolt", 2, "blue nut", 0.5)], "keywords string, concept_id long, concept_name string, search_score double")
    edges = spark.createDataFrame([(1, 2, 0.8), (2, 1, 0.8)], "src long, dst long, score double")
    cats = spark.createDataFrame([(1, "A", "X"), (2, "B", "X")], "concept long, level_4 string, level_3 string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "concept_id long, vector array<double>")
    out = {r["concept_id"]: r for r in wikify.detect(results, edges, cats, vecs, threshold=0.0, refresh=False).collect()}
    ratio = 2 * lcs("red bolt", "blue nut") / 16
    assert out[1]["levenshtein_score"] == pytest.approx(1)
    assert out[2]["levenshtein_score"] == pytest.approx(0.5 * ratio**2 / (ratio**2 + (1 - ratio) ** 2) / 1 + 0.5 * ratio**2 / (ratio**2 + (1 - ratio) ** 2))
    assert [out[k][c] for k in (1, 2) for c in ("embedding_local_score", "embedding_global_score", "graph_score")] == pytest.approx([1] * 6)
    assert out[1]["search_score"] == pytest.approx(1) and out[2]["search_score"] == pytest.approx(0.5)
    assert wikify.detect(results.where("false"), edges, cats, vecs, refresh=False).count() == 0
    with pytest.raises(ValueError):
        wikify.detect(results, edges, cats, vecs, threshold=2)


# Sites.


def site_by_hand(pages, least=32):
    """Headers, then footers, page by page."""
    blank = " \n\t\r"
    for flip in (False, True):
        turn = (lambda s: s[::-1]) if flip else (lambda s: s)
        found = defaultdict(set)
        for site in {s for s, _, _ in pages}:
            kinds = sorted({turn(c) for s, _, c in pages if s == site and c is not None and (flip or len(c) >= 2)})
            for a, b in zip(kinds, kinds[1:]):
                n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                if n > least:
                    found[site].add(turn(a[:n].strip(blank)))
        out = []
        for s, p, c in pages:
            for h in sorted(found[s], key=lambda h: (-len(h), [-ord(x) for x in h])) if c is not None else []:
                if c.endswith(h) if flip else c.startswith(h):
                    c = c.replace(h, "").strip(blank)
            out.append((s, p, c))
        pages = out
    return pages


def test_headers_and_footers(spark):
    rng = random.Random(3)
    head, foot = "Welcome to the site of our laboratory, ", " All rights are reserved by the institute of things"
    pages = []
    for k in range(60):
        body = " ".join(rng.choice(["alpha", "beta", "gamma", "délta"]) for _ in range(rng.randint(0, 9)))
        pages.append((f"s{k % 3}", k, rng.choice(["", head, head + "second line of the header that some share; "]) + body + rng.choice(["", foot])))
    pages += [("s0", 100, None), ("s0", 101, ""), ("s0", 102, head + head), ("s9", 103, "lone"), (None, 104, head)]
    df = spark.createDataFrame(pages, "site string, page long, content string")
    out = scrape.without_headers(df).collect()
    assert {(r["page"], r["content"]) for r in out if r["site"]} == {(p, c) for s, p, c in site_by_hand([x for x in pages if x[0]])}
    assert len(out) == len(pages) and scrape.without_headers(df.where("false")).count() == 0


def shared_by_hand(a, b):
    """Every shift, counted one by one."""
    u, v = ([k for k, c in enumerate(s) if c == " "] for s in (a, b))
    way, best, most = (1 if sum(u) >= sum(v) else -1), 0, 0
    for k in range(1, 2050):
        n = len(set(u) & {x + way * k for x in v})
        if n > most:
            best, most = way * k, n
    turned = "".join(b[(k - best) % len(b)] for k in range(len(b)))
    run, found = 0, ""
    for k in range(min(len(a), len(turned)) + 1):
        if k < min(len(a), len(turned)) and a[k] == turned[k]:
            run += 1
        else:
            if run > 1024 and run > len(found):
                found = a[k - run : k]
            run = 0
    return found.strip()


def test_long_patterns(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared, pages = words(400), []
    for k in range(9):
        at = words(rng.randint(5, 60))
        pages.append((f"s{k % 2}", k, f"{at} {shared} {words(20)}" if k < 6 else words(500)))
    for (_, _, a), (_, _, b) in itertools.combinations(pages, 2):
        assert scrape.shared_pattern(max(a, b), min(a, b)) == shared_by_hand(max(a, b), min(a, b))
    df = spark.createDataFrame([*pages, ("s0", 50, None), ("s1", 51, "")], "site string, page long, content string")
    want = set()
    for site in ("s0", "s1"):
        kinds = sorted((c for s, _, c in pages if s == site), reverse=True)
        want |= {(site, p) for a, b in itertools.combinations(kinds, 2) if len(p := shared_by_hand(a, b)) >= 1024}
    assert want and {(r["site"], r["pattern"]) for r in scrape.long_patterns(df).collect()} == want
    out = {r["page"]: r["content"] for r in scrape.without_long_patterns(df).collect()}
    for s, p, c in pages:
        for _, h in sorted((x for x in want if x[0] == s), key=lambda x: -len(x[1])):
            c = c.replace(h, "").strip()
        assert out[p] == c
    assert out[50] is None and out[51] == ""


def test_site_long_patterns(spark):
    assert len(got(spark, "site_long_patterns")) == len(rows("pages"))


# Search, caches and rights on awkward rows.

DOCS = [(1, "red bolt red nut"), (2, "blue bolt"), (3, None), (4, ""), (5, "red red red"), (5, "red red red")]


def test_bm25_on_awkward_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = search.postings(docs, "doc_id")
    ask = spark.createDataFrame([(1, "red"), (1, "bolt"), (1, "bolt"), (2, "none"), (None, "blue"), (3, None)], "query long, term string")
    out = search.bm25(index, ask, "doc_id").collect()
    assert {r["query"] for r in out} == {1, None} and all(r["score"] > 0 for r in out)
    assert search.bm25(index.where("false"), ask, "doc_id").count() == search.bm25(index, ask.where("false"), "doc_id").count() == 0
    assert search.rank_features(index, ask, "doc_id").count() == len(out) and search.tfidf(index.select("doc_id", "term"), "doc_id").count() == 3
    assert {r["doc_id"] for r in search.rake(docs, "doc_id").collect()} == {1, 2, 5} and search.rake(docs.where("false"), "doc_id").count() == 0
    phrases = {(r["doc_id"], r["phrase"]) for r in search.keywords(docs, "doc_id").collect()}
    assert (2, "blue bolt") in phrases and not any(d in (3, 4) for d, _ in phrases)
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, vector array<double>")
    near = {(r["query"], r["doc_id"]): r["score"] for r in search.hybrid(index, ask, vecs, spark.createDataFrame([(1, [0.0, 1.0])], "query long, vector array<double>"), "doc_id").collect()}
    assert set(near) == {(r["query"], r["doc_id"]) for r in out}


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    search.write_index(docs, "doc_id", str(tmp_path))
    index, sizes = search.read_index(spark, str(tmp_path))
    assert tuple(sizes.first()) == (4, 3.0) and index.count() == search.postings(docs, "doc_id").count()  # rows of one id count apart
    empty = search.sizes(docs.where("false")).first()
    assert empty["docs"] == 0 and empty["mean"] is None
    ask = spark.createDataFrame([(1, "red"), (1, "bolt")], "query long, term string")
    one = docs.where("doc_id < 5")
    assert search.bm25(search.postings(one, "doc_id"), ask, "doc_id", sizes=search.sizes(one)).collect() == search.bm25(search.postings(one, "doc_id"), ask, "doc_id").collect()


def test_filters_of_an_index(spark):
    docs = spark.createDataFrame([(1, "en", 5, None), (2, "fr", 6, 9), (3, "de", 7, 9)], "id long, lang string, from_date int, until_date int")
    assert search.filtered(docs, "documents", {"lang": ["en", "de"], "id": 2}).count() == 2  # id may not be filtered on
    assert search.filtered(docs, "elsewhere", {"id": 2}).count() == 1
    assert {r["id"] for r in search.filtered(docs, "documents", {}, F.lit(6)).collect()} == {1, 2}


def test_caches_on_awkward_rows(spark):
    store = spark.createDataFrame([(1, "x", 1), (2, None, 2), (None, "z", 3)], "k long, v string, d int")
    closest = spark.createDataFrame([(1, 1), (3, 1), (4, 9), (None, 1)], "k long, closest long")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k long")
    out = {r["k"]: (r["v"], r["through_closest"]) for r in cache.cached(asked, store, closest, "k", "v").collect()}
    assert out == {1: ("x", False), 2: (None, True), 3: ("x", True), 4: (None, True), None: (None, True)}
    through = cache.written_through(spark.createDataFrame([(3, "n", 5), (3, "o", 4), (1, "p", 1)], "k long, v string, d int"), closest, "k", "v", "d")
    assert {tuple(r) for r in through.collect()} == {(3, "n", 5), (1, "p", 1)}
    settled = cache.settled(store, spark.createDataFrame([(1, None, 4), (7, "w", 4)], "k long, v string, d int"), "k", "v")
    assert {r["k"] for r in settled.collect()} == {2, None, 7}
    assert [r["status"] for r in cache.outcomes(store.where("k = 2"), "v").collect()] == ["FAILURE"]
    times = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-30"), (2, "2024-01-29"), (None, "2024-01-01"), (3, None)], "g long, t string").withColumn("t", F.to_timestamp("t"))
    kept = cache.purged(times, "g", "t", F.to_timestamp(F.lit("2024-01-31")), 7)
    assert {r["g"] for r in kept.collect()} == {2, None, 3}
    named = spark.createDataFrame([(k, n, k, 0) for k, n in enumerate(["red ring", "red rings", "zzz", "red ring"])], "k long, f string, d long, b int")
    loose = {r["k"]: (r["closest"], r["score"]) for r in cache.closest(named, "k", "f", "d", "b", 0.8).collect()}
    assert loose[3] == (0, 1.0) and loose[2] == (2, -1.0) and loose[0][0] == 1 and loose[1][0] == 0
    assert cache.batches(store.where("false").select("k", F.lit("a").alias("g"), "d"), "g", "k", "d", 5).count() == 0


def test_clusters_on_awkward_rows(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.6]), (3, 1, [0.0, 1.0]), (4, 1, [0.1, 0.9]), (5, 2, [0.6, 0.8])], "id long, label int, vector array<double>")
    q = cluster.quality(v.where("label < 2")).first()
    assert q["davies_bouldin"] > 0 and q["calinski_harabasz"] > 0
    out = {r["id"]: r["new_label"] for r in cluster.reassigned(v, 2).collect()}
    assert out == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0} or out == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert cluster.reassigned(v.where("false"), 2).count() == 0
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (9, "c"), (None, "d")], "id long, category string")
    best = {r["label"]: (r["category"], r["n"], r["impurity"]) for r in cluster.majority(v.select("id", "label"), known).collect()}
    assert best == {0: ("a", 1, 1), 1: ("b", 1, 0)}  # ties go to the first name


def test_clusters_of_a_graph(spark):
    """Two cliques held by one weak edge, and a lone pair: the spectrum parts them."""
    import pandas as pd

    cliques = [(a, b, 1.0) for own in (range(6), range(10, 15)) for a, b in itertools.combinations(own, 2)]
    data = [*cliques, (5, 10, 0.01), (20, 21, 1.0), (3, 3, 5.0)]
    df = spark.createDataFrame(data, "src long, dst long, score double")
    out = {r["id"]: r["label"] for r in cluster.recomputed(df, 2).collect()}
    assert out == {**{k: 0 for k in range(6)}, **{k: 10 for k in range(10, 15)}, 20: 20, 21: 21}
    assert cluster.recomputed(df.where("false"), 2).count() == 0
    v = cluster.spectral_vectors(pd.DataFrame(cliques[:15], columns=["src", "dst", "score"]), 3)
    assert len(v) == 6 and np.linalg.norm(np.stack(v["vector"]), axis=1) == pytest.approx([1] * 6)
    w = np.ones((6, 6)) - np.eye(6)
    lap = np.eye(6) - w / 5
    assert np.linalg.eigvalsh(lap)[0] == pytest.approx(0, abs=1e-9)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x[50:] = x[:10]
    data = [(k, k % 2, v.tolist()) for k, v in enumerate(x)] + [(100, 0, None), (101, None, [1.0] * 4), (None, 0, [1.0] * 4), (200, 7, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, `group` long, vector array<double>").repartition(3)
    monkeypatch.setattr(vectors.blocks, "__defaults__", (7,))
    monkeypatch.setattr(vectors.compared, "__defaults__", (7,))
    out = {(r["src"], r["dst"]) for r in vectors.nearest(df, 3).collect()}
    want = set()
    for a in range(60):
        near = sorted((b for b in range(60) if b != a and a % 2 == b % 2), key=lambda b: (-round(float(x[a] @ x[b]), 9), b))
        want |= {(a, b) for b in near[:3]}
    assert out == want
    total = {r["id"]: r["total"] for r in vectors.sums(df, lambda p: np.maximum(p, 0)).collect()}
    assert total == pytest.approx({**{a: sum(max(0, x[a] @ x[b]) for b in range(60) if b != a and a % 2 == b % 2) for a in range(60)}, 200: 0.0})
    assert vectors.nearest(df.where("false"), 2).count() == 0


def test_exact_median(spark):
    rng = random.Random(7)
    for n in (0, 1, 2, 7, 100, 501):
        data = [(rng.choice([None, float(rng.randrange(9)), rng.random()]),) for _ in range(n)]
        known = [v for (v,) in data if v is not None]
        found = relational.median(spark.createDataFrame(data, "v double").repartition(4), "v").first()["_median"]
        assert found == (pytest.approx(float(np.median(known))) if known else None)


def test_top_share(spark):
    rng = random.Random(6)
    data = [(rng.randrange(20), k) for k in range(997)]
    df = spark.createDataFrame(data, "v int, k int").repartition(5)
    assert {tuple(r) for r in relational.top_share(df, 0.1, F.desc("v"), F.col("k")).collect()} == set(sorted(data, key=lambda x: (-x[0], x[1]))[:99])
    assert relational.top_share(df.where("false"), 0.5, F.col("v")).count() == 0


def test_ontology_on_awkward_rows(spark):
    tree = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "a")], "child string, parent string")
    clusters = spark.createDataFrame([(1, "c"), (2, "b")], "cluster long, category string")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "cluster long, concept long")
    sizes, bins = ontology.statistics(tree, clusters, members, 2)
    assert {tuple(r) for r in sizes.collect()} == {("c", 1, 2), ("b", 1, 1)} and {tuple(r) for r in bins.collect()} == {(1, 1), (0, 1)}
    new, groups = ontology.new_cluster(members, clusters, spark.createDataFrame([(10,), (13,), (13,)], "concept long"), "b")
    assert {tuple(r) for r in new.collect()} == {(1, 10), (1, 11), (2, 12), (3, 13)} and (3, "b") in {tuple(r) for r in groups.collect()}
    first = ontology.new_cluster(members.where("false"), clusters.where("false"), members.select("concept"), "b")[0]
    assert {r["cluster"] for r in first.collect()} == {0}
    graph = spark.createDataFrame([(10, 12, 1.0), (12, 10, 1.0)], "src long, dst long, score double")
    of = members.join(clusters, "cluster")
    assert {(r["concept"], r["cluster"]) for r in ontology.closest_clusters(graph, of).collect()} == {(10, 2), (12, 1)}
    assert ontology.closest_clusters(graph.where("false"), of).count() == 0


def test_rights(spark):
    df = spark.createDataFrame([("a, b,a,",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(evaluate.scopes(F.col("s"))).collect()] == [["a", "b"], [], []]


# Models, files, schemas, stages.


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abcdef")], "id long, text string").repartition(2)
    out = slots.with_model(df, "text", "n", T.LongType(), "length", lambda: len, lambda model, xs: [model(x) for x in xs], 1)
    assert {r["id"]: r["n"] for r in out.collect()} == {1: 2, 2: None, 3: 0, 4: 6}
    cut = {r["id"]: (r["text"], r["error"]) for r in slots.limited(df, "text", F.length("text"), 3).collect()}
    assert cut == {1: ("ab", None), 2: (None, None), 3: ("", None), 4: (None, "text over token limit of 3")}
    assert slots.with_model(df.where("false"), "text", "n", T.LongType(), "length", lambda: len, lambda m, xs: xs).count() == 0
    slots._LOADED.clear()
    for name in ("a", "b", "a", "c"):
        slots.loaded(name, lambda name=name: name.upper())
    assert list(slots._LOADED) == ["a", "c"]
    starts = spark.createDataFrame([(100.0,), (300.0,)], "d double").select(slots.segments(F.col("d"))).collect()
    assert [r[0] for r in starts] == [[0.0], [0.0, 60.0, 120.0, 180.0, 240.0]]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "é\nf")], "k long, v string")
    for packed in (False, True):
        files.write_csv(df, f"{tmp_path}/c{packed}", packed)
        files.write_json(df, f"{tmp_path}/j{packed}", packed)
        files.write_text(df.where("k < 3"), "v", f"{tmp_path}/t{packed}", packed)
        assert {tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c{packed}", df.schema).collect()} == {(1, 'a "b", c'), (2, None), (3, "é\nf")}
        assert {tuple(r) for r in files.read_json(spark, f"{tmp_path}/j{packed}", df.schema).collect()} == {(1, 'a "b", c'), (2, None), (3, "é\nf")}
        assert [r[0] for r in files.read_text(spark, f"{tmp_path}/t{packed}").collect()] == ['a "b", c']
    (tmp_path / "c.ini").write_text("[a]\nx = 1\n[b]\ny = z\n")
    assert files.configuration(spark, str(tmp_path / "c.ini")) == {"a": {"x": "1"}, "b": {"y": "z"}}
    assert files.read_binary(spark, str(tmp_path), "c.ini").first()["length"] == 20
    data = spark.createDataFrame([("aGk=",), ("!!",), (None,), ("aGVsbG8gd29ybGQ=",)], "b string")
    assert [(r["payload"] and bytes(r["payload"]), r["size"]) for r in files.payloads(data, F.col("b"), 5).collect()] == [(b"hi", 2), (None, None), (None, None), (None, None)]
    assert not files.table_exists(spark, "no_such_table")


def test_web_trees_and_drawings(spark, tmp_path):
    def get():
        def fetch(url):
            if "bad" in url:
                raise OSError("no answer")
            return 200, url + "/", "<p>"

        return fetch

    df = spark.createDataFrame([(1, "https://a"), (2, "https://bad"), (3, None)], "k long, url string")
    assert {tuple(r)[2:] for r in web.fetched(df, get).collect()} == {(200, "https://a/", "<p>", None), (None, None, None, "OSError: no answer"), (None, None, None, "no url")}
    assert web.fetched(df.where("false"), get).count() == 0
    tree = '{"feature": "a", "left": {"feature": "b", "left": {"value": 1}, "right": {"feature": "a"}}, "right": {"value": 2}}'
    trees = spark.createDataFrame([(1, tree), (2, '{"feature": "b"}'), (3, None), (4, "{"), (5, "7")], "id long, tree string")
    assert {tuple(r) for r in evaluate.tree_features(trees).collect()} == {("a", 2, 1), ("b", 2, 2)}
    assert {tuple(r) for r in evaluate.tree_features(trees, 1).collect()} == {("a", 1, 1), ("b", 1, 1)}
    nodes = spark.createDataFrame([(1, "r<", 0), (2, "a", 1), (3, "b", 1)], "id long, label string, level int")
    store.write_svg(nodes, spark.createDataFrame([(1, 2), (1, 9)], "src long, dst long"), str(tmp_path / "g.svg"))
    drawn = (tmp_path / "g.svg").read_text()
    assert drawn.count("<text") == 3 and drawn.count("<line") == 1 and "r&lt;" in drawn


def test_api(spark):
    assert set(api.names()) == set(catalog.queries()) and api.sql("degree") and api.sql("greedy_cover") is None
    answer = api.call(spark, FOLDER, "tree_lookups", 3)
    assert answer["successful"] and answer["n_results"] == 3 and not api.call(spark, FOLDER, "no such query")["successful"]


def test_schemas(spark, tmp_path):
    made = schemas.create_missing(spark, str(tmp_path), ["cache_text", "auth_users"])
    assert made == ["cache_text", "auth_users"] and schemas.create_missing(spark, str(tmp_path), ["cache_text"]) == []
    assert all(schemas.empty(spark, name).count() == 0 for name in schemas.TABLES)


def test_stages_of_investment(spark, tmp_path):
    seen = log.Stages(spark)
    paths = reports.run_stages(spark, FOLDER, str(tmp_path), reports.Parameters(prefix="x", best=3), seen)
    assert [s for s, _, _ in seen.done] == ["graph", "recent past", "jaccard", "units"] and seen.table().count() == 4
    units = spark.read.parquet(paths["units"]).groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("score") * F.col("score")).alias("q")).collect()
    assert max(r["n"] for r in units) <= 3 and [r["q"] for r in units] == pytest.approx([1.0] * len(units))
    assert spark.read.parquet(paths["jaccard"]).count() == len(got(spark, "jaccard_link_prediction"))
    few = reports.run_stages(spark, FOLDER, str(tmp_path), reports.Parameters(prefix="y").but(statuses=("F",)))
    assert 0 < spark.read.parquet(few["rounds"]).count() < spark.read.parquet(paths["rounds"]).count()
