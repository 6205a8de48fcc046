"""The stages of the corpus pipeline, one after the other and on awkward documents."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoloom.llm import shingles
from ontoloom.llm._shared import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, FOLDER, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, at, FOLDER).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= at.count(), name
        at = after
    packed = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER)
    whole = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(packed) == key(whole)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_awkward_documents(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3), (3, "a b " * 5000, "en", "s", 20000), (3, "a b " * 5000, "en", "s", 20000)]
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, FOLDER)
    if name != "packing":
        assert got.columns == docs.columns and got.count() <= docs.count()
    else:
        assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, None}
    assert stage(spark, docs.where("false"), FOLDER).count() == 0
    extra = docs.withColumn("n_words", F.lit(1)).withColumn("score", F.lit("x"))
    assert stage(spark, extra, FOLDER).count() >= 0


@pytest.mark.parametrize("part", [1 << 22, 700])
def test_near_duplicates_of_five_words_and_four_fifths(spark, monkeypatch, part):
    """The stage keeps what brute force over the sets of shingles keeps, among groups of edited copies."""
    monkeypatch.setattr(shingles, "PART", part)
    rng, rows = random.Random(4), []
    for k in range(40):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((60, 150, 400)))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words), "en", "s", 0))
            for at in rng.sample(range(len(words)), len(words) // 60):
                words[at] = f"x{rng.randrange(900)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()}
    assert got == set(root) and 40 <= len(got) < len(rows)


def test_similar_links_connect_all():
    sets = [shingles.shingles(" ".join(f"w{k}" for k in range(n, n + 100))) for n in (0, 500, 9, 18, 509, 900)]
    assert sorted(tuple(sorted(x)) for x in shingles.similar_links(sets)) == [(0, 2), (1, 4), (2, 3)]


def test_crossing_links_are_all_pairs():
    rng = random.Random(5)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64) for _ in range(120)]
    some = sets[::3]
    want = {(i, j) for i, a in enumerate(some) for j, b in enumerate(sets) if len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b))}
    assert set(shingles.crossing_links(some, sets, 0.5)) == want and len(want) > len(some)


def test_near_duplicates_without_ids_or_words(spark):
    rows = [(3, "a b c d e f"), (None, "a b c d e f"), (5, None), (4, ""), (None, None), (9, "x"), (9, "x"), (None, "lone y")]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(3, 3), (None, 3), (5, 4), (4, 4), (None, 4), (9, 9), (9, 9), (None, None)])


def test_promising_rows():
    rng = np.random.default_rng(6)
    bucket = np.repeat([3, 5, 6, 9], [1, 2, 7, 40])
    sketches = rng.integers(0, 256, (50, shingles.SKETCH)).astype(np.uint8)
    for a, b, n in ((1, 2, 29), (3, 8, 30), (4, 9, 60), (12, 49, 45), (9, 10, 60)):
        sketches[b, :n] = sketches[a, :n]
    agree = lambda i, j: bucket[i] == bucket[j] and (sketches[i] == sketches[j]).sum() >= shingles.AGREE
    want = [any(agree(i, j) for j in range(50) if j != i) for i in range(50)]
    assert shingles.promising(bucket, sketches).tolist() == want and 3 in np.flatnonzero(want)
    rows = pa.table({"n": np.bincount(bucket)[bucket], "key": np.arange(50), "size": np.ones(50, int), "turn": np.zeros(50, int), "band": bucket, "sketch": [x.tobytes() for x in sketches]})
    for size in (1, 3, 50):
        got = [k for b in shingles._promising(iter(rows.to_batches(max_chunksize=size))) for k in b["key"].to_pylist()]
        assert got == np.flatnonzero(want).tolist()
    assert shingles.promising(bucket[:0], sketches[:0]).tolist() == [] and list(shingles._promising(iter([]))) == []


def test_run_by_hand(spark):
    """All stages in plain Python, but for what the models learn: what run() packs are their documents."""
    import numpy as np
    import public_tokenizers
    import tokenizers
    from test_llm import check_packing, quality_by_hand, toxicity_by_hand

    from ontoloom.llm import quality, toxicity
    from ontoloom.llm._shared import split_of

    docs, labels = (table(spark, FOLDER, n) for n in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    bad = toxicity.fit(docs, labels, split_of(F.col("doc_id"), 5) != 0)
    rows = [r for r in rows if bad.score(np.array([toxicity_by_hand(r[1], bad.lexicon)]))[0] < 0.5]
    good = quality.fit(docs, labels, split_of(F.col("doc_id"), 4) != 2)
    rows = [r for r in rows if good.score(np.array([quality_by_hand(r[1])]))[0] >= 0.7]
    low = [[w for w in "".join(c.lower() if c.isascii() else c for c in t).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w] for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in low]
    root = [d for d, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                least, most = sorted((root[a], root[b]))
                root = [least if r == most else r for r in root]
    rows = [r for r, k in zip(rows, root) if r[0] == k]
    words = {d: [w for w in t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w] for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
    kept = []
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(13)}
        kept.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert 50 < len(kept) < docs.count() and any(len(words[d]) > len(t.split()) for d, t in kept)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(corpus_pipeline.run(spark, FOLDER).collect(), kept, tokenizer)


def test_simhash_tree_gives_candidates(spark):
    rows = [(1, 9, 0), (2, 9, 0b1011), (3, 9, -1), (4, 9, -1), (5, 9, 0x0F0F0F0F0F0F0F0F)]
    near = shingles._near(spark.createDataFrame(rows, "key long, size long, fp long")).collect()
    found = {}
    for r in near:
        found.setdefault(r["band"], set()).add(r["key"])
    assert sorted(map(sorted, found.values())) == [[1, 2], [3, 4]]
