"""The operators of the llm subpackage against plain Python, and on awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tokenizers
from pyspark.sql import functions as F

from ontoloom.llm import _blocks, _training, bpe, chat, matroska, ngrams, nndescent, packing, quality, recompression, simhash, toxicity
from ontoloom.llm._blocks import pack, unpack
from ontoloom.llm._graph import components
from ontoloom.llm._shared import table

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
SAME = "the same thirteen words in a row, more or less, to be found again here and there"
TEXTS = [
    None, "", "   \n\t ", "one", "Ünïcode 😀 texts\x1c\x85 and spaces", LONG, LONG, SAME, SAME, f"before {SAME} after", "a " * 400, "a " * 300,
    "<|endoftext|> special <|endoftext|>", "x" * 5000,
]
#: Rows with null and repeated ids, and columns whose names the operators use themselves.
ROWS = [(k if k != 4 else None, t, None if k % 3 else "en", "src", len(t or ""), k, "v", float(k)) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[7], ROWS[7], (None, SAME, None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, component_id string, score double"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def bag(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


# Automaton


def test_automaton_equals_tokenizers(tokenizer):
    own, rng = bpe.codec(PATH), random.Random(7)
    letters = "aeiou thnsrl  \n\t''..!!--==1234é😀中​\x1c\x1f\x85"
    texts = [t for t in TEXTS if t is not None]
    for k in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        texts.append(t * (k % 5 == 0) * 9 + t + "<|endoftext|>" * (k % 7 == 0) + rng.choice("ab -=*_.A") * (k % 11) * 20)
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_automaton_on_small_merges():
    """All words over two letters, against merging by priority."""
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab", 5: b"abab", 6: b"ba", 7: b"aaab"}
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (3, 3, 5), (1, 0, 6), (2, 3, 7)]
    m = bpe.MergeAutomaton(labels, merges)
    for n in range(1, 10):
        for bits in range(2**n):
            word = [bits >> k & 1 for k in range(n)]
            want = word[:]
            for u, v, w in merges:
                k = 0
                while k < len(want) - 1:
                    if (want[k], want[k + 1]) == (u, v):
                        want[k : k + 2] = [w]
                    k += 1
            assert m.encode(bytes(97 + x for x in word)) == want


def test_bpe_rows(spark, awkward, none):
    got = bpe.digest(bpe.encode_decode(awkward, PATH)).collect()
    want = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS)
    assert bag(got, "doc_id", "decoded_sha256") == want
    assert bpe.digest(bpe.encode_decode(none, PATH)).count() == 0


# SimHash


def linked(rows, radius=4):
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in out.items()}
    return Counter((d, f"{h:016x}", least[find(i)]) for i, (d, h) in enumerate(rows))


def test_simhash_equals_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect()]
    assert bag(simhash.near_duplicates(docs).collect(), "doc_id", "fingerprint", "component_id") == linked(rows)


def test_simhash_of_shards_in_parts(spark, monkeypatch):
    """Many shards, each in several parts of those that live there and of those that visit."""
    monkeypatch.setattr(simhash, "PER_SHARD", 150)
    monkeypatch.setattr(simhash, "PER_PART", 60)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    near = [b ^ np.uint64(1 << int(i) | 1 << int(j)) for b in base[:200] for i, j in rng.integers(0, 64, (3, 2))]
    points = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    got = [tuple(r) for r in simhash.links(df).collect()]
    rows = [(int(x), int(np.int64(x).view(np.uint64))) for x in points.view(np.int64)]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = linked(rows)
    assert Counter((d, f"{h:016x}", find(d)) for d, h in rows) == want and len({c for _, _, c in want}) > 100


def test_simhash_by_definition():
    import xxhash

    words = "The quick brown fox jumps over the lazy dog".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), seed=42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("The QUICK brown\tfox jumps \n over the lazy dog") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", seed=42)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = base[:800] ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64))
    ball = base[0] ^ np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, (900, 2))], np.uint64)
    points = np.unique(np.concatenate([base, near, ball]))
    tree = simhash.ShardTree(points[::3], 16, 4)
    assert tree.shards == 16
    links, homes = [], 0
    for _, lives, visits in tree.route(points):
        homes += len(lives)
        links.append(simhash.forest(lives, visits, 4))
    assert homes == len(points)
    a, b = (np.concatenate(x) for x in zip(*links))
    at = lambda x: np.searchsorted(points, x)
    from ontoloom.llm._graph import spanning_forest

    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points) <= 4, 1))
    roots = []
    for x, y in ((at(a), at(b)), (i, j)):
        root = np.arange(len(points))
        node, to = spanning_forest(x, y, len(points))
        root[node] = to
        roots.append(root.tolist())
    assert roots[0] == roots[1]


def test_simhash_awkward(spark, awkward, none):
    rows = [(r[0], simhash.fingerprint(r[1])) for r in ROWS]
    assert bag(simhash.near_duplicates(awkward).collect(), "doc_id", "fingerprint", "component_id") == linked(rows)
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, _, c in linked(rows) if d == c and d is not None})
    assert ids.count(None) == 2
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Language model


def test_backoff_scores(spark, awkward, none):
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r[1] or ""))) for r in ROWS]
    counts = [Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    total = sum(len(w) for _, w in texts)
    want = []
    for d, w in texts:
        own = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
        left = lambda *g: counts[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        s = 0.0
        for i in range(len(w)):
            most = min(i + 1, 3)
            for k in range(most, 0, -1):
                g = w[i - k + 1 : i + 1]
                if left(*g) > 0:
                    s += math.log(left(*g) / (left(*g[:-1]) if k > 1 else total - len(w))) + (most - k) * math.log(0.4)
                    break
            else:
                s += most * math.log(0.4) - math.log(total - len(w) + 1)
        want.append((d, len(w), s))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted((tuple(r) for r in ngrams.backoff_scores(awkward).collect()), key=key)
    want.sort(key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert ngrams.backoff_scores(none).count() == 0


def test_packed_arrays():
    rng = np.random.default_rng(2)
    for kind in (np.uint64, np.int64, np.uint32):
        for n in (0, 1, 7, 4000):
            x = rng.integers(0, 1 << 31, n).astype(kind)
            assert (unpack(pack(x), kind) == x).all()
            assert (unpack(pack(np.sort(x), True), kind, True) == np.sort(x)).all()


# Substrings


def without_repeats(rows, width=13):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - width + 1 if d is not None else 0):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, d), d)
    out = Counter()
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("size", [2000, 2 << 20])
def test_recompression_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(recompression, "BLOCK", size)
    docs = table(spark, FOLDER, "documents")
    got = recompression.digest(recompression.remove_repeats(docs)).collect()
    assert bag(got, *COLUMNS) == without_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_recompression_of_runs_and_few_words(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(200 + k, "a " * n) for k, n in enumerate((12, 13, 14, 40, 100, 41))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert bag(recompression.digest(recompression.remove_repeats(docs)).collect(), *COLUMNS) == without_repeats(rows)


def test_recompression_awkward(spark, awkward, none):
    out = recompression.remove_repeats(awkward)
    assert out.columns == [*awkward.columns, "n_words", "n_removed"]
    assert bag(recompression.digest(out).collect(), *COLUMNS) == without_repeats([r[:2] for r in ROWS])
    assert bag(out.collect(), "doc_id", "lang", "block", "component_id") == Counter((r[0], r[2], r[5], r[6]) for r in ROWS)
    assert recompression.remove_repeats(none).count() == 0


def thue_morse():
    """A word over a and b of 1,024 letters, and the one with all letters swapped: unlike, but alike to many hashes."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_only_hash_alike_stay_apart(spark):
    one, two = thue_morse()
    same = "the same twelve words stand before two words that are not one"
    docs = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}")], "doc_id long, text string")
    assert {r["n_removed"] for r in recompression.remove_repeats(docs).collect()} == {0}
    lone = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r["log_score"] for r in ngrams.backoff_scores(lone).collect()] == pytest.approx([math.log(0.4) - math.log(2)] * 2)


@pytest.mark.parametrize("alike", [False, True])
def test_recompression_if_all_hashes_are_alike(monkeypatch, alike):
    """The rounds, without Spark: hashes decide where keys meet, never which are equal."""
    if alike:
        monkeypatch.setattr(_blocks, "mix", np.zeros_like)
        monkeypatch.setattr(recompression, "mix", np.zeros_like)
    rng = random.Random(6)
    passages = [" ".join(rng.choice("abcd") + str(rng.randrange(40)) for _ in range(30)) for _ in range(3)]
    rows = [(k, " ".join(rng.choice([*passages, "x y", f"u{k}", "a a a a a a a"]) for _ in range(6))) for k in range(24)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in part], "text": [r[1] for r in part]}) for part in (rows[::3], rows[1::3], rows[2::3])]
    own, buckets, most = [recompression.Spelt(b, 13) for b in batches], 3, 0
    words = [_blocks.Words(b["text"]) for b in batches]

    def meet(sends, answer):
        parts = [b for s in sends for b in s]
        if not parts:
            return []
        sent_ = pa.Table.from_batches(parts)
        groups = [sent_.filter(pc.equal(sent_["bucket"], k)) for k in set(sent_["bucket"].to_pylist())]
        return [r for g in groups for r in answer(g).to_pylist()]

    for k in range(recompression.ROUNDS + 1):
        got = meet((b.send(i, buckets) for i, b in enumerate(own)), _blocks._met(k == 0, buckets, most))
        most = max([most, *(r["most"] for r in got)])
        own = [b.learn([r for r in got if r["block"] == i], buckets) for i, b in enumerate(own)]
        own = [recompression.Symbols.load(b.dump(), 13) for b in own]
    asked = [recompression.Passages(b) for b in own]
    got = meet((p.send(i, buckets) for i, p in enumerate(asked)), recompression._earlier(13))
    want = {d: m for d, _, m, _ in without_repeats(rows)}
    for i, p in enumerate(asked):
        gone = p.repeated([r for r in got if r["block"] == i], buckets)
        removed = sorted({int(g + j) for g in gone for j in range(13)})
        n = np.bincount(words[i].text[removed], minlength=len(batches[i])) if removed else [0] * len(batches[i])
        assert {d: want[d] for d in batches[i]["doc_id"].to_pylist()} == dict(zip(batches[i]["doc_id"].to_pylist(), map(int, n)))
    assert sum(want.values()) > 0


def test_recompression_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_words long, N_removed string")
    out = recompression.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n_words", "N_removed", "n_words_", "n_removed_"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b", 7, "x", 2, 0), (2, "", 8, "y", 0, 0)]


# Packing


def check_packing(rows, texts, tokenizer, capacity=1024):
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in texts]
    want = Counter()
    for (d, _), x in zip(texts, ids):
        cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)]
        want.update((d, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert bag(rows, "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(bins), sum(map(len, ids))


def test_packing(spark, awkward, none, tokenizer):
    n, total = check_packing(packing.pack_documents(awkward, PATH).collect(), [r[:2] for r in ROWS], tokenizer)
    assert n <= -(-total // 1024) + 1
    docs = table(spark, FOLDER, "documents")
    n, total = check_packing(packing.pack_documents(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    assert n <= 1.01 * total / 1024 + 1
    assert packing.pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_binding_capacities(spark, tokenizer, rule):
    """Many short documents: the number of documents or the cost binds before the tokens do."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(1, 12)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    most = packing.pack_documents(docs, PATH, rule=rule).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    assert max(r["n"] for r in most) == packing.DOCUMENTS and max(r["t"] for r in most) < 1024
    cheap = packing.pack_documents(docs, PATH, documents=None, cost=2000, rule=rule).collect()
    check_packing(cheap, rows, tokenizer)
    costs = Counter()
    for r in cheap:
        costs[r["sequence_id"]] += r["length"] ** 2
    assert max(costs.values()) <= 2000 and len(costs) <= 1.2 * sum(costs.values()) / 2000 + 1


def first_fit(lengths, capacity):
    """Bins of first-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= n
    return len(rooms)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_fit_needs_no_more_bins_than_first_fit(rule):
    rng = random.Random(5)
    for k in range(6):
        lengths = [min(1024, 1 + int(rng.lognormvariate(5, 1 + k / 6))) for _ in range(1500)]
        bins = sum(c.bins for c in packing.fit(Counter(lengths), (1024, 1024, 1024**2), rule=rule))
        assert -(-sum(lengths) // 1024) <= bins <= first_fit(lengths, 1024) * 1.01 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 2_500)])
def test_fit_keeps_every_capacity(rule, capacity):
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 50) for _ in range(5000))
    classes = packing.fit(histogram, capacity, rule=rule)
    placed = Counter()
    for c in classes:
        for length, each in c.contents:
            placed[length] += each * c.bins
        loads = (sum(a * n for a, n in c.contents), sum(n for _, n in c.contents), sum(a * a * n for a, n in c.contents))
        assert all(x <= y for x, y in zip(loads, capacity))
    assert placed == histogram
    with pytest.raises(ValueError):
        packing.fit({101: 1}, capacity, rule=rule)


def test_encoder_gives_ids_of_tokenizers(tokenizer):
    encode = packing._encoder(PATH)
    for t in [t for t in TEXTS if t is not None] + [" " * 100_000 + "x", "\n" * 3000]:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# Chat


def formatted(turns):
    """(examples, digests) of the conversations, in plain Python."""
    convs, rows, out = {}, [], Counter()
    for k, t in enumerate(turns):
        convs.setdefault((t[0], k if t[0] is None else None), []).append(t)
    for (conv, _), own in convs.items():
        own.sort(key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text, loss, chars, n = "", "", 0, 0
        for k, (_, _, role, said) in enumerate(own):
            role, said = role or "", said or ""
            before = text + "### " + re.sub(r"([\\\\#<:])", r"\\\1", role) + ":\n"
            reply = re.sub(r"([\\\\#<])", r"\\\1", said)
            text = before + reply + "</turn>\n"
            target, last = role == "assistant", k == len(own) - 1
            if target or last:
                rows.append((conv, n if target else None, text, len(before) if target else None, len(before + reply) if target else None, last))
                chars += len(text)
            if target:
                loss, n = loss + said, n + 1
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        out[conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars] += 1
    return Counter(rows), out


def test_chat_expands_and_reads_back(spark, monkeypatch):
    turns = [
        (1, 0, "system", "a"), (1, 1, "user", "### user:\n</turn>\n\\"), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 3, "assistant", "b"), (1, 4, "user", ""),
        (2, 1, None, None), (2, None, "user", "first"), (3, 0, "role:\n#<", "😀" * 3), (None, 0, "assistant", None), (None, 0, "user", "lone"), (4, 0, "user", "x"), (4, 0, "user", "x"),
        *((5, k, ("user", "assistant")[k % 2], f"turn {k} " * 40) for k in range(300)), (6, 0, "assistant", "z" * 200_000), (6, 1, "assistant", "y"),
    ]
    df = spark.createDataFrame([(*t, 1, "c") for t in turns], "conv_id long, turn long, role string, text string, seq int, piece string").repartition(5)
    rows, digests = formatted(turns)
    got = chat.examples(df)
    assert bag(got.collect(), "conv_id", "example", "text", "loss_start", "loss_end", "last") == rows
    assert Counter(tuple(r) for r in chat.read_back(got).collect()) == digests
    assert chat.examples(df.where("false")).count() == chat.read_back(chat.examples(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of("### user:\nno end")


# Classifiers


@pytest.mark.parametrize("module,name,label,least", [(quality, "op1_gam", "quality", 0.95), (toxicity, "op8_boosted_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, module, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = getattr(module, name)(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r[label] for r in got) / len(got) >= least


@pytest.mark.parametrize("module,label,keep", [(quality, "quality", quality.keep_good), (toxicity, "toxic", toxicity.keep_clean)])
def test_classifiers_awkward(spark, awkward, none, module, label, keep):
    labels = spark.createDataFrame([(k, k % 2 if k < 9 else None, k % 2 if k < 9 else 7) for k in range(12)] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        model = module.fit(awkward, known, F.lit(True))
        got = module.classify(awkward, model).collect()
        assert bag(got, "doc_id") == Counter((r[0],) for r in ROWS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        kept = keep(awkward, model)
        assert kept.columns == awkward.columns and kept.count() == sum(r["predicted"] == (label == "quality") for r in got)
    assert module.classify(none, model).count() == module.classify(none, module.fit(none, labels, F.lit(True))).count() == 0


PIECES = ["idiot", "You", "1d10t", "i d i o t", "STUPID", "stupidity", "a", "b!!", "soooo", "été", "ÉTÉ", "x_y", "3.5", "$$", "|", "😀", "(ok).", "ß", "I.d.i", "o.t", "\x85", "\u3000", "the", "the"]


def random_texts(n, seed):
    rng = random.Random(seed)
    gaps = [" ", " ", " ", "  ", "\n", "\t", "\r\n"]
    return ["".join(rng.choice(PIECES) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [t or "" for t in TEXTS if len(t or "") < 6000] + ["", ""]


def quality_by_hand(text):
    words = text.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, low = len(words), ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in words]
    counts, lines, line = Counter(low), [], []
    for piece in re.split("(\n)", text):
        own = piece.split()
        if own:
            lines.append(piece.strip())
    longest = run = 1
    for x, y in zip(low, low[1:]):
        run = run + 1 if x == y else 1
        longest = max(longest, run)
    sizes = [len(w) for w in words]
    word = lambda c: c.isalnum() or c == "_"
    mark = lambda c: not word(c) and not c.isspace() and c not in ".,;:'’-"
    letters = sum(word(c) and c != "_" and not c.isdecimal() for c in text)
    alpha, chars, raw = max(1, letters), len(text), text.encode()
    top = [v for _, v in counts.most_common(3)]
    return [
        math.log1p(n), len(counts) / n**0.9, top[0] / n, sum(top) / n, sum(x == y for x, y in zip(low, low[1:])) / n, math.log1p(longest if longest > 1 else 0),
        1 - len(set(zip(low, low[1:]))) / max(1, n - 1), sum(sizes) / n, max(0, sum(x * x for x in sizes) / n - (sum(sizes) / n) ** 2) ** 0.5, sum(x <= 3 for x in sizes) / n,
        sum(c.isupper() for c in text) / alpha, sum(len(w) > 1 and any(c.isupper() for c in w) and not any(c.islower() for c in w) for w in words) / n,
        sum(map(mark, text)) / chars, sum(any(map(mark, w)) for w in words) / n, sum(len(w) > 1 and not word(w[-1]) and not word(w[-2]) for w in words) / n,
        sum(c.isdecimal() for c in text) / chars, letters / chars, text.count("|") / n, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        n / (sum(c in ".!?" for c in text) + 1), len(zlib.compress(raw, 1)) / max(1, len(raw)), math.log1p(len(set(raw))),
    ]


def toxicity_by_hand(text, lexicon):
    m, get = toxicity, lambda t: lexicon.get(t, 0.0)
    small = lambda c: c.lower() if len(c.lower()) == 1 else c
    word = lambda c: c.isalnum() or c == "_"
    letter = lambda c: word(c) and c != "_" and not c.isdecimal()
    words, rows, kinds = text.split(), [], set()
    n, last_hit, last_you, near, strongest = max(1, len(words)), -99, -99, 0, 0.0
    for k, w in enumerate(words):
        bare = "".join(small(c) for c in w if letter(c))
        own, stem, you = get(bare), max(get(bare[:j] + "*") if len(bare) > j else 0.0 for j in m.STEMS), bare in m.SECOND_PERSON
        plain = m.undisguised(w)
        odd = plain != m.bare_of(w) and bool(m._INNER.search(w) or m._DRAWN.search(w))
        under = max(map(get, m.terms(plain))) if odd and not own and not stem else 0.0
        if you:
            near += k - last_hit <= m.NEAR
            last_you = k
        if own or stem or under:
            near += k - last_you <= m.NEAR
            last_hit = k
            kinds.add(bare[:5])
            strongest = max(strongest, own, stem, under)
        rows.append((own, stem, under, you, odd))
    spaced = 0
    for found in m._SPACED.finditer(text):
        got = max(map(get, m.terms(m.bare_of(found[0].translate(m.DISGUISES)))))
        spaced += got > 0
        strongest = max(strongest, got)
    hit = [r for r in rows if r[0] or r[1] or r[2]]
    alpha, chars = max(1, sum(map(letter, text))), max(1, len(text))
    hits, stems = sum(r[0] > 0 for r in rows), sum(r[1] > 0 for r in rows)
    return [
        math.log1p(len(words)), hits, hits / n, len(kinds), strongest, sum(r[0] for r in rows) / n, stems, stems / n, sum(max(r[1], r[2]) for r in hit) / n, near / n,
        sum(r[3] for r in rows) / n, sum(c.isupper() for c in text) / alpha, sum(x.isupper() and y.isupper() for x, y in zip(text, text[1:])) / alpha,
        sum(33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 for c in text) / chars, (text.count("!") + text.count("?")) / n, sum(r[4] for r in rows) / n,
        sum(r[2] > 0 for r in rows), spaced, len(re.findall(r"(.)\1{2,}", text)) / n, sum(not c.isspace() for c in text) / n,
    ]


LEXICON = {"idiot": 5.0, "stup*": 4.0, "you": 2.5, "so": 3.0, "idio*": 2.0}


@pytest.mark.parametrize("size", [1 << 21, 300])
def test_features_equal_those_by_hand(monkeypatch, size):
    monkeypatch.setattr(_training, "PART", size)
    texts = random_texts(400, 1)
    array = pa.array([*texts, None])
    got = _training.in_parts(quality.features, array, len(quality.FEATURES))
    np.testing.assert_allclose(got, [quality_by_hand(t) for t in [*texts, ""]], rtol=1e-9, atol=1e-12)
    got = _training.in_parts(toxicity.Features(LEXICON), array, len(toxicity.FEATURES))
    np.testing.assert_allclose(got, [toxicity_by_hand(t, LEXICON) for t in [*texts, ""]], rtol=1e-9, atol=1e-12)
    assert _training.in_parts(quality.features, array[:0], len(quality.FEATURES)).shape == (0, len(quality.FEATURES))


def test_lexicons_count_documents(spark):
    texts = [t for t in random_texts(120, 2) if len(t) < 1000]
    rows = spark.createDataFrame([(k, t, k % 3 == 0 and 1 or 0, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, y int, weight double").repartition(3)
    got = toxicity.lexicons(rows)[2]
    small = lambda c: c.lower() if len(c.lower()) == 1 else c
    letter = lambda c: c.isalnum() and not c.isdecimal()
    n = {0: Counter(), 1: Counter()}
    for k, t in enumerate(texts):
        bare = {"".join(small(c) for c in w if letter(c)) for w in t.split()}
        n[k % 3 == 0].update({x for w in bare for x in toxicity.terms(w) if 2 < len(x) < 40})
    total = [sum(k % 3 != 0 for k in range(len(texts))), sum(k % 3 == 0 for k in range(len(texts)))]
    odds = {t: math.log((a + 0.5) / (total[1] + 1)) - math.log((n[0][t] + 0.5) / (total[0] + 1)) for t, a in n[1].items() if a + n[0][t] >= 3}
    want = {t: v for t, v in odds.items() if v >= 2 and n[1][t] >= max(3, 0.004 * total[1]) and n[0][t] <= 0.5 * n[1][t]}
    assert got == pytest.approx(want)


def test_sample_keeps_the_shares_of_the_classes(spark):
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(1000)], "doc_id long, toxic int")
    got = _training.labelled(labels, "toxic", F.lit(True), 100).collect()
    weight = {y: sum(r["weight"] for r in got if r["y"] == y) for y in (0, 1)}
    assert Counter(r["y"] for r in got) == {0: 100, 1: 100} and weight[1] / (weight[0] + weight[1]) == pytest.approx(0.2) and sum(weight.values()) == pytest.approx(200)


def weighted_sample(seed, n=300, d=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, d)) / 3.0
    return x, (rng.random(n) < 1 / (1 + np.exp(2 - x[:, 0] - x[:, 1] * (x[:, 2] > 2)))).astype(float), rng.choice([0.5, 1.0, 3.0], n)


def test_gam_scores_by_bin_additions():
    x, y, w = weighted_sample(1)
    model = quality.Gam(x, y, w)
    assert len(model.pairs) == quality.PAIRS
    for row, got in zip(x, model.score(x)):
        f = model.base
        for t, edges, v in zip(model.tables, model.edges, row):
            f += t[sum(v >= e for e in edges)]
        for t, (a, b) in zip(model.pair_tables, model.pairs):
            f += t[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])]
        assert got == pytest.approx(1 / (1 + math.exp(-f)))
    twice = quality.Gam(np.concatenate([x, x[w == 3], x[w == 3]]), np.concatenate([y, y[w == 3], y[w == 3]]))
    assert np.corrcoef(twice.score(x), quality.Gam(x, y, np.where(w == 3, 3.0, 1.0)).score(x))[0, 1] > 0.97


def test_shallow_tree_takes_the_best_cuts(monkeypatch):
    rng = np.random.default_rng(2)
    for k in range(30):
        g, h, n = rng.standard_normal(9), rng.random(9) + 0.1, rng.integers(1, 9, 9)
        monkeypatch.setattr(quality, "LEAVES", 2)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)  # noqa: E731, B023
        fits = [c for c in range(1, 9) if min(n[:c].sum(), n[c:].sum()) >= quality.LEAST]  # noqa: B023
        best = max(fits, key=lambda c: gain(0, c) + gain(c, 9), default=None)
        got = quality.shallow(g, h, n)
        if best is None or gain(0, best) + gain(best, 9) - gain(0, 9) <= 1e-9:
            assert len(set(got)) == 1
        else:
            want = [g[:best].sum() / (h[:best].sum() + 1)] * best + [g[best:].sum() / (h[best:].sum() + 1)] * (9 - best)
            assert got == pytest.approx(want)


def test_boosting_step_takes_the_best_cut(monkeypatch):
    x, y, w = weighted_sample(3)
    model = toxicity.Boosted(x, y, w)
    bins = model._bins(x)
    g, h = w * (y - 0.3), w * 0.21
    feature, cut, leaf = model._grow(bins, g, h)
    score = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
    splits = [(score(bins[:, j] <= c) + score(bins[:, j] > c), j, c) for j in range(4) for c in range(bins[:, j].max()) if min((bins[:, j] <= c).sum(), (bins[:, j] > c).sum()) >= toxicity.LEAST]
    assert score(bins[:, feature[0]] <= cut[0]) + score(bins[:, feature[0]] > cut[0]) == pytest.approx(max(splits)[0])
    for row in range(0, 300, 7):
        node = 0
        for _ in range(toxicity.DEPTH):
            node = 2 * node + 1 + int(bins[row, feature[node]] > cut[node])
        assert model._walk((feature, cut, leaf), bins[row : row + 1])[0] == leaf[node - len(feature)]


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(4)
    raw, y, w = np.sort(rng.random(60)), rng.integers(0, 2, 60).astype(float), rng.choice([1.0, 2.0, 5.0], 60)
    mean = lambda a, b: (w[a:b] * y[a:b]).sum() / w[a:b].sum()
    want = [max(min(mean(a, b) for b in range(k + 1, 61)) for a in range(k + 1)) for k in range(60)]
    fitted = toxicity.Isotonic(raw, y, w)
    blocks = dict(zip(fitted.at, fitted.share))
    sums = {v: w[np.isclose(want, v)].sum() for v in set(np.round(want, 12))}
    for r, v in zip(raw, want):
        if r in blocks:
            total = next(s for k, s in sums.items() if abs(k - v) < 1e-9)
            assert blocks[r] == pytest.approx((v * total + 0.05) / (total + 0.1))
    assert (np.diff(fitted(np.linspace(0, 1, 200))) >= 0).all()


def test_disguised_words():
    f = toxicity.Features({"idiot": 5.0, "stup*": 4.0})
    of = lambda t: dict(zip(toxicity.FEATURES, f(pa.array([t]))[0]))
    assert of("you idiot")["hits"] == 1 and of("you idiot")["near_second_person"] > 0
    assert of("an 1d10t here")["disguised_hits"] == 1 and of("i d i o t now")["spaced_hits"] == 1
    assert of("stupidity")["stem_hits"] == 1 and of("")["hits"] == 0


# Vectors


def test_nn_descent_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    vectors = [*base, *(base[:60] + 0.2 * rng.standard_normal((60, 16))), *(base[0] + 0.05 * rng.standard_normal((150, 16))), *base[:5]]
    rows = [(k, [float(np.float32(x)) for x in v], k % 2 if k < 360 else 0, 9) for k, v in enumerate(vectors)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8]
    rows += [(1000 + k, v, 0, 9) for k, v in enumerate(bad)] + [(2000, rows[0][1], None, 9), rows[1], (None, rows[2][1], 0, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rid int").repartition(5)
    got = Counter(tuple(r) for r in nndescent.near_duplicates(df).collect())
    ok = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([rows[i][1] for i in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([rows[i][2] for i in ok])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    reach = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.minimum(reach, np.where(hit, reach[None, :], len(ok)).min(1, initial=len(ok)))
        if (new == reach).all():
            break
        reach = new
    root, n = {i: i for i in range(len(rows))}, Counter()
    for k, i in enumerate(ok):
        root[i], n[i] = ok[reach[k]], int(hit[k].sum())
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    want = Counter((r[0], n[i], least.get(root[i]), r[0] == least.get(root[i])) for i, r in enumerate(rows))
    assert got == want
    assert nndescent.near_duplicates(df.where("false")).count() == 0


def test_nn_descent_of_a_dense_cluster(spark, monkeypatch):
    """More vectors in reach of each other than a list or a block holds: as many links as brute force counts."""
    monkeypatch.setattr(nndescent, "BLOCK", 200)
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.standard_normal(32) + 0.25 * rng.standard_normal((700, 32)), rng.standard_normal((50, 32))])
    x = np.concatenate([x, x[:40], x[:20] + 0.01 * rng.standard_normal((20, 32))])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.93
    assert 0.2 < hit[:700, :700].mean() < 0.9
    got = {r["vec_id"]: r["n_links"] for r in nndescent.near_duplicates(df).collect()}
    assert got == dict(enumerate((hit.sum(1) - 1).tolist()))


def test_nn_descent_fails_if_links_stay_unseen(spark, monkeypatch):
    """A search that finds nothing of its own is not saved by what the audits add to its graph."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((7000, 16)), 2, axis=0) + 0.04 * rng.standard_normal((14000, 16))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    none = lambda nodes, k, turn=0: nndescent.stash(spark.createDataFrame([], "id long, nbr long, sim double"), "none")
    monkeypatch.setattr(nndescent, "balls", lambda units, half_angle: units.select("rid", F.col("rid").alias("pid"), F.lit(0.0).alias("angle")))
    monkeypatch.setattr(nndescent, "neighbour_graph", none)
    monkeypatch.setattr(nndescent, "PASSES", 2)
    with pytest.raises(RuntimeError, match="pairs in reach"):
        nndescent.near_duplicates(df)


def test_nn_descent_introduces_long_lists():
    v = np.random.default_rng(9).standard_normal((600, 8)).astype(np.float32)
    rows = [(1, k, x.tobytes(), -2.0, True, k) for k, x in enumerate(v)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("c", "m", "v", "kth", "fresh", "group"), r)) for r in rows])
    got = {(r["id"], r["nbr"]) for b in nndescent._introduce(3)(iter([batch])) for r in b.to_pylist()}
    sim = v @ v.T
    np.fill_diagonal(sim, -np.inf)
    assert got == {(i, int(j)) for i in range(600) for j in np.argsort(-sim[i])[:3]}


def test_nn_descent_audits_other_nodes(spark):
    v = [np.array([1.0, k / 1e6], np.float32).tobytes() for k in range(2000)]
    nodes = spark.createDataFrame([(k, f"g{k // 2}", x, 0.0, k) for k, x in enumerate(v)], "id long, grp string, v binary, radius double, group long")
    recall, missed = nndescent.audit(nodes, 0.3)
    assert recall == 0 and missed.count() == nndescent.AUDITED
    joined = nodes.join(missed.select("id", "nbr"), "id", "left").withColumn("group", F.least("id", F.coalesce("nbr", "id")))
    assert nndescent.audit(joined.drop("nbr"), 0.3, 1)[0] < nndescent.RECALL


# Media


@pytest.mark.parametrize("lacing", ["xiph", "fixed", "ebml"])
def test_matroska_round_trip(lacing):
    rng = random.Random(8)
    for frames in (1, 2, 8, 9, 256, 257, 1000):
        payload = rng.randbytes(matroska.FRAME * frames)
        data = matroska.write(payload, lacing)
        media = matroska.parse(data)
        assert matroska.payload_of(data, media) == payload
        assert [p.timestamp_ms for p in media.packets] == [matroska.FRAME_MS * k for k in range(frames)]
        assert [c for _, _, c in media.cues] == list(range(media.clusters)) and media.duration_ms == frames * matroska.FRAME_MS


def test_lacing_of_unequal_frames():
    rng = random.Random(9)
    for _ in range(100):
        frames = [rng.randbytes(rng.choice([0, 1, 5, 127, 128, 254, 255, 256, 600, 20_000])) for _ in range(rng.randint(1, 9))]
        for lacing in ("xiph", "ebml"):
            data = matroska.block(3, -7, frames, lacing)
            track, relative, key, _, ranges = matroska.read_block(data, 0, len(data), True)
            assert (track, relative, key) == (3, -7, True) and [data[o : o + n] for o, n in ranges] == frames


def test_elements_of_unknown_size():
    m = matroska
    frames = m.element(m.TIMESTAMP, 5) + m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"abc"]))
    unknown = lambda i: i.to_bytes((i.bit_length() + 7) // 8, "big") + b"\xff"
    data = m.HEADER + unknown(m.SEGMENT) + unknown(m.CLUSTER) + frames + unknown(m.CLUSTER) + frames
    assert [(p.timestamp_ms, p.size, p.cluster) for p in m.parse(data).packets] == [(5, 3, 0), (5, 3, 1)]
    with pytest.raises(ValueError):
        m.parse(m.HEADER + m.master(m.SEGMENT, m.element(m.TIMESTAMP, 5))[:-1] + b"")


def test_media_rows(spark, awkward, none):
    got = matroska.digest(matroska.read_back(matroska.store(awkward))).collect()
    want = Counter()
    for r in ROWS:
        n, payload = matroska.padded(r[1])
        want[r[0], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert bag(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert matroska.packets(matroska.store(awkward.where("doc_id = 1"))).count() == 1
    assert matroska.digest(matroska.read_back(matroska.store(none))).count() == 0


def test_null_and_broken_media(spark):
    """Files cut at every length and files with a byte changed: a row with an error, or what the rest of it still says."""
    whole = matroska.write(bytes(range(192)) * 2)
    rng = random.Random(12)
    broken = [whole[:n] for n in range(len(whole))]
    for _ in range(400):
        k = rng.randrange(len(whole))
        broken.append(whole[:k] + bytes([rng.randrange(256)]) + whole[k + 1 :])
    for data in broken:
        media, error = matroska.checked(data)
        assert (media is None) == (error is not None)
    stored = spark.createDataFrame([(1, 384, whole), (2, 5, None), (3, 384, whole[:-7]), (4, None, b"")], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in matroska.read_back(stored).collect()}
    assert bytes(got[1]["payload"]) == bytes(range(192)) * 2 and got[1]["error"] is None
    assert got[2]["error"] == "no media" and got[2]["payload"] is None and got[3]["error"] and got[3]["feature"] is None
    frames = Counter((r["doc_id"], r["packet"] is None, r["error"] is None) for r in matroska.packets(stored).collect())
    assert frames[1, False, True] == 2 and frames[2, True, False] == frames[3, True, False] == 1
    assert {r["doc_id"] for r in matroska.digest(matroska.read_back(stored)).collect()} == {1, 2, 3, 4}


def test_packing_of_clashing_columns(spark):
    cut = packing.pieces(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), PATH)
    more = cut.withColumn("rank", F.lit("x")).withColumn("before", F.lit(1)).withColumn("n", F.lit(None).cast("int"))
    got = packing.pack(more).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] and {(r["rank"], r["before"], r["n"]) for r in got} == {("x", 1, None)}


def test_features_of_many_texts_hold_little():
    import tracemalloc

    import pyarrow as pa

    from ontoloom.llm import _training, quality

    texts = pa.array(["some words of a text, and more of them. " * 25] * 4000)
    quality.features(texts[:1])
    tracemalloc.start()
    try:
        x = _training.in_parts(quality.features, texts, len(quality.FEATURES))
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()
    assert len(x) == len(texts) and (x == x[0]).all()


def test_small_arrays_are_packed_without_new_compressors(monkeypatch):
    rng = np.random.default_rng(7)
    arrays = [rng.integers(0, 1 << bits, n).astype(np.int64) for n in (0, 1, 47, 48, 49, 300) for bits in (1, 8, 40)]
    _blocks.unpack(_blocks.pack(arrays[-1]), np.int64)  # this thread has its own by now

    def made(*_, **__):
        raise AssertionError("made anew")

    monkeypatch.setattr(_blocks.zstandard, "ZstdCompressor", made)
    monkeypatch.setattr(_blocks.zstandard, "ZstdDecompressor", made)
    for x in arrays:
        assert (_blocks.unpack(_blocks.pack(x), np.int64) == x).all()
        up = np.sort(x)
        assert (_blocks.unpack(_blocks.pack(up, True), np.int64, True) == up).all()
        assert (_blocks.unpack_sparse(_blocks.pack_sparse(x)) == x).all()
