"""Byte-level BPE as a deterministic automaton over tokens.

The merge list is compiled by successive merge gadgets.  The automaton starts
with one state and a loop for every byte.  The gadget for a merge (u, v) -> w

* gives w a state that forbids what the state after v forbade just then,
* splits the state after u, which from now on has no arc for v, and
* gives every state that still has an arc for u an arc for w.

A path through the finished automaton spells exactly the correct tokenization
of its bytes.  Every prefix of such a path is one as well, so one forward pass
over a word, along the trie of arc labels, finds the single token that ends at
each position.  States are persistent: the state after a token keeps a link to
the state it was split from and the time of the split, and an arc is resolved
along these links when it is first asked for and then kept in the table.

Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Fixed by the byte-level pre-tokenizer of the vocabulary.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept encoded in each Python worker; beyond it the cache starts anew, nothing is lost.
CACHE_WORDS = 400_000
#: Arcs kept resolved in each Python worker.
CACHE_ARCS = 1_000_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """The tokenization automaton of a merge list.

    labels: bytes of each token id.  merges: pairs of ids with the id they make, by priority.
    """

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        self.labels = labels
        self.merged: dict[tuple[int, int], int] = {}  # split states: u has lost its arc for v at this time
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        for time, (u, v, w) in enumerate(merges, 1):
            self._gadget(time, u, v, w)
        self.arcs: dict[int, bool] = {}
        self._trie()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if w not in self.born and self._has_arc(u, v, time - 1):  # else no path spells u v any more
            self.left[w], self.right[w], self.born[w] = u, v, time
        self.merged[u, v] = time

    def _has_arc(self, after: int, label: int, time: int) -> bool:
        """Whether the state after one token has an arc for another once the gadgets up to `time` are in."""
        while True:
            if self.merged.get((after, label), time + 1) <= time:
                return False
            a, b = self.born.get(after, 0), self.born.get(label, 0)
            if a == b == 0:
                return True
            if b >= a:  # the arc for a label copies that for its left part, just after the label's gadget
                label, time = self.left[label], b
            else:  # the state copies that after its right part, just before its own gadget
                after, time = self.right[after], a - 1

    def allows(self, after: int, label: int) -> bool:
        if len(self.arcs) >= CACHE_ARCS:
            self.arcs.clear()
        got = self.arcs[after << 32 | label] = self._has_arc(after, label, len(self.merged) + 1)
        return got

    def _trie(self) -> None:
        """The labels of all arcs that lie on some path, as one trie of bytes."""
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1]
        for t, word in self.labels.items():
            if len(word) > 1 and t not in self.born:
                continue
            node = 0
            for b in word:
                if (child := self.next.get(node << 8 | b)) is None:
                    child = self.next[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = child
            self.token[node] = t

    def encode(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word."""
        n, step, token, known, allows = len(word), self.next.get, self.token, self.arcs.get, self.allows
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            after, node = last[j], 0
            for k in range(j, n):
                if (node := step(node << 8 | word[k])) is None:
                    break
                if (t := token[node]) >= 0 > last[k + 1]:
                    if j and not (allows(after, t) if (ok := known(after << 32 | t)) is None else ok):
                        continue
                    last[k + 1], start[k + 1] = t, j
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        return ids[::-1]


class WordIds(dict):
    """Little-endian 32-bit ids of pre-split words, each run through the automaton when first met."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.automaton.encode(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts as the vocabulary file says.

    path: a tokenizers JSON file with a byte-level BPE model and no normalizer.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocab = byte_of_char(), spec["model"]["vocab"]
        labels = {i: bytes(map(byte.__getitem__, t)) for t, i in vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.words = WordIds(MergeAutomaton(labels, ((vocab[u], vocab[v], vocab[u + v]) for u, v in pairs)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = labels | {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(PRE_SPLIT).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words, split = self.words, self.split
        if not any(map(text.__contains__, self.special)):
            return b"".join(map(words.__getitem__, split(text)))
        out = []
        for part in self.at_special.split(text):
            if (i := self.special.get(part)) is not None:
                out.append(np.uint32(i).tobytes())
            else:
                out += map(words.__getitem__, split(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text that the labels of the arcs spell."""
        spelt = b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return spelt.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), decoded: every row of docs, its whole text.

    A null text is encoded as the empty text, which has no ids.  Repeated rows stay repeated;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """Count and digests of what encode_decode returned, by built-in functions."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
