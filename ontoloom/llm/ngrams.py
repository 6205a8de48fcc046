"""Stupid-backoff language-model scores, computed relationally.

The model of a document is the n-gram counts of all other documents: what the
corpus counts less what the document itself holds.  Count tables are partitioned
by the hash of the n-gram.  A block of documents sends each of its n-grams once,
with its own count; the bucket that it belongs to adds the counts up and the
sums are joined back to the block, where they meet the exploded n-grams of every
document and are summed to its score.

Words go first and are sent as they are spelt.  Each that two documents have
gets a number, and longer n-grams are sent as rows of these numbers, so counts
never mix what only hashes alike.  An n-gram can only occur elsewhere if both
its shorter parts do: others are known to count zero and are not sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import SENT, Words, columns_of, distinct, heard, in_blocks, in_order_sent, of_ipc, sent, several, told
from ._shared import stash_by, table

#: Bytes of text in a block, about; keys that meet in a bucket of a count table, about.
BLOCK, BUCKET = 2 << 20, 1 << 19
#: What a step back costs.
ALPHA = 0.4


class Block:
    """The n-grams of a block, and what is known of their counts in all other documents."""

    def __init__(self, batch: pa.RecordBatch, order: int):
        self.words = Words(batch.column("text"), lower=True)
        self.text, self.order = self.words.text, order
        self.ids, self.vocabulary = self.words.spelt()
        self.elsewhere: dict[int, np.ndarray] = {}  # by order: for each word, how often the k-gram ending there occurs elsewhere

    def grams(self, k: int, bits: int):
        """(last words of the k-grams that may occur elsewhere, what to send for them, which of that each is)."""
        if k == 1:
            return np.arange(len(self.text)), self.vocabulary, self.ids
        shorter = self.elsewhere[k - 1]
        at = np.flatnonzero(self.text[: max(0, len(self.text) - k + 1)] == self.text[k - 1 :])
        at = at[(shorter[at + k - 2] > 0) & (shorter[at + k - 1] > 0)]
        columns = columns_of([self.number[at + j] for j in range(k)], bits)
        first, of = distinct(columns)
        return at + k - 1, [c[first] for c in columns], of

    def send(self, k: int, bits: int, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        at, keys, of = self.grams(k, bits)
        yield from sent(block, keys, np.bincount(of, minlength=_size(keys)) * 2 + several(of, self.text[at], _size(keys)), buckets)

    def learn(self, k: int, bits: int, told_: list | None, buckets: int) -> None:
        at, keys, of = self.grams(k, bits)
        number, others = heard(told_, in_order_sent(keys, buckets))
        total = (np.bincount(of, minlength=_size(keys)) + others)[of]
        _, mine = distinct([of.astype(np.uint64) << np.uint64(32) | self.text[at].astype(np.uint64)])
        if k == 1:
            self.number = number[of]
        self.elsewhere[k] = np.zeros(len(self.text), np.int64)
        self.elsewhere[k][at] = total - np.bincount(mine)[mine] if len(at) else 0

    def scores(self, alpha: float, total: int) -> np.ndarray:
        """The natural logarithm of the score of each word after those before it in its text."""
        place = np.arange(len(self.text)) - self.words.first[:-1][self.text]
        most = np.minimum(place + 1, self.order)
        rest = total - self.words.count[self.text]
        step = np.log(alpha)
        out = most * step - np.log(rest + 1.0)  # a word that no other document has
        one = self.elsewhere[1]
        some = one > 0
        out[some] = np.log(one[some]) - np.log(rest[some]) + (most[some] - 1) * step
        for k in range(2, self.order + 1):
            own = self.elsewhere[k]
            some = np.flatnonzero((own > 0) & (place >= k - 1))
            out[some] = np.log(own[some]) - np.log(self.elsewhere[k - 1][some - 1]) + (most[some] - k) * step
        return out


def _size(keys: pa.Array | list[np.ndarray]) -> int:
    return len(keys) if isinstance(keys, pa.Array) else len(keys[0])


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, log_score: one row for every row of docs.

    Words are what white space separates, A-Z in lower case.  log_score sums the natural logarithms of the
    stupid-backoff scores of a document's words under the counts of all other rows of docs; each step back from the
    longest context that the document offers multiplies by alpha, and a word that no other row has gets one step more
    over one word more than they hold.  Without words (null or empty text) it is zero.  Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    blocks = stash_by(in_blocks(docs, BLOCK), "block", "blocks")
    size, total = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "words"))).first()
    blocks = blocks.select("block", "docs")
    buckets = max(8, size // 8 // BUCKET)

    def opened(rows: pa.RecordBatch, known: int, bits: int) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
        for i, block in enumerate(rows.column(0).to_pylist()):
            batch = of_ipc(rows.column(1)[i].as_py())
            own = Block(batch, order)
            for k in range(1, known + 1):
                own.learn(k, bits, rows.column(1 + k)[i].as_py(), buckets)
            yield block, batch, own

    def send(k: int, bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for block, _, own in opened(rows, k - 1, bits):
                    yield from own.send(k, bits, block, buckets)

        return run

    def score(bits: int, total: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for _, batch, own in opened(rows, order, bits):
                    sums = np.bincount(own.text, own.scores(alpha, total), len(batch)) if len(own.text) else np.zeros(len(batch))
                    yield pa.record_batch([batch.column("doc_id"), pa.array(own.words.count), pa.array(sums)], names=["doc_id", "n_words", "log_score"])

        return run

    asked, bits = blocks, 1
    for k in range(1, order + 1):
        answer, most = told(asked.mapInArrow(send(k, bits), SENT), buckets, f"told{k}", spelt=k == 1, named=k == 1)
        if k == 1:
            bits = max(1, most.bit_length())
        asked = asked.join(answer, "block", "left")
    return asked.mapInArrow(score(bits, total), "doc_id long, n_words long, log_score double")


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents),
e as (select doc_id, unnest(words) a, generate_subscripts(words, 1) i, len(words) n from d),
t as (select *, lag(a) over p b, lag(a, 2) over p c from e window p as (partition by doc_id order by i)),
x as (select *, count(*) over (partition by a) n1, count(*) over (partition by doc_id, a) o1,
  count(*) over (partition by a, b) n2, count(*) over (partition by doc_id, a, b) o2,
  count(*) over (partition by a, b, c) n3, count(*) over (partition by doc_id, a, b, c) o3, count(*) over () total from t),
y as (select doc_id, i, total - n rest, n1 - o1 c1, case when i > 1 then n2 - o2 else 0 end c2, case when i > 2 then n3 - o3 else 0 end c3 from x),
z as (select *, lag(c1) over p before1, lag(c2) over p before2, least(i, 3) most from y window p as (partition by doc_id order by i)),
s as (select doc_id, case when c3 > 0 then ln(c3) - ln(before2)
  when c2 > 0 then ln(c2) - ln(before1) + (most - 2) * ln(0.4)
  when c1 > 0 then ln(c1) - ln(rest) + (most - 1) * ln(0.4)
  else most * ln(0.4) - ln(rest + 1) end s from z)
select d.doc_id, cast(len(words) as bigint) n_words, round(coalesce(sum(s), 0), 6) log_score from d left join s using (doc_id) group by d.doc_id, words
"""
