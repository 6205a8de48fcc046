"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns of its
conversation are the context, and only that reply is trainable.  Pieces, one for
each turn, are made and put in order by Spark; a task then walks the pieces of a
conversation and writes out one example after the other, so it holds the text of
one conversation and no more.  Turns after the last reply are in no example's
context; a row without target holds such a conversation in full.

A turn is written `### role:\\n` text `</turn>\\n`.  In roles and texts every
backslash, `#`, `<` and `:` of a role is preceded by a backslash, so that the
marks of the template never come from a text, and dropping the backslashes
gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import table

#: Characters of examples handed on in one batch, about.
BATCH = 1 << 23

OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "</turn>\n"
PIECE = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*):\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)

CONTROL_CASE = [(-7, t, role, "\\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]


def _escaped(text, control: str):
    return F.regexp_replace(text, f"([{control}])", r"\\$1")


def pieces(turns: DataFrame) -> DataFrame:
    """conv_id, seq, piece, example, loss_start, loss_end, last: one row for every row of turns.

    Turns are put in order by turn, then role, then text (nulls first); seq numbers them from 0.  A null role or text
    counts as empty, and a row whose conv_id is null is a conversation of its own.  example numbers the assistant turns
    from 0 and is null for other turns, as are loss_start and loss_end, the code points of the example's text under the
    loss mask.  last marks the last turn of a conversation.  Repeated rows stay repeated; other columns are not read.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), _escaped(F.col("role"), r"\\#<:"), F.lit(AFTER_ROLE))
    target = F.col("role") == "assistant"
    t = t.withColumn("head", F.length(head).cast("long")).withColumn("body", _escaped(F.col("text"), r"\\#<"))
    t = t.withColumn("piece", F.concat(head, "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    known = t.where("conv_id is not null").select(
        "*",
        (F.row_number().over(order).cast("long") - 1).alias("seq"),
        (F.sum(F.length("piece").cast("long")).over(so_far) - F.length("piece")).alias("before"),
        F.when(target, F.sum(target.cast("long")).over(so_far) - 1).alias("example"),
        F.lead("conv_id").over(order).isNull().alias("last"),
    )
    zero = F.lit(0).cast("long")
    lone = t.where("conv_id is null").select("*", zero.alias("seq"), zero.alias("before"), F.when(target, zero).alias("example"), F.lit(True).alias("last"))
    start = F.when(target, F.col("before") + F.col("head"))
    return known.unionByName(lone).select(
        "conv_id", "seq", "piece", "example", start.alias("loss_start"), (start + F.length("body")).alias("loss_end"), "last"
    )


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end, last: the examples, with their contexts written out.

    The rows of a conversation follow each other in order.  last marks its last row, which holds all its turns; example
    and the loss span are null there if turns come after the last reply.  See pieces() for nulls, ties and order.
    """
    names = ["conv_id", "example", "text", "loss_start", "loss_end", "last"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, done, n = "", [], 0
        for batch in batches:
            for conv, seq, piece, example, a, b, last in zip(*(c.to_pylist() for c in batch.columns)):
                text = piece if seq == 0 else text + piece
                if example is not None or last:
                    done.append((conv, example, text, a, b, last))
                    n += len(text)
                if n >= BATCH:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                    done, n = [], 0
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    cut = pieces(turns)
    lone = cut.where("conv_id is null")  # whole already, and in no order: they need not meet
    ordered = cut.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "seq").union(lone)
    return ordered.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long, last boolean")


def turns_of(text: str) -> list[tuple[str, str]]:
    """The (role, text) of the turns that the text of an example holds."""
    at, out = 0, []
    while at < len(text):
        found = PIECE.match(text, at)
        if not found:
            raise ValueError(f"no turn starts at character {at}")
        out.append(tuple(ESCAPED.sub(r"\1", x) for x in found.groups()))
        at = found.end()
    return out


def read_back(expanded: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read from its examples.

    expanded: as examples() gives it.  The turns are those in the last row of a conversation, the loss text what the
    masks of all its rows cover, unescaped, and formatted_chars the length of all its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in batches:
            done: list[tuple] = []
            for conv, text, a, b, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end", "last"))):
                chars += len(text)
                if a is not None:
                    reply = ESCAPED.sub(r"\1", text[a:b])
                    loss_chars += len(reply)
                    loss.update(reply.encode())
                if last:
                    turns = turns_of(text)
                    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    done.append((conv, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    return expanded.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame(CONTROL_CASE, turns.schema)
    return read_back(examples(turns.unionByName(case)))


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end lone from (
    select conv_id, turn, role, text from conversations
    union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
),
p as (select *, 14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) n from t),
s as (select *, sum(n) over w so_far, lead(n) over w is null ends from p window w as (partition by conv_id, lone order by turn nulls first, role, text rows between unbounded preceding and current row))
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(so_far) filter (role = 'assistant' or ends) as bigint) formatted_chars
from s group by conv_id, lone
"""
