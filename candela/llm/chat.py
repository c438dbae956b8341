"""Chat formatting by prefix-target expansion.

Each turn is rendered once, as a segment between control strings; control
strings inside texts are escaped reversibly. Every assistant turn is its own
example: all segments before it are the context, and only that reply is
trainable. As the examples of a conversation are prefixes of one rendering, a
segment is stored with the first example that holds it, and an example row says
how many of its conversation's segments and characters are its text, and where
in it the loss is; so the stored size is linear in the turns. `render_examples`
gives the full texts. `read_back` takes both tables: turns from the segments,
loss and lengths from the example rows alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from candela.llm.common import stage_table, table, text_or_empty

#: The template's own control strings, and those of other templates that texts must not smuggle in.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = [OPEN, CLOSE, "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""Each backslash doubled, then a backslash inside every control string after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in sorted(CONTROL, key=lambda m: (-len(m), m)):
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


_ESCAPE = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(CLOSE), re.S)


def unescaped(text: str) -> str:
    """The text that was escaped."""
    return _ESCAPE.sub(r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment per turn: (conv_id, turn, segment, loss_start, loss_chars), the loss over an assistant's text alone.

    Defined results: null texts and roles count as empty; a null turn comes
    first; rows that share a turn follow each other by role and text.
    """
    role = F.replace(escaped(text_or_empty("role")), F.lit("\n"), F.lit("\\\n"))
    text = escaped(text_or_empty("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("__r"), text.alias("__t"), text_or_empty("role").alias("__role"))
    head = F.concat(F.lit(OPEN), F.col("__r"), F.lit("\n"))
    trained = F.col("__role") == TRAINED_ROLE
    return rows.select(
        "conv_id",
        "turn",
        F.concat(head, F.col("__t"), F.lit(CLOSE)).alias("segment"),
        F.when(trained, F.length(head).cast("long")).alias("loss_start"),
        F.when(trained, F.length("__t").cast("long")).alias("loss_chars"),
    )


PLACED = "conv_id long, turn long, segment string, loss_start long, loss_chars long, part int, k long, start long, example long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, segment, loss_start, loss_chars, chars) with their place among their conversation's rows of this partition."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, null = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        steps = np.ones(n, np.int64), batch.column(5).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        totals = [np.concatenate(([0], np.cumsum(v))) for v in steps]
        before = [t[:-1] - t[first] for t in totals]
        if last is not None and (conv[0], null[0]) == last[:2]:
            for v, carried in zip(before, last[2:]):
                v[first == 0] += carried
        last = (conv[-1], null[-1], *(int(v[-1] + s[-1]) for v, s in zip(before, steps)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.full(n, part, np.int32)), *map(pa.array, before)], [c.strip().split(" ")[0] for c in PLACED.split(",")])


def placed(segments: DataFrame) -> DataFrame:
    """segments, staged, with their place: k (number in the conversation), start (characters before it), example (the first that holds it).

    Turns are dealt by ranges, so a conversation that holds a third of all rows
    is spread over the tasks; what a range needs of those before it is one row
    for each conversation that goes over its bounds.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    rows = segments.select("conv_id", "turn", "segment", "loss_start", "loss_chars", F.length("segment").cast("long").alias("chars"))
    rows = rows.repartitionByRange(*order, F.substring("segment", 1, 64)).sortWithinPartitions(*order, "segment")
    here = stage_table(rows.mapInArrow(_running, PLACED), "placed")
    size = F.length("segment").cast("long")
    sums = here.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("c"), F.count("loss_start").alias("r"))
    w = W.Window.partitionBy("conv_id").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    # At most two rows for each partition.
    over = sums.select(F.col("conv_id").alias("conv"), F.col("part").alias("p"), *[F.sum(c).over(w).alias(f"{c}0") for c in ("n", "c", "r")]).where("n0 is not null")
    out = here.join(F.broadcast(over), here["conv_id"].eqNullSafe(over["conv"]) & (here["part"] == over["p"]), "left")
    add = {"k": "n0", "start": "c0", "example": "r0"}
    return out.select("conv_id", "turn", "segment", "loss_start", "loss_chars", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in add.items()])


def examples(rows: DataFrame) -> DataFrame:
    """The expansion of placed segments: a row per assistant turn with its example's number, last segment, length, and the loss's place in its text."""
    chars = F.col("start") + F.length("segment")
    return rows.where("loss_start is not null").select("conv_id", "example", F.col("k").alias("last_segment"), chars.alias("chars"), (F.col("start") + F.col("loss_start")).alias("loss_start"), "loss_chars")


def render_examples(own: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars) with each example's whole text, from examples and placed segments: size grows with turns squared."""
    parts = rows.select("conv_id", "k", "segment")
    pairs = own.join(parts, own["conv_id"].eqNullSafe(parts["conv_id"]) & (parts["k"] <= own["last_segment"])).drop(parts["conv_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "segment"))), lambda x: x["segment"]), "")
    return pairs.groupBy("conv_id", "example", "loss_start", "loss_chars").agg(text.alias("text"))


class _Conversation:
    """What has been read back of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.formatted, self.loss_chars, self.last = conv_id, 0, 0, 0, 0, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def segment(self, segment: str) -> None:
        """The next segment of the rendering."""
        role, text = (unescaped(x) for x in _SEGMENT.fullmatch(segment).groups())
        self.turns += 1
        self.chars += len(segment)
        self.last = segment
        self.all.update(f"{role}\n{text}\n".encode())

    def example(self, chars: int, loss_start: int, loss_chars: int) -> None:
        """An example whose text is all of the rendering up to here."""
        at = loss_start - (self.chars - len(self.last))
        if chars != self.chars or at < 0:
            raise ValueError(f"an example of conversation {self.conv_id} does not end with the turn it trains")
        reply = unescaped(self.last[at : at + loss_chars])
        self.loss_chars += len(reply)
        self.loss.update(reply.encode())
        self.formatted += chars

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, segment, *example in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            if segment is not None:
                now.segment(segment)
            else:
                now.example(*example)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), DIGEST.types)], schema=DIGEST)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), DIGEST.types)], schema=DIGEST)


def read_back(own: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation, from its example rows and placed segments; formatted_chars sums its examples' lengths.

    An example row follows its last segment, so that its text is what has been
    read. Rows stream by in order: memory doesn't grow with a conversation. An
    example row that doesn't fit the segments raises.
    """
    none = F.lit(None).cast("long")
    parts = rows.select("conv_id", "k", F.lit(0).alias("kind"), "segment", none.alias("chars"), none.alias("loss_start"), none.alias("loss_chars"))
    marks = own.select("conv_id", F.col("last_segment").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("segment"), "chars", "loss_start", "loss_chars")
    both = parts.unionByName(marks).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "k", "kind")
    return both.select("conv_id", "segment", "chars", "loss_start", "loss_chars").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, expanded to examples and read back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = placed(format_turns(turns.unionByName(own)))
    return read_back(stage_table(examples(rows), "examples"), rows)


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'),
    '<</SYS>>', '<\</SYS>>'), '<|turn|>', '<\|turn|>'), '<<SYS>>', '<\<SYS>>'), '<|end|>', '<\|end|>'), '[/INST]', '[\/INST]'),
    '[INST]', '[\INST]'), '</s>', '<\/s>'), '<s>', '<\s>'), '<|', '<\|'), '|>', '|\>') AS esc FROM t
), s AS (
  SELECT *, sum(8 + length(role) + 1 + length(esc) + 7) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
