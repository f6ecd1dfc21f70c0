"""Chat formatting from event logs.

A log row is one event of a conversation: ``message`` (a whole message), ``delta`` (more text for message ``msg``, begun by
its first delta), ``edit`` (new text for ``msg``; later messages, which answered the old text, go) and ``regenerate``
(``msg`` starts empty again; later messages go). Rows are dealt by conversation, sorted by sequence, and folded in one
streaming pass. A message is given out as soon as no later event of its conversation can change it, which a window over
the same sort tells; so a conversation of plain messages needs memory for one message, whatever its length.

Rendering marks turns with ``<|im_start|>role`` and ``<|im_end|>``. Inside roles and texts, a control string gets one
backslash after its first character, and one that has backslashes there gets one more, so it is undone exactly. The output
has one row per turn: its formatted segment and the span in it that counts for the loss (assistant texts).

Defined cases: a null text is empty, a null role is empty; a null conversation is one of its own; null sequences come first;
events with equal sequence go by role, message, kind and text; repeated rows are repeated messages; an ``edit`` or
``regenerate`` of an unknown message begins it; an unknown kind is a message; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import small_batches, table, written

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that must not be read as marks: those of this template and of other common ones.
CONTROL = (START, STOP, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
#: Characters of turns gathered into one output batch.
_BATCH_CHARS = 4_000_000

_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "{0}{1}\\{2}".format(*[g for g in m.groups() if g is not None]), text)


def unescape(text: str) -> str:
    def less(m: re.Match) -> str:
        first, slashes, rest = (g for g in m.groups() if g is not None)
        return first + slashes[1:] + rest

    return _ESCAPE.sub(less, text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(mark: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(mark))


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head, body = f"{START}{_role_out(role)}\n", escape(text)
    return f"{head}{body}{STOP}\n", len(head), len(head) + len(body)


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not turn.startswith(START) or not turn.endswith(f"{STOP}\n"):
        raise ValueError("not a turn")
    role, _, text = turn[len(START) : -len(STOP) - 1].partition("\n")
    return _role_in(role), unescape(text)


class _Folder:
    """Messages of one conversation that later events may still change."""

    def __init__(self, conv):
        self.conv, self.at, self.open = conv, 0, []

    def take(self, kind: str, msg, role: str, text: str) -> None:
        place = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == msg), None) if msg is not None and kind in ("delta", "edit", "regenerate") else None
        if place is None:
            self.open.append([msg, role, [text]])
        elif kind == "delta":
            self.open[place][2].append(text)
        else:
            del self.open[place + 1 :]
            self.open[place][2] = [text] if kind == "edit" else []

    def ready(self, settled: bool) -> Iterator[tuple]:
        if settled:
            for _, role, text in self.open:
                turn, a, b = segment(role, "".join(text))
                yield self.conv, self.at, turn, *((a, b) if role == LOSS_ROLE else (None, None))
                self.at += 1
            self.open = []


_TURNS = "conv_id long, position long, formatted string, loss_start long, loss_end long"
_FIELDS = [("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, now, out, size = pa.schema(_FIELDS), None, [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for rows in batches:
        for conv, kind, msg, role, text, later in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out += now.ready(True)
                now = _Folder(conv)
            now.take(kind or "message", msg, role or "", text or "")
            for turn in now.ready(later == 0):
                out.append(turn)
                size += len(turn[2])
            if size > _BATCH_CHARS:
                yield batch()
                out, size = [], 0
    if now is not None:
        out += now.ready(True)
    if out:
        yield batch()


def render(events: DataFrame) -> DataFrame:
    """Turns of the final conversations from events (conv_id, seq, kind, msg, role, text)."""
    small_batches(events.sparkSession)
    events = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind", F.col("msg").cast("string").alias("msg"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last(), F.col("role").desc_nulls_last(), F.col("msg").desc_nulls_last(), F.col("kind").desc_nulls_last(), F.col("text").desc_nulls_last())
    changes = F.when(F.coalesce("kind", F.lit("message")).isin("delta", "edit", "regenerate"), 1).otherwise(0)
    # how many events after this one may change a message before them
    marked = events.withColumn("later", F.coalesce(F.sum(changes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    sorted_ = marked.sortWithinPartitions("conv_id", "seq", "role", "msg", "kind", "text")
    return sorted_.select("conv_id", "kind", "msg", "role", "text", "later").mapInArrow(_fold, _TURNS)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    now, turns, loss, counts = None, None, None, None

    def row() -> tuple:
        return now[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    for rows in batches:
        out = []
        for conv, _, turn, a, b in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(row())
                now, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text = parsed(turn)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            counts[0] += 1
            counts[2] += len(turn)
            if a is not None:
                counted = unescape(turn[a:b])
                loss.update(counted.encode("utf-8", "surrogatepass"))
                counts[1] += len(counted)
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if now is not None:
        yield pa.record_batch([pa.array([x], pa.int64() if x is None else None) for x in row()], names=names)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from formatted turns alone: counts and digests of its turns and of the text under the loss mask."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(_digest, _DIGEST)


def messages_as_events(rows: DataFrame) -> DataFrame:
    """Whole messages (conv_id, turn, role, text) as an event log."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("msg"), "role", "text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return read_back(written(render(messages_as_events(rows)), "chat"))
