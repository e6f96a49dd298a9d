"""Chat formatting by event-sourced reconstruction.

A log has one event per row: conversation, sequence number, kind, target message, role, text.
``message`` starts a message, ``delta`` appends to its target, ``edit`` replaces its text,
``regenerate`` empties it for the deltas that follow, ``delete`` removes it. Events of one message
are folded in order of (sequence, kind, role, text); a message stands where its first event stood.

A log is partitioned by conversation and, so that a conversation with a third of all events is no single
task, by message within it: events of one message never change another. Rendering is done row by row; only
the last pass streams a conversation's messages in order, one at a time, as a hash of the whole needs, so a
conversation of any length takes the memory of one message.

``events_of`` reads a log; ``edits_of`` makes one from a table of final turns, as an interface that streams
and lets its users change messages would have written it.

Nulls: text and role count as empty, kind as ``message``, target as the row's own sequence number.
Messages without a sequence number come last.
A null conversation is a conversation of its own; ids stay whole numbers throughout. Every ``message`` event makes a message, so repeated
rows give repeated messages. Events with no message before them start one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import slices

OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (OPEN, CLOSE, ASK, ASKED)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    """Break every control string with a backslash after its first character; backslashes double."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """One message's segment and the characters of it under the loss mask (all of an assistant's text)."""
    head = escape(role).replace("\n", "\\n")
    body = escape(text)
    if role == "assistant":
        start = len(OPEN) + len(head) + 1
        return f"{OPEN}{head}\n{body}{CLOSE}", start, start + len(body)
    return f"{ASK}{head}\n{body}{ASKED}", 0, 0


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a rendered segment."""
    for opener, closer in ((OPEN, CLOSE), (ASK, ASKED)):
        if segment.startswith(opener) and segment.endswith(closer):
            inside = segment[len(opener) : -len(closer)]
            if _CONTROL.search(inside):
                raise ValueError("control string inside a message")
            head, _, body = inside.partition("\n")
            return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], head), unescape(body)
    raise ValueError("not a rendered message")


def events_of(df: DataFrame, conv: str = "conv_id", seq: str = "turn", kind: str | None = None, target: str | None = None, role: str = "role", text: str = "text") -> DataFrame:
    """The log in the columns that ``reconstruct`` takes."""
    here: Column = df[seq].cast("long")
    return df.select(
        df[conv].cast("long").alias("conv_id"),
        here.alias("seq"),
        F.coalesce(df[kind] if kind else F.lit(None).cast("string"), F.lit("message")).alias("kind"),
        F.coalesce(df[target].cast("long") if target else F.lit(None).cast("long"), here).alias("target"),
        F.coalesce(df[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(df[text].cast("string"), F.lit("")).alias("text"),
    )


def edits_of(df: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log whose folded messages are the rows of ``df``, each row a message of its own.

    An assistant's turn starts empty, streams a draft, is regenerated and streamed again in two parts; that of
    others is a draft and an edit.
    """
    # a message's id is made before its events are
    turns = df.select(df[conv].cast("long").alias("conv_id"), df[seq].cast("long").alias("_turn"), F.monotonically_increasing_id().alias("target"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text].cast("string"), F.lit("")).alias("_text"))
    whole = F.col("_text")
    half = F.floor(F.length(whole) / 2).cast("int")
    first, rest = F.substring(whole, F.lit(1), half), F.substring(whole, half + 1, F.length(whole))
    event = lambda k, kind, t: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), t.alias("text"))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", rest), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest))
    changed = F.array(event(0, "message", first), event(1, "edit", whole))
    rows = turns.select("conv_id", "_turn", "target", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(changed)).alias("_e"))
    return rows.select("conv_id", (F.col("_turn") * len(STEPS) + F.col("_e.k")).alias("seq"), F.col("_e.kind").alias("kind"), "target", "role", F.col("_e.text").alias("text"))


#: Events of a turn at most, in their order.
STEPS = range(5)


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq, role, text, segment, loss_begin, loss_end (offsets in the segment)."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).alias("kind_no")
    dealt = events.withColumn("kind_no", order).repartition("conv_id", "target").sortWithinPartitions("conv_id", "target", "seq", "kind_no", "role", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = None, None  # made: conv_id, seq, role, parts of text

        def done() -> list[tuple]:
            if made is None:
                return []
            text = "".join(made[3])
            return [(made[0], made[1], made[2], text, *render(made[2], text))]

        for batch in slices(batches):
            out: list[tuple] = []
            for conv, seq, kind, target, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "seq", "kind", "target", "role", "text")], strict=True):
                if (conv, target) != key or kind == "message":
                    out += done()
                    key, made = (conv, target), None
                if kind == "delete":
                    made = None
                elif made is None:
                    made = (conv, seq, role, [text] if kind != "regenerate" else [])
                elif kind == "delta":
                    made[3].append(text)
                else:
                    made = (*made[:3], [text] if kind == "edit" else [])
            yield batch_of(out)
        yield batch_of(done())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "seq", "role", "text", "segment", "loss_begin", "loss_end"])

    return dealt.mapInArrow(fold, "conv_id long, seq long, role string, text string, segment string, loss_begin long, loss_end long")


def digests(messages: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered segments in order: counts and hashes of turns and masked text."""
    dealt = messages.select("conv_id", "seq", "role", "text", "segment", "loss_begin", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", F.col("seq").asc_nulls_last(), "role", "text").drop("role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def done() -> list[tuple]:
            return [] if state is None else [(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

        for batch in slices(batches, "segment"):
            for conv, segment, lo, hi in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_begin", "loss_end")], strict=True):
                if state is None or conv != state[0]:
                    out += done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(segment)
                lost = unescape(segment[lo:hi])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(lost)
                state[4].update(lost.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
            yield batch_of(out)
            out = []
        yield batch_of(done())

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
