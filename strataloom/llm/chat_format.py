"""Chat formatting: conversations rebuilt from event logs, then rendered with a template that can be read back.

An event is (conv_id, seq, kind, message_id, role, text). Kinds: ``message`` opens a message with its whole text,
``delta`` adds to it, ``edit`` replaces its text, ``regenerate`` empties it for new deltas. A message's final text is its
last message, edit or regenerate event plus the deltas after it; its place is its first event's seq.

Folding and rendering go by message, so a conversation with a third of all rows is spread over all tasks. Only reading
back needs a conversation in order: it streams over rows sorted by (conv_id, place) and holds one turn at a time.

The template is ``### Role: text</turn>\\n``. Inside roles and texts, a backslash goes before every ``### ``, ``</turn>``
and backslash, so that any text, control strings included, comes back as it was.

Defined cases: null role or text: empty; a message's role is that of its first event with one. Null conv_id is a conversation of its
own. Null seq comes first. Of events of one seq (or none), deltas come last; the others are ordered by kind, role and text, deltas by text.
``message`` events without an id are separate turns, also when repeated; those of one id are one message. Null kind counts as ``message``. An
event with null message_id is a message of its own whatever its kind, folded as its only event: a ``regenerate`` is empty, any other
keeps its text. Very long texts are taken whole. Other columns, whatever their names, are left out. An empty log gives an empty result.

One message's deltas meet in one row, as its text must; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OPEN, CLOSE, ROLE_END = "### ", "</turn>", ": "
CONTROL = r"(### |</turn>|\\|: )"
TURNS = "conv_id long, place long, nth long, segment string, loss_from long, loss_to long"


def turn_events(conversations: DataFrame, streams: int = 3) -> DataFrame:
    """The event log that leads to a table of whole turns (conv_id, turn, role, text): each row is a message of its own, with an id of its own.

    An assistant's turn is opened empty, streamed, regenerated and streamed again in ``streams`` deltas; any other is sent with the first half of
    its text and then edited. seq is 16 * turn and upwards, in the order of the events, as a decimal, which no turn overflows. A row
    without a turn has no order of events: it is sent as a whole.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    piece = lambda i: text.substr(F.floor(n * i / streams).cast("int") + 1, (F.floor(n * (i + 1) / streams) - F.floor(n * i / streams)).cast("int"))
    step = lambda i, kind, said, role="role": F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), (F.col(role) if role else F.lit(None)).cast("string").alias("role"), said.cast("string").alias("text"))
    half = text.substr(F.lit(1), F.floor(n / 2).cast("int"))
    streamed = [step(0, "message", F.lit("")), step(1, "delta", half, None), step(2, "regenerate", F.lit(None), None), *(step(3 + i, "delta", piece(i), None) for i in range(streams))]
    log = F.when(F.col("turn").isNull(), F.array(step(0, "message", F.col("text")))).when(F.lower("role") == "assistant", F.array(*streamed)).otherwise(F.array(step(0, "message", half), step(1, "edit", F.col("text"))))
    named = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().cast("string").alias("message_id"))
    rows = named.select("conv_id", "turn", "message_id", F.explode(log).alias("e"))
    return rows.select("conv_id", (F.col("turn").cast("decimal(30,0)") * 16 + F.col("e.step")).alias("seq"), "e.kind", "message_id", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of an event log.

    Events that no other event can refer to (null message_id) need no grouping and pass straight on.
    """
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = e.where(F.col("message_id").isNull()).select("conv_id", F.col("seq").alias("place"), "role", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))
    kept = e.where(F.col("message_id").isNotNull())
    order = F.struct("seq", "kind", "role", "text")  # nulls come first
    parts = kept.groupBy("conv_id", "message_id").agg(F.min(F.struct("seq"))["seq"].alias("place"), F.min_by("role", F.when(F.col("role") != "", order)).alias("role"), F.max(F.when(F.col("kind") != "delta", order)).alias("start"), F.collect_list(F.when(F.col("kind") == "delta", order)).alias("deltas"))
    later = F.filter(F.array_sort("deltas"), lambda d: F.col("start").isNull() | F.col("start.seq").isNull() | F.coalesce(d["seq"] >= F.col("start.seq"), F.lit(False)))
    base = F.when(F.col("start.kind") == "regenerate", F.lit("")).otherwise(F.coalesce("start.text", F.lit("")))
    text = F.concat(base, F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return alone.unionByName(parts.select("conv_id", "place", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"\\$1")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """messages with their rendered ``segment`` and, for turns of ``loss_role``, the loss mask's start and end in it (code points)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    masked = F.lower("role") == loss_role
    start = F.char_length(head).cast("long")
    return messages.select("conv_id", "place", "role", "text", F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"), F.when(masked, start).alias("loss_from"), F.when(masked, start + F.char_length(body)).alias("loss_to"))


_TOKEN = re.compile(r"\\(### |</turn>|\\|: )|(### |</turn>\n|: )")


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    parts: list[list[str]] = [[]]
    last = 0
    for m in _TOKEN.finditer(segment):
        parts[-1].append(segment[last : m.start()])
        last = m.end()
        if m[1] is not None:
            parts[-1].append(m[1])
        else:
            parts.append([])
    head, role, text, rest = ("".join(p) for p in parts)
    if head or rest or segment[last:]:
        raise ValueError("not a rendered turn")
    return role, text


def unescape(text: str) -> str:
    return re.sub(r"\\(### |</turn>|\\|: )", r"\1", text)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame) -> DataFrame:
    """A row of DIGEST for each conversation, taken from its rendered segments and loss mask alone."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        out: list[list] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])
            out.clear()
            return batch

        def close() -> None:
            if now:
                out.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]])

        for b in batches:
            for conv, segment, a, z in zip(*(b.column(k).to_pylist() for k in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += len(segment)
                if a is not None:
                    under = unescape(segment[a:z])
                    now[3] += len(under)
                    now[4].update(under.encode())
            if len(out) >= 1000:
                yield flush()
        close()
        yield flush()

    small_batches(rendered.sparkSession)
    n = int(rendered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rendered.select("conv_id", "place", "role", "text", "segment", "loss_from", "loss_to").repartition(n, "conv_id").sortWithinPartitions("conv_id", "place", "role", "text")
    return ordered.select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(digests, DIGEST)
