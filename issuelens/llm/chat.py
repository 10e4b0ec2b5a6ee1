"""Chat formatting by event-sourced reconstruction.

A log of events ``(conv_id, turn, seq, kind, role, text)`` is partitioned by
conversation and sorted; a streaming fold turns it into final messages, which
are rendered one by one.  Kinds:

- ``message`` begins a message (each such event one of its own);
- ``delta`` appends text to the turn's latest message (and begins it, if none has);
- ``edit`` replaces the text of the turn's latest message;
- ``regenerate`` empties the turn's latest message and voids every event of a
  later turn that came before it (smaller seq).

Only one message is held at a time, whatever a conversation's length, so a
conversation with a third of all rows streams through its task in sorted
order; its digest is sequential by nature.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per message.  Inside roles
and texts a backslash becomes two, and each control string gets ``\\|`` after
its first character, so none appears whole; in roles a line break becomes
``\\n``.  ``unescape`` reverses this.  The loss mask spans each assistant text.

Cases: a null text or role is empty; events of equal turn go by seq, then
kind, role and text; repeated rows are messages of their own; null conv_ids
are one conversation, null turns come first; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"\\": "\\", "|": "", "n": "\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\|" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """``(conv_id, turn, role, text)`` of final messages from events sorted by conversation, turn and seq."""
    conv = turn = role = None
    parts: list[str] | None = None
    begun, void = False, None  # void: the largest seq of a regenerate so far in this conversation
    pending = None             # the same, for turns after the present one
    for c, t, seq, kind, r, text in events:
        if not begun or c != conv or t != turn:
            if parts is not None:
                yield conv, turn, role, "".join(parts)
            if not begun or c != conv:
                void = pending = None
            conv, turn, parts, begun, void = c, t, None, True, pending
        if void is not None and seq is not None and seq < void:
            continue
        text = text or ""
        if kind == "message":
            if parts is not None:
                yield conv, turn, role, "".join(parts)
            role, parts = r or "", [text]
        elif kind == "delta":
            if parts is None:
                role, parts = r or "", []
            parts.append(text)
        elif kind == "edit":
            role, parts = (r or "") if parts is None else role, [text]
        elif kind == "regenerate":
            parts = None if parts is None else []
            pending = seq if pending is None else max(pending, seq)
    if parts is not None:
        yield conv, turn, role, "".join(parts)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _chunks(rows: Iterator[tuple], schema: pa.Schema, chars: int = 4 << 20, text: int = -1) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[text]) if text >= 0 else 0)
        if size > chars:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PIECES = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()),
                     ("formatted", pa.string()), ("loss", _SPAN)])


def _render(batches):
    def pieces():
        last, position = object(), 0
        for conv, turn, role, text in fold(_rows(batches)):
            position = position + 1 if conv == last else 0
            last = conv
            head = START + escape(role).replace("\n", "\\n") + "\n"
            body = escape(text)
            loss = {"start": len(head), "end": len(head) + len(body)} if role == "assistant" else None
            yield conv, position, turn, head + body + END, loss

    yield from _chunks(pieces(), _PIECES, text=3)


def render(events: DataFrame) -> DataFrame:
    """``(conv_id, position, turn, formatted, loss)`` of each final message.

    A conversation's transcript is its pieces in order of position; ``loss``
    (code points of the piece) marks assistant text and is null elsewhere.
    The rows of a conversation come together and in order.
    """
    return (events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"),
                          "kind", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
            .mapInArrow(_render, "conv_id long, position long, turn long, formatted string, "
                                 "loss struct<start:long,end:long>"))


def parse(piece: str) -> tuple[str, str]:
    """Role and text that a piece was rendered from."""
    role, _, body = piece[len(START):-len(END)].partition("\n")
    return unescape(role), unescape(body)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches):
    def digests():
        conv, n = object(), 0
        for c, _, _, piece, loss in _rows(batches):
            if n and c != conv:
                yield conv, n, turns.hexdigest(), chars, under.hexdigest(), length
                n = 0
            if not n:
                conv, turns, under, chars, length = c, hashlib.sha256(), hashlib.sha256(), 0, 0
            role, text = parse(piece)
            turns.update(f"{role}\n{text}\n".encode())
            if loss:
                masked = unescape(piece[loss["start"]:loss["end"]])
                under.update(masked.encode())
                chars += len(masked)
            length += len(piece)
            n += 1
        if n:
            yield conv, n, turns.hexdigest(), chars, under.hexdigest(), length

    yield from _chunks(digests(), _DIGEST)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, what its rendered pieces say (rows as ``render`` orders them)."""
    return pieces.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                         "loss_sha256 string, formatted_chars long")


#: A conversation that says control strings, formatted beside the given ones.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe (-1), rendered and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                  F.lit(PROBE))
    events = rows.union(probe).select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"),
                                      "role", "text")
    return read_back(render(events))


def _length(column: str) -> str:
    extra = " + ".join(rf"2 * ((length({column}) - length(replace({column}, '{c}', ''))) // {len(c)})" for c in CONTROL)
    return rf"length({column}) + length({column}) - length(replace({column}, '\', '')) + {extra}"


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START) + 1 + len(END)} + {_length('role')} + length(role) - length(replace(role, chr(10), ''))
                + {_length('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
