"""Chat formatting by incremental black-box rendering.

A template is any function ``render(messages, prompt) -> str`` over a list of
``(role, text)``; nothing is known of its inside.  Successive prefixes of the
conversation are rendered, and what a turn adds to the previous rendering is
its span; the part that belongs to the text is found with two probe texts that
share neither first nor last character.  A rendering that does not begin with
the one before it shows a template that rewrites history.

Long conversations are rendered over a sliding window of ``window`` turns, so
time does not grow with the square of their length.  Whether the window holds
is checked: at doublings of its length and at the conversation's end the whole
prefix is rendered and compared with the pieces.  Where they differ (the
template looks further back) that conversation is done again with its true
prefixes.  One conversation at a time is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import table
from hearth.llm.registry import register

Render = Callable[[list[tuple[str, str]]], str]

_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
PROBES = ("\x01a\x01", "\x02b\x02")


def escape(s: str) -> str:
    """Control characters of the template with a backslash in front."""
    return _CONTROL.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], s)


def turn_template(messages: list[tuple[str, str]]) -> str:
    """``<turn ROLE>TEXT</turn>`` per message; backslash and angle brackets inside are escaped."""
    return "".join(f"<turn {escape(r)}>{escape(t)}</turn>\n" for r, t in messages)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The messages back from the output of ``turn_template``."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not an output of this template")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not an output of this template")
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Incremental:
    """Feeds one conversation to a template, turn by turn."""

    def __init__(self, render: Render, loss_roles: tuple[str, ...] = ("assistant",), window: int | None = 32):
        self.render, self.loss_roles, self.window = render, loss_roles, window
        self.messages: list[tuple[str, str]] = []
        self.before = render([])
        self.opening = self.before     # what a template writes ahead of any turn
        self.rewrites = False

    def add(self, role: str, text: str) -> tuple[str, tuple[int, int] | None]:
        """(what this turn appends, span of its text inside that, if it is under
        the loss).  A turn after which an earlier part reads differently sets
        ``rewrites`` and has no trustworthy span."""
        if self.window and len(self.messages) >= self.window:
            # restart on the later half: an appended piece may look back over at most that many turns
            self.messages = self.messages[self.window // 2:]
            self.before = self.render(self.messages)
        now = self.render([*self.messages, (role, text)])
        piece, span = now[len(self.before):], None
        if not now.startswith(self.before):
            self.rewrites = True
            piece = now[_common(now, self.before):]
        elif role in self.loss_roles:
            a, b = (self.render([*self.messages, (role, p)])[len(self.before):] for p in PROBES)
            head, tail = _common(a, b), _common(a[::-1], b[::-1])
            span = (head, len(piece) - tail)
        self.messages.append((role, text))
        self.before = now
        return piece, span


def _pieces(messages: list[tuple[str, str]], render: Render, loss_roles: tuple[str, ...],
            window: int | None) -> tuple[list[tuple[str, tuple[int, int] | None]], bool]:
    """(piece, span) of every turn, the opening in the first piece, and whether
    the template rewrites history; then the last piece is the whole rendering,
    the others are empty and no span is given."""
    inc = Incremental(render, loss_roles, window)
    out, whole, check = [], [], window
    for n, (role, text) in enumerate(messages, 1):
        piece, span = inc.add(role, text)
        if n == 1:
            shift = len(inc.opening)
            piece, span = inc.opening + piece, span and (span[0] + shift, span[1] + shift)
        out.append((piece, span))
        whole.append(piece)
        if inc.rewrites:
            break
        if window and n > window and (n >= 2 * check or n == len(messages)):
            check = n
            if "".join(whole) != render(messages[:n]):
                return _pieces(messages, render, loss_roles, None)
    if not inc.rewrites:
        return out, False
    if window and len(out) > window:  # only the window may have shown it: true prefixes decide
        return _pieces(messages, render, loss_roles, None)
    return [("", None)] * (len(messages) - 1) + [(render(messages), None)], True


def format_messages(messages: list[tuple[str, str]], render: Render = turn_template,
                    loss_roles: tuple[str, ...] = ("assistant",), window: int = 32) -> dict:
    """One conversation: ``formatted``, ``spans`` of the loss in it (code points), ``rewrites``.

    When the template rewrites history the whole conversation is rendered once
    more and no span is given."""
    if not messages:
        return {"formatted": render([]), "spans": [], "rewrites": False}
    pieces, rewrites = _pieces(messages, render, loss_roles, window)
    spans, at = [], 0
    for piece, span in pieces:
        if span:
            spans.append((at + span[0], at + span[1]))
        at += len(piece)
    return {"formatted": "".join(p for p, _ in pieces), "spans": spans, "rewrites": rewrites}


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))


def format_conversations(conversations: DataFrame, render: Render = turn_template,
                         loss_roles: tuple[str, ...] = ("assistant",), window: int = 32) -> DataFrame:
    """One row per turn of ``conversations(conv_id, turn, role, text)``: conv_id,
    turn_no (from 0), role, piece (what the turn appends to the formatted
    conversation), loss_from / loss_to (span inside the piece, null outside the
    loss), rewrites.  Concatenated pieces are the formatted conversation; where
    the template rewrites history, all rows say so and the last one's piece is
    the whole rendering.

    Null roles and texts are empty; a null conv_id is a conversation of its
    own; rows of one turn come in (role, text) order and repeated rows are
    repeated turns; no rows give none."""
    def run(batches):
        out = []
        for conv, turns in groupby(_turns(batches), key=lambda x: x[0]):
            said = [(role, text) for _, role, text in turns]
            pieces, rewrites = _pieces(said, render, loss_roles, window)
            for n, ((role, _), (piece, span)) in enumerate(zip(said, pieces)):
                out.append((conv, n, role, piece, span and span[0], span and span[1], rewrites))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)
    return _ordered(conversations).mapInArrow(run, PIECES)


PIECES = "conv_id long, turn_no long, role string, piece string, loss_from long, loss_to long, rewrites boolean"
_TYPES = [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("piece", pa.string()),
          ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("rewrites", pa.bool_())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], [n for n, _ in _TYPES])


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, rewrites boolean")
_DIGEST_TYPES = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                 ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())]


def digest_conversations(pieces: DataFrame) -> DataFrame:
    """Reads formatted conversations back: per conversation the parsed turns'
    digest and that of the unescaped text under the loss mask.  ``pieces`` is
    the output of ``format_conversations`` with ``turn_template``; its rows
    are still partitioned by conversation and in order."""
    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n, _ in _TYPES)))
        out = []
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            told, loss, n, chars, size, rewrites = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
            for _, _, _, piece, start, end, changed in turns:
                for role, text in parse_turns(piece):
                    told.update(f"{role}\n{text}\n".encode())
                    n += 1
                if start is not None:
                    kept = unescape(piece[start:end])
                    loss.update(kept.encode())
                    chars += len(kept)
                size += len(piece)
                rewrites |= changed
            out.append((conv, n, told.hexdigest(), chars, loss.hexdigest(), size, rewrites))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _DIGEST_TYPES)],
                                                 [x for x, _ in _DIGEST_TYPES])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _DIGEST_TYPES)],
                                             [x for x, _ in _DIGEST_TYPES])
    return pieces.mapInArrow(run, DIGEST)


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(regexp_replace(role, '[\\<>]', '..', 'g')) + length(regexp_replace(text, '[\\<>]', '..', 'g')))
            AS BIGINT) AS formatted_chars, false AS rewrites
FROM c GROUP BY conv_id
"""


@register("op8_chat_formatting", OP8_SQL)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -7 with control strings in its texts, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_conversations(rows.unionByName(probe)))
