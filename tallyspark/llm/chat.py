"""Chat formatting: conversations rebuilt from event logs, then rendered with a template.

An event log has rows (conv_id, seq, kind, msg, role, text).  Kinds:

* message: a whole message, the text that later events of msg act on;
* delta: text to be added to message msg (the first one makes the message);
* edit: new text for message msg;
* regenerate: message msg is emptied, its next deltas write it anew;
* delete: message msg is taken out.

Folding deals out events by (conv_id, msg), so one long conversation is spread over many
tasks, and reads each message's events as a sorted stream, the last one first: what has been
overwritten is passed over, and a task holds the deltas of one message at a time.
Rendering deals out messages by conversation and streams them in order: a task holds one
message at a time and writes one rendered segment for each, so the length of a
conversation is not bounded by memory (its digests, which are of one stream, are one task's
work).  Joined in order, the segments are the formatted conversation.

The template opens each turn with <|im_start|>role, newline, ends it with <|im_end|>,
newline.  Control strings begin with `<` or `[`; inside roles and texts these characters,
and the backslash, are written as \\l, \\b and \\\\, so that no text can hold a control
string and reading back gives exactly the text; a newline inside a role is \\n.  The loss
mask covers assistant texts.

Cases: null text or role: empty.  Null conv_id: a conversation of its own.  Messages are
ordered by msg, then seq, role and text (nulls first), so ties and repeated rows have one
order, and each repeated row of kind message is a message, until another event acts on msg:
then the last one is what is left of them.  Of one seq, kind message comes first.  Events of a
null or unknown kind change nothing.  An empty log gives no row.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = frozenset({"assistant"})
KINDS = ("message", "delta", "edit", "regenerate", "delete")

MESSAGES = "conv_id long, msg long, seq long, role string, text string"
SEGMENTS = "conv_id long, part long, segment string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPED = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_MEANS = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.translate(_ESCAPED)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _MEANS[m[1]], text) if "\\" in text else text


def _known(value) -> bool:
    return value is not None and value == value


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as an event log."""
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"),
        F.col("turn").cast("long").alias("msg"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log."""
    events = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("msg").cast("long").alias("msg"), F.col("seq").cast("long").alias("seq"), "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    events = events.where(F.col("kind").isin(*KINDS))
    order = ["conv_id", "msg", F.desc("seq"), F.col("kind") == "message", *(F.desc(c) for c in ("kind", "text", "role"))]
    dealt = events.repartition("conv_id", "msg").sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for batch in batches:
            out: list[tuple] = []
            for conv, msg, at, kind, by, text in zip(*(batch[c] for c in ("conv_id", "msg", "seq", "kind", "role", "text")), strict=True):
                now = (int(conv) if _known(conv) else None, int(msg) if _known(msg) else None)
                at = int(at) if _known(at) else None
                if now != key:
                    if key is not None:
                        out += last.rest()
                    key, last = now, _Last(*now)
                out += last.add(at, kind, by, text)
            yield _messages(out)
        if key is not None:
            yield _messages(last.rest())

    return dealt.mapInPandas(run, MESSAGES)


class _Last:
    """What is left of one message, its events coming from the last one to the first."""

    def __init__(self, conv: int | None, msg: int | None) -> None:
        self.key, self.deltas, self.base = (conv, msg), [], None
        self.role, self.seq = "", None
        self.acted = self.whole = self.settled = self.over = False  # settled: the text is known; over: so is all else

    def add(self, seq: int | None, kind: str, role: str, text: str) -> list[tuple]:
        if self.over:
            return []
        if kind == "message" and not self.acted:  # nothing acts on it later
            self.whole = True
            return [(*self.key, seq, role, text)]
        if self.whole:  # overwritten by the whole messages after it
            self.over = True
            return []
        self.acted, self.seq = True, seq
        if kind == "message":
            self.role, self.over = self.role or role, True
        self.role = self.role or role
        if not self.settled:
            if kind == "delta":
                self.deltas.append(text)
            else:
                self.settled = True
                self.base = {"delete": None, "regenerate": ""}.get(kind, text)
        return []

    def rest(self) -> list[tuple]:
        if not self.acted or self.base is None and not self.deltas:
            return []
        return [(*self.key, self.seq, self.role, (self.base or "") + "".join(reversed(self.deltas)))]


def _messages(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "msg", "seq", "role", "text"])
    return out.astype({"conv_id": "Int64", "msg": "Int64", "seq": "Int64"})


def render_message(role: str, text: str) -> tuple[str, int, int]:
    """One turn's segment and the range of its text in it."""
    before = f"{START}{escape(role).replace(chr(10), chr(92) + "n")}\n"
    body = escape(text)
    return f"{before}{body}{END}\n", len(before), len(before) + len(body)


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not segment.startswith(START) or not segment.endswith(f"{END}\n") or segment.find(START, 1) >= 0 or segment.find(END) != len(segment) - len(END) - 1:
        raise ValueError("not one rendered turn")
    role, _, body = segment[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(body)


def render(messages: DataFrame) -> DataFrame:
    """Rendered segments in order; loss_start and loss_end bound the loss mask in the segment (null: none)."""
    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "seq", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, part = object(), 0
        for batch in batches:
            out = []
            for now, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                now = int(now) if _known(now) else None
                conv, part = now, part + 1 if now == conv else 0
                segment, start, end = render_message(role, text)
                out.append((conv, part, segment, *((start, end) if role in LOSS_ROLES else (None, None))))
            rows = pd.DataFrame(out, columns=["conv_id", "part", "segment", "loss_start", "loss_end"])
            yield rows.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return dealt.mapInPandas(run, SEGMENTS)


def digests(segments: DataFrame, in_order: bool = False) -> DataFrame:
    """Of each conversation, read back from its segments: turns, text under the loss mask, length.

    in_order: the segments come straight from `render`, which leaves each conversation in one partition and in order.
    """
    dealt = segments if in_order else segments.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None

        def row() -> tuple:
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            out = []
            for conv, segment, start, end in zip(batch["conv_id"], batch["segment"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = int(conv) if _known(conv) else None
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
                if _known(start):
                    own = unescape(segment[int(start) : int(end)])
                    state[3] += len(own)
                    state[4].update(own.encode("utf-8", "surrogatepass"))
            yield _digests(out)
        if state is not None:
            yield _digests([row()])

    return dealt.mapInPandas(run, DIGESTS)


#: The query's result in DuckDB SQL: the control conversation and all others, turn by turn.
ORACLE = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b'), chr(10), '\n') AS r,
         replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b') AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(x) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _digests(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})
