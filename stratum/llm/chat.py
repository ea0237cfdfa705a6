"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a control string that
could be read as markup gets a backslash behind its ``<`` (and one more if it has some already), which
reparsing takes off again. Rendering starts without escapes: the turn is reparsed by a deterministic
parser, and only if that doesn't give back the role and text is it escaped and parsed anew, one
level after another, until it is identical.

The loss mask of a turn is the span of its text in the rendered form if its role is trained.

A formatted conversation is the rendered turns in order; :func:`format_turns` gives a row per
turn, so a conversation of any length is never one value. Digests read the rendered turns as a
stream in (conversation, turn) order, whatever the length of a conversation.

Null role and text count as empty. Turns are ordered by turn (nulls last), then role, then text, so
ties and repeated rows have one order up to equal rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|br|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ROLE_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end|br)\|>")
_ROLE_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end|br)\|>")
_CONTROL_PLAIN = re.compile(r"<\|im_(?:start|end)\|>")


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    start: int
    end: int


def _escape(x: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", x)


def _unescape(x: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", x)


def _escape_role(role: str) -> str:
    """Line breaks as a control string of their own."""
    return _ROLE_CONTROL.sub(r"<\\\1|\2|>", role).replace("\n", BREAK)


def _unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(r"<\1|\2|>", role.replace(BREAK, "\n"))


def parse(rendered: str) -> list[Turn]:
    """The turns of a rendered string; raises ValueError if it isn't one. start and end: the text's place in ``rendered``."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m or _CONTROL_PLAIN.search(m[2]) or _CONTROL_PLAIN.search(m[1]):
            raise ValueError(f"no turn at {at}")
        turns.append(Turn(_unescape_role(m[1]), _unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str, text: str) -> str:
    """The turn, with as much escaping as the round trip needs."""
    for r, t in ((role, text), (role, _escape(text)), (_escape_role(role), _escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        try:
            turns = parse(out)
        except ValueError:
            continue
        if [(x.role, x.text) for x in turns] == [(role, text)]:
            return out
    raise AssertionError("escaping is complete, so the last form parses")


def _render_batches(batches: Iterator[pa.RecordBatch], trained: frozenset) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roles, texts = (b.column(c).to_pylist() for c in ("role", "text"))
        out, starts, ends = [], [], []
        for role, text in zip(roles, texts):
            role, text = role or "", text or ""
            x = render(role, text)
            (turn,) = parse(x)
            out.append(x)
            starts.append(turn.start if role in trained else 0)
            ends.append(turn.end if role in trained else 0)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(out, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["conv_id", "turn", "rendered", "loss_start", "loss_end"])


RENDERED = "conv_id long, turn long, rendered string, loss_start int, loss_end int"


def format_turns(conversations: DataFrame, trained: tuple = ("assistant",)) -> DataFrame:
    """(conv_id, turn, rendered, loss_start, loss_end) for each row: the loss covers rendered[loss_start:loss_end] in code points. No shuffle."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    roles = frozenset(trained)
    return c.mapInArrow(lambda batches: _render_batches(batches, roles), RENDERED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by conversation and turn; the state is that of one conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state, rows = None, []

    def closed():
        return {"conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]}

    for b in batches:
        for conv, rendered, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))):
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for turn in parse(rendered):
                state[1] += 1
                state[2].update(f"{turn.role}\n{turn.text}\n".encode())
            loss = _unescape(rendered[start:end])
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += len(rendered)
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if state is not None:
        rows.append(closed())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered turns: the counts and SHA-256 digests of turns and of the text under the loss mask."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions(F.asc("conv_id"), F.asc_nulls_last("turn"), "rendered")
    return ordered.mapInArrow(_digest_batches, DIGESTS)
