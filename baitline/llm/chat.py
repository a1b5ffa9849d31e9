"""Chat formatting (operator 5) by incremental black-box rendering.

A template is any object with ``render(turns)`` for a list of (role, text). It
is never looked into: successive prefixes of a conversation are rendered, and
consecutive outputs compared. Where the longer output begins with the shorter
one, the rest is the new turn's span; where it does not, the template *rewrites
history*, and the conversation is reported as such. Two more renderings of a
prefix, with the new turn's text replaced by two different letters, tell the
frame of the turn from its body: what both share at the front and at the back
is frame.

Every prefix is rendered whole, however long it is and whatever its template
declares, so the work grows with the square of a conversation's turns: no
shorter context could show that a template rewrites what stands before it.

Rows are dealt by conversation and sorted in the partition by turn, then role,
then text (the order of ties); a task reads them as a stream and holds the turns
of one conversation and three renderings of them. Digests are sequential by
nature, so one conversation is one task's work.

Null text or role is the empty text; null turns come first; null conv_id is a
conversation of its own. Repeated rows are turns of their own. An empty table
gives an empty result. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns that the next one is said to depend on, at most, by a template that declares ``append_only``.
CONTEXT = 32
LOSS_ROLE = "assistant"
_SPANS = ("conv_id bigint, position bigint, role string, rendered string, start bigint, "
          "body_start bigint, body_end bigint, in_loss boolean, rewrites boolean")
_FIELDS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()),
                     ("rendered", pa.string()), ("start", pa.int64()), ("body_start", pa.int64()),
                     ("body_end", pa.int64()), ("in_loss", pa.bool_()), ("rewrites", pa.bool_())])
_DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
            "formatted_chars bigint, rewrites boolean")
_DIGEST_FIELDS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                            ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])
#: Rows of an output batch.
_BATCH = 512


class EscapedTemplate:
    """Turns between ``<|im_start|>`` and ``<|im_end|>``.

    Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``
    (in roles a line feed becomes ``\\n`` too), so no control string of a text
    survives, and ``read`` gives back exactly what went in.
    """

    append_only = True
    START, END = "<|im_start|>", "<|im_end|>"
    _TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*)<\|im_end\|>\n", re.S)
    _ESCAPED = re.compile(r"\\(.)", re.S)

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def unescape(self, text: str) -> str:
        return self._ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)

    def render(self, turns: list[tuple[str, str]]) -> str:
        return "".join(f"{self.START}{self.escape(role).replace(chr(10), chr(92) + 'n')}\n"
                       f"{self.escape(text)}{self.END}\n" for role, text in turns)

    def read(self, turn: str) -> tuple[str, str]:
        """(role, text) of one rendered turn."""
        m = self._TURN.fullmatch(turn)
        if m is None:
            raise ValueError(f"not a turn of this template: {turn[:80]!r}")
        return self.unescape(m[1]), self.unescape(m[2])


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Conversation:
    """Renders the growing prefix of one conversation and locates each turn."""

    def __init__(self, template):
        self.template, self.prefix, self.text = template, [], ""
        self.length = 0        # of the formatted conversation so far
        self.rewrites = False

    @property
    def turns(self) -> list[tuple[str, str]]:
        """The turns that the next one may depend on by the template's own word; renderings take the whole prefix."""
        return self.prefix[-CONTEXT:] if vars(type(self.template)).get("append_only") else self.prefix

    def add(self, role: str, text: str) -> tuple[str, int, int, int]:
        """(rendered turn, start, body start, body end) of the next turn."""
        before, render = self.text, self.template.render
        now = render([*self.prefix, (role, text)])
        if not now.startswith(before):
            self.rewrites = True
        keep = _shared(before, now)
        span = now[keep:]
        # two texts without a common letter at either end leave only the frame in common
        a, b = (render([*self.prefix, (role, x)])[keep:] for x in "AB")
        head, tail = _shared(a, b), _shared(a[::-1], b[::-1])
        start = self.length - (len(before) - keep)
        self.length = start + len(span)
        self.prefix.append((role, text))
        self.text = now
        return span, start, start + head, start + len(span) - tail


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch[n].to_pylist() for n in names))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def format_turns(conversations: DataFrame, template, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per turn, in order within a partition: what it adds to the formatted
    conversation (``rendered``, from code point ``start``), the span of its body,
    whether the body is under the loss mask, and whether history was rewritten so far."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, talk, position, out = (), None, 0, []
        for batch in batches:
            for conv, role, text in _rows(batch, "conv_id", "role", "text"):
                if current != (conv,):
                    current, talk, position = (conv,), Conversation(template), 0
                rendered, start, lo, hi = talk.add(role or "", text or "")
                out.append((conv, position, role or "", rendered, start, lo, hi, role == loss_role, talk.rewrites))
                position += 1
                if len(out) >= _BATCH:
                    yield _batch(out, _FIELDS)
                    out = []
        if out:
            yield _batch(out, _FIELDS)

    return (conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(rows, _SPANS))


def digests(turns: DataFrame, template) -> DataFrame:
    """Per conversation, read back from the formatted turns (in the order of ``format_turns``)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = (), []
        n = loss_chars = chars = 0
        all_turns = loss = None
        rewrites = False

        def close() -> tuple:
            return (current[0], n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites)

        for batch in batches:
            for conv, rendered, start, lo, hi, in_loss, broken in _rows(
                    batch, "conv_id", "rendered", "start", "body_start", "body_end", "in_loss", "rewrites"):
                if current != (conv,):
                    if current:
                        out.append(close())
                    current, n, loss_chars, chars = (conv,), 0, 0, 0
                    all_turns, loss, rewrites = hashlib.sha256(), hashlib.sha256(), False
                role, text = template.read(rendered)
                all_turns.update(f"{role}\n{text}\n".encode())
                if in_loss:
                    body = template.unescape(rendered[lo - start:hi - start])
                    loss.update(body.encode())
                    loss_chars += len(body)
                n, chars, rewrites = n + 1, start + len(rendered), rewrites or broken
                if len(out) >= _BATCH:
                    yield _batch(out, _DIGEST_FIELDS)
                    out = []
        if current:
            out.append(close())
        if out:
            yield _batch(out, _DIGEST_FIELDS)

    return turns.mapInArrow(rows, _DIGESTS)


def format_digests(conversations: DataFrame, template=None) -> DataFrame:
    """Counts and digests of every conversation, formatted by ``template``."""
    template = template or EscapedTemplate()
    return digests(format_turns(conversations, template), template)
