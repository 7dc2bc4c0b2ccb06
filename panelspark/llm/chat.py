"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to text; nothing else is known about it.
The prefixes of a conversation are rendered one after the other, and what a longer prefix
adds behind the shorter one's text is the span of its last turn.  A template whose longer
rendering does not start with the shorter one rewrites history and is reported.  Where a
turn's content lies in its span is found by rendering, too: the same prefix with two probe
texts in place of the turn's own differs in the content alone.

Every prefix is rendered from the true start, and of the earlier one only its length and
hash are kept.  A template that the caller declares local, one that renders each turn from
the turn and the one before alone, is rendered in windows instead: each starts with the
last turn of the one before, whose rendering is cut off again.  That claim is checked: the
first turn of every window must come out the same behind one more turn, and the segments
of a conversation, up to ``WHOLE_CHARS``, must join to its one whole rendering.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, record

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

START, END = "<|im_start|>", "<|im_end|>"
#: Turns and characters after which a window ends.
WINDOW_TURNS, WINDOW_CHARS = 32, 200_000
#: Characters of a conversation that are held to compare its windows with one rendering.
WHOLE_CHARS = 4_000_000
#: Texts that no template renders alike, and that none escapes.
PROBES = ("x", "y")
LOSS_ROLE = "assistant"


class RewritesHistory(ValueError):
    """A template that changes what it has rendered for earlier turns."""


def escape(text: str) -> str:
    """Text in which no ``<|`` is left: a backslash goes behind ``<``, also behind ``<\\``..."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def marked_turns(turns: Turns) -> str:
    """The default template: each turn between marks, control strings in it escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def turn_segments(template: Template, turns: Turns, seen: int = 0) -> Iterator[str]:
    """What each turn after the first ``seen`` adds to the rendering of those before it."""
    before = template(turns[:seen]) if seen else ""
    length, digest = len(before), _digest(before)
    del before
    for k in range(seen + 1, len(turns) + 1):
        after = template(turns[:k])
        if len(after) < length or _digest(after[:length]) != digest:
            raise RewritesHistory(f"turn {k - 1} changes the text of earlier turns")
        yield after[length:]
        length, digest = len(after), _digest(after)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest()


def content_span(template: Template, before: Turns, turn: tuple[str, str], segment: str) -> tuple[int, int]:
    """Where in the ``segment`` of ``turn``, behind the turns ``before``, its content lies.

    What two probe texts have in common from the left and the right is the frame of the
    turn, which must be that of its own text; a turn without text may lack its frame.
    """
    base = len(template(before)) if before else 0
    one, two = (template([*before, (turn[0], probe)])[base:] for probe in PROBES)
    start = len(os.path.commonprefix([one, two]))
    rest = len(os.path.commonprefix([one[start:][::-1], two[start:][::-1]]))
    end = len(segment) - rest
    if start <= end and segment[:start] == one[:start] and segment[end:] == one[len(one) - rest :]:
        return start, end
    if not turn[1]:
        at = len(os.path.commonprefix([segment, one]))
        return at, at
    raise ValueError("the frame of a turn depends on its text")


def read_turn(segment: str, start: int, end: int) -> tuple[str, str]:
    """Role and text of a turn of the default template, read back from the formatted text."""
    return unescape_role(segment[len(START) : start - 1]), unescape(segment[start:end])


def _joined(template: Template, turns: Turns, digest: bytes) -> None:
    if _digest(template(turns)) != digest:
        raise RewritesHistory("windows of a template declared local differ from its whole rendering")


def format_stream(
    template: Template, turns: Iterator[tuple[str, str]], local: bool | None = None
) -> Iterator[tuple[str, str, str, int, int]]:
    """(role, text, segment, content start, content end) of each turn of one conversation.

    A local template's turns are held a window at a time; any other one needs them all, and
    time that grows with the square of the conversation.  By default only ``marked_turns``
    is local.
    """
    if not (template is marked_turns if local is None else local):
        whole = list(turns)
        for k, (t, s) in enumerate(zip(whole, turn_segments(template, whole), strict=True)):
            yield (*t, s, *content_span(template, whole[:k], t, s))
        return
    window: Turns = []
    chars = seen = 0
    held: Turns = []
    joined, held_chars = hashlib.blake2b(), 0

    def render() -> Iterator[tuple[str, str, str, int, int]]:
        nonlocal held_chars
        for k, (t, s) in enumerate(zip(window[seen:], turn_segments(template, window, seen), strict=True), seen):
            if held_chars <= WHOLE_CHARS:
                joined.update(s.encode("utf-8", "surrogatepass"))
                held_chars += len(s)
                held.append(t)
                if held_chars > WHOLE_CHARS:
                    _joined(template, held, joined.digest())
                    held.clear()
            try:
                span = content_span(template, window[max(k - 1, 0) : k], t, s)
            except ValueError as e:
                raise RewritesHistory("the frame of a turn depends on its text or on more than the turn before") from e
            yield (*t, s, *span)

    def seam(two: Turns, turn: tuple[str, str]) -> None:
        """A turn must come out the same behind one turn and behind two."""
        short, long = two[1:], two
        if template([*short, turn])[len(template(short)) :] != template([*long, turn])[len(template(long)) :]:
            raise RewritesHistory("a template declared local looks at more than the turn before")

    last: Turns = []
    for turn in turns:
        if len(last) == 2 and len(window) == seen:
            seam(last, turn)
        window.append(turn)
        chars += len(turn[1])
        if len(window) - seen >= WINDOW_TURNS or (chars >= WINDOW_CHARS and len(window) > seen + 1):
            yield from render()
            last = window[-2:]
            window, seen, chars = window[-1:], 1, 0
    yield from render()
    if held:
        _joined(template, held, joined.digest())


class _Stream:
    """Rows of a sorted stream, one conversation after the other."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = (
            row
            for b in batches
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)
        )
        self.next = next(self.rows, None)

    def conversation(self) -> Iterator[tuple[str, str]]:
        conv = self.next[0]
        while self.next is not None and self.next[0] == conv:
            row, self.next = self.next, next(self.rows, None)
            yield row[2] or "", row[3] or ""


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, template: Template = marked_turns, loss_role: str = LOSS_ROLE, local: bool | None = None) -> DataFrame:
    """(conv_id, turn_no, segment, content_start, content_end, loss) for every turn, in order.

    The formatted conversation is its segments one after the other; ``content_start`` and
    ``content_end`` count within the segment, and ``loss`` marks the turns whose content a
    model is trained on.  Turns are ordered by turn, role and text, nulls first; null role
    or text is empty; rows with a null conv_id are one conversation; repeated rows are turns
    of their own.  Rows of a conversation stay together and in order in their partition.
    A conversation may be long: the turns of a ``local`` template, as ``marked_turns`` is, are
    streamed through a window.  ``template`` may be any function of the turns; where it
    escapes texts, ``digests`` needs its inverse.
    """
    # told here: a task's copy of the function is another object
    local = template is marked_turns if local is None else local
    ddl = "conv_id long, turn_no long, segment string, content_start long, content_end long, loss boolean"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, chars = _Stream(batches), [], 0
        while stream.next is not None:
            conv = stream.next[0]
            for no, (role, _, segment, a, b) in enumerate(format_stream(template, stream.conversation(), local)):
                rows.append((conv, no, segment, a, b, role == loss_role))
                chars += len(segment)
                if chars > 2_000_000 or len(rows) >= 4096:
                    yield record(rows, schema)
                    rows, chars = [], 0
        if rows:
            yield record(rows, schema)

    return _ordered(turns).mapInArrow(run, ddl)


def digests(formatted: DataFrame, read: Callable[[str, int, int], tuple[str, str]] = read_turn) -> DataFrame:
    """One row per conversation, read back from the formatted turns in their order.

    ``read`` gives role and text from a segment and its content's ends: the inverse of the
    template, by default that of ``marked_turns``.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_conv, state = [], None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "content_start", "content_end", "loss")]
            for conv, segment, a, b, loss in zip(*columns, strict=True):
                if state is None or conv != open_conv:
                    if state is not None:
                        done.append((open_conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    open_conv, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read(segment, a, b)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
                if loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
            if done:
                yield record(done, schema)
                done = []
        if state is not None:
            yield record([(open_conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])], schema)

    return formatted.mapInArrow(run, ddl)
