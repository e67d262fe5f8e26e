"""Chat formatting with a grammar round trip.

Grammar: a conversation is its turns end to end; a turn is `open` text `close` of its role (ROLES), other roles stand as
`[ROLE]` role `[:]` text `[/ROLE]`. Inside role and text a backslash makes the next character plain, and no control string
but the one that ends them may stand there. A turn is first rendered as it stands, read back by the deterministic parser,
and compared with its source. Where it doesn't come back, conflicting content is escaped (ESCAPES: first control strings, then
backslashes, too) and the round trip is made again, until the same turn comes back; the comparison alone decides. With all of it
escaped no plain control string or lone backslash is left, so the last round trip always ends it. As a turn's reading ends at
its own close, turns that come back alone also come back in a row; reading back parses the joined string and knows no borders.

The loss mask of a turn is the place of an assistant's text inside the rendered turn, without what frames it.

Null texts and roles are empty strings; an empty text is a turn. Turns go by turn number (nulls first), ties by role,
then text; repeated rows are turns of their own; rows of a null conversation are one conversation. An empty table gives
an empty result; extra columns are ignored. Rendering is row by row; reading back streams over rows sorted by
conversation and carries running digests, so even one conversation with a third of all rows needs only one row's memory. A
conversation's digests are sequential, so that its turns pass through one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What opens and closes a turn of a role.
ROLES = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ASST] ", " </s>")}
OTHER = ("[ROLE] ", " [:] ", " [/ROLE]")
CONTROL = ["[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ASST]", "</s>", "<s>", "[ROLE]", "[:]", "[/ROLE]"]
LOSS = "assistant"
_control = re.compile("|".join(re.escape(c) for c in CONTROL))
_special = re.compile(_control.pattern + r"|\\", re.S)
_plain = re.compile(r"\\(.)", re.S)
#: A control string, or a backslash and what it makes plain.
_stops = re.compile(r"\\.?|" + _control.pattern, re.S)


#: What is escaped, by round.
ESCAPES = (lambda text: text, lambda text: _control.sub(lambda m: "\\" + m[0], text), lambda text: _special.sub(lambda m: "\\" + m[0], text))


def unescape(text: str) -> str:
    return _plain.sub(r"\1", text) if "\\" in text else text


def frame(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, begin and end of the text in it)."""
    if role in ROLES:
        start, end = ROLES[role]
    else:
        start, end = OTHER[0] + role + OTHER[1], OTHER[2]
    return start + text + end, len(start), len(start) + len(text)


def until(s: str, at: int, end: str) -> int:
    """Where `end` stands after at, nothing but plain text and escapes before it; -1 if s ends first; ValueError at another control string."""
    lead = len(end) - len(end.lstrip())
    for m in _stops.finditer(s, at):
        if m[0][0] != "\\":
            k = m.start() - lead
            if k >= at and end.startswith(s[k : k + len(end)]):
                return k if len(s) - k >= len(end) else -1
            raise ValueError(f"{m[0]} at {m.start()}")
    return -1


def parse_turn(s: str, at: int) -> tuple[str, str, int, int, int] | None:
    """(role, text, begin and end of the escaped text, end of the turn) of the turn at `at`; None if s ends inside it, ValueError outside the grammar."""
    for role, (start, end) in ROLES.items():
        if s.startswith(start, at):
            begin = at + len(start)
            break
    else:
        if not s.startswith(OTHER[0], at):
            if any(start.startswith(s[at : at + len(start)]) for start in [OTHER[0], *(start for start, _ in ROLES.values())]):
                return None
            raise ValueError(f"no turn at {at}")
        if (middle := until(s, at + len(OTHER[0]), OTHER[1])) < 0:
            return None
        role, begin, end = unescape(s[at + len(OTHER[0]) : middle]), middle + len(OTHER[1]), OTHER[2]
    stop = until(s, begin, end)
    return None if stop < 0 else (role, unescape(s[begin:stop]), begin, stop, stop + len(end))


def parse(s: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin and end of the escaped text in s) of each turn; ValueError where s is outside the grammar."""
    at = 0
    while at < len(s):
        turn = parse_turn(s, at)
        if turn is None:
            raise ValueError(f"the turn at {at} has no end")
        yield turn[:4]
        at = turn[4]


def comes_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> tuple[str, int, int, bool]:
    """(rendered turn, begin and end of its text, whether it had to be escaped)."""
    for k, escape in enumerate(ESCAPES):
        out = frame(role if role in ROLES else escape(role), escape(text))
        if comes_back(out[0], role, text):
            return *out, k > 0
    raise AssertionError("an escaped turn must come back")


RENDERED = "conv_id bigint, turn bigint, role string, rendered string, text_begin int, text_end int, mask_begin int, mask_end int, escaped boolean"


def rendering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles = [r or "" for r in batch.column(2).to_pylist()]
        made = [render(r, t or "") for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
        loss = [r == LOSS for r in roles]
        columns = [
            pa.array(roles, pa.string()),
            pa.array([m[0] for m in made], pa.string()),
            pa.array([m[1] for m in made], pa.int32()),
            pa.array([m[2] for m in made], pa.int32()),
            pa.array([m[1] if own else 0 for m, own in zip(made, loss, strict=True)], pa.int32()),
            pa.array([m[2] if own else 0 for m, own in zip(made, loss, strict=True)], pa.int32()),
            pa.array([m[3] for m in made], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in RENDERED.split(", ")])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered, text_begin, text_end (place of the text), mask_begin, mask_end (the loss mask; 0, 0 for none), escaped of every row.

    A conversation's string is its turns' `rendered`, in order, end to end.
    """
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(rendering, RENDERED)


class Reading:
    """Running digests of a conversation whose string is read piece by piece, whatever the pieces' borders."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""  # read, but not yet a whole turn

    def add(self, piece: str, begin: int, end: int) -> None:
        """begin, end: the loss mask in the piece."""
        self.chars += len(piece)
        under = unescape(piece[begin:end])
        self.loss_chars += len(under)
        self.loss.update(under.encode())
        string, at = self.rest + piece, 0
        while at < len(string) and (turn := parse_turn(string, at)):
            self.turns += 1
            self.all.update(f"{turn[0]}\n{turn[1]}\n".encode())
            at = turn[4]
        self.rest = string[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("the conversation ends inside a turn")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation to one digest row each."""
    now: Reading | None = None
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in READ.split(", ")])

    for batch in batches:
        rows = []
        for conv, rendered, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "mask_begin", "mask_end")), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    rows.append(now.row())
                now = Reading(conv)
            now.add(rendered, begin, end)
        if rows:
            yield made(rows)
    if now is not None:
        yield made([now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row of digests for each conversation, all from the rendered turns and their masks."""
    text = F.regexp_replace(F.expr("substring(rendered, text_begin + 1, text_end - text_begin)"), r"(?s)\\(.)", "$1")
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text).mapInArrow(reading, READ)
