"""Chat formatting whose output provably reads back.

Grammar of a formatted conversation:

    conversation = "<s>" turn* "</s>"
    turn         = "[INST]" role "|" level "\\n" text "[/INST]"

`role` is the role with every character that is not a letter, digit, `_` or `-`
written as `%` and its code point in hex and `;`. `level` is 0 or more digits 1, the number of
times the text was escaped. One escape writes a backslash before each backslash and
after the first character of each control string. parse() reads this grammar
deterministically, one turn after another, and undoes the escapes.

A turn is rendered without escapes, with what precedes and follows it, parsed again
and compared with its source; as long as anything differs its text is escaped once
more. Escaped text holds no control string, so that one escape is enough.

Turns are rendered and checked row by row in any order, and get the range of the loss mask within
them: an assistant's text as written. Then a conversation's rows go to one task in the order of turns,
which puts the conversation together as a stream, reads it back with a parser that takes it piece by piece, and hashes what it
reads; the loss figures are of the unescaped text under the mask. No more than one turn is kept in memory, so a conversation of any
length fits; its hash is of ordered text, so one conversation is the work of one task.

Defined results: null text is empty; null role is the empty role; turns are ordered
by turn (null first), then role, then text; repeated rows are turns of their own;
rows with null conv_id form one conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (END, BEGIN, CLOSE, OPEN)
LEARNT = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_SPECIAL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\\\|([<\[])\\")
_HEAD = re.compile(r"\[INST\]([^|\n]*)\|(1*)\n")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "\\", text)


def _role_out(role: str) -> str:
    return re.sub(r"[^A-Za-z0-9_\-]", lambda m: f"%{ord(m[0]):x};", role)


def _role_in(role: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), role)


@dataclass
class Turn:
    role: str
    body: str  # as written
    level: int  # how often it was escaped
    start: int  # of the body, in code points from the conversation's beginning
    end: int

    def plain(self, written: str) -> str:
        """What was escaped to `written` in this turn."""
        for _ in range(self.level):
            written = unescape(written)
        return written

    @property
    def text(self) -> str:
        return self.plain(self.body)


class Reader:
    """The parser of a formatted conversation that comes in pieces, cut anywhere; it keeps what belongs to an unfinished turn."""

    def __init__(self):
        self.open, self.rest, self.at = False, "", 0  # `at`: where rest begins in the conversation

    @property
    def chars(self) -> int:
        return self.at + len(self.rest)

    def feed(self, piece: str) -> Iterator[Turn]:
        """The turns that the piece completes."""
        self.rest += piece
        if not self.open:
            if not self.rest.startswith(BEGIN[: len(self.rest)]):
                raise GrammarError("no beginning")
            if len(self.rest) < len(BEGIN):
                return
            self.open, self.rest, self.at = True, self.rest[len(BEGIN) :], len(BEGIN)
        while head := _HEAD.match(self.rest):
            stop = _CONTROL.search(self.rest, head.end())
            if not stop:
                return
            if stop[0] != CLOSE:
                raise GrammarError(f"turn at {self.at} isn't closed")
            turn = Turn(_role_in(head[1]), self.rest[head.end() : stop.start()], len(head[2]), self.at + head.end(), self.at + stop.start())
            self.rest, self.at = self.rest[stop.end() :], self.at + stop.end()
            yield turn

    def close(self) -> None:
        if not self.open or self.rest != END:
            raise GrammarError(f"unexpected text at {self.at}")


def parse(text: str) -> list[Turn]:
    """The turns of a whole formatted conversation."""
    reader = Reader()
    turns = list(reader.feed(text))
    reader.close()
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn, escaped just as often as it takes to read back the same within a conversation."""
    body, level = text, 0
    while True:
        out = f"{OPEN}{_role_out(role)}|{'1' * level}\n{body}{CLOSE}"
        try:
            if [(t.role, t.text) for t in parse(f"{BEGIN}{out}{OPEN}x|\n{CLOSE}{END}")] == [(role, text), ("x", "")]:
                return out
        except GrammarError:
            pass
        body, level = escape(body), level + 1


def render(turns: Iterable[tuple[str, str]]) -> str:
    return BEGIN + "".join(render_turn(r, t) for r, t in turns) + END


def _text(value: str | None) -> str:
    return "" if value is None else value


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted (the rendered turn), mask_start, mask_end: the code points of it that a loss counts, an assistant's text; null for others."""
    small_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            pairs = [(_text(r), _text(t)) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            made = [render_turn(*p) for p in pairs]
            learnt = [r == LEARNT for r, _ in pairs]
            start = [x.index("\n") + 1 if yes else None for x, yes in zip(made, learnt, strict=True)]
            end = [len(x) - len(CLOSE) if yes else None for x, yes in zip(made, learnt, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()),
                 pa.array(made, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["conv_id", "turn", "role", "text", "formatted", "mask_start", "mask_end"],
            )

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return clean.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, mask_start long, mask_end long")


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """Figures of one conversation, read back from its pieces as they come."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.reader, self.turns, self.chars = conv_id, Reader(), 0, 0
        self.read, self.loss = hashlib.sha256(), hashlib.sha256()
        self.add(BEGIN, None)

    def add(self, piece: str, mask: tuple[int, int] | None) -> None:
        """A piece of the conversation and the range of it under the mask."""
        base = self.reader.chars
        for turn in self.reader.feed(piece):
            self.turns += 1
            self.read.update(f"{turn.role}\n{turn.text}\n".encode())
            if mask is not None and turn.start - base <= mask[0] and mask[1] <= turn.end - base:
                text = turn.plain(piece[mask[0] : mask[1]])
                self.chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> dict:
        self.add(END, None)
        self.reader.close()
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.read.hexdigest(), "loss_chars": self.chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.reader.chars}


def _digests(rows: Iterable[tuple]) -> Iterator[dict]:
    """Rows (conv_id, formatted, mask_start, mask_end) of a conversation after another; one result each."""
    now = None
    for conv, made, start, end in rows:
        if now is None or conv != now.conv_id:
            if now is not None:
                yield now.row()
            now = Digest(conv)
        now.add(made, None if start is None else (start, end))
    if now is not None:
        yield now.row()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, from what was read back from its formatted turns."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_end")), strict=True)

        out = []

        def batch():
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for d in _digests(rows()):
            out.append(d)
            if len(out) >= 5000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(run, _DIGESTS)


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def loss_spans(conversation: str) -> list[tuple[int, int]]:
    """Ranges of code points of a formatted conversation under the loss mask: the assistant texts as written."""
    return [(t.start, t.end) for t in parse(conversation) if t.role == LEARNT]


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(role, '[^A-Za-z0-9_\-]', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(role, '[^A-Za-z0-9_\-]'), lambda x: length(printf('%x', unicode(x))) + 2)), 0) AS role_chars,
    length(regexp_replace(text, '</s>|<s>|\[/INST\]|\[INST\]', '', 'g')) <> length(text) AS bad,
    length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</s>|<s>|\[/INST\]|\[INST\]')) AS escapes FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (7 + sum(6 + role_chars + 1 + bad::INT + 1 + length(text) + CASE WHEN bad THEN escapes ELSE 0 END + 7))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
