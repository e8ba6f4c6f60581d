"""Chat formatting: a finite-state machine over roles and a declarative template.

A template is data: what opens and closes a turn of each role, whether its text
counts for the loss, which role may follow which, and which strings are
controls.  Turns are put in order by a range sort, so a conversation may span
tasks; each task streams its rows into *pieces*, runs of whole turns of one
conversation as text segments with a loss flag, beside what the machine does
over them from each state it could start in.  Such moves compose, so the order
of turns is judged without any conversation in one task.

Reading back parses the pieces' text by the template alone.  Conversations that
lie inside one piece are read where they are; pieces of the others are
brought together and read as a stream, as a digest needs their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import small_batches, stored, tidy, work_dir

#: Characters of a piece, but for a longer single turn.
PIECE = 1 << 20
SEGMENTS = "array<struct<text:string,loss:boolean>>"
MOVES = "array<struct<state:int,bad:long>>"


@dataclass(frozen=True)
class Turn:
    """What stands before and after a turn's text, and whether the text is learned."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns are written and in which order they may come.

    ``turns`` by role; ``other`` writes any other role, its name between
    ``opens`` and ``named``.  ``follows`` gives the roles that may come after
    each state: the role before, or ``start``.  ``ends``: roles that may end a
    conversation.  ``controls`` never occur in a written text: ``escape`` is put
    behind the first character of each of them and behind each ``escape``.
    """

    turns: dict[str, Turn]
    other: Turn
    named: str
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    controls: tuple[str, ...]
    escape: str = "\\"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        every = [*self.turns.values(), self.other]
        opens = [t.opens for t in every]
        closes = [t.closes for t in every] + [self.named]
        if any(len(c) < 2 or self.escape in c for c in self.controls) or len(self.escape) != 1:
            raise ValueError("controls have two characters at least and none of them is the escape")
        if any(not any(c in mark for c in self.controls) for mark in opens + closes):
            raise ValueError("every mark holds a control")
        if any(a != b and b.startswith(a) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("no opening mark begins another")
        if any(c[:n] == c[-n:] for c in closes for n in range(1, len(c))):
            raise ValueError("no closing mark ends as it begins")
        if not {"start"} <= set(self.follows) <= {"start", *self.turns} or not {r for f in self.follows.values() for r in f} <= set(self.turns):
            raise ValueError("order of roles that have no turn")
        object.__setattr__(self, "states", ("start", *self.turns))

    def __hash__(self):
        return hash((self.controls, self.escape, self.named))

    @property
    def escaping(self) -> re.Pattern:
        return re.compile("|".join([re.escape(self.escape), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))


#: The template of the query.
CHAT = Template(
    turns={"system": Turn("<<SYS>>\n", " <</SYS>>\n"), "user": Turn("<s>[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", " </s>\n", loss=True)},
    other=Turn("[ROLE] ", " [/TURN]\n"),
    named="[/ROLE] ",
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]"),
)


class Writer:
    """Turns as segments, by a template."""

    def __init__(self, template: Template):
        self.t, self.escaping = template, template.escaping
        self.state = {s: i for i, s in enumerate(template.states)}

    def escaped(self, text: str) -> str:
        return self.escaping.sub(lambda m: m[0] + self.t.escape, text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        turn = self.t.turns.get(role)
        head = turn.opens if turn else self.t.other.opens + self.escaped(role) + self.t.named
        turn = turn or self.t.other
        return [(head, False), (self.escaped(text), turn.loss), (turn.closes, False)]

    def move(self, state: int, role: str) -> tuple[int, bool]:
        """The state after a turn, and whether the turn may stand there; a turn out of order is taken as it is."""
        return self.state.get(role, state) if role != "start" else state, role in self.t.follows.get(self.t.states[state], ())


class Reader:
    """Turns from formatted text, by a template."""

    def __init__(self, template: Template):
        self.t = template
        self.escapes = re.compile(re.escape(template.escape) + "(.)", re.S)
        self.by_opening = {turn.opens: (role, turn) for role, turn in template.turns.items()}
        self.opening = re.compile("|".join(map(re.escape, [*self.by_opening, template.other.opens])))

    def plain(self, text: str) -> str:
        return self.escapes.sub(r"\1", text) if self.t.escape in text else text

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = self.opening.match(text, at)
            if not m:
                raise ValueError("no turn begins here")
            at, (role, turn) = m.end(), self.by_opening.get(m[0], (None, self.t.other))
            if role is None:
                end = text.index(self.t.named, at)
                role, at = self.plain(text[at:end]), end + len(self.t.named)
            end = text.index(turn.closes, at)
            yield role, self.plain(text[at:end])
            at = end + len(turn.closes)


def _joined(segments):
    """Neighbours of one flag as one segment; empty ones go."""
    out: list[list] = []
    for text, loss in segments:
        if out and out[-1][1] == loss:
            out[-1][0].append(text)
        elif text:
            out.append([[text], loss])
    return [{"text": "".join(t), "loss": loss} for t, loss in out]


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def _conv_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def format_conversations(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Pieces of formatted conversations, from rows (conv_id, turn, role, text).

    Returns conv_id, piece (ascending within a conversation), inner (the piece is
    the whole conversation), n_turns, segments (text and loss flag; their texts
    joined are the formatted text) and moves (for each state of the template: the
    state after the piece, and its first turn out of order, or -1).  Rows go by
    turn (null first), then role, then a hash of the text; repeated rows all
    stay.  A null text or role is empty; rows without conv_id are one
    conversation.  Very long texts are pieces of their own; an empty table gives
    no rows; other columns are left aside.
    """
    small_batches(conversations.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h", "text").select("conv_id", "role", "text")

    def run(batches):
        writer, schema = Writer(template), None
        part = TaskContext.get().partitionId() << 33
        conv, first, number = None, True, 0
        turns: list[tuple[str, str]] = []
        size, several, ready, ready_size = 0, False, [], 0

        def piece(inner: bool):
            nonlocal number, turns, size
            segments = _joined(s for role, text in turns for s in writer.segments(role, text))
            moves = []
            for state in range(len(template.states)):
                bad = -1
                for i, (role, _) in enumerate(turns):
                    state, fits = writer.move(state, role)
                    bad = i if bad < 0 and not fits else bad
                moves.append({"state": state, "bad": bad})
            row = (conv, part + number, inner, len(turns), segments, moves)
            number, turns, size = number + 1, [], 0
            return row

        for batch in batches:
            if schema is None:
                moved = pa.list_(pa.struct([("state", pa.int32()), ("bad", pa.int64())]))
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("piece", pa.int64()), ("inner", pa.bool_()), ("n_turns", pa.int64()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("moves", moved)])
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if turns and c != conv:
                    ready_size += size
                    ready.append(piece(not first and not several))
                    first, several = False, False
                elif size and size + len(text) > PIECE:
                    ready_size += size
                    ready.append(piece(False))
                    several = True
                conv = c
                turns.append((role, text))
                size += len(text) + 1
                if ready_size > PIECE or len(ready) > 5000:
                    yield _as_batch(ready, schema)
                    ready, ready_size = [], 0
        if turns:
            ready.append(piece(False))
        if ready:
            yield _as_batch(ready, schema)

    return rows.mapInArrow(tidy(run), f"conv_id {_conv_type(conversations)}, piece long, inner boolean, n_turns long, segments {SEGMENTS}, moves {MOVES}")


def segments(pieces: DataFrame) -> DataFrame:
    """Pieces as rows: conv_id, piece, segment, text, loss."""
    return pieces.select("conv_id", "piece", F.posexplode("segments").alias("segment", "s")).select("conv_id", "piece", "segment", "s.text", "s.loss")


def read_back(pieces: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of conversations, from their written pieces.

    Returns conv_id, n_turns, turns_sha256 (of role, newline, text, newline a
    turn), loss_chars and loss_sha256 (of the texts under the loss flag,
    unescaped), formatted_chars, valid (every turn in order and the last one may
    be last) and bad_turn (the first turn out of order, counted from 0; null if
    there is none).  Text that the template didn't write raises.
    """

    def run(batches):
        reader, schema, conv, now = Reader(template), None, None, None
        ends = {i for i, s in enumerate(template.states) if s in template.ends}

        def done():
            n, turns, loss_n, loss, chars, state, bad = now
            return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, bad < 0 and state in ends, None if bad < 0 else bad

        for batch in batches:
            out = []
            schema = schema or pa.schema(
                [("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("bad_turn", pa.int64())]
            )
            for c, parts, moves in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or c != conv:
                    if now is not None:
                        out.append(done())
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, -1]
                text = "".join(s["text"] for s in parts)
                before = now[0]
                for role, said in reader.turns(text):
                    now[1].update(f"{role}\n{said}\n".encode())
                    now[0] += 1
                for s in parts:
                    if s["loss"]:
                        plain = reader.plain(s["text"])
                        now[2] += len(plain)
                        now[3].update(plain.encode())
                now[4] += len(text)
                move = moves[now[5]]
                now[6] = before + move["bad"] if now[6] < 0 <= move["bad"] else now[6]
                now[5] = move["state"]
            if out:
                yield _as_batch(out, schema)
        if now is not None:
            yield _as_batch([done()], schema)

    small_batches(pieces.sparkSession)
    cols = ("conv_id", "segments", "moves")
    shape = f"conv_id {_conv_type(pieces)}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn long"
    whole = pieces.where("inner").select(*cols).mapInArrow(tidy(run), shape)
    split = pieces.where("not inner").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*cols).mapInArrow(tidy(run), shape)
    return whole.unionAll(split)


def chat_query(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Formats all conversations and conversation -1, writes the pieces and reads them back."""
    spark = conversations.sparkSession
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(stored(format_conversations(rows, template), work_dir(spark), "chat"), template)
