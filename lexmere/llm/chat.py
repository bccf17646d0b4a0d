"""Chat formatting: a finite-state machine over roles, and a declarative template that says which text carries loss.

Control strings all start with `[` or `<`. Inside texts these two characters
and the backslash get a backslash before them, so control strings never occur
in a text and formatting can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Before each conversation.
BEGIN = "<s>"
#: Role -> segments: (control string, False), or (slot, loss) for the slots "{text}" and "{role}". Roles without an entry use None.
TEMPLATE: dict[str | None, tuple[tuple[str, bool], ...]] = {
    "system": (("[SYS] ", False), ("{text}", False), (" [/SYS]", False)),
    "user": (("[INST] ", False), ("{text}", False), (" [/INST]", False)),
    "assistant": (("[OUT] ", False), ("{text}", True), (" </s>", False)),
    None: (("[ROLE] ", False), ("{role}", False), (" [SAYS] ", False), ("{text}", False), (" [/ROLE]", False)),
}
#: State -> roles that may come next. Any other turn is formatted all the same, and its conversation marked as out of order.
NEXT: dict[str, tuple[str, ...]] = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

_ESCAPED = re.compile(r"\\(.)", re.S)
#: Escaped text up to the next control string.
_SLOT = r"((?:[^\\\[<]++|\\.)*+)"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("[", "\\[").replace("<", "\\<")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def segments(role: str | None, text: str | None) -> list[tuple[str, bool]]:
    """One turn's segments (text, loss). Null text: empty."""
    slots = {"{text}": text or "", "{role}": role or ""}
    return [(escaped(slots[s]) if s in slots else s, loss) for s, loss in TEMPLATE.get(role, TEMPLATE[None])]


def _reader(parts: tuple[tuple[str, bool], ...]) -> tuple[re.Pattern, list[tuple[str, int]]]:
    """The expression of one role's turns, and per slot its name and how many blanks before the next control string it also takes."""
    whole, slots = "", []
    for (s, _), (after, _) in zip(parts, [*parts[1:], ("", False)]):
        if s in ("{text}", "{role}"):
            whole += _SLOT
            slots.append((s, len(after) - len(after.lstrip())))
        else:
            whole += re.escape(s.lstrip() if slots else s)
    return re.compile(whole, re.S), slots


_READERS = {of[0][0]: (role, *_reader(of)) for role, of in TEMPLATE.items()}


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, pattern, slots = _READERS[formatted[: formatted.index(" ") + 1]]
    found = {"{role}": role}
    for (name, blanks), got in zip(slots, pattern.fullmatch(formatted).groups()):
        found[name] = unescaped(got[: len(got) - blanks])
    return found["{role}"] or "", found["{text}"]


def _dealt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, role, text), each conversation's turns together and in order."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def _machine(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bool, bool, list[tuple[str, bool]]]]]:
    """Runs the machine over dealt turns; yields per batch (conv, first turn, in order, segments) of each."""
    now, state = object(), ""
    for b in batches:
        out = []
        for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            first = c != now
            if first:
                now, state = c, ""
            order = role in NEXT.get(state, ())
            state = role if order else "out of order"
            out.append((c, first, order, segments(role, text)))
        yield out


def formatted_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, role, in_order, segments array<struct<text, loss>>), one row per turn, each conversation's rows together and in order.

    Turns are dealt by conversation and sorted by turn (ties by role, then
    text); tasks read them as a stream and hold one turn and the machine's
    state, so a conversation of any length needs constant memory. The first
    segment of a conversation is BEGIN.
    """
    schema = "conv long, in_order boolean, segments array<struct<text string, loss boolean>>"

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for rows in _machine(batches):
            segs = [[{"text": t, "loss": loss} for t, loss in [(BEGIN, False)] * first + parts] for _, first, _, parts in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(segs, kind)], names=["conv", "in_order", "segments"])

    return _dealt(turns, conv_col, turn_col, role_col, text_col).mapInArrow(of, schema)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, read back from its formatted text: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order, complete).

    Turns are formatted and read back in one pass; running hashes are all it
    holds. Null texts and roles count as empty; rows with a null conversation
    id form one conversation; repeated rows are turns of their own; an empty
    table gives an empty result; other columns are not read.
    """
    schema = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, complete boolean"

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        kept = None

        def row(k: list) -> list:
            conv, n, turns_hash, loss_chars, loss_hash, chars, in_order, last = k
            return [conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, in_order, last == "assistant"]

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for rows in _machine(batches):
            done = []
            for conv, first, order, parts in rows:
                if first:
                    if kept:
                        done.append(row(kept))
                    kept = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN), True, None]
                whole = "".join([t for t, _ in parts])
                role, text = read_turn(whole)
                kept[1] += 1
                kept[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for t, loss in parts:
                    if loss:
                        said = unescaped(t)
                        kept[3] += len(said)
                        kept[4].update(said.encode("utf-8", "replace"))
                kept[5] += len(whole)
                kept[6] &= order
                kept[7] = role
            if done:
                yield batch(done)
        if kept:
            yield batch([row(kept)])

    return _dealt(turns, conv_col, turn_col, role_col, text_col).mapInArrow(of, schema)
