"""Chat formatting: records of many layouts, recognised by a fingerprint of their field paths, become canonical turns.

1. Fingerprint: the sorted set of a JSON record's nested field paths (``.messages[].role``) is hashed. A declared layout
   lists its paths, some of them optional, and so owns a fixed set of fingerprints; equal hash, equal layout, whatever
   the order or number of fields and items. A record of an unknown fingerprint is returned as such, never guessed at.
2. Mapping: a layout says which paths make a turn: a fixed role or a role path, and one or more text paths.
3. Template: ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts are broken by a backslash mark,
   backslashes are doubled, so no text can end a turn and every text can be read back.
4. Pieces: turns are range-partitioned and sorted by conversation and turn, then streamed into pieces of bounded size, so a
   conversation with a third of all turns is spread over tasks. A piece carries its loss mask: spans of assistant text.

:func:`read_back` parses pieces and digests each conversation. Conversations inside one piece need no shuffle; the others
are sorted together and streamed, with constant memory (a digest of one conversation is sequential by its definition).

Cases: a null text or role is an empty one. A null ``conv_id`` is one conversation. Turns of equal number are in order of
their place in the record, role and text, nulls first; equal rows are all kept. A record that is null, no JSON object or
of no known layout gives one row with a null ``layout``; an empty list of messages gives no turn. Null items of a list are passed
over. Very long texts are rows of their own piece. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and those of a widespread instruction template.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]")
#: Role under the loss mask.
LEARNED = "assistant"
#: Code points after which a piece ends with its turn.
PIECE = 1 << 20


@dataclass(frozen=True)
class Turn:
    """One turn for a record, or one for each item of the list at ``each``. ``role`` is fixed or, with a dot first, a path."""

    role: str
    text: tuple[str, ...]
    each: str = ""


@dataclass(frozen=True)
class Layout:
    """Paths of a record: ``needed`` ones, ``optional`` ones, and the turns they make. ``roles`` renames role values."""

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turn, ...]
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("prompt", (), (".system", ".prompt", ".completion"),
           (Turn("system", (".system",)), Turn("user", (".prompt",)), Turn("assistant", (".completion",)))),
    Layout("instruction", (), (".context", ".instruction", ".input", ".output"),
           (Turn("system", (".context",)), Turn("user", (".instruction", ".input")), Turn("assistant", (".output",)))),
    Layout("messages", (), (".messages[]?", ".messages[].role", ".messages[].content"), (Turn(".role", (".content",), ".messages"),)),
    Layout("message parts", (".messages[].content[].text",), (".messages[]?", ".messages[].role", ".messages[].content[]?", ".messages[].content[].type"), (Turn(".role", (".content[].text",), ".messages"),)),
    Layout("shared", (), (".conversations[]?", ".conversations[].from", ".conversations[].value"), (Turn(".from", (".value",), ".conversations"),),
           (("human", "user"), ("gpt", "assistant"))),
)


def field_paths(value, at: str = "") -> Iterator[str]:
    """Paths of all values that are not null; a list without any, or with an item without any, also has a path ending in ``?``."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from field_paths(inner, at + "." + re.sub(r"([.\[?\\])", r"\\\1", name))
    elif isinstance(value, list):
        for found in [list(field_paths(inner, at + "[]")) for inner in value] or [[]]:
            yield from found or [at + "[]?"]
    elif value is not None:
        yield at


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def known_layouts(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Every fingerprint that a layout owns: its needed paths with any of its optional ones. The first layout keeps a shared one."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for some in itertools.combinations(layout.optional, n):
                if layout.needed or some:
                    out.setdefault(fingerprint({*layout.needed, *some}), layout)
    return out


def _texts(item: dict, path: str) -> Iterator[str]:
    """Values at ``.name`` or ``.name[].name`` of an item, as text."""
    name, _, inner = path[1:].partition("[]")
    for value in (item.get(name) or []) if inner else [item.get(name)]:
        value = value.get(inner[1:]) if inner and value is not None else value
        if value is not None:
            yield value if isinstance(value, str) else json.dumps(value)


def mapped_turns(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that a record's layout declares."""
    names = dict(layout.roles)
    for turn in layout.turns:
        for item in (record.get(turn.each[1:]) or []) if turn.each else [record]:
            if item is None:
                continue
            texts = [t for path in turn.text for t in _texts(item, path)]
            if turn.role.startswith("."):
                role = next(_texts(item, turn.role), "")
                yield names.get(role, role), "".join(texts)
            elif texts:
                yield turn.role, "\n\n".join(texts)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, pos, role, text, layout, fingerprint`` from ``conv_id, turn, record`` (JSON text).

    ``pos`` is the place of a turn in its record. A record without a known layout is one row with a null ``layout`` and ``pos``.
    """
    known = known_layouts(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, pos, role, text, name, marks = [], [], [], [], [], []
            for i, raw in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                    mark = fingerprint(set(field_paths(record))) if isinstance(record, dict) else None
                except (ValueError, RecursionError):
                    mark = None
                layout = known.get(mark) if mark else None
                found = [(None, None, None)] if layout is None else [(n, r, t) for n, (r, t) in enumerate(mapped_turns(record, layout))]
                for n, r, t in found:
                    source.append(i), pos.append(n), role.append(r), text.append(t), name.append(layout and layout.name), marks.append(mark)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(at), batch.column("turn").take(at), pa.array(pos, pa.int32()), pa.array(role, pa.string()),
                                              pa.array(text, pa.string()), pa.array(name, pa.string()), pa.array(marks, pa.string())],
                                             names=["conv_id", "turn", "pos", "role", "text", "layout", "fingerprint"])

    kinds = [f"{c} {records.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn")]
    return records.select("conv_id", "turn", "record").mapInArrow(run, ", ".join([*kinds, "pos int, role string, text string, layout string, fingerprint string"]))


def escaped(text: Column) -> Column:
    """``text`` without a control string: backslashes are doubled, and a control string's first character is followed by ``\\-``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\-" + control[1:]))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(-|\\)", lambda m: "" if m[1] == "-" else "\\", text) if "\\" in text else text


PIECES = "piece bigint, text string, mask array<struct<start:bigint,end:bigint>>, whole boolean"


def _pieces(rows: Iterator[tuple], part: int, size: int) -> Iterator[tuple]:
    """Pieces of sorted turns ``(conv_id, markup, n, at, learned)``; ``whole`` pieces hold all of a conversation that no other task can share."""
    conv, texts, mask, chars, nth, of_conv, opened = None, [], [], 0, 0, 0, False
    first = True

    def piece(whole: bool) -> tuple:
        return conv, (part << 32) + nth, "".join(texts), mask, whole

    for key, markup, n, at, learned in rows:
        if opened and (key != conv or chars >= size):
            done = key != conv
            yield piece(done and of_conv == 0 and not first)
            nth, texts, mask, chars = nth + 1, [], [], 0
            of_conv, first = (0, False) if done else (of_conv + 1, first)
        conv, opened = key, True
        if learned is not None:
            mask.append({"start": chars + at, "end": chars + at + learned})
        texts.append(markup)
        chars += n
    if opened:
        yield piece(False)


def format_chats(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, piece, text, mask, whole``: the markup of all turns; the pieces of a conversation, in order, are its text.

    ``mask`` holds the spans of assistant text as code points of the piece, end excluded.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    drawn = (turns.select("conv_id", "turn", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("plain"), role.alias("r"), text.alias("t"))
             .repartitionByRange("conv_id", "turn", "pos", "role", F.substring("plain", 1, 32))
             .sortWithinPartitions("conv_id", "turn", "pos", "role", "plain"))
    at = F.length("r") + len(TURN) + len(BODY)
    markup = drawn.select("conv_id", F.concat(F.lit(TURN), "r", F.lit(BODY), "t", F.lit(END)).alias("markup"), (at + F.length("t") + len(END)).alias("n"), at.alias("at"),
                          F.when(F.col("role") == LEARNED, F.length("t")).alias("learned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        kind = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field("conv_id").type]
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "markup", "n", "at", "learned")), strict=True)

        made = _pieces(rows(), TaskContext.get().partitionId(), size)
        while some := list(itertools.islice(_limited(made, 16 * size), 10_000)):
            conv, piece, texts, masks, whole = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, kind[0]), pa.array(piece, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(whole, pa.bool_())],
                names=["conv_id", "piece", "text", "mask", "whole"])

    return markup.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {PIECES}")


def _limited(pieces: Iterator[tuple], chars: int) -> Iterator[tuple]:
    """Pieces until their texts hold ``chars`` code points."""
    total = 0
    while total < chars and (piece := next(pieces, None)) is not None:
        total += len(piece[2])
        yield piece


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns of a piece."""
    for turn in text.split(END)[:-1]:
        role, _, body = turn[len(TURN):].partition(BODY)
        yield unescaped(role), unescaped(body)


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest_stream(pieces: DataFrame) -> DataFrame:
    """One digest for each run of pieces of one conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, state = None, None

        def row() -> tuple:
            n, turns, chars, loss, formatted = state
            return open_conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = None
        for batch in batches:
            kind, rows = batch.schema.field("conv_id").type, []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "mask")), strict=True):
                if state is None or conv != open_conv:
                    rows += [row()] if state is not None else []
                    open_conv, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in mask:
                    learned = unescaped(text[span["start"]:span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if rows:
                yield table(rows, kind)
        if state is not None:
            yield table([row()], kind)

    return pieces.select("conv_id", "text", "mask").mapInArrow(run, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {DIGEST}")


def read_back(pieces: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of written pieces."""
    shared = pieces.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return _digest_stream(pieces.where("whole")).unionByName(_digest_stream(shared))
