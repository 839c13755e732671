"""Fill-in-middle transformation over seekable compressed frames.

1. Store: a text is a list of independent zstandard frames of at most ``FRAME`` code points, with cumulative counts.
2. Cut: a document's id fixes its form and two cuts. Only frames that a cut runs through are decompressed; whole frames go
   into the output as they are. The output, markers included, is again a list of frames with cumulative counts.
3. Digest and restore: frames are decompressed one at a time, in the order that is needed. The original is found from the
   output and the form alone: the markers are searched in the stream, then the three parts are read in their old order.

Every step maps single rows; there is no shuffle, and a task holds one document's compressed frames and one plain frame.

Cases: a null text is an empty one; empty texts and those with a marker stay plain. A null ``doc_id`` counts as no digits.
Rows with equal ``doc_id`` are cut by the same numbers, each by its own length. Very long texts are many frames. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.session import materialise

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a frame.
FRAME = 1 << 16
#: Documents below this percentile are transformed; of these, those below the second one get suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

FRAMES = "frames array<struct<end:bigint,data:binary>>"
KIND = pa.list_(pa.struct([("end", pa.int64()), ("data", pa.binary())]))


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def packed(text: str) -> bytes:
    return _codec()[0].compress(text.encode())


def plain(data: bytes) -> str:
    return _codec()[1].decompress(data).decode()


class Frames:
    """Frames of one text: ``ends`` are cumulative code points, ``data`` independent zstandard frames."""

    def __init__(self, ends: list[int] | None = None, data: list[bytes] | None = None):
        self.ends, self.data = ends or [], data or []

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, units: int, data: bytes) -> None:
        self.ends.append(len(self) + units)
        self.data.append(data)

    def add_text(self, text: str, size: int) -> None:
        for i in range(0, len(text), size):
            self.add(len(text[i:i + size]), packed(text[i:i + size]))

    def pieces(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """``frame, from, to`` of the frames that hold units ``start`` to ``end``."""
        for i in range(bisect_right(self.ends, start), bisect_left(self.ends, end) + 1 if start < end else 0):
            base = self.ends[i - 1] if i else 0
            yield i, max(0, start - base), min(end, self.ends[i]) - base

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[str]:
        """The text of a range, a frame at a time."""
        for i, a, b in self.pieces(start, len(self) if end is None else end):
            yield plain(self.data[i])[a:b]

    def copy(self, start: int, end: int, into: Frames, size: int) -> None:
        """Append a range to other frames; only cut frames are decompressed."""
        for i, a, b in self.pieces(start, end):
            if b - a == self.ends[i] - (self.ends[i - 1] if i else 0):
                into.add(b - a, self.data[i])
            else:
                into.add_text(plain(self.data[i])[a:b], size)

    def find(self, mark: str) -> int:
        """Where ``mark`` first stands; it may lie across frames."""
        at, tail = 0, ""
        for text in self.stream():
            place = (tail + text).find(mark)
            if place >= 0:
                return at - len(tail) + place
            at, tail = at + len(text), (tail + text)[1 - len(mark):]
        raise ValueError(f"no {mark} in the output")

    def sha256(self, *ranges: tuple[int, int]) -> str:
        state = hashlib.sha256()
        for start, end in ranges or [(0, len(self))]:
            for text in self.stream(start, end):
                state.update(text.encode())
        return state.hexdigest()


def original_ranges(output: Frames, form: str) -> list[tuple[int, int]]:
    """Ranges of the output that make up the original text, in its order."""
    n, k = len(output), len(PREFIX)
    if form == "plain":
        return [(0, n)]
    middle = output.find(MIDDLE)
    if form == "psm":
        suffix = output.find(SUFFIX)
        return [(k, suffix), (middle + k, n), (suffix + k, middle)]
    prefix = output.find(PREFIX)
    return [(prefix + k, middle), (middle + k, n), (k, prefix)]


def choices(doc_id: int | None) -> list[int]:
    """Four numbers that depend on the document's id alone."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def plan(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form and the two cuts."""
    h1, h2, h3, h4 = choices(doc_id)
    if n == 0 or marked or h3 % 100 >= TRANSFORMED:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", a, b


def transformed(stored: Frames, form: str, a: int, b: int, size: int = FRAME) -> Frames:
    """The output's frames."""
    out, n = Frames(), len(stored)
    orders = {"plain": [("", 0, n)], "psm": [(PREFIX, 0, a), (SUFFIX, b, n), (MIDDLE, a, b)], "spm": [(SUFFIX, b, n), (PREFIX, 0, a), (MIDDLE, a, b)]}
    for mark, start, end in orders[form]:
        out.add_text(mark, size)
        stored.copy(start, end, out, size)
    return out


def _column(all_frames: list[Frames]) -> pa.Array:
    offsets = [0]
    for f in all_frames:
        offsets.append(offsets[-1] + len(f.ends))
    items = pa.StructArray.from_arrays([pa.array([e for f in all_frames for e in f.ends], pa.int64()), pa.array([d for f in all_frames for d in f.data], pa.binary())], ["end", "data"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _frames(column: pa.Array) -> Iterator[Frames]:
    items, offsets = column.flatten(), column.offsets.to_pylist()
    ends, data, base = items.field("end").to_pylist(), items.field("data"), offsets[0]
    for a, b in zip(offsets, offsets[1:]):
        yield Frames(ends[a - base:b - base], data[a - base:b - base].to_pylist())


def _mapped(df: DataFrame, schema: str, run: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``run`` gives the columns after ``doc_id``, for at most 256 rows at a time."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(part.split()[0] for part in schema.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *run(some)], names=names)

    return df.mapInArrow(each, f"doc_id {kind}, {schema}")


def store_frames(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """``doc_id, marked, frames``; ``marked`` says that the text holds a marker."""
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text in batch.column("text"):
            frames = Frames()
            frames.add_text(text.as_py(), size)
            out.append(frames)
        return [batch.column("marked"), _column(out)]

    return _mapped(docs.select("doc_id", text.alias("text"), marked.alias("marked")), f"marked boolean, {FRAMES}", run)


def fill_in_middle(stored: DataFrame, size: int = FRAME) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, frames``: the output of each stored text, as frames."""
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, out = [], []
        for doc_id, marked, frames in zip(batch.column("doc_id").to_pylist(), batch.column("marked").to_pylist(), _frames(batch.column("frames")), strict=True):
            form, a, b = plan(doc_id, len(frames), marked)
            rows.append((len(frames), form, *((None, None) if form == "plain" else (a, b - a))))
            out.append(transformed(frames, form, a, b, size))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return [*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), _column(out)]

    return _mapped(stored, f"n bigint, form string, prefix_chars bigint, middle_chars bigint, {FRAMES}", run)


def output_texts(outputs: DataFrame) -> DataFrame:
    """``doc_id, form, output``: plain output texts, for training."""
    return _mapped(outputs.select("doc_id", "form", "frames"), "form string, output string",
                   lambda batch: [batch.column("form"), pa.array(["".join(f.stream()) for f in _frames(batch.column("frames"))], pa.string())])


def infill_digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``.

    Only the stored frames are written; outputs are digested as they are made.
    """
    outputs = fill_in_middle(materialise(store_frames(docs), "frames"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pairs = [(f.sha256(), f.sha256(*original_ranges(f, form))) for f, form in zip(_frames(batch.column("frames")), batch.column("form").to_pylist(), strict=True)]
        return [*(batch.column(c) for c in ("n", "form", "prefix_chars", "middle_chars")), pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())]

    return _mapped(outputs, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", run)
