"""Operator 13: fill-in-the-middle over texts that are kept as seekable compressed frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

FRAME = 1 << 16  # bytes of text in a frame
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FRAMES = "data array<binary>, ends array<bigint>, units array<bigint>, chars array<bigint>"


class Frames(NamedTuple):
    """A text as zstandard frames, each readable alone, and where each one ends: bytes, units and code points from the start."""

    data: list[bytes]
    ends: list[int]
    units: list[int]
    chars: list[int]


def _solid(block: bytes) -> np.ndarray:
    codes = np.frombuffer(block, np.uint8)
    return (codes != 0x20) & ((codes < 0x09) | (codes > 0x0D))


def _code_points(block: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(block, np.uint8) & 0xC0) != 0x80))


def pack(chunks: Iterable[bytes], size: int = FRAME) -> Frames:
    """Frames of ``size`` bytes from a text that comes in chunks. A unit is a word with the white space before it, or the white space at the
    end; it counts in the frame where its last byte lies."""
    packer, out, held, ended = zstandard.ZstdCompressor(), Frames([], [], [], []), bytearray(), False

    def put(block: bytes, follower: int | None) -> None:
        solid = _solid(block)
        after = follower is None or follower in b" \t\n\x0b\x0c\r"
        units = int(np.count_nonzero(solid[:-1] & ~solid[1:])) + bool(solid[-1] and after) + bool(follower is None and not solid[-1])
        out.data.append(packer.compress(block))
        for totals, more in ((out.ends, len(block)), (out.units, units), (out.chars, _code_points(block))):
            totals.append((totals[-1] if totals else 0) + more)

    for chunk in chunks:
        held += chunk
        at = 0
        while len(held) - at > size:  # one byte more than a frame shows whether its last word ends
            put(bytes(held[at : at + size]), held[at + size])
            at += size
        del held[:at]
    if held:
        put(bytes(held), None)
    return out


def read(frames: Frames, start: int, stop: int) -> Iterator[bytes]:
    """Bytes ``start`` to ``stop``, frame by frame; only frames that hold some of them are decompressed."""
    unpacker = zstandard.ZstdDecompressor()
    at = int(np.searchsorted(frames.ends, start, "right"))
    while at < len(frames.data) and start < stop:
        first = frames.ends[at - 1] if at else 0
        yield unpacker.decompress(frames.data[at])[start - first : stop - first]
        start, at = frames.ends[at], at + 1


def seek(frames: Frames, units: int) -> tuple[int, int]:
    """Bytes and code points in the first ``units`` units: one frame is decompressed."""
    if not units:
        return 0, 0
    at = int(np.searchsorted(frames.units, units, "left"))
    before, byte, char = (totals[at - 1] if at else 0 for totals in (frames.units, frames.ends, frames.chars))
    block = zstandard.ZstdDecompressor().decompress(frames.data[at])
    solid = _solid(block)
    inside = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    length = int(inside[units - before - 1]) if units - before <= len(inside) else len(block)
    return byte + length, char + _code_points(block[:length])


def find(frames: Frames, mark: bytes, start: int = 0) -> int:
    """Where ``mark`` first stands at or after byte ``start``; -1 if nowhere. Frame ends may cut it."""
    tail, at = b"", start
    for block in read(frames, start, frames.ends[-1] if frames.ends else 0):
        seen = tail + block
        place = seen.find(mark)
        if place >= 0:
            return at - len(tail) + place
        at, tail = at + len(block), seen[-(len(mark) - 1) :]
    return -1


def arrange(text: Frames, form: str, first: int, second: int) -> Iterator[bytes]:
    """The output's bytes for cuts at two byte offsets, as a stream."""
    end = text.ends[-1] if text.ends else 0
    if form == PLAIN:
        yield from read(text, 0, end)
        return
    prefix, middle, suffix = (0, first), (first, second), (second, end)
    order = [(PREFIX, prefix), (SUFFIX, suffix)] if form == PSM else [(SUFFIX, suffix), (PREFIX, prefix)]
    for mark, (start, stop) in (*order, (MIDDLE, middle)):
        yield mark
        yield from read(text, start, stop)


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The text's bytes from an output and its form alone, as a stream."""
    end = output.ends[-1] if output.ends else 0
    if form == PLAIN:
        yield from read(output, 0, end)
        return
    second = find(output, SUFFIX if form == PSM else PREFIX)
    third = find(output, MIDDLE)
    parts = [(3, second), (second + 3, third), (third + 3, end)]
    for start, stop in ([parts[0], parts[2], parts[1]] if form == PSM else [parts[1], parts[2], parts[0]]):
        yield from read(output, start, stop)


def digest(chunks: Iterable[bytes]) -> str:
    whole = hashlib.sha256()
    for chunk in chunks:
        whole.update(chunk)
    return whole.hexdigest()


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers from the id: the first four groups of eight hex digits of a hash."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[i : i + 8], 16) for i in range(0, 32, 8)]


def pack_texts(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """Every text as seekable frames: ``doc_id``, ``marked`` (holds one of the marks), ``frames`` and their running totals ``ends`` (bytes),
    ``units`` and ``chars``. One row per row of ``docs``; NULL counts as empty and has no frames; other columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marked = [], []
            for text in batch.column(1):
                text = text.as_py() or b""
                marked.append(any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)))
                rows.append(pack([text], size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marked, pa.bool_()), *_columns(rows)], names=["doc_id", "marked", *Frames._fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, marked boolean, {FRAMES}")


def _columns(rows: list[Frames]) -> list[pa.Array]:
    return [pa.array([r.data for r in rows], pa.list_(pa.binary())), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (1, 2, 3))]


def fill_in_middle(packed: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Cuts packed texts (``pack_texts``) in three and reorders them, by numbers that depend on ``seed`` and ``doc_id`` alone.

    Of 100 texts about ``rate`` are cut, ``spm`` percent of them in the order suffix, prefix, middle. Empty texts and those that hold a mark stay
    plain. Rows: ``doc_id``, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (NULL if plain), ``output_sha256``, ``restored_sha256`` (of the text
    that the output's frames give back), and the output itself as frames (``data``, ``ends``, ``units``, ``chars``). Repeated ids give equal
    cuts of equal texts; a NULL id draws as the empty string. No text is whole in memory at once after packing, only frames are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(batch.schema.get_field_index(name)) for name in ("marked", *Frames._fields)}
            found, outputs = [], []
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                text = Frames(*(at[name][row].as_py() for name in Frames._fields))
                n = text.units[-1] if text.units else 0
                h1, h2, h3, h4 = draws(seed, doc_id)
                form = PLAIN if not n or at["marked"][row].as_py() or h3 % 100 >= rate else SPM if h4 % 100 < spm else PSM
                cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                (first, chars), (second, more) = [seek(text, c) for c in cuts] if form != PLAIN else [(0, None), (0, None)]
                output = pack(arrange(text, form, first, second))
                found.append((n, form, chars, more - chars if form != PLAIN else None, digest(read(output, 0, output.ends[-1] if output.ends else 0)), digest(restore(output, form))))
                outputs.append(output)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            values = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values, *_columns(outputs)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *Frames._fields])

    kind = packed.schema["doc_id"].dataType.simpleString()
    return packed.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string, {FRAMES}")
