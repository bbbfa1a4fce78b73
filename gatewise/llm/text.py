"""Vectorised text hashing on Arrow batches, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RADIX, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 20  # bytes worked on at a time, so temporary arrays stay small whatever the batch


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``data`` and where each word starts. Words end at bytes 0x20 and 0x09-0x0D."""
    buf = np.frombuffer(data, np.uint8)
    solid = np.flatnonzero(~_spaces()[buf])
    if not len(solid):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    starts = solid[first]
    lengths = np.diff(first, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), RADIX, np.uint64))
    h = np.add.reduceat((buf[solid].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    return mix(h ^ (lengths.astype(np.uint64) * MIX2)), starts


def document_pieces(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Group short texts: yields ``(number of texts, word hashes, text of each word)``. A long text comes alone."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        if len(texts[at]) > PIECE:
            hashes = long_text(texts[at])
            yield 1, hashes, np.zeros(len(hashes), np.int64)
        else:
            h, starts = word_hashes(b"\n".join(texts[at:end]))
            edges = np.cumsum([len(t) + 1 for t in texts[at:end]])
            yield end - at, h, np.searchsorted(edges, starts, "right")
        at = end


def long_text(text: bytes) -> np.ndarray:
    """Word hashes of one long text, read in pieces that end between words."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64 below 2^63) of each text, in order; a shorter text is one shingle as a whole."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * RADIX) | np.uint64(1)
    for count, h, owner in document_pieces(texts):
        bounds = np.searchsorted(owner, np.arange(count + 1))
        if len(h) >= width:
            rolled = h[: len(h) - width + 1] * factors[0]
            for j in range(1, width):
                rolled = rolled + h[j : len(h) - width + 1 + j] * factors[j]
            rolled = (mix(rolled) >> np.uint64(1)).astype(np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                whole = (h[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield (mix(np.array([whole])) >> np.uint64(1)).astype(np.int64)
            else:
                yield np.empty(0, np.int64)


def lowered(column: pa.Array) -> list[bytes]:
    """UTF-8 texts with A-Z in lower case (bytes.lower leaves all other bytes); NULL is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in column.to_pylist()]
