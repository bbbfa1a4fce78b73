"""Operator 6: benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RADIX = 0x9E3779B97F4A7C15
PIECE = 1 << 20       # bytes of text hashed at a time
INDEX_BYTES = 2 << 20  # benchmark text indexed and sent to the tasks at a time; a larger benchmark is searched in several such blocks


def flat(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and every ASCII character that is no letter or digit as a blank. Length is kept."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Search:
    """Parameters. A window is up to ``window`` bytes of an item, ``window / 2`` apart; it may differ by ``rate`` edits a byte."""
    q: int = 10
    window: int = 120
    rate: float = 0.08
    least: int = 40  # items shorter than this once folded are too unspecific to search

    def edits(self, size: int) -> int:
        """Edit budget of a window, at most what the q-gram lemma can still filter."""
        return max(0, min(int(self.rate * size), (size - self.q) // self.q))

    def shared(self, size: int) -> int:
        """q-grams that a region within the budget must share with a window of ``size`` bytes."""
        return size - self.q + 1 - self.q * self.edits(size)


def qgram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of ``q`` bytes, built by doubling: O(log q) passes over the bytes."""
    out, done, part, span = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if q & span:
            n = len(data) - done - span + 1
            piece = part[done : done + n]
            out = piece if out is None else out[:n] * np.uint64(pow(RADIX, span, 1 << 64)) + piece
            done += span
        if done == q:
            return out
        n = len(data) - 2 * span + 1
        part = part[:n] * np.uint64(pow(RADIX, span, 1 << 64)) + part[span : span + n]
        span *= 2


class Index:
    """Windows of the benchmark items and the places of their q-grams, ordered by hash."""

    def __init__(self, items: list[tuple[int, str]], search: Search) -> None:
        self.search, self.windows, self.item = search, [], []
        for item, text in items:
            folded = flat(text).strip()
            if len(folded) < search.least:
                continue
            last = max(0, len(folded) - search.window)
            for at in sorted({*range(0, last + 1, search.window // 2), last}):
                self.windows.append(folded[at : at + search.window])
                self.item.append(item)
        hashes, window, place = [], [], []
        for k, w in enumerate(self.windows):
            h = qgram_hashes(np.frombuffer(w, np.uint8), search.q)
            hashes.append(h)
            window.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.window = (np.concatenate(window) if window else np.empty(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int32))[order]
        size = np.array([len(w) for w in self.windows], np.int64)
        self.need = np.array([search.shared(n) for n in size], np.int64)
        self.budget = np.array([search.edits(n) for n in size], np.int64)
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hash * np.uint64(RADIX)) >> np.uint64(64 - self.bits)] = True

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Windows and diagonals (text place less window place) of all shared q-grams of a text, whatever its length."""
        windows, diagonals = [], []
        for at in range(0, len(data) - self.search.q + 1, PIECE):
            h = qgram_hashes(np.frombuffer(data[at : at + PIECE + self.search.q - 1], np.uint8), self.search.q)
            maybe = np.flatnonzero(self.seen[(h * np.uint64(RADIX)) >> np.uint64(64 - self.bits)])
            slot = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
            sure = self.hash[slot] == h[maybe]
            where, slot = maybe[sure] + at, slot[sure]
            n = self.count[slot]
            entry = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            windows.append(self.window[entry])
            diagonals.append(np.repeat(where, n) - self.place[entry])
        if not windows:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(windows), np.concatenate(diagonals)

    def leaks(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """``item -> (begin, end, edits)`` of a text: byte range covered by the item's windows that pass, and the fewest edits of one.

        Diagonals are counted in bands twice as wide as the budget that overlap by half, so a region within the budget has all its
        q-grams in one band.
        """
        if not text or not len(self.hash):
            return {}
        data = flat(text)
        window, diagonal = self.hits(data)
        found: dict[int, tuple[int, int, int]] = {}
        if not len(window):
            return found
        common = np.bincount(window, minlength=len(self.windows))[window] >= self.need[window]
        window, diagonal = window[common], diagonal[common]
        strip = diagonal // np.maximum(self.budget[window], 1)
        keys, n = np.unique((window.astype(np.int64) << 40) + strip + (1 << 39), return_counts=True)
        bands, place = np.unique(np.concatenate((keys, keys - 1)), return_inverse=True)  # a strip counts for the band it opens and the one it closes
        total = np.bincount(place, np.concatenate((n, n))).astype(np.int64)
        enough = total >= self.need[bands >> 40]
        for band in bands[enough].tolist():
            w, s = band >> 40, (band & ((1 << 40) - 1)) - (1 << 39)
            k, target = int(self.budget[w]), self.windows[w]
            half = max(k, 1)
            edits, begin, end = align(target, data, s * half, s * half + 2 * half - 1, k)
            if edits <= k:
                old = found.get(self.item[w], (begin, end, edits))
                found[self.item[w]] = (min(old[0], begin), max(old[1], end), min(old[2], edits))
        return found


def align(window: bytes, data: bytes, low: int, high: int, budget: int) -> tuple[int, int, int]:
    """Fewest edits between ``window`` and a region of ``data`` on diagonals ``low - budget`` to ``high + budget``: (edits, begin, end).

    One column per diagonal, one row per byte of the window; begin and end of the region are free inside the band.
    """
    for d in range(max(low, 0), high + 1):
        if data[d : d + len(window)] == window:
            return 0, d, d + len(window)
    low, high = low - budget, high + budget
    diagonals = np.arange(low, high + 1)
    text = np.frombuffer(data, np.uint8)
    far = len(window) + len(data)
    cost = np.where((diagonals >= 0) & (diagonals <= len(data)), 0, far)
    begin = diagonals.copy()
    steps = np.arange(len(diagonals))
    for i, c in enumerate(window):
        at = diagonals + i
        inside = (at >= 0) & (at < len(data))
        same = inside & (text[np.clip(at, 0, len(data) - 1)] == c)
        step = np.where(inside, cost + ~same, far)
        drop = np.append(cost[1:] + 1, far)  # a byte of the window that the text lacks
        start = np.where(step <= drop, begin, np.append(begin[1:], 0))
        best = np.minimum(step, drop)
        # bytes of the text that the window lacks: a running minimum along the row
        slid = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == slid, steps, 0))
        cost, begin = slid + steps, start[source]
    k = int(np.argmin(cost))
    return int(cost[k]), int(begin[k]), int(diagonals[k] + len(window))


def _indexes(benchmark: DataFrame, search: Search) -> Iterator[Index]:
    """One index per bounded block of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // INDEX_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Index([(r["item_id"], r["text"]) for r in rows], search)


def _find(index: Index):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, item, *where) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item, where in index.leaks(text).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], schema=schema)
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """Benchmark items found in documents: ``doc_id, item_id, begin, end, edits``, one row per document row and item.

    Texts are compared with A-Z lower-cased and ASCII punctuation as blanks. Each item is searched in overlapping windows; a window is found where a
    region of the text is within its edit budget. The q-gram lemma says how many q-grams such a region shares with the window inside one
    diagonal band; bands below that count are left, the others are verified by a banded alignment. ``begin`` and ``end`` are byte offsets
    into the UTF-8 text that cover all windows found of the item, ``edits`` the fewest of one window.

    Every document is read once per ``INDEX_BYTES`` of benchmark, without a shuffle. NULL and empty texts and items, and items shorter than
    ``least`` bytes, match nothing. NULL document ids are kept in the result; repeated documents give repeated rows, repeated items of one id
    count once. An empty table on either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _indexes(benchmark, search):
        part = docs.mapInArrow(_find(index), "doc_id long, item_id long, begin long, end long, edits long")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns and other rows stay. See ``find_leaks``."""
    at = docs.columns.index("text")

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.leaks(t) for t in batch.column(at).to_pylist()], pa.bool_()))
        return run
    for index in _indexes(benchmark, search):
        docs = docs.mapInArrow(keep(index), docs.schema)
    return docs
