"""Operator 12: byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly if every token merges to itself and no two neighbours merge across
their border. Whether two neighbours do depends on the right edge of the first (its last byte, the token its last merge has
on the right, and so on) and the left edge of the second. The nondeterministic transducer guesses where tokens end: a
configuration is a place in the trie of tokens, what the right edge of the last token still forbids, and the tokens that are
not emitted yet. Sets of configurations are the states of the deterministic one. They are made when a text first needs them,
and what all configurations agree on is emitted at once, so the delay is at most the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_STATES = 100_000  # states held at a time in a Python worker; beyond it they are made anew
MAX_PIECES = 150_000  # encoded pieces held at a time
REPEATED = 64  # longer pieces, in characters, are not held


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line has the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: float = math.inf) -> list[bytes]:
    """Plain BPE: join the neighbours of lowest rank, the leftmost first, as long as there are some with a rank under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes of one piece in, token ids out.

    Ranks must be those of an ordered training: both halves of a token's last merge have lower ranks than the token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.kids: list[dict[int, int]] = [{}]
        self.token = [-1]
        self.depth = [0]
        place = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = self.kids[node].get(byte)
                if child is None:
                    child = self.kids[node][byte] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = child
            self.token[node] = rank
            place[token] = node
        halves, self.whole = {}, {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge(token, ranks, rank)
                if len(parts) != 2:
                    self.whole[token] = (rank,)  # no merges lead to it: it stands for a piece that equals it, never inside one
                elif any(len(p) > 1 and ranks[p] > rank for p in parts):
                    raise ValueError(f"rank {rank} is lower than that of its halves")
                else:
                    halves[token] = tuple(parts)
        born = lambda t: ranks[t] if len(t) > 1 else -1
        self.after: dict[int, tuple] = {}  # token: its right edge as (place, time of birth, time of end)
        self.left: dict[int, dict[int, float]] = {}  # token: length of each part of its left edge, and that part's time of end
        self.last_use: list[dict[int, float]] = [{} for _ in self.kids]  # place: by length of such a part, the latest end from here on
        lengths: list[dict[int, list]] = [{} for _ in self.kids]  # place: by length, the first end and the number of tokens below
        below = [0] * len(self.kids)
        for token, rank in ranks.items():
            if token in self.whole:
                continue
            edge, part, end = [], token, math.inf
            while True:
                if self.kids[place[part]]:
                    edge.append((place[part], born(part), end))
                if len(part) == 1:
                    break
                part, end = halves[part][1], ranks[part]
            self.after[rank] = tuple(edge)
            ends, part, end = {}, token, math.inf
            while True:
                ends[len(part)] = end
                if len(part) == 1:
                    break
                part, end = halves[part][0], ranks[part]
            self.left[rank] = ends
            node = 0
            for byte in token:
                node = self.kids[node][byte]
                use = self.last_use[node]
                for length, end in ends.items():
                    if length <= self.depth[node] and end > use.get(length, -1):
                        use[length] = end
                if self.depth[node] < len(token):
                    below[node] += 1
                    for length, end in ends.items():
                        if length <= self.depth[node]:
                            seen = lengths[node].setdefault(length, [end, 0])
                            seen[0], seen[1] = min(seen[0], end), seen[1] + 1
        # place: by length of a part that all tokens below have, the first end; a bar at or before it leaves no token
        same: dict[tuple, dict] = {}
        alike = lambda d: same.setdefault(tuple(d.items()), d)  # noqa: E731  equal small dicts are kept once
        self.shut = [alike({length: end for length, (end, n) in seen.items() if n == all_}) for seen, all_ in zip(lengths, below)]
        self.last_use, self.kids = [alike(d) for d in self.last_use], [alike(d) if not d else d for d in self.kids]
        self.forget()

    def forget(self) -> None:
        """Drop all states but the first."""
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []  # pairs (configuration, tokens that wait)
        self.moves: list[dict] = []  # by state and byte: the next state's moves and what is emitted; at -1 the state's number
        self.ends: list[tuple | None] = []
        self.places: dict[tuple, int] = {}
        self.configurations: list[tuple] = []
        self.steps: dict[int, tuple] = {}  # by 256 * configuration + byte: pairs (next configuration, tokens that it ends)
        self._number(frozenset([(self._configuration((0, (), ())), ())]))

    def _configuration(self, place: tuple) -> int:
        number = self.places.setdefault(place, len(self.configurations))
        if number == len(self.configurations):
            self.configurations.append(place)
        return number

    def _number(self, state: frozenset) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({-1: number})
            done = [waiting for c, waiting in state if self.configurations[c][0] == 0]
            self.ends.append(done[0] if len(done) == 1 else None)
        return number

    def _step(self, configuration: int, byte: int) -> tuple:
        """Where one configuration goes: on in the same token, and to the start of the next one if this may be the token's end."""
        node, barred, edge = self.configurations[configuration]
        node = self.kids[node].get(byte)
        if node is None:
            return ()
        found, token, depth = [], self.token[node], self.depth[node]
        born = token if depth > 1 else -1
        first, longer = math.inf, []
        for place, birth, end in edge:  # parts of the last token's right edge, followed by what was read since
            place = self.kids[place].get(byte)
            if place is not None:
                if token >= 0 and self.token[place] >= 0:
                    time = max(birth, born, self.token[place])
                    if time < end:
                        first = min(first, time)
                if self.kids[place]:
                    longer.append((place, birth, end))
        use = self.last_use[node]
        now = (*barred, (depth, first)) if first < math.inf else barred
        now = tuple((length, time) for length, time in now if time <= use.get(length, -1))
        if token in self.left and first == math.inf and all(time > self.left[token].get(length, -1) for length, time in now):
            found.append((self._configuration((0, (), self.after[token])), (token,)))
        if self.kids[node] and not any(time <= self.shut[node].get(length, -1) for length, time in now):
            found.append((self._configuration((node, now, tuple(sorted(longer)))), ()))
        return tuple(found)

    def _advance(self, number: int, byte: int) -> tuple[dict, tuple]:
        found = []
        for configuration, waiting in self.states[number]:
            key = configuration << 8 | byte
            steps = self.steps.get(key)
            if steps is None:
                steps = self.steps[key] = self._step(configuration, byte)
            for then, ended in steps:
                found.append((then, waiting + ended))
        agreed = 0
        shortest = min((waiting for _, waiting in found), key=len)
        while agreed < len(shortest) and all(waiting[agreed] == shortest[agreed] for _, waiting in found):
            agreed += 1
        then = self._number(frozenset((c, waiting[agreed:]) for c, waiting in found))
        move = self.moves[number][byte] = self.moves[then], shortest[:agreed]
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        if piece in self.whole:
            return self.whole[piece]
        if len(self.states) > MAX_STATES:
            self.forget()
        out: list[int] = []
        at = self.moves[0]
        for byte in piece:
            move = at.get(byte)
            if move is None:
                number = at[-1]
                if len(self.states) > 2 * MAX_STATES:  # within one very long piece: keep only the state that it is in
                    state = [(self.configurations[c], waiting) for c, waiting in self.states[number]]
                    self.forget()
                    number = self._number(frozenset((self._configuration(c), waiting) for c, waiting in state))
                move = self._advance(number, byte)
            at, emitted = move
            if emitted:
                out += emitted
        rest = self.ends[at[-1]]
        if rest is None:
            raise AssertionError("no single encoding")
        return (*out, *rest)


class Pieces(dict):
    """Token ids by piece of text, held for pieces that come again."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.machine.encode(piece.encode())
        if len(piece) <= REPEATED:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _utf8_moves() -> list[list[int]]:
    """The UTF-8 state machine: the next state by state and byte. States: 0 between code points; 1, 2, 3 that many continuation
    bytes to come; 4 to 7 a second byte of limited range after E0, ED, F0 and F4; 8 not UTF-8."""
    table = [[8] * 256 for _ in range(9)]
    first = [(0x00, 0x80, 0), (0xC2, 0xE0, 1), (0xE0, 0xE1, 4), (0xE1, 0xED, 2), (0xED, 0xEE, 5), (0xEE, 0xF0, 2), (0xF0, 0xF1, 6), (0xF1, 0xF4, 3), (0xF4, 0xF5, 7)]
    second = {1: (0x80, 0xC0, 0), 2: (0x80, 0xC0, 1), 3: (0x80, 0xC0, 2), 4: (0xA0, 0xC0, 1), 5: (0x80, 0xA0, 1), 6: (0x90, 0xC0, 2), 7: (0x80, 0x90, 2)}
    for low, high, state in first:
        table[0][low:high] = [state] * (high - low)
    for state, (low, high, then) in second.items():
        table[state][low:high] = [then] * (high - low)
    return table


class TextStream:
    """Tokens in, text out: code points are given out as soon as their last byte is there; other bytes become U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.moves = tokens, _utf8_moves()
        self.closed = {i: t.decode() for i, t in tokens.items() if self._run(0, t) == 0}  # whole code points only
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, bytearray()

    def _run(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.moves[state][byte]
        return state

    def feed(self, ids: list[int]) -> str:
        """Text that ``ids`` complete. Unknown ids raise KeyError."""
        return "".join(self._feed(ids[at : at + 128]) for at in range(0, len(ids), 128))

    def _feed(self, ids: list[int]) -> str:
        if self.state == 0:
            try:
                return "".join(map(self.closed.__getitem__, ids))
            except KeyError:  # a token that ends within a code point
                pass
        out = []
        for i in ids:
            if self.state == 0 and i in self.closed:
                out.append(self.closed[i])
                continue
            for byte in self.tokens[i]:
                then = self.moves[self.state][byte]
                if then == 8 and self.state:  # the code point breaks off here; the byte begins anew
                    out.append("�")
                    self.held.clear()
                    then = self.moves[0][byte]
                if then == 8:
                    out.append("�")
                    self.state = 0
                    continue
                self.held.append(byte)
                self.state = then
                if then == 0:
                    out.append(self.held.decode())
                    self.held.clear()
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end: U+FFFD for a code point that breaks off."""
        rest = "�" if self.held else ""
        self.reset()
        return rest


_SHARED: dict[tuple[str, str], Broadcast] = {}


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read by the driver and broadcast once per application: its size is fixed, whatever the input.

    The broadcast value is a dict that Python workers keep from task to task, as long as they are given the same broadcast. What a worker
    makes of the vocabulary (transducer, states, pieces, decoder) is put into it, so encoding and decoding share one.
    """
    key = spark.sparkContext.applicationId, path
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast({"ranks": read_ranks(path)})
    return _SHARED[key]


ROWS = 256  # rows that a task works on at a time


def _encoded(texts: Iterable[bytes | None], kept: dict, pattern: str) -> Iterator[list[int]]:
    """Token ids of each text."""
    import regex

    if "pieces" not in kept:
        kept["pieces"] = Pieces(Transducer(kept["ranks"]))
    pieces, split = kept["pieces"], regex.compile(pattern).findall
    for text in texts:
        yield list(chain.from_iterable(map(pieces.__getitem__, split(text.decode("utf-8", "replace"))))) if text else []


def _decoded(rows: Iterable[list[int] | None], kept: dict) -> Iterator[str]:
    """The text of each row of ids."""
    if "stream" not in kept:
        kept["stream"] = TextStream({rank: token for token, rank in kept["ranks"].items()})
    stream = kept["stream"]
    for ids in rows:
        yield stream.feed(ids or []) + stream.finish()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    return (text.as_py() for text in column)


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every whole text: ``doc_id``, ``ids`` (array of int), one row per row of ``docs``.

    ``pattern`` splits a text into pieces, which are encoded one by one; what it does not match is left out. NULL counts as empty and
    gives no ids; bytes that are not UTF-8 are read as U+FFFD. Repeated rows and ids stay as they are; other columns are left out.
    A Python worker keeps the states and pieces it has met, up to ``MAX_STATES`` and ``MAX_PIECES``.
    """
    shared, (texts, kind) = shared_vocabulary(docs.sparkSession, path), _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = [pa.array(ids, pa.int32()) for ids in _encoded(_bytes(part.column(1)), shared.value, pattern)]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.concat_arrays(rows))], names=["doc_id", "ids"])

    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """The text of every row's ``ids``, added as ``decoded``. No ids or NULL give empty text; an id outside the vocabulary is an error."""
    shared = shared_vocabulary(encoded.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = (ids.as_py() for ids in part.column(part.schema.get_field_index("ids")))
            yield part.append_column("decoded", pa.array(list(_decoded(rows, shared.value)), pa.string()))

    return encoded.mapInArrow(run, f"{schema}, decoded string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Both steps in one pass, in place of the ids and texts their number and hashes: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids, joined
    by commas) and ``decoded_sha256``. One worker at a time holds a machine, and only digests leave it. Awkward rows as in ``encode_texts``."""
    shared, (texts, kind) = shared_vocabulary(docs.sparkSession, path), _texts(docs)

    def sha256(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sizes, names, decoded = [], [], []
            for ids in _encoded(_bytes(part.column(1)), shared.value, pattern):
                sizes.append(len(ids))
                names.append(sha256(str(ids)[1:-1].replace(" ", "").encode()))
                decoded += [sha256(text.encode()) for text in _decoded([ids], shared.value)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
