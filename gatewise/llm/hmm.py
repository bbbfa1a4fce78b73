"""Operator 10: hidden Markov language model with exact sequence likelihoods."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewise.session import STAGES, shuffled, staged

END = "\n"  # the end token; no word contains a line break
LANES = 1024  # sequences that advance together
BLOCK = 1 << 23  # bytes of text whose words share one list
ROW = 64  # bytes that a text counts for besides its own, so that short texts do not make long lists
SHARD = 1 << 15  # words beyond the broadcast ones whose counts are summed side by side
MENTIONS = 1 << 19  # places of such words in training texts, which bound what the blocks ask of one shard
PIECE = 4096  # broadcast words whose counts are summed side by side
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22  # of the rows that a task hands to Python at once; a longer row goes alone


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words and the end token, as text."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()] + [END]


def _slices(batches: Iterator[pa.RecordBatch], texts: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes in the column ``texts``, and ``ROW`` for each, however they came; a longer text comes alone."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False) + ROW, dtype=np.int64)
        at, passed = 0, 0
        while at < batch.num_rows:
            end = max(at + (not held), int(np.searchsorted(ends, passed + limit - size, "right")))
            if end > at:
                held.append(batch.slice(at, end - at))
                size, passed, at = size + int(ends[end - 1]) - passed, int(ends[end - 1]), end
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased (A-Z) words of the texts, one text after the other, and how many each has. NULL is the empty text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    return flat.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in _slices(batches, 0, BLOCK // 4):
        words, sizes = _words(batch.column(0))
        found = words.value_counts()
        held += [pa.table({"word": found.field("values"), "n": found.field("counts")}), pa.table({"word": pa.array([END], words.type), "n": pa.array([len(sizes)], pa.int64())})]
        size += len(found)
        if size > 700_000:
            held = [_summed(held)]
            size = len(held[0])
            if size > 500_000:
                yield from held[0].to_batches(1 << 16)
                held, size = [], 0
    if held:
        yield from _summed(held).to_batches(1 << 16)
    held = []
    pa.default_memory_pool().release_unused()  # else the worker holds it through all later steps


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """Counts ``(word, n)`` of all words and end tokens, combined in tasks before the shuffle."""
    return texts.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def leading_level(counts: DataFrame, limit: int) -> tuple[Column, int | None]:
    """A count level per word and the lowest one whose words, with all above, are at most ``limit``. No task sorts more than its share."""
    level = F.floor(F.log2("n") * 64)  # some 64 levels a doubling
    lowest, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > limit:
            break
        lowest = r["level"]
    return level, lowest


def first_counts(counts: DataFrame, states: int) -> list[Column]:
    """Each word's count dealt out over the states by a fixed lognormal perturbation from its hash, which breaks the symmetry."""
    def uniform(*salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("word", *map(F.lit, salt)), 11) + F.lit(1)) / F.lit(float(2**53 + 1))
    parts = [F.exp(1.5 * F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * math.pi * uniform(k, 1))) for k in range(states)]
    return [(F.col("n") * part / sum(parts[1:], parts[0])).alias(f"c{k}") for k, part in enumerate(parts)]


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of their places."""
    return pa.compress(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, size).T.copy().view(np.int32)[:, 0]


def _encode(lead: list[str], logs: np.ndarray, shards: int):
    """One row per block of texts, with the symbols of all its words and what the broadcast words (``lead``) add to the base columns.
    The distinct words that are not broadcast leave by shard; the j-th of them, over all shards, is the block's symbol ``len(lead) + j``."""
    kinds = [("doc_id", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("symbols", pa.binary()),
             ("own_known", pa.list_(pa.int64())), ("own_base", pa.list_(pa.float64())), ("rare", pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(lead, pa.string())
        for batch in _slices(batches, 2, BLOCK):
            words, sizes = _words(batch.column(2))
            coded = words.dictionary_encode()
            distinct = pa.concat_arrays([coded.dictionary, pa.array([END], words.type)])
            codes = np.insert(coded.indices.to_numpy(), np.cumsum(sizes), len(distinct) - 1)
            place = pc.index_in(distinct, value_set=known.cast(words.type))
            words = coded = None  # a block's arrays are large: none is kept longer than needed
            met, symbol = place.is_valid().to_numpy(zero_copy_only=False), place.fill_null(0).to_numpy().copy()
            values = np.zeros(len(distinct))
            values[met] = logs[symbol[met]]
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
            own = np.bincount(row, met[codes], len(sizes)).astype(np.int64), np.bincount(row, values[codes], len(sizes))
            row = None
            others = np.flatnonzero(~met)
            rare = distinct.take(pa.array(others)).cast(pa.binary()).to_pylist()
            shard = np.array([zlib.crc32(w) for w in rare], np.int64) % shards
            order = np.argsort(shard, kind="stable")
            symbol[others[order]] = len(lead) + np.arange(len(order))
            codes = _packed(symbol[codes])
            held, first = np.unique(shard[order], return_index=True)
            parts = [{"shard": int(k), "words": b" ".join([rare[j] for j in at])} for k, at in zip(held, np.split(order, first[1:]))]
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes + 1, codes, *own, parts
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(columns, kinds)], schema=pa.schema(kinds))
        pa.default_memory_pool().release_unused()  # else the worker holds it through all later steps
    return run


def _route(states: int):
    """One row per shard of words: the counts of its words, with zeros behind them for words unseen in training, and for each block that
    holds words of the shard the places of these words among the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, asked, found in zip(*(batch.column(c) for c in ("shard", "asked", "found"))):
                asked, found = asked.values, found.values
                lists = pc.split_pattern(asked.field("words"), " ")
                sizes = pc.list_value_length(lists).to_pylist()
                size = 0 if found is None else len(found)
                index, n, counts = np.zeros(sum(sizes), np.int32), np.zeros(size + 1, np.int64), np.zeros((size + 1, states), np.float32)
                if size:
                    index = pc.index_in(lists.flatten(), value_set=found.field("word").cast(pa.binary())).fill_null(size).to_numpy()
                    n[:size] = found.field("n").to_numpy()
                    for k in range(states):
                        counts[:size, k] = found.field(f"c{k}").to_numpy()
                yield _shard(shard.as_py(), counts.tobytes(), asked.field("block").to_pylist(), sizes, _packed(index), n.tobytes())
    return run


SHARDS = pa.schema([("shard", pa.int32()), ("counts", pa.binary()), ("blocks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("index", pa.binary()), ("n", pa.binary())])
SHARD_COLUMNS = "shard int, counts binary, blocks array<long>, sizes array<int>, `index` binary, n binary"


def _shard(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SHARDS)], schema=SHARDS)


def _send(states: int, with_n: bool):
    """From each shard to each of its blocks: the expected counts of the block's words and, where asked for, how often they occur in training."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, counts, blocks, sizes, index, n in zip(*(batch.column(f.name) for f in SHARDS)):
                blocks, sizes = blocks.as_py(), sizes.as_py()
                ends = np.cumsum(sizes)
                index = _unpacked(index.as_py(), int(ends[-1]))
                counts, n = np.frombuffer(counts.as_py(), np.float32).reshape(-1, states), np.frombuffer(n.as_py(), np.int64)
                at, passed = 0, 0
                while at < len(blocks):
                    end = max(at + 1, int(np.searchsorted(ends, passed + BATCH_BYTES // (4 * states + 8), "right")))
                    parts = [index[hi - size : hi] for hi, size in zip(ends[at:end], sizes[at:end])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(blocks[at:end], pa.int64()), pa.array([shard.as_py()] * len(parts), pa.int32()), pa.array([counts[k].tobytes() for k in parts], pa.binary()),
                        pa.array([n[k].tobytes() if with_n else None for k in parts], pa.binary())], names=["block", "shard", "counts", "n"])
                    at, passed = end, int(ends[end - 1])
    return run


def forward(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion, many sequences in step.

    ``emit`` is (states, symbols). States come first in every array, so each numpy call runs along the sequences.
    """
    out = np.zeros(len(sequences))
    onward, first_step = np.ascontiguousarray(move.T), start[:, None]
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    for lo in range(0, len(order), LANES):
        lane = order[lo : lo + LANES]
        lengths = np.array([len(sequences[k]) for k in lane])
        flat = np.concatenate([sequences[k] for k in lane])
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        alpha, log = None, np.zeros(len(lane))
        for t in range(int(lengths[0])):
            n = live[t]
            b = emit.take(flat[first[:n] + t], axis=1)
            b *= first_step if t == 0 else onward @ alpha[:, :n]
            scale = b.sum(axis=0)
            b /= scale
            alpha = b
            log[:n] += np.log(scale)
        out[lane] = log
    return out


def expected_counts(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (starts, moves, emissions) of sequences about as long as each other, in step. States come first."""
    states = len(start)
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths, longest = lengths[order], int(lengths.max())
    grid = np.zeros((longest, len(order)), np.int32)
    for k, o in enumerate(order):
        grid[: lengths[k], k] = sequences[o]
    live = np.searchsorted(-lengths, -np.arange(longest), "left")
    onward = np.ascontiguousarray(move.T)
    alpha: list[np.ndarray] = []
    ahead_of: list[np.ndarray] = []
    for t in range(longest):
        b = emit.take(grid[t, : live[t]], axis=1)
        a = b * (start[:, None] if t == 0 else onward @ alpha[-1][:, : live[t]])
        scale = a.sum(axis=0)
        a /= scale
        b /= scale
        alpha.append(a)
        ahead_of.append(b)
    beta = np.ones((states, len(order)))
    moves = np.zeros((states, states))
    for t in range(longest - 1, -1, -1):
        n = live[t]
        if t + 1 < longest:
            m = live[t + 1]
            ahead = ahead_of[t + 1] * beta[:, :m]
            moves += alpha[t][:, :m] @ ahead.T
            beta[:, :m] = move @ ahead
        gamma = alpha[t]
        gamma *= beta[:, :n]
        gamma /= gamma.sum(axis=0)
    held = np.concatenate([grid[t, : live[t]] for t in range(longest)])
    emissions = np.stack([np.bincount(held, np.concatenate([a[k] for a in alpha]), minlength=emit.shape[1]) for k in range(states)])
    return alpha[0].sum(axis=1), moves * move, emissions


class Model(NamedTuple):
    """What every task gets: ``share`` are the smoothing tokens of each state, ``below`` the denominators of its emissions."""

    start: np.ndarray
    move: np.ndarray
    lead: np.ndarray  # emissions of the leading words, (states, words)
    share: np.ndarray
    below: np.ndarray

    def emissions(self, counts: np.ndarray) -> np.ndarray:
        """Emissions of words with these expected counts, (states, words); one pseudo-token a word, spread as the states' shares."""
        return (counts + self.share[:, None]) / self.below[:, None]


def make_model(starts: np.ndarray, moves: np.ndarray, lead: np.ndarray, totals: np.ndarray, words: int, smoothing: float = 0.1) -> Model:
    """The model of expected counts; ``totals`` are the tokens of each state, ``words`` the distinct training words. One more word is
    left for all unseen ones, so with a single state this is the unigram model with add-one smoothing."""
    share = totals / totals.sum() if totals.sum() else np.full(len(totals), 1 / len(totals))
    model = Model((starts + smoothing) / (starts + smoothing).sum(), (moves + smoothing) / (moves + smoothing).sum(axis=1, keepdims=True), lead, share, totals + share * (words + 1))
    return model._replace(lead=np.ascontiguousarray(model.emissions(lead)))


def _meet(blocks: DataFrame, shards: DataFrame, states: int, with_n: bool = False) -> DataFrame:
    """Each block followed by the counts of its rare words, in the order of its symbols."""
    sent = shards.mapInArrow(_send(states, with_n), "block long, shard int, counts binary, n binary")
    return blocks.unionByName(sent, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("shard").asc_nulls_first())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple]]]:
    """The rows of blocks and for each what the shards have sent: (shard, counts, n)."""
    block, sent = None, []
    for batch in batches:
        for k, shard in enumerate(batch.column("shard").to_pylist()):
            if shard is None:
                if block is not None:
                    yield block, sent
                block, sent = batch.slice(k, 1).to_pylist()[0], []
            else:
                sent.append((shard, batch.column("counts")[k].as_py(), batch.column("n")[k].as_py()))
    if block is not None:
        yield block, sent


def _unfold(model: Model, block: dict, sent: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All symbols of a block, the sequence of each text, and the emissions of the leading words with those of the block's own behind them."""
    lengths = np.array(block["lengths"], np.int64)
    symbols = _unpacked(block["symbols"], int(lengths.sum()))
    counts = np.frombuffer(b"".join(c for _, c, _ in sent), np.float32).reshape(-1, len(model.start)).T.astype(float)
    return symbols, np.split(symbols, np.cumsum(lengths)[:-1]), np.concatenate((model.lead, model.emissions(counts)), axis=1)


def _learn(model: Model, span: int, budget: int):
    """Send the expected counts of each block's words back to their shards. This task's starts, moves, state totals and leading words leave
    in pieces of ``PIECE``, numbered from -1 down."""
    states, offset = model.lead.shape

    def rows(shards: list[int], block: int, counts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([block] * len(shards), pa.int64()), pa.array(counts, pa.binary())], names=["shard", "block", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = np.zeros((states, states + 2))  # starts, moves from each state, totals
        lead, last = np.zeros_like(model.lead), None
        for block, sent in _blocks(batches):
            if not any(block["learn"]):
                continue
            _, sequences, emit = _unfold(model, block, sent)
            # long texts in spans, all of them
            held = sorted((s[k : k + span] for s, learn in zip(sequences, block["learn"]) if learn for k in range(0, len(s), span)), key=len)
            found, low = np.zeros_like(emit), 0
            while low < len(held):  # sequences of like length side by side
                high = low + 1
                while high < len(held) and len(held[high]) * (high - low + 1) <= budget:
                    high += 1
                starts, moves, emissions = expected_counts(held[low:high], model.start, model.move, emit)
                fixed[:, 0] += starts
                fixed[:, 1:-1] += moves.T
                found += emissions
                low = high
            fixed[:, -1] += found.sum(axis=1)
            lead += found[:, :offset]
            last = block["block"]
            own, ends = np.ascontiguousarray(found[:, offset:].T, np.float32), np.cumsum([len(c) for _, c, _ in sent]) // (4 * states)
            yield rows([shard for shard, _, _ in sent], last, [own[lo:hi].tobytes() for lo, hi in zip((0, *ends[:-1]), ends)])
        if last is not None:
            whole = np.concatenate((fixed, lead), axis=1).T
            yield rows([-1 - k for k in range(-(-len(whole) // PIECE))], last, [np.ascontiguousarray(whole[at : at + PIECE]).tobytes() for at in range(0, len(whole), PIECE)])
    return run


def _gather(states: int):
    """Sum what the blocks have sent to each shard, whose own row comes first, and to each piece, which has no row of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, total, at = None, None, None, {}

        def summed() -> pa.RecordBatch:
            return _shard(shard, *((total.tobytes(), None, None, None, None) if own is None else (total.astype(np.float32).tobytes(), own["blocks"], own["sizes"], own["index"], own["n"])))
        for batch in batches:
            for k, (key, block) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist())):
                if key != shard:
                    if shard is not None:
                        yield summed()
                    shard, own, total = key, None, None
                if block is None:
                    own = batch.slice(k, 1).to_pylist()[0]
                    ends = np.cumsum(own["sizes"])
                    index = _unpacked(own["index"], int(ends[-1]))
                    at = {b: index[lo:hi] for b, lo, hi in zip(own["blocks"], (0, *ends[:-1]), ends)}
                    total = np.zeros((len(own["n"]) // 8, states))
                elif own is not None:  # a word stands once in a block's list; unseen words share the last row, and only zeros come for them
                    total[at[block]] += np.frombuffer(batch.column("counts")[k].as_py(), np.float32).reshape(-1, states)
                else:
                    counts = np.frombuffer(batch.column("counts")[k].as_py(), float).reshape(-1, states)
                    total = counts.copy() if total is None else total + counts
        if shard is not None:
            yield summed()
    return run


def _drop_stage(spark: SparkSession, folder: str) -> None:
    """Delete a staged table that later ones have replaced."""
    STAGES.remove(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _held_small(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as their job has ended, not when the driver happens to collect its garbage, and rows go to Python in small
    batches, which the executor and Python both hold more than once."""
    was = {name: spark.conf.get(name) for name in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def train(blocks: DataFrame, shards: DataFrame, model: Model, words: int, rounds: int, span: int = 256, budget: int = 400_000) -> tuple[Model, DataFrame]:
    """Baum-Welch over all ``learn`` texts of ``blocks``. The expected counts of rare words are a table of shards; in each round these send
    each block the counts of its words and sum what the blocks send back. The driver and the tasks hold those of the leading words."""
    spark, (states, offset) = blocks.sparkSession, model.lead.shape
    last = STAGES[-1]
    for _ in range(rounds):
        met = _meet(blocks.select("block", "learn", "lengths", "symbols"), shards.where("shard >= 0"), states)
        parts = met.mapInArrow(_learn(model, span, budget), "shard int, block long, counts binary")
        both = parts.unionByName(shards.where("shard >= 0").drop("counts"), allowMissingColumns=True)
        shards = staged(both.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first()).mapInArrow(_gather(states), SHARD_COLUMNS))
        fixed = sorted(shards.where("shard < 0").select("shard", "counts").collect(), reverse=True)
        _drop_stage(spark, last)
        last = STAGES[-1]
        if not fixed:
            break
        table = np.concatenate([np.frombuffer(r["counts"], float) for r in fixed]).reshape(-1, states).T
        model = make_model(table[:, 0], table[:, 1 : states + 1].T, table[:, states + 2 :], table[:, states + 1], words)
    return model, shards.where("shard >= 0")


def _score(model: Model, below: float):
    schema = pa.schema([("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sent in _blocks(batches):
            symbols, sequences, emit = _unfold(model, block, sent)
            log = forward(sequences, model.start, model.move, emit) / math.log(10)
            # training counts of the block's rare words, those unseen in training at 0
            n, lead = np.frombuffer(b"".join(n for _, _, n in sent), np.int64), np.zeros(model.lead.shape[1])
            lengths = np.array(block["lengths"], np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            known = np.array(block["own_known"], np.int64) + np.bincount(row, np.concatenate((lead, n > 0))[symbols]).astype(np.int64)
            base = np.array(block["own_base"]) + np.bincount(row, np.concatenate((lead, np.log10((n + 1) / below)))[symbols])
            columns = block["doc_id"], block["learn"], lengths, known, base, log
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)
    return run


def score_texts(docs: DataFrame, learn: Column, vocabulary: int = 16_384, broadcast_words: int = 100_000, states: int = 4, rounds: int = 4) -> DataFrame:
    """One row per document: ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score``.

    Words (A-Z lower-cased) and one end token per text are counted over all rows where ``learn`` holds. ``base_score`` is the smoothed
    unigram log10 likelihood with these counts. ``score`` is the log10 likelihood under a hidden Markov model in which every training
    word has emissions of its own, trained by Baum-Welch on all training texts; one further symbol stands for all unseen words. Long
    texts are learned from in spans but scored as one exact forward recursion. The counts of the most frequent words, as many as
    the larger of ``vocabulary`` and ``broadcast_words``, travel with the tasks; those of all others are sent in each round to the blocks
    of texts that hold the words. That is a choice of plan and changes no score.

    NULL text is the empty text: one end token. With no training rows all counts are 0. Repeated rows and rows with a NULL id are kept
    and scored each on its own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    with _held_small(spark):
        counts, counted = staged(count_words(docs.where("learn"))), STAGES[-1]
        first = first_counts(counts, states)
        names = [f"c{k}" for k in range(states)]
        total, distinct, *totals = counts.select("n", *first).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), *(F.coalesce(F.sum(c), F.lit(0.0)) for c in names)).first()
        level, lowest = leading_level(counts, max(vocabulary, broadcast_words))
        leads = F.lit(False) if lowest is None else level >= lowest
        head = counts.where(leads).select("word", "n", *first).toPandas().sort_values(["n", "word"], ascending=[False, True])
        below = total + distinct + 1
        logs = np.array([math.log10((n + 1) / below) for n in head["n"].tolist()])
        n_shards = max(1, -(-(distinct - len(head)) // SHARD), -(-(total - int(head["n"].sum())) // MENTIONS))
        kinds = "doc_id array<long>, learn array<boolean>, lengths array<int>, symbols binary, own_known array<long>, own_base array<double>, rare array<struct<shard int, words binary>>"
        blocks = staged(docs.mapInArrow(_encode(head["word"].tolist(), logs, n_shards), kinds).withColumn("block", F.monotonically_increasing_id()))
        asked = blocks.select("block", F.inline("rare")).groupBy("shard").agg(F.collect_list(F.struct("block", "words")).alias("asked"))  # a list of words for each block
        found = counts.where(~leads).select(F.pmod(F.crc32("word"), F.lit(n_shards)).cast("int").alias("shard"), "word", "n", *(c.cast("float").alias(name) for c, name in zip(first, names)))
        found = found.groupBy("shard").agg(F.collect_list(F.struct("word", "n", *names)).alias("found"))  # some SHARD words
        shards = staged(shuffled(asked).join(found, "shard", "left").mapInArrow(_route(states), SHARD_COLUMNS))
        _drop_stage(spark, counted)
        move = np.full((states, states), 0.1) + 9.0 * np.eye(states)  # states last, so they settle on topics before word order
        model = make_model(np.ones(states), move, head[names].to_numpy().T.reshape(states, -1), np.array(totals, float), distinct, smoothing=0.0)
        model, shards = train(blocks, shards, model, distinct, rounds)
        met = _meet(blocks.drop("rare"), shards, states, with_n=True)
        scored = staged(met.mapInArrow(_score(model, float(below)), "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", "learned", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
