"""Name similarity: shared tokens and a counting bound are decided in the JVM, the rest by bit-parallel vector steps on Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

PAIRS = 4096  # pairs that advance together


def partial_similarity(a: str, b: str) -> float:
    """Best similarity (0 to 100) of the shorter text with any equally long or cut-off window of the longer one."""
    return float(partial_similarities([a], [b])[0])


def token_similarity(a: str | None, b: str | None) -> float:
    """100 when a token is shared, else the partial similarity of the sorted tokens."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    if left & right:
        return 100.0
    return partial_similarity(" ".join(sorted(left)), " ".join(sorted(right)))


def partial_similarities(left: list[str], right: list[str]) -> np.ndarray:
    """``partial_similarity`` of many pairs."""
    out = np.zeros(len(left))
    pairs = [sorted((a, b), key=len) for a, b in zip(left, right)]
    narrow = [k for k, (short, _) in enumerate(pairs) if 0 < len(short) <= 64]
    narrow.sort(key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))  # pairs of like length together
    for at in range(0, len(narrow), PAIRS):
        some = narrow[at : at + PAIRS]
        out[some] = _narrow([pairs[k][0] for k in some], [pairs[k][1] for k in some])
    for k, (short, long) in enumerate(pairs):
        if len(short) > 64:
            out[k] = _wide(short, long)
    return out


def _codes(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.int64)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def _narrow(short: list[str], long: list[str]) -> np.ndarray:
    """Windows of all pairs at once: a bit per place of the shorter text, a vector step per place of the window.

    The recurrence keeps, in the zero bits of ``state``, where the common subsequence grows; their number is its length.
    """
    width, length = np.array([len(s) for s in short]), np.array([len(t) for t in long])
    s, t = _codes(short, -1), _codes(long, -2)
    hits = np.zeros(t.shape, np.uint64)  # places of the shorter text that equal this character of the longer one
    for i in range(s.shape[1]):
        hits |= (s[:, i : i + 1] == t).astype(np.uint64) << np.uint64(i)
    starts = np.arange(1 - width.max(), length.max())[None, :]
    used = (starts > -width[:, None]) & (starts < length[:, None])
    inside = np.where(width == 64, np.uint64(2**64 - 1), (np.uint64(1) << (width % 64).astype(np.uint64)) - np.uint64(1))[:, None]
    state = np.repeat(inside, starts.shape[1], axis=1)
    rows = np.arange(len(short))[:, None]
    for k in range(width.max()):
        at = starts + k
        read = used & (k < width[:, None]) & (at >= 0) & (at < length[:, None])
        step = state & hits[rows, np.clip(at, 0, t.shape[1] - 1)]
        state = np.where(read, (state + step) | (state - step), state)
    common = width[:, None] - np.bitwise_count(state & inside)
    sizes = np.minimum(starts + width[:, None], length[:, None]) - np.maximum(starts, 0)
    scores = np.where(used, 200.0 * common / np.maximum(width[:, None] + sizes, 1), 0.0)
    return scores.max(axis=1)


def _wide(short: str, long: str) -> float:
    """The same for a shorter text of more than 64 characters, on whole numbers of any size."""
    width, best = len(short), 0.0
    places: dict[str, int] = {}
    for i, x in enumerate(short):
        places[x] = places.get(x, 0) | 1 << i
    inside = (1 << width) - 1
    for start in range(1 - width, len(long)):
        window, state = long[max(0, start) : start + width], inside
        for y in window:
            step = state & places.get(y, 0)
            state = (state + step) | (state - step)
        best = max(best, 200.0 * (width - (state & inside).bit_count()) / (width + len(window)))
    return best


@F.pandas_udf(DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a))
    here = (a.notna() & b.notna()).to_numpy()
    out[here] = partial_similarities(a[here].tolist(), b[here].tolist())
    return pd.Series(out)


def tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda x: x != "")))


def shares_token(a: Column, b: Column) -> Column:
    return F.arrays_overlap(tokens(a), tokens(b))


def _once(body: Callable[[Column], Column], **values: Column) -> Column:
    """An expression over values that are worked out once, however often it uses them."""
    return F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), body)[0]


def most_possible(a: Column, b: Column) -> Column:
    """An upper bound of the partial similarity from character counts alone.

    A common subsequence is at most ``c`` long, the number of characters both texts have (with repeats). No window does better than one
    that consists of just these: ``200 * c / (width + c)``, ``width`` the length of the shorter text.
    """
    def times(text: Column, x: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, x, F.lit("")))

    def bound(p: Column) -> Column:
        shared = F.aggregate(F.array_distinct(F.regexp_extract_all(p["s"], F.lit("(?s)."), F.lit(0))), F.lit(0), lambda n, x: n + F.least(times(p["s"], x), times(p["t"], x)))
        return F.when(F.length(p["s"]) == 0, F.lit(0.0)).otherwise(_once(lambda q: 200.0 * q["c"] / (q["w"] + q["c"]), c=shared, w=F.length(p["s"])))
    ordered = _once(lambda p: F.when(F.length(p["a"]) <= F.length(p["b"]), F.struct(p["a"].alias("s"), p["b"].alias("t"))).otherwise(F.struct(p["b"].alias("s"), p["a"].alias("t"))), a=a, b=b)
    return F.transform(F.array(ordered), bound)[0]


def _decision(a: Column, b: Column, least: float) -> Column:
    """``(score, one, other)``: the similarity where it can be told in the JVM, else the sorted tokens that must be compared."""
    def decided(p: Column) -> Column:
        one, other = F.array_join(p["l"], " "), F.array_join(p["r"], " ")
        score = F.when(F.arrays_overlap(p["l"], p["r"]), F.lit(100.0)).when((F.size(p["l"]) == 0) | (F.size(p["r"]) == 0), F.lit(0.0))
        if least > 0:
            score = score.when(most_possible(one, other) < least - 1e-9, F.lit(0.0))
        return F.struct(score.alias("score"), F.when(score.isNull(), one).alias("one"), F.when(score.isNull(), other).alias("other"))
    return F.array(_once(decided, l=tokens(a), r=tokens(b)))


def add_similarity(df: DataFrame, a: Column, b: Column, name: str, least: float = 0.0) -> DataFrame:
    """Similarity score of two lower-cased names as column ``name``. Pairs that share a token are decided in the JVM, and so are those that
    cannot reach ``least``: they get 0. Only the rest reach Python."""
    # a generator keeps the decision from being repeated in every place that uses it
    out = df.select("*", F.inline(_decision(a, b, least)).alias("_score", "_one", "_other"))
    return out.withColumn(name, F.coalesce("_score", _partial(F.col("_one"), F.col("_other")))).drop("_score", "_one", "_other")


def _both(least: float):
    def similarities(a: pa.Array, b: pa.Array, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        here = np.flatnonzero(chosen & a.is_valid().to_numpy(zero_copy_only=False))
        out[here] = partial_similarities(a.take(here).to_pylist(), b.take(here).to_pylist())
        return out

    def run(one: pa.Array, other: pa.Array, one2: pa.Array, other2: pa.Array) -> pa.Array:
        first = similarities(one, other, np.ones(len(one), bool))
        second = similarities(one2, other2, one.is_null().to_numpy(zero_copy_only=False) | (first >= least))
        return pa.StructArray.from_arrays([pa.array(first), pa.array(second)], names=["first", "second"])
    run.__annotations__ = {"one": pa.Array, "other": pa.Array, "one2": pa.Array, "other2": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "first double, second double").asNondeterministic()  # so that no filter has it run a second time


def keep_similar(df: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column], names: tuple[str, str], least: float) -> DataFrame:
    """Rows of which both pairs of lower-cased names reach ``least``, with their scores as columns ``names``.

    What the JVM can tell of either pair is told first, and drops its rows. The rest meet one function that works out both scores, the
    second only where the first is enough: one Python worker a task.
    """
    scores = ["_score", "_score2"]
    parts = [scores[0], "_one", "_other"], [scores[1], "_one2", "_other2"]
    for pair, part in zip((first, second), parts):
        df = df.select("*", F.inline(_decision(*pair, least)).alias(*part)).where(F.coalesce(part[0], F.lit(least)) >= least)
    df = df.withColumn("_both", _both(least)("_one", "_other", "_one2", "_other2"))
    found = (F.coalesce(s, f"_both.{field}") for s, field in zip(scores, ("first", "second")))
    df = df.withColumns(dict(zip(names, found))).drop("_both", *parts[0], *parts[1])
    return df.where((F.col(names[0]) >= least) & (F.col(names[1]) >= least))
