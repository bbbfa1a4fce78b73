"""Operator 7: language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

PIECE = 1 << 18  # characters worked on at a time
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """One bit a code point, set for letters. Made once and unpacked by each task."""
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def grams(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams of a text, piece by piece: 21 bits a character, words set apart by one blank.

    Case is folded by str.lower, all but letters are blanks, and grams of blanks alone are left out.
    """
    for at in range(0, max(len(text), 1), PIECE):
        cp = np.frombuffer((" " + text[at : at + PIECE].lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cp = np.where(letters[cp], cp, 32)
        cp = cp[np.concatenate(([True], (cp[1:] != 32) | (cp[:-1] != 32)))]
        two = (cp[:-1] << 21) | cp[1:]
        yield np.concatenate((cp[cp != 32], two, (two[:-1] << 21) | cp[2:]))


def _count(packed: np.ndarray):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(packed).astype(bool)
        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for codes in grams(text or "", letters):
                    waiting.setdefault(lang, []).append(codes)
                    size[lang] = size.get(lang, 0) + len(codes)
                    if size[lang] > 4 * PIECE:
                        yield _counted(lang, waiting.pop(lang), schema)
                        size[lang] = 0
            for lang, codes in waiting.items():
                yield _counted(lang, codes, schema)
    return run


def _counted(lang: str, codes: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    gram, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], schema=schema)


def learn_profiles(labelled: DataFrame, size: int = 400) -> dict[str, list[int]]:
    """The ``size`` most frequent grams of each language in ``(lang, text)``, most frequent first, ties by code.

    Counts cover all texts and are summed by Spark; the driver receives ``size`` grams a language.
    """
    counts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_count(letter_table()), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    for keys in ([F.col("lang"), part], [F.col("lang")]):  # leaders of each part first, so a language is never ranked as a whole in one task
        counts = counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for r in counts.orderBy("lang", "place").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _predict(profiles: dict[str, list[int]], top: int, packed: np.ndarray):
    langs = sorted(profiles)
    universe = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
    size, miss = len(universe), max((len(p) for p in profiles.values()), default=0)
    ranks = np.full((len(langs), size + 1), miss, np.int64)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(universe, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(packed).astype(bool)
        slots, factor = _slots(universe)
        for batch in batches:
            pred, score = [], []
            for text in batch.column(1).to_pylist():
                counts = np.zeros(size + 1, np.int64)
                found = False
                for codes in grams(text or "", letters):
                    found = found or bool((codes > 32).any())
                    at = slots[((codes.astype(np.uint64) * factor) >> np.uint64(64 - 20)).astype(np.int64)]
                    counts += np.bincount(np.where(universe[np.minimum(at, size - 1)] == codes, at, size) if size else np.zeros(len(codes), np.int64), minlength=size + 1)
                if not found or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                order = np.argsort(-counts[:size], kind="stable")[:top]
                order = order[counts[order] > 0]
                place = np.arange(len(order))
                away = np.minimum(np.abs(ranks[:, order] - place), miss).sum(axis=1) if len(order) else np.full(len(langs), miss)
                best = int(np.argmin(away))
                other = np.delete(away, best).min() if len(langs) > 1 else miss * max(len(order), 1)
                pred.append(langs[best])
                score.append(float(min(1.0, max(0.0, (other - away[best]) / other))) if other > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=schema)
    return run


def _slots(universe: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A table without collisions from the top 20 bits of a product to a place in ``universe``."""
    if not len(universe):
        return np.zeros(1 << 20, np.int32), np.uint64(1)
    rng = np.random.default_rng(5)
    while True:
        factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        slot = ((universe.astype(np.uint64) * factor) >> np.uint64(64 - 20)).astype(np.int64)
        if len(np.unique(slot)) == len(slot):
            table = np.zeros(1 << 20, np.int32)
            table[slot] = np.arange(len(slot))
            return table, factor


def identify_languages(docs: DataFrame, learn: Column, size: int = 400) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``.

    Profiles rank the ``size`` most frequent 1- to 3-grams of every language, learned from rows where ``learn`` holds and ``lang`` is
    given. A document's grams are ranked by frequency over its whole text, and the language whose profile is nearest by the sum of rank
    differences (a missing gram counts ``size``) is predicted; ties go to the first language by name. Grams in no profile are as far
    from every language and are left out. ``score`` is the margin to the second-nearest language, 0 to 1.

    NULL, empty and letterless texts give ``und`` and 0, and so does everything when nothing was learned. Text whose letters occur in
    no profile gives the first language with score 0. Repeated rows and NULL ids are kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang", F.coalesce(learn, F.lit(False)).alias("learn_from"))
    profiles = learn_profiles(docs.where("learn_from").select("lang", "text"), size)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(profiles, size, letter_table()), "doc_id long, lang_pred string, score double")
