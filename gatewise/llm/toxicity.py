"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewise.session import staged

LABEL_BROADCAST = 4_000_000  # labelled ids are broadcast up to this count (some 60 MB), beyond it they are joined by shuffle

# Second-person words of the languages at hand, and look-alike characters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vos vosotros".split())
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")

TOKEN = re.compile(r"[^\s.,;:?\"()\[\]{}|]+")
CAPITALS = re.compile(rb"\b[A-Z]{2,}\b")
UPPER, PUNCTUATION, DIGITS = bytes(range(65, 91)), bytes(c for c in range(33, 127) if not chr(c).isalnum()), b"0123456789"
EDGES = "!#$%&*+-/<=>@^_~'`|"
ROWS = 256  # rows that a task works on at a time
FEATURES = ["hit_density", "weight_density", "heaviest", "hits", "distinct_hits", "obfuscated_hits", "near_second_person", "second_person", "capital_letters", "capital_words", "punctuation", "exclamations", "obfuscated_words", "digits", "words"]


def plain(token: str) -> tuple[str, bool]:
    """A lower-case token without symbols at its ends, look-alike characters undone; whether it was obfuscated inside."""
    bare = token.strip(EDGES)
    if bare.isalpha():
        return bare, False
    if not any(c.isalpha() for c in bare):
        return bare, False
    return "".join(c for c in bare.translate(LOOK_ALIKE) if c.isalpha()), True


def _word_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[label].update({plain(t)[0] for t in set(TOKEN.findall((text.as_py() or "").lower()))})
            if len(counts[label]) > 200_000:
                yield from _emit(counts)
    yield from _emit(counts)


def _emit(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    for label, c in enumerate(counts):
        if c:
            n = pa.array(list(c.values()), pa.int64())
            zero = pa.array([0] * len(c), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), n if label else zero, zero if label else n], names=["word", "toxic", "clean"])
            c.clear()


def odds(toxic: float, clean: float, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def learn_lexicon(labelled: DataFrame, support: int = 4, share: float = 0.0005, least: float = 1.2, z: float = 2.5) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Words whose document frequency is clearly higher among toxic texts: ``word -> (toxic, clean)``, and the numbers of texts.

    Counts cover all labelled rows and are summed by Spark; every word that meets the limits is kept. A word must stand in
    ``support`` toxic texts and in the ``share`` of them, so the lexicon has at most (distinct words of a mean toxic text) / ``share`` words,
    however many texts there are.
    """
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    words = labelled.select("text", "label").mapInArrow(_word_labels, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= max(support, share * n1)) & (F.col("word") != ""))
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    sure = weight / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = words.where((weight >= least) & (sure >= z)).collect()
    return {r["word"]: (r["toxic"], r["clean"]) for r in top}, n1, n0


def text_features(text: str | None, lexicon: dict[str, tuple[int, int]], n1: int, n0: int, label: int | None = None) -> list[float]:
    """Dense features of a whole text. For a training row its own label is taken out of the lexicon's counts first."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    tokens = TOKEN.findall(text.lower())
    words = max(len(tokens), 1)
    once = Counter(tokens)
    weights, obfuscated, hidden, hits, second = {}, 0, 0, 0, 0
    own1, own0 = int(label == 1), int(label == 0)
    for token, n in once.items():
        bare, odd = (token, False) if token.isalpha() else plain(token)
        obfuscated += n if odd else 0
        second += n if bare in SECOND_PERSON else 0
        found = lexicon.get(bare)
        if found:
            weight = odds(found[0] - own1, found[1] - own0, n1 - own1, n0 - own0)
            if weight > 0:
                weights[token] = min(weight, 5.0)
                hits += n
                hidden += n if odd else 0
    near = 0
    if hits and second:
        last = -99
        marks = sorted(k for k, t in enumerate(tokens) if t in weights or t in SECOND_PERSON)
        for k in marks:  # each pair of neighbours, one a hit and one a second person, within five words
            if last >= 0 and k - last <= 5 and (tokens[k] in weights) != (tokens[last] in weights):
                near += 1
            last = k
    size = len(data)
    return [hits / words, sum(w * once[t] for t, w in weights.items()) / words, max(weights.values(), default=0.0), math.log1p(hits), math.log1p(len(weights)), hidden / words, near / words, second / words,
            (size - len(data.translate(None, UPPER))) / size, len(CAPITALS.findall(data)) / words, (size - len(data.translate(None, PUNCTUATION))) / size, data.count(b"!") / words, obfuscated / words,
            (size - len(data.translate(None, DIGITS))) / size, math.log1p(words)]


def _with_features(lexicon: dict, n1: int, n0: int, at: int, label_at: int | None = None, name: str = "f"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                labels = batch.column(label_at).to_pylist() if label_at is not None else [None] * batch.num_rows
                rows = [text_features(t.as_py(), lexicon, n1, n0, y) for t, y in zip(batch.column(at), labels)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, name])
    return run


SCORE_COLUMN = "_toxicity_score"
FOLDS = 3


def _classifier(trees: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=3, stepSize=0.3, seed=3, maxBins=32)


def _calibration(sample: DataFrame, trees: int) -> tuple[list[float], list[float]]:
    """Isotonic steps from the scores that each third of the sample gets from trees fitted on the other two."""
    scored = None
    for fold in range(FOLDS):
        model = _classifier(trees).fit(sample.where(F.col("fold") != fold))
        part = model.transform(sample.where(F.col("fold") == fold)).select("label", "weight", vector_to_array("probability").getItem(1).alias("raw"))
        scored = part if scored is None else scored.unionAll(part)
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(scored)
    return [float(x) for x in steps.boundaries.toArray()], [float(y) for y in steps.predictions.toArray()]


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = 20_000, trees: int = 20) -> DataFrame:
    """``docs`` with a ``_toxicity_score`` between 0 and 1; all columns and rows stay (an input column of that name gives way).

    The lexicon comes from word counts over all rows of ``docs`` where ``learn`` holds and ``labels`` (doc_id, toxic) has 0 or 1.
    Boosted trees are fitted on a sample of these rows of about ``fit_rows`` rows at most, half from each label or all of a rarer one, drawn by a
    hash of the id and weighted back. The isotonic calibration is cross-fitted on the same sample: ranks of the label's rows by hash deal them
    into thirds, so every third has both labels, and each is scored by trees of the other two. The score is the calibrated probability; a
    fiftieth part of it is the raw one, which orders rows on the calibration's steps. Labels, language, source and id are no
    features. Rows are scored where they lie, without a shuffle.

    NULL, empty and wordless texts have all features 0 and are scored like any row. Without labelled rows every score is 0;
    with one class alone, or fewer than ``FOLDS`` rows of one, it is the smoothed share. An id labelled more than once counts with its highest
    label. Repeated rows are kept and learned from as they stand. An empty table gives no rows.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != SCORE_COLUMN])
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marked = staged(marked.select(F.col("doc_id").cast("long").alias("doc_id"), "label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn")).where("learn")
    few = F.broadcast(marked) if marked.count() <= LABEL_BROADCAST else marked
    labelled = staged(texts.join(few, "doc_id").select("doc_id", "text", "label"))
    lexicon, n1, n0 = learn_lexicon(labelled)
    names = docs.columns
    if n1 < FOLDS or n0 < FOLDS:
        share = (n1 + 1) / (n1 + n0 + 2) if n1 + n0 else 0.0
        return docs.withColumn(SCORE_COLUMN, F.lit(share))
    rates = [min(1.0, fit_rows / 2 / n) for n in (n0, n1)]
    rate = F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(spot < rate).select("doc_id", "text", "label").mapInArrow(_with_features(lexicon, n1, n0, 1, 2), "doc_id long, text string, label int, f array<double>")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit("fold")), "doc_id")  # at most about fit_rows rows
    dealt = chosen.select("label", "f", "doc_id", (F.row_number().over(order) % FOLDS).alias("fold"))
    # in a few partitions, by the sample's size: the trees pass over them many times
    parts = max(1, min(8, round((n1 * rates[1] + n0 * rates[0]) / 2_500)))
    sample = staged(dealt.select(F.col("label").cast("double").alias("label"), (1 / rate).alias("weight"), "f", "fold").coalesce(parts))
    sample = sample.select("label", "weight", "fold", array_to_vector("f").alias("features")).cache()
    # the calibration is a short list of steps between which it is linear; as an expression it stays inside generated code
    xs, ys = _calibration(sample, trees)
    prefix = "_t"
    while any(c.startswith(prefix) for c in names):  # names that are not among the input's
        prefix += "t"
    model = _classifier(trees).fit(sample).setFeaturesCol(f"{prefix}_vector").setPredictionCol(f"{prefix}_class").setRawPredictionCol(f"{prefix}_raw").setProbabilityCol(f"{prefix}_p")
    sample.unpersist()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    features = docs.mapInArrow(_with_features(lexicon, n1, n0, names.index("text"), name=f"{prefix}_f"), f"{schema}, {prefix}_f array<double>")
    scored = model.transform(features.withColumn(f"{prefix}_vector", array_to_vector(f"{prefix}_f")))
    p = vector_to_array(f"{prefix}_p").getItem(1)
    return scored.select(*[f"`{c}`" for c in names], (0.98 * _steps(p, xs, ys) + 0.02 * p).alias(SCORE_COLUMN))


def _steps(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation through ``(xs, ys)``, flat beyond the ends. The lists are the calibration's steps, at most the sample's size."""
    bounds, values = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    k = F.size(F.filter(bounds, lambda x: x <= p))
    x0, x1, y0, y1 = F.get(bounds, k - 1), F.get(bounds, k), F.get(values, k - 1), F.get(values, k)
    return F.when(k == 0, ys[0]).when(k >= len(xs), ys[-1]).otherwise(y0 + (y1 - y0) * (p - x0) / F.greatest(x1 - x0, F.lit(1e-12)))
