"""Models on MLlib: boosted and readable trees, parameter search, calibration, contributions and time-wise validation.

Data stays distributed during training; what reaches the driver is a fitted model, its node table, or a metric row.
"""

from __future__ import annotations

import math
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gatewise.operators import evaluate as V
from gatewise.operators.weights import augment_rejects
from gatewise.operators.windows import time_folds
from gatewise.session import checkpoint_folder, staged


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector column; persist the result when several fits follow."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def fit_boosted(df: DataFrame, label: str, weight: str | None = None, validation: str | None = None, rounds: int = 20, depth: int = 3, step: float = 0.1,
                min_rows: int = 1, subsample: float = 1.0, columns: str = "all", seed: int = 111):
    """Boosted trees on assembled features. ``validation`` marks held-out rows: training stops when they no longer improve."""
    checkpoint_folder(df.sparkSession)
    model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=min_rows, subsamplingRate=subsample,
                          featureSubsetStrategy=columns, seed=seed, checkpointInterval=10)
    if weight:
        model = model.setWeightCol(weight)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return model.fit(df)


def with_probability(df: DataFrame, model, name: str = "probability") -> DataFrame:
    out = model.transform(df)
    drop = [c for c in ("rawPrediction", "prediction", "probability") if c in out.columns and c != name]
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*drop)


def node_table(model, spark) -> DataFrame:
    """Nodes of a fitted tree model, read back from its saved form: tree, node, value, rows, children and split."""
    folder = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    if "nodeData" not in saved.columns:
        saved = saved.select(F.lit(0).alias("treeID"), F.struct(*saved.columns).alias("nodeData"))
    n = F.col("nodeData")
    return saved.select(F.col("treeID").alias("tree"), n.id.alias("node"), n.prediction.alias("value"), n.rawCount.alias("rows"), n.impurityStats.alias("stats"),
                        n.leftChild.alias("left"), n.rightChild.alias("right"), n.split.featureIndex.alias("feature"), n.split.leftCategoriesOrThreshold.alias("threshold"),
                        n.split.numCategories.alias("categories"))


def fit_rule_tree(df: DataFrame, label: str, weight: str | None = None, depth: int = 3, seed: int = 42):
    """A shallow weighted tree to read rules from."""
    model = DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=depth, seed=seed)
    return (model.setWeightCol(weight) if weight else model).fit(df)


def tree_rules(model, df: DataFrame, features: list[str]) -> DataFrame:
    """One row per leaf: its conditions as text, rows and weighted positive share. At most 2^depth nodes reach the driver."""
    nodes = {r["node"]: r for r in node_table(model, df.sparkSession).collect()}
    rows = []

    def walk(i: int, path: list[str]) -> None:
        n = nodes[i]
        if n["left"] < 0:
            total = sum(n["stats"])
            rows.append((len(rows), " and ".join(path) or "all", int(n["rows"]), float(n["stats"][1] / total) if total else 0.0))
            return
        name = features[n["feature"]]
        if n["categories"] == -1:
            cut = n["threshold"][0]
            left, right = f"{name} <= {cut:g}", f"{name} > {cut:g}"
        else:
            left, right = f"{name} in {sorted(n['threshold'])}", f"{name} not in {sorted(n['threshold'])}"
        walk(n["left"], path + [left])
        walk(n["right"], path + [right])
    walk(0, [])
    return df.sparkSession.createDataFrame(rows, "leaf int, rule string, n bigint, positive_share double")


def fit_category_model(df: DataFrame, categories: list[str], numbers: list[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees straight on categories (frequency-indexed; unseen values share one extra index)."""
    checkpoint_folder(df.sparkSession)
    indexer = StringIndexer(inputCols=categories, outputCols=[f"{c}_index" for c in categories], handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*(f"{c}_index" for c in categories), *numbers], outputCol="features")
    trees = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, maxBins=128)
    return Pipeline(stages=[indexer, vector, trees.setWeightCol(weight) if weight else trees]).fit(df)


def importances(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def sampled_grid(space: dict[str, list], trials: int, seed: int) -> list[dict]:
    """``trials`` distinct parameter combinations, drawn with a seed."""
    sizes = [len(values) for values in space.values()]
    drawn = random.Random(seed).sample(range(math.prod(sizes)), min(trials, math.prod(sizes)))
    grid = []
    for place in drawn:  # the place in the product, read as a number with one digit per parameter
        digits = []
        for n in reversed(sizes):
            place, digit = divmod(place, n)
            digits.append(digit)
        grid.append({name: values[k] for (name, values), k in zip(space.items(), reversed(digits))})
    return grid


def search_boosted(train: DataFrame, test: DataFrame, label: str, weight: str, space: dict[str, list], trials: int, seed: int = 111, parallelism: int = 2) -> tuple[dict, DataFrame]:
    """Fit sampled parameter sets and score each by weighted log-loss on the test rows. Failures raise.

    Each trial is a distributed fit; several are submitted at once so that their jobs share the cluster.
    """
    grid = sampled_grid(space, trials, seed)

    def trial(params: dict) -> float:
        scored = with_probability(test, fit_boosted(train, label, weight, seed=seed, **params))
        return V.log_loss(scored, "probability", label, weight).first()[0]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        losses = list(pool.map(trial, grid))
    names = list(space)
    rows = [(i, *(float(p[n]) for n in names), float(loss)) for i, (p, loss) in enumerate(zip(grid, losses))]
    table = train.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{n} double" for n in names) + ", loss double")
    return grid[int(np.argmin(losses))], table


def search_halving(train: DataFrame, test: DataFrame, key: str, label: str, weight: str, space: dict[str, list], trials: int, least: float = 0.05, keep: int = 3,
                   seed: int = 111, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """Successive halving: all sampled parameter sets on a small share of the training rows, the best ``1 / keep`` of them on ``keep`` times as many, and so on.

    Shares are nested samples by a hash of ``key``; the last one is everything, and about ``trials * least`` sets reach it, so the number of full fits
    does not follow the number of trials. Trials of a rung are submitted at once, ``parallelism`` at a time. Losses are weighted log-losses on all
    test rows. Gives the best set of the last rung and all losses ``(rung, share, trial, parameters, loss)``; ties go to the earlier trial.
    """
    grid = sampled_grid(space, trials, seed)
    shares = [1.0]
    while shares[0] > least:
        shares.insert(0, max(shares[0] / keep, least))
    spot = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    marked = staged(train.withColumn("_spot", spot))
    test = staged(test)
    alive, rows = list(range(len(grid))), []
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for rung, share in enumerate(shares):
            sample = marked.where(F.col("_spot") < share)

            def loss(trial: int) -> float:
                scored = with_probability(test, fit_boosted(sample, label, weight, seed=seed, **grid[trial]))
                return V.log_loss(scored, "probability", label, weight).first()[0]
            losses = dict(zip(alive, pool.map(loss, alive)))
            rows += [(rung, float(share), i, *(float(grid[i][n]) for n in space), float(x)) for i, x in losses.items()]
            ranked = sorted(alive, key=lambda i: (losses[i], i))
            alive = sorted(ranked[: max(1, -(-len(ranked) // keep))])
    table = train.sparkSession.createDataFrame(rows, "rung int, share double, trial int, " + ", ".join(f"{n} double" for n in space) + ", loss double")
    return grid[ranked[0]], table


def fit_calibration(df: DataFrame, score: str, label: str, weight: str | None = None):
    """Sigmoid calibration of a score with smoothed targets: each row counts as positive with weight t and negative with 1 - t."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label) == 1
    n = df.agg(F.sum(F.when(y, w).otherwise(0.0)).alias("p"), F.sum(F.when(~y, w).otherwise(0.0)).alias("n")).first()
    target = F.when(y, F.lit((n["p"] + 1) / (n["p"] + 2))).otherwise(F.lit(1 / (n["n"] + 2)))
    both = df.select(F.col(score).cast("double").alias("_s"), F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (w * target).alias("w")),
                                                                                F.struct(F.lit(0.0).alias("y"), (w * (1 - target)).alias("w")))).alias("_r"))
    data = VectorAssembler(inputCols=["_s"], outputCol="features").transform(both.select("_s", "_r.y", "_r.w"))
    return LogisticRegression(labelCol="y", weightCol="w", regParam=0.0, maxIter=50, tol=1e-7).fit(data)


def calibrated(score: str, fit) -> Column:
    """Calibrated probability as an expression."""
    return 1 / (1 + F.exp(-(F.lit(float(fit.coefficients[0])) * F.col(score) + F.lit(float(fit.intercept)))))


def score_table(df: DataFrame, keys: list[str], calibrated_p: str, raw_p: str, label: str, amount: str, approved: str, weight: str, date: str) -> DataFrame:
    """Whole scores (half to even), calibrated and not, with label, amount, weight and weighted label."""
    return df.select(*keys, label, F.col(date).alias("created_on"), amount, V.to_score(calibrated_p).alias("rating"), V.to_score(raw_p).alias("rating_uncalibrated"),
                     F.col(weight).alias("weight"), approved, (F.col(label) * F.col(weight)).alias("label_w"))


# ---- contributions -----------------------------------------------------------------------------------------------

def scorecard_contributions(coefficients: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """Contribution of each feature of a linear score: coefficient times the distance from the mean."""
    return {f: F.lit(float(c)) * (F.col(f) - F.lit(float(means[f]))) for f, c in coefficients.items()}


def top_reason(contributions: dict[str, Column]) -> Column:
    """Feature with the largest signed contribution; the first one wins a tie."""
    ranked = [F.struct(c.alias("value"), F.lit(-i).alias("order"), F.lit(f).alias("feature")) for i, (f, c) in enumerate(contributions.items())]
    return F.array_max(F.array(*ranked)).getField("feature")


def path_contributions(df: DataFrame, model, features: list[str], name: str = "contributions") -> DataFrame:
    """Contribution per feature of a boosted model: along each tree path, the change of node value is credited to the split feature.

    The node table (trees times nodes, bounded by the model) travels with the function; rows are handled in Arrow batches
    with one vector operation per node.
    """
    nodes = [r.asDict() for r in node_table(model, df.sparkSession).collect()]
    weights = list(model.treeWeights)
    trees: dict[int, dict[int, dict]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n

    @F.pandas_udf(ArrayType(DoubleType()))
    def attribute(batch: pd.Series) -> pd.Series:
        x = np.array(batch.tolist(), dtype="float64").reshape(len(batch), -1)
        out = np.zeros((len(batch), len(features)))
        for t, tree in trees.items():
            pending = [(0, np.ones(len(batch), dtype=bool))]
            while pending:
                i, here = pending.pop()
                n = tree[i]
                if n["left"] < 0:
                    continue
                f = n["feature"]
                goes_left = x[:, f] <= n["threshold"][0] if n["categories"] == -1 else np.isin(x[:, f], n["threshold"])
                for child, rows in ((n["left"], here & goes_left), (n["right"], here & ~goes_left)):
                    out[rows, f] += weights[t] * (tree[child]["value"] - n["value"])
                    pending.append((child, rows))
        return pd.Series(list(out))
    return df.withColumn(name, attribute(vector_to_array("features")))


def reason_from_array(name: str, features: list[str]) -> Column:
    c = F.col(name)
    return F.element_at(F.array(*map(F.lit, features)), F.array_position(c, F.array_max(c)).cast("int"))


def mean_contribution(df: DataFrame, contributions: dict[str, Column]) -> DataFrame:
    """Mean absolute contribution per feature."""
    wide = df.agg(*(F.avg(F.abs(c)).alias(f) for f, c in contributions.items()))
    return wide.unpivot([], list(contributions), "feature", "mean_abs")


def dependence(df: DataFrame, value: Column, contribution: Column) -> DataFrame:
    """Mean contribution per value bin of one feature."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.avg(contribution).alias("contribution"))


# ---- time-wise validation ----------------------------------------------------------------------------------------

def time_cross_validation(df: DataFrame, date: str, key: str, label: str, weight: str, approved: str, folds: int = 5, within: Column | None = None,
                          limits: tuple = (0, 100, 10, 100, 15, 45), inferred: str | None = None, parallelism: int = 3, **params) -> DataFrame:
    """Train on everything before each block of time, calibrate, score; AUC per fold, split and population, and thresholds.

    ``df`` carries assembled features. With ``inferred``, a column of probabilities, labels of rows that are not approved stay unseen: each
    counts twice, as 1 and as 0, weighted by its probability. Rows are placed in time first, so both halves are in one fold.
    Long result ``(fold, split, population, metric, value)``.
    """
    placed = time_folds(df, date, key, folds, within)
    if inferred:
        halves = augment_rejects(placed, approved, label, inferred, "_share").withColumn(weight, F.col(weight) * F.col("_share"))
        placed = halves.filter(F.col("_share") > 0).drop("_share", inferred)
    placed = staged(placed, ["fold"])  # a fold reads the folders of its own blocks only

    def one(f: int) -> DataFrame:
        rows = placed.filter(F.col("fold") <= f).withColumn("split", F.when(F.col("fold") == f, "Test").otherwise("Train"))
        train = placed.filter(F.col("fold") < f)
        model = fit_boosted(train, label, weight, **params)
        fit = fit_calibration(with_probability(train, model), "probability", label, weight)
        scored = with_probability(rows, model).withColumn("_p", calibrated("probability", fit)).withColumn("score", V.to_score("_p"))
        scored = staged(scored.select("split", "score", label, weight, approved))
        people = F.when(F.col(approved) == 1, F.array(F.lit("RM"), F.lit("KM"))).otherwise(F.array(F.lit("RM")))
        areas = V.auc(scored.withColumn("population", F.explode(people)), "score", label, weight, ["split", "population"])
        metric = areas.select(F.lit(f).alias("fold"), "split", "population", F.lit("auc").alias("metric"), F.col("auc").alias("value"))
        edges = V.threshold_search(scored.filter(F.col("split") == "Test"), "score", label, approved, weight, *limits)
        edge = edges.select(F.lit(f).alias("fold"), F.lit("Test").alias("split"), F.lit("RM").alias("population"), F.concat(F.lit("threshold_"), "edge").alias("metric"),
                            F.col("threshold").cast("double").alias("value"))
        return metric.unionByName(edge)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:  # jobs of different folds share the cluster
        return reduce(DataFrame.unionByName, pool.map(one, range(1, folds + 1)))


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return metrics.groupBy("split", "population", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
