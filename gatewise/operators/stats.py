"""Information value, rank correlation, variance inflation, grouped tests and data profiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.operators.aggregates import long_features
from gatewise.operators.weights import moments
from gatewise.operators.windows import cumulative_by_value, cumulative_in_groups, edge_bin, quantiles_of_groups
from gatewise.session import BROADCAST_ROW_LIMIT, staged


def _long_values(df: DataFrame, features: list[str], measure: Column) -> DataFrame:
    """One row per feature and distinct value (NULL included): rows ``n`` and summed measure ``y``. All features in one scan."""
    named = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))
    rows = df.select(measure.cast("double").alias("_y"), F.explode(named).alias("_f")).select("_f.feature", "_f.v", "_y")
    return staged(rows.groupBy("feature", "v").agg(F.count("*").alias("n"), F.sum("_y").alias("y")))


def information_values(df: DataFrame, features: list[str], measure: str, continuous: bool = False, max_values: int = 10, bins: int = 5) -> DataFrame:
    """Information value of every feature at once, in a fixed number of jobs: ``feature``, ``iv``.

    A feature with few values is binned by them, others at quantiles; NULL counts as the median. Against a binary label the shares of negatives
    and positives per bin are compared, against a continuous response those of rows and of the response. Bins with an empty side
    add nothing; a single bin gives 0.
    """
    long = _long_values(df, features, F.col(measure))
    said = {r["feature"]: r for r in long.groupBy("feature").agg(F.count("v").alias("values"), F.count_if(F.col("v").isNull()).alias("nulls")).collect()}
    filled = long
    if any(r["nulls"] for r in said.values()):
        medians = quantiles_of_groups(cumulative_in_groups(long, "feature", "v", ["n"]), "feature", "v", [0.5])
        value = F.coalesce("v", _by_feature({f: m[0] for f, m in medians.items()})) if medians else F.col("v")
        filled = staged(long.select("feature", value.alias("v"), "n", "y").groupBy("feature", "v").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    wide = [f for f in features if f in said and said[f]["values"] > max_values]
    bin_of = F.col("v")
    if wide:
        edges = quantiles_of_groups(cumulative_in_groups(filled.where(F.col("feature").isin(wide)), "feature", "v", ["n"]), "feature", "v", [i / bins for i in range(bins + 1)])
        for f in wide:
            bin_of = F.when(F.col("feature") == f, edge_bin("v", sorted(set(edges[f]))).cast("double")).otherwise(bin_of)
    g = filled.groupBy("feature", bin_of.alias("bin")).agg(F.sum("n").cast("double").alias("rows"), F.sum("y").alias("y"))
    g = g.withColumn("n", F.col("rows") if continuous else F.col("rows") - F.col("y"))
    whole = W.partitionBy("feature")  # a row per bin
    shares = g.select("feature", (F.col("n") / F.sum("n").over(whole)).alias("pn"), (F.col("y") / F.sum("y").over(whole)).alias("py"))
    term = F.when((F.col("pn") > 0) & (F.col("py") > 0), (F.col("pn") - F.col("py")) * F.log(F.col("pn") / F.col("py"))).otherwise(0.0)
    return shares.groupBy("feature").agg(F.coalesce(F.round(F.sum(term), 3), F.lit(0.0)).alias("iv"))


def _by_feature(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("feature"))


def information_value(df: DataFrame, feature: str, label: str, max_values: int = 10, bins: int = 5, buckets: int = 1) -> DataFrame:
    """Information value of one feature against a binary label."""
    return information_values(df, [feature], label, False, max_values, bins)


def information_value_continuous(df: DataFrame, feature: str, response: str, max_values: int = 10, bins: int = 5, buckets: int = 1) -> DataFrame:
    """The same for a continuous response."""
    return information_values(df, [feature], response, True, max_values, bins)


def iv_strength(iv: str) -> Column:
    c = F.col(iv)
    return F.when(c >= 0.5, "suspicious").when(c >= 0.3, "strong").when(c >= 0.1, "medium").when(c >= 0.02, "weak").otherwise("useless")


def average_ranks(df: DataFrame, column: str, name: str, buckets: int = 1) -> DataFrame:
    """Average rank per distinct value; ties share the mean of their places."""
    run = cumulative_by_value(df, column, {"n": F.count(F.lit(1))}, buckets=buckets)
    return run.select(column, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, columns: list[str], buckets: int = 1) -> DataFrame:
    """Rank correlation of every column pair, over rows where all are known.

    The ranks of all columns come from one long table. A counted-small one is broadcast, so rows stay where they are; beyond
    ``BROADCAST_ROW_LIMIT`` values the rows' values meet it in one join and return by row.
    """
    rows = staged(df.select(*(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns))).dropna())
    names = rows.columns
    run = cumulative_in_groups(_long_values(rows, names, F.lit(0)), "feature", "v", ["n"])
    ranks = staged(run.select("feature", "v", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("r")))
    if ranks.count() <= BROADCAST_ROW_LIMIT:
        ranked = rows
        for c in names:
            ranked = ranked.join(F.broadcast(ranks.where(F.col("feature") == c).select(F.col("v").alias(c), F.col("r").alias(f"r{c}"))), c)
    else:
        values = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in names))
        long = rows.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(values).alias("_f")).select("row", "_f.*")
        ranked = long.join(ranks, ["feature", "v"]).groupBy("row").agg(*(F.max(F.when(F.col("feature") == c, F.col("r"))).alias(f"r{c}") for c in names))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = ranked.agg(*(F.corr(f"r{names[i]}", f"r{names[j]}").alias(f"p{i}_{j}") for i, j in pairs))
    items = F.array(*(F.struct(F.lit(columns[i]).alias("first"), F.lit(columns[j]).alias("second"), F.col(f"p{i}_{j}").alias("correlation")) for i, j in pairs))
    return wide.select(F.explode(items).alias("_p")).select("_p.*")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    items = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(items).alias("_p")).select("_p.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """k*k correlation matrix; a constant column gets zeros."""
    _, _, cov = moments(df.dropna(subset=columns), columns)
    std = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(cov / np.outer(std, std))


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation per feature: the diagonal of the inverse of the features' correlations.

    A feature that the others explain whole has no inverse; each such one counts with 0.1 % left unexplained (1,000).
    """
    corr = correlation_matrix(df, columns)
    live = [i for i in range(len(columns)) if corr[i, i] > 0]
    vif = {columns[i]: 1.0 for i in range(len(columns))}  # a constant column shares nothing
    values, vectors = np.linalg.eigh(corr[np.ix_(live, live)]) if live else (np.empty(0), np.empty((0, 0)))
    flat = values < 1e-10
    bound = (vectors[:, flat] ** 2).sum(axis=1) > 1e-8  # takes part in an exact relation
    inverse = (vectors[:, ~flat] ** 2 / values[~flat]).sum(axis=1)
    for k, i in enumerate(live):
        vif[columns[i]] = round(1000.0 if bound[k] else float(inverse[k]), 2)
    return df.sparkSession.createDataFrame(list(vif.items()), "feature string, vif double")


def explained_variance(df: DataFrame, columns: list[str], selected: list[str]) -> DataFrame:
    """Share of the total variance of ``columns`` that the selected ones explain in a least-squares sense; constant columns are left out."""
    names = list(dict.fromkeys([*columns, *selected]))
    corr = correlation_matrix(df, names)
    keep = [i for i in range(len(names)) if corr[i, i] > 0]
    chosen = [i for i in keep if names[i] in selected]
    explained = 0.0
    if chosen:
        weights, *_ = np.linalg.lstsq(corr[np.ix_(chosen, chosen)], corr[np.ix_(chosen, keep)], rcond=1e-10)
        explained = float(np.einsum("ij,ij->", weights, corr[np.ix_(chosen, keep)]))
    row = (round(explained, 3), float(len(keep)), round(explained / len(keep), 3), [n for i, n in enumerate(names) if i not in keep])
    return df.sparkSession.createDataFrame([row], "explained double, total double, ratio double, dropped array<string>")


def student_p_value(t: float, freedom: float) -> float:
    """Two-sided p of Student's t from the regularised incomplete beta function (continued fraction)."""
    if math.isnan(t):
        return float("nan")
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 300):
            for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + numerator * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + numerator / (c if abs(c) > tiny else tiny)
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def grouped_t(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Means by a 0/1 group and the pooled two-sample t per column, from one aggregate."""
    one = F.col(group) == 1
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        for g, hit in (("1", one), ("0", ~one)):
            v = F.when(hit, x)
            aggregates += [F.count(v).alias(f"n{g}_{i}"), F.avg(v).alias(f"m{g}_{i}"), F.var_samp(v).alias(f"v{g}_{i}")]
    wide = df.agg(*aggregates)
    items = []
    for i, c in enumerate(columns):
        n1, m1, v1, n0, m0, v0 = (F.col(f"{k}{g}_{i}") for g in "10" for k in "nmv")
        pooled = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
        items.append(F.struct(F.lit(c).alias("feature"), m0.alias("mean_0"), m1.alias("mean_1"), ((m1 - m0) / F.sqrt(pooled * (1 / n1 + 1 / n0))).alias("t"), (n1 + n0 - 2).alias("freedom")))
    return wide.select(F.explode(F.array(*items)).alias("_r")).select("_r.*")


def grouped_t_test(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``grouped_t`` with p-values and stars (1 %, 5 %, 10 %); one row per column passes through the driver."""
    rows = []
    for r in grouped_t(df, group, columns).collect():
        p = student_p_value(r["t"], r["freedom"]) if r["t"] is not None else float("nan")
        stars = "***" if p <= 0.01 else "**" if p <= 0.05 else "*" if p <= 0.1 else ""
        rows.append((r["feature"], r["mean_0"], r["mean_1"], r["t"], p, stars))
    return df.sparkSession.createDataFrame(rows, "feature string, mean_0 double, mean_1 double, t double, p double, significance string")


def data_profile(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Per column: type, nulls, distinct values, numeric range and mean, most frequent value with its share and label rate.

    One scan and one shuffle of (column, value) counts; ties for the most frequent value go to the smallest text.
    """
    kinds = dict(df.dtypes)
    counts = long_features(df, columns, [label]).groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum(label).alias("y"))
    v, n = F.col("value").try_cast("double"), F.col("n")
    ties = counts.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("mean"), F.min_by(F.struct("value", "n", "y"), F.struct(F.col("value").isNull(), -n, F.col("value"))).alias("top"))
    types = F.create_map(*(F.lit(x) for c in columns for x in (c, kinds[c])))
    numeric = F.element_at(types, F.col("feature")) != "string"
    return ties.select("feature", F.element_at(types, F.col("feature")).alias("kind"), "rows", "nulls", "distinct_values", F.when(numeric, F.col("low")).alias("low"), F.when(numeric, F.col("high")).alias("high"),
                       F.when(numeric, F.col("mean")).alias("mean"), F.col("top.value").alias("top_value"), (F.col("top.n") / F.col("rows")).alias("top_share"), (F.col("top.y") / F.col("top.n")).alias("top_rate"))
