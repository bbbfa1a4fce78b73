"""Splits, sampling and weights: time decay, value, class balance, fuzzy augmentation of rejects and population balancing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gatewise.operators.encoders import apply_cap_floor, fit_cap_floor, min_max_scale
from gatewise.operators.windows import edge_bin, exact_quantiles, positions_within, quantile_edges


def tag_split(df: DataFrame, date: str, limits: list[tuple[str, str]], last: str, name: str = "data_type") -> DataFrame:
    """Tag rows by date: each ``(name, first day after it)`` in order, later rows get ``last``."""
    column = None
    for tag, end in limits:
        hit = F.col(date) < F.lit(end).cast("date")
        column = F.when(hit, F.lit(tag)) if column is None else column.when(hit, F.lit(tag))
    return df.withColumn(name, column.otherwise(F.lit(last)))


def key_fraction(key: str, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the key and seed only, not on how the rows are partitioned."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def random_halves(df: DataFrame, key: str, seed: int = 111, name: str = "half") -> DataFrame:
    return df.withColumn(name, F.when(key_fraction(key, seed) < 0.5, F.lit("test")).otherwise(F.lit("val")))


def stratified_sample(df: DataFrame, stratum: str, key: str, fraction: float = 0.05, seed: int = 111) -> DataFrame:
    """Exactly ``round(fraction * rows)`` rows per stratum, in order of a hash of the key. A hot stratum is ranked in parts."""
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    marked = df.withColumn("_h", hashed)
    placed = positions_within(marked, [stratum], F.shiftrightunsigned("_h", 58), ["_h", key])
    return placed.filter(F.col("position") < F.round(F.col("group_size") * F.lit(fraction))).drop("_h", "position", "group_size")


def time_decay(df: DataFrame, date: str, name: str = "decay_weight") -> DataFrame:
    """``exp(d / max |d|)`` with ``d`` = days before the last date (negative), scaled so the weights sum to the row count."""
    ends = df.agg(F.min(date), F.max(date)).first()
    if ends[0] is None or ends[0] == ends[1]:
        return df.withColumn(name, F.lit(1.0))
    raw = F.exp(F.date_diff(F.col(date), F.lit(ends[1])) / F.lit(float((ends[1] - ends[0]).days)))
    total = df.agg(F.count(F.lit(1)) / F.sum(raw)).first()[0]
    return df.withColumn(name, raw * F.lit(total))


def value_weight(df: DataFrame, approved: str, amount: str, name: str = "value_weight") -> DataFrame:
    """Min-max of (approved + min-max amount), scaled to mean 1."""
    a = min_max_scale(df, {"_a": F.col(amount).cast("double")})
    v = min_max_scale(a, {"_v": F.col(approved) + F.col("_a")})
    mean = v.agg(F.avg("_v")).first()[0] or 1.0
    return v.withColumn(name, F.col("_v") / F.lit(mean)).drop("_a", "_v")


def combined_weight(df: DataFrame, approved: str, amount: str, weight: str, name: str = "train_weight") -> DataFrame:
    """Value weights for approved rows, scaled to keep their total weight; rejected rows keep their own weight.

    The scaling runs over approved rows only, so rejects are not counted twice.
    """
    km = F.col(approved) == 1
    ends = df.filter(km).agg(F.min(amount).alias("a0"), F.max(amount).alias("a1")).first()
    span = (ends["a1"] - ends["a0"]) if ends["a0"] is not None else 0
    part = (F.col(amount) - F.lit(ends["a0"])) / F.lit(span) if span else F.lit(0.0)
    raw = F.col(weight) + part
    lims = df.filter(km).agg(F.min(raw).alias("r0"), F.max(raw).alias("r1")).first()
    width = (lims["r1"] - lims["r0"]) if lims["r0"] is not None else 0
    scaled = (raw - F.lit(lims["r0"])) / F.lit(width) if width else F.lit(1.0)
    sums = df.filter(km).agg(F.sum(weight).alias("w"), F.sum(scaled).alias("v")).first()
    factor = (sums["w"] / sums["v"]) if sums["v"] else 1.0
    return df.withColumn(name, F.when(km, scaled * F.lit(factor)).otherwise(F.col(weight)))


def positive_class_weight(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Weight of negatives over weight of positives."""
    w, y = F.col(weight).cast("double"), F.col(label) == 1
    return df.agg(F.try_divide(F.sum(F.when(~y, w).otherwise(0.0)), F.sum(F.when(y, w).otherwise(0.0))).alias("scale_pos_weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * rows of the class)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_t", whole).select(label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("class_weight"))


def training_weight(df: DataFrame, date: str, approved: str, amount: str, weight: str, label: str, name: str = "fit_weight") -> DataFrame:
    """The weight a model is fitted with: time decay, value-combined weight and class weight multiplied, and scaled to the row count."""
    out = combined_weight(time_decay(df, date, "_decay"), approved, amount, weight, "_combined")
    counts = out.agg(F.count("*").alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("y")).first()
    n, y = counts["n"], counts["y"] or 0
    of_class = F.when(F.col(label) == 1, n / (2 * y) if y else 1.0).otherwise(n / (2 * (n - y)) if n > y else 1.0)
    out = out.withColumn(name, F.col("_decay") * F.col("_combined") * of_class).drop("_decay", "_combined")
    total = out.agg(F.sum(name)).first()[0]
    return out.withColumn(name, F.col(name) * F.lit(n / total if total else 1.0))


def augment_rejects(df: DataFrame, approved: str, label: str, probability: str, weight: str = "weights") -> DataFrame:
    """Approved rows once at weight 1; each reject twice: label 1 at weight p and label 0 at weight 1 - p. A narrow step."""
    kind = df.schema[label].dataType
    p = F.col(probability).cast("double")
    own = F.array(F.struct(F.col(label).alias("_y"), F.lit(1.0).alias("_w")))
    both = F.array(F.struct(F.lit(1).cast(kind).alias("_y"), p.alias("_w")), F.struct(F.lit(0).cast(kind).alias("_y"), (1 - p).alias("_w")))
    rest = [c for c in df.columns if c != label]
    return df.select(*rest, F.explode(F.when(F.col(approved) == 1, own).otherwise(both)).alias("_r")).select(*rest, F.col("_r._y").alias(label), F.col("_r._w").alias(weight))


# ---- population balancing ----------------------------------------------------------------------------------------

def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance from one aggregate of k*k numbers (centred co-moments, stable at scale)."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)),
                 *(F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


def fit_balancing(population: DataFrame, columns: list[str], bins: int = 200, components: int | None = None, log_score: bool = True,
                  scale_total: bool = True, buckets: int = 8) -> dict:
    """Density model of a population: median imputation, capping at 0.5 % and 99.5 %, standardising, principal components, Gaussian.

    Quantiles and moments are distributed aggregates; only k*k numbers reach the driver.
    """
    medians = {c: exact_quantiles(population.filter(F.col(c).isNotNull()), c, [0.5], buckets)[0] for c in columns}
    filled = population.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns})
    limits = fit_cap_floor(filled, columns, 0.005, 0.995, buckets)
    n, mean, cov = moments(apply_cap_floor(filled, limits), columns)
    std = np.sqrt(np.diag(cov))
    std[std == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    order = np.argsort(values)[::-1][: components or len(columns)]
    keep = [i for i in order if values[i] > 1e-10]
    fit = {"columns": columns, "medians": medians, "limits": limits, "mean": mean.tolist(), "std": std.tolist(), "variance": (values[keep] * n / max(n - 1, 1)).tolist(),
           "loadings": vectors[:, keep].T.tolist(), "log_score": log_score, "total": 1.0}
    scored = with_density(population, fit)
    if scale_total:
        fit["total"] = scored.agg(F.sum("_density")).first()[0]
        scored = with_density(population, fit)
    fit["edges"] = quantile_edges(scored, "_density", bins, buckets)
    counts = scored.groupBy(edge_bin("_density", fit["edges"]).alias("b")).agg(F.count("*").alias("n")).collect()
    fit["population"] = {r["b"]: r["n"] for r in counts}
    return fit


def with_density(df: DataFrame, fit: dict) -> DataFrame:
    """Gaussian (log-)density of each row as one arithmetic expression."""
    z = []
    for i, c in enumerate(fit["columns"]):
        low, high = fit["limits"][c]
        x = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.col(c).cast("double"), F.lit(float(fit["medians"][c])))))
        z.append((x - F.lit(fit["mean"][i])) / F.lit(fit["std"][i]))
    out = F.lit(-0.5 * sum(math.log(2 * math.pi * v) for v in fit["variance"]))
    for variance, loading in zip(fit["variance"], fit["loadings"]):
        part = sum((F.lit(a) * c for a, c in zip(loading, z)), F.lit(0.0))
        out = out - part * part / F.lit(2 * variance)
    return df.withColumn("_density", (out if fit["log_score"] else F.exp(out)) / F.lit(fit["total"]))


def balance_weights(sample: DataFrame, fit: dict, name: str = "weight") -> DataFrame:
    """Weight per sample row: population share over sample share of its density bin. Empty bins raise."""
    scored = with_density(sample, fit)
    edges = [-math.inf, *fit["edges"][1:-1], math.inf]
    binned = scored.withColumn("_bin", edge_bin("_density", edges))
    counts = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.count("*").alias("n")).collect()}
    if len(counts) != len(edges) - 1:
        raise ValueError("some bins have no sample rows; use a lower number of bins")
    people, rows = sum(fit["population"].values()), sum(counts.values())
    ratio = {b: (fit["population"].get(b, 0) / people) / (n / rows) for b, n in counts.items()}
    pairs = [x for b, r in ratio.items() for x in (F.lit(b), F.lit(r))]
    return binned.withColumn(name, F.element_at(F.create_map(*pairs), F.col("_bin"))).drop("_bin", "_density")


def balancing_report(population: DataFrame, sample: DataFrame, weight: str, columns: list[str]) -> DataFrame:
    """Mean of each column in the population, the sample and the weighted sample."""
    def long(df: DataFrame, expr, name: str) -> DataFrame:
        return df.agg(*(expr(c).alias(c) for c in columns)).unpivot([], columns, "feature", name)
    w = F.col(weight).cast("double")
    plain = long(sample, lambda c: F.avg(F.col(c).cast("double")), "sample_mean")
    weighted = long(sample, lambda c: F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))), "sample_mean_w")
    whole = long(population, lambda c: F.avg(F.col(c).cast("double")), "population_mean")
    return plain.join(weighted, "feature").join(whole, "feature")
