"""Aggregations: profiles, frequencies, weighted statistics, pivots and multi-feature groupings in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.operators.windows import exact_quantiles, weighted_quantiles


def rate_by(df: DataFrame, keys: list[str], label: str, amount: str) -> DataFrame:
    """Rows, positives, mean label and amount per group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate"),
                                 F.sum(amount).alias("amount"), F.avg(amount).alias("mean_amount"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Frequencies and shares of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table of null counts and shares per column, from one aggregate."""
    counted = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = counted.unpivot("_n", columns, "column", "nulls")
    return long.select("column", "nulls", (F.col("nulls") / F.col("_n")).alias("share"))


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key, from one pass over grouped counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("n"))


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(feature, value) rows. The expansion is narrow: grouping combines on the map side before anything is shuffled."""
    named = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))
    return df.select(*keep, F.explode(named).alias("_f")).select(*keep, "_f.feature", "_f.value")


def rates_by_each_feature(df: DataFrame, features: list[str], label: str, amount: str) -> DataFrame:
    """The same measures grouped by each feature alone, in one scan and one shuffle."""
    return rate_by(long_features(df, features, [label, amount]), ["feature", "value"], label, amount)


def top_values(df: DataFrame, features: list[str], label: str, by: str = "rate", n: int = 5) -> DataFrame:
    """Top ``n`` values per feature by count, sum or mean of the label (``n``, ``positives``, ``rate``); ties by value."""
    grouped = long_features(df, features, [label]).groupBy("feature", "value").agg(
        F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate"))
    order = W.partitionBy("feature").orderBy(F.col(by).desc(), F.col("value").asc())
    return grouped.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def top_k_or_other(df: DataFrame, column: str, k: int, name: str, other: str = "other") -> DataFrame:
    """Keep the ``k`` most frequent values (ties by value); the rest become ``other``."""
    kept = (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
            .orderBy(F.col("_n").desc(), column).limit(k).select(F.col(column).alias("_kept")))
    return df.join(F.broadcast(kept), F.col(column) == F.col("_kept"), "left").withColumn(name, F.coalesce("_kept", F.lit(other))).drop("_kept")


def weighted_mean_std(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weighted mean and population standard deviation. Values are shifted by the overall mean before squaring, so no second join is needed."""
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    usable = df.filter(x.isNotNull() & w.isNotNull())
    shift = usable.agg(F.sum(w * x) / F.sum(w)).scalar()
    moved = usable.withColumns({"_w": w, "_x": x - shift, "_shift": shift})
    mass, first, second = F.sum("_w"), F.sum(F.col("_w") * F.col("_x")), F.sum(F.col("_w") * F.col("_x") * F.col("_x"))
    spread = F.greatest(F.lit(0.0), second / mass - (first / mass) * (first / mass))
    return moved.groupBy(*(by or [])).agg((F.first("_shift") + first / mass).alias("mean"), F.sqrt(spread).alias("std"))


def describe(df: DataFrame, column: str, probs: list[float], buckets: int = 1) -> DataFrame:
    """Exact linear-interpolation percentiles as a long table."""
    values = exact_quantiles(df, column, probs, buckets)
    return df.sparkSession.createDataFrame([(float(p), float(v)) for p, v in zip(probs, values)], "p double, value double")


def weighted_quantile_table(df: DataFrame, value: str, weight: str, probs: list[float], old_style: bool = False, buckets: int = 1) -> DataFrame:
    found = weighted_quantiles(df, value, weight, probs, old_style, buckets)
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "place int, value double")


def share_of_total(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    grouped = df.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))
    whole = grouped.agg(F.struct(*(F.sum(m).alias(m) for m in measures))).scalar()
    return grouped.withColumn("_t", whole).select(*keys, *(F.try_divide(F.col(m), F.col(f"_t.{m}")).alias(f"{m}_share") for m in measures))


def percent_pivot(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of listed values per row key as a percentage of all of the row's records."""
    counts = df.groupBy(row).agg(F.count("*").alias("_n"), *(F.count_if(F.col(column) == v).alias(v) for v in values))
    return counts.select(row, *(F.round(100.0 * F.col(v) / F.col("_n"), 2).alias(v) for v in values))


def cross_tab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def overlap_rates(df: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """Rate of each system, and of the union and intersection of every pair and of all, in one aggregate."""
    names = list(systems)
    rates = {n: systems[n] for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            rates[f"{a}_or_{b}"] = systems[a] | systems[b]
            rates[f"{a}_and_{b}"] = systems[a] & systems[b]
    everything = systems[names[0]]
    for n in names[1:]:
        everything = everything | systems[n]
    rates["any"] = everything
    wide = df.agg(*(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in rates.items()))
    return wide.unpivot([], list(rates), "measure", "rate")
