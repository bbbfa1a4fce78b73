"""Score evaluation: curves, thresholds, bands, lift and calibration reports.

Scores are whole numbers 0..1000, so everything starts from one row per score: the only shuffle of row-level data is an
aggregate with at most 1,001 groups, and the ordered windows afterwards run on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.functions.scalars import flag
from gatewise.operators.windows import cumulative_by_value, cutoff_bins, equal_weight_bins, grouped_quantiles, share_bin

# Score scale and the score thresholds in use (medium/high and low/medium).
SCORE_SCALE = 1000
HIGH_THRESHOLD, MEDIUM_THRESHOLD = 12, 3


def to_score(probability: str) -> Column:
    """Probability to a whole score, half to even."""
    return F.bround(F.col(probability) * F.lit(SCORE_SCALE), 0).cast("int")


def check_binary(df: DataFrame, column: str) -> None:
    """Raise unless the column holds 0 and 1 only."""
    bad = df.filter(F.col(column).isNull() | ~F.col(column).isin(0, 1)).limit(1).count()
    if bad:
        raise ValueError(f"{column} must be a binary column of 0 and 1")


def check_full_bins(report: DataFrame, n: int) -> DataFrame:
    """Raise when a report has fewer than ``n`` bins."""
    if report.select("bin").distinct().count() != n:
        raise ValueError("some bins have no rows; use a lower number of bins")
    return report


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def score_curve(df: DataFrame, score: str, label: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Per score (and group), downwards: positive and negative weight with running totals."""
    w, y = _weight(weight), F.col(label).cast("double")
    return cumulative_by_value(df, score, {"pos": F.sum(w * y), "neg": F.sum(w * (1 - y))}, by=by, descending=True)


def roc_points(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    c = score_curve(df, score, label, weight)
    return c.select(F.col(score).alias("threshold"), F.try_divide("cum_neg", "total_neg").alias("fpr"), F.try_divide("cum_pos", "total_pos").alias("tpr"))


def auc(df: DataFrame, score: str, label: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids (ties between classes count half), per group when given."""
    c = score_curve(df, score, label, weight, by)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return c.groupBy(*(by or [])).agg(F.try_divide(area, F.max("total_pos") * F.max("total_neg")).alias("auc"))


def pr_points(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    c = score_curve(df, score, label, weight)
    return c.select(F.col(score).alias("threshold"), F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    F.try_divide("cum_pos", "total_pos").alias("recall"))


def pr_area(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Area under the precision-recall points by trapezoids, starting at recall 0 and precision 1."""
    p = pr_points(df, score, label, weight)
    back = W.orderBy(F.col("threshold").desc())
    step = p.select("precision", "recall", F.lag("precision", 1, 1.0).over(back).alias("p0"), F.lag("recall", 1, 0.0).over(back).alias("r0"))
    return step.agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("area"))


def calibration_bins(df: DataFrame, score: str, label: str, weight: str | None = None, n: int = 10) -> DataFrame:
    """Mean predicted and observed rate in ``n`` bins of equal weight, from low to high scores."""
    w, y, s = _weight(weight), F.col(label).cast("double"), F.col(score)
    run = cumulative_by_value(df, score, {"w": F.sum(w), "wy": F.sum(w * y), "ws": F.sum(w * s)})
    binned = run.withColumn("bin", share_bin("cum_w", "total_w", n))
    return binned.groupBy("bin").agg(F.sum("w").alias("weight"), (F.sum("ws") / F.sum("w") / SCORE_SCALE).alias("predicted"), (F.sum("wy") / F.sum("w")).alias("observed"))


# ---- thresholds --------------------------------------------------------------------------------------------------

def threshold_counts(df: DataFrame, score: str, label: str, approved: str, weight: str) -> DataFrame:
    """Per score: weight of approved positives and negatives, and of everybody, with running totals from the top."""
    w, km, y = _weight(weight), F.col(approved) == 1, F.col(label) == 1
    sums = {"pos": F.sum(F.when(km & y, w).otherwise(0.0)), "neg": F.sum(F.when(km & ~y, w).otherwise(0.0)), "all": F.sum(w)}
    return cumulative_by_value(df, score, sums, descending=True)


def _rates(pos: Column, neg: Column, every: Column) -> dict[str, Column]:
    total_pos, total_neg, total = F.col("total_pos"), F.col("total_neg"), F.col("total_all")
    return {"precision": F.coalesce(F.try_divide(100.0 * pos, pos + neg), F.lit(0.0)), "recall": F.coalesce(F.try_divide(100.0 * pos, total_pos), F.lit(0.0)),
            "fpr": F.coalesce(F.try_divide(100.0 * neg, total_neg), F.lit(0.0)), "group_size": F.coalesce(F.try_divide(100.0 * every, total), F.lit(0.0))}


def threshold_table(df: DataFrame, score: str, label: str, approved: str, weight: str) -> DataFrame:
    """For every score present: rates of the group at or above it (``above_*``) and at or below it (``below_*``), in percent."""
    c = threshold_counts(df, score, label, approved, weight)
    above = _rates(F.col("cum_pos"), F.col("cum_neg"), F.col("cum_all"))
    below = _rates(F.col("total_pos") - F.col("cum_pos") + F.col("pos"), F.col("total_neg") - F.col("cum_neg") + F.col("neg"),
                   F.col("total_all") - F.col("cum_all") + F.col("all"))
    return c.select(F.col(score).alias("score"), *(F.round(v, 3).alias(f"above_{n}") for n, v in above.items()), *(F.round(v, 3).alias(f"below_{n}") for n, v in below.items()))


def threshold_metrics(df: DataFrame, score: str, label: str, approved: str, weight: str, thresholds: list[float], side: str = "above") -> DataFrame:
    """Precision, recall, false-positive rate and group size at given thresholds; ``below`` means strictly below."""
    c = threshold_counts(df, score, label, approved, weight)
    hit = (F.col(score) >= F.col("threshold")) if side == "above" else (F.col(score) < F.col("threshold"))
    spread = c.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    g = spread.groupBy("threshold").agg(*(F.sum(F.when(hit, F.col(n)).otherwise(0.0)).alias(f"h_{n}") for n in ("pos", "neg", "all")),
                                        *(F.max(f"total_{n}").alias(f"total_{n}") for n in ("pos", "neg", "all")))
    return g.select("threshold", *(F.round(v, 3).alias(n) for n, v in _rates(F.col("h_pos"), F.col("h_neg"), F.col("h_all")).items()))


def threshold_search(df: DataFrame, score: str, label: str, approved: str, weight: str, reject_min_precision: float, reject_max_recall: float,
                     reject_max_group: float, approve_max_precision: float, approve_max_recall: float, approve_max_group: float) -> DataFrame:
    """The first threshold, stepping down from the top (or up from the bottom), whose group breaks a limit.

    Rates only change at scores that occur, so every candidate comes from one cumulative table. No row when nothing breaks.
    """
    t = threshold_table(df, score, label, approved, weight)
    upper_ok = (F.col("above_precision") >= reject_min_precision) & (F.col("above_recall") <= reject_max_recall) & (F.col("above_group_size") <= reject_max_group)
    lower_ok = (F.col("below_precision") <= approve_max_precision) & (F.col("below_recall") <= approve_max_recall) & (F.col("below_group_size") <= approve_max_group)

    def edge(rows: DataFrame, name: str, side: str, threshold: Column) -> DataFrame:
        pick = F.max_by if side == "above" else F.min_by
        best = rows.agg(pick(F.struct(threshold.alias("threshold"), *(F.col(f"{side}_{c}").alias(c) for c in ("precision", "recall", "fpr", "group_size"))), "score").alias("b"))
        return best.filter(F.col("b").isNotNull()).select(F.lit(name).alias("edge"), "b.*")
    high = edge(t.filter(~upper_ok), "medium_high", "above", F.col("score"))
    return high.unionByName(edge(t.filter(~lower_ok), "low_medium", "below", F.col("score") + 1))


# ---- bands -------------------------------------------------------------------------------------------------------

def band(score: str, high: float = HIGH_THRESHOLD, medium: float = MEDIUM_THRESHOLD) -> Column:
    c = F.col(score)
    return F.when(c >= high, "High").when(c >= medium, "Medium").when(c < medium, "Low")


def band_report(df: DataFrame, band_column: str, label: str, amount: str, approved: str, weight: str) -> DataFrame:
    """Precision, recall, lift and group size per band for all (RM, weighted) and approved (KM) members, and KM amounts; long form."""
    w, y, km = _weight(weight), F.col(label).cast("double"), F.col(approved) == 1
    sums = {"w": F.sum(w), "wy": F.sum(w * y), "kn": F.count_if(km).cast("double"), "ky": F.sum(F.when(km, y).otherwise(0.0)),
            "kw": F.sum(F.when(km, w).otherwise(0.0)), "ka": F.sum(F.when(km, F.col(amount)).otherwise(0.0))}
    whole = W.partitionBy()
    g = df.groupBy(F.col(band_column).alias("category")).agg(*(v.alias(k) for k, v in sums.items()))
    g = g.select("*", *(F.sum(k).over(whole).alias(f"t_{k}") for k in sums))
    c = F.col
    metrics = [("RM", "precision", F.try_divide(c("wy"), c("w"))), ("RM", "recall", F.try_divide(c("wy"), c("t_wy"))),
               ("RM", "lift", F.try_divide(F.try_divide(c("wy"), c("w")), F.try_divide(c("t_wy"), c("t_w")))), ("RM", "group_size", F.try_divide(c("w"), c("t_w"))),
               ("KM", "precision", F.try_divide(c("ky"), c("kn"))), ("KM", "recall", F.try_divide(c("ky"), c("t_ky"))),
               ("KM", "lift", F.try_divide(F.try_divide(c("ky"), c("kn")), F.try_divide(c("t_ky"), c("t_kn")))), ("KM", "group_size", F.try_divide(c("kw"), c("t_kw"))),
               ("KM", "amount_mean", F.try_divide(c("ka"), c("kn"))), ("KM", "amount_capture", F.try_divide(c("ka"), c("t_ka")))]
    return g.select("category", F.explode(F.array(*(F.struct(F.lit(p).alias("population"), F.lit(m).alias("metric"), v.alias("value")) for p, m, v in metrics))).alias("_m")).select(
        "_m.population", "category", "_m.metric", "_m.value")


def money_impact(df: DataFrame, band_column: str, amount: str, approved: str, months: float = 3.0, high: str = "High") -> DataFrame:
    """Amount of approved members in the high band over the period and per year, with half of each."""
    total = F.sum(F.when((F.col(approved) == 1) & (F.col(band_column) == high), F.col(amount)).otherwise(0.0))
    return df.agg(total.alias("amount")).select("amount", (0.5 * F.col("amount")).alias("half"), (F.col("amount") / months * 12).alias("yearly"), (0.5 * F.col("amount") / months * 12).alias("half_yearly"))


# ---- binned reports ----------------------------------------------------------------------------------------------

def _binned_scores(df: DataFrame, score: str, weight: str | None, n: int, cutoffs: list[float] | None, extra: dict[str, Column], buckets: int) -> DataFrame:
    if cutoffs is None:
        return equal_weight_bins(df, score, weight, n, extra, buckets)
    grouped = df.groupBy(score).agg(*(c.alias(k) for k, c in extra.items()))
    return grouped.withColumn("bin", cutoff_bins(score, cutoffs))


def lift_report(df: DataFrame, score: str, label: str, weight: str | None = None, n: int = 20, cutoffs: list[float] | None = None,
                segment: str | None = None, buckets: int = 1) -> DataFrame:
    """Cumulative precision, recall, lift, F1 and accuracy per bin of equal weight (or per cut-off), plain and weighted.

    Bins come from all rows; counts and totals from the segment (rows where ``segment`` is 1). Use ``buckets`` when
    scores are not whole numbers of a bounded range.
    """
    w, y = _weight(weight), F.col(label).cast("double")
    seg = (F.col(segment) == 1) if segment else F.lit(True)

    def within(c: Column) -> Column:
        return F.sum(F.when(seg, c).otherwise(0.0))
    extra = {"N": within(F.lit(1.0)), "weight": within(w), "responders": within(y), "responders_w": within(w * y)}
    scores = _binned_scores(df, score, weight, n, cutoffs, extra, buckets).filter(F.col("N") > 0)
    s, whole = F.col(score), W.partitionBy()
    running = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = scores.groupBy("bin").agg(*(F.sum(k).alias(k) for k in extra), F.min(s).alias("pred_min"), (F.sum(s * F.col("N")) / F.sum("N")).alias("pred_mean"), F.max(s).alias("pred_max"))
    full = base.select("*", *(F.sum(k).over(running).alias(f"c_{k}") for k in extra), *(F.sum(k).over(whole).alias(f"t_{k}") for k in extra))
    out = {"bin": F.col("bin"), "N": F.col("N").cast("bigint"), "weight": F.col("weight"), "pred_min": F.col("pred_min").cast("double"), "pred_mean": F.col("pred_mean"), "pred_max": F.col("pred_max").cast("double")}
    for suffix, mass, hits in (("", "N", "responders"), ("_w", "weight", "responders_w")):
        c_mass, c_hits, t_mass, t_hits = (F.col(f"{p}_{k}") for p, k in (("c", mass), ("c", hits), ("t", mass), ("t", hits)))
        precision, recall = F.try_divide(c_hits, c_mass), F.try_divide(c_hits, t_hits)
        out |= {f"cum_responders{suffix}": c_hits, f"cum_precision{suffix}": precision, f"cum_recall{suffix}": recall,
                f"lift{suffix}": F.try_divide(precision, F.try_divide(t_hits, t_mass)), f"f1_score{suffix}": F.try_divide(2 * c_hits, c_mass + t_hits),
                f"accuracy{suffix}": F.try_divide(2 * c_hits + t_mass - t_hits - c_mass, t_mass)}
    return full.select(*(c.alias(k) for k, c in out.items()))


def with_bins(df: DataFrame, score: str, weight: str | None = None, n: int = 20, cutoffs: list[float] | None = None, segment: str | None = None, buckets: int = 1) -> DataFrame:
    """Bin per row; rows outside the segment get NULL. The score table joins back (small when scores are bounded)."""
    if cutoffs is not None:
        out = df.withColumn("bin", cutoff_bins(score, cutoffs))
    else:
        bins = equal_weight_bins(df, score, weight, n, buckets=buckets).select(F.col(score).alias("_s"), "bin")
        out = df.join(F.broadcast(bins) if buckets <= 1 else bins, F.col(score) == F.col("_s"), "left").drop("_s")
    return out.withColumn("bin", F.when(F.col(segment) == 1, F.col("bin"))) if segment else out


# Percentiles of the statistics report.
REPORT_PERCENTILES = {"actual_percentile_1": 0.01, "actual_percentile_10": 0.10, "actual_percentile_25": 0.25, "actual_median": 0.50,
                      "actual_percentile_75": 0.75, "actual_percentile_90": 0.90, "actual_percentile_99": 0.99}


def stats_report(df: DataFrame, score: str, actual: str, weight: str | None = None, n: int = 20, cutoffs: list[float] | None = None,
                 segment: str | None = None, buckets: int = 1, value_buckets: int = 8) -> DataFrame:
    """Score statistics and the distribution of the actual value per bin."""
    binned = with_bins(df, score, weight, n, cutoffs, segment, buckets).filter(F.col("bin").isNotNull())
    w = _weight(weight)
    base = binned.groupBy("bin").agg(
        F.count("*").alias("N"), F.sum(w).alias("weight"), F.min(score).cast("double").alias("pred_min"), F.avg(score).alias("pred_mean"), F.max(score).cast("double").alias("pred_max"),
        F.min(actual).cast("double").alias("actual_min"), F.try_divide(F.sum(w * F.col(actual)), F.sum(w)).alias("actual_mean_w"), F.max(actual).cast("double").alias("actual_max"))
    return base.join(grouped_quantiles(binned, ["bin"], actual, REPORT_PERCENTILES, value_buckets), "bin")


def variable_profile(df: DataFrame, score: str, variables: list[str], weight: str | None = None, n: int = 10, cutoffs: list[float] | None = None, buckets: int = 1) -> DataFrame:
    """Mean of each variable, smallest score and row count per score bin."""
    binned = with_bins(df, score, weight, n, cutoffs, buckets=buckets)
    return binned.groupBy("bin").agg(F.min(score).alias("pred_min"), F.count("*").alias("count"), *(F.avg(v).alias(v) for v in variables))


def band_by_precision(report: DataFrame, column: str = "cum_precision_w", high: float = 0.015, low: float = 0.005) -> DataFrame:
    """Band of a lift-report bin from its cumulative precision."""
    c = F.col(column)
    return report.withColumn("risk_category", F.when(c > high, "High").when(c < low, "Low").otherwise("Medium"))


def class_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """Rows, responders, precision, recall and F1 by predicted class."""
    g = df.groupBy(F.col(predicted).alias("predicted")).agg(F.count("*").alias("N"), F.sum(label).alias("responders"))
    precision, recall = F.col("responders") / F.col("N"), F.try_divide(F.col("responders"), F.sum("responders").over(W.partitionBy()))
    return g.select("predicted", "N", "responders", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def accuracy_at(df: DataFrame, probability: str, label: str, cutoff: float) -> DataFrame:
    hit = flag(F.col(probability) > cutoff) == F.col(label)
    return df.agg(F.avg(flag(hit)).alias("accuracy"))


def confusion(df: DataFrame, predicted: str, label: str, amount: str) -> DataFrame:
    """Counts and amounts of the four outcomes."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    cells = {"tp": p & y, "fp": p & ~y, "fn": ~p & y, "tn": ~p & ~y}
    return df.agg(*(F.count_if(c).alias(k) for k, c in cells.items()), *(F.sum(F.when(c, F.col(amount)).otherwise(0.0)).alias(f"{k}_amount") for k, c in cells.items()))


def rmse_r2(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Weighted root mean squared error and R squared; squares are taken about the mean from a first aggregate."""
    w, y, p = _weight(weight), F.col(actual).cast("double"), F.col(predicted).cast("double")
    mean = df.agg(F.try_divide(F.sum(w * y), F.sum(w)).alias("m")).scalar()
    centred = df.withColumn("_m", mean)
    errors, spread = F.sum(w * (p - y) * (p - y)), F.sum(w * (y - F.col("_m")) * (y - F.col("_m")))
    return centred.agg(F.sqrt(F.try_divide(errors, F.sum(w))).alias("rmse"), (1 - F.try_divide(errors, spread)).alias("r2"))


def log_loss(df: DataFrame, probability: str, label: str, weight: str | None = None, floor: float = 1e-15) -> DataFrame:
    """Weighted mean log-loss with probabilities kept off 0 and 1."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(probability)))
    w = _weight(weight)
    return df.agg(F.try_divide(F.sum(-w * F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))), F.sum(w)).alias("log_loss"))


def period_comparison(df: DataFrame, period: Column, score: str, label: str, approved: str, weight: str, high: float = HIGH_THRESHOLD, medium: float = MEDIUM_THRESHOLD) -> DataFrame:
    """Per period: approved label rate, and rates above the high and below the medium threshold."""
    w, km, y, s = _weight(weight), F.col(approved) == 1, F.col(label) == 1, F.col(score)

    def part(hit: Column, prefix: str) -> list[Column]:
        pos, neg = F.sum(F.when(hit & km & y, w).otherwise(0.0)), F.sum(F.when(hit & km & ~y, w).otherwise(0.0))
        return [F.try_divide(100.0 * pos, pos + neg).alias(f"{prefix}_precision"), F.try_divide(100.0 * pos, F.sum(F.when(km & y, w))).alias(f"{prefix}_recall"),
                F.try_divide(100.0 * F.sum(F.when(hit, w).otherwise(0.0)), F.sum(w)).alias(f"{prefix}_group_size")]
    return df.groupBy(period.alias("period")).agg(F.avg(F.when(km, flag(y))).alias("label_rate"), *part(s >= high, "high"), *part(s < medium, "low"))
