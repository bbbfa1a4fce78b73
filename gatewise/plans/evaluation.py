"""Registered evaluation queries over the fixture score."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import evaluate as V
from gatewise.plans.registry import query
from gatewise.sources.standins import load

WEIGHT = "CASE WHEN is_approved = 1 THEN 1.0 ELSE (score % 7 + 1) / 8.0 END"
_S = f"s AS (SELECT *, CAST({WEIGHT} AS DOUBLE) AS w FROM applications)"


def scored(spark, d):
    return load(spark, d, "applications").withColumn("w", F.expr(WEIGHT).cast("double"))


def _r(df, columns=None, digits=6):
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(c, digits) for c in (columns or df.columns) if kinds[c] == "double"})


_CURVE = _S + """,
v AS (SELECT score, SUM(w * is_app_fraud) AS p, SUM(w * (1 - is_app_fraud)) AS n FROM s GROUP BY 1),
c AS (SELECT score, p, n, SUM(p) OVER o AS cp, SUM(n) OVER o AS cn, SUM(p) OVER () AS tp, SUM(n) OVER () AS tn FROM v WINDOW o AS (ORDER BY score DESC))"""


@query("roc_points", ("applications",), _CURVE + " SELECT score AS threshold, ROUND(cn / tn, 6) AS fpr, ROUND(cp / tp, 6) AS tpr FROM c")
def roc_points(spark, d):
    return _r(V.roc_points(scored(spark, d), "score", "is_app_fraud", "w"))


@query("auc", ("applications",), _CURVE + " SELECT ROUND(SUM(n * (cp - p / 2)) / (MAX(tp) * MAX(tn)), 6) AS auc FROM c")
def auc(spark, d):
    return _r(V.auc(scored(spark, d), "score", "is_app_fraud", "w"))


@query("pr_points", ("applications",), _CURVE + " SELECT score AS threshold, ROUND(cp / (cp + cn), 6) AS \"precision\", ROUND(cp / tp, 6) AS recall FROM c")
def pr_points(spark, d):
    return _r(V.pr_points(scored(spark, d), "score", "is_app_fraud", "w"))


@query("pr_area", ("applications",), _CURVE + """, q AS (SELECT cp / (cp + cn) AS pr, cp / tp AS re, score FROM c), l AS (SELECT pr, re, lag(pr, 1, 1.0) OVER o AS p0, lag(re, 1, 0.0) OVER o AS r0 FROM q WINDOW o AS (ORDER BY score DESC))
SELECT ROUND(SUM((re - r0) * (pr + p0) / 2), 6) AS area FROM l""")
def pr_area(spark, d):
    return _r(V.pr_area(scored(spark, d), "score", "is_app_fraud", "w"))


@query("calibration_bins", ("applications",), _S + """,
v AS (SELECT score, SUM(w) AS w, SUM(w * is_app_fraud) AS wy FROM s GROUP BY 1), c AS (SELECT *, SUM(w) OVER (ORDER BY score) AS cw, SUM(w) OVER () AS tw FROM v)
SELECT CAST(GREATEST(0, CEIL(ROUND(cw * 10 / tw, 9)) - 1) AS INTEGER) AS bin, ROUND(SUM(w), 6) AS weight, ROUND(SUM(w * score) / SUM(w) / 1000, 6) AS predicted, ROUND(SUM(wy) / SUM(w), 6) AS observed FROM c GROUP BY 1""")
def calibration_bins(spark, d):
    return _r(V.calibration_bins(scored(spark, d), "score", "is_app_fraud", "w"))


_COUNTS = _S + """,
v AS (SELECT score, SUM(CASE WHEN is_approved = 1 AND is_app_fraud = 1 THEN w ELSE 0 END) AS p, SUM(CASE WHEN is_approved = 1 AND is_app_fraud = 0 THEN w ELSE 0 END) AS n, SUM(w) AS a FROM s GROUP BY 1),
c AS (SELECT score, p, n, a, SUM(p) OVER o AS cp, SUM(n) OVER o AS cn, SUM(a) OVER o AS ca, SUM(p) OVER () AS tp, SUM(n) OVER () AS tn, SUM(a) OVER () AS ta FROM v WINDOW o AS (ORDER BY score DESC)),
t AS (SELECT score, ROUND(COALESCE(100 * cp / NULLIF(cp + cn, 0), 0), 3) AS above_precision, ROUND(100 * cp / tp, 3) AS above_recall, ROUND(100 * cn / tn, 3) AS above_fpr, ROUND(100 * ca / ta, 3) AS above_group_size,
  ROUND(COALESCE(100 * (tp - cp + p) / NULLIF(tp - cp + p + tn - cn + n, 0), 0), 3) AS below_precision, ROUND(100 * (tp - cp + p) / tp, 3) AS below_recall, ROUND(100 * (tn - cn + n) / tn, 3) AS below_fpr,
  ROUND(100 * (ta - ca + a) / ta, 3) AS below_group_size FROM c)"""


@query("threshold_table", ("applications",), _COUNTS + " SELECT * FROM t")
def threshold_table(spark, d):
    return V.threshold_table(scored(spark, d), "score", "is_app_fraud", "is_approved", "w")


_LIMITS = "0 <= above_precision AND above_recall <= 100 AND above_group_size <= 10", "below_precision <= 100 AND below_recall <= 15 AND below_group_size <= 45"


@query("threshold_search", ("applications",), _COUNTS + f"""
SELECT 'medium_high' AS edge, CAST(score AS DOUBLE) AS threshold, above_precision AS "precision", above_recall AS recall, above_fpr AS fpr, above_group_size AS group_size FROM t
  WHERE score = (SELECT MAX(score) FROM t WHERE NOT ({_LIMITS[0]}))
UNION ALL SELECT 'low_medium', CAST(score + 1 AS DOUBLE), below_precision, below_recall, below_fpr, below_group_size FROM t WHERE score = (SELECT MIN(score) FROM t WHERE NOT ({_LIMITS[1]}))""")
def threshold_search(spark, d):
    out = V.threshold_search(scored(spark, d), "score", "is_app_fraud", "is_approved", "w", 0, 100, 10, 100, 15, 45)
    return out.withColumn("threshold", F.col("threshold").cast("double"))


@query("threshold_metrics", ("applications",), _S + """, m AS (SELECT unnest([116.0, 12.0, 5.0, 3.0, 1.0]) AS t),
g AS (SELECT CAST(t AS DOUBLE) AS threshold, SUM(CASE WHEN is_approved = 1 AND is_app_fraud = 1 THEN w ELSE 0 END) AS tp, SUM(CASE WHEN is_approved = 1 AND is_app_fraud = 0 THEN w ELSE 0 END) AS tn, SUM(w) AS ta,
  SUM(CASE WHEN score >= t AND is_approved = 1 AND is_app_fraud = 1 THEN w ELSE 0 END) AS p, SUM(CASE WHEN score >= t AND is_approved = 1 AND is_app_fraud = 0 THEN w ELSE 0 END) AS n,
  SUM(CASE WHEN score >= t THEN w ELSE 0 END) AS a FROM s, m GROUP BY 1)
SELECT threshold, ROUND(100 * p / (p + n), 3) AS "precision", ROUND(100 * p / tp, 3) AS recall, ROUND(100 * n / tn, 3) AS fpr, ROUND(100 * a / ta, 3) AS group_size FROM g""")
def threshold_metrics(spark, d):
    return V.threshold_metrics(scored(spark, d), "score", "is_app_fraud", "is_approved", "w", [116, 12, 5, 3, 1])


@query("threshold_metrics_below", ("applications",), _S + """, m AS (SELECT unnest([600.0, 300.0, 45.0]) AS t),
g AS (SELECT CAST(t AS DOUBLE) AS threshold, SUM(CASE WHEN is_approved = 1 AND is_app_fraud = 1 THEN w ELSE 0 END) AS tp, SUM(CASE WHEN is_approved = 1 AND is_app_fraud = 0 THEN w ELSE 0 END) AS tn, SUM(w) AS ta,
  SUM(CASE WHEN score < t AND is_approved = 1 AND is_app_fraud = 1 THEN w ELSE 0 END) AS p, SUM(CASE WHEN score < t AND is_approved = 1 AND is_app_fraud = 0 THEN w ELSE 0 END) AS n,
  SUM(CASE WHEN score < t THEN w ELSE 0 END) AS a FROM s, m GROUP BY 1)
SELECT threshold, ROUND(100 * p / (p + n), 3) AS "precision", ROUND(100 * p / tp, 3) AS recall, ROUND(100 * n / tn, 3) AS fpr, ROUND(100 * a / ta, 3) AS group_size FROM g""")
def threshold_metrics_below(spark, d):
    return V.threshold_metrics(scored(spark, d), "score", "is_app_fraud", "is_approved", "w", [600, 300, 45], "below")


_BAND = "CASE WHEN score >= 700 THEN 'High' WHEN score >= 300 THEN 'Medium' ELSE 'Low' END"


@query("score_bands", ("applications",), f"SELECT company_id, {_BAND} AS band, CASE WHEN score >= 700 THEN 1 ELSE 0 END AS prediction FROM applications")
def score_bands(spark, d):
    return load(spark, d, "applications").select("company_id", V.band("score", 700, 300).alias("band"), (F.col("score") >= 700).cast("int").alias("prediction"))


_BANDS = _S + f""",
g AS (SELECT {_BAND} AS category, SUM(w) AS w, SUM(w * is_app_fraud) AS wy, SUM(is_approved) AS kn, SUM(is_approved * is_app_fraud) AS ky, SUM(w * is_approved) AS kw, SUM(is_approved * app_fraud_amount) AS ka FROM s GROUP BY 1),
t AS (SELECT SUM(w) AS tw, SUM(wy) AS twy, SUM(kn) AS tkn, SUM(ky) AS tky, SUM(kw) AS tkw, SUM(ka) AS tka FROM g)"""
_BAND_METRICS = [("RM", "precision", "wy / w"), ("RM", "recall", "wy / twy"), ("RM", "lift", "(wy / w) / (twy / tw)"), ("RM", "group_size", "w / tw"), ("KM", "precision", "ky / kn"), ("KM", "recall", "ky / tky"),
                 ("KM", "lift", "(ky / kn) / (tky / tkn)"), ("KM", "group_size", "kw / tkw"), ("KM", "amount_mean", "ka / kn"), ("KM", "amount_capture", "ka / tka")]


@query("band_report", ("applications",), _BANDS + " " + " UNION ALL ".join(f"SELECT '{p}' AS population, category, '{m}' AS metric, ROUND({e}, 4) AS value FROM g, t" for p, m, e in _BAND_METRICS))
def band_report(spark, d):
    s = scored(spark, d).withColumn("band", V.band("score", 700, 300))
    return _r(V.band_report(s, "band", "is_app_fraud", "app_fraud_amount", "is_approved", "w"), digits=4)


@query("money_impact", ("applications",), "x AS (SELECT SUM(app_fraud_amount) AS a FROM applications WHERE is_approved = 1 AND score >= 700) SELECT ROUND(a, 2) AS amount, ROUND(0.5 * a, 2) AS half, ROUND(a / 3 * 12, 2) AS yearly, ROUND(0.5 * a / 3 * 12, 2) AS half_yearly FROM x")
def money_impact(spark, d):
    return _r(V.money_impact(scored(spark, d).withColumn("band", V.band("score", 700, 300)), "band", "app_fraud_amount", "is_approved"), digits=2)


def _lift_sql(base: str, bins: str, n_bins: int) -> str:
    return base + f""",
v AS (SELECT score, SUM(bw) AS bw, SUM(k) AS "N", SUM(k * w) AS weight, SUM(k * is_app_fraud) AS r, SUM(k * w * is_app_fraud) AS rw FROM b GROUP BY 1),
c AS (SELECT *, {bins} AS bin FROM (SELECT *, SUM(bw) OVER (ORDER BY score DESC) AS cw, SUM(bw) OVER () AS tw FROM v)),
g AS (SELECT bin, SUM("N") AS "N", SUM(weight) AS weight, SUM(r) AS r, SUM(rw) AS rw, MIN(score) AS lo, SUM(score * "N") / SUM("N") AS mid, MAX(score) AS hi FROM c WHERE "N" > 0 GROUP BY bin),
f AS (SELECT *, SUM("N") OVER o AS cn, SUM(weight) OVER o AS cwt, SUM(r) OVER o AS cr, SUM(rw) OVER o AS crw, SUM("N") OVER () AS tn, SUM(weight) OVER () AS twt, SUM(r) OVER () AS tr, SUM(rw) OVER () AS trw FROM g WINDOW o AS (ORDER BY bin))
SELECT CAST(bin AS INTEGER) AS bin, CAST("N" AS BIGINT) AS "N", ROUND(weight, 6) AS weight, CAST(lo AS DOUBLE) AS pred_min, ROUND(mid, 6) AS pred_mean, CAST(hi AS DOUBLE) AS pred_max, CAST(cr AS DOUBLE) AS cum_responders, ROUND(cr / cn, 6) AS cum_precision,
  ROUND(cr / tr, 6) AS cum_recall, ROUND((cr / cn) / (tr / tn), 6) AS lift, ROUND(2 * cr / (cn + tr), 6) AS f1_score, ROUND((cr + (tn - tr) - (cn - cr)) / tn, 6) AS accuracy, ROUND(crw, 6) AS cum_responders_w, ROUND(crw / cwt, 6) AS cum_precision_w,
  ROUND(crw / trw, 6) AS cum_recall_w, ROUND((crw / cwt) / (trw / twt), 6) AS lift_w, ROUND(2 * crw / (cwt + trw), 6) AS f1_score_w, ROUND((crw + (twt - trw) - (cwt - crw)) / twt, 6) AS accuracy_w FROM f"""


_EQUAL = "GREATEST(0, CEIL(ROUND(cw * 10 / tw, 9)) - 1)"


@query("lift_report", ("applications",), _lift_sql(_S + ", b AS (SELECT *, w AS bw, 1 AS k FROM s)", _EQUAL, 10))
def lift_report(spark, d):
    return _r(V.lift_report(scored(spark, d), "score", "is_app_fraud", "w", 10))


@query("lift_report_segment", ("applications",), _lift_sql(_S + ", b AS (SELECT *, w AS bw, is_approved AS k FROM s)", _EQUAL, 10))
def lift_report_segment(spark, d):
    return _r(V.lift_report(scored(spark, d), "score", "is_app_fraud", "w", 10, segment="is_approved"))


@query("lift_report_cutoffs", ("applications",), _lift_sql(_S + ", b AS (SELECT *, w AS bw, 1 AS k FROM s)", "CASE WHEN score >= 800 THEN 0 WHEN score >= 500 THEN 1 WHEN score >= 200 THEN 2 ELSE 3 END", 4))
def lift_report_cutoffs(spark, d):
    return _r(V.lift_report(scored(spark, d), "score", "is_app_fraud", "w", cutoffs=[800, 500, 200, 0]))


_BINNED = _S + """,
v AS (SELECT score, SUM(w) AS bw FROM s GROUP BY 1), c AS (SELECT score, CAST(GREATEST(0, CEIL(ROUND(SUM(bw) OVER (ORDER BY score DESC) * 10 / SUM(bw) OVER (), 9)) - 1) AS INTEGER) AS bin FROM v),
k AS (SELECT s.*, c.bin FROM s JOIN c USING (score))"""


@query("stats_report", ("applications",), _BINNED + """
SELECT bin, CAST(COUNT(*) AS BIGINT) AS "N", ROUND(SUM(w), 6) AS weight, CAST(MIN(score) AS DOUBLE) AS pred_min, ROUND(AVG(score), 6) AS pred_mean, CAST(MAX(score) AS DOUBLE) AS pred_max, MIN(balance) AS actual_min,
  ROUND(SUM(w * balance) / SUM(w), 4) AS actual_mean_w, MAX(balance) AS actual_max, """ + ", ".join(f"ROUND(quantile_cont(balance, {p}), 4) AS {n}" for n, p in V.REPORT_PERCENTILES.items()) + " FROM k GROUP BY 1")
def stats_report(spark, d):
    out = V.stats_report(scored(spark, d), "score", "balance", "w", 10)
    return _r(_r(out, ["weight", "pred_mean"]), ["actual_mean_w", *V.REPORT_PERCENTILES], 4)


@query("bin_per_row", ("applications",), _BINNED + " SELECT company_id, CAST(CASE WHEN is_approved = 1 THEN bin END AS DOUBLE) AS bin FROM k")
def bin_per_row(spark, d):
    return V.with_bins(scored(spark, d), "score", "w", 10, segment="is_approved").select("company_id", F.col("bin").cast("double").alias("bin"))


@query("variable_profile", ("applications",), _BINNED + " SELECT bin, MIN(score) AS pred_min, CAST(COUNT(*) AS BIGINT) AS \"count\", ROUND(AVG(balance), 4) AS balance, ROUND(AVG(declared_amount), 4) AS declared_amount, ROUND(AVG(is_app_fraud), 4) AS is_app_fraud FROM k GROUP BY 1")
def variable_profile(spark, d):
    return _r(V.variable_profile(scored(spark, d), "score", ["balance", "declared_amount", "is_app_fraud"], "w", 10), digits=4)


@query("band_by_precision", ("applications",), "r AS (" + "WITH " + _lift_sql(_S + ", b AS (SELECT *, w AS bw, 1 AS k FROM s)", _EQUAL, 10) + ") SELECT bin, cum_precision_w, CASE WHEN cum_precision_w > 0.09 THEN 'High' WHEN cum_precision_w < 0.088 THEN 'Low' ELSE 'Medium' END AS risk_category FROM r")
def band_by_precision(spark, d):
    return V.band_by_precision(_r(V.lift_report(scored(spark, d), "score", "is_app_fraud", "w", 10)), high=0.09, low=0.088).select("bin", "cum_precision_w", "risk_category")


@query("class_report", ("applications",), """g AS (SELECT CASE WHEN score >= 700 THEN 1 ELSE 0 END AS predicted, COUNT(*) AS n, SUM(is_app_fraud) AS r FROM applications GROUP BY 1), m AS (SELECT *, r / n AS pr, r / SUM(r) OVER () AS re FROM g)
SELECT predicted, CAST(n AS BIGINT) AS "N", CAST(r AS BIGINT) AS responders, ROUND(pr, 6) AS "precision", ROUND(re, 6) AS recall, ROUND(2 * pr * re / (pr + re), 6) AS f1 FROM m""")
def class_report(spark, d):
    return _r(V.class_report(load(spark, d, "applications").withColumn("hit", (F.col("score") >= 700).cast("int")), "hit", "is_app_fraud"))


@query("accuracy_at_cutoff", ("applications",), "SELECT ROUND(AVG(CASE WHEN (CASE WHEN score / 1000 > 0.85 THEN 1 ELSE 0 END) = is_app_fraud THEN 1 ELSE 0 END), 6) AS accuracy FROM applications")
def accuracy_at_cutoff(spark, d):
    return _r(V.accuracy_at(load(spark, d, "applications").withColumn("p", F.col("score") / 1000), "p", "is_app_fraud", 0.85))


@query("confusion_counts", ("applications",), "SELECT " + ", ".join(
    f"CAST(SUM(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {k}, ROUND(SUM(CASE WHEN {c} THEN declared_amount ELSE 0 END), 2) AS {k}_amount"
    for k, c in [("tp", "score >= 700 AND is_app_fraud = 1"), ("fp", "score >= 700 AND is_app_fraud = 0"), ("fn", "score < 700 AND is_app_fraud = 1"), ("tn", "score < 700 AND is_app_fraud = 0")]) + " FROM applications")
def confusion_counts(spark, d):
    return _r(V.confusion(load(spark, d, "applications").withColumn("hit", (F.col("score") >= 700).cast("int")), "hit", "is_app_fraud", "declared_amount"), digits=2)


@query("rmse_r2", ("applications",), _S + ", m AS (SELECT SUM(w * is_app_fraud) / SUM(w) AS m FROM s) SELECT ROUND(SQRT(SUM(w * (score / 1000 - is_app_fraud) ** 2) / SUM(w)), 6) AS rmse, ROUND(1 - SUM(w * (score / 1000 - is_app_fraud) ** 2) / SUM(w * (is_app_fraud - m) ** 2), 6) AS r2 FROM s, m")
def rmse_r2(spark, d):
    return _r(V.rmse_r2(scored(spark, d).withColumn("p", F.col("score") / 1000), "is_app_fraud", "p", "w"))


@query("log_loss", ("applications",), _S + ", p AS (SELECT *, GREATEST(1e-15, LEAST(1 - 1e-15, (score + 1) / 1002)) AS p FROM s) SELECT ROUND(SUM(-w * CASE WHEN is_app_fraud = 1 THEN ln(p) ELSE ln(1 - p) END) / SUM(w), 6) AS log_loss FROM p")
def log_loss(spark, d):
    return _r(V.log_loss(scored(spark, d).withColumn("p", (F.col("score") + 1) / 1002), "p", "is_app_fraud", "w"))


_HALF = "CAST(year(created_on) AS VARCHAR) || CASE WHEN month(created_on) <= 6 THEN 'H1' ELSE 'H2' END"


@query("period_comparison", ("applications",), _S + f"""
SELECT {_HALF} AS period, ROUND(AVG(CASE WHEN is_approved = 1 THEN is_app_fraud END), 6) AS label_rate, """ + ", ".join(
    f"ROUND(100 * SUM(CASE WHEN {h} AND is_approved * is_app_fraud = 1 THEN w ELSE 0 END) / NULLIF(SUM(CASE WHEN {h} AND is_approved = 1 THEN w ELSE 0 END), 0), 6) AS {n}_precision, ROUND(100 * SUM(CASE WHEN {h} AND is_approved * is_app_fraud = 1 THEN w ELSE 0 END) / SUM(CASE WHEN is_approved * is_app_fraud = 1 THEN w END), 6) AS {n}_recall, ROUND(100 * SUM(CASE WHEN {h} THEN w ELSE 0 END) / SUM(w), 6) AS {n}_group_size"
    for n, h in [("high", "score >= 700"), ("low", "score < 300")]) + " FROM s GROUP BY 1")
def period_comparison(spark, d):
    half = F.concat(F.year("created_on").cast("string"), F.when(F.month("created_on") <= 6, "H1").otherwise("H2"))
    return _r(V.period_comparison(scored(spark, d), half, "score", "is_app_fraud", "is_approved", "w", 700, 300))


@query("score_rounding", ("applications",), "SELECT company_id, CAST(round_even(balance / 10000 * 1000, 0) AS INTEGER) AS rating FROM applications")
def score_rounding(spark, d):
    return load(spark, d, "applications").withColumn("p", F.col("balance") / 10000).select("company_id", V.to_score("p").alias("rating"))
