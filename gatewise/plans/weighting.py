"""Registered splits, weights and reject inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import weights as X
from gatewise.plans.evaluation import WEIGHT, _r, scored
from gatewise.plans.registry import query
from gatewise.session import staged
from gatewise.sources.standins import load

_S = f"s AS (SELECT *, CAST({WEIGHT} AS DOUBLE) AS w FROM applications)"
BALANCED = ["balance", "declared_amount", "score"]


def apps(spark, d):
    return load(spark, d, "applications")


@query("split_by_date", ("applications",), """
SELECT CASE WHEN created_on < DATE '1998-01-01' THEN 'train' WHEN created_on < DATE '1999-07-01' THEN 'test' ELSE 'val' END AS split, is_approved, CAST(COUNT(*) AS BIGINT) AS n,
  CAST(SUM(is_app_fraud) AS BIGINT) AS frauds FROM applications GROUP BY 1, 2""")
def split_by_date(spark, d):
    tagged = X.tag_split(apps(spark, d), "created_on", [("train", "1998-01-01"), ("test", "1999-07-01")], "val", "split")
    return tagged.groupBy("split", "is_approved").agg(F.count("*").alias("n"), F.sum("is_app_fraud").alias("frauds"))


@query("random_halves", ())
def random_halves(spark, d):
    return X.random_halves(apps(spark, d).select("company_id", "is_app_fraud"), "company_id")


@query("stratified_sample", ())
def stratified_sample(spark, d):
    months = apps(spark, d).select("company_id", F.date_format("created_on", "yyyy-MM").alias("year_month"))
    return X.stratified_sample(months, "year_month", "company_id", 0.05)


@query("stratified_sample_sizes", ("applications",), "SELECT strftime(created_on, '%Y-%m') AS year_month, CAST(ROUND(COUNT(*) * 0.05) AS BIGINT) AS n FROM applications GROUP BY 1 HAVING ROUND(COUNT(*) * 0.05) > 0")
def stratified_sample_sizes(spark, d):
    return stratified_sample(spark, d).groupBy("year_month").agg(F.count("*").alias("n"))


_DECAY = """e AS (SELECT MIN(created_on) AS d0, MAX(created_on) AS d1 FROM applications),
x AS (SELECT company_id, EXP(date_diff('day', d1, created_on) / date_diff('day', d0, d1)) AS r FROM applications, e)"""


@query("time_decay", ("applications",), _DECAY + " SELECT company_id, ROUND(r * COUNT(*) OVER () / SUM(r) OVER (), 6) AS decay_weight FROM x")
def time_decay(spark, d):
    return X.time_decay(apps(spark, d), "created_on").select("company_id", F.round("decay_weight", 6).alias("decay_weight"))


_VALUE = """e AS (SELECT MIN(app_fraud_amount) AS a0, MAX(app_fraud_amount) AS a1 FROM applications), r AS (SELECT company_id, is_approved + (app_fraud_amount - a0) / (a1 - a0) AS r FROM applications, e),
l AS (SELECT MIN(r) AS r0, MAX(r) AS r1 FROM r), v AS (SELECT company_id, (r - r0) / (r1 - r0) AS v FROM r, l)"""


@query("value_weight", ("applications",), _VALUE + " SELECT company_id, ROUND(v / AVG(v) OVER (), 6) AS value_weight FROM v")
def value_weight(spark, d):
    return X.value_weight(apps(spark, d), "is_approved", "app_fraud_amount").select("company_id", F.round("value_weight", 6).alias("value_weight"))


@query("combined_weight", ("applications",), _S + """,
e AS (SELECT MIN(app_fraud_amount) AS a0, MAX(app_fraud_amount) AS a1 FROM s WHERE is_approved = 1), r AS (SELECT company_id, is_approved, w, w + (app_fraud_amount - a0) / (a1 - a0) AS r FROM s, e),
l AS (SELECT MIN(r) AS r0, MAX(r) AS r1 FROM r WHERE is_approved = 1), v AS (SELECT *, (r - r0) / (r1 - r0) AS v FROM r, l), f AS (SELECT SUM(w) / SUM(v) AS f FROM v WHERE is_approved = 1)
SELECT company_id, ROUND(CASE WHEN is_approved = 1 THEN v * f ELSE w END, 6) AS train_weight FROM v, f""")
def combined_weight(spark, d):
    return X.combined_weight(scored(spark, d), "is_approved", "app_fraud_amount", "w").select("company_id", F.round("train_weight", 6).alias("train_weight"))


@query("positive_class_weight", ("applications",), _S + " SELECT ROUND(SUM(CASE WHEN is_app_fraud = 0 THEN w ELSE 0 END) / SUM(CASE WHEN is_app_fraud = 1 THEN w ELSE 0 END), 6) AS scale_pos_weight FROM s")
def positive_class_weight(spark, d):
    return _r(X.positive_class_weight(scored(spark, d), "is_app_fraud", "w"))


@query("class_weights", ("applications",), "SELECT is_app_fraud, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)), 6) AS class_weight FROM applications GROUP BY 1")
def class_weights(spark, d):
    return _r(X.class_weights(apps(spark, d), "is_app_fraud"))


@query("reject_augment", ("applications",), """
SELECT company_id, is_app_fraud, 1.0 AS weights FROM applications WHERE is_approved = 1 UNION ALL SELECT company_id, 1, score / 1000 FROM applications WHERE is_approved = 0
UNION ALL SELECT company_id, 0, ROUND(1 - score / 1000, 6) FROM applications WHERE is_approved = 0""")
def reject_augment(spark, d):
    a = apps(spark, d).select("company_id", "is_approved", "is_app_fraud", (F.col("score") / 1000).alias("p"))
    return X.augment_rejects(a, "is_approved", "is_app_fraud", "p").select("company_id", "is_app_fraud", F.round("weights", 6).alias("weights"))


@query("balance_weights", ())
def balance_weights(spark, d):
    a = staged(apps(spark, d).select("company_id", "is_approved", *BALANCED))
    fit = X.fit_balancing(a, BALANCED, bins=20)
    return X.balance_weights(a.filter("is_approved = 1"), fit).select("company_id", F.round("weight", 6).alias("weight"))


@query("balancing_report", ("applications",), _S + ", k AS (SELECT * FROM s WHERE is_approved = 1) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND((SELECT AVG({c}) FROM k), 4) AS sample_mean, ROUND((SELECT SUM(declared_amount * {c}) / SUM(declared_amount) FROM k), 4) AS sample_mean_w, ROUND((SELECT AVG({c}) FROM s), 4) AS population_mean" for c in BALANCED))
def balancing_report(spark, d):
    s = scored(spark, d)
    return _r(X.balancing_report(s, s.filter("is_approved = 1").withColumn("weight", F.col("declared_amount")), "weight", BALANCED), digits=4)
