"""Registered statistics and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gatewise.operators import stats as Z
from gatewise.plans.evaluation import _r
from gatewise.plans.registry import query
from gatewise.session import staged
from gatewise.sources.standins import load

IV_FEATURES = ["failed_rules", "identity_address_fail", "balance", "declared_amount", "score"]
NUMERIC = ["balance", "declared_amount", "score", "age_at_completion", "company_age_months"]
PROFILED = ["applicant_id_type", "country_risk", "icc_raw", "device_raw", "failed_rules", "balance", "years_to_id_expiry"]


def km(spark, d):
    return load(spark, d, "members").filter("is_approved = 1")


def _iv_sql(f: str, response: str | None = None) -> str:
    few = f in ("failed_rules", "identity_address_fail")
    binned = f"CAST({f} AS DOUBLE)" if few else f"GREATEST(0, len(list_filter(q, lambda x: x < {f})) - 1)"
    y, n = ("SUM(is_app_fraud)", "COUNT(*) - SUM(is_app_fraud)") if response is None else (f"SUM({response})", "COUNT(*)")
    edges = f"(SELECT list_sort(list_distinct(quantile_cont({f}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM km)"
    return f"""SELECT '{f}' AS feature, ROUND(SUM(CASE WHEN pn > 0 AND py > 0 THEN (pn - py) * ln(pn / py) ELSE 0 END), 3) AS iv FROM (
  SELECT n / SUM(n) OVER () AS pn, y / SUM(y) OVER () AS py FROM (SELECT {binned} AS b, {y} AS y, {n} AS n FROM km, {edges} e GROUP BY 1))"""


_KM = "km AS (SELECT * FROM members WHERE is_approved = 1) "


@query("iv", ("members",), _KM + " UNION ALL ".join(_iv_sql(f) for f in IV_FEATURES))
def iv(spark, d):
    return Z.information_values(km(spark, d), IV_FEATURES, "is_app_fraud")


@query("iv_continuous", ("members",), _KM + " UNION ALL ".join(_iv_sql(f, "app_fraud_amount") for f in ["failed_rules", "balance"]))
def iv_continuous(spark, d):
    return Z.information_values(km(spark, d), ["failed_rules", "balance"], "app_fraud_amount", continuous=True)


@query("iv_strength", ("applications",), "SELECT company_id, CASE WHEN score / 1000 >= 0.5 THEN 'suspicious' WHEN score / 1000 >= 0.3 THEN 'strong' WHEN score / 1000 >= 0.1 THEN 'medium' WHEN score / 1000 >= 0.02 THEN 'weak' ELSE 'useless' END AS strength FROM applications")
def iv_strength(spark, d):
    return load(spark, d, "applications").withColumn("iv", F.col("score") / 1000).select("company_id", Z.iv_strength("iv").alias("strength"))


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@query("spearman", ("members",), _KM + ", r AS (SELECT " + ", ".join(f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{i}" for i, c in enumerate(NUMERIC)) + " FROM km) "
       + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, ROUND(corr(r{NUMERIC.index(a)}, r{NUMERIC.index(b)}), 6) AS correlation FROM r" for a, b in _PAIRS))
def spearman(spark, d):
    return _r(Z.spearman(km(spark, d), NUMERIC))


@query("trigger_correlation", ("members",), _KM + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, ROUND(corr({a}, {b}), 6) AS correlation FROM km"
       for a, b in [("identity_address_fail", "internal_check_fail"), ("identity_address_fail", "sanctions_fail"), ("internal_check_fail", "sanctions_fail")]))
def trigger_correlation(spark, d):
    return _r(Z.correlation_pairs(km(spark, d), ["identity_address_fail", "internal_check_fail", "sanctions_fail"]))


@query("vif", ())
def vif(spark, d):
    return Z.variance_inflation(km(spark, d), NUMERIC)


@query("vif_pair", ("members",), _KM + "SELECT f AS feature, ROUND(1 / (1 - POWER(c, 2)), 2) AS vif FROM (SELECT corr(balance, declared_amount) AS c FROM km), (VALUES ('balance'), ('declared_amount')) t(f)")
def vif_pair(spark, d):
    return Z.variance_inflation(km(spark, d), ["balance", "declared_amount"])


@query("explained_variance", ())
def explained_variance(spark, d):
    return Z.explained_variance(km(spark, d), NUMERIC, NUMERIC[:3])


@query("grouped_t", ("members",), _KM + ", g AS (SELECT is_app_fraud AS g, " + ", ".join(f"COUNT({c}) AS n{i}, AVG({c}) AS m{i}, VAR_SAMP({c}) AS v{i}" for i, c in enumerate(NUMERIC)) + " FROM km GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(a.m{i}, 4) AS mean_0, ROUND(b.m{i}, 4) AS mean_1, ROUND((b.m{i} - a.m{i}) / SQRT(((b.n{i} - 1) * b.v{i} + (a.n{i} - 1) * a.v{i}) / (a.n{i} + b.n{i} - 2) * (1 / a.n{i} + 1 / b.n{i})), 4) AS t, CAST(a.n{i} + b.n{i} - 2 AS BIGINT) AS freedom FROM g a, g b WHERE a.g = 0 AND b.g = 1"
    for i, c in enumerate(NUMERIC)))
def grouped_t(spark, d):
    return _r(Z.grouped_t(km(spark, d), "is_app_fraud", NUMERIC), digits=4)


@query("grouped_t_test", ())
def grouped_t_test(spark, d):
    return Z.grouped_t_test(km(spark, d), "is_app_fraud", NUMERIC)


_KIND = {"applicant_id_type": "string", "country_risk": "string", "icc_raw": "string", "device_raw": "string", "failed_rules": "int", "balance": "double", "years_to_id_expiry": "int"}


def _profile_sql(c: str) -> str:
    number = "NULL" if _KIND[c] == "string" else "{}(" + c + ")"
    stats = ", ".join(f"CAST({'NULL' if _KIND[c] == 'string' else f'{fn}({c})'} AS DOUBLE) AS {n}" for fn, n in [("MIN", "low"), ("MAX", "high")])
    mean = "CAST(NULL AS DOUBLE)" if _KIND[c] == "string" else f"ROUND(AVG({c}), 4)"
    top = f"(SELECT {{}} FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n, SUM(is_app_fraud) AS y FROM km WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1))"
    return (f"SELECT '{c}' AS feature, '{_KIND[c]}' AS kind, CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS distinct_values, {stats}, {mean} AS mean, "
            f"{top.format('v')} AS top_value, ROUND({top.format('n')} / COUNT(*), 6) AS top_share, ROUND({top.format('y / n')}, 6) AS top_rate FROM km")


@query("data_profile", ("members",), _KM + " UNION ALL ".join(_profile_sql(c) for c in PROFILED))
def data_profile(spark, d):
    out = Z.data_profile(km(spark, d), PROFILED, "is_app_fraud")
    return out.withColumns({"mean": F.round("mean", 4), "top_share": F.round("top_share", 6), "top_rate": F.round("top_rate", 6)})
