"""Registered encoders, bins and scalers."""

from __future__ import annotations

from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gatewise.functions.scalars import code_list
from gatewise.operators import encoders as E
from gatewise.plans.evaluation import _r
from gatewise.plans.registry import query
from gatewise.session import staged
from gatewise.sources.standins import load

CATEGORICAL = ["applicant_id_type", "company_icc", "applicant_country", "postcode_area"]
CUTS = {"age_at_completion": [25, 35, 50], "company_age_months": [6, 18, 30], "balance": [0, 2500, 5000, 7500]}


def train(spark, d):
    return load(spark, d, "members").filter("is_approved = 1 AND data_type = 'train'")


_T = "t AS (SELECT * FROM members WHERE is_approved = 1 AND data_type = 'train')"
_N = ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS category, COUNT(*) AS n, CAST(SUM(is_app_fraud) AS DOUBLE) AS y FROM t GROUP BY {f}" for f in CATEGORICAL) + ")"


@query("category_counts", ("members",), _T + _N + " SELECT feature, category, CAST(n AS BIGINT) AS n, y FROM c")
def category_counts(spark, d):
    return E.category_counts(train(spark, d), CATEGORICAL, "is_app_fraud")


@query("mixed_encoding", ())
def mixed_encoding(spark, d):
    return E.fit_mixed_encoding(E.category_counts(train(spark, d), CATEGORICAL, "is_app_fraud"))


@query("encoded_members", ())
def encoded_members(spark, d):
    """Mixed-model encodings of all members, the list feature by its largest entry, and industry with codes combined."""
    t = train(spark, d).withColumn("codes", code_list("sic_raw"))
    counts = E.category_counts(t, CATEGORICAL, "is_app_fraud").unionByName(E.list_category_counts(t, "codes", "is_app_fraud").filter("category IS NOT NULL"))
    table = E.fit_mixed_encoding(counts)
    m = load(spark, d, "members").withColumn("codes", code_list("sic_raw")).select("company_id", "codes", *CATEGORICAL)
    coded = E.apply_list_encoding(E.apply_encoding(m, table, CATEGORICAL), "company_id", table, "codes")
    return coded.withColumn("business_encoded", F.greatest("company_icc_encoded", "codes_encoded")).select("company_id", *(f"{f}_encoded" for f in CATEGORICAL), "codes_encoded", "business_encoded")


_PRIOR = "SUM(y) OVER (PARTITION BY feature) AS ay, SUM(n) OVER (PARTITION BY feature) AS an"
_SMOOTH = {
    "woe": "LN(((y + 0.5) / (ay + 1)) / ((n - y + 0.5) / (an - ay + 1)))",
    "target": "ay / an + (y / n - ay / an) / (1 + EXP(-(n - 10) / 10))",
    "m": "(y + ay / an * 10) / (n + 10)",
    "james_stein": "ay / an + (y / n - ay / an) * COALESCE(bt / NULLIF(bt + ay / an * (1 - ay / an) / n, 0), 0)",
}


@query("smoothed_encodings", ("members",), _T + _N + f""", p AS (SELECT *, {_PRIOR} FROM c),
q AS (SELECT *, GREATEST(0, VAR_POP(y / n) OVER (PARTITION BY feature) - AVG(ay / an * (1 - ay / an) / n) OVER (PARTITION BY feature)) AS bt FROM p) """
       + " UNION ALL ".join(f"SELECT '{k}' AS kind, feature, category, ROUND({f}, 6) AS value FROM q" for k, f in _SMOOTH.items()))
def smoothed_encodings(spark, d):
    counts = E.category_counts(train(spark, d), CATEGORICAL, "is_app_fraud")
    parts = [E.fit_smoothed_encoding(counts, k).select(F.lit(k).alias("kind"), "feature", "category", F.round("value", 6).alias("value")) for k in _SMOOTH]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("combined_encoding", ("members",), _T + _N + """, p AS (SELECT feature, category, (y + SUM(y) OVER w / SUM(n) OVER w * 10) / (n + 10) AS v FROM c WINDOW w AS (PARTITION BY feature))
SELECT m.company_id, ROUND(GREATEST(COALESCE(a.v, 0), COALESCE(b.v, 0)), 6) AS combined FROM members m LEFT JOIN p a ON a.feature = 'company_icc' AND a.category = m.company_icc
LEFT JOIN p b ON b.feature = 'applicant_country' AND b.category = m.applicant_country""")
def combined_encoding(spark, d):
    table = E.fit_smoothed_encoding(E.category_counts(train(spark, d), CATEGORICAL, "is_app_fraud"), "m")
    coded = E.apply_encoding(load(spark, d, "members").select("company_id", "company_icc", "applicant_country"), table, ["company_icc", "applicant_country"])
    return coded.select("company_id", F.round(F.greatest("company_icc_encoded", "applicant_country_encoded"), 6).alias("combined"))


@query("list_encoding", ("members",), _T + """,
e AS (SELECT company_id, data_type, is_approved, is_app_fraud, list_filter(list_transform(string_split(CASE WHEN sic_raw IS NULL OR lower(sic_raw) = 'nan' THEN '' ELSE sic_raw END, ','), lambda x: trim(x)), lambda x: x <> '') AS codes FROM members),
c AS (SELECT codes[1] AS category, COUNT(*) AS n, SUM(is_app_fraud) AS y FROM e WHERE is_approved = 1 AND data_type = 'train' GROUP BY 1), p AS (SELECT category, (y + SUM(y) OVER () / SUM(n) OVER () * 10) / (n + 10) AS v FROM c),
u AS (SELECT company_id, unnest(codes) AS code FROM e), b AS (SELECT company_id, MAX(COALESCE(v, 0)) AS v FROM u LEFT JOIN p ON code = category GROUP BY 1)
SELECT m.company_id, ROUND(b.v, 6) AS codes_encoded FROM members m LEFT JOIN b USING (company_id)""")
def list_encoding(spark, d):
    coded = load(spark, d, "members").withColumn("codes", code_list("sic_raw"))
    counts = E.list_category_counts(coded.filter("is_approved = 1 AND data_type = 'train'"), "codes", "is_app_fraud")
    out = E.apply_list_encoding(coded.select("company_id", "codes"), "company_id", E.fit_smoothed_encoding(counts, "m"), "codes")
    return out.select("company_id", F.round("codes_encoded", 6).alias("codes_encoded"))


@query("out_of_fold_encoding", ("members",), """
f AS (SELECT company_id, company_icc, is_app_fraud, company_id % 5 AS fold FROM members WHERE is_approved = 1), g AS (SELECT company_icc, fold, COUNT(*) AS n, SUM(is_app_fraud) AS y FROM f GROUP BY 1, 2),
o AS (SELECT company_icc, fold, SUM(n) OVER (PARTITION BY company_icc) - n AS n, SUM(y) OVER (PARTITION BY company_icc) - y AS y, (SUM(y) OVER () - SUM(y) OVER (PARTITION BY fold)) / (SUM(n) OVER () - SUM(n) OVER (PARTITION BY fold)) AS p FROM g)
SELECT company_id, ROUND((o.y + p * 10) / (o.n + 10), 6) AS company_icc_encoded FROM f LEFT JOIN o USING (company_icc, fold)""")
def out_of_fold_encoding(spark, d):
    m = load(spark, d, "members").filter("is_approved = 1").select("company_id", "company_icc", "is_app_fraud", (F.col("company_id") % 5).alias("fold"))
    out = E.out_of_fold_encoding(m, "company_icc", "is_app_fraud", "fold")
    return out.select("company_id", F.round("company_icc_encoded", 6).alias("company_icc_encoded"))


def _cut(f: str) -> str:
    return "CASE " + " ".join(f"WHEN {f} <= {c} THEN {i}" for i, c in enumerate(CUTS[f])) + f" ELSE {len(CUTS[f])} END"


_BINS = ", b AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {_cut(f)} AS bin, SUM(is_app_fraud) AS e, COUNT(*) - SUM(is_app_fraud) AS o FROM t GROUP BY 2" for f in CUTS) + """),
w AS (SELECT *, SUM(e) OVER k AS te, SUM(o) OVER k AS tot, LN((o / SUM(o) OVER k) / (e / SUM(e) OVER k)) AS woe FROM b WINDOW k AS (PARTITION BY feature))"""


@query("woe_table", ("members",), _T + _BINS + " SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(e AS DOUBLE) AS events, CAST(o AS DOUBLE) AS non_events, ROUND(e / (e + o), 6) AS rate, ROUND(woe, 6) AS woe, ROUND((o / tot - e / te) * woe, 6) AS iv FROM w")
def woe_table(spark, d):
    t = staged(train(spark, d).select("is_app_fraud", *CUTS))
    return _r(E.woe_report(t, [E.fit_woe_bins(t, f, "is_app_fraud", cuts=c) for f, c in CUTS.items()]).drop("low", "high"))


@query("woe_transform", ("members",), _T + _BINS + f" SELECT company_id, ROUND(w.woe, 6) AS woe FROM members m JOIN w ON w.feature = 'age_at_completion' AND w.bin = {_cut('age_at_completion')}")
def woe_transform(spark, d):
    fit = E.fit_woe_bins(train(spark, d), "age_at_completion", "is_app_fraud", cuts=CUTS["age_at_completion"])
    return load(spark, d, "members").select("company_id", F.round(E.woe_column(fit), 6).alias("woe"))


@query("fitted_woe_bins", ())
def fitted_woe_bins(spark, d):
    t = staged(train(spark, d).select("is_app_fraud", "balance", "declared_amount", "score"))
    return E.woe_report(t, [E.fit_woe_bins(t, f, "is_app_fraud", buckets=8) for f in ["balance", "declared_amount", "score"]])


@query("cap_floor", ("members",), """
q AS (SELECT quantile_cont(declared_amount, 0.01) AS lo, quantile_cont(declared_amount, 0.99) AS hi FROM members WHERE data_type = 'train')
SELECT company_id, ROUND(GREATEST(lo, LEAST(hi, declared_amount)), 4) AS declared_amount FROM members, q""")
def cap_floor(spark, d):
    m = load(spark, d, "members").select("company_id", "data_type", "declared_amount")
    limits = E.fit_cap_floor(m.filter("data_type = 'train'"), ["declared_amount"], 0.01, 0.99, buckets=8)
    return E.apply_cap_floor(m, limits).select("company_id", F.round("declared_amount", 4).alias("declared_amount"))


@query("min_max_scaled", ("members",), "SELECT company_id, ROUND((balance - MIN(balance) OVER ()) / (MAX(balance) OVER () - MIN(balance) OVER ()), 6) AS scaled FROM members")
def min_max_scaled(spark, d):
    out = E.min_max_scale(load(spark, d, "members").select("company_id", "balance"), {"scaled": F.col("balance")})
    return out.select("company_id", F.round("scaled", 6).alias("scaled"))


@query("impute_scale_components", ())
def impute_scale_components(spark, d):
    m = load(spark, d, "members").select("company_id", F.col("balance"), F.col("days_to_app_fraud").cast("double").alias("days"), F.col("score").cast("double").alias("score"))
    columns = ["balance", "days", "score"]
    filled = Imputer(strategy="median", inputCols=columns, outputCols=columns).fit(m).transform(m)
    vectors = VectorAssembler(inputCols=columns, outputCol="raw").transform(filled)
    scaled = StandardScaler(withMean=True, inputCol="raw", outputCol="scaled").fit(vectors).transform(vectors)
    return PCA(k=2, inputCol="scaled", outputCol="components").fit(scaled).transform(scaled).select("company_id", vector_to_array("components").alias("components"))
