"""Registered hand rules, rule mining and rule measurement."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gatewise.functions.scalars import flag, term_flags
from gatewise.operators import encoders as E, rules as R
from gatewise.operators.aggregates import cross_tab, value_shares
from gatewise.plans.registry import query
from gatewise.sources.standins import load

RISK_FEATURES = ["structure_level", "company_type", "identity_address_fail", "postcode_risk", "country_risk", "email_domain", "company_status"]
MINED = ["applicant_id_type", "company_icc", *RISK_FEATURES]


def km_train(spark, d):
    return load(spark, d, "members").filter("is_approved = 1 AND data_type = 'train'")


def _in(values):
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _like(column, terms, fmt="%{}%"):
    return "(" + " OR ".join(f"contains({column}, '{t}')" if fmt == "%{}%" else f"starts_with({column}, '{t}')" for t in terms) + ")"


_T = {c: f"COALESCE({c}, '')" for c in ["idcountry_raw", "id_type_raw", "company_type_raw", "postcode_raw", "icc_raw", "sic_raw", "email_raw", "device_raw", "trading_name_raw", "id_subtype_raw", "nationality_raw"]}
_HAND = {
    "single_name": "(COALESCE(first_name, '') <> '') <> (COALESCE(last_name, '') <> '')",
    "animal_breeder": f"contains(lower({_T['icc_raw']}), 'animal_breeder')",
    "country_russia": f"upper({_T['idcountry_raw']}) IN ('RU', 'RUS')", "country_ukraine": f"upper({_T['idcountry_raw']}) IN ('UA', 'UKR')",
    "country_belarus": f"upper({_T['idcountry_raw']}) IN ('BY', 'BLR')",
    "country_romania": f"upper({_T['idcountry_raw']}) IN ('RO', 'ROU') AND contains({_T['id_type_raw']}, 'PASSPORT') AND (company_type_raw IS NULL OR {_like('company_type_raw', ['LTD', 'null', 'None'])})"
                       f" AND ({_like(_T['postcode_raw'], R.ROMANIA_POSTCODES, '{}%')} OR {_like(_T['icc_raw'], R.ROMANIA_INDUSTRIES)} OR {_like(_T['sic_raw'], R.ROMANIA_SIC)})",
    "country_portugal": f"upper({_T['idcountry_raw']}) IN ('PT', 'PRT') AND {_like(_T['id_type_raw'], ['PASSPORT', 'ID_CARD'])} AND is_registered = 1 AND {_like(_T['postcode_raw'], R.PORTUGAL_POSTCODES, '{}%')}"
                        f" AND contains(lower({_T['email_raw']}), '@gmail.com') AND contains(lower({_T['device_raw']}), 'ios')",
    "company_bank": f"contains(lower({_T['trading_name_raw']}), 'bank') OR contains(lower({_T['icc_raw']}), '{R.BANK_INDUSTRY}') OR {_like(_T['sic_raw'], R.BANK_SIC)}",
    "provisional_licence": f"id_type_raw = 'DRIVING_LICENSE' AND ({_T['id_subtype_raw']} = 'LEARNING_DRIVING_LICENSE' OR ({_T['idcountry_raw']} IN ('GB', 'GBR') AND (id_subtype_raw IS NULL OR id_subtype_raw IN ('none', 'None', 'null'))))",
    "residence_permit": f"id_type_raw = 'ID_CARD' AND {_T['id_subtype_raw']} = 'RESIDENT_PERMIT_ID'",
    "prohibited_nationality": f"list_has_any(string_split({_T['nationality_raw']}, ' '), ['" + "', '".join(R.PROHIBITED_NATIONALITIES) + "'])",
}


@query("hand_rules", ("members",), "f AS (SELECT company_id, " + ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {n}" for n, c in _HAND.items()) + " FROM members) SELECT *, GREATEST("
       + ", ".join(_HAND) + ") AS any_rule, " + " + ".join(_HAND) + " AS rule_count FROM f")
def hand_rules(spark, d):
    rules = R.hand_rules()
    return R.with_rule_flags(load(spark, d, "members"), rules).select("company_id", *rules, "any_rule", "rule_count")


@query("country_rules_substring", ("members",), "SELECT company_id, " + ", ".join(
    f"CASE WHEN {_like('upper(' + _T['idcountry_raw'] + ')', codes)} THEN 1 ELSE 0 END AS {n}"
    for n, codes in [("russia", R.RUSSIA), ("ukraine", R.UKRAINE), ("belarus", R.BELARUS), ("romania", R.ROMANIA)]) + " FROM members")
def country_rules_substring(spark, d):
    lists = {"russia": R.RUSSIA, "ukraine": R.UKRAINE, "belarus": R.BELARUS, "romania": R.ROMANIA}
    return load(spark, d, "members").select("company_id", *(flag(R.country_is("idcountry_raw", c, quirk=True)).alias(n) for n, c in lists.items()))


_TRIGGERS = {g: "CASE WHEN " + _like("upper(COALESCE(triggers_raw, ''))", [c.upper() for c in codes]) + " THEN 1 ELSE 0 END" for g, codes in R.TRIGGER_GROUPS.items()}


@query("trigger_groups", ("members",), "SELECT company_id, " + ", ".join(f"{c} AS {g}" for g, c in _TRIGGERS.items()) + ", LEAST(5, failed_rules + " + " + ".join(_TRIGGERS.values()) + ") AS failed_count FROM members")
def trigger_groups(spark, d):
    flags = R.trigger_flags("triggers_raw")
    m = load(spark, d, "members").withColumns(flags)
    return m.select("company_id", *flags, R.failed_rule_count([F.col("failed_rules"), *(F.col(g) for g in flags)]).alias("failed_count"))


_RATIO = """
ratios AS (""" + " UNION ALL ".join(f"""
  SELECT '{f}' AS feature, {f} AS category, COUNT(*) AS total, SUM(is_app_fraud) AS y, CASE WHEN COUNT(*) > SUM(is_app_fraud) THEN SUM(is_app_fraud) / (COUNT(*) - SUM(is_app_fraud)) END AS ratio
  FROM members WHERE is_approved = 1 AND data_type = 'train' GROUP BY {f}""" for f in R.LEARNED_FEATURES) + """),
ranked AS (SELECT *, CASE WHEN COALESCE(ratio, 1e300) > 0.08 THEN 1 ELSE 0 END AS risky,
  COUNT(*) OVER (PARTITION BY feature ORDER BY COALESCE(ratio, 1e300) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM ratios)"""


@query("ratio_encoder", ("members",), _RATIO + "SELECT feature, category, CAST(total AS BIGINT) AS total, CAST(y AS DOUBLE) AS y, ROUND(ratio, 6) AS ratio, risky, CAST(place AS BIGINT) AS place FROM ranked")
def ratio_encoder(spark, d):
    return E.ratio_table(km_train(spark, d), R.LEARNED_FEATURES, "is_app_fraud", 0.08).withColumn("ratio", F.round("ratio", 6))


_NAMED = {
    "risky_country_young_id": f"applicant_country IN {_in(R.RULE1_COUNTRIES)} AND age_at_completion <= 30 AND applicant_id_type IN {_in(R.RULE1_ID_TYPES)}",
    "listed_industry_young": f"company_icc IN {_in(R.RULE2_INDUSTRIES)} AND age_at_completion <= 25",
    "industry_address_internal": "icc_risky AND identity_address_fail = 1 AND internal_check_fail = 1",
    "industry_rules_address": "icc_risky AND failed_rules >= 2 AND identity_address_fail = 1",
    "industry_address": "icc_risky AND identity_address_fail = 1",
    "industry_young_directors_keyword": "icc_risky AND directors_avg_age <= 26 AND keyword_present = 1",
    "expiry_young_directors_sanctions": "years_to_id_expiry <= 5 AND directors_avg_age <= 25 AND sanctions_fail = 1",
    "email_nationality_expiry": "email_numeric = 1 AND nat_risky AND years_to_id_expiry >= 5",
    "risky_email": "email_numeric = 1 AND email_domain = 'outlook.com'",
    "young_and_new": "age_at_completion <= 20 AND company_age_months <= 1",
    "sole_trader_risky_country": "company_type = 'sole-trader' AND country_risk = 'High'",
    "industry_and_romania": f"company_icc IN {_in(R.RULE12_INDUSTRIES)} AND applicant_country = 'RO'",
    "id_country_industry": f"applicant_id_type IN {_in(R.RULE13_ID_TYPES)} AND applicant_country IN {_in(R.RULE13_COUNTRIES)} AND company_icc IN {_in(R.RULE13_INDUSTRIES)}",
    "postcode_address_industry": f"postcode_area IN {_in(R.RULE14_POSTCODES)} AND identity_address_fail = 1 AND company_icc IN {_in(R.RULE13_INDUSTRIES)}",
    "status_industry_country": f"company_status IN {_in(R.RULE15_STATUSES)} AND icc_risky AND country_risky",
}
_FLAGGED = _RATIO + """,
flagged AS (SELECT *, company_icc IN (SELECT category FROM ranked WHERE feature = 'company_icc' AND risky = 1) AS icc_risky,
  applicant_nationality IN (SELECT category FROM ranked WHERE feature = 'applicant_nationality' AND risky = 1) AS nat_risky,
  applicant_country IN (SELECT category FROM ranked WHERE feature = 'applicant_country' AND risky = 1) AS country_risky FROM members WHERE data_type {split}),
fired AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS rule, CASE WHEN {c} THEN 1 ELSE 0 END AS hit, is_approved AS km, CASE WHEN is_approved = 0 THEN 1 ELSE is_app_fraud END AS fraud, app_fraud_amount AS amount FROM flagged" for n, c in _NAMED.items()) + """),
g AS (SELECT rule, COUNT(*) AS rm, SUM(km) AS km, SUM(hit * km) AS ak, SUM(hit) AS ar, SUM(hit * km * fraud) AS fk, SUM(hit * fraud) AS fr, SUM(km * fraud) AS tk,
  SUM(CASE WHEN km * fraud = 1 THEN amount ELSE 0 END) AS vk, SUM(CASE WHEN hit * km * fraud = 1 THEN amount ELSE 0 END) AS av FROM fired GROUP BY rule)
SELECT rule, CAST(rm AS BIGINT) AS rm, CAST(km AS BIGINT) AS km, CAST(ak AS BIGINT) AS alerted_km, CAST(ar AS BIGINT) AS alerted_rm, CAST(fk AS BIGINT) AS alerted_frauds_km, CAST(fr AS BIGINT) AS alerted_frauds_rm,
  ROUND(100.0 * ar / rm, 6) AS alert_rate, ROUND(100.0 * fk / NULLIF(ak, 0), 6) AS "precision", ROUND(100.0 * fk / NULLIF(tk, 0), 6) AS recall, ROUND(100.0 * av / NULLIF(vk, 0), 6) AS recall_value,
  ROUND(100.0 * (ak - fk) / NULLIF(ak, 0), 6) AS false_alert_rate_km, ROUND(100.0 * (ar - fr) / NULLIF(ar, 0), 6) AS false_alert_rate_rm, ROUND(tk / NULLIF(km, 0), 6) AS fraud_per_km,
  ROUND(vk / NULLIF(km, 0), 4) AS value_per_km, ROUND(fk / NULLIF(km, 0), 6) AS alerted_fraud_per_km, ROUND(av / NULLIF(km, 0), 4) AS alerted_value_per_km FROM g WHERE ar > 0"""


def _rule_table(spark, d, condition):
    ratios = E.ratio_table(km_train(spark, d), R.LEARNED_FEATURES, "is_app_fraud", 0.08)
    flagged = R.with_learned_flags(load(spark, d, "members").filter(condition), ratios)
    out = R.rule_table(flagged, R.named_rules())
    digits = {c: 4 if c in ("value_per_km", "alerted_value_per_km") else 6 for c in out.columns[7:]}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("rule_table", ("members",), _FLAGGED.replace("{split}", "= 'train'"))
def rule_table(spark, d):
    return _rule_table(spark, d, "data_type = 'train'")


@query("rule_table_later_period", ("members",), _FLAGGED.replace("{split}", "<> 'train'"))
def rule_table_later_period(spark, d):
    return _rule_table(spark, d, "data_type <> 'train'")


_MEASURES = """CAST(n AS BIGINT) AS size, CAST(y AS BIGINT) AS frauds, CAST(ty AS BIGINT) AS frame_frauds, ROUND(100.0 * y / n, 6) AS fraud_rate, ROUND(y / n, 6) AS "precision", ROUND(y / ty, 6) AS recall,
  ROUND(ya / tya, 6) AS recall_value, ROUND(2 * y / (n + ty), 6) AS f1, ROUND((n - y) / (tn_ - ty), 6) AS false_positive_rate, CAST(y AS BIGINT) AS tp, CAST(n - y AS BIGINT) AS fp, CAST(ty - y AS BIGINT) AS fn,
  CAST(tn_ - ty - (n - y) AS BIGINT) AS tn"""
_KM = "km AS (SELECT * FROM members WHERE is_approved = 1 AND data_type = 'train'), tot AS (SELECT COUNT(*) AS tn_, SUM(is_app_fraud) AS ty, SUM(app_fraud_amount) AS tya FROM km)"
_AGG = "COUNT(*) AS n, SUM(is_app_fraud) AS y, SUM(CASE WHEN is_app_fraud = 1 THEN app_fraud_amount ELSE 0 END) AS ya"


def _round(df):
    ratios = ["alert_rate", "fraud_rate", "precision", "recall", "recall_value", "f1", "false_positive_rate"]
    return df.withColumns({c: F.round(c, 6) for c in ratios if c in df.columns})


@query("univariate_rules", ("members",), _KM + ", g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, {_AGG} FROM km GROUP BY {f}" for f in MINED) + f") SELECT feature, value, {_MEASURES} FROM g, tot WHERE value IS NOT NULL")
def univariate_rules(spark, d):
    return _round(R.univariate_rules(km_train(spark, d), MINED, "is_app_fraud", "app_fraud_amount"))


@query("bivariate_rules", ("members",), _KM + ", g AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, CAST({a} AS VARCHAR) AS value1, '{b}' AS feature2, CAST({b} AS VARCHAR) AS value2, {_AGG} FROM km GROUP BY {a}, {b}" for a, b in combinations(MINED, 2))
    + f") SELECT feature1, value1, feature2, value2, {_MEASURES} FROM g, tot WHERE value1 IS NOT NULL AND value2 IS NOT NULL")
def bivariate_rules(spark, d):
    return _round(R.bivariate_rules(km_train(spark, d), MINED, "is_app_fraud", "app_fraud_amount"))


@query("threshold_grid", ("members",), _KM + f""",
g AS (SELECT a AS first_limit, b AS second_limit, {_AGG} FROM km, range(20, 31) x(a), range(1, 13) y(b) WHERE age_at_completion <= a AND company_age_months <= b GROUP BY 1, 2)
SELECT CAST(first_limit AS INTEGER) AS first_limit, CAST(second_limit AS INTEGER) AS second_limit, {_MEASURES} FROM g, tot""")
def threshold_grid(spark, d):
    return _round(R.threshold_grid(km_train(spark, d), "age_at_completion", "company_age_months", list(range(20, 31)), list(range(1, 13)), "is_app_fraud", "app_fraud_amount"))


@query("single_rule_metrics", ("members",), _KM + f""", g AS (SELECT {_AGG} FROM km WHERE email_numeric = 1 AND email_domain = 'outlook.com')
SELECT 'risky_email' AS rule, CAST(tn_ AS BIGINT) AS records, ROUND(100.0 * n / tn_, 6) AS alert_rate, {_MEASURES} FROM g, tot""")
def single_rule_metrics(spark, d):
    rule = {"risky_email": (F.col("email_numeric") == 1) & (F.col("email_domain") == "outlook.com")}
    return _round(R.rule_metrics(km_train(spark, d), rule, "is_app_fraud", "app_fraud_amount"))


@query("rule_overlap", ("members",), _KM + """ SELECT CASE WHEN company_type = 'sole-trader' AND country_risk = 'High' THEN 1 ELSE 0 END AS rule1,
  CAST(SUM(CASE WHEN country_risk = 'High' AND postcode_risk = 'High' THEN 0 ELSE 1 END) AS BIGINT) AS "0", CAST(SUM(CASE WHEN country_risk = 'High' AND postcode_risk = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS "1" FROM km GROUP BY 1""")
def rule_overlap(spark, d):
    high = F.col("country_risk") == "High"
    m = km_train(spark, d).select(flag((F.col("company_type") == "sole-trader") & high).alias("rule1"), flag(high & (F.col("postcode_risk") == "High")).alias("rule2"))
    return cross_tab(m, "rule1", "rule2", [0, 1])


@query("rule_drill_down", ("members",), _KM + f""", k AS (SELECT * FROM km WHERE company_type = 'sole-trader' AND country_risk = 'High'),
t AS (SELECT COUNT(*) AS tn_, SUM(is_app_fraud) AS ty, SUM(app_fraud_amount) AS tya FROM k),
g AS (SELECT 'applicant_country' AS feature, applicant_country AS value, {_AGG} FROM k GROUP BY applicant_country) SELECT feature, value, {_MEASURES} FROM g, t""")
def rule_drill_down(spark, d):
    rule = (F.col("company_type") == "sole-trader") & (F.col("country_risk") == "High")
    return _round(R.drill_down(km_train(spark, d), rule, ["applicant_country"], "is_app_fraud", "app_fraud_amount"))


_FLAG_COLUMNS = ["identity_address_fail", "internal_check_fail", "sanctions_fail", "keyword_present", "email_numeric"]


@query("rule_capture", ("members",), _KM + ", g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS rule, CAST({f} AS VARCHAR) AS hit, {_AGG} FROM km GROUP BY {f}" for f in _FLAG_COLUMNS) + """)
SELECT rule, hit, CAST(n AS BIGINT) AS n, ROUND(y / ty, 6) AS fraud_share, ROUND(ya / tya, 6) AS amount_share, ROUND((n - y) / n, 6) AS false_positive_share FROM g, tot""")
def rule_capture(spark, d):
    out = R.rule_capture(km_train(spark, d), _FLAG_COLUMNS, "is_app_fraud", "app_fraud_amount")
    return out.withColumns({c: F.round(c, 6) for c in ["fraud_share", "amount_share", "false_positive_share"]})


_SCAMS = ["purchase", "investment", "advance", "romance", "invoice", "unknown"]


@query("capture_by_scam", ("tickets",), "w AS (SELECT lower(fraud_type) AS t, CASE WHEN is_subtask = 0 AND reported_by = 'Bank' THEN 1 ELSE 0 END AS c, CAST(company_id AS DOUBLE) AS a FROM tickets WHERE fraud_type IS NOT NULL), h AS ("
       + " UNION ALL ".join(f"SELECT '{s}' AS term, CASE WHEN list_contains(regexp_extract_all(t, '[a-z0-9_]+'), '{s}') THEN 1 ELSE 0 END AS hit, c, a FROM w" for s in _SCAMS)
       + ") SELECT term, ROUND(AVG(hit), 6) AS share, ROUND(SUM(hit * c) / NULLIF(SUM(hit), 0), 6) AS caught, ROUND(SUM(hit * c * a) / NULLIF(SUM(hit * a), 0), 6) AS amount_caught FROM h GROUP BY term")
def capture_by_scam(spark, d):
    t = load(spark, d, "tickets").filter("fraud_type IS NOT NULL").withColumn("a", F.col("company_id").cast("double"))
    out = R.capture_by_term(t, "fraud_type", term_flags("fraud_type", _SCAMS), (F.col("is_subtask") == 0) & (F.col("reported_by") == "Bank"), "a")
    return out.withColumns({c: F.round(c, 6) for c in ["share", "caught", "amount_caught"]})


@query("days_to_label_curve", ("applications",), """
v AS (SELECT days_to_app_fraud, COUNT(*) AS n, SUM(app_fraud_amount) AS a FROM applications WHERE is_app_fraud = 1 GROUP BY 1)
SELECT days_to_app_fraud, ROUND(100.0 * SUM(n) OVER w / SUM(n) OVER (), 6) AS cum_frauds_pct, ROUND(100.0 * SUM(a) OVER w / SUM(a) OVER (), 6) AS cum_amount_pct FROM v WINDOW w AS (ORDER BY days_to_app_fraud)""")
def days_to_label_curve(spark, d):
    out = R.days_to_label_curve(load(spark, d, "applications"), "days_to_app_fraud", "is_app_fraud", "app_fraud_amount")
    return out.select("days_to_app_fraud", F.round("cum_frauds_pct", 6).alias("cum_frauds_pct"), F.round("cum_amount_pct", 6).alias("cum_amount_pct"))


@query("high_band_reasons", ("members",), "SELECT company_icc, CAST(COUNT(*) AS BIGINT) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM members WHERE score >= 900 GROUP BY 1")
def high_band_reasons(spark, d):
    return value_shares(load(spark, d, "members").filter("score >= 900"), "company_icc").withColumn("share", F.round("share", 6))
