"""Registered decision queries: payload features, standard scores, decisions and replay monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gatewise.functions.scalars import COMMON_EMAIL_HOSTS, year_month
from gatewise.operators import decide as D, models as G
from gatewise.operators.aggregates import overlap_rates, percent_pivot, value_shares
from gatewise.operators.encoders import fit_smoothed_encoding
from gatewise.plans.evaluation import _r
from gatewise.plans.expressions import COUNTRIES, KEYWORDS
from gatewise.plans.registry import query
from gatewise.session import checkpoint_folder, staged
from gatewise.sources.files import write_stage
from gatewise.sources.standins import load

HIGH, MEDIUM = 700, 300
PAIRS = [(a, b) for a, b, _ in COUNTRIES]
# A small linear score, so that reasons can be checked exactly.
COEFFICIENTS = {"age_at_completion": -0.03125, "company_age_months": -0.015625, "failed_rules": 0.375, "years_to_id_expiry": 0.0625}
MEANS = {"age_at_completion": 42.0, "company_age_months": 24.0, "failed_rules": 2.0, "years_to_id_expiry": 4.0}


def payloads(spark, d):
    return D.payload_from_members(load(spark, d, "members"), KEYWORDS, ["company_id", "score", "is_app_fraud"])


_MAP = "MAP {" + ", ".join(f"'{a}': '{a}', '{b}': '{a}'" for a, b in PAIRS) + "}"
_HOSTS = ", ".join(f"'{h}'" for h in COMMON_EMAIL_HOSTS)
_FEATURES = rf"""
s AS (SELECT *, trim(postcode_raw) AS t, CASE WHEN length(trim(postcode_raw)) <= 4 THEN trim(postcode_raw) ELSE left(replace(trim(postcode_raw), ' ', ''), greatest(length(replace(trim(postcode_raw), ' ', '')) - 3, 0)) END AS o,
  list_extract(string_split(list_extract(string_split(email_raw, '@'), -1), '#'), -1) AS host, ' ' || lower(trim(trading_name_raw)) || ' ' AS trade FROM members),
feat AS (SELECT company_id, is_app_fraud, is_approved, data_type, identity_address_fail AS individual_identity_address, COALESCE({_MAP}[idcountry_raw], 'Undefined') AS applicant_idcountry_issue,
  CASE WHEN nationality_raw IS NULL OR nationality_raw = 'null' THEN ['Undefined'] ELSE list_transform(string_split(nationality_raw, ' '), lambda x: COALESCE({_MAP}[x], 'Undefined')) END AS applicant_nationality,
  CASE WHEN sic_raw IS NULL THEN ['Undefined'] ELSE list_filter(list_transform(string_split(sic_raw, ','), lambda x: trim(x)), lambda x: x <> '') END AS company_sic,
  COALESCE(icc_raw, 'Undefined') AS company_icc,
  CASE WHEN COALESCE(t, '') IN ('', 'none', 'None', 'null') OR NOT length(o) BETWEEN 2 AND 4 THEN 'Undefined' ELSE regexp_replace(o, '[0-9]', '', 'g') END AS applicant_postcode,
  CASE WHEN length(postcode_area) BETWEEN 2 AND 4 THEN postcode_area ELSE 'Undefined' END AS company_postcode,
  CASE WHEN host IN ({_HOSTS}) THEN host ELSE 'other' END AS applicant_email_domain, CASE WHEN regexp_matches(email_raw, '[0-9]') THEN 1 ELSE 0 END AS applicant_email_numeric,
  CAST(GREATEST(0, LEAST(10, years_to_id_expiry)) AS DOUBLE) AS applicant_years_to_id_expiry, CAST(age_at_completion AS DOUBLE) AS age_at_completion,
  date_diff('day', incorporated_on, created_on) / 30.436875 AS company_age_at_completion,
  GREATEST(keyword_present, CASE WHEN regexp_matches(trade, '[^a-z0-9_](c\.i\.c|trust|second hand|ruby|trading|trade|bank|holdings|gold)[^a-z0-9_]') THEN 1 ELSE 0 END) AS is_restricted_keyword_present,
  applicant_id_type, structure_level AS company_structurelevelwise FROM s)"""


@query("payload_features", ("members",), _FEATURES + """
SELECT company_id, individual_identity_address, applicant_idcountry_issue, array_to_string(applicant_nationality, ',') AS applicant_nationality, array_to_string(company_sic, ',') AS company_sic, company_icc, applicant_postcode,
  company_postcode, applicant_email_domain, applicant_email_numeric, applicant_years_to_id_expiry AS years, age_at_completion, ROUND(company_age_at_completion, 6) AS company_age, is_restricted_keyword_present,
  applicant_id_type, company_structurelevelwise FROM feat""")
def payload_features(spark, d):
    f = D.payload_features(payloads(spark, d), PAIRS, ["company_id"])
    lists = {c: F.array_join(c, ",") for c in D.ENCODED_LISTS}
    return f.withColumns({**lists, "years": F.col("applicant_years_to_id_expiry"), "company_age": F.round("company_age_at_completion", 6)}).drop("applicant_years_to_id_expiry", "company_age_at_completion")


# Invented bounds and coefficients of a small scorecard over all inputs of the model.
CUTS = {f: [0.004, 0.012, 0.03, 0.08, 0.2, 0.4] for f in D.WOE_INPUTS} | {"age_at_completion": [25.0, 35.0, 50.0], "company_age_at_completion": [6.0, 18.0, 30.0, 48.0], "applicant_years_to_id_expiry": [1.0, 4.0, 7.0]}
SCORECARD = {f"{f}_woe": -0.75 - i / 16 for i, f in enumerate(D.WOE_INPUTS)} | {"individual_identity_address": 0.4375, "applicant_email_numeric": -0.3125, "is_restricted_keyword_present": 0.8125}
INTERCEPT = -0.5
_STD = f"CAST(round_even(CASE WHEN score >= {HIGH} THEN (score - {HIGH}) / (1000 - {HIGH}) * 397 + 602 WHEN score >= {MEDIUM} THEN (score - {MEDIUM}) / ({HIGH} - 1 - {MEDIUM}) * 201 + 400 ELSE score / {MEDIUM} * 198 + 201 END, 0) AS INTEGER)"


def _chain_sql() -> str:
    """The fitted chain in SQL: category encodings, bins, model inputs, score and decision."""
    train = "FROM feat WHERE is_approved = 1 AND data_type = 'train'"
    maps, coded, parts = [], [], [_FEATURES]
    for f in D.ENCODED + D.ENCODED_LISTS:
        value = f"{f}[1]" if f in D.ENCODED_LISTS else f
        parts.append(f"e_{f} AS (SELECT MAP(list(c), list(v)) AS m_{f} FROM (SELECT c, (y + SUM(y) OVER () / SUM(n) OVER () * 10) / (n + 10) AS v FROM (SELECT {value} AS c, COUNT(*) AS n, CAST(SUM(is_app_fraud) AS DOUBLE) AS y {train} GROUP BY 1)))")
        coded.append((f"list_max(list_transform({f}, lambda x: COALESCE(m_{f}[x], 0)))" if f in D.ENCODED_LISTS else f"COALESCE(m_{f}[{f}], 0)") + f" AS {f}_encoded")
    parts.append(f"coded AS (SELECT *, GREATEST(company_icc_encoded, company_sic_encoded) AS company_nob_encoded FROM (SELECT feat.*, {', '.join(coded)} FROM feat, {', '.join('e_' + f for f in D.ENCODED + D.ENCODED_LISTS)}))")
    for f in D.WOE_INPUTS:
        maps.append(f"CASE WHEN {f} IS NULL THEN -1 " + " ".join(f"WHEN {f} <= {c} THEN {i}" for i, c in enumerate(CUTS[f])) + f" ELSE {len(CUTS[f])} END AS b_{f}")
    parts.append(f"binned AS (SELECT *, {', '.join(maps)} FROM coded)")
    counts = " UNION ALL ".join(f"SELECT '{f}' AS feature, b_{f} AS bin, SUM(is_app_fraud) AS e, COUNT(*) - SUM(is_app_fraud) AS o FROM binned WHERE is_approved = 1 AND data_type = 'train' GROUP BY 2" for f in D.WOE_INPUTS)
    parts.append(f"bins AS (SELECT *, SUM(e) OVER (PARTITION BY feature) AS te, SUM(o) OVER (PARTITION BY feature) AS tot FROM ({counts}))")
    parts.append("woes AS (SELECT feature, bin, LN((GREATEST(o, 0.5) / tot) / (GREATEST(e, 0.5) / te)) AS woe, LN((0.5 / tot) / (0.5 / te)) AS none FROM bins)")
    joins = " ".join(f"LEFT JOIN woes w{i} ON w{i}.feature = '{f}' AND w{i}.bin = b_{f}" for i, f in enumerate(D.WOE_INPUTS))
    values = ", ".join(f"COALESCE(w{i}.woe, CASE WHEN b_{f} = -1 THEN 0 ELSE (SELECT MAX(none) FROM woes WHERE feature = '{f}') END) AS {f}_woe" for i, f in enumerate(D.WOE_INPUTS))
    parts.append(f"inputs AS (SELECT binned.*, {values} FROM binned {joins})")
    parts.append("means AS (SELECT " + ", ".join(f"AVG({f}) AS {f}" for f in SCORECARD) + " FROM inputs WHERE is_approved = 1 AND data_type = 'train')")
    parts.append("p AS (SELECT company_id, data_type, " + ", ".join(f"{c} * (i.{f} - m.{f}) AS p{k}" for k, (f, c) in enumerate(SCORECARD.items())) + " FROM inputs i, means m)")
    every = ", ".join(f"p{k}" for k in range(len(SCORECARD)))
    total = " + ".join(f"p{k}" for k in range(len(SCORECARD)))
    reason = "CASE " + " ".join(f"WHEN p{k} = GREATEST({every}) THEN '{f.removesuffix('_woe').removesuffix('_encoded').upper()}'" for k, f in enumerate(SCORECARD)) + " END"
    parts.append(f"scored AS (SELECT company_id, data_type, CAST(round_even(1000 / (1 + EXP(-({INTERCEPT} + {total}))), 0) AS INTEGER) AS score, {reason} AS why FROM p)")
    parts.append(f"rated AS (SELECT *, {_STD} AS rating FROM scored)")
    parts.append("decided AS (SELECT company_id, data_type, score AS raw_rating, rating, CASE WHEN rating <= 399 THEN 'LOW' WHEN rating <= 601 THEN 'MEDIUM' ELSE 'HIGH' END AS category, CASE WHEN rating <= 601 THEN 'BAU' ELSE 'EDD' END AS decision, CASE WHEN rating > 601 THEN why END AS reason FROM rated)")
    return ",\n".join(parts)


_CHAIN = _chain_sql()


def saved_chain(spark, d) -> str:
    """Fit the chain on approved training members, write it to files and give their folder. Encodings are m-estimates, which SQL can check."""
    train = load(spark, d, "members").filter("is_approved = 1 AND data_type = 'train'")
    features = staged(D.payload_features(D.payload_from_members(train, KEYWORDS, ["company_id", "is_app_fraud"]), PAIRS, ["company_id", "is_app_fraud"]))
    folder = f"{checkpoint_folder(spark)}/chain-{uuid.uuid4().hex}"
    D.save_chain(D.fit_chain(features, "is_app_fraud", CUTS, SCORECARD, INTERCEPT, lambda counts: fit_smoothed_encoding(counts, "m")), folder)
    return folder


@query("decide_payloads", ("members",), _CHAIN + " SELECT company_id, raw_rating, rating, category, decision, reason FROM decided")
def decide_payloads(spark, d):
    """All payloads through the whole chain, read back from its files."""
    chain = D.load_chain(spark, saved_chain(spark, d))
    return D.decide_payloads(payloads(spark, d), PAIRS, chain, HIGH, MEDIUM, ["company_id"])


@query("score_later_period", ("members",), _CHAIN + " SELECT company_id, raw_rating, reason FROM decided WHERE data_type = 'val'")
def score_later_period(spark, d):
    """The validation period from files alone: payloads kept by period (only that folder is read), the chain from its files."""
    folder = saved_chain(spark, d)
    kept = D.payload_from_members(load(spark, d, "members"), KEYWORDS, ["company_id", "data_type"])
    write_stage(kept, f"{folder}/payloads", "data_type")
    later = spark.read.parquet(f"{folder}/payloads").where("data_type = 'val'")
    return D.decide_payloads(later, PAIRS, D.load_chain(spark, folder), HIGH, MEDIUM, ["company_id"]).select("company_id", "raw_rating", "reason")


@query("standardise_score", ("applications",), f"SELECT company_id, score, {_STD} AS rating FROM applications")
def standardise_score(spark, d):
    return load(spark, d, "applications").select("company_id", "score", D.standardise_score("score", HIGH, MEDIUM).alias("rating"))


_PARTS = ", ".join(f"{c} * ({f} - {MEANS[f]}) AS p{i}" for i, (f, c) in enumerate(COEFFICIENTS.items()))
_REASON = "CASE " + " ".join(f"WHEN p{i} = GREATEST(p0, p1, p2, p3) THEN '{f.upper()}'" for i, f in enumerate(COEFFICIENTS)) + " END"
_DECIDED = f"""
p AS (SELECT *, {_STD} AS rating, {_PARTS} FROM members),
decided AS (SELECT *, score AS raw_rating, CASE WHEN rating <= 399 THEN 'LOW' WHEN rating <= 601 THEN 'MEDIUM' ELSE 'HIGH' END AS category, CASE WHEN rating <= 601 THEN 'BAU' ELSE 'EDD' END AS decision,
  CASE WHEN rating > 601 THEN {_REASON} END AS reason FROM p)"""


def decided(spark, d):
    reason = G.top_reason(G.scorecard_contributions(COEFFICIENTS, MEANS))
    return D.decide(load(spark, d, "members"), "score", HIGH, MEDIUM, reason)


@query("decide_scores", ("members",), _DECIDED + " SELECT company_id, raw_rating, rating, category, decision, reason FROM decided")
def decide_scores(spark, d):
    return decided(spark, d).select("company_id", "raw_rating", "rating", "category", "decision", "reason")


@query("band_consistency", ("members",), _DECIDED + f" SELECT company_id FROM decided WHERE category <> CASE WHEN score >= {HIGH} THEN 'HIGH' WHEN score >= {MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END")
def band_consistency(spark, d):
    return D.inconsistent_bands(decided(spark, d), HIGH, MEDIUM).select("company_id")


@query("replay_categories", ("members",), _DECIDED + """ SELECT category, CAST(COUNT(*) AS BIGINT) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share, ROUND(AVG(is_app_fraud), 6) AS label_rate,
  ROUND(AVG(is_app_fraud) / (SUM(SUM(is_app_fraud)) OVER () / SUM(COUNT(*)) OVER ()), 6) AS lift FROM decided GROUP BY 1""")
def replay_categories(spark, d):
    return _r(D.category_report(decided(spark, d), "is_app_fraud"))


@query("replay_by_month", ("members",), _DECIDED + " SELECT strftime(created_on, '%Y-%m') AS year_month, " + ", ".join(
    f"ROUND(100.0 * SUM(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) / COUNT(*), 2) AS \"{c}\"" for c in ["LOW", "MEDIUM", "HIGH"]) + " FROM decided GROUP BY 1")
def replay_by_month(spark, d):
    return percent_pivot(decided(spark, d).withColumn("year_month", year_month("created_on")), "year_month", "category", ["LOW", "MEDIUM", "HIGH"])


@query("replay_overlap", ("members",), _DECIDED + " " + " UNION ALL ".join(f"SELECT '{n}' AS measure, ROUND(AVG(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS rate FROM decided" for n, c in [
    ("rules", "failed_rules >= 3"), ("model", "decision = 'EDD'"), ("rules_or_model", "failed_rules >= 3 OR decision = 'EDD'"), ("rules_and_model", "failed_rules >= 3 AND decision = 'EDD'"), ("any", "failed_rules >= 3 OR decision = 'EDD'")]))
def replay_overlap(spark, d):
    return _r(overlap_rates(decided(spark, d), {"rules": F.col("failed_rules") >= 3, "model": F.col("decision") == "EDD"}))


@query("replay_reasons", ("members",), _DECIDED + " SELECT reason, CAST(COUNT(*) AS BIGINT) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM decided WHERE category = 'HIGH' GROUP BY 1")
def replay_reasons(spark, d):
    return _r(value_shares(decided(spark, d).filter("category = 'HIGH'"), "reason"))


@query("replay_sample_decisions", ())
def replay_sample_decisions(spark, d):
    from gatewise.operators.weights import stratified_sample
    m = stratified_sample(load(spark, d, "members").withColumn("year_month", year_month("created_on")), "year_month", "company_id", 0.05)
    return D.decide(m, "score", HIGH, MEDIUM).select("company_id", "year_month", "raw_rating", "rating", "category", "decision")
