"""Registered projections, predicates and scalar functions over the raw member frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import scalars as S
from gatewise.operators import joins as J
from gatewise.plans.registry import query
from gatewise.session import literal_table
from gatewise.sources.standins import load
from gatewise.sources.tables import between_times, coerce, normalise_names, require_columns, run_query

# Invented sample of a country table (alpha-2, alpha-3, risk).
COUNTRIES = [("GB", "GBR", "Low"), ("RO", "ROU", "High"), ("PT", "PRT", "Medium"), ("RU", "RUS", "High"), ("UA", "UKR", "High"), ("BY", "BLR", "High"),
             ("IN", "IND", "Medium"), ("PK", "PAK", "High"), ("FR", "FRA", "Low"), ("US", "USA", "Low"), ("KP", "PRK", "High")]
COUNTRY_SCHEMA = "alpha_2 string, alpha_3 string, risk string"
# Invented sample of restricted words; production reads the whole list as a table (word, level).
KEYWORDS = ["ruby", "trading", "bank", "holdings", "gold", "second hand", "c.i.c", "trust", "trade"]

_C = "countries(a2, a3, risk) AS (VALUES " + ", ".join(str(r) for r in COUNTRIES) + ")"


def members(spark, d):
    return load(spark, d, "members")


@query("project_rename_drop", ("members",), "SELECT company_id AS id, score * 2 AS double_score, 'onboarding' AS source, is_approved = 1 AND score > 500 AS kept FROM members")
def project_rename_drop(spark, d):
    return (members(spark, d).select("company_id", "score", "is_approved").withColumnRenamed("company_id", "id")
            .withColumns({"double_score": F.col("score") * 2, "source": F.lit("onboarding"), "kept": (F.col("is_approved") == 1) & (F.col("score") > 500)})
            .drop("score", "is_approved"))


@query("coerce_bad_values", ("members",), "SELECT company_id, CAST(TRY_CAST(sic_raw AS BIGINT) AS DOUBLE) AS sic_number, TRY_CAST(structure_level AS DOUBLE) AS level FROM members")
def coerce_bad_values(spark, d):
    m = members(spark, d).select("company_id", F.col("sic_raw").alias("sic_number"), F.col("structure_level").alias("level"))
    return coerce(coerce(m, {"sic_number": "bigint"}), {"sic_number": "double", "level": "double"})


@query("filters_and_between", ("members",), """
SELECT company_id FROM members WHERE (is_approved = 1 AND score >= 300 AND NOT (country_risk = 'Low')) AND created_on BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  OR (is_approved = 0 AND created_on BETWEEN DATE '1999-01-01' AND DATE '1999-01-01' + INTERVAL 3 MONTH)""")
def filters_and_between(spark, d):
    day = F.col("created_on")
    start = F.lit("1999-01-01").cast("date")
    first = (F.col("is_approved") == 1) & (F.col("score") >= 300) & ~(F.col("country_risk") == "Low") & day.between("1996-01-01", "1998-12-31")
    second = (F.col("is_approved") == 0) & day.between(start, F.add_months(start, 3))
    return members(spark, d).filter(first | second).select("company_id")


@query("membership_and_null_tests", ("members",), """
SELECT company_id, CASE WHEN applicant_country IN ('RO', 'IN') THEN 1 ELSE 0 END AS listed, CASE WHEN icc_raw NOT IN ('category.builder') THEN 1 ELSE 0 END AS not_builder,
  CASE WHEN device_raw IS NULL OR device_raw <> 'web' THEN 1 ELSE 0 END AS not_web, CASE WHEN first_name IS NOT DISTINCT FROM last_name THEN 1 ELSE 0 END AS same_names FROM members""")
def membership_and_null_tests(spark, d):
    return members(spark, d).select(
        "company_id", S.flag(F.col("applicant_country").isin("RO", "IN")).alias("listed"), S.flag(~F.col("icc_raw").isin("category.builder")).alias("not_builder"),
        S.flag(F.col("device_raw").isNull() | (F.col("device_raw") != "web")).alias("not_web"), S.flag(F.col("first_name").eqNullSafe(F.col("last_name"))).alias("same_names"))


@query("case_map_and_fill", ("members",), """
SELECT company_id, CASE WHEN country_risk = 'High' THEN 3 WHEN country_risk = 'Medium' THEN 2 ELSE 1 END AS level, COALESCE(device_raw, 'Undefined') AS device,
  COALESCE(days_to_app_fraud, 9999) AS days, COALESCE(first_name, '') AS first_name FROM members""")
def case_map_and_fill(spark, d):
    m = members(spark, d).fillna({"days_to_app_fraud": 9999, "device_raw": "Undefined", "first_name": ""})
    level = F.when(F.col("country_risk") == "High", 3).when(F.col("country_risk") == "Medium", 2).otherwise(1)
    return m.select("company_id", level.alias("level"), F.col("device_raw").alias("device"), F.col("days_to_app_fraud").alias("days"), "first_name")


@query("drop_incomplete_rows", ("members",), "SELECT company_id FROM members WHERE first_name IS NOT NULL AND last_name IS NOT NULL AND sic_raw IS NOT NULL")
def drop_incomplete_rows(spark, d):
    return members(spark, d).select("company_id", "first_name", "last_name", "sic_raw").dropna().select("company_id")


@query("clip_and_row_stats", ("members",), """
SELECT company_id, CASE WHEN years_to_id_expiry IS NOT NULL THEN GREATEST(0, LEAST(10, years_to_id_expiry)) END AS years,
  CASE WHEN days_to_app_fraud IS NOT NULL THEN CAST(GREATEST(5, LEAST(90, days_to_app_fraud)) AS DOUBLE) END AS days,
  GREATEST(identity_address_fail, internal_check_fail, sanctions_fail) AS any_fail, LEAST(identity_address_fail, internal_check_fail, sanctions_fail) AS all_fail,
  identity_address_fail + internal_check_fail + sanctions_fail AS fails FROM members""")
def clip_and_row_stats(spark, d):
    checks = ["identity_address_fail", "internal_check_fail", "sanctions_fail"]
    return members(spark, d).select("company_id", S.clip("years_to_id_expiry", 0, 10).alias("years"), S.clip("days_to_app_fraud", 5, 90).cast("double").alias("days"),
                                    F.greatest(*checks).alias("any_fail"), F.least(*checks).alias("all_fail"), S.row_sum(checks).alias("fails"))


_ID_FLAGS = ["Passport", "Driving_Licence", "Provisional_Licence", "Residence_Permit", "National_ID", "Other_ID"]


@query("one_hot_columns", ("members",), "SELECT company_id, " + ", ".join(f"CASE WHEN applicant_id_type = '{t}' THEN 1 ELSE 0 END AS id_type_{t}" for t in _ID_FLAGS) + " FROM members")
def one_hot_columns(spark, d):
    return members(spark, d).withColumns(S.one_hot("applicant_id_type", _ID_FLAGS, "id_type")).select("company_id", *(f"id_type_{t}" for t in _ID_FLAGS))


@query("decode_one_hot", ("members",), """
SELECT company_id, CASE WHEN sanctions_fail = 1 THEN 'sanctions' WHEN internal_check_fail = 1 THEN 'internal' WHEN identity_address_fail = 1 THEN 'address' ELSE 'Undefined' END AS first_fail FROM members""")
def decode_one_hot(spark, d):
    order = [("sanctions_fail", "sanctions"), ("internal_check_fail", "internal"), ("identity_address_fail", "address")]
    return members(spark, d).select("company_id", S.first_set_flag(order).alias("first_fail"))


@query("worst_risk", ("members",), """
SELECT company_id, CASE WHEN 'High' IN (country_risk, postcode_risk) THEN 'High' WHEN 'Medium' IN (country_risk, postcode_risk) THEN 'Medium'
  WHEN 'Low' IN (country_risk, postcode_risk) THEN 'Low' ELSE 'Undefined' END AS worst FROM members""")
def worst_risk(spark, d):
    return members(spark, d).select("company_id", S.worst_of("country_risk", "postcode_risk").alias("worst"))


@query("email_features", ("members",), """
SELECT company_id, CASE WHEN regexp_matches(email_raw, '[0-9]') THEN 1 ELSE 0 END AS email_numeric, host,
  CASE WHEN host IN (""" + ", ".join(f"'{h}'" for h in S.COMMON_EMAIL_HOSTS) + """) THEN host ELSE 'other' END AS host_group
FROM (SELECT company_id, email_raw, string_split(string_split(email_raw, '@')[-1], '#')[-1] AS host FROM members)""")
def email_features(spark, d):
    m = members(spark, d).withColumn("host", S.email_host("email_raw"))
    return m.select("company_id", S.has_digit("email_raw").alias("email_numeric"), "host", S.keep_or_other("host", S.COMMON_EMAIL_HOSTS).alias("host_group"))


@query("postcode_outward", ("members",), """
s AS (SELECT company_id, trim(postcode_raw) AS t FROM members),
o AS (SELECT company_id, t, CASE WHEN length(t) <= 4 THEN t ELSE left(replace(t, ' ', ''), greatest(length(replace(t, ' ', '')) - 3, 0)) END AS outward FROM s),
v AS (SELECT company_id, CASE WHEN COALESCE(t, '') <> '' AND length(outward) BETWEEN 2 AND 4 THEN outward END AS outward,
  CASE WHEN COALESCE(t, '') = '' THEN 'empty' WHEN NOT length(outward) BETWEEN 2 AND 4 THEN 'bad length' END AS error FROM o)
SELECT company_id, outward, error, COALESCE(regexp_replace(outward, '[0-9]', '', 'g'), 'Undefined') AS area FROM v""")
def postcode_outward(spark, d):
    m = members(spark, d).withColumn("o", S.postcode_outward("postcode_raw"))
    return m.select("company_id", F.col("o.value").alias("outward"), F.col("o.error").alias("error"), S.postcode_area("postcode_raw").alias("area"))


@query("country_code", ("members",), _C + """
SELECT company_id, COALESCE(x.a2, y.a2) AS country, CASE WHEN trim(COALESCE(idcountry_raw, '')) = '' THEN 'not text' WHEN length(idcountry_raw) NOT IN (2, 3) THEN 'bad length'
  WHEN COALESCE(x.a2, y.a2) IS NULL THEN 'unknown code' END AS country_error FROM members LEFT JOIN countries x ON idcountry_raw = x.a2 LEFT JOIN countries y ON idcountry_raw = y.a3""")
def country_code(spark, d):
    table = literal_table(spark, COUNTRIES, COUNTRY_SCHEMA)
    return J.country_code(members(spark, d).select("company_id", "idcountry_raw"), "idcountry_raw", table, "country", "country_error").drop("idcountry_raw")


@query("country_risk_of_list", ("members",), _C + """,
e AS (SELECT company_id, unnest(string_split(nationality_raw, ' ')) AS c FROM members WHERE nationality_raw IS NOT NULL),
r AS (SELECT company_id, list(COALESCE(risk, 'Undefined')) AS risks FROM e LEFT JOIN countries ON c = a2 WHERE c <> 'null' GROUP BY 1)
SELECT m.company_id, CASE WHEN list_contains(risks, 'High') THEN 'High' WHEN list_contains(risks, 'Medium') THEN 'Medium' WHEN list_contains(risks, 'Low') THEN 'Low' ELSE 'Undefined' END AS risk
FROM members m LEFT JOIN r USING (company_id)""")
def country_risk_of_list(spark, d):
    table = literal_table(spark, [(a, r) for a, _, r in COUNTRIES], "code string, level string")
    exploded = members(spark, d).select("company_id", F.explode_outer(S.clean_array(F.split("nationality_raw", " "))).alias("code"))
    levels = J.lookup(exploded, "code", table, "code", "level", "level", S.UNDEFINED)
    return levels.groupBy("company_id").agg(F.collect_set("level").alias("levels")).select("company_id", S.worst_in("levels").alias("risk"))


@query("code_lists", ("members",), """
SELECT company_id, array_to_string(codes, '|') AS codes, CAST(len(codes) AS BIGINT) AS n, CASE WHEN len(codes) = 1 THEN '1' WHEN len(codes) = 2 THEN '2' WHEN len(codes) >= 3 THEN '3+' ELSE 'Undefined' END AS level
FROM (SELECT company_id, list_filter(list_transform(string_split(CASE WHEN sic_raw IS NULL OR lower(sic_raw) = 'nan' THEN '' ELSE sic_raw END, ','), lambda x: trim(x)), lambda x: x <> '') AS codes FROM members)""")
def code_lists(spark, d):
    m = members(spark, d).withColumn("codes", S.code_list("sic_raw"))
    return m.select("company_id", F.array_join("codes", "|").alias("codes"), F.size("codes").cast("bigint").alias("n"), S.count_level(F.size("codes")).alias("level"))


@query("industry_and_company_type", ("members",), """
SELECT company_id, lower(trim(icc_raw)) AS icc, CASE WHEN NOT missing THEN lower(trim(company_type_raw)) WHEN is_registered = 0 THEN 'sole-trader' END AS company_type,
  CASE WHEN missing AND is_registered = 1 THEN 1 ELSE 0 END AS type_error
FROM (SELECT *, company_type_raw IS NULL OR contains(company_type_raw, 'null') OR contains(company_type_raw, 'None') AS missing FROM members)""")
def industry_and_company_type(spark, d):
    m = members(spark, d).withColumn("t", S.company_type("company_type_raw", "is_registered"))
    return m.select("company_id", S.industry_code("icc_raw").alias("icc"), F.col("t.value").alias("company_type"), S.flag(F.col("t.error").isNotNull()).alias("type_error"))


@query("keyword_flag", ("members",), r"""
SELECT company_id, CASE WHEN regexp_matches(' ' || n || ' ', '[^a-z0-9_](c\.i\.c|trust|second hand|ruby|trading|trade|bank|holdings|gold)[^a-z0-9_]') THEN 1 ELSE 0 END AS flag, CASE n WHEN 'ruby trading ltd' THEN 'ruby,trading'
  WHEN 'smith bank holdings' THEN 'bank,holdings' WHEN 'gold second hand' THEN 'gold,second hand' WHEN 'c.i.c trust' THEN 'c.i.c,trust' ELSE '' END AS hits
FROM (SELECT company_id, lower(trim(trading_name_raw)) AS n FROM members)""")
def keyword_flag(spark, d):
    return members(spark, d).select("company_id", S.keyword_flag("trading_name_raw", KEYWORDS).alias("flag"),
                                    F.array_join(S.keyword_hits("trading_name_raw", KEYWORDS), ",").alias("hits"))


@query("text_basics", ("banks",), """
SELECT DISTINCT sortcode, upper(trim(bank_name)) AS bank, left(sortcode, 4) AS head, concat_ws('-', lower(trim(bank_name)), sortcode) AS label, replace(sortcode, '10', 'x') AS masked,
  CASE WHEN starts_with(trim(bank_name), 'G') THEN 1 ELSE 0 END AS starts_g, CASE WHEN contains(bank_name, 'et') THEN 1 ELSE 0 END AS has_et FROM banks""")
def text_basics(spark, d):
    name = F.trim("bank_name")
    return load(spark, d, "banks").select(
        "sortcode", F.upper(name).alias("bank"), F.left("sortcode", F.lit(4)).alias("head"), F.concat_ws("-", F.lower(name), "sortcode").alias("label"),
        F.replace("sortcode", F.lit("10"), F.lit("x")).alias("masked"), S.flag(F.startswith(name, F.lit("G"))).alias("starts_g"), S.flag(F.col("bank_name").contains("et")).alias("has_et")).distinct()


@query("url_parts", (), r"""
SELECT page_id, NULLIF(regexp_extract(url, 'https?://([^/]+)', 1), '') AS host, NULLIF(regexp_extract(url, '/([0-9]+)', 1), '') AS number, split_part(url, '://', 1) AS scheme,
  string_split(split_part(url, '?', 1), '/')[-1] AS tail, regexp_replace(url, '[0-9]', '', 'g') AS no_digits FROM pages""")
def url_parts(spark, d):
    return load(spark, d, "pages").select(
        "page_id", S.first_match("url", r"https?://([^/]+)", 1).alias("host"), S.first_match("url", "/([0-9]+)", 1).alias("number"), F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"),
        F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1).alias("tail"), S.drop_digits("url").alias("no_digits"))


@query("emails_in_text", (), r"SELECT doc_id, NULLIF(regexp_extract(text, '([A-Za-z0-9._-]+)@([A-Za-z0-9.-]+)', 2), '') AS host FROM documents")
def emails_in_text(spark, d):
    return load(spark, d, "documents").select("doc_id", S.first_match("text", "([A-Za-z0-9._-]+)@([A-Za-z0-9.-]+)", 2).alias("host"))


@query("date_functions", ("members",), """
SELECT company_id, CAST(date_diff('day', incorporated_on, created_on) AS BIGINT) AS days, CAST(year(created_on) - year(incorporated_on) AS BIGINT) AS years,
  ROUND(date_diff('day', incorporated_on, created_on) / 30.436875, 6) AS age_months, ROUND(date_diff('day', incorporated_on, created_on) / 365.2425, 6) AS age_years,
  CAST(CAST(floor(date_diff('day', incorporated_on, created_on) / 365.2425) AS BIGINT) AS BIGINT) AS whole_years, strftime(created_on, '%Y-%m') AS year_month,
  CAST(CAST(date_trunc('month', created_on) AS DATE) AS VARCHAR) AS month_start, CAST(CAST(created_on + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS later FROM members""")
def date_functions(spark, d):
    a, b = "incorporated_on", "created_on"
    return members(spark, d).select(
        "company_id", F.date_diff(b, a).cast("bigint").alias("days"), S.year_boundaries(a, b).cast("bigint").alias("years"), F.round(S.age_in_months(a, b), 6).alias("age_months"),
        F.round(S.age_in_years(a, b), 6).alias("age_years"), S.age_in_years(a, b).cast("bigint").alias("whole_years"), S.year_month(b).alias("year_month"),
        F.to_date(F.date_trunc("month", b)).cast("string").alias("month_start"), F.add_months(b, 3).cast("string").alias("later"))


@query("json_fields", (), "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def json_fields(spark, d):
    return load(spark, d, "events").select("event_id", S.json_text("props", "$.k").cast("bigint").alias("k"), S.json_text("props", "$.missing").alias("missing"))


@query("json_bad_input", ("decisions",), """
SELECT decision_id, CASE WHEN json_valid(data) THEN CAST(data AS JSON)->>'$.decision.risk_category' END AS category,
  CASE WHEN json_valid(data) THEN CAST(data AS JSON)->>'$.metadata.versions.risk_engine_version' END AS version FROM decisions""")
def json_bad_input(spark, d):
    return load(spark, d, "decisions").select("decision_id", S.json_text("data", "$.decision.risk_category").alias("category"),
                                              S.json_text("data", "$.metadata.versions.risk_engine_version").alias("version"))


@query("json_envelopes", ("members",), """
SELECT company_id, CASE WHEN COALESCE(trim(postcode_raw), '') = '' THEN NULL ELSE postcode_risk END AS value,
  '{"value":"' || company_icc || '"}' AS payload FROM members""")
def json_envelopes(spark, d):
    blank = F.coalesce(F.trim("postcode_raw"), F.lit("")) == ""
    wrapped = S.make_envelope({"postcode": F.col("postcode_raw")}, F.when(~blank, F.col("postcode_risk")), F.when(blank, F.lit("empty value")))
    m = members(spark, d).select("company_id", wrapped.alias("e"), F.to_json(F.struct(F.col("company_icc").alias("value"))).alias("payload"))
    return m.select("company_id", S.envelope_value("e").alias("value"), "payload")


@query("array_functions", ("members",), """
a AS (SELECT company_id, string_split(COALESCE(nationality_raw, 'null'), ' ') AS raw, applicant_nationality FROM members),
b AS (SELECT company_id, applicant_nationality, list_sort(list_distinct(list_filter(raw, lambda x: x NOT IN ('none', 'None', 'null')))) AS clean FROM a),
c AS (SELECT *, list_sort(list_distinct(list_concat(clean, [applicant_nationality]))) AS merged FROM b)
SELECT company_id, array_to_string(clean, ',') AS clean, array_to_string(merged, ',') AS merged, CASE WHEN list_has_any(merged, ['RO', 'IN']) THEN 1 ELSE 0 END AS listed, CAST(len(merged) AS BIGINT) AS n FROM c""")
def array_functions(spark, d):
    m = members(spark, d).select("company_id", "applicant_nationality", S.clean_array(F.split(F.coalesce("nationality_raw", F.lit("null")), " ")).alias("clean"))
    m = m.withColumn("merged", S.merge_nationalities("applicant_nationality", "clean"))
    return m.select("company_id", F.array_join("clean", ",").alias("clean"), F.array_join("merged", ",").alias("merged"),
                    S.flag(F.arrays_overlap("merged", F.array(F.lit("RO"), F.lit("IN")))).alias("listed"), F.size("merged").cast("bigint").alias("n"))


@query("null_functions", ("members",), "SELECT company_id, COALESCE(device_raw, first_name, 'none') AS first_known, NULLIF(first_name, '') AS name_or_null, COALESCE(NULLIF(company_type_raw, 'null'), 'missing') AS kind FROM members")
def null_functions(spark, d):
    return members(spark, d).select("company_id", F.coalesce("device_raw", "first_name", F.lit("none")).alias("first_known"), F.nullif("first_name", F.lit("")).alias("name_or_null"),
                                    F.coalesce(F.nullif("company_type_raw", F.lit("null")), F.lit("missing")).alias("kind"))


@query("math_functions", ("members",), """
SELECT company_id, ROUND(ln(score + 1), 6) AS log_score, ROUND(exp(-score / 1000), 6) AS decay, ROUND(sqrt(score), 6) AS root, CAST(ceil(score / 7) AS BIGINT) AS up, CAST(abs(500 - score) AS BIGINT) AS gap,
  round_even(score / 2, 0) AS half_even FROM members""")
def math_functions(spark, d):
    s = F.col("score")
    return members(spark, d).select("company_id", F.round(F.log(s + 1), 6).alias("log_score"), F.round(F.exp(-s / 1000), 6).alias("decay"), F.round(F.sqrt(s), 6).alias("root"),
                                    F.ceil(s / 7).cast("bigint").alias("up"), F.abs(500 - s).cast("bigint").alias("gap"), F.bround(s / 2, 0).alias("half_even"))


@query("name_mismatch", (), """
p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
t AS (SELECT *, list_sort(list_distinct(string_split(x, ' '))) AS tx, list_sort(list_distinct(string_split(y, ' '))) AS ty FROM p)
SELECT p_partkey, CASE WHEN list_has_any(tx, ty) OR contains(array_to_string(tx, ' '), array_to_string(ty, ' ')) OR contains(array_to_string(ty, ' '), array_to_string(tx, ' ')) THEN 0 ELSE 1 END AS mismatch FROM t""")
def name_mismatch(spark, d):
    p = load(spark, d, "part")
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(following, "p_partkey").select("p_partkey", S.name_mismatch("p_name", "other").alias("mismatch"))


@query("name_similarity", ())
def name_similarity(spark, d):
    from gatewise.functions.similarity import add_similarity
    p = load(spark, d, "part")
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    scored = add_similarity(p.join(following, "p_partkey"), F.col("p_name"), F.col("other"), "similarity")
    return scored.select("p_partkey", F.round("similarity", 4).alias("similarity"))


@query("declared_against_scanned_names", ())
def declared_against_scanned_names(spark, d):
    from gatewise.operators.labels import applicant_names
    names = applicant_names(load(spark, d, "app_events"), "2024-01-01", "2024-01-31", ["membership-completed", "calculate-risk"])
    return names.select("company_id", S.name_mismatch("full_name", "id_full_name").alias("mismatch"))


@query("gaussian_noise", ())
def gaussian_noise(spark, d):
    from gatewise.operators.encoders import add_noise
    return add_noise(members(spark, d).select("company_id", "score", "data_type"), "score", F.col("data_type") == "train", 0.5, 11, "company_id")


@query("parameterised_query", (), "SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30' GROUP BY 1")
def parameterised_query(spark, d):
    return run_query(spark, "SELECT o_orderpriority, COUNT(*) AS n FROM {o} WHERE o_orderdate BETWEEN CAST(:from_date AS TIMESTAMP_NTZ) AND CAST(:to_date AS TIMESTAMP_NTZ) GROUP BY 1",
                     {"from_date": "1996-01-01", "to_date": "1997-06-30"}, o=load(spark, d, "orders"))


@query("time_bounded_read", (), "SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def time_bounded_read(spark, d):
    import datetime
    e = between_times(load(spark, d, "events"), "ts", datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("normalised_names", (), "SELECT c_custkey AS member, c_acctbal AS balance FROM customer")
def normalised_names(spark, d):
    raw = load(spark, d, "customer").select(F.col("c_custkey").alias("fs.MEMBER"), F.col("c_acctbal").alias("service__Balance"))
    return require_columns(normalise_names(raw), ["member", "balance"])


@query("drop_inconsistent_fraud_rows", ("members",), "SELECT company_id, COALESCE(days_to_app_fraud, 9999) AS days FROM members WHERE app_fraud_amount >= 0 AND COALESCE(days_to_app_fraud, 9999) >= 0 AND icc_raw IS NOT NULL")
def drop_inconsistent_fraud_rows(spark, d):
    m = members(spark, d).fillna({"days_to_app_fraud": 9999}).filter((F.col("app_fraud_amount") >= 0) & (F.col("days_to_app_fraud") >= 0))
    return m.dropna(subset=["icc_raw"]).select("company_id", F.col("days_to_app_fraud").alias("days"))


@query("period_filter", ("members",), """
SELECT CASE WHEN created_on <= DATE '1997-06-30' THEN 'first' WHEN created_on <= DATE '1998-12-31' THEN 'second' ELSE 'later' END AS period, CAST(COUNT(*) AS BIGINT) AS n,
  ROUND(AVG(is_app_fraud), 6) AS rate FROM members WHERE is_approved = 1 AND strftime(created_on, '%Y-%m') NOT IN ('1995-01', '1995-02') GROUP BY 1""")
def period_filter(spark, d):
    day = F.col("created_on")
    period = F.when(day <= "1997-06-30", "first").when(day <= "1998-12-31", "second").otherwise("later")
    kept = members(spark, d).filter((F.col("is_approved") == 1) & ~S.year_month("created_on").isin("1995-01", "1995-02"))
    return kept.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("is_app_fraud"), 6).alias("rate"))
