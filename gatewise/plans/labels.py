"""Registered label queries and the flagship cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import labels as L
from gatewise.plans.registry import query
from gatewise.sources.standins import REFERENCE_COLUMNS, load

FROM, TO = "2023-03-01", "2023-12-31"
EVENT_TYPES = ["membership-completed", "calculate-risk"]


def _in(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_MAP = "kinds(fraud_type, main_category) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in L.MAIN_CATEGORY.items()) + ")"

_PARSED = """
parsed AS (
  SELECT decision_id, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS j FROM decisions),
typed AS (
  SELECT CAST(j->>'$.identity.membership_id' AS BIGINT) AS member_id, CAST(j->>'$.metadata.created_at' AS DATE) AS created_at, decision_id,
         j->>'$.decision.risk_category' AS risk_category, j->>'$.decision.final_decision' AS final_decision,
         j->>'$.decision.failed_business_rules' AS failed_business_rules
  FROM parsed WHERE j IS NOT NULL)"""


def _latest(low: str, high: str) -> str:
    return _PARSED + f""",
latest AS (
  SELECT *, CASE WHEN failed_business_rules IN ({_in(L.AUTOMATIC_RULE_LISTS)}) THEN 'approved' ELSE 'mkyc' END AS rules_engine_decision
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY created_at DESC, decision_id DESC) AS rn FROM typed
        WHERE created_at BETWEEN DATE '{low}' AND DATE '{high}') WHERE rn = 1)"""


_OPEN = f"project_key = 'RCM' AND is_subtask <> 1 AND status NOT IN ({_in(L.DUPLICATE_STATUSES)})"
_CLASSED = _MAP + f""",
classed AS (
  SELECT DISTINCT ticket_key, ticket_id, company_id, CASE WHEN report_link IS NOT NULL THEN 'Bank' ELSE reported_by END AS reported_by,
    COALESCE(k.main_category, fraud_category) AS app_fraud_type,
    COALESCE(app_fraud, CASE WHEN COALESCE(k.main_category, fraud_category) IN (SELECT main_category FROM kinds) THEN 'Yes' ELSE 'No' END) AS is_app,
    NULLIF(regexp_extract(report_link, 'https.*/event/([a-z0-9]+)', 1), '') AS link_id,
    NULLIF(regexp_extract(description, 'https.*/event/([a-z0-9]+)', 1), '') AS text_id, created_at
  FROM tickets LEFT JOIN kinds k USING (fraud_type)
  WHERE {_OPEN} AND year(created_at) >= 2022 AND COALESCE(fraud_type, fraud_category) IS NOT NULL)"""
_COUNTED = f"""
counted AS (
  SELECT ticket_key, company_id, t.ticket_id, reported_by, COALESCE(k.main_category, t.fraud_type) AS app_fraud_type,
    CASE WHEN t.fraud_type IN ({_in(L.REPORTED_TYPES)}) THEN 'Yes' ELSE 'No' END AS is_app, MIN(COALESCE(c.change_at, t.created_at)) AS reported_at
  FROM tickets t LEFT JOIN kinds k ON t.fraud_type = k.fraud_type
  LEFT JOIN ticket_changes c ON t.ticket_id = c.ticket_id AND c.change_field = 'Number of fraud reports'
  WHERE {_OPEN} AND fraud_report_count IS NOT NULL AND CAST(COALESCE(c.change_at, t.created_at) AS DATE) >= DATE '2022-01-01'
  GROUP BY ALL)"""
_REPORTED = """
reported AS (
  SELECT a.*, CAST(COALESCE(b.created_at, c.created_at, a.created_at) AS DATE) AS reported_date
  FROM classed a LEFT JOIN chats b ON a.link_id = b.ticket_id LEFT JOIN chats c ON a.text_id = c.ticket_id)"""
_REFS = "refs AS (SELECT DISTINCT ticket_key, regexp_replace(raw, '[\\s,\"]', '', 'g') AS txn_ref FROM (" + " UNION ALL ".join(
    f"SELECT ticket_key, {c} AS raw FROM tickets" for c in REFERENCE_COLUMNS) + ") WHERE raw IS NOT NULL)"
_LINKED = f"""
linked AS (
  SELECT DISTINCT a.company_id, COALESCE(a.parent_key, a.ticket_key) AS ticket_key, a.created_at AS ticket_created_at, b.txn_ref, b.account_name,
    LEFT(b.account_identification, 6) AS sort_code, b.transaction_at, b.amount
  FROM tickets a JOIN refs t ON a.ticket_key = t.ticket_key JOIN cleared_txns b ON t.txn_ref = b.txn_ref
  JOIN realtime_txns rt ON b.txn_ref = rt.transaction_reference AND rt.status = 'CLEARED'
  WHERE a.project_key = 'RCM' AND b.transaction_type IN ({_in(L.INBOUND_TYPES)}) AND b.local_instrument <> '{L.FOREIGN_INSTRUMENT}')"""
_NEWEST = """
newest AS (
  SELECT * FROM (
    SELECT t.*, r.app_fraud_type, r.is_app, r.reported_date, ROW_NUMBER() OVER (PARTITION BY t.txn_ref
      ORDER BY t.ticket_created_at DESC, t.ticket_key DESC, r.is_app DESC, r.app_fraud_type DESC NULLS LAST, r.reported_date DESC) AS rn
    FROM linked t JOIN (SELECT ticket_key, app_fraud_type, is_app, reported_date FROM reported
                        UNION SELECT ticket_key, app_fraud_type, is_app, CAST(reported_at AS DATE) FROM counted) r ON t.ticket_key = r.ticket_key)
  WHERE rn = 1)"""
_DAYS = """
spans AS (
  SELECT DISTINCT a.company_id, a.txn_ref, a.transaction_at, a.app_fraud_type, a.amount,
    date_diff('day', m.approved_at, CAST(a.transaction_at AS DATE)) AS days_to_fraud, date_diff('day', CAST(a.transaction_at AS DATE), m.rejected_at) AS days_to_reject
  FROM newest a LEFT JOIN companies c ON a.company_id = c.company_id LEFT JOIN memberships m ON c.member_id = m.member_id WHERE a.is_app = 'Yes')"""
_TICKET_TABLES = ("tickets", "ticket_changes", "chats", "cleared_txns", "realtime_txns")
_CHAIN = ",".join([_CLASSED, _COUNTED, _REPORTED, _REFS, _LINKED, _NEWEST])
_COHORT = f"""m.is_completed = 1 AND COALESCE(m.approved_at, c.created_at) <= DATE '{TO}' AND (c.created_at BETWEEN DATE '{FROM}' AND DATE '{TO}'
    OR (m.approved_at BETWEEN DATE '{FROM}' AND DATE '{TO}' AND m.approved_at BETWEEN c.created_at AND c.created_at + INTERVAL 3 MONTH))"""


def _tables(spark, d, *names):
    return {n: load(spark, d, n) for n in names}


def _newest(spark, d):
    t = _tables(spark, d, *_TICKET_TABLES)
    reports = L.conversation_report_date(L.classify_tickets(t["tickets"]), t["chats"])
    linked = L.ticket_transactions(t["tickets"], L.references_to_rows(t["tickets"], REFERENCE_COLUMNS), t["cleared_txns"], t["realtime_txns"])
    return L.newest_per_transaction(linked, reports, L.earliest_report(t["tickets"], t["ticket_changes"]))


@query("label_cohort", ("decisions", "memberships", "companies", *_TICKET_TABLES), _CHAIN + "," + _DAYS + "," + _latest("2022-12-01", TO) + f"""
SELECT m.member_id, c.company_id, CAST(c.created_at AS VARCHAR) AS created_at, d.risk_category, d.failed_business_rules, d.rules_engine_decision,
  d.final_decision, CAST(m.approved_at AS VARCHAR) AS approved_at, CASE WHEN m.approved_at IS NOT NULL THEN 1 ELSE 0 END AS is_approved,
  MAX(CASE WHEN s.days_to_fraud BETWEEN 0 AND 180 THEN 1 ELSE 0 END) AS is_app_fraud, CAST(MIN(s.days_to_fraud) AS DOUBLE) AS days_to_app_fraud,
  CAST(MIN(s.days_to_reject) AS DOUBLE) AS days_fraud_to_reject,
  ROUND(SUM(CASE WHEN s.days_to_fraud BETWEEN 0 AND 180 THEN s.amount ELSE 0 END), 2) AS app_fraud_amount,
  string_agg(DISTINCT CASE WHEN s.days_to_fraud BETWEEN 0 AND 180 THEN s.app_fraud_type END, ',' ORDER BY
    CASE WHEN s.days_to_fraud BETWEEN 0 AND 180 THEN s.app_fraud_type END) AS app_fraud_type
FROM companies c JOIN memberships m ON c.member_id = m.member_id JOIN latest d ON d.member_id = m.member_id LEFT JOIN spans s ON s.company_id = c.company_id
WHERE {_COHORT} GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""")
def label_cohort(spark, d):
    t = _tables(spark, d, "decisions", "memberships", "companies", *_TICKET_TABLES)
    out = L.label_cohort(t, REFERENCE_COLUMNS, FROM, TO)
    return out.withColumns({"created_at": F.col("created_at").cast("string"), "approved_at": F.col("approved_at").cast("string"),
                            "days_to_app_fraud": F.col("days_to_app_fraud").cast("double"),
                            "days_fraud_to_reject": F.col("days_fraud_to_reject").cast("double"),
                            "app_fraud_amount": F.round("app_fraud_amount", 2)})


@query("fraud_rate_by_industry", ("applications",), """
SELECT industry, CAST(COUNT(*) AS BIGINT) AS applicants, CAST(SUM(is_app_fraud) AS BIGINT) AS frauds, ROUND(AVG(is_app_fraud), 6) AS fraud_rate,
  ROUND(SUM(app_fraud_amount), 2) AS amount, ROUND(AVG(app_fraud_amount), 4) AS mean_amount FROM applications WHERE is_approved = 1 GROUP BY industry""")
def fraud_rate_by_industry(spark, d):
    return (load(spark, d, "applications").filter("is_approved = 1").groupBy("industry").agg(
        F.count("*").alias("applicants"), F.sum("is_app_fraud").alias("frauds"), F.round(F.avg("is_app_fraud"), 6).alias("fraud_rate"),
        F.round(F.sum("app_fraud_amount"), 2).alias("amount"), F.round(F.avg("app_fraud_amount"), 4).alias("mean_amount")))


@query("latest_decision", ("decisions",), _latest("2022-12-01", TO) + """
SELECT member_id, decision_id, CAST(created_at AS VARCHAR) AS created_at, risk_category, final_decision, failed_business_rules, rules_engine_decision FROM latest""")
def latest_decision(spark, d):
    return L.latest_decision(load(spark, d, "decisions"), "2022-12-01", TO).select(
        "member_id", "decision_id", F.col("created_at").cast("string").alias("created_at"), "risk_category", "final_decision",
        "failed_business_rules", "rules_engine_decision")


@query("ticket_classes", ("tickets",), _CLASSED + """
SELECT ticket_key, ticket_id, company_id, reported_by, app_fraud_type, is_app, link_id, text_id FROM classed""")
def ticket_classes(spark, d):
    return L.classify_tickets(load(spark, d, "tickets")).drop("created_at")


@query("ticket_reported_dates", ("tickets", "ticket_changes"), _MAP + "," + _COUNTED + """
SELECT ticket_key, company_id, ticket_id, reported_by, app_fraud_type, is_app, CAST(CAST(reported_at AS DATE) AS VARCHAR) AS reported_on FROM counted""")
def ticket_reported_dates(spark, d):
    out = L.earliest_report(load(spark, d, "tickets"), load(spark, d, "ticket_changes"))
    return out.withColumn("reported_on", F.to_date("reported_at").cast("string")).drop("reported_at")


@query("conversation_reported_date", ("tickets", "chats"), _CLASSED + "," + _REPORTED + """
SELECT ticket_key, CAST(reported_date AS VARCHAR) AS reported_date FROM reported""")
def conversation_reported_date(spark, d):
    out = L.conversation_report_date(L.classify_tickets(load(spark, d, "tickets")), load(spark, d, "chats"))
    return out.select("ticket_key", F.col("reported_date").cast("string").alias("reported_date"))


@query("ref_columns_to_rows", ("tickets",), _REFS + " SELECT ticket_key, txn_ref FROM refs")
def ref_columns_to_rows(spark, d):
    return L.references_to_rows(load(spark, d, "tickets"), REFERENCE_COLUMNS)


@query("wide_line_items_to_rows", (), "SELECT DISTINCT l_orderkey, l_partkey AS part FROM lineitem WHERE l_partkey IS NOT NULL")
def wide_line_items_to_rows(spark, d):
    # seven slots a row; a slot is a list, so later lines and repeated ones lose nothing
    slot = F.coalesce(F.pmod(F.col("l_linenumber"), F.lit(7)), F.lit(0))
    wide = load(spark, d, "lineitem").withColumn("slot", slot).groupBy("l_orderkey").pivot("slot", list(range(7))).agg(F.collect_set("l_partkey"))
    slots = [str(i) for i in range(7)]
    return wide.unpivot("l_orderkey", slots, "slot", "parts").select("l_orderkey", F.explode("parts").alias("part")).distinct()


@query("ticket_transactions", ("tickets", "cleared_txns", "realtime_txns"), _REFS + "," + _LINKED + """
SELECT company_id, ticket_key, txn_ref, account_name, sort_code, ROUND(amount, 4) AS amount FROM linked""")
def ticket_transactions(spark, d):
    t = _tables(spark, d, "tickets", "cleared_txns", "realtime_txns")
    out = L.ticket_transactions(t["tickets"], L.references_to_rows(t["tickets"], REFERENCE_COLUMNS), t["cleared_txns"], t["realtime_txns"])
    return out.select("company_id", "ticket_key", "txn_ref", "account_name", "sort_code", F.round("amount", 4).alias("amount"))


@query("newest_per_txn", _TICKET_TABLES, _CHAIN + """
SELECT txn_ref, ticket_key, company_id, app_fraud_type, is_app, CAST(reported_date AS VARCHAR) AS reported_date FROM newest""")
def newest_per_txn(spark, d):
    return _newest(spark, d).select("txn_ref", "ticket_key", "company_id", "app_fraud_type", "is_app", F.col("reported_date").cast("string").alias("reported_date"))


@query("days_between_events", ("companies", "memberships", *_TICKET_TABLES), _CHAIN + "," + _DAYS + """
SELECT company_id, txn_ref, app_fraud_type, ROUND(amount, 4) AS amount, CAST(days_to_fraud AS DOUBLE) AS days_to_fraud,
  CAST(days_to_reject AS DOUBLE) AS days_to_reject FROM spans""")
def days_between_events(spark, d):
    out = L.fraud_days(_newest(spark, d).filter("is_app = 'Yes'"), load(spark, d, "companies"), load(spark, d, "memberships"))
    return out.select("company_id", "txn_ref", "app_fraud_type", F.round("amount", 4).alias("amount"),
                      F.col("days_to_fraud").cast("double").alias("days_to_fraud"), F.col("days_to_reject").cast("double").alias("days_to_reject"))


@query("first_status_date", ("tickets", "ticket_changes", "companies", "memberships"), f"""
first_change AS (
  SELECT CAST(regexp_extract(trim(t.summary), '[0-9]{{4,}}') AS BIGINT) - 10000 AS company_id, CAST(date_trunc('day', MIN(c.change_at)) AS DATE) AS at
  FROM tickets t JOIN ticket_changes c ON t.ticket_id = c.ticket_id
  WHERE t.project_key = 'RCM' AND trim(t.issue_type) IN ({_in(L.ACTIVITY_ISSUES)}) AND (t.status IS NULL OR t.status <> 'Duplicates')
    AND (t.is_subtask <> 1 OR t.is_subtask IS NULL) AND c.new_value IN ({_in(L.ACTIVITY_STATES)}) AND regexp_extract(trim(t.summary), '[0-9]{{4,}}') <> ''
  GROUP BY 1)
SELECT c.company_id, c.member_id, MAX(CASE WHEN date_diff('day', m.approved_at, a.at) <= 90 THEN 1 ELSE 0 END) AS activity_label
FROM first_change a JOIN companies c USING (company_id) JOIN memberships m ON c.member_id = m.member_id WHERE m.is_completed = 1 GROUP BY 1, 2""")
def first_status_date(spark, d):
    t = _tables(spark, d, "tickets", "ticket_changes", "companies", "memberships")
    return L.activity_label(t["tickets"], t["ticket_changes"], t["companies"], t["memberships"])


@query("decision_rules", ("decisions", "memberships", "companies"), _latest("2022-12-01", "2023-06-30") + """
SELECT DISTINCT c.company_id, a.risk_category, a.final_decision, a.failed_business_rules
FROM latest a LEFT JOIN memberships m ON a.member_id = m.member_id LEFT JOIN companies c ON a.member_id = c.member_id WHERE m.is_completed = 1""")
def decision_rules(spark, d):
    return L.decision_rules(load(spark, d, "decisions"), load(spark, d, "memberships"), load(spark, d, "companies"), "2022-12-01", "2023-06-30")


@query("member_attributes", ("company_versions", "memberships", "id_scans", "users"), f"""
company AS (
  SELECT * FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.company_id ORDER BY c.created_at DESC, c.version_id DESC, c.is_accounts_overdue DESC,
    c.accounts_next_due_at DESC, c.company_status DESC) AS rn FROM company_versions c JOIN memberships m ON c.member_id = m.member_id WHERE {_COHORT}) WHERE rn = 1),
scan AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM id_scans
    WHERE verification_type IN ('ID_SCAN', 'ID_SCAN_VALIDATIONS') AND verification_usage IN ('REGISTRATION', 'ACCOUNT_RECOVERY')) WHERE rn = 1),
born AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY created_at, date_of_birth) AS rn FROM users) WHERE rn = 1)
SELECT c.company_id, CAST(c.created_at AS VARCHAR) AS created_at, c.company_status, CAST(c.is_accounts_overdue AS BIGINT) AS overdue,
  s.id_first_name, s.id_last_name, CAST(b.date_of_birth AS VARCHAR) AS date_of_birth,
  CAST(year(s.id_expiry_at) - year(c.created_at) AS DOUBLE) AS years_to_id_expiry
FROM company c LEFT JOIN scan s ON c.member_id = s.member_id LEFT JOIN born b ON c.member_id = b.member_id""")
def member_attributes(spark, d):
    t = _tables(spark, d, "company_versions", "memberships", "id_scans", "users")
    out = L.member_attributes(t["company_versions"], t["memberships"], t["id_scans"], t["users"], FROM, TO)
    return out.select("company_id", F.col("created_at").cast("string").alias("created_at"), "company_status",
                      F.col("is_accounts_overdue").cast("bigint").alias("overdue"), "id_first_name", "id_last_name",
                      F.col("date_of_birth").cast("string").alias("date_of_birth"), F.col("years_to_id_expiry").cast("double").alias("years_to_id_expiry"))


@query("registry_match", ("companies", "memberships", "registry_docs"), f"""
docs AS (SELECT CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS j FROM registry_docs),
typed AS (
  SELECT j->>'$.data.companyNumber' AS registry_number, CAST(j->>'$.metadata.created_at' AS DATE) AS registry_created_at,
    j->>'$.data.address.postcode' AS company_postcode, CAST(j->>'$.data.numberOfEmployees' AS BIGINT) AS employees, j->>'$.data.status' AS registry_status,
    j->>'$.data.directorsTree' AS directors, j->>'$.data.structureLevelWise."1"' AS structure_level, j->>'$.data.incorporationDate' AS incorporation_date
  FROM docs WHERE j IS NOT NULL),
earliest AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY registry_number ORDER BY registry_created_at, company_postcode, employees, registry_status, directors) AS rn
    FROM typed) WHERE rn = 1)
SELECT c.company_id, c.registry_number, CASE WHEN e.registry_number IS NOT NULL THEN 1 ELSE 0 END AS registry_hit, e.company_postcode,
  CAST(e.employees AS DOUBLE) AS employees, e.registry_status, e.structure_level, e.incorporation_date, CAST(e.registry_created_at AS VARCHAR) AS registry_created_at
FROM companies c JOIN memberships m ON c.member_id = m.member_id AND m.is_completed = 1 LEFT JOIN earliest e ON c.registry_number = e.registry_number
WHERE c.created_at BETWEEN DATE '{FROM}' AND DATE '{TO}'""")
def registry_match(spark, d):
    out = L.registry_match(load(spark, d, "companies"), load(spark, d, "memberships"), load(spark, d, "registry_docs"), FROM, TO)
    return out.select("company_id", "registry_number", "registry_hit", "company_postcode", F.col("employees").cast("double").alias("employees"),
                      "registry_status", "structure_level", "incorporation_date", F.col("registry_created_at").cast("string").alias("registry_created_at"))


@query("applicant_names", ("app_events",), f"""
latest AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY ts DESC, event_id DESC) AS rn FROM app_events
    WHERE event_type IN ({_in(EVENT_TYPES)}) AND CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-30') WHERE rn = 1)
SELECT company_id, concat_ws(' ', lower(COALESCE(payload->>'$.applicant.firstName', '')), lower(COALESCE(payload->>'$.applicant.middleName', '')),
    lower(COALESCE(payload->>'$.applicant.lastName', ''))) AS full_name,
  concat_ws(' ', lower(COALESCE(payload->>'$.applicant.idScan.firstName', '')), lower(COALESCE(payload->>'$.applicant.idScan.middleName', '')),
    lower(COALESCE(payload->>'$.applicant.idScan.lastName', ''))) AS id_full_name FROM latest""")
def applicant_names(spark, d):
    return L.applicant_names(load(spark, d, "app_events"), "2024-01-02", "2024-01-30", EVENT_TYPES)


@query("existing_customer", ("companies", "memberships", "users", "person_links", "individuals", "businesses"), f"""
owned AS (
  SELECT i.user_id, COUNT(DISTINCT b.legacy_id) - 1 AS other_companies FROM person_links r JOIN individuals i ON r.entity_id = i.id
  JOIN businesses b ON r.entity_dest_id = b.id WHERE i.created_on <= b.created_on AND i.user_id IS NOT NULL GROUP BY 1)
SELECT c.company_id, MAX(CASE WHEN o.other_companies > 0 THEN 1 ELSE 0 END) AS is_existing_user
FROM companies c JOIN memberships m ON c.member_id = m.member_id LEFT JOIN users u ON c.member_id = u.member_id LEFT JOIN owned o ON u.user_id = o.user_id
WHERE m.is_completed = 1 AND c.created_at BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY 1""")
def existing_customer(spark, d):
    t = _tables(spark, d, "companies", "memberships", "users", "person_links", "individuals", "businesses")
    return L.existing_customer(t["companies"], t["memberships"], t["users"], t["person_links"], t["individuals"], t["businesses"], FROM, TO)
