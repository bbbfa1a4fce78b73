"""Fixture tables in the shape of onboarding sources, derived row by row from the driver tables.

Each definition is one SELECT in SQL that both Spark and DuckDB read, so a query and its oracle start from the same rows.
They scan whole tables and grow with them. Nothing here is real data: codes, names and postcodes are invented samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
               "pages", "benchmark", "labels", "conversations"]


@dataclass(frozen=True)
class Dialect:
    """The few spellings in which the two engines differ."""

    name: str

    def days(self, start: str, end: str) -> str:
        return f"datediff({end}, {start})" if self.name == "spark" else f"date_diff('day', {start}, {end})"

    def add_days(self, start: str, days: str) -> str:
        return f"date_add({start}, CAST({days} AS INT))" if self.name == "spark" else f"CAST({start} + CAST({days} AS INTEGER) AS DATE)"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def pick(key: str, values: list[str | None]) -> str:
    """Choose a literal by key modulo the list length."""
    def text(v: str | None) -> str:
        return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE ({key}) % {len(values)} {arms} ELSE {text(values[-1])} END"


def pick_number(key: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE ({key}) % {len(values)} {arms} ELSE {values[-1]} END"


# Sample categories of the fixture.
ID_TYPES = ["National_ID", "Passport", "Driving_Licence", "Other_ID", "Provisional_Licence", "Residence_Permit", "Undefined"]
INDUSTRIES = ["category.construction", "category.builder", "category.cleaner", "category.transport_and_storage",
              "category.web_design", "category.domestic_cleaner", "category.tour_guide", "category.animal_breeder",
              "category.household_cleaning_services"]
COUNTRIES = ["GB", "RO", "IN", "PT", "SK", "PK", "FR", "US", "NG", "PL", "BG"]
RISKS = ["High", "Medium", "Low", "Undefined"]
STATUSES = ["Active", "Liquidation", "Dissolved", "Undefined", "Active", "Active"]


def _applications(d: Dialect) -> str:
    return f"""
SELECT o.o_orderkey AS company_id, o.o_custkey AS member_id, CAST(o.o_orderdate AS DATE) AS created_on,
  CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_approved,
  o.o_orderpriority AS id_type, c.c_mktsegment AS industry, n.n_name AS id_country, r.r_name AS region,
  c.c_acctbal AS balance, o.o_totalprice AS declared_amount,
  CASE WHEN f.company_id IS NOT NULL THEN 1 ELSE 0 END AS is_app_fraud,
  ROUND(COALESCE(f.app_fraud_amount, 0), 2) AS app_fraud_amount, f.days_to_app_fraud,
  CAST(FLOOR(o.o_totalprice) AS BIGINT) % 1001 AS score,
  CASE WHEN o.o_orderdate < TIMESTAMP '1999-01-01' THEN 'train'
       WHEN o.o_orderdate < TIMESTAMP '2000-01-01' THEN 'test' ELSE 'val' END AS data_type
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (
  SELECT l.l_orderkey AS company_id, CAST(MIN({d.days('o2.o_orderdate', 'l.l_shipdate')}) AS BIGINT) AS days_to_app_fraud,
         SUM(l.l_extendedprice) AS app_fraud_amount
  FROM {{lineitem}} l JOIN {{orders}} o2 ON l.l_orderkey = o2.o_orderkey
  WHERE l.l_returnflag = 'R' AND {d.days('o2.o_orderdate', 'l.l_shipdate')} BETWEEN 0 AND 180
  GROUP BY l.l_orderkey) f ON o.o_orderkey = f.company_id"""


def _members(d: Dialect) -> str:
    k = "company_id"
    return f"""
SELECT company_id, member_id, created_on, is_approved, is_app_fraud, app_fraud_amount, days_to_app_fraud, score, data_type,
  industry, id_country, region, balance, declared_amount,
  {pick(k, ['GB', 'RO', 'PT', 'RUS', 'UA', 'BLR', 'FRO', 'gb', '', None, 'XX', 'IND'])} AS idcountry_raw,
  {pick(k + ' * 5 + 1', ['GB', 'RO GB', 'null', None, 'IN PK', 'XX', 'PRT'])} AS nationality_raw,
  {pick(k + ' * 3 + 2', ['WC2H 9JQ', 'HP13', 'A', None, '  ', 'E1 6AN', 'B33 8TH', 'M34 5AB', 'G21 3AA', 'IP1 2AB', 'CV47AL'])} AS postcode_raw,
  {pick(k + ' * 7', ['user', 'name', 'info', 'ann.lee'])} || CASE WHEN {k} % 3 = 0 THEN CAST({k} AS STRING) ELSE '' END
    || {pick(k + ' * 11', ['@gmail.com', '@outlook.com', '@firm.co.uk', '@x#yahoo.com', '@icloud.com', '@hotmail.com'])} AS email_raw,
  {pick(k, ['iOS 16', 'Android', None, 'web'])} AS device_raw,
  {pick(k, ['PASSPORT', 'ID_CARD', 'DRIVING_LICENSE', 'DRIVING_LICENSE', 'OTHER'])} AS id_type_raw,
  {pick(k, ['LEARNING_DRIVING_LICENSE', 'RESIDENT_PERMIT_ID', None, 'none'])} AS id_subtype_raw,
  {pick(k, ['Ann', 'Bob', None, 'Cy', '', 'Dee', 'Eva'])} AS first_name,
  {pick(k + ' * 3', ['Lee', 'Ray', None, 'Fox', 'Kim'])} AS last_name,
  {pick(k, ['59111, 96090', '64191', None, 'nan', ' 74201 ,, 74202', '62012'])} AS sic_raw,
  {pick(k, [' Category.Construction ', 'category.builder', 'category.cleaner', 'category.animal_breeder', 'category.transport_and_storage',
            'category.bank_(the_business_you_own_is_a_bank)', 'category.web_design', None, 'category.domestic_cleaner'])} AS icc_raw,
  {pick(k, ['LTD', 'null', None, 'PLC', 'LLP'])} AS company_type_raw,
  {k} % 2 AS is_registered,
  {pick(k, ['Ruby Trading Ltd', 'Smith Bank Holdings', 'Gold Second Hand', 'Oak Labs', 'Sunny Bankers', 'c.i.c trust', 'Plain Name', 'trademark studio'])} AS trading_name_raw,
  {d.add_days('created_on', f'-({k} % 2000)')} AS incorporated_on,
  {pick(k, ['BL001,applicant_pep', 'applicant_address_fail', 'idscan_mismatch, missing_sic_codes', 'sanction_fail', '', None,
            'missing_shareholder,bl008,applicant_address_fail'])} AS triggers_raw,
  CAST(18 + ({k} * 7) % 50 AS INT) AS age_at_completion,
  CAST(({k} * 5) % 48 AS INT) AS company_age_months,
  CAST(({k} * 3) % 14 - 2 AS INT) AS years_to_id_expiry,
  CAST(20 + ({k} * 11) % 40 AS INT) AS directors_avg_age,
  CASE WHEN {k} % 4 = 0 THEN 1 ELSE 0 END AS identity_address_fail,
  CASE WHEN {k} % 6 = 1 THEN 1 ELSE 0 END AS internal_check_fail,
  CASE WHEN {k} % 10 = 2 THEN 1 ELSE 0 END AS sanctions_fail,
  CASE WHEN {k} % 5 = 0 THEN 1 ELSE 0 END AS keyword_present,
  CASE WHEN ({k} * 7) % 3 = 0 THEN 1 ELSE 0 END AS email_numeric,
  CAST({k} % 5 AS INT) AS failed_rules,
  {pick(k + ' * 3 + 1', ID_TYPES)} AS applicant_id_type,
  {pick(k + ' * 7 + 2', INDUSTRIES)} AS company_icc,
  {pick(k + ' * 5 + 3', COUNTRIES)} AS applicant_country,
  {pick(k + ' * 13 + 1', COUNTRIES)} AS applicant_nationality,
  {pick(k + ' * 3', RISKS)} AS country_risk,
  {pick(k + ' * 5', RISKS)} AS postcode_risk,
  {pick(k + ' * 11', ['B', 'E', 'M', 'CV', 'WC', 'N', 'LS', 'SE', 'HP'])} AS postcode_area,
  {pick(k, STATUSES)} AS company_status,
  {pick(k, ['sole-trader', 'ltd', 'plc'])} AS company_type,
  {pick(k + ' * 7 + 3', ['gmail.com', 'outlook.com', 'other', 'yahoo.com'])} AS email_domain,
  {pick(k + ' * 5', ['1', '2', '3+', 'Undefined'])} AS structure_level
FROM applications"""


def _decisions(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""
SELECT {k} AS decision_id, CASE WHEN {k} % 97 = 5 THEN 'not json' ELSE
  '{{{{"identity":{{{{"membership_id":"' || CAST(o_custkey AS STRING) || '"}}}},"metadata":{{{{"created_at":"' ||
  CAST({d.add_days("DATE '2022-11-01'", f'({k} * 13) % 420')} AS STRING) || '","versions":{{{{"risk_engine_version":"v' || CAST({k} % 3 AS STRING) ||
  '"}}}}}}}},"decision":{{{{"risk_category":"' || {pick(k, ['High', 'Medium', 'Low'])} || '","final_decision":"' ||
  {pick(k + ' * 5', ['approved', 'manual', 'rejected'])} || '","risk_rating":' || CAST({k} % 1000 AS STRING) || ',"failed_business_rules":' ||
  {pick(k, ['["ORE_RISK_RATING"]', '[]', '["BL001","PEP"]', '["RC_RULE"]'])} || '}}}}}}}}' END AS data
FROM {{orders}}"""


def _memberships(d: Dialect) -> str:
    k = "c_custkey"
    approved = d.add_days("DATE '2023-02-01'", f"({k} * 17) % 300")
    rejected = d.add_days("DATE '2023-06-01'", f"({k} * 7) % 260")
    return f"""
SELECT {k} AS member_id, CASE WHEN {k} % 10 = 3 THEN 0 ELSE 1 END AS is_completed,
  CASE WHEN {k} % 4 <> 1 THEN {approved} END AS approved_at,
  CASE WHEN {k} % 4 = 1 OR {k} % 15 = 2 THEN {rejected} END AS rejected_at
FROM {{customer}}"""


def _companies(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""
SELECT {k} AS company_id, o_custkey AS member_id, {d.add_days("DATE '2023-01-01'", f'({k} * 11) % 300')} AS created_at,
  {d.add_days("DATE '2024-01-01'", f'{k} % 365')} AS accounts_next_due_at, {k} % 2 AS is_accounts_overdue,
  {pick(k, STATUSES)} AS company_status,
  CASE WHEN {k} % 6 = 0 THEN NULL ELSE 'R' || CAST({k} % 4000 AS STRING) END AS registry_number
FROM {{orders}}"""


def _company_versions(d: Dialect) -> str:
    return f"""
SELECT o.o_orderkey AS company_id, o.o_custkey AS member_id, l.l_partkey AS version_id,
  {d.add_days("DATE '2023-01-01'", 'l.l_partkey % 300')} AS created_at,
  {d.add_days("DATE '2024-01-01'", 'l.l_suppkey % 365')} AS accounts_next_due_at,
  l.l_linenumber % 2 AS is_accounts_overdue, {pick('l.l_partkey', STATUSES)} AS company_status
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey"""


def _users(d: Dialect) -> str:
    born = f"CASE WHEN c_custkey % 3 = 0 THEN {d.add_days("DATE '1980-02-01'", 'c_custkey % 29')} ELSE {d.add_days("DATE '1950-01-01'", '(c_custkey * 37) % 18000')} END"  # a third in the birth month of an officer
    later = d.add_days("DATE '1960-01-01'", "(c_custkey * 31) % 9000")
    return f"""
SELECT c_custkey AS member_id, c_custkey + 100000 AS user_id, {born} AS date_of_birth, DATE '2023-01-02' AS created_at FROM {{customer}}
UNION ALL
SELECT c_custkey, c_custkey + 100000, {later}, DATE '2023-05-02' FROM {{customer}} WHERE c_custkey % 5 = 0"""


def _id_scans(d: Dialect) -> str:
    return f"""
SELECT event_id AS scan_id, user_id AS member_id, {pick('event_id', ['PASSPORT', 'ID_CARD', 'DRIVING_LICENSE'])} AS id_type,
  {pick('event_id * 3', ['Ann', 'Bob', 'Cy', 'Dee', 'Eva'])} AS id_first_name, {pick('event_id', ['Lee', 'Ray', 'Fox', 'Kim'])} AS id_last_name,
  {d.add_days('CAST(ts AS DATE)', '(event_id * 29) % 3000 - 100')} AS id_expiry_at,
  {pick('event_id', ['ID_SCAN', 'ID_SCAN_VALIDATIONS', 'SELFIE'])} AS verification_type,
  {pick('event_id * 5', ['REGISTRATION', 'ACCOUNT_RECOVERY', 'LOGIN', 'REGISTRATION'])} AS verification_usage, ts AS created_at
FROM {{events}}"""


# Fraud types named on a ticket (the lookup to a main category is in gatewise.plans.labels).
TICKET_TYPES = ["419 emails and letters", "Advance fee fraud", "Cryptocurrency investment fraud", "HMRC scam", "Impersonation scam",
                "Investment scam", "Invoice scams", "Mail boxes and multiple post redirections", "Mule", "Not provided", "Other",
                "Purchase scam", "Pyramid scheme fraud", "Romance scam", "Safe account scam", "Telephone banking scam", None,
                "CEO fraud"]
REFERENCE_COLUMNS = [f"{n}_reference" for n in ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]]


def _tickets(d: Dialect) -> str:
    e = "event_id"
    refs = [f"'TX' || CAST({e} AS STRING)",
            f"CASE WHEN {e} % 3 = 0 THEN ' TX' || CAST({e} + 1 AS STRING) || ', ' END",
            f"CASE WHEN {e} % 5 = 0 THEN '\"TX' || CAST({e} + 2 AS STRING) || '\"' END",
            f"CASE WHEN {e} % 7 = 0 THEN 'TX' || CAST({e} AS STRING) || ' ' END",
            f"CASE WHEN {e} % 11 = 0 THEN 'TX' || CAST({e} + 9 AS STRING) END"] + ["CAST(NULL AS STRING)"] * 5
    columns = ",\n  ".join(f"{sql} AS {name}" for sql, name in zip(refs, REFERENCE_COLUMNS))
    return f"""
SELECT 'K' || CAST({e} AS STRING) AS ticket_key, {e} AS ticket_id,
  CASE WHEN {e} % 9 = 4 THEN 'K' || CAST({e} - 1 AS STRING) END AS parent_key,
  CAST(user_id * 10 + {e} % 10 AS BIGINT) AS company_id, {pick(e, ['RCM', 'RCM', 'OPS', 'RCM'])} AS project_key,
  {pick(e, ['TM alert', ' Risk case', 'Task'])} AS issue_type,
  CASE WHEN {e} % 2 = 0 THEN 'see https://desk.example.com/app/event/a' || CAST({e} % 500 AS STRING) || ' now' ELSE 'no link' END AS description,
  CASE WHEN {e} % 5 = 0 THEN 'https://desk.example.com/x/event/b' || CAST({e} % 400 AS STRING) END AS report_link,
  CASE WHEN {e} % 6 = 0 THEN 'no id' ELSE 'Case ' || CAST(10000 + user_id * 10 + {e} % 10 AS STRING) || ' opened 12' END AS summary,
  {pick(e, ['Open', 'Duplicate', 'Done', None, 'Duplicates', 'Done', 'Open'])} AS status,
  {pick(e, ['Customer', 'Bank', 'Police'])} AS reported_by,
  {pick(e, TICKET_TYPES)} AS fraud_type, {pick(e + ' * 5', ['Investment', 'Other kind', None])} AS fraud_category,
  {pick(e, ['Yes', None, 'No', None, None])} AS app_fraud,
  CASE WHEN {e} % 8 = 3 THEN 1 ELSE 0 END AS is_subtask,
  CASE WHEN {e} % 3 = 1 THEN CAST({e} % 4 AS INT) END AS fraud_report_count,
  {columns}, ts AS created_at
FROM {{events}}"""


def _ticket_changes(d: Dialect) -> str:
    e = "event_id"
    return f"""
SELECT {e} AS ticket_id, 'Number of fraud reports' AS change_field, CAST({e} % 4 AS STRING) AS new_value,
  CAST({d.add_days('CAST(ts AS DATE)', f'{e} % 6')} AS TIMESTAMP) AS change_at FROM {{events}} WHERE {e} % 2 = 0
UNION ALL
SELECT {e}, 'Status', {pick(e, ['SAR', 'Confirmed', 'PPS Review', 'Clear funds', 'Off-board', 'Open'])},
  CAST({d.add_days('CAST(ts AS DATE)', f'{e} % 9')} AS TIMESTAMP) FROM {{events}} WHERE {e} % 3 <> 1"""


def _chats(d: Dialect) -> str:
    first = "MIN(ts)"
    return f"""
SELECT 'a' || CAST(event_id % 450 AS STRING) AS ticket_id, {first} AS created_at FROM {{events}} GROUP BY event_id % 450
UNION ALL
SELECT 'b' || CAST(event_id % 350 AS STRING), {first} FROM {{events}} GROUP BY event_id % 350"""


def _cleared(d: Dialect) -> str:
    e = "event_id"
    return f"""
SELECT 'TX' || CAST({e} AS STRING) AS txn_ref, {pick(e, ['PaymentIn', 'FasterPaymentIn', 'PaymentOut'])} AS transaction_type,
  {pick(e, ['UK.OBIE.FPS', 'UK.OBIE.SWIFT', 'UK.OBIE.BACS', 'UK.OBIE.FPS', None])} AS local_instrument,
  'Name ' || CAST({e} % 50 AS STRING) AS account_name, CAST(100000 + {e} % 70 AS STRING) || '12345678' AS account_identification,
  ts AS transaction_at, value AS amount FROM {{events}}"""


def _realtime(d: Dialect) -> str:
    return f"""
SELECT 'TX' || CAST(event_id AS STRING) AS transaction_reference, {pick('event_id', ['CLEARED', 'CLEARED', 'FAILED', 'CLEARED'])} AS status
FROM {{events}}"""


def _banks(d: Dialect) -> str:
    return f"""
SELECT CAST(100000 + event_id % 60 AS STRING) AS sortcode, {pick('event_id % 60', [' alpha bank', 'Beta ', 'GAMMA'])} AS bank_name FROM {{events}}"""


def _registry_payload(key: str, company: str, created: str) -> str:
    """Registry document as JSON text; the director list uses the part key for dates of birth."""
    return f"""'{{{{"data":{{{{"companyNumber":"' || {company} || '","address":{{{{"postcode":"' ||
  {pick(key, ['WC2H 9JQ', 'E1 6AN', 'A', 'HP13'])} || '","countryCode":"GB"}}}},"status":"' || {pick(key, ['Active', 'Dissolved', 'Liquidation'])} ||
  '","numberOfEmployees":' || CAST({key} % 90 AS STRING) || ',"incorporationDate":"2019-0' || CAST(1 + {key} % 9 AS STRING) || '-15"' ||
  ',"directorsTree":[{{{{"officerId":"o' || CAST({key} AS STRING) || '","person":{{{{"firstName":"' || {pick(key, ['Ann', 'Bobby', 'Cy', 'Zed'])} ||
  '","lastName":"' || {pick(key, ['Lee', 'Ray', 'Fox'])} || '","dateOfBirth":"19' || CAST(60 + {key} % 40 AS STRING) || '-0' || CAST(1 + {key} % 9 AS STRING) ||
  '-11","nationalities":["' || {pick(key, ['GB', 'RO', 'none', 'IN'])} || '","PT"]}}}}}}}},{{{{"officerId":"p' || CAST({key} AS STRING) ||
  '","person":{{{{"firstName":"' || {pick(key + ' * 3', ['Eva', 'Evan', 'Bob', 'Anna', 'Deeva'])} || '","lastName":"' || {pick(key + ' * 7', ['Kim', 'Kimber', 'Lee', 'Raye'])} ||
  '","dateOfBirth":"1980-02-03","nationalities":' || {pick(key, ['[]', '["RO"]', '["IND","none"]'])} || '}}}}}}}}],"structureLevelWise":{{{{"1":' ||
  CAST(1 + {key} % 4 AS STRING) || '}}}}}}}},"metadata":{{{{"created_at":"' || CAST({created} AS STRING) || '"}}}}}}}}'"""


def _registry(d: Dialect) -> str:
    number = "'R' || CAST(p_partkey % 4000 AS STRING)"
    first = _registry_payload("p_partkey", number, d.add_days("DATE '2022-01-01'", "(p_partkey * 7) % 300"))
    second = _registry_payload("p_partkey", number, d.add_days("DATE '2022-03-01'", "(p_partkey * 5) % 300"))
    return f"""
SELECT CASE WHEN p_partkey % 50 = 7 THEN '{{{{bad' ELSE {first} END AS doc FROM {{part}}
UNION
SELECT {second} AS doc FROM {{part}} WHERE p_partkey % 3 = 0"""


def _app_events(d: Dialect) -> str:
    e = "event_id"
    return f"""
SELECT {e} AS event_id, CAST(user_id * 10 + {e} % 10 AS BIGINT) AS company_id,
  {pick(e, ['membership-completed', 'calculate-risk', 'heartbeat'])} AS event_type, ts,
  '{{{{"applicant":{{{{"firstName":"' || {pick(e, ['Ann', 'BOB', 'Cy'])} || '"' || CASE WHEN {e} % 2 = 0 THEN ',"middleName":"Jo"' ELSE '' END ||
  ',"lastName":"' || {pick(e, ['Lee', 'Ray', 'Fox', 'Kim'])} || '","idScan":{{{{"firstName":"' || {pick(e + ' * 3', ['ann', 'Bobby', 'Cy', 'Dee'])} ||
  '","lastName":"' || {pick(e + ' * 5', ['LEE', 'Ray', 'Foxx', 'Kimble', 'Stone'])} || '"}}}}}}}}}}}}' AS payload
FROM {{events}}"""


def _links(d: Dialect) -> str:
    return "\nSELECT o_custkey AS entity_id, o_orderkey AS entity_dest_id FROM {orders}"


def _individuals(d: Dialect) -> str:
    return f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey + 100000 END AS user_id,
  {d.add_days("DATE '1995-06-01'", '(c_custkey * 13) % 1500')} AS created_on FROM {{customer}}"""


def _businesses(d: Dialect) -> str:
    return "\nSELECT o_orderkey AS id, o_orderkey AS legacy_id, CAST(o_orderdate AS DATE) AS created_on FROM {orders}"


_DEFINITIONS = {
    "applications": (_applications, ()), "members": (_members, ("applications",)), "decisions": (_decisions, ()),
    "memberships": (_memberships, ()), "companies": (_companies, ()), "company_versions": (_company_versions, ()),
    "users": (_users, ()), "id_scans": (_id_scans, ()), "tickets": (_tickets, ()), "ticket_changes": (_ticket_changes, ()),
    "chats": (_chats, ()), "cleared_txns": (_cleared, ()), "realtime_txns": (_realtime, ()), "banks": (_banks, ()),
    "registry_docs": (_registry, ()), "app_events": (_app_events, ()), "person_links": (_links, ()),
    "individuals": (_individuals, ()), "businesses": (_businesses, ()),
}


def cte_list(names: list[str] | tuple[str, ...], dialect: Dialect, tables: dict[str, str]) -> str:
    """``name AS (select), ..`` for the named fixtures and what they depend on, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in _DEFINITIONS[name][1]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)
    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({_DEFINITIONS[n][0](dialect).format(**tables)})" for n in ordered)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table or a fixture as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    tables = {t: f"parquet.`{folder}/{t}.parquet`" for t in BASE_TABLES}
    return spark.sql(f"WITH {cte_list([name], SPARK, tables)} SELECT * FROM {name}")


def oracle_prefix(names: list[str] | tuple[str, ...]) -> str:
    """The WITH clause that gives DuckDB the same fixtures."""
    return f"WITH {cte_list(names, DUCKDB, {t: t for t in BASE_TABLES})}"
