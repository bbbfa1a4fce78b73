"""Onboarding labels: latest decisions, fraud tickets, their transactions, and the labelled cohort.

Everything is joins on keys plus aggregates that combine before the shuffle; pick-one steps carry a total order, so a
member or transaction with very many rows never becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewise.functions.scalars import first_match, full_name, year_boundaries
from gatewise.operators.windows import pick_one
from gatewise.session import literal_table, shuffled

# Ticket fraud type to main category.
MAIN_CATEGORY = {
    "419 emails and letters": "Unknown type/Other",
    "Advance fee fraud": "Advance Fee",
    "Cryptocurrency investment fraud": "Investment",
    "HMRC scam": "Impersonation (Other)",
    "Impersonation scam": "Impersonation (Other)",
    "Investment scam": "Investment",
    "Invoice scams": "Invoice and Mandate",
    "Mail boxes and multiple post redirections": "Invoice and Mandate",
    "Mule": "Unknown type/Other",
    "Not provided": "Unknown type/Other",
    "Other": "Unknown type/Other",
    "Purchase scam": "Purchase scam",
    "Pyramid scheme fraud": "Investment",
    "Romance scam": "Romance scam",
    "Safe account scam": "Impersonation (Police/Bank)",
    "Telephone banking scam": "Impersonation (Other)",
}
# Types that the older report system counts as authorised-payment fraud.
REPORTED_TYPES = ["Cryptocurrency investment fraud", "HMRC scam", "Impersonation scam", "Investment scam", "Invoice scams", "Other",
                  "Romance scam", "Purchase scam", "Advance fee fraud", "Pyramid scheme fraud", "419 emails and letters", "Safe account scam"]
# Statuses, rule lists, channels and state changes the queries test for.
DUPLICATE_STATUSES = ["Duplicate", "Duplicates"]
AUTOMATIC_RULE_LISTS = ['["ORE_RISK_RATING"]', "[]"]
INBOUND_TYPES = ["PaymentIn", "FasterPaymentIn"]
FOREIGN_INSTRUMENT = "UK.OBIE.SWIFT"
ACTIVITY_STATES = ["SAR", "PPS Review", "Submit to NCA", "NCA Approval", "NCA Refusal", "Clear funds", "Off-board", "customer"]
ACTIVITY_ISSUES = ["TM alert", "Risk case"]
# Pattern of the conversation id in a link.
CONVERSATION_ID = r"https.*/event/([a-z0-9]+)"

DECISION_SCHEMA = ("identity struct<membership_id: string>, metadata struct<created_at: string, versions: struct<risk_engine_version: string>>, "
                   "decision struct<risk_category: string, final_decision: string, risk_rating: double, failed_business_rules: string>")


def parsed_once(column: str, schema: str) -> Column:
    """Top-level fields of a JSON column. Generated, so that filters and later projections do not repeat the parse."""
    return F.inline(F.array(F.from_json(column, schema)))


def parse_decisions(decisions: DataFrame) -> DataFrame:
    """Typed columns of the decision documents; documents that do not parse are dropped (they have no member)."""
    parsed = decisions.select("decision_id", parsed_once("data", DECISION_SCHEMA))
    return parsed.select(
        F.col("identity.membership_id").try_cast("bigint").alias("member_id"), F.col("metadata.created_at").try_cast("date").alias("created_at"),
        "decision_id", F.col("metadata.versions.risk_engine_version").alias("risk_engine_version"),
        F.col("decision.risk_category").alias("risk_category"), F.col("decision.final_decision").alias("final_decision"),
        F.col("decision.risk_rating").alias("risk_rating"), F.col("decision.failed_business_rules").alias("failed_business_rules"),
    ).filter(F.col("member_id").isNotNull())


def latest_decision(decisions: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Newest decision per member within the dates (ties: largest decision id), with the rule engine's own decision."""
    dated = parse_decisions(decisions).filter(F.col("created_at").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
    latest = pick_one(dated, ["member_id"], ["created_at", "decision_id"])
    return latest.withColumn("rules_engine_decision", F.when(F.col("failed_business_rules").isin(AUTOMATIC_RULE_LISTS), "approved").otherwise("mkyc"))


def with_main_category(tickets: DataFrame, column: str = "fraud_type") -> DataFrame:
    lookup = literal_table(tickets.sparkSession, list(MAIN_CATEGORY.items()), f"{column} string, main_category string")
    return tickets.join(lookup, column, "left")


def open_reports(tickets: DataFrame) -> DataFrame:
    """Main tickets of the risk project that are not duplicates (an unknown status does not qualify)."""
    return tickets.filter((F.col("project_key") == "RCM") & (F.col("is_subtask") != 1) & ~F.col("status").isin(DUPLICATE_STATUSES))


def classify_tickets(tickets: DataFrame) -> DataFrame:
    """Fraud category, yes/no flag and conversation ids per report ticket.

    No join to status changes: every confirmed change would only repeat the ticket.
    """
    typed = with_main_category(open_reports(tickets).filter(
        (F.year("created_at") >= 2022) & F.coalesce("fraud_type", "fraud_category").isNotNull()))
    kind = F.coalesce("main_category", "fraud_category")
    derived = F.when(kind.isin(sorted(set(MAIN_CATEGORY.values()))), "Yes").otherwise("No")
    link = F.element_at(F.split(first_match("description", r"https?://.*"), r"\|https:"), 1)
    return typed.select(
        "ticket_key", "ticket_id", "company_id", F.when(F.col("report_link").isNotNull(), "Bank").otherwise(F.col("reported_by")).alias("reported_by"),
        kind.alias("app_fraud_type"), F.coalesce("app_fraud", derived).alias("is_app"),
        first_match("report_link", CONVERSATION_ID, 1).alias("link_id"), first_match(link, CONVERSATION_ID, 1).alias("text_id"), "created_at").distinct()


def earliest_report(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """Older system: first report-count change (or creation) per counted ticket."""
    counted = open_reports(tickets).filter(F.col("fraud_report_count").isNotNull())
    counts = changes.filter(F.col("change_field") == "Number of fraud reports").select("ticket_id", "change_at")
    joined = with_main_category(counted).join(counts, "ticket_id", "left").withColumn("at", F.coalesce("change_at", "created_at"))
    return (joined.filter(F.to_date("at") >= F.lit("2022-01-01").cast("date"))
            .groupBy("ticket_key", "company_id", "ticket_id", "reported_by", F.coalesce("main_category", "fraud_type").alias("app_fraud_type"),
                     F.when(F.col("fraud_type").isin(REPORTED_TYPES), "Yes").otherwise("No").alias("is_app"))
            .agg(F.min("at").alias("reported_at")))


def spread_nulls(key: str, by: str) -> Column:
    """A text join key whose NULLs become up to 4,096 values that match nothing, dealt by another column."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000absent "), F.pmod(F.xxhash64(by), F.lit(4096)).cast("string")))


def conversation_report_date(classified: DataFrame, chats: DataFrame) -> DataFrame:
    """Reported date: first conversation found by link, then by description, else the ticket's creation."""
    by_link = chats.select(F.col("ticket_id").alias("link_id"), F.col("created_at").alias("link_at"))
    by_text = chats.select(F.col("ticket_id").alias("text_id"), F.col("created_at").alias("text_at"))
    # most tickets have no link: absent ids are spread over keys that match nothing, not gathered in one partition
    joined = (classified.withColumns({"_link": spread_nulls("link_id", "ticket_key"), "_text": spread_nulls("text_id", "ticket_key")})
              .join(by_link.withColumnRenamed("link_id", "_link"), "_link", "left").join(by_text.withColumnRenamed("text_id", "_text"), "_text", "left").drop("_link", "_text"))
    return joined.withColumn("reported_date", F.to_date(F.coalesce("link_at", "text_at", "created_at"))).drop("link_at", "text_at")


def references_to_rows(tickets: DataFrame, columns: list[str]) -> DataFrame:
    """Many reference columns to distinct (ticket, reference) rows in one scan, without blanks, commas and quotes."""
    long = tickets.select("ticket_key", *columns).unpivot("ticket_key", columns, "slot", "raw").filter(F.col("raw").isNotNull())
    return long.select("ticket_key", F.regexp_replace("raw", r'[\s,"]', "").alias("txn_ref")).distinct()


def ticket_transactions(tickets: DataFrame, references: DataFrame, cleared: DataFrame, realtime: DataFrame) -> DataFrame:
    """Report tickets to cleared inbound transactions; a sub-ticket is credited to its parent."""
    inbound = cleared.filter(F.col("transaction_type").isin(INBOUND_TYPES) & (F.col("local_instrument") != FOREIGN_INSTRUMENT))
    settled = realtime.filter(F.col("status") == "CLEARED").select(F.col("transaction_reference").alias("txn_ref")).distinct()
    known = inbound.join(settled, "txn_ref", "left_semi")
    risk = tickets.filter(F.col("project_key") == "RCM").select("ticket_key", "parent_key", "company_id", F.col("created_at").alias("ticket_created_at"))
    return (risk.join(references, "ticket_key").join(known, "txn_ref")
            .select("company_id", F.coalesce("parent_key", "ticket_key").alias("ticket_key"), "ticket_created_at", "txn_ref", "account_name",
                    F.substring("account_identification", 1, 6).alias("sort_code"), "transaction_at", "amount").distinct())


def newest_per_transaction(transactions: DataFrame, conversation_reports: DataFrame, counted_reports: DataFrame) -> DataFrame:
    """Both report systems together; the newest ticket wins each transaction (then key, flag, category, date)."""
    first = conversation_reports.select("ticket_key", "app_fraud_type", "is_app", "reported_date")
    second = counted_reports.select("ticket_key", "app_fraud_type", "is_app", F.to_date("reported_at").alias("reported_date"))
    reports = first.unionByName(second).distinct()
    joined = transactions.join(reports, "ticket_key")
    return pick_one(joined, ["txn_ref"], ["ticket_created_at", "ticket_key", "is_app", "app_fraud_type", "reported_date"])


def fraud_days(transactions: DataFrame, companies: DataFrame, memberships: DataFrame) -> DataFrame:
    """Days from approval to the fraud and from the fraud to rejection."""
    owner = companies.select("company_id", "member_id").join(memberships.select("member_id", "approved_at", "rejected_at"), "member_id")
    return (transactions.join(owner, "company_id", "left")
            .select("company_id", "txn_ref", "transaction_at", "app_fraud_type", "amount",
                    F.date_diff(F.to_date("transaction_at"), "approved_at").alias("days_to_fraud"),
                    F.date_diff("rejected_at", F.to_date("transaction_at")).alias("days_to_reject")).distinct())


def in_cohort(from_date: str, to_date: str) -> Column:
    """Created in the window, or approved in it within three months of creation; nothing after the end."""
    low, high = F.lit(from_date).cast("date"), F.lit(to_date).cast("date")
    created, approved = F.col("created_at"), F.col("approved_at")
    return ((F.col("is_completed") == 1) & (F.coalesce(approved, created) <= high)
            & (created.between(low, high) | (approved.between(low, high) & approved.between(created, F.add_months(created, 3)))))


def label_per_company(frauds: DataFrame, window_days: int = 180, allow_before: bool = False) -> DataFrame:
    """Fraud label, first days, amount and kinds per company. ``allow_before`` also counts frauds dated before approval."""
    inside = (F.col("days_to_fraud") <= window_days) if allow_before else F.col("days_to_fraud").between(0, window_days)
    return frauds.groupBy("company_id").agg(
        F.max(F.when(inside, 1).otherwise(0)).alias("is_app_fraud"), F.min("days_to_fraud").alias("days_to_app_fraud"),
        F.min("days_to_reject").alias("days_fraud_to_reject"), F.sum(F.when(inside, F.col("amount")).otherwise(0.0)).alias("app_fraud_amount"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(inside, F.col("app_fraud_type")))), ","), F.lit("")).alias("app_fraud_type"))


def label_cohort(t: dict[str, DataFrame], reference_columns: list[str], from_date: str, to_date: str, window_days: int = 180,
                 allow_before: bool = False) -> DataFrame:
    """One row per completed company in the window: decision, approval, and fraud within ``window_days`` of approval."""
    early = str(_months_before(from_date, 3))
    decisions = latest_decision(t["decisions"], early, to_date).select(
        "member_id", "risk_category", "failed_business_rules", "rules_engine_decision", "final_decision")
    reports = conversation_report_date(classify_tickets(t["tickets"]), t["chats"])
    counted = earliest_report(t["tickets"], t["ticket_changes"])
    linked = ticket_transactions(t["tickets"], references_to_rows(t["tickets"], reference_columns), t["cleared_txns"], t["realtime_txns"])
    newest = newest_per_transaction(linked, reports, counted).filter(F.col("is_app") == "Yes")
    labels = label_per_company(fraud_days(newest, t["companies"], t["memberships"]), window_days, allow_before)
    base = (t["companies"].select("company_id", "member_id", "created_at").join(t["memberships"], "member_id")
            .filter(in_cohort(from_date, to_date)).join(decisions, "member_id"))
    return (base.join(labels, "company_id", "left")
            .select("member_id", "company_id", "created_at", "risk_category", "failed_business_rules", "rules_engine_decision", "final_decision",
                    "approved_at", F.col("approved_at").isNotNull().cast("int").alias("is_approved"),
                    F.coalesce("is_app_fraud", F.lit(0)).alias("is_app_fraud"), "days_to_app_fraud", "days_fraud_to_reject",
                    F.coalesce("app_fraud_amount", F.lit(0.0)).alias("app_fraud_amount"), "app_fraud_type"))


def _months_before(day: str, months: int):
    from datetime import date
    d = date.fromisoformat(day)
    month = d.year * 12 + d.month - 1 - months
    return date(month // 12, month % 12 + 1, min(d.day, 28))


def activity_label(tickets: DataFrame, changes: DataFrame, companies: DataFrame, memberships: DataFrame, window_days: int = 90) -> DataFrame:
    """Suspicious-activity label: the first reporting state change of any of a company's cases, within days of approval."""
    cases = tickets.filter((F.col("project_key") == "RCM") & F.trim("issue_type").isin(ACTIVITY_ISSUES)
                           & (F.col("status").isNull() | (F.col("status") != "Duplicates")) & ((F.col("is_subtask") != 1) | F.col("is_subtask").isNull()))
    moved = changes.filter(F.col("new_value").isin(ACTIVITY_STATES)).select("ticket_id", "change_at")
    first = (cases.select("ticket_id", (first_match(F.trim("summary"), "[0-9]{4,}").try_cast("bigint")).alias("case_id")).join(moved, "ticket_id")
             .groupBy("case_id").agg(F.to_date(F.date_trunc("day", F.min("change_at"))).alias("first_change")))
    owner = companies.select("company_id", "member_id").join(memberships.filter(F.col("is_completed") == 1), "member_id")
    hit = F.date_diff("first_change", "approved_at") <= window_days
    return (owner.join(first.withColumn("company_id", F.col("case_id") - 10000), "company_id")
            .groupBy("company_id", "member_id").agg(F.max(F.when(hit, 1).otherwise(0)).alias("activity_label")))


def decision_rules(decisions: DataFrame, memberships: DataFrame, companies: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Latest decision and its failed rules for the companies of completed members."""
    latest = latest_decision(decisions, from_date, to_date).select("member_id", "risk_category", "final_decision", "failed_business_rules")
    done = memberships.filter(F.col("is_completed") == 1).select("member_id")
    return (latest.join(done, "member_id", "left_semi").join(companies.select("company_id", "member_id"), "member_id", "left")
            .select("company_id", "risk_category", "final_decision", "failed_business_rules").distinct())


def member_attributes(versions: DataFrame, memberships: DataFrame, scans: DataFrame, users: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Latest company row, latest identity scan and earliest birth date per company, with years to document expiry."""
    inside = versions.join(memberships, "member_id").filter(in_cohort(from_date, to_date))
    company = pick_one(inside.select("company_id", "member_id", "created_at", "version_id", "accounts_next_due_at", "is_accounts_overdue", "company_status"),
                       ["company_id"], ["created_at", "version_id", "is_accounts_overdue", "accounts_next_due_at", "company_status"])
    valid = scans.filter(F.col("verification_type").isin("ID_SCAN", "ID_SCAN_VALIDATIONS") & F.col("verification_usage").isin("REGISTRATION", "ACCOUNT_RECOVERY"))
    scan = pick_one(valid.select("member_id", "scan_id", "id_first_name", "id_last_name", "id_expiry_at", F.col("created_at").alias("scanned_at")),
                    ["member_id"], ["scanned_at", "scan_id"]).drop("scan_id", "scanned_at")
    born = users.groupBy("member_id").agg(F.min_by("date_of_birth", F.struct("created_at", "date_of_birth")).alias("date_of_birth"))
    return (company.join(scan, "member_id", "left").join(born, "member_id", "left")
            .withColumn("years_to_id_expiry", year_boundaries("created_at", "id_expiry_at")))


REGISTRY_SCHEMA = ("data struct<companyNumber: string, address: struct<postcode: string, countryCode: string>, status: string, incorporationDate: string, "
                   "numberOfEmployees: bigint, directorsTree: string, structureLevelWise: struct<`1`: string>>, metadata struct<created_at: string>")


def parse_registry(docs: DataFrame) -> DataFrame:
    """Typed columns of registry documents; the director list stays as JSON text."""
    p = docs.select(parsed_once("doc", REGISTRY_SCHEMA))
    return p.select(
        F.col("data.companyNumber").alias("registry_number"), F.col("metadata.created_at").try_cast("date").alias("registry_created_at"),
        F.col("data.address.postcode").alias("company_postcode"), F.col("data.address.countryCode").alias("company_countrycode"),
        F.col("data.incorporationDate").alias("incorporation_date"), F.col("data.numberOfEmployees").alias("employees"),
        F.col("data.directorsTree").alias("directors"), F.col("data.structureLevelWise.`1`").alias("structure_level"),
        F.col("data.status").alias("registry_status")).filter(F.col("registry_number").isNotNull())


def registry_match(companies: DataFrame, memberships: DataFrame, docs: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Earliest registry document of each company's number; companies without one stay with a hit of 0."""
    earliest = pick_one(parse_registry(docs), ["registry_number"],
                        ["registry_created_at", "company_postcode", "employees", "registry_status", "directors"], largest=False)
    done = memberships.filter(F.col("is_completed") == 1).select("member_id")
    base = (companies.filter(F.col("created_at").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
            .join(shuffled(done), "member_id", "left_semi").select("company_id", "member_id", "created_at", "registry_number"))
    matched = (base.withColumn("_number", spread_nulls("registry_number", "company_id"))
               .join(shuffled(earliest.withColumnRenamed("registry_number", "_number")), "_number", "left").drop("_number"))
    return matched.withColumn("registry_hit", F.col("registry_created_at").isNotNull().cast("int"))


NAME_SCHEMA = "applicant struct<firstName: string, middleName: string, lastName: string, idScan: struct<firstName: string, middleName: string, lastName: string>>"


def applicant_names(events: DataFrame, from_date: str, to_date: str, event_types: list[str]) -> DataFrame:
    """Declared and scanned full name from the newest application event per company."""
    dated = events.filter(F.col("event_type").isin(event_types) & F.to_date("ts").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
    latest = pick_one(dated.select("company_id", "ts", "event_id", "payload"), ["company_id"], ["ts", "event_id"])
    a = F.from_json("payload", NAME_SCHEMA).getField("applicant")
    flat = latest.select("company_id", a.firstName.alias("f"), a.middleName.alias("m"), a.lastName.alias("l"),
                         a.idScan.firstName.alias("sf"), a.idScan.middleName.alias("sm"), a.idScan.lastName.alias("sl"))
    return flat.select("company_id", full_name("f", "m", "l").alias("full_name"), full_name("sf", "sm", "sl").alias("id_full_name"))


def existing_customer(companies: DataFrame, memberships: DataFrame, users: DataFrame, links: DataFrame, individuals: DataFrame,
                      businesses: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """1 when the person behind a company also owns another business created no earlier than their own record."""
    person = individuals.filter(F.col("user_id").isNotNull()).select(F.col("id").alias("entity_id"), "user_id", F.col("created_on").alias("person_on"))
    business = businesses.select(F.col("id").alias("entity_dest_id"), "legacy_id", F.col("created_on").alias("business_on"))
    owned = (links.join(person, "entity_id").join(business, "entity_dest_id").filter(F.col("person_on") <= F.col("business_on"))
             .groupBy("user_id").agg((F.count_distinct("legacy_id") - 1).alias("other_companies")))
    base = (companies.filter(F.col("created_at").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
            .join(memberships.filter(F.col("is_completed") == 1).select("member_id"), "member_id", "left_semi"))
    per_member = (users.select("member_id", "user_id").distinct().join(owned, "user_id", "left")
                  .groupBy("member_id").agg(F.max(F.when(F.col("other_companies") > 0, 1).otherwise(0)).alias("existing")))
    return base.join(per_member, "member_id", "left").groupBy("company_id").agg(F.max(F.coalesce("existing", F.lit(0))).alias("is_existing_user"))
