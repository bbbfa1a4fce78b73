"""Registered joins, aggregations, windows, sorting and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gatewise.functions.scalars import flag
from gatewise.functions.similarity import shares_token
from gatewise.operators import aggregates as A, joins as J, windows as N
from gatewise.plans.expressions import COUNTRIES
from gatewise.plans.registry import query
from gatewise.session import checkpoint_folder, literal_table, shuffled
from gatewise.sources.files import write_bucketed
from gatewise.sources.standins import load

# Invented sample of postcode prefixes and risks.
POSTCODE_RISK = [("WC", "High"), ("W", "Low"), ("E1", "Medium"), ("B", "High"), ("G21", "High"), ("M", "Medium"), ("HP13", "Medium")]
PROBS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query("inner_join_nation_orders", (), """
SELECT n_name, CAST(COUNT(*) AS BIGINT) AS orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def inner_join_nation_orders(spark, d):
    joined = (load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
              .join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_join_missing_items", (), """
SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS orders, CAST(SUM(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_items
FROM orders LEFT JOIN (SELECT l_orderkey AS k FROM lineitem GROUP BY 1) ON o_orderkey = k GROUP BY 1""")
def left_join_missing_items(spark, d):
    keys = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    joined = load(spark, d, "orders").join(keys, F.col("o_orderkey") == F.col("k"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count_if(F.col("k").isNull()).alias("without_items"))


@query("keyless_join_as_exists", ("tickets", "ticket_changes"), """
SELECT DISTINCT ticket_key, company_id, fraud_type FROM tickets a LEFT JOIN (SELECT 1 AS one FROM ticket_changes b
  WHERE b.change_field = 'Status' AND b.new_value = 'Confirmed' LIMIT 1) ON TRUE WHERE project_key = 'RCM'""")
def keyless_join_as_exists(spark, d):
    # A left join on literals only would repeat each ticket once per change row before DISTINCT; no column of the
    # right side is read, so the distinct left side alone is the answer.
    return load(spark, d, "tickets").filter("project_key = 'RCM'").select("ticket_key", "company_id", "fraud_type").distinct()


@query("join_with_filtered_side", ("cleared_txns", "realtime_txns"), """
SELECT b.txn_ref, CASE WHEN rt.transaction_reference IS NULL THEN 0 ELSE 1 END AS settled FROM cleared_txns b
LEFT JOIN realtime_txns rt ON b.txn_ref = rt.transaction_reference AND rt.status = 'CLEARED' WHERE b.transaction_type = 'PaymentIn'""")
def join_with_filtered_side(spark, d):
    settled = load(spark, d, "realtime_txns").filter("status = 'CLEARED'").select(F.col("transaction_reference").alias("txn_ref"))
    return J.with_membership(load(spark, d, "cleared_txns").filter("transaction_type = 'PaymentIn'"), settled, ["txn_ref"], "settled").select("txn_ref", "settled")


@query("inequality_join", ("individuals", "businesses", "person_links"), """
SELECT i.user_id, CAST(COUNT(*) AS BIGINT) AS later_businesses FROM person_links r JOIN individuals i ON r.entity_id = i.id
JOIN businesses b ON r.entity_dest_id = b.id WHERE i.created_on <= b.created_on AND i.user_id IS NOT NULL GROUP BY 1""")
def inequality_join(spark, d):
    i = load(spark, d, "individuals").select(F.col("id").alias("entity_id"), "user_id", F.col("created_on").alias("person_on"))
    b = load(spark, d, "businesses").select(F.col("id").alias("entity_dest_id"), F.col("created_on").alias("business_on"))
    return (load(spark, d, "person_links").join(i.filter("user_id IS NOT NULL"), "entity_id").join(b, "entity_dest_id")
            .filter("person_on <= business_on").groupBy("user_id").agg(F.count("*").alias("later_businesses")))


@query("parent_self_join", ("tickets",), """
SELECT a.ticket_key, a.parent_key, sub.status AS parent_status FROM tickets a LEFT JOIN tickets sub ON a.parent_key = sub.ticket_key WHERE a.parent_key IS NOT NULL""")
def parent_self_join(spark, d):
    t = load(spark, d, "tickets")
    parents = t.select(F.col("ticket_key").alias("parent_key"), F.col("status").alias("parent_status"))
    return t.filter("parent_key IS NOT NULL").select("ticket_key", "parent_key").join(parents, "parent_key", "left").select("ticket_key", "parent_key", "parent_status")


@query("asof_features", (), """
spine AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
features AS (
  SELECT user_id, ts AS feature_ts, MAX(event_id) AS feature_id FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)
SELECT s.event_id, s.user_id, CAST(f.feature_id AS DOUBLE) AS feature_id, ROUND(e.value, 4) AS feature_value
FROM spine s ASOF LEFT JOIN features f ON s.user_id = f.user_id AND s.ts >= f.feature_ts LEFT JOIN events e ON e.event_id = f.feature_id""")
def asof_features(spark, d):
    e = load(spark, d, "events")
    features = e.filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("feature_ts"), F.col("event_id").alias("feature_id"), F.col("value").alias("feature_value"))
    out = J.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), features, "user_id", "ts", "feature_ts", ["feature_id", "feature_value"])
    return out.select("event_id", "user_id", F.col("feature_id").cast("double").alias("feature_id"), F.round("feature_value", 4).alias("feature_value"))


_PREFIX = "risk(prefix, level) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for p, r in POSTCODE_RISK) + ")"


@query("prefix_lookup", ("members",), _PREFIX + """
SELECT company_id, postcode_area, CASE WHEN postcode_area IS NULL THEN 'Undefined' ELSE COALESCE(
  (SELECT level FROM risk WHERE prefix = LEFT(postcode_area, 4) AND LENGTH(prefix) = 4), (SELECT level FROM risk WHERE prefix = LEFT(postcode_area, 3) AND LENGTH(prefix) = 3),
  (SELECT level FROM risk WHERE prefix = LEFT(postcode_area, 2) AND LENGTH(prefix) = 2), (SELECT level FROM risk WHERE prefix = LEFT(postcode_area, 1) AND LENGTH(prefix) = 1),
  'Low') END AS level FROM members""")
def prefix_lookup(spark, d):
    table = literal_table(spark, POSTCODE_RISK, "prefix string, level string")
    return J.prefix_lookup(load(spark, d, "members").select("company_id", "postcode_area"), "postcode_area", table, "prefix", "level")


@query("dictionary_lookup", (), """
SELECT event_type, COALESCE(kind, 'Undefined') AS kind, CAST(COUNT(*) AS BIGINT) AS n FROM events
LEFT JOIN (VALUES ('click', 'browse'), ('view', 'browse'), ('purchase', 'money'), ('signup', 'account')) t(k, kind) ON event_type = k GROUP BY 1, 2""")
def dictionary_lookup(spark, d):
    table = literal_table(spark, [("click", "browse"), ("view", "browse"), ("purchase", "money"), ("signup", "account")], "k string, kind string")
    return (J.lookup(load(spark, d, "events"), "event_type", table, "k", "kind", "kind", "Undefined").groupBy("event_type", "kind").agg(F.count("*").alias("n")))


_DOCS = """
docs AS (SELECT CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS j FROM registry_docs),
typed AS (SELECT j->>'$.data.companyNumber' AS registry_number, CAST(j->>'$.metadata.created_at' AS DATE) AS made, j->>'$.data.address.postcode' AS p, CAST(j->>'$.data.numberOfEmployees' AS BIGINT) AS e,
  j->>'$.data.status' AS s, j->>'$.data.directorsTree' AS directors FROM docs WHERE j IS NOT NULL),
first_doc AS (SELECT registry_number, directors FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY registry_number ORDER BY made, p, e, s, directors) AS rn FROM typed) WHERE rn = 1),
base AS (SELECT c.company_id, c.member_id, c.created_at, f.directors FROM companies c JOIN memberships m ON c.member_id = m.member_id AND m.is_completed = 1 LEFT JOIN first_doc f ON c.registry_number = f.registry_number
  WHERE c.created_at BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'),
entry AS (SELECT company_id, created_at, unnest(CAST(json_extract(directors, '$[*]') AS JSON[])) AS o FROM base WHERE directors IS NOT NULL),
officer AS (SELECT company_id, created_at, o->>'$.officerId' AS officer_id, lower(o->>'$.person.firstName') AS director_first, lower(o->>'$.person.lastName') AS director_last, CAST(o->>'$.person.dateOfBirth' AS DATE) AS dob,
  CASE WHEN json_array_length(o, '$.person.nationalities') = 0 THEN '' ELSE array_to_string(CAST(json_extract(o, '$.person.nationalities') AS VARCHAR[]), ',') END AS nationalities FROM entry)"""
_DIRECTOR_TABLES = ("companies", "memberships", "registry_docs", "users")


def _registry(spark, d):
    from gatewise.operators.labels import registry_match
    return registry_match(load(spark, d, "companies"), load(spark, d, "memberships"), load(spark, d, "registry_docs"), "2023-01-01", "2023-12-31")


def _applicants_and_directors(spark, d):
    """Names as scanned, birth dates from the user record, and the officers of the register document."""
    docs = _registry(spark, d)
    directors = J.flatten_directors(docs.filter("directors IS NOT NULL"), "company_id", "directors")
    born = load(spark, d, "users").groupBy("member_id").agg(F.min_by("date_of_birth", "created_at").alias("date_of_birth"))
    applicants = docs.select("company_id", "member_id").join(shuffled(born), "member_id", "left").join(shuffled(load(spark, d, "members").select("company_id", "first_name", "last_name")), "company_id")
    return applicants.select("company_id", "first_name", "last_name", "date_of_birth"), directors


@query("director_match", ())
def director_match(spark, d):
    applicants, directors = _applicants_and_directors(spark, d)
    pairs = J.match_directors(applicants, directors, "company_id").select("company_id", "officer_id", "first_similarity", "last_similarity", "nationalities")
    return applicants.select("company_id").join(shuffled(pairs), "company_id", "left")


@query("first_director_match", ())
def first_director_match(spark, d):
    applicants, directors = _applicants_and_directors(spark, d)
    return J.first_director(applicants, directors, "company_id").select("company_id", "officer_id", "nationalities")


@query("keyword_levels", (), """
t AS (SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT DISTINCT p_name AS phrase, CASE WHEN p_type LIKE 'E%' THEN 'High' WHEN p_type LIKE 'S%' THEN 'Medium' ELSE 'Low' END AS level FROM part
  UNION SELECT DISTINCT string_split(p_name, ' ')[1], 'Low' FROM part WHERE p_size > 25),
h AS (SELECT l_orderkey, phrase, level FROM t JOIN k ON contains(' ' || lower(text) || ' ', ' ' || lower(phrase) || ' '))
SELECT t.l_orderkey, COALESCE(array_to_string(list_sort(list_distinct(list(phrase) FILTER (phrase IS NOT NULL))), ','), '') AS keywords,
  CASE WHEN bool_or(level = 'High') THEN 'High' WHEN bool_or(level = 'Medium') THEN 'Medium' WHEN bool_or(level = 'Low') THEN 'Low' ELSE 'Undefined' END AS keyword_level
FROM t LEFT JOIN h ON t.l_orderkey = h.l_orderkey GROUP BY 1""")
def keyword_levels(spark, d):
    """Item names of each order against a keyword table that is made of the parts."""
    part = load(spark, d, "part")
    items = load(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("i"))
    texts = items.select("l_orderkey", F.array_join(F.transform("i", lambda x: x["p_name"]), " ").alias("text"))
    level = F.when(F.col("p_type").like("E%"), "High").when(F.col("p_type").like("S%"), "Medium").otherwise("Low")
    first = part.where("p_size > 25").select(F.split("p_name", " ")[0].alias("phrase"), F.lit("Low").alias("level"))
    found = J.keyword_levels(texts, "l_orderkey", "text", part.select(F.col("p_name").alias("phrase"), level.alias("level")).union(first))
    return found.select("l_orderkey", F.array_join("keywords", ",").alias("keywords"), "keyword_level")


@query("bucketed_join", (), """
SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS orders, CAST(SUM(n) AS BIGINT) AS items, ROUND(SUM(price), 2) AS price
FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(l_extendedprice) AS price FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def bucketed_join(spark, d):
    """Orders and items kept in buckets of the order: grouping the items and joining the orders move no row."""
    orders, items = bucketed_tables(spark, d)
    per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    joined = orders.join(per_order.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("n").alias("items"), F.round(F.sum("price"), 2).alias("price"))


def bucketed_tables(spark, d):
    name = f"stage_{uuid.uuid4().hex}"
    folder = f"{checkpoint_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = {"orders": ("o_orderkey", ["o_orderkey", "o_orderpriority"]), "lineitem": ("l_orderkey", ["l_orderkey", "l_extendedprice"])}
    return [write_bucketed(load(spark, d, t).select(*columns), f"{name}_{t}", key, buckets, path=f"{folder}/{t}") for t, (key, columns) in kept.items()]


@query("director_exact_match", (*_DIRECTOR_TABLES, "members"), _DOCS + """,
born AS (SELECT member_id, MIN(date_of_birth) FILTER (created_at = DATE '2023-01-02') AS dob FROM users GROUP BY 1),
person AS (SELECT b.company_id, string_split(lower(COALESCE(m.first_name, '')), ' ') AS f, string_split(lower(COALESCE(m.last_name, '')), ' ') AS l, u.dob FROM base b JOIN born u ON b.member_id = u.member_id JOIN members m ON b.company_id = m.company_id)
SELECT p.company_id, o.officer_id, o.nationalities FROM person p JOIN officer o ON p.company_id = o.company_id AND month(p.dob) = month(o.dob) AND year(p.dob) = year(o.dob)
WHERE list_has_any(list_filter(p.f, lambda x: x <> ''), string_split(o.director_first, ' ')) AND list_has_any(list_filter(p.l, lambda x: x <> ''), string_split(o.director_last, ' '))""")
def director_exact_match(spark, d):
    """The matches whose names share a whole token."""
    applicants, directors = _applicants_and_directors(spark, d)
    exact = shares_token(F.lower("first_name"), F.col("director_first")) & shares_token(F.lower("last_name"), F.col("director_last"))
    return J.match_directors(applicants, directors, "company_id").where(exact).select("company_id", "officer_id", F.array_join("nationalities", ",").alias("nationalities"))


@query("director_nationality_risk", ())
def director_nationality_risk(spark, d):
    """Declared nationalities and those of the matching officer, united, with the worst risk."""
    applicants, directors = _applicants_and_directors(spark, d)
    found = J.first_director(applicants, directors, "company_id").select("company_id", "officer_id", "nationalities")
    declared = load(spark, d, "members").select("company_id", F.split("nationality_raw", " ").alias("declared"))
    countries = literal_table(spark, [(c, r) for a, b, r in COUNTRIES for c in (a, b)], "code string, risk string")
    both = J.nationality_risk(found.join(shuffled(declared), "company_id"), ["declared", "nationalities"], countries, "company_id")
    return both.select("company_id", "officer_id", F.array_join("nationalities_all", ",").alias("nationalities"), "nationality_risk")


@query("directors_to_rows", _DIRECTOR_TABLES, _DOCS + " SELECT company_id, officer_id, director_first, director_last, CAST(dob AS VARCHAR) AS director_dob, nationalities FROM officer")
def directors_to_rows(spark, d):
    flat = J.flatten_directors(_registry(spark, d).filter("directors IS NOT NULL"), "company_id", "directors")
    return flat.select("company_id", "officer_id", "director_first", "director_last", F.col("director_dob").cast("string").alias("director_dob"),
                       F.array_join("nationalities", ",").alias("nationalities"))


@query("director_features", _DIRECTOR_TABLES, _DOCS + """,
ages AS (SELECT company_id, AVG(date_diff('day', CAST(date_trunc('month', dob) AS DATE), created_at) / 365.2425) AS age, COUNT(*) AS n FROM officer GROUP BY 1),
born AS (SELECT member_id, MIN(date_of_birth) FILTER (created_at = DATE '2023-01-02') AS dob FROM users GROUP BY 1)
SELECT b.company_id, CAST(floor(COALESCE(a.age, date_diff('day', u.dob, b.created_at) / 365.2425)) AS INTEGER) AS directors_avg_age,
  CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n >= 3 THEN '3+' ELSE 'Undefined' END AS directors_level FROM base b LEFT JOIN ages a ON b.company_id = a.company_id JOIN born u ON b.member_id = u.member_id""")
def director_features(spark, d):
    docs = _registry(spark, d)
    users = load(spark, d, "users").groupBy("member_id").agg(F.min_by("date_of_birth", "created_at").alias("date_of_birth"))
    applicants = docs.join(shuffled(users), "member_id").select("company_id", "created_at", "date_of_birth")
    directors = J.flatten_directors(docs.filter("directors IS NOT NULL"), "company_id", "directors")
    return J.director_features(applicants, directors, "company_id").select("company_id", "directors_avg_age", "directors_level")


@query("semi_anti_join", (), """
SELECT c_mktsegment, CAST(SUM(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 1 ELSE 0 END) AS BIGINT) AS with_pending,
  CAST(SUM(CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 1 ELSE 0 END) AS BIGINT) AS without_pending
FROM customer GROUP BY 1""")
def semi_anti_join(spark, d):
    c = load(spark, d, "customer")
    pending = load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    semi, anti = c.join(pending, "c_custkey", "left_semi"), c.join(pending, "c_custkey", "left_anti")
    both = semi.withColumn("hit", F.lit(1)).unionByName(anti.withColumn("hit", F.lit(0)))
    return both.groupBy("c_mktsegment").agg(F.sum("hit").alias("with_pending"), F.sum(1 - F.col("hit")).alias("without_pending"))


@query("group_aggregates", (), """
SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_discount), 6) AS mean_discount,
  MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY 1, 2""")
def group_aggregates(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean_discount"),
        F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("global_aggregate", ("applications",), """
SELECT CAST(MIN(created_on) AS VARCHAR) AS first_day, CAST(MAX(created_on) AS VARCHAR) AS last_day, ROUND(AVG(is_approved), 6) AS approval_rate,
  CAST(SUM(is_approved) AS BIGINT) AS approved FROM applications""")
def global_aggregate(spark, d):
    return load(spark, d, "applications").agg(F.min("created_on").cast("string").alias("first_day"), F.max("created_on").cast("string").alias("last_day"),
                                              F.round(F.avg("is_approved"), 6).alias("approval_rate"), F.sum("is_approved").alias("approved"))


@query("conditional_aggregate", (), """
SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, MAX(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS max_pending,
  ROUND(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_amount FROM orders GROUP BY 1""")
def conditional_aggregate(spark, d):
    s = F.col("o_orderstatus")
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count_if(s == "F").alias("done"), F.max(F.when(s == "P", F.col("o_totalprice"))).alias("max_pending"),
        F.round(F.sum(F.when(s == "O", F.col("o_totalprice")).otherwise(0.0)), 2).alias("open_amount"))


@query("distinct_count_less_one", (), """
SELECT o_custkey, CAST(COUNT(DISTINCT CAST(o_orderdate AS DATE)) - 1 AS BIGINT) AS other_days FROM orders GROUP BY 1""")
def distinct_count_less_one(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.count_distinct(F.to_date("o_orderdate")) - 1).alias("other_days"))


@query("distinct_list", (), """
SELECT l_orderkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, CAST(COUNT(DISTINCT p_type) AS BIGINT) AS n_types
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def distinct_list(spark, d):
    pairs = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type")
    kinds = pairs.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))
    return kinds.select("l_orderkey", F.array_join("kinds", ",").alias("types"), F.size("kinds").cast("bigint").alias("n_types"))


@query("distinct_rows", (), "SELECT DISTINCT sortcode, bank_name FROM (SELECT CAST(s_nationkey AS VARCHAR) AS sortcode, upper(trim(' ' || s_name || ' ')) AS bank_name FROM supplier)")
def distinct_rows(spark, d):
    return load(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sortcode"), F.upper(F.trim(F.concat(F.lit(" "), "s_name", F.lit(" ")))).alias("bank_name")).distinct()


@query("first_per_key", (), """
SELECT l_orderkey, l_partkey, l_suppkey, ROUND(l_extendedprice, 2) AS price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def first_per_key(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    one = N.pick_one(li, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], largest=False)
    return one.select("l_orderkey", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))


@query("duplicate_count", (), """
SELECT CAST(COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem""")
def duplicate_count(spark, d):
    return A.duplicate_count(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("value_shares", ("applications",), "SELECT industry, CAST(COUNT(*) AS BIGINT) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM applications GROUP BY 1")
def value_shares(spark, d):
    return A.value_shares(load(spark, d, "applications"), "industry").withColumn("share", F.round("share", 6))


_NULLABLE = ["idcountry_raw", "nationality_raw", "postcode_raw", "device_raw", "first_name", "last_name", "sic_raw", "icc_raw", "company_type_raw", "triggers_raw", "days_to_app_fraud"]


@query("null_shares", ("members",), " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls, ROUND((COUNT(*) - COUNT({c})) / COUNT(*), 6) AS share FROM members" for c in _NULLABLE))
def null_shares(spark, d):
    return A.null_shares(load(spark, d, "members"), _NULLABLE).withColumn("share", F.round("share", 6))


@query("describe_amounts", ("applications",), """
x AS (SELECT quantile_cont(app_fraud_amount, [""" + ", ".join(str(i / 100) for i in range(101)) + """]) AS q FROM applications WHERE app_fraud_amount > 0)
SELECT i / 100 AS p, ROUND(q[i + 1], 4) AS value FROM x, range(101) t(i)""")
def describe_amounts(spark, d):
    a = load(spark, d, "applications").filter("app_fraud_amount > 0")
    return A.describe(a, "app_fraud_amount", [i / 100 for i in range(101)], buckets=16).withColumn("value", F.round("value", 4))


@query("medians", ("members",), "SELECT 'years_to_id_expiry' AS feature, median(years_to_id_expiry) AS median FROM members UNION ALL SELECT 'company_age_months', median(company_age_months) FROM members")
def medians(spark, d):
    # Small integer domains: the exact percentile buffer holds one entry per distinct value.
    wide = load(spark, d, "members").agg(F.percentile("years_to_id_expiry", F.lit(0.5)).alias("years_to_id_expiry"), F.percentile("company_age_months", F.lit(0.5)).alias("company_age_months"))
    return wide.unpivot([], ["years_to_id_expiry", "company_age_months"], "feature", "median")


@query("weighted_mean_std", ("applications",), """
m AS (SELECT industry, SUM(declared_amount * score) / SUM(declared_amount) AS mean FROM applications GROUP BY 1)
SELECT a.industry, ROUND(MIN(m.mean), 6) AS mean, ROUND(SQRT(SUM(declared_amount * (score - m.mean) * (score - m.mean)) / SUM(declared_amount)), 6) AS std
FROM applications a JOIN m USING (industry) GROUP BY 1""")
def weighted_mean_std(spark, d):
    out = A.weighted_mean_std(load(spark, d, "applications"), "score", "declared_amount", ["industry"])
    return out.select("industry", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("weighted_quantile", ("applications",), f"""
v AS (SELECT CAST(balance AS DOUBLE) AS v, SUM(declared_amount) AS w FROM applications WHERE balance IS NOT NULL GROUP BY 1),
p AS (SELECT v, (SUM(w) OVER (ORDER BY v) - w / 2) / SUM(w) OVER () AS pos FROM v),
q AS (SELECT unnest({PROBS}) AS q),
b AS (SELECT q, MAX(v) FILTER (pos <= q) AS v0, MAX(pos) FILTER (pos <= q) AS p0, MIN(v) FILTER (pos >= q) AS v1, MIN(pos) FILTER (pos >= q) AS p1 FROM p, q GROUP BY q),
r AS (SELECT DISTINCT CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (q - p0) / (p1 - p0) END AS value FROM b)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS place, ROUND(value, 4) AS value FROM r""")
def weighted_quantile(spark, d):
    return A.weighted_quantile_table(load(spark, d, "applications"), "balance", "declared_amount", PROBS, buckets=8).withColumn("value", F.round("value", 4))


@query("share_of_total", ("applications",), """
SELECT region, ROUND(SUM(is_app_fraud) / SUM(SUM(is_app_fraud)) OVER (), 6) AS is_app_fraud_share,
  ROUND(SUM(app_fraud_amount) / SUM(SUM(app_fraud_amount)) OVER (), 6) AS app_fraud_amount_share FROM applications GROUP BY 1""")
def share_of_total(spark, d):
    out = A.share_of_total(load(spark, d, "applications"), ["region"], ["is_app_fraud", "app_fraud_amount"])
    return out.select("region", *(F.round(c, 6).alias(c) for c in ["is_app_fraud_share", "app_fraud_amount_share"]))


@query("month_pivot", (), """
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, """ + ", ".join(
    f"ROUND(100.0 * SUM(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END) / COUNT(*), 2) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def month_pivot(spark, d):
    return A.percent_pivot(load(spark, d, "orders").withColumn("year_month", F.date_format("o_orderdate", "yyyy-MM")), "year_month", "o_orderstatus", ["F", "O", "P"])


@query("cross_tab", (), """
SELECT l_returnflag, """ + ", ".join(f"CAST(SUM(CASE WHEN l_linestatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{s}\"" for s in "FO") + " FROM lineitem GROUP BY 1")
def cross_tab(spark, d):
    return A.cross_tab(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


_A, _B, _C = "keyword_present = 1", "failed_rules >= 3", "score >= 700"


def _rate(condition: str, name: str) -> str:
    return f"SELECT '{name}' AS measure, ROUND(AVG(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END), 6) AS rate FROM members"


@query("system_overlap", ("members",), " UNION ALL ".join([
    _rate(_A, "a"), _rate(_B, "b"), _rate(_C, "c"), _rate(f"{_A} OR {_B}", "a_or_b"), _rate(f"{_A} AND {_B}", "a_and_b"), _rate(f"{_A} OR {_C}", "a_or_c"),
    _rate(f"{_A} AND {_C}", "a_and_c"), _rate(f"{_B} OR {_C}", "b_or_c"), _rate(f"{_B} AND {_C}", "b_and_c"), _rate(f"{_A} OR {_B} OR {_C}", "any")]))
def system_overlap(spark, d):
    return A.overlap_rates(load(spark, d, "members"), {"a": F.expr(_A), "b": F.expr(_B), "c": F.expr(_C)}).withColumn("rate", F.round("rate", 6))


FEATURES = ["applicant_id_type", "company_icc", "applicant_country", "country_risk", "company_type", "email_domain", "structure_level", "keyword_present", "failed_rules"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, is_app_fraud, app_fraud_amount FROM members WHERE is_approved = 1" for f in FEATURES) + ")"


@query("group_by_each_feature", ("members",), _LONG + """
SELECT feature, value, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(is_app_fraud) AS BIGINT) AS positives, ROUND(AVG(is_app_fraud), 6) AS rate,
  ROUND(SUM(app_fraud_amount), 2) AS amount, ROUND(AVG(app_fraud_amount), 4) AS mean_amount FROM long GROUP BY 1, 2""")
def group_by_each_feature(spark, d):
    out = A.rates_by_each_feature(load(spark, d, "members").filter("is_approved = 1"), FEATURES, "is_app_fraud", "app_fraud_amount")
    return out.withColumns({"rate": F.round("rate", 6), "amount": F.round("amount", 2), "mean_amount": F.round("mean_amount", 4)})


@query("top_n_categories", ("members",), _LONG + """
SELECT feature, value, n, positives, place FROM (SELECT feature, value, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(is_app_fraud) AS BIGINT) AS positives,
  CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY SUM(is_app_fraud) DESC, value) AS INTEGER) AS place FROM long GROUP BY 1, 2) WHERE place <= 3""")
def top_n_categories(spark, d):
    return A.top_values(load(spark, d, "members").filter("is_approved = 1"), FEATURES, "is_app_fraud", "positives", 3).drop("rate")


@query("top_k_or_other", (), """
kept AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, p_brand LIMIT 5)
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM kept) THEN p_brand ELSE 'other' END AS brand, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY 1""")
def top_k_or_other(spark, d):
    return A.top_k_or_other(load(spark, d, "part"), "p_brand", 5, "brand").groupBy("brand").agg(F.count("*").alias("n"))


@query("ranked_ties_kept", (), "SELECT o_custkey, o_orderkey FROM (SELECT *, RANK() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS r FROM orders) WHERE r = 1")
def ranked_ties_kept(spark, d):
    return N.keep_first_ranked(load(spark, d, "orders"), ["o_custkey"], [F.to_date("o_orderdate").desc()]).select("o_custkey", "o_orderkey")


@query("earliest_per_key", (), "SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def earliest_per_key(spark, d):
    return N.pick_one(load(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], largest=False).select("user_id", "event_id", "event_type")


@query("newest_row_per_key", (), "SELECT conv_id, turn, role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations) WHERE r = 1")
def newest_row_per_key(spark, d):
    return N.keep_first_row(load(spark, d, "conversations"), ["conv_id"], [F.col("turn").desc(), F.col("role")]).select("conv_id", "turn", "role")


@query("running_percent", ("applications",), """
v AS (SELECT balance, SUM(is_app_fraud) AS y, SUM(app_fraud_amount) AS a FROM applications GROUP BY 1)
SELECT balance, ROUND(100.0 * SUM(y) OVER (ORDER BY balance) / SUM(y) OVER (), 6) AS cum_is_app_fraud_pct,
  ROUND(100.0 * SUM(a) OVER (ORDER BY balance) / SUM(a) OVER (), 6) AS cum_app_fraud_amount_pct FROM v""")
def running_percent(spark, d):
    out = N.running_percent(load(spark, d, "applications"), "balance", ["is_app_fraud", "app_fraud_amount"], buckets=8)
    return out.select("balance", F.round("cum_is_app_fraud_pct", 6).alias("cum_is_app_fraud_pct"), F.round("cum_app_fraud_amount_pct", 6).alias("cum_app_fraud_amount_pct"))


@query("max_rank", (), """
v AS (SELECT p_size, COUNT(*) AS n FROM part GROUP BY 1)
SELECT p_size, CAST(SUM(n) OVER (ORDER BY p_size DESC) AS BIGINT) AS place FROM v""")
def max_rank(spark, d):
    return N.max_rank(load(spark, d, "part"), "p_size", name="place")


@query("equal_weight_bins", ("applications",), """
v AS (SELECT balance, SUM(declared_amount) AS w, COUNT(*) AS n FROM applications GROUP BY 1),
c AS (SELECT balance, n, SUM(w) OVER (ORDER BY balance DESC) AS cw, SUM(w) OVER () AS tw FROM v)
SELECT CAST(GREATEST(0, CEIL(ROUND(cw * 10 / tw, 9)) - 1) AS INTEGER) AS bin, CAST(SUM(n) AS BIGINT) AS n, MIN(balance) AS low, MAX(balance) AS high FROM c GROUP BY 1""")
def equal_weight_bins(spark, d):
    bins = N.equal_weight_bins(load(spark, d, "applications"), "balance", "declared_amount", 10, {"n": F.count(F.lit(1))}, buckets=8)
    return bins.groupBy("bin").agg(F.sum("n").alias("n"), F.min("balance").alias("low"), F.max("balance").alias("high"))


@query("qcut_bins", ("members",), """
e AS (SELECT list_sort(list_distinct(quantile_cont(declared_amount, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM members)
SELECT bin, CAST(COUNT(*) AS BIGINT) AS n, ROUND(MIN(declared_amount), 2) AS low, ROUND(MAX(declared_amount), 2) AS high
FROM (SELECT declared_amount, CAST(GREATEST(0, len(list_filter(q, lambda x: x < declared_amount)) - 1) AS INTEGER) AS bin FROM members, e) GROUP BY 1""")
def qcut_bins(spark, d):
    binned = N.quantile_bins(load(spark, d, "members"), "declared_amount", 5, buckets=8)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("declared_amount"), 2).alias("low"), F.round(F.max("declared_amount"), 2).alias("high"))


@query("time_folds", ("applications",), """
p AS (SELECT company_id, created_on, ROW_NUMBER() OVER (ORDER BY created_on, company_id % 16, company_id) - 1 AS pos, COUNT(*) OVER () AS n FROM applications),
f AS (SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM p)
SELECT CAST(fold AS INTEGER) AS fold, CAST(COUNT(*) AS BIGINT) AS n, CAST(MIN(created_on) AS VARCHAR) AS first_day, CAST(MAX(created_on) AS VARCHAR) AS last_day,
  CAST(SUM(company_id) AS BIGINT) AS key_sum FROM f GROUP BY 1""")
def time_folds(spark, d):
    folds = N.time_folds(load(spark, d, "applications").select("company_id", "created_on"), "created_on", "company_id", within=F.col("company_id") % 16)
    return folds.groupBy("fold").agg(F.count("*").alias("n"), F.min("created_on").cast("string").alias("first_day"),
                                     F.max("created_on").cast("string").alias("last_day"), F.sum("company_id").alias("key_sum"))


@query("sorted_top_orders", (), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sorted_top_orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("sample_rows", (), """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-111'), 1, 4) < '028f'""")
def sample_rows(spark, d):
    # one row in a hundred by a hash of its key: the same rows however the table is partitioned
    drawn = F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", F.lit("111"))), 1, 4) < "028f"
    return load(spark, d, "lineitem").filter(drawn).select("l_orderkey", "l_linenumber", "l_quantity")


@query("argmax_column", ("members",), """
SELECT company_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS top FROM (SELECT company_id, score / 1000 AS a, company_age_months / 48 AS b, age_at_completion / 67 AS c FROM members)""")
def argmax_column(spark, d):
    parts = {"a": F.col("score") / 1000, "b": F.col("company_age_months") / 48, "c": F.col("age_at_completion") / 67}
    # Ties go to the first column: rank the columns downwards inside the compared struct.
    ranked = F.array(*(F.struct(v.alias("v"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, v) in enumerate(parts.items())))
    return load(spark, d, "members").select("company_id", F.array_max(ranked).getField("name").alias("top"))


@query("union_distinct", (), "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_distinct(spark, d):
    return (load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
            .union(load(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey")).distinct())


@query("union_all_by_name", ("applications",), """
SELECT split, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(is_app_fraud) AS BIGINT) AS frauds FROM (SELECT data_type AS split, is_app_fraud FROM applications
  UNION ALL SELECT 'all', is_app_fraud FROM applications) GROUP BY 1""")
def union_all_by_name(spark, d):
    a = load(spark, d, "applications").select(F.col("data_type").alias("split"), "is_app_fraud")
    return a.unionByName(a.withColumn("split", F.lit("all"))).groupBy("split").agg(F.count("*").alias("n"), F.sum("is_app_fraud").alias("frauds"))


@query("intersect_except", (), """
SELECT 'both' AS part, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'only_p', CAST(COUNT(*) AS BIGINT) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def intersect_except(spark, d):
    o = load(spark, d, "orders")
    p, f = o.filter("o_orderstatus = 'P'").select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey")
    return (p.intersect(f).agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n")
            .union(p.subtract(f).agg(F.count("*").alias("n")).select(F.lit("only_p").alias("part"), "n")))


TERMS = ["purchase", "impersonation", "investment", "advance", "romance", "invoice", "ceo", "2nd", "unknown"]


@query("binary_terms", ("tickets",), "SELECT ticket_key, " + ", ".join(
    f"CASE WHEN list_contains(regexp_extract_all(lower(fraud_type), '[a-z0-9_]+'), '{t}') THEN 1 ELSE 0 END AS \"{t}\"" for t in TERMS) + " FROM tickets WHERE fraud_type IS NOT NULL")
def binary_terms(spark, d):
    from gatewise.functions.scalars import term_flags
    t = load(spark, d, "tickets").filter("fraud_type IS NOT NULL")
    return t.select("ticket_key", *(c.alias(n) for n, c in term_flags("fraud_type", TERMS).items()))


@query("set_sizes", ("members",), f"""
SELECT CAST(SUM(CASE WHEN {_A} THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(SUM(CASE WHEN {_A} AND {_B} THEN 1 ELSE 0 END) AS BIGINT) AS both,
  CAST(SUM(CASE WHEN {_A} OR {_B} THEN 1 ELSE 0 END) AS BIGINT) AS either FROM members""")
def set_sizes(spark, d):
    a, b = F.expr(_A), F.expr(_B)
    return load(spark, d, "members").agg(F.sum(flag(a)).alias("a"), F.sum(flag(a & b)).alias("both"), F.sum(flag(a | b)).alias("either"))
