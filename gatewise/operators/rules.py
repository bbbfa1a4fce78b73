"""Risk rules as Boolean columns, and one-scan measurement of many rules, values and value pairs.

A rule set is expanded to (rule, hit) rows inside each task and combined there, so N rules cost one scan and a shuffle
of a few rows per task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from gatewise.functions.scalars import all_of, any_of, contains_any, flag
from gatewise.operators.aggregates import long_features
from gatewise.operators.encoders import risky_categories
from gatewise.operators.joins import with_membership
from gatewise.operators.windows import cumulative_by_value
from gatewise.session import cut_lineage

# Country codes and term lists of the hand-written rules.
RUSSIA, UKRAINE, BELARUS = ["RU", "RUS"], ["UA", "UKR"], ["BY", "BLR"]
ROMANIA, PORTUGAL, BRITAIN = ["RO", "ROU"], ["PT", "PRT"], ["GB", "GBR"]
ROMANIA_POSTCODES = ["E", "B", "IP", "IG", "ST", "CV", "PR1", "PR2"]
ROMANIA_INDUSTRIES = ["category.construction", "category.cleaner", "category.transport_and_storage", "category.decorator_&_painter", "category.painter_&_decorator",
                      "category.furniture_removal", "category.domestic_cleaner", "category.household_cleaning_services", "category.industrial_cleaning_services",
                      "category.hygiene_and_cleansing_services", "category.carpenter_/_carpentry", "category.plumbing_/_plumber", "category.builder"]
ROMANIA_SIC = ["59111", "96090", "59112", "59200", "74209", "74202", "74201"]
PORTUGAL_POSTCODES = ["M3", "M6", "M7", "M8", "G20", "G21", "G22", "G31", "G51", "ML1", "PA1"]
BANK_NAME_TERMS = ["bank", "banking", "banker"]
BANK_INDUSTRY = "category.bank_(the_business_you_own_is_a_bank)"
BANK_SIC = ["64191", "64110"]
PROHIBITED_NATIONALITIES = ["AF", "AFG", "GN", "GIN", "ML", "MLI", "SS", "SSD", "GW", "GNB", "BY", "BLR", "MM", "MMR", "SD", "SDN", "BA", "BIH", "IR", "IRN",
                            "RU", "RUS", "UA", "UKR", "KP", "PRK", "SY", "SYR", "BI", "BDI", "IQ", "IRQ", "NI", "NIC", "VE", "VEN", "CF", "CAF", "LB", "LBN",
                            "YE", "YEM", "CD", "COD", "LY", "LBY", "SO", "SOM", "ZW", "ZWE"]
# Check codes grouped into trigger flags.
TRIGGER_GROUPS = {
    "individual_blocklist": ["bl001", "bl002", "bl004", "bl005", "bl006", "bl007", "bl008"],
    "individual_identity_address": ["applicant_address_fail"],
    "individual_sanctions_pep": ["applicant_pep", "sanction_fail"],
    "individual_id_scan": ["facematch_verification_failed", "id_scan_images_download_failed", "id_scan_verification_failed", "idscan_mismatch"],
    "business_internal_checks": ["missing_country_shareholder", "director_mismatch", "missing_number_or_name_registered_address", "missing_shareholder", "missing_sic_codes"],
}


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def country_is(column: str, codes: list[str], quirk: bool = False) -> Column:
    """Exact code match. ``quirk=True`` repeats the substring test in which ``BY`` also hits ``LBY``."""
    upper = F.upper(_text(column))
    return any_of([upper.contains(c) for c in codes]) if quirk else upper.isin(codes)


def starts_with_any(column: str, prefixes: list[str]) -> Column:
    return any_of([F.startswith(_text(column), F.lit(p)) for p in prefixes])


def has_any(column: str, terms: list[str]) -> Column:
    return any_of([_text(column).contains(t) for t in terms])


def hand_rules(quirk: bool = False) -> dict[str, Column]:
    """The row rules over the raw member frame."""
    known_first, known_last = (F.coalesce(F.length(F.col(c)) > 0, F.lit(False)) for c in ("first_name", "last_name"))
    kind = _text("company_type_raw")
    romania = all_of([country_is("idcountry_raw", ROMANIA, quirk), has_any("id_type_raw", ["PASSPORT"]),
                      F.col("company_type_raw").isNull() | kind.contains("LTD") | kind.contains("null") | kind.contains("None"),
                      starts_with_any("postcode_raw", ROMANIA_POSTCODES) | has_any("icc_raw", ROMANIA_INDUSTRIES) | has_any("sic_raw", ROMANIA_SIC)])
    portugal = all_of([country_is("idcountry_raw", PORTUGAL, quirk), has_any("id_type_raw", ["PASSPORT", "ID_CARD"]), F.col("is_registered") == 1,
                       starts_with_any("postcode_raw", PORTUGAL_POSTCODES), F.lower(_text("email_raw")).contains("@gmail.com"), F.lower(_text("device_raw")).contains("ios")])
    name, icc = F.lower(_text("trading_name_raw")), F.lower(_text("icc_raw"))
    bank = any_of([name.contains(t) for t in BANK_NAME_TERMS] + [icc.contains(BANK_INDUSTRY)] + [_text("sic_raw").contains(s) for s in BANK_SIC])
    missing_subtype = F.col("id_subtype_raw").isNull() | F.col("id_subtype_raw").isin("none", "None", "null")
    provisional = (F.col("id_type_raw") == "DRIVING_LICENSE") & (
        F.coalesce(F.col("id_subtype_raw") == "LEARNING_DRIVING_LICENSE", F.lit(False)) | (_text("idcountry_raw").isin(BRITAIN) & missing_subtype))
    return {
        "single_name": known_first != known_last,
        "animal_breeder": icc.contains("animal_breeder"),
        "country_russia": country_is("idcountry_raw", RUSSIA, quirk),
        "country_ukraine": country_is("idcountry_raw", UKRAINE, quirk),
        "country_belarus": country_is("idcountry_raw", BELARUS, quirk),
        "country_romania": romania,
        "country_portugal": portugal,
        "company_bank": bank,
        "provisional_licence": provisional,
        "residence_permit": (F.col("id_type_raw") == "ID_CARD") & (F.col("id_subtype_raw") == "RESIDENT_PERMIT_ID"),
        "prohibited_nationality": F.arrays_overlap(F.split(_text("nationality_raw"), " "), F.array(*map(F.lit, PROHIBITED_NATIONALITIES))),
    }


def with_rule_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """0/1 columns per rule, whether any fired, and how many did (the any-flag itself is not counted)."""
    out = df.withColumns({n: flag(c) for n, c in rules.items()})
    names = list(rules)
    return out.withColumns({"any_rule": F.greatest(*names) if len(names) > 1 else F.col(names[0]), "rule_count": sum((F.col(n) for n in names), F.lit(0))})


def trigger_flags(column: str) -> dict[str, Column]:
    """Grouped check flags: a group is set when any of its codes occurs."""
    return {group: F.coalesce(contains_any(column, codes), F.lit(0)) for group, codes in TRIGGER_GROUPS.items()}


def failed_rule_count(parts: list[Column], most: int = 5) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0), sum(parts, F.lit(0))))


# Lists of the fifteen named rules.
RULE1_COUNTRIES = ["PT", "SK", "HU", "SE", "BG", "RO", "ES", "PK", "IN", "CZ", "TW", "DK", "MT", "CH", "GM", "JM", "MD", "JO", "DZ", "CM"]
RULE1_ID_TYPES = ["National_ID", "Other_ID"]
RULE2_INDUSTRIES = [
    "category.wholesale_of_machines_&_equipment", "category.bailiff", "category.agricultural_contractors", "category.boot_&_shoe_shop",
    "category.bathroom_&_kitchen_design", "category.demolition", "category.watch_&_clock_shop_(including_repair)", "category.carpet_fitter",
    "category.ceiling_contractors", "category.hygiene_and_cleansing_services", "category.sunglasses_shop", "category.knitted_garment_maker",
    "category.cooking_&_ironing_services", "category.appliance_repair_shop", "category.wine_shop", "category.appliances_shop",
    "category.swimming_pool_installers", "category.cookery_shop_/_cooking_ingredients", "category.metalworker", "category.tour_guide",
    "category.timber_preservation", "category.rendering", "category.kitchen_storage", "category.bakery_(factory)", "category.amusement_arcade",
    "category.insurance_agent_/_broker", "category.washing_machine_repairs_&_servicing_shop", "category.frozen_food_shop",
    "category.exhibition_stand_erector", "category.sewing_machine_shop_/_sewing_supplies", "category.personal_training_shop", "category.barrister",
    "category.conservatory_installers", "category.water_freight_transport", "category.pedicurist_&_manicurist", "category.shed_&_carport_erector",
    "category.textile_shop", "category.body_artist_shop", "category.insurance_motor_vehicle_inspector", "category.data_removal",
    "category.decorators_supplies", "category.web_cafe", "category.milkman", "category.furnisher", "category.patent_agent", "category.preacher",
    "category.cladding_removal", "category.fascia_/_guttering_installation", "category.manufacturing,_processing_&_machining_of_ceramics", "category.tobacco"]
RULE12_INDUSTRIES = ["category.construction", "category.domestic_cleaner", "category.cleaner", "category.household_cleaning_services",
                     "category.transport_and_storage", "category.industrial_cleaning_services"]
RULE13_ID_TYPES = ["Other_ID", "Provisional_Licence", "Undefined"]
RULE13_COUNTRIES = ["GB", "RO", "IN", "PT", "SK"]
RULE13_INDUSTRIES = ["category.construction", "category.builder", "category.cleaner", "category.transport_and_storage", "category.household_cleaning_services"]
RULE14_POSTCODES = ["B", "E", "M", "CV", "IG", "N", "LS", "SE", "IP", "NE"]
RULE15_STATUSES = ["Liquidation", "Dissolved", "Undefined"]

LEARNED_FEATURES = ["company_icc", "applicant_nationality", "applicant_country"]


def with_learned_flags(df: DataFrame, ratios: DataFrame, features: list[str] = LEARNED_FEATURES) -> DataFrame:
    """``<feature>_risky`` flags for categories whose fraud ratio was learned to be high."""
    ratios = cut_lineage(ratios.filter(F.col("risky") == 1))
    for f in features:
        df = with_membership(df, risky_categories(ratios, f), [f], f"{f}_risky")
    return df


def named_rules() -> dict[str, Column]:
    """The fifteen rules over features and learned lists (``with_learned_flags`` supplies the latter)."""
    c = F.col
    risky_industry, address = c("company_icc_risky") == 1, c("identity_address_fail") == 1
    return {
        "risky_country_young_id": c("applicant_country").isin(RULE1_COUNTRIES) & (c("age_at_completion") <= 30) & c("applicant_id_type").isin(RULE1_ID_TYPES),
        "listed_industry_young": c("company_icc").isin(RULE2_INDUSTRIES) & (c("age_at_completion") <= 25),
        "industry_address_internal": risky_industry & address & (c("internal_check_fail") == 1),
        "industry_rules_address": risky_industry & (c("failed_rules") >= 2) & address,
        "industry_address": risky_industry & address,
        "industry_young_directors_keyword": risky_industry & (c("directors_avg_age") <= 26) & (c("keyword_present") == 1),
        "expiry_young_directors_sanctions": (c("years_to_id_expiry") <= 5) & (c("directors_avg_age") <= 25) & (c("sanctions_fail") == 1),
        "email_nationality_expiry": (c("email_numeric") == 1) & (c("applicant_nationality_risky") == 1) & (c("years_to_id_expiry") >= 5),
        "risky_email": (c("email_numeric") == 1) & (c("email_domain") == "outlook.com"),
        "young_and_new": (c("age_at_completion") <= 20) & (c("company_age_months") <= 1),
        "sole_trader_risky_country": (c("company_type") == "sole-trader") & (c("country_risk") == "High"),
        "industry_and_romania": c("company_icc").isin(RULE12_INDUSTRIES) & (c("applicant_country") == "RO"),
        "id_country_industry": c("applicant_id_type").isin(RULE13_ID_TYPES) & c("applicant_country").isin(RULE13_COUNTRIES) & c("company_icc").isin(RULE13_INDUSTRIES),
        "postcode_address_industry": c("postcode_area").isin(RULE14_POSTCODES) & address & c("company_icc").isin(RULE13_INDUSTRIES),
        "status_industry_country": c("company_status").isin(RULE15_STATUSES) & risky_industry & (c("applicant_country_risky") == 1),
    }


# ---- measurement -------------------------------------------------------------------------------------------------

def _counts(label: str, amount: str) -> list[Column]:
    hit = F.col(label) == 1
    return [F.count("*").alias("n"), F.sum(flag(hit)).alias("y"), F.sum(F.when(hit, F.col(amount)).otherwise(0.0)).alias("ya")]


def confusion_measures(n: Column, y: Column, ya: Column, all_n: Column, all_y: Column, all_ya: Column) -> dict[str, Column]:
    """Measures of a condition that selects ``n`` rows with ``y`` positives worth ``ya``, against the totals."""
    return {
        "size": n, "frauds": y, "frame_frauds": all_y, "fraud_rate": F.try_divide(100.0 * y, n), "precision": F.try_divide(y, n), "recall": F.try_divide(y, all_y),
        "recall_value": F.try_divide(ya, all_ya), "f1": F.try_divide(2 * y, n + all_y), "false_positive_rate": F.try_divide(n - y, all_n - all_y),
        "tp": y, "fp": n - y, "fn": all_y - y, "tn": all_n - all_y - (n - y)}


def _with_totals(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per feature (or pair) from the grouped rows: no second scan; one row per feature is safe to broadcast."""
    totals = grouped.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum("y").alias("all_y"), F.sum("ya").alias("all_ya"))
    return grouped.join(F.broadcast(totals), keys)


def _measured(df: DataFrame, keep: list[str]) -> DataFrame:
    c = F.col
    return df.select(*keep, *(m.alias(k) for k, m in confusion_measures(c("n"), c("y"), c("ya"), c("all_n"), c("all_y"), c("all_ya")).items()))


def univariate_rules(df: DataFrame, features: list[str], label: str, amount: str) -> DataFrame:
    """Every feature value as a rule. Complements come from totals, so no row is copied per value."""
    grouped = long_features(df, features, [label, amount]).groupBy("feature", "value").agg(*_counts(label, amount))
    return _measured(_with_totals(grouped, ["feature"]).filter(F.col("value").isNotNull()), ["feature", "value"])


def bivariate_rules(df: DataFrame, features: list[str], label: str, amount: str) -> DataFrame:
    """Every value pair of every feature pair that occurs, as a rule."""
    pairs = F.array(*(F.struct(F.lit(a).alias("feature1"), F.col(a).cast("string").alias("value1"), F.lit(b).alias("feature2"), F.col(b).cast("string").alias("value2"))
                      for a, b in combinations(features, 2)))
    keys = ["feature1", "value1", "feature2", "value2"]
    long = df.select(label, amount, F.explode(pairs).alias("_p")).select(label, amount, "_p.*")
    grouped = long.groupBy(*keys).agg(*_counts(label, amount))
    whole = _with_totals(grouped, ["feature1", "feature2"])
    return _measured(whole.filter(F.col("value1").isNotNull() & F.col("value2").isNotNull()), keys)


def threshold_grid(df: DataFrame, first: str, second: str, first_limits: list[int], second_limits: list[int], label: str, amount: str) -> DataFrame:
    """Rules ``first <= a and second <= b`` for a grid of consecutive whole limits, in one pass.

    Rows are counted per grid cell; each cell then adds to the limits at or above it. Rows beyond the grid only count in
    the totals. Rows with a NULL in either column are left out. Limits with gaps raise.
    """
    for limits in (first_limits, second_limits):
        if sorted(limits) != list(range(min(limits), max(limits) + 1)):
            raise ValueError(f"limits must be consecutive whole numbers: {limits}")
    hi1, hi2 = max(first_limits), max(second_limits)

    def cell(c: str, limits: list[int]) -> Column:
        return F.greatest(F.lit(min(limits)), F.least(F.lit(max(limits) + 1), F.ceil(c).cast("int")))
    cells = (df.select(first, second, label, amount).dropna().groupBy(cell(first, first_limits).alias("a"), cell(second, second_limits).alias("b"))
             .agg(*_counts(label, amount)))
    totals = cells.agg(F.struct(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("ya").alias("ya"))).scalar()
    inside = cells.filter((F.col("a") <= hi1) & (F.col("b") <= hi2))
    spread = inside.withColumn("a", F.explode(F.sequence("a", F.lit(hi1)))).withColumn("b", F.explode(F.sequence("b", F.lit(hi2))))
    grid = spread.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("ya").alias("ya")).withColumn("_t", totals)
    grid = grid.withColumns({"all_n": F.col("_t.n"), "all_y": F.col("_t.y"), "all_ya": F.col("_t.ya")})
    return _measured(grid.withColumnsRenamed({"a": "first_limit", "b": "second_limit"}), ["first_limit", "second_limit"])


def rule_metrics(df: DataFrame, rules: dict[str, Column], label: str, amount: str) -> DataFrame:
    """Alerts, alert rate, precision, recall by member and amount, false-positive rate and confusion per rule."""
    hits = F.array(*(F.struct(F.lit(n).alias("rule"), flag(c).alias("hit")) for n, c in rules.items()))
    long = df.select(label, amount, F.explode(hits).alias("_h")).select(label, amount, "_h.*")
    fraud, fired = F.col(label) == 1, F.col("hit") == 1
    grouped = long.groupBy("rule").agg(
        F.count_if(fired).alias("n"), F.count_if(fired & fraud).alias("y"), F.sum(F.when(fired & fraud, F.col(amount)).otherwise(0.0)).alias("ya"),
        F.count("*").alias("all_n"), F.count_if(fraud).alias("all_y"), F.sum(F.when(fraud, F.col(amount)).otherwise(0.0)).alias("all_ya"))
    return _measured(grouped.filter(F.col("n") > 0).withColumn("alert_rate", 100.0 * F.col("n") / F.col("all_n")).withColumn("records", F.col("all_n")),
                     ["rule", "records", "alert_rate"])


def rule_table(df: DataFrame, rules: dict[str, Column], label: str = "is_app_fraud", amount: str = "app_fraud_amount", approved: str = "is_approved") -> DataFrame:
    """Rules measured over approved (km) and all registered (rm) members; rejected members count as fraud. One scan."""
    hits = F.array(*(F.struct(F.lit(n).alias("rule"), flag(c).alias("hit")) for n, c in rules.items()))
    long = df.select(label, amount, approved, F.explode(hits).alias("_h")).select(label, amount, approved, "_h.*")
    km, fired = F.col(approved) == 1, F.col("hit") == 1
    fraud = ~km | (F.col(label) == 1)
    value = F.when(km & fraud, F.col(amount)).otherwise(0.0)
    g = long.groupBy("rule").agg(
        F.count("*").alias("rm"), F.count_if(km).alias("km"), F.count_if(fired & km).alias("alerted_km"), F.count_if(fired).alias("alerted_rm"),
        F.count_if(fired & km & fraud).alias("alerted_frauds_km"), F.count_if(fired & fraud).alias("alerted_frauds_rm"),
        F.count_if(km & fraud).alias("frauds_km"), F.sum(value).alias("value_km"), F.sum(F.when(fired, value).otherwise(0.0)).alias("alerted_value_km"))
    c = F.col
    return g.filter(c("alerted_rm") > 0).select(
        "rule", "rm", "km", "alerted_km", "alerted_rm", "alerted_frauds_km", "alerted_frauds_rm", (100.0 * c("alerted_rm") / c("rm")).alias("alert_rate"),
        F.try_divide(100.0 * c("alerted_frauds_km"), c("alerted_km")).alias("precision"), F.try_divide(100.0 * c("alerted_frauds_km"), c("frauds_km")).alias("recall"),
        F.try_divide(100.0 * c("alerted_value_km"), c("value_km")).alias("recall_value"),
        F.try_divide(100.0 * (c("alerted_km") - c("alerted_frauds_km")), c("alerted_km")).alias("false_alert_rate_km"),
        F.try_divide(100.0 * (c("alerted_rm") - c("alerted_frauds_rm")), c("alerted_rm")).alias("false_alert_rate_rm"),
        F.try_divide(c("frauds_km"), c("km")).alias("fraud_per_km"), F.try_divide(c("value_km"), c("km")).alias("value_per_km"),
        F.try_divide(c("alerted_frauds_km"), c("km")).alias("alerted_fraud_per_km"), F.try_divide(c("alerted_value_km"), c("km")).alias("alerted_value_per_km"))


def rule_capture(df: DataFrame, flags: list[str], label: str, amount: str) -> DataFrame:
    """Share of frauds and of their amount per flag value, and the non-fraud share among the rows of that value."""
    grouped = long_features(df, flags, [label, amount]).groupBy("feature", "value").agg(*_counts(label, amount))
    c = F.col
    return _with_totals(grouped, ["feature"]).select(
        c("feature").alias("rule"), c("value").alias("hit"), "n", F.try_divide(c("y"), c("all_y")).alias("fraud_share"), F.try_divide(c("ya"), c("all_ya")).alias("amount_share"),
        F.try_divide(c("n") - c("y"), c("n")).alias("false_positive_share"))


def drill_down(df: DataFrame, rule: Column, features: list[str], label: str, amount: str) -> DataFrame:
    """Values inside a rule, measured within it; sort by ``f1`` at the edge."""
    return univariate_rules(df.filter(rule), features, label, amount)


def capture_by_term(df: DataFrame, text: str, terms: dict[str, Column], caught: Column, amount: str) -> DataFrame:
    """Per vocabulary term: share of rows with it, and how much of them (rows and amount) is caught."""
    hits = F.array(*(F.struct(F.lit(n).alias("term"), c.alias("hit")) for n, c in terms.items()))
    long = df.select(amount, flag(caught).alias("_caught"), F.explode(hits).alias("_h")).select(amount, "_caught", "_h.*")
    hit = F.col("hit") == 1
    both = hit & (F.col("_caught") == 1)
    return long.groupBy("term").agg(
        F.avg("hit").alias("share"), F.try_divide(F.count_if(both), F.count_if(hit)).alias("caught"),
        F.try_divide(F.sum(F.when(both, F.col(amount)).otherwise(0.0)), F.sum(F.when(hit, F.col(amount)).otherwise(0.0))).alias("amount_caught"))


def days_to_label_curve(df: DataFrame, days: str, label: str, amount: str) -> DataFrame:
    """Cumulative percentage of frauds and amount by whole days since approval (a bounded domain)."""
    run = cumulative_by_value(df.filter(F.col(label) == 1), days, {"frauds": F.sum(label), "amount": F.sum(amount)})
    return run.select(days, (100.0 * F.col("cum_frauds") / F.col("total_frauds")).alias("cum_frauds_pct"), F.try_divide(100.0 * F.col("cum_amount"), F.col("total_amount")).alias("cum_amount_pct"))
