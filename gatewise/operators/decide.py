"""From payload to decision: feature contract, payload transform, score standardisation and banded decisions.

Every function maps a DataFrame to a DataFrame with column expressions and lookups, so batch replay and streams share it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewise.functions.scalars import (COMMON_EMAIL_HOSTS, UNDEFINED, age_in_months, clip, email_host, first_set_flag, flag, has_digit, keep_or_other,
                                        keyword_flag, known_entries, known_text, payload_content, postcode_area)
from gatewise.operators import encoders as E, evaluate as V
from gatewise.operators.models import scorecard_contributions, top_reason
from gatewise.session import staged
from gatewise.sources.files import load_tables, save_tables
from gatewise.sources.tables import require_columns

# The raw payload contract.
ID_TYPE_FLAGS = [("APPLICANT_ID_TYPE_Passport", "Passport"), ("APPLICANT_ID_TYPE_Driving_Licence", "Driving_Licence"),
                 ("APPLICANT_ID_TYPE_Provisional_Licence", "Provisional_Licence"), ("APPLICANT_ID_TYPE_Residence_Permit", "Residence_Permit"),
                 ("APPLICANT_ID_TYPE_National_ID", "National_ID"), ("APPLICANT_ID_TYPE_Other_ID", "Other_ID")]
STRUCTURE_FLAGS = [("COMPANY_STRUCTURE_LEVELWISE_1", "1"), ("COMPANY_STRUCTURE_LEVELWISE_2", "2"), ("COMPANY_STRUCTURE_LEVELWISE_3+", "3+")]
PAYLOAD_INPUTS = ["INDIVIDUAL_CHECKS_C_NOT_PASSED", *(c for c, _ in ID_TYPE_FLAGS), "APPLICANT_ID_COUNTRY_ISSUE__RawData", "APPLICANT_NATIONALITY__RawData", "AGE_AT_COMPLETION",
                  "APPLICANT_email_domain", "COMPANY_KEYWORDS_High", "COMPANY_KEYWORDS_Prohibited", "COMPANY_SIC_CODES__RawData", "COMPANY_INDUSTRY_CLASSIFICATION__RawData",
                  "APPLICANT_POSTCODE__RawData", "COMPANY_POSTCODE__RawData", "APPLICANT_YEARS_TO_ID_EXPIRY", *(c for c, _ in STRUCTURE_FLAGS), "COMPANY_AGE_AT_COMPLETION",
                  "APPLICANT_email_domain__RawData"]
# Standardised score scale and outcomes.
LOW_START, LOW_END, MEDIUM_START, MEDIUM_END, HIGH_START, HIGH_END = 201, 399, 400, 601, 602, 999
APPROVED, REVIEW = "BAU", "EDD"


def payload_from_members(members: DataFrame, keywords: list[str], keep: list[str]) -> DataFrame:
    """Wrap raw member columns into the payload contract, as a caller of the decision service would."""
    def wrap(value: Column) -> Column:
        return F.to_json(F.struct(value.alias("value")), {"ignoreNullFields": "false"})
    empty = F.expr("CAST(array() AS array<string>)")
    columns = {c: flag(F.col("applicant_id_type") == label) for c, label in ID_TYPE_FLAGS}
    columns |= {c: flag(F.col("structure_level") == label) for c, label in STRUCTURE_FLAGS}
    columns |= {
        "INDIVIDUAL_CHECKS_C_NOT_PASSED": wrap(F.transform(F.split(F.when(F.col("identity_address_fail") == 1, F.concat_ws(",", F.lit("INDIVIDUAL_IDENTITY_ADDRESS"), "triggers_raw")).otherwise(F.coalesce("triggers_raw", F.lit(""))), ","), lambda x: F.trim(x))),
        "APPLICANT_ID_COUNTRY_ISSUE__RawData": wrap(F.col("idcountry_raw")),
        "APPLICANT_NATIONALITY__RawData": wrap(F.when(F.col("nationality_raw").isNotNull(), F.split("nationality_raw", " ")).otherwise(empty)),
        "AGE_AT_COMPLETION": F.col("age_at_completion"), "APPLICANT_email_domain": email_host("email_raw"),
        "COMPANY_KEYWORDS_High": keyword_flag("trading_name_raw", keywords), "COMPANY_KEYWORDS_Prohibited": F.col("keyword_present"),
        "COMPANY_SIC_CODES__RawData": wrap(F.when(F.col("sic_raw").isNotNull(), F.split("sic_raw", ",")).otherwise(empty)),
        "COMPANY_INDUSTRY_CLASSIFICATION__RawData": wrap(F.col("icc_raw")), "APPLICANT_POSTCODE__RawData": wrap(F.col("postcode_raw")), "COMPANY_POSTCODE__RawData": wrap(F.col("postcode_area")),
        "APPLICANT_YEARS_TO_ID_EXPIRY": clip("years_to_id_expiry", 0, 10), "COMPANY_AGE_AT_COMPLETION": age_in_months("incorporated_on", "created_on"),
        "APPLICANT_email_domain__RawData": wrap(F.col("email_raw")),
    }
    return members.select(*keep, *(c.alias(n) for n, c in columns.items()))


def _country_lookup(countries: list[tuple[str, str]]) -> Column:
    """Map literal from 2- and 3-letter codes to the 2-letter code, for a bounded country table."""
    pairs = {**{a: a for a, _ in countries}, **{b: a for a, b in countries}}
    return F.create_map(*(F.lit(x) for item in pairs.items() for x in item))


# Which payload inputs come in envelopes, with a list or one value inside.
LIST_ENVELOPES = ["INDIVIDUAL_CHECKS_C_NOT_PASSED", "APPLICANT_NATIONALITY__RawData", "COMPANY_SIC_CODES__RawData"]
VALUE_ENVELOPES = ["APPLICANT_ID_COUNTRY_ISSUE__RawData", "COMPANY_INDUSTRY_CLASSIFICATION__RawData", "APPLICANT_POSTCODE__RawData", "COMPANY_POSTCODE__RawData",
                   "APPLICANT_email_domain__RawData"]


def open_envelopes(payload: DataFrame, keep: list[str]) -> DataFrame:
    """The payload with the content in place of its envelopes. A generator gives it out, so each envelope is parsed once, however often it is used."""
    require_columns(payload, PAYLOAD_INPUTS)
    content = [payload_content(n, "array<string>").alias(n) for n in LIST_ENVELOPES] + [payload_content(n, "string").alias(n) for n in VALUE_ENVELOPES]
    plain = [F.col(f"`{n}`") for n in PAYLOAD_INPUTS if n not in LIST_ENVELOPES + VALUE_ENVELOPES]
    opened = payload.select(*keep, *plain, F.inline(F.array(F.struct(*content))))
    return opened.withColumns({n: known_entries(F.col(n)) for n in LIST_ENVELOPES} | {n: known_text(F.col(n)) for n in VALUE_ENVELOPES})


def payload_features(payload: DataFrame, countries: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Categorical and numeric inputs of the model from a payload; missing or invalid values become ``Undefined`` or NULL."""
    c, known = F.col, _country_lookup(countries)

    def country(code: Column) -> Column:
        return F.coalesce(F.element_at(known, code), F.lit(UNDEFINED))
    nationality = F.transform("APPLICANT_NATIONALITY__RawData", country)
    codes = F.filter(F.transform("COMPANY_SIC_CODES__RawData", lambda x: F.trim(x)), lambda x: x != "")
    undefined = F.array(F.lit(UNDEFINED))
    host = email_host(F.lower("APPLICANT_email_domain"))
    features = {
        "individual_identity_address": flag(F.array_contains("INDIVIDUAL_CHECKS_C_NOT_PASSED", "INDIVIDUAL_IDENTITY_ADDRESS")),
        "applicant_idcountry_issue": country(c("APPLICANT_ID_COUNTRY_ISSUE__RawData")),
        "applicant_nationality": F.when(F.size(nationality) > 0, nationality).otherwise(undefined),
        "company_sic": F.when(F.size(codes) > 0, codes).otherwise(undefined),
        "company_icc": F.coalesce("COMPANY_INDUSTRY_CLASSIFICATION__RawData", F.lit(UNDEFINED)),
        "applicant_postcode": postcode_area("APPLICANT_POSTCODE__RawData"),
        "company_postcode": postcode_area("COMPANY_POSTCODE__RawData"),
        "applicant_email_domain": keep_or_other(host, COMMON_EMAIL_HOSTS),
        "applicant_email_numeric": has_digit("APPLICANT_email_domain__RawData"),
        "applicant_years_to_id_expiry": c("APPLICANT_YEARS_TO_ID_EXPIRY").cast("double"),
        "age_at_completion": c("AGE_AT_COMPLETION").cast("double"),
        "company_age_at_completion": c("COMPANY_AGE_AT_COMPLETION").cast("double"),
        "is_restricted_keyword_present": F.greatest("COMPANY_KEYWORDS_Prohibited", "COMPANY_KEYWORDS_High"),
        "applicant_id_type": first_set_flag(ID_TYPE_FLAGS), "company_structurelevelwise": first_set_flag(STRUCTURE_FLAGS),
    }
    return open_envelopes(payload, keep).select(*keep, *(v.alias(n) for n, v in features.items()))


# ---- encode, bin, score ------------------------------------------------------------------------------------------

# How the model takes each payload feature.
ENCODED = ["applicant_idcountry_issue", "company_icc", "applicant_postcode", "company_postcode", "applicant_email_domain", "applicant_id_type", "company_structurelevelwise"]
ENCODED_LISTS = ["applicant_nationality", "company_sic"]
NUMERIC = ["age_at_completion", "company_age_at_completion", "applicant_years_to_id_expiry"]
FLAGS = ["individual_identity_address", "applicant_email_numeric", "is_restricted_keyword_present"]
BUSINESS = "company_nob_encoded"  # the larger one of industry and codes
WOE_INPUTS = [*(f"{f}_encoded" for f in ENCODED if f != "company_icc"), "applicant_nationality_encoded", BUSINESS, *NUMERIC]


class Chain(NamedTuple):
    """Fitted steps from features to a score: category encodings (feature, category, value), bins (feature, bin, upper, woe) and the
    linear model (feature, coefficient, mean), its intercept under the empty name."""

    encodings: DataFrame
    bins: DataFrame
    model: DataFrame


def encode_features(features: DataFrame, encodings: DataFrame) -> DataFrame:
    """Encoded columns of all categories; a list counts by its largest entry. No join and no shuffle: it works on streams."""
    known = {f: E.lookup_constant(encodings, f) for f in ENCODED + ENCODED_LISTS}
    out = features.withColumns({f"{f}_encoded": E.looked_up(known[f], F.col(f)) for f in ENCODED} | {f"{f}_encoded": E.looked_up_largest(known[f], f) for f in ENCODED_LISTS})
    return out.withColumn(BUSINESS, F.greatest("company_icc_encoded", "company_sic_encoded"))


def model_inputs(encoded: DataFrame, bins: DataFrame) -> DataFrame:
    """Weights of evidence in place of encodings and numbers (``*_woe``); flags stay."""
    fits = E.woe_fits(bins)
    return encoded.withColumns({f"{f}_woe": E.woe_column(fits[f]) for f in WOE_INPUTS})


def fit_encodings(features: DataFrame, label: str, fit: Callable[[DataFrame], DataFrame] = E.fit_mixed_encoding) -> DataFrame:
    """Encodings of all categories from labelled features. Lists are fitted on their first entry."""
    counts = E.category_counts(features, ENCODED, label)
    for f in ENCODED_LISTS:
        counts = counts.unionByName(E.list_category_counts(features, f, label))
    return fit(counts).select("feature", "category", "value")


def fit_chain(features: DataFrame, label: str, cuts: dict[str, list[float]], coefficients: dict[str, float], intercept: float,
              fit: Callable[[DataFrame], DataFrame] = E.fit_mixed_encoding) -> Chain:
    """All three tables from labelled features, for a linear model whose coefficients are given; means are those of the fit."""
    spark = features.sparkSession
    encodings = staged(fit_encodings(features, label, fit))
    encoded = staged(encode_features(features, encodings))
    bins = E.woe_bin_table(spark, E.fit_many_woe_bins(encoded, {f: cuts[f] for f in WOE_INPUTS}, label))
    means = model_inputs(encoded, bins).agg(*(F.avg(f).alias(f) for f in coefficients)).first()
    rows = [("", float(intercept), 0.0)] + [(f, float(c), float(means[f] or 0.0)) for f, c in coefficients.items()]
    return Chain(encodings, bins, spark.createDataFrame(rows, "feature string, coefficient double, mean double"))


def save_chain(chain: Chain, folder: str) -> None:
    save_tables(chain._asdict(), folder)


def load_chain(spark: SparkSession, folder: str) -> Chain:
    """The chain from its files alone."""
    return Chain(**load_tables(spark, folder, list(Chain._fields)))


def score_features(features: DataFrame, chain: Chain, keep: list[str], score: str = "score") -> tuple[DataFrame, Column]:
    """Whole scores 0..1000 of features, and the reason column of ``decide``: the feature that adds most."""
    model = {r["feature"]: (r["coefficient"], r["mean"]) for r in chain.model.collect()}  # a row per feature
    intercept = model.pop("")[0]
    inputs = model_inputs(encode_features(features, chain.encodings), chain.bins).select(*keep, *model)
    contributions = scorecard_contributions({f: c for f, (c, _) in model.items()}, {f: m for f, (_, m) in model.items()})
    logit = sum(contributions.values(), F.lit(intercept))
    named = {f.removesuffix("_woe").removesuffix("_encoded"): c for f, c in contributions.items()}
    scored = inputs.withColumns({"_p": 1 / (1 + F.exp(-logit)), "_reason": top_reason(named)})
    return scored.select(*keep, V.to_score("_p").alias(score), "_reason"), F.col("_reason")


def decide_payloads(payload: DataFrame, countries: list[tuple[str, str]], chain: Chain, high: float, medium: float, keep: list[str]) -> DataFrame:
    """From raw payloads to decisions: parse, clean, encode, bin, score, standardise, decide. One narrow function for tables and streams."""
    scored, reason = score_features(payload_features(payload, countries, keep), chain, keep)
    return decide(scored, "score", high, medium, reason).select(*keep, "raw_rating", "rating", "category", "decision", "reason")


def standardise_score(score: str | Column, high: float, medium: float) -> Column:
    """Raw score to the standard scale in three linear pieces (half to even); adjacent thresholds give the start of the middle piece."""
    s = F.col(score) if isinstance(score, str) else score
    low_piece = s / F.lit(float(medium)) * F.lit(LOW_END - LOW_START) + LOW_START
    width = high - 1 - medium
    middle = ((s - medium) / F.lit(float(width)) * F.lit(MEDIUM_END - MEDIUM_START) + MEDIUM_START) if width > 0 else F.lit(float(MEDIUM_START))
    top = (s - high) / F.lit(float(1000 - high)) * F.lit(HIGH_END - HIGH_START) + HIGH_START
    return F.bround(F.when(s >= high, top).when(s >= medium, middle).otherwise(low_piece), 0).cast("int")


def band_of_standard(rating: str) -> Column:
    c = F.col(rating)
    return F.when(c <= LOW_END, "LOW").when(c <= MEDIUM_END, "MEDIUM").otherwise("HIGH")


def decide(df: DataFrame, score: str, high: float, medium: float, reason: Column | None = None) -> DataFrame:
    """Add raw and standard rating, category, decision and (only for a review) the reason."""
    out = df.withColumns({"raw_rating": F.col(score), "rating": standardise_score(score, high, medium)})
    out = out.withColumns({"category": band_of_standard("rating"), "decision": F.when(F.col("rating") <= MEDIUM_END, APPROVED).otherwise(REVIEW)})
    named = F.upper(F.regexp_replace(reason, "_encoded$", "")) if reason is not None else F.lit(None).cast("string")
    return out.withColumn("reason", F.when(F.col("decision") == REVIEW, named))


def inconsistent_bands(decided: DataFrame, high: float, medium: float) -> DataFrame:
    """Rows whose raw and standard bands differ (expected: none)."""
    raw = F.when(F.col("raw_rating") >= high, "HIGH").when(F.col("raw_rating") >= medium, "MEDIUM").otherwise("LOW")
    return decided.filter(raw != F.col("category"))


def category_report(decided: DataFrame, label: str) -> DataFrame:
    """Share, label rate and lift per category."""
    g = decided.groupBy("category").agg(F.count("*").alias("n"), F.sum(label).alias("y"))
    whole = g.agg(F.struct(F.sum("n").alias("n"), F.sum("y").alias("y"))).scalar()
    g = g.withColumn("_t", whole)
    rate = F.col("y") / F.col("n")
    return g.select("category", "n", (F.col("n") / F.col("_t.n")).alias("share"), rate.alias("label_rate"), F.try_divide(rate, F.col("_t.y") / F.col("_t.n")).alias("lift"))


