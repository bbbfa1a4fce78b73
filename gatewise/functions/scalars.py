"""Column expressions for cleaning and deriving applicant features. All stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from gatewise.sources.tables import as_column

UNDEFINED = "Undefined"

# Mean length of a month and a year in days, and the spellings that mean "missing" in payloads.
DAYS_PER_MONTH = 30.436875
DAYS_PER_YEAR = 365.2425
NULL_WORDS = ["none", "None", "null"]

# Risk levels from worst to best.
RISK_LEVELS = ["High", "Medium", "Low"]

# E-mail hosts kept as categories of their own.
COMMON_EMAIL_HOSTS = ["gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "hotmail.co.uk", "icloud.com", "yahoo.co.uk", "live.co.uk"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def flag(condition: Column) -> Column:
    """Boolean to 0/1, with an unknown condition counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(value: str | Column, low: float, high: float) -> Column:
    """Limit to a range and keep NULL (``greatest`` and ``least`` alone would turn NULL into a bound)."""
    c = as_column(value)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def row_sum(columns: list[str]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))


def year_boundaries(start: str | Column, end: str | Column) -> Column:
    """Calendar years crossed: 2020-12-31 to 2021-01-01 counts 1."""
    return F.year(as_column(end)) - F.year(as_column(start))


def age_in_months(start: str | Column, end: str | Column) -> Column:
    return F.date_diff(as_column(end), as_column(start)) / F.lit(DAYS_PER_MONTH)


def age_in_years(start: str | Column, end: str | Column) -> Column:
    return F.date_diff(as_column(end), as_column(start)) / F.lit(DAYS_PER_YEAR)


def year_month(value: str | Column) -> Column:
    return F.date_format(as_column(value), "yyyy-MM")


def first_match(value: str | Column, pattern: str, group: int = 0) -> Column:
    """First regex match or NULL (``regexp_extract`` alone gives an empty string)."""
    return F.nullif(F.regexp_extract(as_column(value), pattern, group), F.lit(""))


def has_digit(value: str | Column) -> Column:
    return flag(as_column(value).rlike("[0-9]"))


def drop_digits(value: str | Column) -> Column:
    return F.regexp_replace(as_column(value), "[0-9]", "")


def email_host(value: str | Column) -> Column:
    """Text after the last ``@`` and then after the last ``#``."""
    return F.element_at(F.split(F.element_at(F.split(as_column(value), "@"), -1), "#"), -1)


def keep_or_other(value: str | Column, kept: list[str], other: str = "other") -> Column:
    c = as_column(value)
    return F.when(c.isin(kept), c).otherwise(F.lit(other))


def is_missing(value: Column) -> Column:
    return value.isNull() | value.isin(NULL_WORDS)


def postcode_outward(value: str | Column) -> Column:
    """Outward part and error text as a struct. Up to four characters are taken whole; longer text loses blanks and its last three."""
    stripped = F.trim(as_column(value))
    packed = F.replace(stripped, F.lit(" "), F.lit(""))
    outward = F.when(F.length(stripped) <= 4, stripped).otherwise(F.expr("NULL"))
    outward = F.coalesce(outward, F.when(F.length(packed) > 3, F.substring(packed, F.lit(1), F.length(packed) - 3)), F.lit(""))
    error = (F.when(F.coalesce(stripped, F.lit("")) == "", F.lit("empty"))
             .when(~F.length(outward).between(2, 4), F.lit("bad length")))
    return F.struct(F.when(error.isNull(), outward).alias("value"), error.alias("error"))


def postcode_area(value: str | Column) -> Column:
    """Letters of the outward part, ``Undefined`` when the postcode does not parse."""
    return F.coalesce(drop_digits(postcode_outward(value).getField("value")), F.lit(UNDEFINED))


def code_list(value: str | Column) -> Column:
    """Comma-separated codes to an array without blanks; NULL and NaN text give an empty array."""
    c = as_column(value)
    text = F.when(c.isNull() | (F.lower(c) == "nan"), F.lit("")).otherwise(c)
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def industry_code(value: str | Column) -> Column:
    return F.lower(F.trim(as_column(value)))


def company_type(value: str | Column, registered: str | Column) -> Column:
    """Lower-cased type; a missing type means sole trader unless the company is registered, which is an error."""
    c, reg = as_column(value), F.coalesce(as_column(registered).cast("boolean"), F.lit(False))
    missing = c.isNull() | c.contains("null") | c.contains("None")
    parsed = F.when(~missing, F.lower(F.trim(c))).when(~reg, F.lit("sole-trader"))
    return F.struct(parsed.alias("value"), F.when(missing & reg, F.lit("registered company without a type")).alias("error"))


def worst_of(*values: str | Column) -> Column:
    """Highest risk level present in any column, ``Undefined`` when none is."""
    ordinals = [F.coalesce(*(F.when(as_column(v) == level, F.lit(len(RISK_LEVELS) - i)) for i, level in enumerate(RISK_LEVELS)), F.lit(0))
                for v in values]
    worst = F.greatest(*ordinals) if len(ordinals) > 1 else ordinals[0]
    return F.coalesce(*(F.when(worst == len(RISK_LEVELS) - i, F.lit(level)) for i, level in enumerate(RISK_LEVELS)), F.lit(UNDEFINED))


def worst_in(values: str | Column) -> Column:
    """Highest risk level present in an array of levels."""
    levels = as_column(values)
    return F.coalesce(*(F.when(F.array_contains(levels, level), F.lit(level)) for level in RISK_LEVELS), F.lit(UNDEFINED))


def one_hot(value: str, levels: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{level}": flag(F.col(value) == level) for level in levels}


def first_set_flag(flags: list[tuple[str, str]], default: str = UNDEFINED) -> Column:
    """Decode indicator columns in order of priority: the first column equal to 1 names the category."""
    return F.coalesce(*(F.when(F.col(column) == 1, F.lit(label)) for column, label in flags), F.lit(default))


def count_level(value: str | Column) -> Column:
    """Counts 1 and 2 kept, larger ones ``3+``, zero or unknown ``Undefined``."""
    c = as_column(value)
    return (F.when(c == 1, F.lit("1")).when(c == 2, F.lit("2")).when(c >= 3, F.lit("3+")).otherwise(F.lit(UNDEFINED)))


def clean_array(values: str | Column) -> Column:
    """Drop null-like entries, then sort and de-duplicate."""
    return F.array_sort(F.array_distinct(F.filter(as_column(values), lambda x: ~is_missing(x))))


def merge_nationalities(declared: str | Column, registry: str | Column) -> Column:
    """Union of a declared nationality and the registry's list; ``[Undefined]`` when both are unknown."""
    own = as_column(declared)
    own_list = F.when(own.isNull() | own.contains(UNDEFINED), F.expr("CAST(array() AS array<string>)")).otherwise(F.array(own))
    both = clean_array(F.array_union(own_list, F.coalesce(as_column(registry), F.expr("CAST(array() AS array<string>)"))))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit(UNDEFINED)))


def keyword_pattern(words: list[str]) -> str:
    """One alternation of escaped words, longest first, on word boundaries."""
    ordered = sorted(set(w.lower() for w in words), key=lambda w: (-len(w), w))
    return r"(?<!\w)(" + "|".join(re.escape(w).replace("/", r"\/") for w in ordered) + r")(?!\w)"


def keyword_hits(value: str | Column, words: list[str]) -> Column:
    """Distinct keywords found as whole words, sorted."""
    text = F.lower(F.trim(as_column(value)))
    hits = F.regexp_extract_all(text, F.lit(keyword_pattern(words)), F.lit(1))
    return F.coalesce(F.array_sort(F.array_distinct(hits)), F.expr("CAST(array() AS array<string>)"))


def keyword_flag(value: str | Column, words: list[str]) -> Column:
    return flag(F.lower(F.trim(as_column(value))).rlike(keyword_pattern(words)))


def contains_any(value: str | Column, terms: list[str]) -> Column:
    """Any term occurs in the text, ignoring case."""
    text = F.upper(as_column(value))
    return flag(any_of([text.contains(t.upper()) for t in terms]))


def term_flags(value: str | Column, terms: list[str]) -> dict[str, Column]:
    """One indicator per vocabulary term, matched on whole words of two or more characters."""
    tokens = F.regexp_extract_all(F.lower(as_column(value)), F.lit(r"\b(\w\w+)\b"), F.lit(1))
    return {t: flag(F.array_contains(tokens, t.lower())) for t in terms}


def full_name(*parts: str) -> Column:
    return F.concat_ws(" ", *(F.lower(F.coalesce(F.col(p), F.lit(""))) for p in parts))


def name_mismatch(a: str | Column, b: str | Column) -> Column:
    """1 when no token is shared and neither name, with sorted tokens, occurs in the other.

    This is when a token-set partial similarity stays below 100. Empty names count as a mismatch.
    """
    def tokens(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")))

    left, right = tokens(as_column(a)), tokens(as_column(b))
    joined_left, joined_right = F.array_join(left, " "), F.array_join(right, " ")
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    same = F.arrays_overlap(left, right) | F.contains(joined_left, joined_right) | F.contains(joined_right, joined_left)
    return F.when(empty, F.lit(1)).otherwise(F.when(same, F.lit(0)).otherwise(F.lit(1)))


def json_text(value: str | Column, path: str) -> Column:
    """A value at a JSON path as text; bad JSON gives NULL."""
    return F.expr("1") if value is None else F.try_variant_get(F.try_parse_json(as_column(value)), path, "string")


def envelope_value(value: str | Column) -> Column:
    """``output.value`` of a feature-service envelope, NULL when the envelope carries an error or does not parse."""
    parsed = F.from_json(as_column(value), "output struct<value: string, error: string>")
    return F.when(parsed.output.error.isNull(), parsed.output.value)


def make_envelope(inputs: dict[str, Column], value: Column, error: Column) -> Column:
    source = F.struct(*(c.alias(n) for n, c in inputs.items()))
    return F.to_json(F.struct(source.alias("input"), F.struct(value.alias("value"), error.alias("error")).alias("output")),
                     {"ignoreNullFields": "false"})


def payload_content(value: str | Column, kind: str) -> Column:
    """What is in ``{"value": ..}``, as ``kind``."""
    return F.from_json(as_column(value), f"value {kind}").getField("value")


def known_text(text: Column) -> Column:
    """The text, or NULL when missing or null-like."""
    return F.when(~is_missing(text), text)


def known_entries(items: Column) -> Column:
    """The entries without null-like ones; an empty array when there is none."""
    return F.filter(F.coalesce(items, F.expr("CAST(array() AS array<string>)")), lambda x: ~is_missing(x))


def payload_value(value: str | Column) -> Column:
    """``{"value": x}`` with a scalar: the text, or NULL when missing or null-like."""
    return known_text(payload_content(value, "string"))


def payload_list(value: str | Column) -> Column:
    """``{"value": [..]}``: the entries without null-like ones; an empty array when there is none."""
    return known_entries(payload_content(value, "array<string>"))
