"""Joins beyond the plain equi-join: as-of, longest prefix, dictionary lookups, membership and blocked fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.functions.scalars import DAYS_PER_YEAR, UNDEFINED, count_level, is_missing, worst_in
from gatewise.functions.similarity import keep_similar
from gatewise.operators import encoders as E
from gatewise.session import broadcast_if_small, shuffled, staged


def asof_join(spine: DataFrame, features: DataFrame, key: str, spine_ts: str, feature_ts: str, columns: list[str],
              bucket_seconds: int = 86_400) -> DataFrame:
    """Each spine row with the latest feature row of its key at or before its time (nothing matches: NULL).

    Time is cut into buckets and all windows run per (key, bucket), so a key that holds much of the data is spread over
    its buckets. The value carried into a bucket comes from one small row per (key, bucket). Ties on time take the
    largest feature tuple.
    """
    def bucket(ts: str):
        return F.floor(F.col(ts).cast("timestamp").cast("double") / bucket_seconds)

    empty = F.lit(None)
    value = F.struct(F.col(feature_ts).alias("_at"), *columns)
    right = features.select(F.col(key).alias("_key"), bucket(feature_ts).alias("_bucket"), F.col(feature_ts).alias("_ts"), F.lit(0).alias("_kind"),
                            value.alias("_value"))
    left = spine.select(F.col(key).alias("_key"), bucket(spine_ts).alias("_bucket"), F.col(spine_ts).alias("_ts"), F.lit(1).alias("_kind"),
                        F.struct(*spine.columns).alias("_row"))
    # Latest value per (key, bucket), also for buckets that only the spine has, then the last one before each bucket.
    ends = (right.select("_key", "_bucket", "_value").unionByName(left.select("_key", "_bucket"), allowMissingColumns=True)
            .groupBy("_key", "_bucket").agg(F.max("_value").alias("_end")))
    before = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_key", "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = W.partitionBy("_key", "_bucket").orderBy("_ts", "_kind", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = right.withColumn("_row", empty.cast(left.schema["_row"].dataType)).unionByName(
        left.withColumn("_value", empty.cast(right.schema["_value"].dataType)))
    local = merged.withColumn("_local", F.last("_value", ignorenulls=True).over(inside)).filter(F.col("_kind") == 1)
    chosen = local.join(carried, ["_key", "_bucket"], "left").withColumn("_best", F.coalesce("_local", "_carried"))
    return chosen.select("_row.*", *(F.col(f"_best.{c}").alias(c) for c in columns))


def prefix_lookup(df: DataFrame, column: str, table: DataFrame, prefix: str, value: str, longest: int = 4, default: str = "Low",
                  undefined: str = "Undefined") -> DataFrame:
    """Value of the longest matching prefix (``longest`` to 1 characters); no match gives ``default``, NULL text ``undefined``.

    One equi-join per length against the lookup table; the row itself is never multiplied (prefixes are unique).
    """
    out = df
    for n in range(longest, 0, -1):
        side = table.filter(F.length(prefix) == n).select(F.col(prefix).alias(f"_p{n}"), F.col(value).alias(f"_v{n}"))
        out = out.join(side, F.when(F.length(column) >= n, F.substring(column, 1, n)) == F.col(f"_p{n}"), "left")
    found = F.coalesce(*(F.col(f"_v{n}") for n in range(longest, 0, -1)), F.lit(default))
    helper = [f"_{k}{n}" for n in range(1, longest + 1) for k in "pv"]
    return out.withColumn(value, F.when(F.col(column).isNull(), F.lit(undefined)).otherwise(found)).drop(*helper)


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str, name: str, default: str | None = None) -> DataFrame:
    """Dictionary lookup as a left join on a table of unique keys."""
    side = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = df.join(side, F.col(column) == F.col("_k"), "left")
    found = F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")
    return out.withColumn(name, found).drop("_k", "_v")


def country_code(df: DataFrame, column: str, countries: DataFrame, name: str, error: str) -> DataFrame:
    """Validate a 2- or 3-letter code (exact case) against ``countries(alpha_2, alpha_3)``; bad input gives an error text."""
    short = countries.select(F.col("alpha_2").alias("_c2"), F.col("alpha_2").alias("_r2"))
    long = countries.select(F.col("alpha_3").alias("_c3"), F.col("alpha_2").alias("_r3"))
    out = df.join(short, F.col(column) == F.col("_c2"), "left").join(long, F.col(column) == F.col("_c3"), "left")
    blank = F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
    found = F.coalesce("_r2", "_r3")
    problem = (F.when(blank, F.lit("not text")).when(~F.length(column).isin(2, 3), F.lit("bad length")).when(found.isNull(), F.lit("unknown code")))
    return out.withColumn(name, found).withColumn(error, problem).drop("_c2", "_r2", "_c3", "_r3")


def with_membership(df: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Flag rows whose key occurs in a table, without multiplying them."""
    return (df.join(table.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
            .withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit"))


def word_runs(text: Column, most: int) -> Column:
    """Distinct pieces of a text that run from the start of a word to the end of one, of 1 to ``most`` words, with what stands between them."""
    def runs(parts: Column) -> Column:
        size = F.size(parts)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i <= size) & F.try_element_at(parts, i).rlike(r"^\w"))
        spans = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.when(i + 2 * k <= size, F.array_join(F.slice(parts, i, 2 * k + 1), ""))))
        return F.array_distinct(F.array_compact(F.flatten(spans)))
    # a variable of a lambda: the text is cut once, and not again for every run
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(r"(?s)\w+|\W+"), F.lit(0))), runs)[0]


def keyword_levels(df: DataFrame, key: str, text: str, phrases: DataFrame, hits: str = "keywords", level: str = "keyword_level") -> DataFrame:
    """Phrases of a table ``(phrase, level)`` that stand in a text as whole words, sorted, and the worst of their levels (``Undefined`` if none).

    Case and blanks at the ends do not count; what stands between the words of a phrase does. The runs of words of a text, as
    long as the table's longest phrase, are looked up from the first to the last word character of each phrase; phrases with other
    characters at their ends are then looked for as they are. The table is counted: up to ``encoders.LOOKUP_LIMIT`` phrases it is a constant
    of the plan and no row moves; beyond it the runs meet it in a join and return by ``key``, which must be unique.
    """
    clean = F.lower(F.trim("phrase"))
    core = F.regexp_extract(clean, r"(?s)\w(.*\w)?", 0)
    table = staged(phrases.select(clean.alias("phrase"), core.alias("core"), "level").where("core <> ''").distinct())
    size = table.agg(F.count("*").alias("n"), F.max(F.size(F.regexp_extract_all("core", F.lit(r"\w+"), F.lit(0)))).alias("words")).first()
    clean_text = F.col("_t")
    runs = word_runs(clean_text, size["words"] or 1)
    # generators: what they give is worked out once a row, however often it is used
    texts = df.select("*", F.explode(F.array(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))))).alias("_t"))

    def stands(phrase: Column, run: Column) -> Column:
        return (phrase == run) | F.regexp_like(clean_text, F.concat(F.lit(r"(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)")))
    if size["n"] <= E.LOOKUP_LIMIT:
        listed = table.groupBy("core").agg(F.collect_list(F.array("phrase", "level")).alias("value"))
        known = E.lookup_constant(listed.select(F.lit("k").alias("feature"), F.col("core").alias("category"), "value"), "k", "array<array<string>>")
        none = F.expr("CAST(array() AS array<array<string>>)")
        found = F.flatten(F.transform(runs, lambda g: F.filter(E.looked_up(known, g, none), lambda h: stands(h[0], g))))
        marked = texts.select("*", F.explode(F.array(found)).alias("_found"))
        return marked.withColumns({hits: F.array_sort(F.array_distinct(F.transform("_found", lambda h: h[0]))), level: worst_in(F.transform("_found", lambda h: h[1]))}).drop("_t", "_found")
    met = texts.select(key, "_t", F.explode(runs).alias("core")).join(broadcast_if_small(table), "core")
    met = met.where((F.col("phrase") == F.col("core")) | F.regexp_like("_t", F.concat(F.lit(r"(?<!\w)\Q"), F.col("phrase"), F.lit(r"\E(?!\w)"))))
    rows = met.groupBy(key).agg(F.array_sort(F.collect_set("phrase")).alias(hits), F.collect_set("level").alias("_levels"))
    empty = F.expr("CAST(array() AS array<string>)")
    out = df.join(rows, key, "left")
    return out.withColumns({hits: F.coalesce(hits, empty), level: worst_in(F.coalesce("_levels", empty))}).drop("_levels")


def flatten_directors(docs: DataFrame, key: str, column: str) -> DataFrame:
    """JSON director list to one row per officer; the last entry of a repeated officer id wins, in the place of its first."""
    shape = "array<struct<officerId: string, person: struct<firstName: string, lastName: string, dateOfBirth: string, nationalities: array<string>>>>"
    rows = docs.select(key, F.posexplode(F.from_json(column, shape)).alias("_pos", "_d"))
    flat = rows.select(key, F.coalesce("_d.officerId", F.lit("")).alias("officer_id"), "_pos",
                       F.lower(F.coalesce("_d.person.firstName", F.lit(""))).alias("director_first"),
                       F.lower(F.coalesce("_d.person.lastName", F.lit(""))).alias("director_last"),
                       F.col("_d.person.dateOfBirth").try_cast("date").alias("director_dob"),
                       F.coalesce("_d.person.nationalities", F.expr("CAST(array() AS array<string>)")).alias("nationalities"))
    last = F.max_by(F.struct("director_first", "director_last", "director_dob", "nationalities"), "_pos")
    return flat.groupBy(key, "officer_id").agg(last.alias("_r"), F.min("_pos").alias("position")).select(key, "officer_id", "position", "_r.*")


def match_directors(applicants: DataFrame, directors: DataFrame, key: str, threshold: float = 90.0) -> DataFrame:
    """Applicants joined to the directors of their own company with the same birth month and year and similar names.

    Blocking on (key, month, year) is an equi-join; pairs that share a token or cannot reach the threshold by their characters are decided in the
    JVM. The rest reach one Arrow function, which compares the last names only of those whose first names are similar.
    """
    left = applicants.withColumns({"_m": F.month("date_of_birth"), "_y": F.year("date_of_birth")})
    right = directors.withColumns({"_m": F.month("director_dob"), "_y": F.year("director_dob")})
    pairs = left.join(shuffled(right), [key, "_m", "_y"]).drop("_m", "_y")
    first = F.lower(F.coalesce("first_name", F.lit(""))), F.col("director_first")
    last = F.lower(F.coalesce("last_name", F.lit(""))), F.col("director_last")
    return keep_similar(pairs, first, last, ("first_similarity", "last_similarity"), threshold)


def first_director(applicants: DataFrame, directors: DataFrame, key: str, threshold: float = 90.0) -> DataFrame:
    """Every applicant with the officer id and nationalities of the first officer, in the register's order, that matches; else NULL."""
    first = F.min_by(F.struct("officer_id", "nationalities"), "position")
    found = match_directors(applicants, directors, key, threshold).groupBy(key).agg(first.alias("_d")).select(key, "_d.*")
    return applicants.join(shuffled(found), key, "left")


def nationality_risk(df: DataFrame, lists: list[str], countries: DataFrame, key: str, name: str = "nationality_risk") -> DataFrame:
    """The union of several nationality lists, sorted, and its worst risk; unknown countries and empty unions are ``Undefined``.

    ``countries`` (code, risk) is counted; up to ``encoders.LOOKUP_LIMIT`` codes it is a constant of the plan, so no row moves.
    Null-like entries do not count.
    """
    entries = F.concat(*(F.coalesce(F.col(c), F.expr("CAST(array() AS array<string>)")) for c in lists))
    union = F.array_sort(F.array_distinct(F.filter(entries, lambda x: ~is_missing(x) & (x != ""))))
    out = df.withColumn("nationalities_all", union)
    if countries.count() <= E.LOOKUP_LIMIT:
        ranked = countries.select(F.lit("risk").alias("feature"), F.col("code").alias("category"), F.col("risk").alias("value"))
        known = E.lookup_constant(ranked, "risk", "string")
        return out.withColumn(name, worst_in(F.transform("nationalities_all", lambda x: E.looked_up(known, x, UNDEFINED))))
    levels = out.select(key, F.explode("nationalities_all").alias("code")).join(countries, "code").groupBy(key).agg(F.collect_set("risk").alias("_risks"))
    return out.join(levels, key, "left").withColumn(name, worst_in(F.coalesce("_risks", F.expr("CAST(array() AS array<string>)")))).drop("_risks")


def director_features(applicants: DataFrame, directors: DataFrame, key: str) -> DataFrame:
    """Average whole age of all directors on the company's date and their number as a level; without directors the applicant's own age.

    ``applicants`` has the key, ``created_at`` and ``date_of_birth``. Directors' ages count from the first of their birth month.
    """
    born = directors.join(shuffled(applicants.select(key, "created_at")), key).filter(F.col("director_dob").isNotNull())
    age = F.date_diff("created_at", F.to_date(F.trunc("director_dob", "month"))) / F.lit(DAYS_PER_YEAR)
    per_company = born.groupBy(key).agg(F.avg(age).alias("_age"))
    sizes = directors.groupBy(key).agg(F.count("*").alias("_n"))
    own = F.date_diff("created_at", "date_of_birth") / F.lit(DAYS_PER_YEAR)
    joined = applicants.join(shuffled(per_company), key, "left").join(shuffled(sizes), key, "left")
    return joined.select(*applicants.columns, F.coalesce("_age", own).cast("int").alias("directors_avg_age"), count_level("_n").alias("directors_level"))
