"""The chain from payload to decision: one parse per envelope, no shuffle, equal on tables and streams, and from files alone."""

import re

import pytest
from pyspark.sql import functions as F

from gatewise.operators import decide as D, encoders as E
from gatewise.plans import decisions as P
from gatewise.streaming import decisions as S

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    return P.saved_chain(spark, FOLDER)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_envelopes_are_parsed_once_and_no_row_moves(spark, chain):
    payloads = spark.read.parquet(stage(spark, chain))
    decided = D.decide_payloads(payloads, P.PAIRS, D.load_chain(spark, chain), P.HIGH, P.MEDIUM, ["company_id"])
    text = plan(decided)
    assert "Exchange" not in text and "Join" not in text
    assert len(re.findall(r"from_json\(", text)) == len(D.LIST_ENVELOPES + D.VALUE_ENVELOPES)


def stage(spark, chain):
    path = f"{chain}/test-payloads"
    P.payloads(spark, FOLDER).write.mode("overwrite").parquet(path)
    return path


def test_stream_equals_table(spark, chain):
    path = stage(spark, chain)
    loaded = D.load_chain(spark, chain)
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = lambda df: D.decide_payloads(df, P.PAIRS, loaded, P.HIGH, P.MEDIUM, ["company_id"])
    got = S.available_rows(S.decide_stream(stream, run), "t_chain", "append")
    assert sorted(got.collect(), key=str) == sorted(run(table).collect(), key=str)
    assert {r["category"] for r in got.collect()} >= {"LOW", "MEDIUM"}


def test_later_period_reads_its_own_folder_only(spark, chain):
    scored = P.score_later_period(spark, FOLDER)
    assert re.search(r"PartitionFilters: \[[^\]]*data_type[^\]]*val", plan(scored))


def test_saved_and_loaded_chain_scores_alike(spark, chain):
    train = P.load(spark, FOLDER, "members").filter("is_approved = 1 AND data_type = 'train'")
    features = D.payload_features(D.payload_from_members(train, P.KEYWORDS, ["company_id", "is_app_fraud"]), P.PAIRS, ["company_id", "is_app_fraud"])
    fitted = D.fit_chain(features, "is_app_fraud", P.CUTS, P.SCORECARD, P.INTERCEPT, lambda c: E.fit_smoothed_encoding(c, "m"))
    loaded = D.load_chain(spark, chain)
    for a, b in zip(fitted, loaded):
        assert sorted(map(str, a.select([c for c in a.columns if c not in ("value", "woe", "mean")]).collect())) == sorted(map(str, b.select([c for c in a.columns if c not in ("value", "woe", "mean")]).collect()))
    for frame in (fitted, loaded):
        scored, _ = D.score_features(features, frame, ["company_id"])
        scores = sorted((r["company_id"], r["score"]) for r in scored.collect())
        assert scores == (first := scores if frame is fitted else first)


def test_lookups_know_null_and_unseen_categories(spark):
    table = spark.createDataFrame([("f", "a", 1.5), ("f", None, -2.0), ("f", "", 0.25), ("f", "=a", 9.0), ("g", "b", 3.0)], "feature string, category string, value double")
    known = E.lookup_constant(table, "f")
    rows = spark.createDataFrame([(1, "a", ["a", "zz"]), (2, None, [None, "zz"]), (3, "zz", ["zz"]), (4, "", []), (5, "=a", None), (6, "b", ["", "=a"])], "k int, c string, l array<string>")
    got = {r["k"]: (r["v"], r["m"]) for r in rows.select("k", E.looked_up(known, F.col("c"), 0.5).alias("v"), E.looked_up_largest(known, "l", 0.5).alias("m")).collect()}
    assert got == {1: (1.5, 1.5), 2: (-2.0, 0.5), 3: (0.5, 0.5), 4: (0.25, None), 5: (9.0, None), 6: (0.5, 9.0)}


def test_large_list_tables_are_joined(spark, monkeypatch):
    table = spark.createDataFrame([("f", f"c{i}", float(i)) for i in range(30)], "feature string, category string, value double")
    df = spark.createDataFrame([(1, ["c3", "c7"]), (2, ["x"]), (3, [])], "k int, f array<string>")
    small = sorted(E.apply_list_encoding(df, "k", table, "f").collect())
    assert "Exchange" not in plan(E.apply_list_encoding(df, "k", table, "f"))
    monkeypatch.setattr(E, "LOOKUP_LIMIT", 10)
    assert sorted(E.apply_list_encoding(df, "k", table, "f").collect()) == small
    with pytest.raises(ValueError):
        E.lookup_constant(table, "f")


def test_bins_survive_the_table(spark):
    df = spark.createDataFrame([(float(i), None if i % 11 == 0 else float(i % 40), int(i % 3 == 0)) for i in range(300)], "i double, v double, y int")
    fits = E.fit_many_woe_bins(df, {"v": [10.0, 20.0], "i": [50.0, 100.0, 200.0]}, "y")
    for fit in fits:
        one = E.fit_woe_bins(df, fit["feature"], "y", cuts=[10.0, 20.0] if fit["feature"] == "v" else [50.0, 100.0, 200.0])
        assert fit == one
        assert E.woe_fits(E.woe_bin_table(spark, fits))[fit["feature"]] == {k: fit[k] for k in ("feature", "edges", "woe", "missing")}
