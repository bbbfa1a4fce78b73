"""Tables of several files, values that are no plain numbers, and fits that must converge."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gatewise.operators import encoders, windows
from gatewise.streaming import decisions as S

FOLDER = "/root/testdata/sf0.001"
STREAMS = ["stream_decisions", "stream_rates", "stream_sliding_rates", "stream_sessions", "stream_dedupe", "stream_latest_batches", "stream_latest_state", "stream_label_maturation"]


@pytest.fixture(scope="module")
def several_files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(4, "event_id").write.parquet(f"{folder}/events.parquet")
    for name in ("orders", "customer", "nation", "region", "lineitem"):  # the members whose payloads are decided on
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_a_table_of_several_files(spark, several_files, name):
    rows = [sorted(map(str, entry.queries()[name](spark, d).collect())) for d in (FOLDER, several_files)]
    assert rows[0] and rows[0] == rows[1]


def test_latest_over_many_batches(spark, several_files):
    events = S.event_stream(spark, several_files, "events", "ts", files_per_trigger=1)
    updates = S.available_rows(S.latest_rows(events, "user_id", "ts", "event_id", "props"), "t_many", "update")
    got = {(r["key"], r["event_id"]) for r in S.newest_update(updates).collect()}
    want = spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert got == {(r["user_id"], r["e"]) for r in want.collect()}


@pytest.mark.parametrize("rows", [2, 1000])
def test_running_totals_with_nan_and_infinite_values(spark, monkeypatch, rows):
    monkeypatch.setattr(windows, "BUCKET_ROWS", rows)
    values = [float("-inf"), -1.0, 0.0, 0.0, 2.5, 7.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {str(r["v"]): r["cum_n"] for r in windows.cumulative_by_value(df, "v", {"n": F.count(F.lit(1))}, buckets=8).collect()}
    assert got == {"-inf": 1, "-1.0": 2, "0.0": 4, "2.5": 5, "7.0": 6, "inf": 7, "nan": 8}


def test_ratio_table_with_a_category_of_positives_alone(spark, monkeypatch):
    monkeypatch.setattr(windows, "BUCKET_ROWS", 1)
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("c", 0), ("d", 1)], "c string, y int")
    assert {r["category"]: r["place"] for r in encoders.ratio_table(df, ["c"], "y").collect()} == {"a": 2, "d": 2, "b": 3, "c": 4}


def test_mixed_encoding_meets_its_tolerance_on_a_weak_signal(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(20, 200, 60)
    y = rng.binomial(n, 1 / (1 + np.exp(2 - 0.05 * rng.standard_normal(60))))
    counts = spark.createDataFrame([("f", f"c{k}", int(a), float(b)) for k, (a, b) in enumerate(zip(n, y))], "feature string, category string, n long, y double")
    got = {r["category"]: r["value"] for r in encoders.fit_mixed_encoding(counts).collect()}
    b, s2 = math.log(y.sum() / (n.sum() - y.sum())), 0.5
    for _ in range(20_000):
        u = np.zeros(60)
        for _ in range(40):
            p = 1 / (1 + np.exp(-(b + u)))
            u += (y - n * p - u / s2) / (n * p * (1 - p) + 1 / s2)
        p = 1 / (1 + np.exp(-(b + u)))
        info = n * p * (1 - p)
        total = info + 1 / s2
        b2, s3 = b + (y - n * p).sum() / (info - info**2 / total).sum(), max((u * u + 1 / total).mean(), 1e-4)
        done = abs(b2 - b) < 1e-8 and abs(s3 - s2) < 1e-8
        b, s2 = b2, s3
        if done:
            break
    assert max(abs(got[f"c{k}"] - u[k]) for k in range(60)) < 2e-3
    with pytest.raises(RuntimeError):
        encoders.fit_mixed_encoding(counts, rounds=2)
