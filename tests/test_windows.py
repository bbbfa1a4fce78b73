import datetime
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gatewise.operators import joins as J, windows as N


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_weighted_quantile_by_hand(spark):
    df = frame(spark, [(float(v), 1.0) for v in (1, 2, 3, 4)], "v double, w double")
    assert N.weighted_quantiles(df, "v", "w", [0.0, 0.5, 1.0]) == [1.0, 2.5, 4.0]
    assert N.weighted_quantiles(df, "v", "w", [0.25], old_style=True) == [1.75]
    with pytest.raises(ValueError):
        N.weighted_quantiles(df, "v", "w", [1.5])


def test_equal_weight_bins_by_hand(spark):
    df = frame(spark, [(s,) for s in (4, 3, 2, 1)], "s int")
    assert {r["s"]: r["bin"] for r in N.equal_weight_bins(df, "s", n=2).collect()} == {4: 0, 3: 0, 2: 1, 1: 1}


def test_zero_weight_at_the_top_gets_bin_zero(spark):
    df = frame(spark, [(9, 0.0), (5, 1.0), (1, 1.0)], "s int, w double")
    assert {r["s"]: r["bin"] for r in N.equal_weight_bins(df, "s", "w", 2).collect()} == {9: 0, 5: 0, 1: 1}


def test_max_rank_by_hand(spark):
    df = frame(spark, [(v,) for v in (0.5, 0.2, 0.2, 0.1)], "v double")
    assert {r["v"]: r["rank"] for r in N.max_rank(df, "v").collect()} == {0.5: 1, 0.2: 3, 0.1: 4}


def test_quantile_bins_with_ties(spark):
    df = frame(spark, [(0.0,)] * 8 + [(1.0,), (2.0,)], "v double")
    assert N.quantile_edges(df, "v", 5) == pytest.approx([0.0, 0.2, 2.0])
    assert {r["v"]: r["bin"] for r in N.quantile_bins(df, "v", 5).collect()} == {0.0: 0, 1.0: 1, 2.0: 1}


@pytest.mark.parametrize("descending", [False, True])
def test_bucketed_running_totals_equal_one_window(spark, split_ordered_work, descending):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randrange(40)) if rng.random() < 0.6 else 7.0, rng.randrange(5)) for _ in range(600)]
    df = frame(spark, rows, "g string, v double, w int")
    sums = {"w": F.sum("w"), "n": F.count(F.lit(1))}
    key = lambda r: (r["g"], r["v"], r["cum_w"], r["total_w"], r["cum_n"])
    many = sorted(map(key, N.cumulative_by_value(df, "v", sums, ["g"], descending, buckets=8).collect()))
    one = sorted(map(key, N.cumulative_by_value(df, "v", sums, ["g"], descending).collect()))
    assert many == one


def test_bucketed_quantiles_equal_numpy(spark, split_ordered_work):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=500), np.zeros(300)])
    df = frame(spark, [(float(v),) for v in values], "v double")
    probs = [0, 0.1, 0.333, 0.5, 0.9, 1]
    assert N.exact_quantiles(df, "v", probs, buckets=8) == pytest.approx(list(np.quantile(values, probs)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5)), min_size=1, max_size=40), st.integers(1, 6))
def test_bins_partition_the_rows(spark, rows, n):
    df = frame(spark, [(s, float(w)) for s, w in rows], "s int, w double")
    bins = N.equal_weight_bins(df, "s", "w", n, {"rows": F.count(F.lit(1))}).collect()
    assert sum(r["rows"] for r in bins) == len(rows)
    assert all(0 <= r["bin"] < n for r in bins)
    ordered = [r["bin"] for r in sorted(bins, key=lambda r: -r["s"])]
    assert ordered == sorted(ordered)


def test_time_folds_match_the_splitter(spark):
    start = datetime.date(2024, 1, 1)
    rng = random.Random(1)
    rows = [(k, start + datetime.timedelta(days=rng.randrange(5))) for k in range(100)]
    out = N.time_folds(frame(spark, rows, "k int, d date"), "d", "k").toPandas().sort_values("position")
    size = 100 // 6
    assert list(out["position"]) == list(range(100))
    assert out.groupby("fold").size().to_dict() == {0: 100 - 5 * size, **{f: size for f in range(1, 6)}}
    assert out["d"].is_monotonic_increasing


def test_asof_join_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    base = datetime.datetime(2024, 1, 1)

    def moment():
        return base + datetime.timedelta(minutes=rng.randrange(60 * 24 * 4))
    spine = [(i, 1 if rng.random() < 0.6 else rng.randrange(5), moment()) for i in range(300)]
    features = [(1 if rng.random() < 0.6 else rng.randrange(5), moment(), i) for i in range(60)]
    left = frame(spark, spine, "i int, k int, ts timestamp_ntz")
    right = frame(spark, features, "k int, fts timestamp_ntz, v int")
    got = {r["i"]: r["v"] for r in J.asof_join(left, right, "k", "ts", "fts", ["v"], bucket_seconds=3600 * 5).collect()}
    want = {}
    for i, k, ts in spine:
        before = [(f, v) for kk, f, v in features if kk == k and f <= ts]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_longest_prefix_by_hand(spark):
    table = frame(spark, [("WC", "High"), ("W", "Low")], "p string, risk string")
    df = frame(spark, [("WC2H",), ("W1",), ("ZZ9",), (None,)], "code string")
    got = {r["code"]: r["risk"] for r in J.prefix_lookup(df, "code", table, "p", "risk").collect()}
    assert got == {"WC2H": "High", "W1": "Low", "ZZ9": "Low", None: "Undefined"}


def test_pick_one_breaks_ties_by_the_whole_order(spark):
    df = frame(spark, [(1, 5, "a"), (1, 5, "b"), (2, 1, "z")], "k int, t int, v string")
    assert {r["k"]: r["v"] for r in N.pick_one(df, ["k"], ["t", "v"]).collect()} == {1: "b", 2: "z"}
    assert {r["k"]: r["v"] for r in N.pick_one(df, ["k"], ["t", "v"], largest=False).collect()} == {1: "a", 2: "z"}


def test_positions_are_complete_per_group(spark):
    df = frame(spark, [("x" if i % 3 else "y", i) for i in range(90)], "g string, i int")
    out = N.positions_within(df, ["g"], F.col("i") % 7, ["i"]).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["position"]) == list(range(len(part)))
        assert (part["group_size"] == len(part)).all()


def test_grouped_quantiles_equal_pandas(spark, split_ordered_work):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": rng.normal(size=400)})
    out = N.grouped_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"q1": 0.1, "q2": 0.75}, buckets=4).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert out.loc[g, "q1"] == pytest.approx(np.quantile(part["v"], 0.1))
        assert out.loc[g, "q2"] == pytest.approx(np.quantile(part["v"], 0.75))


@pytest.mark.parametrize("rows_in_order", [5, 200_000])
def test_quantiles_by_brackets(spark, monkeypatch, rows_in_order):
    """Ties that fill half of the rows, infinities and NaN, with brackets that must be cut again and without."""
    monkeypatch.setattr(N, "BRACKET_ROWS", rows_in_order)
    monkeypatch.setattr(N, "SKETCH_ACCURACY", 20)  # a coarse sketch: its cuts are far from the wanted ranks
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=700), np.full(600, 0.25), [np.inf, -np.inf, 1e300, -1e300], rng.integers(0, 3, 200)])
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.61, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "v double").repartition(6)
    want = [float("-inf"), *np.quantile(np.sort(values)[1:-1], [(p * (len(values) - 1) - 1) / (len(values) - 3) for p in probs[1:-1]]), float("inf")]
    assert N.exact_quantiles(df, "v", probs) == pytest.approx(want)
    with_nan = df.unionByName(spark.createDataFrame([(float("nan"),)] * 3000, "v double"))
    got = N.exact_quantiles(with_nan, "v", [0.0, 0.2, 0.5, 1.0])
    assert got[1] == pytest.approx(np.sort(values)[int(0.2 * (len(values) + 2999))], abs=0.02) and np.isnan(got[2]) and np.isnan(got[3])
    assert np.isnan(N.exact_quantiles(df.where("v IS NULL"), "v", [0.5])[0])


def test_weighted_quantiles_by_brackets(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values, weights = np.round(rng.normal(size=900), 2), rng.random(900)
    df = spark.createDataFrame([(float(v), float(w)) for v, w in zip(values, weights)], "v double, w double").repartition(5)
    probs = [0.0, 0.05, 0.3, 0.5, 0.77, 0.99, 1.0]
    distinct = np.unique(values)
    mass = np.array([weights[values == v].sum() for v in distinct])
    mid = np.cumsum(mass) - mass / 2
    for old_style in (False, True):
        place = (mid - mid[0]) / (mid[-1] - mid[0]) if old_style else mid / mass.sum()
        want = sorted(set(np.interp(probs, place, distinct)))
        whole = N.weighted_quantiles(df, "v", "w", probs, old_style)
        monkeypatch.setattr(N, "BRACKET_ROWS", 4)
        monkeypatch.setattr(N, "SKETCH_ACCURACY", 10)
        assert N.weighted_quantiles(df, "v", "w", probs, old_style) == pytest.approx(want) and whole == pytest.approx(want)
        monkeypatch.undo()


def test_selection_sorts_only_brackets(spark, monkeypatch):
    monkeypatch.setattr(N, "BRACKET_ROWS", 1000)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    cells = N.Brackets(df.withColumn("w", F.lit(1)))
    near = cells.around([25_000.5], [0.5])
    assert near.count() <= 1000 and N.exact_quantiles(df, "v", [0.5]) == [24_999.5]
