import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gatewise.operators import decide as D, evaluate as V, stats as Z, weights as X

FIXTURE = [HealthCheck.function_scoped_fixture]


def scored(spark, rows):
    return spark.createDataFrame([(s, y, 1, float(w)) for s, y, w in rows], "score int, y int, km int, w double")


def test_threshold_by_hand(spark):
    df = scored(spark, [(3, 1, 1), (2, 0, 1), (1, 1, 1), (0, 0, 1)])
    r = V.threshold_metrics(df, "score", "y", "km", "w", [2]).first()
    assert (r["precision"], r["recall"], r["fpr"], r["group_size"]) == (50, 50, 50, 50)


def step_search(rows, limits):
    """The stepwise search, one pass over the rows per candidate."""
    lo_p, hi_r, hi_g, ap, ar, ag = limits
    score, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def rates(hit):
        p, n = y[hit].sum(), (1 - y[hit]).sum()
        return (round(100 * p / (p + n), 3) if p + n else 0, round(100 * p / y.sum(), 3) if y.sum() else 0, round(100 * hit.sum() / len(y), 3))
    t, high = score.max(), None
    while t >= score.min():
        a, b, c = rates(score >= t)
        if not (a >= lo_p and b <= hi_r and c <= hi_g):
            high = t
            break
        t -= 1
    t, low = score.min(), None
    while t <= score.max() + 1:
        a, b, c = rates(score < t)
        if not (a <= ap and b <= ar and c <= ag):
            low = t
            break
        t += 1
    return {k: v for k, v in (("medium_high", high), ("low_medium", low)) if v is not None}


@settings(max_examples=10, deadline=None, suppress_health_check=FIXTURE)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 1), st.just(1)), min_size=2, max_size=40))
def test_threshold_search_equals_stepping(spark, rows):
    limits = (0, 100, 10, 100, 15, 45)
    got = {r["edge"]: r["threshold"] for r in V.threshold_search(scored(spark, rows), "score", "y", "km", "w", *limits).collect()}
    assert got == step_search(rows, limits)


def area(rows):
    pairs = [(a, b) for a in rows for b in rows if a[1] == 1 and b[1] == 0]
    weight = sum(a[2] * b[2] for a, b in pairs)
    return sum(a[2] * b[2] * (1.0 if a[0] > b[0] else 0.5 if a[0] == b[0] else 0.0) for a, b in pairs) / weight if weight else None


@settings(max_examples=8, deadline=None, suppress_health_check=FIXTURE)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1), st.integers(1, 3)), min_size=2, max_size=25))
def test_auc_equals_pair_counting_and_ignores_monotone_transforms(spark, rows):
    df = scored(spark, rows)
    want = area(rows)
    for frame in (df, df.withColumn("score", F.col("score") * F.col("score") + 3)):
        got = V.auc(frame, "score", "y", "w").first()["auc"]
        assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("raw, want", [(0, 201), (2, 333), (3, 400), (11, 601), (12, 602), (1000, 999)])
def test_standard_score_by_hand(spark, raw, want):
    assert spark.range(1).select(D.standardise_score(F.lit(raw), 12, 3).alias("r")).first()["r"] == want


def test_adjacent_thresholds_do_not_divide_by_zero(spark):
    assert spark.range(1).select(D.standardise_score(F.lit(5), 6, 5).alias("r")).first()["r"] == 400


@pytest.mark.parametrize("high, medium", [(12, 3), (22, 3), (700, 300)])
def test_raw_and_standard_bands_agree_for_every_score(spark, high, medium):
    every = spark.range(0, 1001).withColumn("score", F.col("id").cast("int"))
    decided = D.decide(every, "score", high, medium)
    assert D.inconsistent_bands(decided, high, medium).count() == 0
    ratings = [r["rating"] for r in decided.orderBy("score").collect()]
    assert ratings == sorted(ratings)
    assert decided.filter("decision = 'BAU' AND reason IS NOT NULL").count() == 0


def test_payload_missing_column_fails_before_any_job(spark):
    with pytest.raises(ValueError):
        D.payload_features(spark.range(1), [("GB", "GBR")], ["id"])


def test_lift_report_checks(spark):
    df = scored(spark, [(5, 1, 1)] * 10)
    with pytest.raises(ValueError):
        V.check_full_bins(V.lift_report(df, "score", "y", n=4), 4)
    with pytest.raises(ValueError):
        V.check_binary(df.withColumn("y", F.lit(2)), "y")


@settings(max_examples=6, deadline=None, suppress_health_check=FIXTURE)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 1), st.integers(1, 3)), min_size=3, max_size=40))
def test_lift_report_totals(spark, rows):
    report = V.lift_report(scored(spark, rows), "score", "y", "w", 5).toPandas().sort_values("bin")
    assert report["N"].sum() == len(rows)
    assert report["weight"].sum() == pytest.approx(sum(r[2] for r in rows))
    assert report["cum_responders"].iloc[-1] == sum(r[1] for r in rows)


def test_augment_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (2, 0, 0, 0.2)], "k int, km int, y int, p double")
    rows = sorted((r["k"], r["y"], round(r["weights"], 6)) for r in X.augment_rejects(df, "km", "y", "p").collect())
    assert rows == [(1, 1, 1.0), (2, 0, 0.8), (2, 1, 0.2)]


@settings(max_examples=5, deadline=None, suppress_health_check=FIXTURE)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.floats(0, 1)), min_size=1, max_size=20))
def test_augmented_weights_sum_to_the_row_count(spark, rows):
    df = spark.createDataFrame([(a, y, float(p)) for a, y, p in rows], "km int, y int, p double")
    assert X.augment_rejects(df, "km", "y", "p").agg(F.sum("weights")).first()[0] == pytest.approx(len(rows))


def test_time_decay_by_hand(spark):
    df = spark.sql("SELECT DATE '2024-01-01' AS d UNION ALL SELECT DATE '2024-01-11'")
    assert sorted(r["decay_weight"] for r in X.time_decay(df, "d").collect()) == pytest.approx([0.5379, 1.4621], abs=1e-4)


def test_split_parts_add_up(spark):
    df = spark.range(100).selectExpr("id", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS d")
    parts = {r["data_type"]: r["count"] for r in X.tag_split(df, "d", [("train", "2024-02-01"), ("test", "2024-03-01")], "val").groupBy("data_type").count().collect()}
    assert sum(parts.values()) == 100 and set(parts) == {"train", "test", "val"}


def test_random_halves_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    a = {r["id"]: r["half"] for r in X.random_halves(df.repartition(3), "id").collect()}
    b = {r["id"]: r["half"] for r in X.random_halves(df.repartition(7), "id").collect()}
    assert a == b and 150 < sum(v == "test" for v in a.values()) < 350


def test_information_value_by_hand(spark):
    rows = [(0, 1)] + [(0, 0)] * 3 + [(1, 1)] * 3 + [(1, 0)]
    df = spark.createDataFrame(rows, "b int, y int")
    assert Z.information_value(df, "b", "y").first()["iv"] == 1.099
    assert Z.information_value(df.withColumn("b", F.lit(1)), "b", "y").first()["iv"] == 0.0


def test_student_p_values():
    # Values of the t distribution from standard tables.
    assert Z.student_p_value(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert Z.student_p_value(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert Z.student_p_value(0.0, 5) == pytest.approx(1.0)
    assert Z.student_p_value(-12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_variance_inflation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 400))
    c = a + 0.5 * b + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    want = np.diag(np.linalg.inv(np.corrcoef([a, b, c])))
    got = {r["feature"]: r["vif"] for r in Z.variance_inflation(df, ["a", "b", "c"]).collect()}
    assert [got[k] for k in "abc"] == pytest.approx(want, abs=0.01)
    assert Z.explained_variance(df, ["a", "b", "c"], ["a", "b", "c"]).first()["ratio"] == pytest.approx(1.0)


def test_balancing_moves_the_sample_towards_the_population(spark):
    rng = np.random.default_rng(4)
    people = rng.normal(size=(3000, 2))
    keep = rng.random(3000) < 1 / (1 + np.exp(-2 * np.abs(people[:, 0]) + 1))
    population = spark.createDataFrame([(float(a), float(b)) for a, b in people], "a double, b double")
    sample = spark.createDataFrame([(float(a), float(b)) for a, b in people[keep]], "a double, b double")
    fit = X.fit_balancing(population, ["a", "b"], bins=10)
    out = X.balance_weights(sample, fit).toPandas()
    target, plain = (people[:, 0] ** 2).mean(), (people[keep][:, 0] ** 2).mean()
    weighted = np.average(out["a"] ** 2, weights=out["weight"])
    assert abs(weighted - target) < abs(plain - target)
    assert out["weight"].mean() == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        X.balance_weights(sample.limit(3), fit)


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def _mixed_columns(n=400):
    rng = np.random.default_rng(12)
    columns = {"few": rng.integers(0, 4, n).astype(float), "wide": np.round(rng.normal(size=n), 2), "gaps": np.where(rng.random(n) < 0.2, np.nan, np.round(rng.exponential(size=n), 1)), "flat": np.ones(n)}
    y = (rng.random(n) < 0.2 + 0.3 * (columns["wide"] > 0.3)).astype(int)
    return columns, y


@pytest.mark.parametrize("rows_in_order", [3, 200_000])
def test_information_values_of_all_features_at_once(spark, monkeypatch, rows_in_order):
    from gatewise.operators import windows
    monkeypatch.setattr(windows, "BUCKET_ROWS", rows_in_order)
    columns, y = _mixed_columns()
    names = list(columns)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r[:-1]) + (int(r[-1]),) for r in zip(*columns.values(), y)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y int").repartition(4)
    got, jobs = _jobs(spark, f"iv{rows_in_order}", lambda: {r["feature"]: r["iv"] for r in Z.information_values(df, names, "y").collect()})
    want = {}
    for c, v in columns.items():
        filled = np.where(np.isnan(v), np.nanmedian(v), v)
        values = np.unique(v[~np.isnan(v)])
        edges = np.unique(np.quantile(filled, np.linspace(0, 1, 6)))
        place = filled if len(values) <= 10 else np.maximum(np.searchsorted(edges, filled, "left"), 1)
        iv = 0.0
        for b in np.unique(place):
            pn, py = ((place == b) & (y == 0)).sum() / (y == 0).sum(), ((place == b) & (y == 1)).sum() / (y == 1).sum()
            iv += (pn - py) * np.log(pn / py) if pn > 0 and py > 0 else 0.0
        want[c] = round(iv, 3)
    assert got == pytest.approx(want, abs=0.0011)
    _, alone = _jobs(spark, f"iv-one{rows_in_order}", lambda: Z.information_values(df, ["gaps"], "y").collect())
    assert jobs < 1.5 * alone  # adaptive execution starts a job per stage; their number does not grow with the features


def test_spearman_by_broadcast_and_by_join(spark, monkeypatch):
    columns, _ = _mixed_columns()
    names = list(columns)
    frame = pd.DataFrame(columns).dropna()
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in frame.itertuples(index=False)] + [(None, 1.0, 1.0, 1.0)], ", ".join(f"{c} double" for c in names))
    want = frame.rank().corr()
    for limit in (100_000, 1):
        monkeypatch.setattr(Z, "BROADCAST_ROW_LIMIT", limit)
        for r in Z.spearman(df.select(names[:3]), names[:3]).collect():
            assert r["correlation"] == pytest.approx(want.loc[r["first"], r["second"]])


def test_variance_inflation_of_exact_relations(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(y), float(x + y), float(z), 1.0) for x, y, z in zip(a, b, rng.normal(size=300))], "a double, b double, s double, free double, flat double")
    got = {r["feature"]: r["vif"] for r in Z.variance_inflation(df, ["a", "b", "s", "free", "flat"]).collect()}
    assert got["a"] == got["b"] == got["s"] == 1000.0 and got["free"] == pytest.approx(1.0, abs=0.05) and got["flat"] == 1.0
