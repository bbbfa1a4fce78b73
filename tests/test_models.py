import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators import encoders as E, evaluate as V, models as G


def brute_mixed(pairs, rounds=25):
    """Joint penalised logistic fit in numpy."""
    n, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    u, s2 = np.zeros(len(n)), 0.5
    p0 = (y.sum() + 0.5) / (n.sum() + 1)
    b = math.log(p0 / (1 - p0))
    for _ in range(rounds * 8):
        p = 1 / (1 + np.exp(-(b + u)))
        info = n * p * (1 - p)
        d, g = info + 1 / s2, y - n * p - u / s2
        db = ((y - n * p).sum() - (info * g / d).sum()) / (info - info ** 2 / d).sum()
        u, b = u + (g - info * db) / d, b + db
        p = 1 / (1 + np.exp(-(b + u)))
        s2 = max((u ** 2 + 1 / (n * p * (1 - p) + 1 / s2)).mean(), 1e-4)
    return u


def test_mixed_encoding_of_planted_signal(spark):
    counts = spark.createDataFrame([("f", "A", 500, 150.0), ("f", "B", 499, 15.0), ("f", "C", 1, 0.0)], "feature string, category string, n bigint, y double")
    table = E.fit_mixed_encoding(counts, rounds=100, tolerance=1e-7)
    v = {r["category"]: r["value"] for r in table.collect()}
    assert v["A"] > 0 > v["B"] and v["B"] < v["C"] < v["A"]
    assert [v[c] for c in "ABC"] == pytest.approx(list(brute_mixed([(500, 150), (499, 15), (1, 0)])), abs=2e-3)
    coded = E.apply_encoding(spark.createDataFrame([("A",), ("new",), (None,)], "f string"), table, ["f"])
    assert {r["f"]: r["f_encoded"] for r in coded.collect()} == {"A": pytest.approx(v["A"]), "new": 0.0, None: 0.0}


def test_list_encoding_takes_the_largest(spark):
    table = spark.createDataFrame([("l", "a", 0.5), ("l", "b", -0.2)], "feature string, category string, value double")
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, []), (4, ["b", "new"])], "k int, l array<string>")
    assert {r["k"]: r["l_encoded"] for r in E.apply_list_encoding(df, "k", table, "l").collect()} == {1: 0.5, 2: -0.2, 3: None, 4: 0.0}


def brute_merge(counts, share=0.05):
    from itertools import combinations
    k, events, others = len(counts), sum(c[0] for c in counts), sum(c[1] for c in counts)
    best = 0.0
    for size in range(1, k):
        for cuts in combinations(range(1, k), size):
            ends = [0, *cuts, k]
            parts = [(sum(c[0] for c in counts[i:j]), sum(c[1] for c in counts[i:j])) for i, j in zip(ends, ends[1:])]
            rates = [e / (e + o) if e + o else 0 for e, o in parts]
            rising, falling = all(a < b for a, b in zip(rates, rates[1:])), all(a > b for a, b in zip(rates, rates[1:]))
            if (rising or falling) and all(e > 0 and o > 0 and e + o >= share * (events + others) for e, o in parts):
                best = max(best, sum((o / others - e / events) * math.log((o / others) / (e / events)) for e, o in parts))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_bin_merge_is_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = [(float(rng.integers(0, 12)), float(rng.integers(5, 60))) for _ in range(8)]
    ends = E.merge_bins(counts)
    starts = [0, *ends[:-1]]
    events, others = sum(c[0] for c in counts), sum(c[1] for c in counts)
    parts = [(sum(c[0] for c in counts[i:j]), sum(c[1] for c in counts[i:j])) for i, j in zip(starts, ends)]
    value = sum((o / others - e / events) * math.log((o / others) / (e / events)) for e, o in parts) if len(parts) > 1 else 0.0
    assert value == pytest.approx(brute_merge(counts))


def test_woe_missing_bin_is_its_own(spark):
    rows = [(1.0, 1)] * 2 + [(1.0, 0)] * 8 + [(9.0, 1)] * 6 + [(9.0, 0)] * 4 + [(None, 1)] * 5 + [(None, 0)] * 5
    fit = E.fit_woe_bins(spark.createDataFrame(rows, "v double, y int"), "v", "y", cuts=[5.0])
    assert fit["woe"] == pytest.approx([math.log((8 / 17) / (2 / 13)), math.log((4 / 17) / (6 / 13))])
    assert fit["missing"] == pytest.approx(math.log((5 / 17) / (5 / 13)))


def planted(spark, n=1500):
    base = spark.range(n, numPartitions=4).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("d"))
    y = ((F.col("a") > 6) & (F.pmod(F.xxhash64("id"), F.lit(10)) < 8)) | (F.pmod(F.xxhash64("id"), F.lit(50)) == 0)
    return base.withColumns({"y": y.cast("int"), "w": F.lit(1.0), "km": (F.col("id") % 3 != 0).cast("int"), "held": F.col("id") % 5 == 0})


@pytest.fixture(scope="module")
def boosted(spark):
    data = G.assemble(planted(spark), ["a", "b"]).persist()
    return data, G.fit_boosted(data, "y", "w", "held", rounds=6, depth=3, step=0.3)


def test_boosted_model_finds_the_signal(boosted):
    data, model = boosted
    scored = G.with_probability(data, model).withColumn("score", V.to_score("probability"))
    assert V.auc(scored, "score", "y", "w").first()["auc"] > 0.85


def test_path_contributions_add_up_to_the_margin(spark, boosted):
    data, model = boosted
    base = sum(w * r["value"] for w, r in zip(model.treeWeights, sorted(G.node_table(model, spark).filter("node = 0").collect(), key=lambda r: r["tree"])))
    rows = G.path_contributions(model.transform(data), model, ["a", "b"]).limit(50).select("contributions", "rawPrediction").collect()
    for r in rows:
        assert base + sum(r["contributions"]) == pytest.approx(r["rawPrediction"][1], abs=1e-6)



def test_calibration_recovers_a_known_sigmoid(spark):
    df = spark.range(4000).select((F.col("id") % 20 / 20.0).alias("s"), F.col("id"))
    p = 1 / (1 + F.exp(-(4 * F.col("s") - 3)))
    df = df.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000.0 < p).cast("int"))
    fit = G.fit_calibration(df, "s", "y")
    assert fit.coefficients[0] == pytest.approx(4, abs=0.6) and fit.intercept == pytest.approx(-3, abs=0.5)
    assert df.select(G.calibrated("s", fit).alias("p")).filter("p <= 0 OR p >= 1").count() == 0


def test_tree_rules_cover_every_row(spark):
    data = G.assemble(planted(spark), ["a", "b"])
    rules = G.tree_rules(G.fit_rule_tree(data, "y", "w", 2), data, ["a", "b"]).collect()
    assert sum(r["n"] for r in rules) == 1500 and any("a > 6" in r["rule"] for r in rules)


def test_parameter_search_returns_the_best_trial(spark):
    data = G.assemble(planted(spark, 600), ["a", "b"]).persist()
    best, table = G.search_boosted(data.filter("not held"), data.filter("held"), "y", "w", {"depth": [1, 2], "rounds": [1, 3]}, trials=3)
    rows = table.collect()
    assert len(rows) == 3
    top = min(rows, key=lambda r: r["loss"])
    assert (best["depth"], best["rounds"]) == (top["depth"], top["rounds"])


def test_time_cross_validation_has_every_fold(spark):
    data = G.assemble(planted(spark, 900), ["a", "b"]).persist()
    out = G.time_cross_validation(data, "d", "id", "y", "w", "km", folds=2, rounds=2, depth=2, step=0.5).toPandas()
    areas = out[out["metric"] == "auc"]
    assert len(areas) == 2 * 2 * 2 and areas["value"].between(0.7, 1).all()
    assert len(G.fold_summary(spark.createDataFrame(areas)).collect()) == 4


def test_scorecard_reason(spark):
    parts = G.scorecard_contributions({"a": 1.0, "b": -2.0}, {"a": 0.0, "b": 0.0})
    df = spark.createDataFrame([(3.0, 1.0), (1.0, -4.0), (0.0, 0.0)], "a double, b double").select(G.top_reason(parts).alias("r"))
    assert [r["r"] for r in df.collect()] == ["a", "b", "a"]


def test_sampled_grid_draws_distinct_places_of_the_product():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    every = G.sampled_grid(space, 99, 5)
    assert len(every) == 6 and {(g["a"], g["b"]) for g in every} == {(a, b) for a in space["a"] for b in space["b"]}
    assert len(G.sampled_grid({str(k): list(range(10)) for k in range(12)}, 4, 5)) == 4  # a product of 10^12 is never built


def test_halving_finds_a_set_no_worse_than_the_grid(spark):
    import random as rnd
    rng = rnd.Random(6)
    rows = [(i, x := rng.random(), rng.random(), int(rng.random() < (0.8 if x > 0.6 else 0.1)), 1.0) for i in range(900)]
    df = G.assemble(spark.createDataFrame(rows, "k int, a double, b double, y int, w double"), ["a", "b"])
    train, test = df.where("k < 600"), df.where("k >= 600")
    space = {"depth": [1, 2], "step": [0.05, 0.5], "rounds": [1, 3]}
    best, table = G.search_halving(train, test, "k", "y", "w", space, trials=8, least=0.3, keep=3)
    _, plain = G.search_boosted(train, test, "y", "w", space, trials=8, parallelism=4)
    losses = table.toPandas()
    assert list(losses.groupby("rung")["trial"].count()) == [8, 3, 1] and list(losses.groupby("rung")["share"].max()) == pytest.approx([0.3, 1 / 3, 1.0])
    final = losses[losses["rung"] == 2].iloc[0]
    assert {n: final[n] for n in space} == best
    assert final["loss"] <= plain.toPandas()["loss"].median()


def test_folds_read_their_own_blocks_only(spark, monkeypatch):
    """Fold f scans the folders of blocks 0 to f, and the summary has every measure once."""
    from gatewise.operators import models
    import datetime
    seen = []
    fit = models.fit_boosted
    monkeypatch.setattr(models, "fit_boosted", lambda train, *a, **k: (seen.append(sorted(r["fold"] for r in train.select("fold").distinct().collect())), fit(train, *a, **k))[1])
    rows = [(i, datetime.date(2023, 1, 1) + datetime.timedelta(days=i % 200), float(i % 17), int(i % 17 > 11), 1.0, 1) for i in range(600)]
    df = models.assemble(spark.createDataFrame(rows, "k int, d date, x double, y int, w double, ok int"), ["x"])
    metrics = models.time_cross_validation(df, "d", "k", "y", "w", "ok", folds=3, rounds=1, depth=1)
    assert sorted(seen) == [[0], [0, 1], [0, 1, 2]]
    areas = metrics.where("metric = 'auc'").collect()
    assert len(areas) == 12 and all(r["value"] > 0.9 for r in areas)
    assert {r["metric"] for r in models.fold_summary(metrics).collect()} >= {"auc"}


def test_noise_follows_the_key_not_the_partitions(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"))
    runs = [sorted((r["k"], r["x"]) for r in E.add_noise(df.repartition(n), "x", F.col("k") % 2 == 0, 0.5, 3, "k").collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    drawn = np.array([x - 1 for k, x in runs[0] if k % 2 == 0]) / 0.5
    assert all(x == 1.0 for k, x in runs[0] if k % 2) and abs(drawn.mean()) < 0.08 and abs(drawn.std() - 1) < 0.06


def test_cuts_of_many_features_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=500), 1), rng.integers(0, 3, 500).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None, int(x > 0.5)) for x, y in zip(a, b)], "a double, b double, n double, y int")
    cuts = E.quantile_cuts(df, ["a", "b", "n"], 10)
    for f, v in (("a", a), ("b", b)):
        assert cuts[f] == pytest.approx(list(np.unique(np.quantile(v, np.linspace(0, 1, 11))))[1:-1])
    assert cuts["n"] == []
    merged = {f["feature"]: f for f in E.fit_many_woe_bins(df, cuts, "y", max_bins=4)}
    assert merged["a"] == E.fit_woe_bins(df, "a", "y", pre_bins=10, max_bins=4)


def test_training_weight_balances_classes(spark):
    import datetime
    from gatewise.operators import weights as X
    rows = [(i, datetime.date(2023, 1, 1 + i % 28), 1, float(i % 7), 1.0, int(i % 10 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, d date, ok int, amount double, w double, y int")
    out = X.training_weight(df, "d", "ok", "amount", "w", "y").toPandas()
    parts = X.combined_weight(X.time_decay(df, "d", "t"), "ok", "amount", "w", "c").toPandas()
    want = parts["t"] * parts["c"] * np.where(parts["y"] == 1, 200 / 40, 200 / 360)
    assert out["fit_weight"].sum() == pytest.approx(200) and np.allclose(out["fit_weight"], want * 200 / want.sum())
