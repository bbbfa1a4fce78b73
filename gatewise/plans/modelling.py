"""Registered model queries. Fits are small here; the same calls take larger trees and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import decide as D, encoders as E, models as G
from gatewise.operators.weights import augment_rejects, class_weights, training_weight
from gatewise.plans.decisions import COEFFICIENTS, MEANS, PAIRS
from gatewise.plans.evaluation import WEIGHT, _r
from gatewise.plans.expressions import KEYWORDS
from gatewise.plans.registry import query
from gatewise.session import cut_lineage, staged
from gatewise.sources.standins import load

CATEGORIES = ["applicant_id_type", "company_icc", "applicant_country"]
NUMBERS = ["age_at_completion", "company_age_months", "years_to_id_expiry", "identity_address_fail", "failed_rules"]
FEATURES = [*(f"{c}_encoded" for c in CATEGORIES), *NUMBERS]
SMALL = {"rounds": 5, "depth": 3, "step": 0.3}


def prepared(spark, d):
    """Members with encoded categories and the assembled vector; encoders see approved training rows only."""
    m = load(spark, d, "members").select("company_id", "created_on", "is_approved", "is_app_fraud", "app_fraud_amount", "data_type", F.expr(WEIGHT).cast("double").alias("w"), *CATEGORIES, *NUMBERS)
    table = E.fit_smoothed_encoding(E.category_counts(m.filter("is_approved = 1 AND data_type = 'train'"), CATEGORIES, "is_app_fraud"), "woe")
    return cut_lineage(G.assemble(E.apply_encoding(m, table, CATEGORIES), FEATURES))


def km_train(frame):
    return frame.filter("is_approved = 1 AND data_type <> 'val'").withColumn("held_out", F.col("data_type") == "test")


@query("gbt_scores", ())
def gbt_scores(spark, d):
    """Boosted trees with early stopping on the test period, sigmoid calibration, and the score table of everybody."""
    p = prepared(spark, d)
    model = G.fit_boosted(km_train(p), "is_app_fraud", "w", "held_out", **SMALL)
    scored = G.with_probability(p, model)
    fit = G.fit_calibration(scored.filter("is_approved = 1 AND data_type = 'train'"), "probability", "is_app_fraud", "w")
    return G.score_table(scored.withColumn("calibrated", G.calibrated("probability", fit)), ["company_id"], "calibrated", "probability", "is_app_fraud", "app_fraud_amount", "is_approved", "w", "created_on")


@query("chain_gbt_scores", ())
def chain_gbt_scores(spark, d):
    """Boosted trees behind the whole encoding chain: mixed encodings of all categories with noise on training rows, lists by their largest entry,
    industry and codes combined, merged WOE bins at quantiles, and decay x combined x class weights; early stopping on the test period."""
    keep = ["company_id", "created_on", "is_approved", "is_app_fraud", "app_fraud_amount", "data_type", "w"]
    members = load(spark, d, "members").withColumn("w", F.expr(WEIGHT).cast("double"))
    features = staged(D.payload_features(D.payload_from_members(members, KEYWORDS, keep), PAIRS, keep))
    learn = (F.col("is_approved") == 1) & (F.col("data_type") == "train")
    encoded = D.encode_features(features, D.fit_encodings(features.filter(learn), "is_app_fraud"))
    for i, f in enumerate(D.WOE_INPUTS):
        if f.endswith("_encoded"):
            encoded = E.add_noise(encoded, f, learn, 0.01, i, "company_id")
    encoded = staged(encoded)
    train = encoded.filter(learn)
    bins = E.woe_bin_table(spark, E.fit_many_woe_bins(train, E.quantile_cuts(train, D.WOE_INPUTS), "is_app_fraud", max_bins=8))
    inputs = [*(f"{f}_woe" for f in D.WOE_INPUTS), *D.FLAGS]
    whole = staged(G.assemble(training_weight(D.model_inputs(encoded, bins), "created_on", "is_approved", "app_fraud_amount", "w", "is_app_fraud").select(*keep, "fit_weight", *inputs), inputs))
    scored = G.with_probability(whole, G.fit_boosted(km_train(whole), "is_app_fraud", "fit_weight", "held_out", **SMALL))
    fit = G.fit_calibration(scored.filter(learn), "probability", "is_app_fraud", "w")
    return G.score_table(scored.withColumn("calibrated", G.calibrated("probability", fit)), ["company_id"], "calibrated", "probability", "is_app_fraud", "app_fraud_amount", "is_approved", "w", "created_on")


def _first_scores(p):
    """Everybody's calibrated probability ``p`` by the model of approved members."""
    first = G.with_probability(p, G.fit_boosted(km_train(p), "is_app_fraud", "w", "held_out", **SMALL))
    fit = G.fit_calibration(first.filter("is_approved = 1 AND data_type = 'train'"), "probability", "is_app_fraud", "w")
    return first.withColumn("p", G.calibrated("probability", fit))


@query("reject_inference_scores", ())
def reject_inference_scores(spark, d):
    """Scores of the approved-member model turn each reject into two weighted rows; a second model is fitted on all of them."""
    p = prepared(spark, d)
    inferred = augment_rejects(_first_scores(p).drop("probability"), "is_approved", "is_app_fraud", "p")
    final = G.fit_boosted(inferred.filter("data_type = 'train' AND weights > 0"), "is_app_fraud", "weights", **SMALL)
    return G.with_probability(p, final).select("company_id", F.round("probability", 6).alias("probability"))


@query("tree_rules", ())
def tree_rules(spark, d):
    t = prepared(spark, d).filter("is_approved = 1 AND data_type = 'train'")
    balanced = class_weights(t, "is_app_fraud").select("is_app_fraud", "class_weight")
    weighted = t.join(F.broadcast(balanced), "is_app_fraud")
    return G.tree_rules(G.fit_rule_tree(weighted, "is_app_fraud", "class_weight", 2), t, FEATURES)


@query("feature_importances", ())
def feature_importances(spark, d):
    t = staged(load(spark, d, "members").filter("is_approved = 1 AND data_type = 'train'").select("is_app_fraud", *CATEGORIES, *NUMBERS))
    return G.importances(G.fit_category_model(t, CATEGORIES, NUMBERS, "is_app_fraud", rounds=3, depth=3), t, [*CATEGORIES, *NUMBERS])


@query("parameter_search", ())
def parameter_search(spark, d):
    p = prepared(spark, d).filter("is_approved = 1")
    space = {"depth": [2, 3], "step": [0.1, 0.3], "rounds": [2, 3], "min_rows": [1, 20]}
    return G.search_boosted(p.filter("data_type = 'train'"), p.filter("data_type = 'test'"), "is_app_fraud", "w", space, trials=2)[1]


@query("parameter_halving", ())
def parameter_halving(spark, d):
    """27 parameter sets by successive halving: one of them is fitted on all rows."""
    p = prepared(spark, d).filter("is_approved = 1")
    space = {"depth": [1, 2, 3], "step": [0.1, 0.2, 0.3], "rounds": [1, 2, 3], "min_rows": [1, 20]}
    return G.search_halving(p.filter("data_type = 'train'"), p.filter("data_type = 'test'"), "company_id", "is_app_fraud", "w", space, trials=27, least=0.1)[1]


@query("tree_reasons", ())
def tree_reasons(spark, d):
    p = prepared(spark, d)
    model = G.fit_boosted(km_train(p), "is_app_fraud", "w", "held_out", **SMALL)
    return G.path_contributions(p, model, FEATURES).select("company_id", G.reason_from_array("contributions", FEATURES).alias("reason"), "contributions")


@query("time_cross_validation", ())
def time_cross_validation(spark, d):
    """Labels of rejected members stay unseen: they are inferred from the model of approved members."""
    first = _first_scores(prepared(spark, d)).drop("probability")
    return G.time_cross_validation(first, "created_on", "company_id", "is_app_fraud", "w", "is_approved", inferred="p", folds=5, rounds=2, depth=2, step=0.3)



@query("time_cross_validation_summary", ())
def time_cross_validation_summary(spark, d):
    """Mean and spread of every measure over the folds."""
    return G.fold_summary(time_cross_validation(spark, d))


@query("score_table", ("applications",), f"SELECT company_id, is_app_fraud, CAST(created_on AS VARCHAR) AS created_on, app_fraud_amount, CAST(round_even(balance / 10000 * 1000, 0) AS INTEGER) AS rating, CAST(round_even(score / 7777 * 1000, 0) AS INTEGER) AS rating_uncalibrated, CAST({WEIGHT} AS DOUBLE) AS weight, is_approved, ROUND(is_app_fraud * CAST({WEIGHT} AS DOUBLE), 6) AS label_w FROM applications")
def score_table(spark, d):
    a = load(spark, d, "applications").withColumns({"w": F.expr(WEIGHT).cast("double"), "p": F.col("balance") / 10000, "q": F.col("score") / 7777})
    out = G.score_table(a, ["company_id"], "p", "q", "is_app_fraud", "app_fraud_amount", "is_approved", "w", "created_on")
    return out.withColumns({"created_on": F.col("created_on").cast("string"), "label_w": F.round("label_w", 6)})


_CONTRIBUTION = {f: f"{c} * ({f} - {MEANS[f]})" for f, c in COEFFICIENTS.items()}


@query("scorecard_reason", ("members",), "p AS (SELECT company_id, " + ", ".join(f"{e} AS p{i}" for i, e in enumerate(_CONTRIBUTION.values())) + " FROM members) SELECT company_id, CASE "
       + " ".join(f"WHEN p{i} = GREATEST(p0, p1, p2, p3) THEN '{f}'" for i, f in enumerate(_CONTRIBUTION)) + " END AS reason FROM p")
def scorecard_reason(spark, d):
    return load(spark, d, "members").select("company_id", G.top_reason(G.scorecard_contributions(COEFFICIENTS, MEANS)).alias("reason"))


@query("mean_contribution", ("members",), " UNION ALL ".join(f"SELECT '{f}' AS feature, ROUND(AVG(ABS({e})), 6) AS mean_abs FROM members" for f, e in _CONTRIBUTION.items()))
def mean_contribution(spark, d):
    return _r(G.mean_contribution(load(spark, d, "members"), G.scorecard_contributions(COEFFICIENTS, MEANS)))


@query("feature_dependence", ("members",), f"SELECT CAST(FLOOR(age_at_completion / 10) AS BIGINT) AS value, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG({_CONTRIBUTION['age_at_completion']}), 6) AS contribution FROM members GROUP BY 1")
def feature_dependence(spark, d):
    parts = G.scorecard_contributions(COEFFICIENTS, MEANS)
    return _r(G.dependence(load(spark, d, "members"), F.floor(F.col("age_at_completion") / 10), parts["age_at_completion"]))
