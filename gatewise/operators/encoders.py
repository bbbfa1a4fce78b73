"""Category encoders and binning. Fitting is an aggregate that yields a small table; applying it is a join or an expression."""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.operators.aggregates import long_features
from gatewise.operators.windows import cumulative_by_value, cumulative_in_groups, edge_bin, exact_quantiles, quantile_edges, quantiles_of_groups
from gatewise.session import broadcast_if_small, cut_lineage, staged


# ---- category counts and encodings -------------------------------------------------------------------------------

def category_counts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows and positives per (feature, category): the sufficient statistics of every category encoder.

    NULL stays a category of its own (it is never turned into 0).
    """
    return long_features(df, features, [label]).groupBy("feature", F.col("value").alias("category")).agg(
        F.count("*").alias("n"), F.sum(label).cast("double").alias("y"))


LEAST_SPREAD = 1e-4


def list_category_counts(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Counts on the first entry of a list feature, the slot its encoder is fitted on."""
    first = df.select(F.try_element_at(F.col(feature), F.lit(1)).alias("category"), label)
    return first.groupBy("category").agg(F.count("*").alias("n"), F.sum(label).cast("double").alias("y")).select(F.lit(feature).alias("feature"), "category", "n", "y")


def _effect(n: Column, y: Column, base: Column, spread: Column, rounds: int = 12) -> Column:
    """Posterior mode ``u`` of one category: the root of ``y - n*p(base + u) - u/spread``.

    Newton steps run inside ``aggregate`` over a constant array, damped to steps of at most 2.
    """
    def step(u: Column, _: Column) -> Column:
        p = 1 / (1 + F.exp(-(base + u)))
        move = (y - n * p - u / spread) / (n * p * (1 - p) + 1 / spread)
        return u + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), step)


def _scalar(column: str, values: dict[str, float]) -> Column:
    pairs = [x for name, v in values.items() for x in (F.lit(name), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), F.col(column))


def fit_mixed_encoding(counts: DataFrame, rounds: int = 400, tolerance: float = 1e-6) -> DataFrame:
    """Random-intercept logistic encoding per category, from counts ``(feature, category, n, y)``.

    Model: ``logit p = b + u`` with ``u ~ N(0, s2)`` per feature. Categories with equal ``(n, y)`` share ``u``, so the
    rounds run on distinct pairs with their multiplicity. The only state between rounds is ``(b, s2)`` per feature;
    each round is one aggregate of fixed plan size. The encoding is ``u``; a category not seen gets 0.

    The spread's plain update creeps on a weak signal, so after every three plain rounds its logarithm is extrapolated
    (Steffensen). A fit that does not meet the tolerance raises.
    """
    counts = staged(counts.filter(F.col("n") > 0))
    pairs = staged(counts.groupBy("feature", "n", "y").agg(F.count("*").alias("m")))
    start = pairs.groupBy("feature").agg(F.sum(F.col("m") * F.col("n")).alias("n"), F.sum(F.col("m") * F.col("y")).alias("y"), F.sum("m").alias("k")).collect()
    smooth = {r["feature"]: (r["y"] + 0.5) / (r["n"] + 1.0) for r in start}
    base = {f: math.log(p / (1 - p)) for f, p in smooth.items()}
    spread = {f: 0.5 for f in base}
    recent: dict[str, list[float]] = {f: [] for f in base}
    for _ in range(rounds if base else 0):
        b, s2 = _scalar("feature", base), _scalar("feature", spread)
        at = pairs.withColumn("u", _effect(F.col("n").cast("double"), F.col("y"), b, s2)).withColumn("p", 1 / (1 + F.exp(-(b + F.col("u")))))
        info = F.col("n") * F.col("p") * (1 - F.col("p"))
        total = info + 1 / s2
        sums = at.groupBy("feature").agg(
            F.sum(F.col("m") * (F.col("y") - F.col("n") * F.col("p"))).alias("g"), F.sum(F.col("m") * (info - info * info / total)).alias("h"),
            (F.sum(F.col("m") * (F.col("u") * F.col("u") + 1 / total)) / F.sum("m")).alias("s2")).collect()
        change = 0.0
        for r in sums:
            f = r["feature"]
            move = max(-2.0, min(2.0, r["g"] / r["h"])) if r["h"] else 0.0
            new = max(r["s2"], LEAST_SPREAD)
            change = max(change, abs(move), abs(new - spread[f]))
            recent[f].append(math.log(new))
            if len(recent[f]) == 3:
                new = math.exp(_extrapolated(*recent[f]))
                recent[f] = []
            base[f] += move
            spread[f] = new
        if change < tolerance:
            break
    else:
        if base:
            raise RuntimeError(f"the mixed encoding did not settle in {rounds} rounds")
    b, s2 = _scalar("feature", base), _scalar("feature", spread)
    return counts.select("feature", "category", "n", "y", _effect(F.col("n").cast("double"), F.col("y"), b, s2).alias("value"))


def _extrapolated(a: float, b: float, c: float) -> float:
    """Where a geometric sequence through three values ends; kept within two of the last and above the least spread."""
    bend = (c - b) - (b - a)
    end = c if abs(bend) < 1e-12 else a - (b - a) ** 2 / bend
    if (end - c) * (c - b) < 0:  # no extrapolation backwards
        end = c
    return min(max(end, c - 2, math.log(LEAST_SPREAD)), c + 2)


def apply_encoding(df: DataFrame, table: DataFrame, features: list[str], suffix: str = "_encoded", default: float = 0.0) -> DataFrame:
    """Encoded columns by one lookup join per feature; unseen categories get ``default``. NULL matches a fitted NULL."""
    out = df
    for f in features:
        side = broadcast_if_small(table.filter(F.col("feature") == f).select(F.col("category").alias("_c"), F.col("value").alias(f + suffix)))
        out = out.join(side, F.col(f).cast("string").eqNullSafe(F.col("_c")), "left").drop("_c").withColumn(f + suffix, F.coalesce(f + suffix, F.lit(default)))
    return out


# Fitted categories of one feature that are held as a constant of the plan; larger tables are joined.
LOOKUP_LIMIT = 20_000
LOOKUP_SLOTS = 256


def _lookup_key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))  # map keys cannot be NULL


def _lookup_slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(LOOKUP_SLOTS)).cast("int")


def lookup_constant(table: DataFrame, feature: str, kind: str = "double") -> Column:
    """The categories and values of one feature as a constant of the plan: an array of small maps, addressed by hash.

    Rows are encoded without a join, inside lists too, on tables and on streams. The table is counted first: more than
    ``LOOKUP_LIMIT`` categories raise an error. The constant travels as JSON, which the optimizer folds once per query.
    """
    rows = table.filter(F.col("feature") == feature)
    if (n := rows.count()) > LOOKUP_LIMIT:
        raise ValueError(f"{n} categories of {feature}: join them instead")
    key = _lookup_key(F.col("category"))
    slots: list[dict] = [{} for _ in range(LOOKUP_SLOTS)]
    for r in rows.select(key.alias("k"), _lookup_slot(key).alias("slot"), "value").collect():
        slots[r["slot"]][r["k"]] = r["value"]
    return F.from_json(F.lit(json.dumps(slots)), f"array<map<string, {kind}>>")


def looked_up(constant: Column, value: Column, default: float | str = 0.0) -> Column:
    """Value of one category; ``default`` if it was not fitted. NULL matches a fitted NULL."""
    key = _lookup_key(value)
    return F.coalesce(F.element_at(F.element_at(constant, _lookup_slot(key) + 1), key), F.lit(default))


def looked_up_largest(constant: Column, values: str | Column, default: float = 0.0) -> Column:
    """Largest value over all entries of a list; NULL for an empty list."""
    return F.array_max(F.transform(values, lambda x: looked_up(constant, x, default)))


def apply_list_encoding(df: DataFrame, key: str, table: DataFrame, feature: str, suffix: str = "_encoded", default: float = 0.0) -> DataFrame:
    """Largest encoding over all entries of a list feature (unseen entries count as ``default``); NULL for an empty list.

    Up to ``LOOKUP_LIMIT`` categories no row moves; beyond it the entries meet the table in a join and return by ``key``.
    """
    table = cut_lineage(table.filter(F.col("feature") == feature))
    if table.count() <= LOOKUP_LIMIT:
        return df.withColumn(feature + suffix, looked_up_largest(lookup_constant(table, feature), feature, default))
    side = table.select(F.col("category").alias("_c"), F.col("value").alias("_v"))
    entries = df.select(key, F.explode(feature).alias("_e")).join(side, F.col("_e").eqNullSafe(F.col("_c")), "left")
    best = entries.groupBy(key).agg(F.max(F.coalesce("_v", F.lit(default))).alias(feature + suffix))
    return df.join(best, key, "left")


def fit_smoothed_encoding(counts: DataFrame, kind: str = "woe", weight: float = 10.0) -> DataFrame:
    """Encodings that are one formula of ``(n, y)``.

    ``woe``: log ratio of the category's share of positives and of negatives (half a count added); ``target``: mean
    shrunk by a sigmoid of ``n - weight``; ``m``: m-estimate; ``james_stein``: mean shrunk by its variance ratio.
    """
    mean = F.col("y") / F.col("n")
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_n"), F.sum("y").alias("_y"), F.var_pop(mean).alias("_spread"), F.avg(1 / F.col("n")).alias("_inverse"))
    all_n, all_y = F.col("_n"), F.col("_y")
    prior = all_y / all_n
    own = prior * (1 - prior) / F.col("n")
    between = F.greatest(F.lit(0.0), F.col("_spread") - prior * (1 - prior) * F.col("_inverse"))
    formulas = {
        "woe": F.log(((F.col("y") + 0.5) / (all_y + 1)) / ((F.col("n") - F.col("y") + 0.5) / (all_n - all_y + 1))),
        "target": prior + (mean - prior) / (1 + F.exp(-(F.col("n") - weight) / weight)),
        "m": (F.col("y") + prior * weight) / (F.col("n") + weight),
        "james_stein": prior + (mean - prior) * F.coalesce(F.try_divide(between, between + own), F.lit(0.0)),
    }
    # One row per feature: safe to broadcast; the category table itself is neither collected nor ordered.
    return counts.join(F.broadcast(totals), "feature").select("feature", "category", "n", "y", formulas[kind].alias("value"))


def out_of_fold_encoding(df: DataFrame, feature: str, label: str, fold: str, weight: float = 10.0, suffix: str = "_encoded") -> DataFrame:
    """M-estimate encoding where each row's value comes from the other folds only: totals minus the fold's own counts."""
    own = df.groupBy(feature, fold).agg(F.count("*").alias("_n"), F.sum(label).alias("_y"))
    per_fold = own.groupBy(fold).agg(F.sum("_n").alias("_fn"), F.sum("_y").alias("_fy"))
    every = W.partitionBy()
    priors = per_fold.select(fold, ((F.sum("_fy").over(every) - F.col("_fy")) / (F.sum("_fn").over(every) - F.col("_fn"))).alias("_prior"))
    category = W.partitionBy(feature)
    others = own.join(F.broadcast(priors), fold).select(feature, fold, "_prior", (F.sum("_n").over(category) - F.col("_n")).alias("_on"), (F.sum("_y").over(category) - F.col("_y")).alias("_oy"))
    value = (F.col("_oy") + F.col("_prior") * weight) / (F.col("_on") + weight)
    table = broadcast_if_small(others.select(F.col(feature).alias("_c"), F.col(fold).alias("_f"), value.alias(feature + suffix)))
    return df.join(table, F.col(feature).eqNullSafe(F.col("_c")) & (F.col(fold) == F.col("_f")), "left").drop("_c", "_f")


def ratio_table(df: DataFrame, features: list[str], label: str, threshold: float = 0.021) -> DataFrame:
    """Positives per negative for each category, whether that exceeds the threshold, and its descending max-rank.

    A category without negatives has no ratio; it counts as above the threshold and ranks first.
    """
    counts = category_counts(df, features, label)
    ratio = F.try_divide(F.col("y"), F.col("n") - F.col("y"))
    scored = counts.withColumn("ratio", ratio).withColumn("_order", F.coalesce("ratio", F.lit(float("inf"))))
    scored = cut_lineage(scored)
    places = cumulative_by_value(scored, "_order", {"k": F.count(F.lit(1))}, ["feature"], descending=True, buckets=8)
    return scored.join(places.select("feature", "_order", F.col("cum_k").alias("place")), ["feature", "_order"]).select(
        "feature", "category", F.col("n").alias("total"), "y", "ratio", (F.col("_order") > threshold).cast("int").alias("risky"), "place")


def risky_categories(table: DataFrame, feature: str) -> DataFrame:
    """Learned list of one feature, for joining rows to."""
    return table.filter((F.col("feature") == feature) & (F.col("risky") == 1)).select(F.col("category").alias(feature))


def standard_normal(key: str | Column, seed: int) -> Column:
    """A standard normal number per key (Box-Muller on two hashes of it): the same whatever the partitioning."""
    def uniform(salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(salt)), 11) + F.lit(1)) / F.lit(float(2**53 + 1))
    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def add_noise(df: DataFrame, column: str, rows: Column, scale: float, seed: int, key: str) -> DataFrame:
    """Add N(0, scale) to one column of the chosen (training) rows, drawn by ``key``."""
    return df.withColumn(column, F.when(rows, F.col(column) + standard_normal(key, seed) * F.lit(scale)).otherwise(F.col(column)))


# ---- numeric binning ---------------------------------------------------------------------------------------------

def bin_counts(df: DataFrame, value: str, label: str, edges: list[float]) -> DataFrame:
    """Events and non-events per pre-bin; the missing bin is -1. Values beyond the fitted edges join the end bins."""
    inner = [-math.inf, *edges[1:-1], math.inf]
    index = F.coalesce(edge_bin(value, inner), F.lit(-1))
    return df.groupBy(index.alias("bin")).agg(F.sum(label).cast("double").alias("events"), (F.count("*") - F.sum(label)).cast("double").alias("non_events"))


def merge_bins(counts: list[tuple[float, float]], max_bins: int = 8, min_share: float = 0.05) -> list[int]:
    """End indices of the contiguous merge with the largest information value whose event rate rises or falls throughout.

    Dynamic programming over at most some twenty pre-bins; ties prefer fewer bins.
    """
    k = len(counts)
    events, others = sum(c[0] for c in counts), sum(c[1] for c in counts)
    prefix = [(0.0, 0.0)]
    for e, o in counts:
        prefix.append((prefix[-1][0] + e, prefix[-1][1] + o))

    def part(i: int, j: int):
        e, o = prefix[j][0] - prefix[i][0], prefix[j][1] - prefix[i][1]
        if e + o < min_share * (events + others) or e <= 0 or o <= 0:
            return None
        a, b = o / others, e / events
        return e / (e + o), (a - b) * math.log(a / b)

    parts = {(i, j): part(i, j) for i, j in combinations(range(k + 1), 2)}
    best = (0.0, 1, [k])
    for sign in (1, -1):
        # state: last part (i, j), number of parts -> (value, cuts)
        states = {(0, j, 1): (parts[0, j][1], [j]) for j in range(1, k + 1) if parts[0, j]}
        for size in range(2, max_bins + 1):
            for (i, j, s), (v, cuts) in list(states.items()):
                if s != size - 1:
                    continue
                for end in range(j + 1, k + 1):
                    nxt = parts[j, end]
                    if nxt and sign * (nxt[0] - parts[i, j][0]) > 0:
                        found = states.get((j, end, size))
                        if found is None or v + nxt[1] > found[0]:
                            states[j, end, size] = (v + nxt[1], cuts + [end])
        for (i, j, s), (v, cuts) in states.items():
            if j == k and (v > best[0] + 1e-12 or (abs(v - best[0]) <= 1e-12 and s < best[1])):
                best = (v, s, cuts)
    return best[2]


def fit_woe_bins(df: DataFrame, value: str, label: str, pre_bins: int = 20, max_bins: int = 8, buckets: int = 1, cuts: list[float] | None = None) -> dict:
    """Merged bins of one numeric with their weight of evidence: ``{feature, edges, woe, missing}``.

    Quantile edges, then one aggregate of at most ``pre_bins`` rows, merged on the driver. With ``cuts`` the inner edges
    are given. WOE is the log of non-event share over event share; half a count stands in for an empty side.
    """
    if cuts is None:
        edges = quantile_edges(df.filter(F.col(value).isNotNull()), value, pre_bins, buckets)
        inner = edges[1:-1]
    else:
        inner = list(cuts)
    rows = {r["bin"]: (r["events"], r["non_events"]) for r in bin_counts(df, value, label, [-math.inf, *inner, math.inf]).collect()}
    ends = merge_bins([rows.get(i, (0.0, 0.0)) for i in range(len(inner) + 1)], max_bins) if cuts is None else list(range(1, len(inner) + 2))
    return _woe_fit(value, inner, rows, ends)


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 20) -> dict[str, list[float]]:
    """Inner quantile edges of many numerics at once, without NULLs: a fixed number of jobs."""
    named = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))
    values = df.select(F.explode(named).alias("_f")).select("_f.*").where("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("n"))
    found = quantiles_of_groups(cumulative_in_groups(staged(values), "feature", "v", ["n"]), "feature", "v", [i / bins for i in range(bins + 1)])
    return {f: sorted(set(found[f]))[1:-1] if f in found else [] for f in features}


def fit_many_woe_bins(df: DataFrame, cuts: dict[str, list[float]], label: str, max_bins: int | None = None) -> list[dict]:
    """``fit_woe_bins`` with given cuts for many numerics at once: one scan, one small aggregate. With ``max_bins`` neighbours are merged."""
    marks = F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(edge_bin(f, [-math.inf, *inner, math.inf]), F.lit(-1)).alias("bin")) for f, inner in cuts.items()))
    counted = df.select(label, F.explode(marks).alias("m")).groupBy("m.feature", "m.bin").agg(F.sum(label).cast("double").alias("events"), F.count("*").alias("n")).collect()
    found = {(r["feature"], r["bin"]): (r["events"], r["n"] - r["events"]) for r in counted}
    fits = []
    for f, inner in cuts.items():
        rows = {b: c for (g, b), c in found.items() if g == f}
        ends = [*range(1, len(inner) + 2)] if max_bins is None else merge_bins([rows.get(i, (0.0, 0.0)) for i in range(len(inner) + 1)], max_bins)
        fits.append(_woe_fit(f, list(inner), rows, ends))
    return fits


def _woe_fit(value: str, inner: list[float], rows: dict[int, tuple[float, float]], ends: list[int]) -> dict:
    """Merge counted pre-bins at ``ends`` and give each its weight of evidence."""
    counted = [rows.get(i, (0.0, 0.0)) for i in range(len(inner) + 1)]
    events, others = sum(r[0] for r in rows.values()), sum(r[1] for r in rows.values())

    def woe(e: float, o: float) -> float:
        return math.log((max(o, 0.5) / others) / (max(e, 0.5) / events)) if events and others else 0.0
    merged, start = [], 0
    for end in ends:
        merged.append((sum(c[0] for c in counted[start:end]), sum(c[1] for c in counted[start:end])))
        start = end
    return {"feature": value, "edges": [inner[e - 1] for e in ends[:-1]], "woe": [woe(*m) for m in merged],
            "missing": woe(*rows[-1]) if -1 in rows else 0.0, "counts": merged, "missing_counts": rows.get(-1, (0.0, 0.0))}


def woe_bin_table(spark, fits: list[dict]) -> DataFrame:
    """Fitted bins as a table ``(feature, bin, upper, woe)``: the last bin has no upper bound, the missing bin is -1."""
    rows = [(f["feature"], i, None if i == len(f["edges"]) else float(f["edges"][i]), float(w)) for f in fits for i, w in enumerate(f["woe"])]
    return spark.createDataFrame(rows + [(f["feature"], -1, None, float(f["missing"])) for f in fits], "feature string, bin int, upper double, woe double")


def woe_fits(table: DataFrame) -> dict[str, dict]:
    """``woe_column``'s input from such a table; it has one row per feature and bin."""
    fits: dict[str, dict] = {}
    for r in sorted(table.collect(), key=lambda r: (r["feature"], r["bin"])):
        fit = fits.setdefault(r["feature"], {"feature": r["feature"], "edges": [], "woe": [], "missing": 0.0})
        if r["bin"] == -1:
            fit["missing"] = r["woe"]
        else:
            fit["woe"].append(r["woe"])
            fit["edges"] += [] if r["upper"] is None else [r["upper"]]
    return fits


def woe_column(fit: dict, value: str | None = None) -> Column:
    """WOE of a value as a chain of comparisons (right-closed bins)."""
    c = F.col(value or fit["feature"])
    column = F.when(c.isNull(), F.lit(fit["missing"]))
    for edge, w in zip(fit["edges"], fit["woe"]):
        column = column.when(c <= edge, F.lit(w))
    return column.otherwise(F.lit(fit["woe"][-1]))


def woe_report(df: DataFrame, fits: list[dict]) -> DataFrame:
    """Binning table per feature: bounds, counts, event rate, WOE and information value per bin; the missing bin is -1."""
    rows = []
    for f in fits:
        bounds = [None, *f["edges"], None]
        counted = [(i, bounds[i], bounds[i + 1], c, w) for i, (c, w) in enumerate(zip(f["counts"], f["woe"]))]
        if sum(f["missing_counts"]):
            counted.append((-1, None, None, f["missing_counts"], f["missing"]))
        events, others = sum(r[3][0] for r in counted), sum(r[3][1] for r in counted)
        for i, low, high, (e, o), w in counted:
            iv = (o / others - e / events) * w if events and others else 0.0
            rows.append((f["feature"], i, None if low is None else float(low), None if high is None else float(high), float(e), float(o), e / (e + o) if e + o else 0.0, float(w), float(iv)))
    return df.sparkSession.createDataFrame(rows, "feature string, bin int, low double, high double, events double, non_events double, rate double, woe double, iv double")


def fit_cap_floor(df: DataFrame, columns: list[str], low: float = 0.001, high: float = 0.999, buckets: int = 1) -> dict[str, tuple[float, float]]:
    return {c: tuple(exact_quantiles(df, c, [low, high], buckets)) for c in columns}


def apply_cap_floor(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double")))) for c, (lo, hi) in limits.items()})




def min_max_scale(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """Scale expressions to 0..1 from one two-number aggregate each (constant: 0)."""
    names = list(expressions)
    row = df.agg(*(f(expressions[n]).alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max)))).first()
    scaled = {}
    for n in names:
        lo, hi = row[f"{n}_lo"], row[f"{n}_hi"]
        scaled[n] = (expressions[n] - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi != lo else F.lit(0.0)
    return df.withColumns(scaled)


