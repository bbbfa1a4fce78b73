"""Ordered operators that avoid one-task windows: pick-one, running totals, quantiles, bins and time folds."""

from __future__ import annotations

import bisect
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.session import cut_lineage, staged

# Distinct values that one task puts in order.
BUCKET_ROWS = 200_000


def pick_one(df: DataFrame, keys: list[str], order: list[Column | str], largest: bool = True) -> DataFrame:
    """One row per key, by the largest (or smallest) ordering tuple.

    An aggregate, not a window: partial results are merged before the shuffle, so a hot key costs one row per task.
    Give a total order to make ties deterministic.
    """
    rest = [c for c in df.columns if c not in keys]
    chosen = (F.max_by if largest else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*")


def keep_first_ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows with rank 1, ties kept. Spark prunes with a group limit before the shuffle."""
    ranked = df.withColumn("_rank", F.rank().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def keep_first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; ``row_number() = 1`` with the same early pruning."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def cumulative_by_value(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] | None = None,
                        descending: bool = False, buckets: int = 1) -> DataFrame:
    """One row per distinct ``(by, value)`` with aggregates ``sums`` and their running totals ``cum_*`` and totals ``total_*``.

    ``buckets=1`` is for values of a bounded domain (scores 0..1000, dates): the window then holds few rows. Otherwise the distinct
    values are counted and the order is split at approximate quantiles into as many buckets as keep about ``BUCKET_ROWS`` values in
    each: totals per bucket become offsets, and each bucket is scanned by its own task. The result is exact for any split points; NaN
    is above all numbers.
    """
    by = list(by or [])
    per_value = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*(c.alias(n) for n, c in sums.items()))
    order = F.col(value).desc() if descending else F.col(value).asc()
    total = W.partitionBy(*by)
    if buckets <= 1:
        running = total.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return per_value.select("*", *(F.sum(n).over(running).alias(f"cum_{n}") for n in sums),
                                *(F.sum(n).over(total).alias(f"total_{n}") for n in sums))
    per_value = staged(per_value)
    pieces = per_value.count() // BUCKET_ROWS + 1
    probs = [i / pieces for i in range(1, pieces)]
    number = F.col(value).cast("double")
    edges = sorted({e for e in per_value.select(number.alias("_v")).approxQuantile("_v", probs, 0.5 / pieces) if math.isfinite(e)}) if probs else []
    marked = per_value.withColumn("_bucket", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= number)) if edges else F.lit(0))
    return _running(marked, value, list(sums), by, descending)


def _running(marked: DataFrame, value: str, sums: list[str], by: list[str], descending: bool = False) -> DataFrame:
    """Running totals over rows that are marked with the ordered ``_bucket`` they lie in: each bucket is scanned by a task, offsets come from bucket totals."""
    total = W.partitionBy(*by)
    order = F.col(value).desc() if descending else F.col(value).asc()
    earlier = W.partitionBy(*by).orderBy(F.col("_bucket").desc() if descending else F.col("_bucket").asc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = (marked.groupBy(*by, "_bucket").agg(*(F.sum(n).alias(n) for n in sums))
               .select(*by, "_bucket", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums),
                       *(F.sum(n).over(total).alias(f"total_{n}") for n in sums)))
    inside = W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = marked.join(offsets, [*by, "_bucket"])
    return ran.select(*by, value, *sums, *((F.sum(n).over(inside) + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in sums),
                      *(f"total_{n}" for n in sums))


def cumulative_in_groups(per_value: DataFrame, by: str, value: str, sums: list[str]) -> DataFrame:
    """``cumulative_by_value`` for a few groups at once, such as the columns of a long table ``(by, value, sums ...)`` with one row per value.

    Each group's order is cut at its own approximate quantiles into buckets of about ``BUCKET_ROWS`` values; the number of jobs does not depend
    on the number of groups. NULL values are left out.
    """
    per_value = per_value.filter(F.col(value).isNotNull())
    counts = {r[by]: r["n"] for r in per_value.groupBy(by).agg(F.count("*").alias("n")).collect()}
    pieces = max(counts.values(), default=0) // BUCKET_ROWS + 1
    bucket = F.lit(0)
    if pieces > 1:
        probs = [i / pieces for i in range(1, pieces)]
        found = per_value.groupBy(by).agg(F.percentile_approx(F.col(value).cast("double"), probs, max(10_000, 4 * pieces)).alias("cuts")).collect()
        cuts = {r[by]: sorted({c for c in r["cuts"] or [] if math.isfinite(c)}) for r in found}
        table = F.create_map(*(x for g, c in cuts.items() for x in (F.lit(g), F.array(*map(F.lit, c)).cast("array<double>"))))
        bucket = F.size(F.filter(F.element_at(table, F.col(by)), lambda e: e <= F.col(value).cast("double")))
    return _running(per_value.withColumn("_bucket", bucket), value, sums, [by])


def quantiles_of_groups(run: DataFrame, by: str, value: str, probs: list[float], weight: str = "n") -> dict[str, list[float]]:
    """Linear-interpolation quantiles of every group from its running counts; only the results reach the driver."""
    wanted = F.array(*(F.struct(F.lit(i).alias("place"), (F.lit(float(p)) * (F.col(f"total_{weight}") - 1)).alias("h")) for i, p in enumerate(probs)))
    first, last = F.col(f"cum_{weight}") - F.col(weight), F.col(f"cum_{weight}") - 1
    covers = F.filter(wanted, lambda x: F.floor(x["h"]).between(first, last) | F.ceil(x["h"]).between(first, last))
    hits = run.select(by, F.col(value).cast("double").alias("_v"), first.alias("_f"), last.alias("_l"), F.explode(covers).alias("_q"))

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("_f"), F.col("_l")), F.col("_v")))
    ends = hits.groupBy(by, "_q.place").agg(at(F.floor("_q.h")).alias("lo"), at(F.ceil("_q.h")).alias("hi"), F.max(F.col("_q.h") - F.floor("_q.h")).alias("part")).collect()
    out: dict[str, list[float]] = {}
    for r in ends:
        out.setdefault(r[by], [float("nan")] * len(probs))[r["place"]] = _between(r["lo"], r["hi"], r["part"])
    return out


def running_percent(df: DataFrame, value: str, measures: list[str], buckets: int = 1) -> DataFrame:
    """Per distinct value: the running share, in percent, of each measure."""
    run = cumulative_by_value(df, value, {m: F.sum(m) for m in measures}, buckets=buckets)
    return run.select(value, *(F.try_divide(100 * F.col(f"cum_{m}"), F.col(f"total_{m}")).alias(f"cum_{m}_pct") for m in measures))


def max_rank(df: DataFrame, value: str, buckets: int = 1, name: str = "rank") -> DataFrame:
    """Descending rank per distinct value where ties take the largest rank (count of rows with an equal or larger value)."""
    run = cumulative_by_value(df, value, {"n": F.count(F.lit(1))}, descending=True, buckets=buckets)
    return run.select(value, F.col("cum_n").alias(name))


def quantile_rows(df: DataFrame, by: list[str], value: str, probs: list[float], buckets: int = 1) -> DataFrame:
    """Linear-interpolation quantiles per group as rows ``(by, place, quantile)``.

    A distinct value covers a run of ranks; it is kept only for the quantiles whose bracketing ranks fall into its run.
    """
    run = cumulative_by_value(df, value, {"n": F.count(F.lit(1))}, by=by, buckets=buckets)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    wanted = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)))

    def covers(p: Column) -> Column:
        h = (F.col("total_n") - 1) * p
        return F.floor(h).between(first, last) | F.ceil(h).between(first, last)
    hits = run.select(*by, F.col(value).cast("double").alias("_v"), first.alias("_f"), last.alias("_l"), "total_n",
                      F.explode(F.filter(wanted, lambda x: covers(x["p"]))).alias("_q"))
    h = (F.col("total_n") - 1) * F.col("_q.p")

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("_f"), F.col("_l")), F.col("_v")))
    ends = hits.groupBy(*by, F.col("_q.place").alias("place")).agg(at(F.floor(h)).alias("lo"), at(F.ceil(h)).alias("hi"), F.max(h - F.floor(h)).alias("part"))
    return ends.select(*by, "place", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("quantile"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], buckets: int = 1) -> list[float]:
    """Linear-interpolation quantiles of a column, by selection (``Brackets``): only values around the wanted ranks are put in order.

    NaN is above all numbers. ``buckets`` is not needed any more.
    """
    cells = Brackets(df.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("w")).where("v IS NOT NULL"))
    places = [(cells.total - 1) * float(p) for p in probs]
    if not cells.total:
        return [float("nan")] * len(probs)
    ranks = sorted({f(h) for h in places for f in (math.floor, math.ceil)})
    near = cells.around([r + 0.5 for r in ranks], probs)
    covered = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("cum_w") - F.col("w")) & (r < F.col("cum_w")))
    at = {r["r"]: r["v"] for r in near.select("v", F.explode(covered).alias("r")).collect()}  # a row per wanted rank
    return [_between(at[math.floor(h)], at[math.ceil(h)], h - math.floor(h)) for h in places]


def _between(low: float, high: float, part: float) -> float:
    return low if low == high or not part else low + (high - low) * part


# Rows between two neighbouring cuts that one task puts in order.
BRACKET_ROWS = 200_000
SKETCH_ACCURACY = 10_000


class Brackets:
    """Selection of values by running mass, without putting all values in order.

    A quantile sketch gives cuts on both sides of each wanted place, and around each of its points a cell for this one value, so
    that ties cannot fill a cell. One scan counts rows and mass per cell, which tells for sure in which cell each place lies, however
    good the sketch was. Wanted cells with more than ``BRACKET_ROWS`` rows and more than one value are cut again in the same way.
    """

    def __init__(self, rows: DataFrame):
        """``rows``: value ``v`` (double, not NULL) and mass ``w``."""
        self.rows = staged(rows.withColumn("v", F.col("v") + F.lit(0.0)))  # one zero only
        self.cuts: list[float] = []
        self._count()

    def _count(self) -> None:
        found = {r["cell"]: (r["n"], r["w"]) for r in self._marked().groupBy("cell").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
        self.counts = [found.get(i, (0, 0)) for i in range(len(self.cuts) + 2)]  # the last cell is that of NaN
        self.total = sum(w for _, w in self.counts)

    def _marked(self) -> DataFrame:
        if not self.cuts:
            return self.rows.withColumn("cell", F.when(F.isnan("v"), F.lit(1)).otherwise(F.lit(0)))
        cutter = Bucketizer(splits=[-math.inf, *self.cuts, math.inf], inputCol="v", outputCol="_cell", handleInvalid="keep")
        return cutter.transform(self.rows).select("v", "w", F.col("_cell").cast("int").alias("cell"))

    def _cut_at(self, points: list[float]) -> bool:
        fresh = {x for p in points if p is not None and math.isfinite(p) for x in (p, math.nextafter(p, math.inf))} - set(self.cuts)
        fresh = {x + 0.0 for x in fresh if math.isfinite(x)}
        self.cuts = sorted(fresh | set(self.cuts))
        return bool(fresh)

    def _wanted(self, masses: list[float], beside: int) -> set[int]:
        """Cells where the running mass reaches one of ``masses``, with the nearest ``beside`` cells on each side that hold rows."""
        filled = [i for i, (n, _) in enumerate(self.counts) if n]
        ends, run = [], 0
        for i in filled:
            run += self.counts[i][1]
            ends.append(run)
        wanted = set()
        for m in masses:
            at = min(bisect.bisect_left(ends, m), len(filled) - 1)
            wanted.update(filled[max(at - beside, 0) : at + beside + 1])
        return wanted

    def _wide(self, cell: int) -> bool:
        n = self.counts[cell][0]
        single = cell == len(self.cuts) + 1 or 0 < cell < len(self.cuts) and self.cuts[cell] == math.nextafter(self.cuts[cell - 1], math.inf)
        return n > BRACKET_ROWS and not single

    def around(self, masses: list[float], probs: list[float], beside: int = 0) -> DataFrame:
        """Distinct values near the running ``masses``: ``v``, their mass ``w`` and the running mass ``cum_w`` up to and with them.

        ``probs`` says about where they lie; it only steers the first cuts. With ``beside=1`` the nearest values below and above every place
        are among the rows.
        """
        if sum(n for n, _ in self.counts) > BRACKET_ROWS:
            shift = 2 / SKETCH_ACCURACY
            points = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-shift, 0.0, shift)})
            if self._cut_at(self.rows.agg(F.percentile_approx("v", points, SKETCH_ACCURACY)).first()[0] or []):
                self._count()
        while wide := [i for i in self._wanted(masses, beside) if self._wide(i)]:
            inner = F.percentile_approx("v", [i / 16 for i in range(17)], SKETCH_ACCURACY)
            cut = self._marked().where(F.col("cell").isin(wide)).groupBy("cell").agg(inner.alias("points")).collect()  # a row per cell
            if not self._cut_at([x for r in cut for x in r["points"]]):
                break
            self._count()
        wanted = sorted(self._wanted(masses, beside))
        before = [sum(w for _, w in self.counts[:i]) for i in wanted]
        offset = F.element_at(F.create_map(*(F.lit(x) for pair in zip(wanted, before) for x in pair)), F.col("cell"))
        values = self._marked().where(F.col("cell").isin(wanted)).groupBy("cell", "v").agg(F.sum("w").alias("w"))
        running = W.partitionBy("cell").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
        return values.select("v", "w", (F.sum("w").over(running) + offset).alias("cum_w"))


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], buckets: int = 1) -> DataFrame:
    """Named quantiles per group, one row each (no group is collected)."""
    rows = quantile_rows(df, by, value, list(probs.values()), buckets)
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col("place") == i, F.col("quantile"))).alias(n) for i, n in enumerate(probs)))


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: list[float], old_style: bool = False, buckets: int = 1) -> list[float]:
    """Quantiles by interpolation on ``(cumulative weight - weight/2) / total``; de-duplicated and sorted.

    Rows with equal values are merged first, so the result does not depend on the order of ties. ``old_style`` stretches
    the positions to 0..1. Only values around the wanted places are put in order (``Brackets``).
    """
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("quantiles must lie in [0, 1]")
    cells = Brackets(df.select(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).where("v IS NOT NULL"))
    if not any(n for n, _ in cells.counts):
        return []
    low, span = 0.0, float(cells.total)
    if old_style:
        ends = cells.rows.agg(F.min("v").alias("first"), F.max("v").alias("last")).first()
        outer = cells.rows.agg(*(F.coalesce(F.sum(F.when(F.col("v") == F.lit(ends[e]), F.col("w"))), F.lit(0.0)).alias(e) for e in ("first", "last"))).first()
        low, span = outer["first"] / 2, cells.total - outer["last"] / 2 - outer["first"] / 2
    run = cut_lineage(cells.around([low + p * span for p in probs], probs, beside=1).withColumn("mid", F.col("cum_w") - F.col("w") / 2))
    place = ((F.col("mid") - F.lit(low)) / F.lit(span)) if span else F.lit(0.0)
    marked = run.withColumn("p", place)
    row = marked.agg(*(f for i, p in enumerate(probs) for f in (
        F.max_by(F.struct("p", "v"), F.when(F.col("p") <= p, F.col("p"))).alias(f"lo{i}"),
        F.min_by(F.struct("p", "v"), F.when(F.col("p") >= p, F.col("p"))).alias(f"hi{i}")))).first()
    out = set()
    for i, p in enumerate(probs):
        lo, hi = row[f"lo{i}"] or row[f"hi{i}"], row[f"hi{i}"] or row[f"lo{i}"]
        out.add(lo["v"] if hi["p"] == lo["p"] else lo["v"] + (hi["v"] - lo["v"]) * (p - lo["p"]) / (hi["p"] - lo["p"]))
    return sorted(out)


def share_bin(cumulative: str | Column, total: str | Column, n: int) -> Column:
    """Right-closed bin of a cumulative share; a zero share falls into bin 0."""
    c = F.col(cumulative) if isinstance(cumulative, str) else cumulative
    t = F.col(total) if isinstance(total, str) else total
    return F.greatest(F.lit(0), F.ceil(F.round(c * F.lit(n) / t, 9)).cast("int") - 1)


def equal_weight_bins(df: DataFrame, score: str, weight: str | None = None, n: int = 10, extra: dict[str, Column] | None = None,
                      buckets: int = 1) -> DataFrame:
    """One row per distinct score, ranked downwards, with its equal-weight bin. A score never straddles two bins."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    run = cumulative_by_value(df, score, {"w": w, **(extra or {})}, descending=True, buckets=buckets)
    return run.withColumn("bin", share_bin("cum_w", "total_w", n))


def cutoff_bins(score: str, cutoffs: list[float]) -> Column:
    """Bin of the first cut-off reached; scores below all of them fall into the last bin."""
    column = F.when(F.col(score) >= cutoffs[0], F.lit(0))
    for i, cut in enumerate(cutoffs[1:], 1):
        column = column.when(F.col(score) >= cut, F.lit(i))
    return column.otherwise(F.lit(len(cutoffs) - 1))


def edge_bin(value: str, edges: list[float]) -> Column:
    """Right-closed bin between given edges with the lowest edge included; outside values give NULL."""
    c, column = F.col(value), None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        hit = (c <= high) & ((c > low) if i else (c >= low))
        column = F.when(hit, F.lit(i)) if column is None else column.when(hit, F.lit(i))
    return column if column is not None else F.lit(None).cast("int")


def quantile_edges(df: DataFrame, value: str, q: int, buckets: int = 1) -> list[float]:
    return sorted(set(exact_quantiles(df, value, [i / q for i in range(q + 1)], buckets)))


def quantile_bins(df: DataFrame, value: str, q: int, name: str = "bin", buckets: int = 1) -> DataFrame:
    """Equal-frequency bins at exact quantiles; duplicate edges are dropped, so ties stay together."""
    return df.withColumn(name, edge_bin(value, quantile_edges(df, value, q, buckets)))


def global_positions(df: DataFrame, date: str, within: Column, key: str, name: str = "position") -> DataFrame:
    """0-based position by (date, ``within``, key). ``within`` splits a date into small parts, so a hot date is shared by tasks."""
    marked = df.withColumn("_part", within)
    earlier = W.orderBy(date, "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (marked.groupBy(date, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select(date, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    local = W.partitionBy(date, "_part").orderBy(key)
    return (marked.withColumn("_rn", F.row_number().over(local)).join(offsets, [date, "_part"])
            .withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_part", "_rn", "_before"))


def positions_within(df: DataFrame, by: list[str], part: Column, order: list[Column | str], name: str = "position") -> DataFrame:
    """0-based position inside each group by (``part``, ``order``). Groups are cut into parts, each ranked by its own task."""
    marked = df.withColumn("_part", part)
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (marked.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("group_size")))
    local = W.partitionBy(*by, "_part").orderBy(*order)
    return (marked.withColumn("_rn", F.row_number().over(local)).join(offsets, [*by, "_part"])
            .withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_part", "_rn", "_before"))


def time_folds(df: DataFrame, date: str, key: str, folds: int = 5, within: Column | None = None, rows: int | None = None) -> DataFrame:
    """Test fold per row (1..folds); fold f trains on all rows placed before its test block. Fold 0 never tests.

    Every test block has ``rows // (folds + 1)`` rows and the last block ends at the last row.
    """
    rows = df.count() if rows is None else rows
    size = rows // (folds + 1)
    placed = global_positions(df, date, within if within is not None else F.pmod(F.xxhash64(key), F.lit(64)), key)
    first = rows - folds * size
    return placed.withColumn("fold", F.when(F.col("position") < first, F.lit(0)).otherwise(
        (F.floor((F.col("position") - F.lit(first)) / F.lit(size)) + 1).cast("int")))
