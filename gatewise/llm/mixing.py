"""Operator 5: mix sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, Window

from gatewise.llm.common import WORD
from gatewise.session import staged


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) by source in code point order, NULL last. Range-partitioned: no task sees all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = staged(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    counts = sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())  # one row per partition
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    # made in the JVM: rows that come from a Python list would start workers of their own on the executors
    rows = F.from_json(F.lit(json.dumps([{"part": part, "start": start} for part, start in starts])), "array<struct<part: bigint, start: bigint>>")
    offsets = sizes.sparkSession.range(0, 1, 1, 1).select(F.inline(rows))
    return (placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
            .withColumn("rank", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "start", "place"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``: shares of the total by weight, clamped at ``max_epochs`` sizes.

    The level rises until no unclamped source is above its cap; each round is one small aggregate of the source table.
    """
    cap = F.col("source_size") * max_epochs
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, clamped = (total / weights if weights else 0.0), -1
    while True:
        above = cap < F.lit(level) * F.col("weight")
        held, free, count = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        if count == clamped or free == 0:
            break
        level, clamped = (total - held) / free, count
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, weight: Column | None = None, max_epochs: int = 3, carry: list[str] | None = None) -> DataFrame:
    """How often each document enters the mix: ``doc_id, source, size, source_size, target, copies, taken``,
    and the columns in ``carry`` as the struct ``_carried``.

    ``weight`` is an expression over ``rank``, by default 1, 2, 3, repeating. A source's target over its size is its rate:
    every document is repeated the whole number of times, and the rest is met by documents in the order of a hash of
    their id. The hash is cut first into 256 and, inside the bucket where the rest ends, into 4096 more, so each source
    misses its target by about half a document. Nothing depends on partitioning: reruns agree.

    NULL text, empty text and text without words have size 0 and are taken 0 words; a NULL source is one source, the last;
    a NULL id hashes as the empty string; documents with equal ids are taken together. An empty table gives no rows.
    """
    weight = F.col("rank") % 3 + 1 if weight is None else weight
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    carried = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_carried")] if carry else []
    sized = staged(docs.select("doc_id", "source", *carried, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                               F.substring(digest, 1, 2).alias("coarse"), F.substring(digest, 3, 3).alias("fine")))
    grid = staged(sized.groupBy("source", "coarse").agg(F.sum("size").alias("words")))  # at most 256 rows per source
    sources = staged(ranked_sources(grid.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("weight", weight))
    sources = staged(water_fill(sources, max_epochs)
                     .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                     .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("rank", "weight"))
    same = grid["source"].eqNullSafe(sources["source"])
    upto = Window.partitionBy("source").orderBy("coarse")
    edge = staged(grid.join(sources, same).select(grid["source"], "coarse", "words", "rest")
                  .withColumn("after", F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
                  .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("after"))).select("source", "coarse", "before", "rest"))
    inside = sized.join(edge, sized["source"].eqNullSafe(edge["source"]) & (sized["coarse"] == edge["coarse"]))
    fine = inside.groupBy(sized["source"], "fine").agg(F.sum("size").alias("words"), F.first("before").alias("base"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("fine")
    stop = (fine.withColumn("after", F.col("base") + F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
            .where(F.col("before") + F.col("after") <= 2 * F.col("rest")).groupBy("source").agg(F.max("fine").alias("last_fine")))
    limits = sources.join(edge.select(F.col("source").alias("s"), F.col("coarse").alias("edge")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    limits = staged(limits.join(stop.select(F.col("source").alias("s"), "last_fine"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    joined = sized.join(limits.withColumnRenamed("source", "s"), sized["source"].eqNullSafe(F.col("s"))).drop("s")
    # without an edge the rest is 0 or the whole source is met; an edge splits before, at and after its bucket
    extra = (F.col("coarse") < F.col("edge")) | ((F.col("coarse") == F.col("edge")) & (F.col("fine") <= F.col("last_fine")))
    copies = F.col("whole") + F.when(F.col("rest") > 0, F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(copies, F.lit(max_epochs))).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["_carried"] if carry else []))
