"""Operator 2: line dedup by distinct-site spread, from sketches per line hash with exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewise.session import staged

BLANK = " \t\r"
KEY = ["h1", "h2"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: its document, site, position and two independent 64-bit hashes of the trimmed line."""
    pieces = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("site"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(BLANK))
    return pieces.where(line != "").select("doc_id", "site", "text_hash", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = 3, sketch_bits: int = 12) -> DataFrame:
    """Lines seen on at least ``min_sites`` distinct sites: ``(h1, h2, first)``, ``first`` the smallest id of a document with the line.

    HyperLogLog sketches of the sites merge inside tasks before the shuffle. Where the estimate is within four standard
    errors (one site at least) of the threshold, sites are counted exactly. For two sites the smallest and the largest
    site tell without a sketch.
    """
    lines = _lines(docs)
    if min_sites == 2:
        return lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.min("site").alias("low"), F.max("site").alias("high")).where("low < high").select(*KEY, "first")
    sketches = lines.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(sketch_bits))).alias("sites"), F.min("doc_id").alias("first"))
    margin = max(1.0, 4 * 1.04 / 2 ** (sketch_bits / 2) * min_sites)
    sketches = staged(sketches.where(F.col("sites") >= min_sites - margin))
    near = sketches.where(F.abs(F.col("sites") - min_sites) <= margin)
    exact = lines.select(*KEY, "site").join(near.select(*KEY, "first"), KEY).groupBy(*KEY).agg(F.count_distinct("site").alias("sites"), F.min("first").alias("first"))
    return sketches.where(F.col("sites") > min_sites + margin).select(*KEY, "first").unionAll(exact.where(F.col("sites") >= min_sites).select(*KEY, "first"))


def dedup_lines(docs: DataFrame, min_sites: int = 3, counts: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the numbers of its lines and of those removed as ``counts``, which must not be among its columns.

    A site is a source (NULL and the empty source are one site). A boilerplate line stays in the document with the smallest id
    that holds it and leaves all others, so nothing is lost altogether; rows repeated with that id all keep it. Lines are
    compared without spaces, tabs and carriage returns at their ends; blank lines are never touched. Every row stays, even
    if no line is left (empty text). NULL text stays NULL with 0 lines. Rows with a NULL id give evidence but keep their lines.
    All other columns are passed through whatever their names.
    """
    found = staged(boilerplate(docs, min_sites))
    gone = (_lines(docs).join(found, KEY).where(F.col("doc_id") > F.col("first")).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_gone"))
            .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_gone"))
    joined = docs.join(gone, (docs["doc_id"] == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left")
    lines, size = F.split(docs["text"], "\n"), F.size(F.split(docs["text"], "\n"))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), size - 1), gone["_gone"]), lambda p: F.get(lines, p)), "\n")
    text = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(left).alias("text")
    kept = [text if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*kept, F.when(docs["text"].isNull(), 0).otherwise(size).cast("long").alias(counts[0]), F.coalesce(F.when(gone["_gone"].isNotNull(), F.size(gone["_gone"])), F.lit(0)).cast("long").alias(counts[1]))
