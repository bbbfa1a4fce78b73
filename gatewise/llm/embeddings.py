"""Operator 3: embedding near-dedup by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm.common import components
from gatewise.session import staged

BLOCK = 1500  # vectors of one bucket compared at a time


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection puts two vectors ``distance`` apart into one cell of ``width``."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(threshold: float, width: float, depth: int, miss: float) -> int:
    """Tables needed so that a pair exactly at the threshold is missed with at most chance ``miss``; nearer pairs less."""
    p = collision(math.sqrt(2 - 2 * threshold), width) ** depth
    return math.ceil(math.log(miss) / math.log(1 - p))


def unit_rows(packed, kind: str) -> np.ndarray:
    """Packed vectors of one length as unit vectors in double precision; scaled first, so no norm overflows or vanishes."""
    x = np.stack([np.frombuffer(v, kind) for v in packed]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(depth: int, tables: int, width: float, seed: int, kind: str):
    schema = pa.schema([("cid", pa.int64()), ("label", pa.string()), ("packed", pa.binary()), ("buckets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for batch in batches:
            by_size: dict[int, list] = {}
            for cid, vector, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                by_size.setdefault(len(vector), []).append((cid, label, np.array(vector, kind).tobytes()))
            for size, rows in by_size.items():
                if size not in planes:
                    rng = np.random.default_rng([seed, size])
                    planes[size] = rng.standard_normal((size, tables * depth)), rng.uniform(0, width, tables * depth), rng.integers(1, 1 << 62, (tables, depth)) * 2 + 1
                a, b, mixers = planes[size]
                cells = np.floor((unit_rows([r[2] for r in rows], kind) @ a + b) / width).astype(np.int64).reshape(len(rows), tables, depth)
                buckets = (((cells * mixers).sum(axis=2) ^ size) >> 32).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(3)] + [pa.array(list(buckets), schema.field(3).type)], schema=schema)
    return run


def _compare(threshold: float, kind: str):
    """Count each vector's links in one block (copies weigh in) and name the smallest vector it reaches there. A pair that already met in
    an earlier table is left to that table, so over all blocks each link counts once."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (table, _, i, j), block in frame.groupby(["table", "bucket", "i", "j"], sort=False):
            for _, own in block.groupby(["label", block["packed"].str.len()], sort=False):
                if len(own) > 1:
                    out += _block(own, int(table), i != j, threshold, kind)
        return pd.DataFrame(out, columns=["vec_id", "links", "reach"])
    return run


def _block(own: pd.DataFrame, table: int, cross: bool, threshold: float, kind: str) -> list[tuple]:
    ids, copies = own["vec_id"].to_numpy(), own["copies"].to_numpy()
    x = unit_rows(own["packed"], kind)
    near = x @ x.T >= threshold - 1e-9
    a, b = np.nonzero(np.triu(near, 1))
    if cross:  # pairs of one side belong to the block of that side alone
        side = own["side"].to_numpy()
        keep = side[a] != side[b]
        a, b = a[keep], b[keep]
    if table and len(a):
        keys = np.stack(own["buckets"].to_numpy())[:, :table]
        met = np.concatenate([(keys[a[k : k + 100_000]] == keys[b[k : k + 100_000]]).any(axis=1) for k in range(0, len(a), 100_000)])
        a, b = a[~met], b[~met]
    if len(a):  # exact cosines of the pairs near the limit, in double precision
        exact = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 50_000]], x[b[k : k + 50_000]]) for k in range(0, len(a), 50_000)]) >= threshold
        a, b = a[exact], b[exact]
    if not len(a):
        return []
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    reach, before = ids.copy(), None
    while before is None or (reach != before).any():
        before = reach.copy()
        np.minimum.at(reach, a, reach[b])
        np.minimum.at(reach, b, reach[a])
    return [(int(v), int(n), int(r)) for v, n, r in zip(ids, links, reach) if n]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, width: float = 2.0, depth: int = 6, miss: float = 1e-5, seed: int = 17) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when labels are equal and not NULL and their cosine in double precision is ``threshold`` or more. Unit vectors are
    hashed by ``depth`` quantised Gaussian projections a table, in as many tables as keep the chance to miss a pair right at the
    threshold under ``miss`` (nearer pairs are missed far less). Equal vectors are one class, counted and expanded by arithmetic. A bucket
    is cut into blocks and pairs of blocks; blocks give link counts and one reach per vector, never a list of pairs.

    A vector that is NULL, empty, zero or has NULL or non-finite components, or whose label is NULL, links with nothing. Vectors of
    different lengths do not link. Repeated rows count as separate vectors with the same id. Rows with a NULL id take no part: no links,
    NULL component, ``kept`` NULL. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "float32" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    sound &= F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("same", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.lit("v"), "label", F.col("v").cast("array<string>")), 256)))
    rows = staged(rows)
    classes = rows.where("sound").groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    firsts = rows.where("sound").join(classes, ["same", "vec_id"]).dropDuplicates(["same"])
    tables = tables_for(threshold, width, depth, miss)
    # classes carry their own key: ids may repeat
    hashed = firsts.select(F.xxhash64("same").alias("cid"), "v", "label").mapInArrow(_hash(depth, tables, width, seed, kind), "cid long, label string, packed binary, buckets array<int>")
    hashed = staged(hashed.join(firsts.select(F.xxhash64("same").alias("cid"), "copies"), "cid"))
    spots = hashed.select("cid", "label", F.posexplode("buckets").alias("table", "bucket"))
    sizes = spots.groupBy("label", "table", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.struct(F.least(F.col("side"), t).alias("i"), F.greatest(F.col("side"), t).alias("j")))
    placed = spots.join(sizes, ["label", "table", "bucket"]).withColumn("side", side).withColumn("pair", F.explode(pairs)).select("cid", "table", "bucket", "side", "pair.i", "pair.j")
    placed = staged(placed)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // BLOCK + 1)
    dealt = placed.withColumn("deal", F.pmod(F.xxhash64("table", "bucket", "i", "j"), F.lit(groups))).join(hashed, "cid").withColumnRenamed("cid", "vec_id")
    found = staged(dealt.groupBy("deal").applyInPandas(_compare(threshold, kind), "vec_id long, links long, reach long"))
    links = found.groupBy(F.col("vec_id").alias("cid")).agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("vec_id").alias("a"), F.col("reach").alias("b")))

    named = classes.select("same", "vec_id", "copies", F.xxhash64("same").alias("cid")).join(links, "cid", "left").join(reached.withColumnRenamed("id", "cid"), "cid", "left")
    named = staged(named.withColumn("component", F.coalesce("component", "cid")))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "component").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id").where("n_links > 0")
    linked = rows.where("sound").select("vec_id", "same").join(named, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
