"""Operator 4: exact n-gram Jaccard join by a sharded prefix tree."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm.common import components
from gatewise.llm.text import MIX1, RADIX, lowered, mix, shingle_sets
from gatewise.session import staged

REGION = 0.26      # share of the hash range whose tokens are counted over all documents
BLOCK = 800        # sets in one prefix tree
ID_BROADCAST = 1_000_000  # ids are broadcast up to this count (some 16 MB), beyond it they are joined by shuffle
SET = ["f1", "f2"]


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` among which any partner must share one: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    u = s.astype(np.uint64)
    return int(mix(u).sum(dtype=np.uint64).view(np.int64)), int((np.bitwise_xor.reduce(mix(u * RADIX + MIX1)) + np.uint64(len(s))).view(np.int64))


def _signatures(width: int, percent: int):
    limit = int(REGION * 2**63)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, tokens = [], [], [], []
            for s in shingle_sets(lowered(batch.column(1)), width):
                one, two = fingerprint(s)
                n.append(len(s))
                f1.append(one)
                f2.append(two)
                tokens.append(s[: max(int(np.searchsorted(s, limit)), min(prefix_size(len(s), percent), len(s)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t.type) for v, t in zip((n, f1, f2, tokens), list(schema)[1:]))], schema=schema)
    return run


def _full_sets(width: int):
    """Whole sets of ``(cid, f1, f2, text)`` rows. Where an id has several texts, only the one with the row's fingerprint counts."""
    schema = pa.schema([("cid", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, packed = [], []
            wanted = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for (cid, *marks), s in zip(wanted, shingle_sets(lowered(batch.column(3)), width)):
                if fingerprint(s) == tuple(marks):
                    cids.append(cid)
                    packed.append(s.astype(">i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(packed, pa.binary())], schema=schema)
    return run


class Tree:
    """A prefix tree of ordered sets. A node holds a run of tokens, its branches, the sets that end in it, the shortest and longest
    set below it and, while all sets below belong to one group, a member of that group."""

    STEP = 32  # longest run of a node, so bounds are tested often

    def __init__(self) -> None:
        self.top = [(), {}, [], 1 << 62, 0, None]

    def add(self, key: int, tokens: tuple, find) -> None:
        at, node, n = 0, self.top, len(tokens)
        self._cover(node, key, n, find)
        while at < n:
            child = node[1].get(tokens[at])
            if child is None:
                child = [tokens[at : at + self.STEP], {}, [], n, n, key]
                node[1][tokens[at]] = child
                at, node = at + len(child[0]), child
                continue
            run = child[0]
            same = next((k for k, t in enumerate(run) if at + k >= n or tokens[at + k] != t), len(run))
            if same < len(run):  # split the run where the sets part
                below = [run[same:], child[1], child[2], child[3], child[4], child[5]]
                child[0], child[1], child[2] = run[:same], {run[same]: below}, []
            self._cover(child, key, n, find)
            at, node = at + same, child
        node[2].append(key)

    @staticmethod
    def _cover(node: list, key: int, n: int, find) -> None:
        if node[4] and (node[5] is None or find(node[5]) != find(key)):
            node[5] = None
        elif not node[4]:
            node[5] = key
        node[3], node[4] = min(node[3], n), max(node[4], n)

    def partners(self, key: int, tokens: tuple, percent: int, size, find, link) -> None:
        """Call ``link`` for each set with Jaccard at or above ``percent`` that is not yet in the group of ``key``.

        I >= p/100 * (a + b - I) is I * (100 + p) >= p * (a + b). On the way down the overlap so far is shared by all sets of a
        branch; the branch is left when even the shorter rest cannot reach the bound for its shortest set.
        """
        own, n, up = set(tokens), len(tokens), 100 + percent
        stack = [(self.top, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node[5] is not None and find(node[5]) == find(key):
                continue
            rest = n
            if node[0]:
                overlap += len(own.intersection(node[0]))
                depth += len(node[0])
                rest = n - bisect_right(tokens, node[0][-1])
            if up * (overlap + min(rest, node[4] - depth)) < percent * (n + node[3]):
                continue
            for other in node[2]:
                if up * overlap >= percent * (n + size[other]) and find(other) != find(key):
                    link(key, other)
            stack.extend((child, depth, overlap) for child in node[1].values())


def link_block(keys: list[int], groups: list[int], packed: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets of one block: for every set the smallest key of its group as far as this block shows.

    ``groups`` are already known groups, whose members need no comparison.
    """
    parent: dict[int, int] = {}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def link(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    heads: dict[int, int] = {}
    for k, g in enumerate(groups):
        parent[k] = heads.setdefault(g, k)
    before = {k: find(k) for k in parent}
    order = sorted(range(len(keys)), key=lambda k: packed[k])
    size = {k: len(packed[k]) // 8 for k in parent}
    tree = Tree()
    for k in order:
        tokens = tuple(np.frombuffer(packed[k], ">i8").tolist())
        tree.partners(k, tokens, percent, size, find, link)
        tree.add(k, tokens, find)
    return [(keys[k], keys[find(k)]) for k in parent if find(k) != before[k]]


def _linker(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, block in frame.groupby(["head", "i", "j"], sort=False):
            block = block.drop_duplicates("cid")
            if len(block) > 1:
                out += link_block(block["cid"].tolist(), block["component"].tolist(), block["shingles"].tolist(), percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Link the sets of every block ``(head, i, j)``. Blocks are dealt to groups of bounded expected size."""
    spark = placed.sparkSession
    rows = placed.count()  # small rows of four numbers: broadcast while counted to be few
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BLOCK + 1)
    dealt = placed.withColumn("deal", F.pmod(F.xxhash64("head", "i", "j"), F.lit(groups)))
    few = F.broadcast(dealt) if rows <= ID_BROADCAST else dealt
    return sets.join(few, "cid").groupBy("deal").applyInPandas(_linker(percent), "a long, b long")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link when their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more; the result is the
    smallest id reachable by links. The join is exact:

    1. Equal sets are one class (by a 128-bit fingerprint); classes are compared through the class's smallest id.
    2. Tokens have a global order: rarest first among the tokens in the lowest ``REGION`` of the hash range, whose document
       counts are taken over all classes, then the others by hash. A set shares a token of its prefix (a fifth of it) with
       any partner. Tokens no other class has use up the prefix; a set with a fifth of its tokens to itself drops out here.
    3. The tree of ordered sets is sharded at the shared tokens: whoever holds one may meet below it. Tokens held by the same
       classes, and then those with the same smallest holder, are one shard. Shards are cut into blocks and pairs of blocks,
       so no task holds an unbounded shard.
    4. A first pass links every set inside its widest shard, together with the shard's smallest member. Shards whose members are
       then all in one component are done; the others are joined in full, skipping sets already connected.

    Short texts are one shingle as a whole. NULL, empty and wordless texts have size 0, link with nothing and are their own
    component. Rows with a NULL id have a NULL component and take no part. Repeated rows are one document; rows with the same id
    and different texts count as one document with both. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = staged(docs.mapInArrow(_signatures(width, percent), "doc_id long, n long, f1 long, f2 long, tokens array<long>"))
    usable = signatures.where("n > 0 AND doc_id IS NOT NULL").withColumn("cid", F.col("doc_id"))
    again = staged(usable.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("rows > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("several")))
    repeated = not again.isEmpty()
    if repeated:  # one row per text; where an id has several texts each is a vertex of its own, below zero
        rows = usable.join(again, "doc_id").withColumn("cid", F.when(F.col("several"), -1 - F.abs(F.shiftright("f1", 1))).otherwise(F.col("doc_id"))).drop("several")
        usable = staged(usable.join(again, "doc_id", "left_anti").unionByName(rows.dropDuplicates(["cid", *SET])))
    classes = staged(usable.groupBy(*SET).agg(F.first("n").alias("n"), F.min("cid").alias("cid"), F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    copies = staged(usable.select("cid", *SET).join(classes.where("copies > 1").select(*SET, F.col("cid").alias("head")), SET).where("cid <> head").select("cid"))
    unique = usable.join(_few(copies), "cid", "left_anti")

    limit = int(REGION * 2**63)
    postings = unique.select("cid", F.explode("tokens").alias("token"))
    shards = postings.groupBy("token").agg(F.count("*").alias("df"), F.expr("bit_xor(xxhash64(cid))").alias("s1"), F.expr("bit_xor(xxhash64(cid, 1))").alias("s2")).where("df > 1")
    shared = postings.join(shards, "token").select("cid", F.struct((F.col("token") >= limit).alias("late"), "df", "token", "s1", "s2").alias("held"))
    held = shared.groupBy("cid").agg(F.array_sort(F.collect_list("held")).alias("held"))  # bounded by one document
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    counted = unique.select("cid", prefix.alias("prefix"), F.size(F.filter("tokens", lambda t: t < limit)).alias("counted"))
    # tokens of the counted region that no other class has come first in the order and use up the prefix
    room = F.col("prefix") - F.col("counted") + F.size(F.filter("held", lambda h: ~h["late"]))
    ranked = held.join(counted, "cid").withColumn("room", room).where("room > 0")
    active = ranked.select("cid", F.explode(F.array_distinct(F.transform(F.slice("held", F.lit(1), F.col("room")), lambda h: F.struct(h["s1"].alias("s1"), h["s2"].alias("s2"))))).alias("shard")).select("cid", "shard.*")
    active = staged(active)
    heads = active.groupBy("s1", "s2").agg(F.count("*").alias("members"), F.min("cid").alias("head")).where("members > 1").select("s1", "s2", "head")
    active = staged(active.join(heads, ["s1", "s2"]).select("cid", "head").distinct())
    active = staged(active.join(active.groupBy("head").agg(F.count("*").alias("members")), "head"))

    wanted = staged(active.select("cid").distinct().join(usable.select("cid", "doc_id", *SET), "cid").dropDuplicates(["cid"]))
    sets = staged(docs.join(_few(wanted), "doc_id").select("cid", *SET, "text").mapInArrow(_full_sets(width), "cid long, shingles binary"))

    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    widest = active.groupBy("cid").agg(F.max(F.struct("members", "head")).alias("w")).select("cid", "w.*")
    everywhere = F.when(F.col("cid") == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))
    first = staged(widest.select("cid", "head", F.explode(everywhere).alias("i")).select("cid", "head", "i", F.col("i").alias("j"), F.col("cid").alias("component")))
    found = staged(components(_links(first, sets, percent)))

    placed = active.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # a shard of one block in which every member was placed has been compared in full
    compared = first.join(active.select("head", "members").distinct(), "head").groupBy("head", "members").agg(F.count("*").alias("seen")).where((F.col("seen") == F.col("members")) & (F.col("members") <= BLOCK))
    open_shards = placed.groupBy("head").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("head")
    open_shards = staged(open_shards.join(compared.select("head"), "head", "left_anti"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.struct(F.least(block, t).alias("i"), F.greatest(block, t).alias("j")))
    rest = staged(placed.join(open_shards, "head").withColumn("pair", F.explode(pairs)).select("cid", "head", "pair.i", "pair.j", "component"))
    more = []
    if not rest.isEmpty():
        more.append(_links(rest, sets, percent))
    if repeated:  # an id with several texts ties their classes together
        vertex = usable.join(again.where("several"), "doc_id").join(classes.select(*SET, F.col("cid").alias("head")), SET)
        more.append(vertex.join(vertex.groupBy("doc_id").agg(F.min("head").alias("b")), "doc_id").select(F.col("head").alias("a"), "b"))
    if more:
        edges = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        for part in more:
            edges = edges.unionAll(part)
        found = staged(components(edges))

    joined = classes.join(found.withColumnRenamed("id", "cid"), "cid")
    lowest = joined.join(joined.groupBy("component").agg(F.min("low").alias("component_id")), "component").select(*SET, "component_id")
    named = lowest.unionAll(classes.where("copies > 1").join(found.withColumnRenamed("id", "cid"), "cid", "left_anti").select(*SET, F.col("low").alias("component_id")))
    rows = signatures.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", *SET).join(named, SET, "left")
    idle = signatures.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).unionAll(idle)


def _few(ids: DataFrame) -> DataFrame:
    """Ids for a semi or anti join: broadcast when counted to be few, else joined by shuffle."""
    ids = ids.distinct()
    return F.broadcast(ids) if ids.count() <= ID_BROADCAST else ids


def keep_first_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are linked to one with a smaller id (among equal ids, to one that comes earlier); all columns stay.

    Every row is a document of its own here, also where ids repeat or are NULL (NULL comes last), so a text goes only if one like it stays.
    """
    names = docs.columns
    row = "_row"
    while row in names:
        row += "_"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = ngram_components(rows.select(F.col(row).alias("doc_id"), "text"))
    later = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("member"), "component_id"))
    heads = later.select(F.col("component_id").alias("member"), "component_id").distinct()
    members = later.unionAll(heads).join(rows.select(F.col(row).alias("member"), F.col("doc_id")), "member")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "member"))
    kept = members.groupBy("component_id").agg(first["member"].alias("kept"))
    gone = staged(members.join(kept, "component_id").where("member <> kept").select(F.col("member").alias(row)))
    few = F.broadcast(gone) if gone.count() <= ID_BROADCAST else gone
    return rows.join(few, row, "left_anti").select(*[f"`{c}`" for c in names])
