"""Session settings, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A fitted table with more rows than this is shuffled instead of broadcast.
BROADCAST_ROW_LIMIT = 100_000


def build_session(app: str = "gatewise", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on: AQE with skew handling, UTC and Arrow."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; where none is named, a folder beside the warehouse, on every master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(named or f"{warehouse}/_checkpoints")
    return named or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder, so later jobs neither recompute it nor depend on one executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


STAGES: list[str] = []


def staged(df: DataFrame, partitions: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: unlike a checkpoint this keeps size statistics and column pruning."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stages/{uuid.uuid4().hex}"
    STAGES.append(folder)
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables ``staged`` has written. Call it when no frame built on them is needed any more; returns their number."""
    dropped = 0
    while STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(STAGES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        dropped += 1
    return dropped


def broadcast_if_small(table: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Materialise a fitted table and broadcast it only when its counted size allows; otherwise leave a shuffle join.

    The shuffle join relies on AQE to split hot keys, so no row is dropped on either path.
    """
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= max_rows else table


def shuffled(table: DataFrame) -> DataFrame:
    """A table that grows with the input, for a join that shuffles both sides. The planner guesses rows derived from JSON, lists or made text
    far too small and would broadcast them through the driver."""
    return table.hint("merge")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table written in code, generated from constants by one task. It is bounded by the source text, hence broadcast."""
    if len(rows) > 10_000:
        raise ValueError("literal lookup tables are for small fixed data; read larger ones from storage")
    fields = [field.split() for field in schema.split(",")]
    entries = [F.struct(*(F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(fields, row))) for row in rows]
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.array(*entries))))
