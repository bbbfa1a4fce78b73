"""File interchange: typed CSV in, partitioned parquet and chunked CSV out, metric documents, fitted artefacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str, schema: str, list_columns: tuple[str, ...] = (), date_columns: tuple[str, ...] = ()) -> DataFrame:
    """CSV with an explicit schema (no inference pass). List columns hold ``['a', 'b']`` text and become arrays."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    for c in list_columns:
        inner = F.regexp_replace(F.trim(F.col(c)), r"^\[|\]$", "")
        parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"""^['"]|['"]$""", ""))
        df = df.withColumn(c, F.filter(parts, lambda x: x != ""))
    return df.withColumns({c: F.col(c).try_cast("date") for c in date_columns}) if date_columns else df


def write_stage(df: DataFrame, path: str, partition_by: str | None = "data_type", mode: str = "overwrite") -> None:
    """Stage output as parquet, partitioned so that the next stage prunes by split."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite", path: str | None = None) -> DataFrame:
    """Bucketed table: joins and aggregates on ``key`` then need no shuffle, as often as they are repeated. Rows are dealt before the write,
    so a bucket is one file. With ``path`` the data lies there instead of in the warehouse."""
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def rows_per_chunk(df: DataFrame, target_bytes: int = 10 * 1024 * 1024) -> int:
    """Rows that make up about ``target_bytes`` of CSV, from the mean size of all rows."""
    size = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns), F.lit(len(df.columns)))
    mean = df.agg(F.avg(size)).first()[0]
    return max(1, int(target_bytes / mean)) if mean else 1


def write_chunks(df: DataFrame, path: str, target_bytes: int = 10 * 1024 * 1024, mode: str = "overwrite") -> None:
    """CSV export in files of about ``target_bytes``, written in parallel."""
    df.write.mode(mode).option("header", True).option("maxRecordsPerFile", rows_per_chunk(df, target_bytes)).csv(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long-form metric rows as JSON lines."""
    metrics.write.mode(mode).json(path)


def save_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Fitted mapping tables, one parquet folder each."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_model(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)
