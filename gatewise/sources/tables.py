"""Table sources: parquet or JDBC reads, parameterised SQL, name normalisation and time-bounded reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple | None = None,
              partitions: int = 64, **options: str) -> DataFrame:
    """Push ``query`` to a warehouse. With a partition column the read is split into ``partitions`` range scans."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    low, high = bounds
    return (reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load())


def run_query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL with bound parameters (``:name``) and DataFrames (``{name}``); values are never spliced into the text."""
    return spark.sql(sql, args=args, **tables)


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case names and keep the part after the last ``.`` or ``__``; a clash is an error."""
    names = [re.split(r"\.|__", c.lower())[-1] for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"normalised names clash: {clashes}")
    return df.toDF(*names)


def spine(df: DataFrame, key: str, timestamp: str) -> DataFrame:
    """Entity and timestamp rows for a point-in-time feature read."""
    return normalise_names(df).select(key.lower(), timestamp.lower())


def between_times(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows with ``start <= column < end``; a plain comparison, so it prunes partitions and is pushed to the scan."""
    return df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Input contract: fail on missing columns before any job runs."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; values that do not parse become NULL (safe under ANSI mode)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
