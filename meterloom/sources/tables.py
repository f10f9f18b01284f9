"""Table scans with validation, yearly unions and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.names import normalise_columns


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a raw table as it is; ``.csv`` paths are read with a header, everything else as Parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ".csv" in path:
        reader = reader.option("header", True)
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    return reader.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a table that may not have been produced yet; an absent path is an empty table."""
    try:
        return read_raw(spark, path, schema)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}; available: {df.columns}")
    return df


def required(value: Column, message: str) -> Column:
    """``value``, failing the job on the first null. Checked inside the scan, without a job of its own."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))


def validated_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """Cast ``date`` to a date and fail when any row cannot be parsed."""
    require_columns(df, date)
    return df.withColumn(
        date, required(F.col(date).try_cast("date"), f"column {date} holds unparseable dates")
    )


def read_daily(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Daily or forecast table whose ``date`` must parse on every row."""
    return validated_dates(read_raw(spark, path, schema))


def union_yearly(frames: dict[int, DataFrame] | list[DataFrame]) -> DataFrame:
    """Stack yearly tables by column name; a column absent from a year is null there.

    Years whose headers agree may come as one table that has a ``source_year`` column: a list of such tables
    is read once per header, not once per year.
    """
    if not frames:
        raise ValueError("no yearly table was given")
    if isinstance(frames, dict):
        tagged = [normalise_columns(df).withColumn("source_year", F.lit(year)) for year, df in sorted(frames.items())]
    else:
        tagged = [require_columns(normalise_columns(df), "source_year") for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_table(
    df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet"
) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` over those partitions of the table at ``path`` that it has rows for, and leave the others.

    Running it again with the same rows leaves the same table, so a failed run is simply repeated.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
