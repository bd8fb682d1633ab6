"""Reading and writing the care-unit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from careflow.functions import scalars as S
from careflow.schemas import DEFAULTS, MONTHLY, TABLES


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table in its declared columns and types.

    Columns the files lack are NULL; text in place of a date, blank included, is
    read leniently. Columns stored in their declared type stay plain column
    references, so filters on them reach the scan.
    """
    stored = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    return typed(stored, table_schema(name))


def typed(stored: DataFrame, schema: T.StructType) -> DataFrame:
    return stored.select(*[_as_type(stored, field).alias(field.name) for field in schema])


def _as_type(stored: DataFrame, field: T.StructField) -> Column:
    if field.name not in stored.columns:
        return F.lit(None).cast(field.dataType)
    kind, value = stored.schema[field.name].dataType, F.col(field.name)
    if kind == field.dataType:
        return value
    if isinstance(kind, T.StringType):
        return F.trim(value).try_cast(field.dataType)
    return value.cast(field.dataType)


def write_table(df: DataFrame, folder: str, name: str, mode: str = "error") -> None:
    """Writes a table with its defaults filled in; large dated tables by month."""
    for col, value in DEFAULTS.get(name, {}).items():
        if col in df.columns:
            df = df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    path = f"{folder.rstrip('/')}/{name}"
    if name in MONTHLY:
        # Months are cut by date ranges first, so a month is a few files and a large
        # month is spread over several tasks.
        day = MONTHLY[name]
        cut = df.withColumn("month", S.month_label(day)).repartitionByRange("month", day, "id")
        cut.write.mode(mode).partitionBy("month").parquet(path)
    else:
        df.write.mode(mode).parquet(path)
