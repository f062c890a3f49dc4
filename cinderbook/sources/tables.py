"""Reading and writing the five tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.functions.exprs import month_of, point
from cinderbook.schemas import FACT_TIME, KEY_COLUMNS, MONTH_COLUMN, SCHEMAS, Ledger, check_schema

TEXT_FORMATS = ("csv",)


def model_schema(table: str, key_type: T.DataType | None = None) -> T.StructType:
    """Schema of a table; keys are strings unless another type is given."""
    fields = []
    for field in SCHEMAS[table].fields:
        is_key = key_type is not None and field.name in KEY_COLUMNS
        fields.append(T.StructField(field.name, key_type if is_key else field.dataType))
    return T.StructType(fields)


def read_table(
    spark: SparkSession,
    table: str,
    path: str,
    fmt: str = "parquet",
    key_type: T.DataType | None = None,
    **options: str,
) -> DataFrame:
    """Read a table from Parquet, ORC, JSON or CSV with its declared schema.

    Facts written by `write_table` also carry their month, by which date filters prune folders.
    """
    schema = model_schema(table, key_type)
    if fmt in TEXT_FORMATS:
        # Text has no structs: positions are written as POINT(x y).
        flat = [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.StructType) else f.dataType)
            for f in schema.fields
        ]
        df = spark.read.format(fmt).schema(T.StructType(flat)).options(header="true", **options).load(path)
        if "location_gps" in df.columns:
            df = df.withColumn("location_gps", point(F.col("location_gps")))
        return check_schema(df, table)
    if table in FACT_TIME:
        schema = T.StructType([*schema.fields, T.StructField(MONTH_COLUMN, T.DateType())])
    df = spark.read.format(fmt).schema(schema).options(**options).load(path)
    return check_schema(df, table)


def read_jdbc(
    spark: SparkSession,
    table: str,
    url: str,
    split_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Read a table from a database, in parallel ranges of `split_column` when one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_column is not None:
        reader = reader.options(
            partitionColumn=split_column, lowerBound=lower, upperBound=upper, numPartitions=str(partitions)
        )
    columns = [
        F.col(f.name) if f.name in KEY_COLUMNS else F.col(f.name).cast(f.dataType)
        for f in SCHEMAS[table].fields
        if f.name != "location_gps"
    ]
    return reader.load().select(*columns)


def read_ledger(
    spark: SparkSession, root: str, fmt: str = "parquet", key_type: T.DataType | None = None
) -> Ledger:
    def load(table: str) -> DataFrame:
        return read_table(spark, table, str(PurePosixPath(root) / table), fmt, key_type)

    return Ledger(
        buildings=load("buildings"),
        users=load("users"),
        energy=load("energy_consumption"),
        trips=load("transportation_log"),
        initiatives=load("initiatives"),
    )


def write_table(df: DataFrame, table: str, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table, facts in one folder per month.

    Rows are rebalanced by month first: small months end in one file, and a month holding a
    third of all rows is split over several tasks.  Pass mode="append" to add to a fact; a
    changed table goes to a new folder, never over the one it was read from.
    """
    if mode not in ("errorifexists", "append"):
        raise ValueError("tables are appended to or written to a new folder")
    df = df.select(*[f.name for f in SCHEMAS[table].fields])
    if fmt in TEXT_FORMATS:
        if "location_gps" in df.columns:
            x, y = F.col("location_gps.x"), F.col("location_gps.y")
            df = df.withColumn("location_gps", F.concat(F.lit("POINT("), x, F.lit(" "), y, F.lit(")")))
        df.write.mode(mode).option("header", "true").format(fmt).save(path)
        return
    if table not in FACT_TIME:
        df.write.mode(mode).format(fmt).save(path)
        return
    by_month = df.withColumn(MONTH_COLUMN, month_of(F.col(FACT_TIME[table])))
    by_month.hint("rebalance", F.col(MONTH_COLUMN)).write.mode(mode).partitionBy(MONTH_COLUMN).format(fmt).save(path)
