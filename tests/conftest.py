import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

import checks.jobs  # noqa: F401  (registers)
import checks.oracle_jobs  # noqa: F401  (registers)
from checks.compare import duck
from cinderbook.functions.factors import with_energy_co2e, with_trip_co2e
from cinderbook.schemas import KM, KWH

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cinderbook-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)


def energy_frame(spark, rows):
    """(record, building, time, source, kwh) rows as readings with their emission."""
    rows = [(r, b, t and dt.datetime.fromisoformat(t), s, None if k is None else Decimal(str(k))) for r, b, t, s, k in rows]
    df = spark.createDataFrame(
        rows,
        "record_id STRING, building_id STRING, date_time TIMESTAMP_NTZ, source STRING, consumption_kwh DECIMAL(12,4)",
    )
    df = df.withColumn("consumption_kwh", df["consumption_kwh"].cast(KWH))
    return with_energy_co2e(df).selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at")


def trip_frame(spark, rows):
    """(trip, user, date, mode, km) rows as trips with their emission."""
    rows = [(t, u, dt.date.fromisoformat(d) if d else None, m, Decimal(str(k))) for t, u, d, m, k in rows]
    df = spark.createDataFrame(rows, "trip_id STRING, user_id STRING, date DATE, mode STRING, distance_km DECIMAL(10,3)")
    df = df.withColumn("distance_km", df["distance_km"].cast(KM))
    return with_trip_co2e(df).selectExpr("*", "CAST(date AS TIMESTAMP_NTZ) AS created_at")


def building_frame(spark, rows):
    """(building, name, area, use) rows."""
    df = spark.createDataFrame(rows, "building_id STRING, name STRING, sq_footage INT, primary_use STRING")
    return df.selectExpr(
        "*",
        "CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE>) AS location_gps",
        "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )


def user_frame(spark, rows):
    """(user, role, department) rows."""
    df = spark.createDataFrame(rows, "user_id STRING, role STRING, department STRING")
    return df.selectExpr(
        "user_id",
        "concat(user_id, '@example.edu') AS email",
        "role",
        "department",
        "user_id AS first_name",
        "'Test' AS last_name",
        "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )


def initiative_frame(spark, rows):
    """(initiative, target, actual, status, start, end, creator) rows."""
    rows = [tuple(r) for r in rows]
    df = spark.createDataFrame(
        rows,
        "initiative_id STRING, target STRING, actual STRING, status STRING, start_date STRING, end_date STRING,"
        " created_by STRING",
    )
    return df.selectExpr(
        "initiative_id",
        "initiative_id AS name",
        "CAST(NULL AS STRING) AS description",
        "CAST(target AS DECIMAL(10,2)) AS target_reduction_tco2e",
        "CAST(actual AS DECIMAL(10,2)) AS actual_reduction_tco2e",
        "status",
        "CAST(start_date AS DATE) AS start_date",
        "CAST(end_date AS DATE) AS end_date",
        "created_by",
        "CAST(start_date AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )
