"""The given order-processing tables seen as the five-table model.

Suppliers act as buildings, line items as meter readings, customers as users, orders as trips,
parts as initiatives and events as live readings.  Every row of each table takes part.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from cinderbook.functions.factors import with_energy_co2e, with_trip_co2e
from cinderbook.schemas import Ledger

# The reporting day of the bound data.
AS_OF = dt.date(2001, 7, 1)

FIRST_START = dt.date(1999, 1, 1)

# Building uses by nation key modulo seven.
USES = ("Academic", "Student Services", "Administrative", "Residential", "Dining", "Recreation", "Research")


# Columns of the given tables the binding reads; explicit, so that no job infers a schema.
GIVEN = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(GIVEN[table]).parquet(str(PurePath(sf_dir) / f"{table}.parquet"))


def _use_of(nation: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{use}'" for i, use in enumerate(USES))
    return f"CASE {nation} % {len(USES)} {cases} END"


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS building_id",
        "s_name AS name",
        "CAST(15000 + (s_suppkey * 997) % 40001 AS INT) AS sq_footage",
        f"{_use_of('s_nationkey')} AS primary_use",
        "CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE>) AS location_gps",
        "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS record_id",
        "l_suppkey AS building_id",
        "l_shipdate + make_dt_interval(0, CAST(l_partkey % 24 AS INT)) AS date_time",
        "CASE l_linenumber % 4 WHEN 0 THEN 'electricity' WHEN 1 THEN 'gas' WHEN 2 THEN 'fuel' ELSE 'steam' END"
        " AS source",
        "CAST(CAST(CAST(l_quantity * 1000 AS BIGINT) + l_partkey % 100 AS DECIMAL(12,0))"
        " * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS consumption_kwh",
        "l_shipdate AS created_at",
    )
    return with_energy_co2e(readings)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "concat('user', CAST(c_custkey AS STRING), '@example.edu') AS email",
        "CASE c_custkey % 20 WHEN 0 THEN 'admin' WHEN 1 THEN 'guest' ELSE 'user' END AS role",
        "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS department",
        "substr(c_name, 1, 8) AS first_name",
        "substr(c_name, 10) AS last_name",
        "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS trip_id",
        "o_custkey AS user_id",
        "CAST(o_orderdate AS DATE) AS date",
        "CASE o_orderkey % 7 WHEN 0 THEN 'car' WHEN 1 THEN 'bus' WHEN 2 THEN 'bike' WHEN 3 THEN 'walk'"
        " WHEN 4 THEN 'air' WHEN 5 THEN 'train' ELSE 'metro' END AS mode",
        "CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS DECIMAL(12,0))"
        " * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS distance_km",
        "o_orderdate AS created_at",
    )
    return with_trip_co2e(logged)


def initiatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = f"date_add(DATE '{FIRST_START}', CAST(p_partkey % 900 AS INT))"
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS initiative_id",
        "p_name AS name",
        "CAST(NULL AS STRING) AS description",
        "CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size END"
        " AS DECIMAL(10,2)) AS target_reduction_tco2e",
        "CAST(p_partkey % 60 AS DECIMAL(10,2)) AS actual_reduction_tco2e",
        "CASE p_partkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' ELSE 'cancelled' END"
        " AS status",
        f"{start} AS start_date",
        f"CASE WHEN p_partkey % 9 <> 0 THEN date_add({start}, CAST(p_partkey % 400 AS INT)) END AS end_date",
        "CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 100 END AS created_by",
        f"CAST({start} AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )


class BoundLedger(Ledger):
    """The bound tables, each set up when a report first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def buildings(self) -> DataFrame:
        return buildings(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return users(self.spark, self.sf_dir)

    @cached_property
    def energy(self) -> DataFrame:
        return energy(self.spark, self.sf_dir)

    @cached_property
    def trips(self) -> DataFrame:
        return trips(self.spark, self.sf_dir)

    @cached_property
    def initiatives(self) -> DataFrame:
        return initiatives(self.spark, self.sf_dir)


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return BoundLedger(spark, sf_dir)


def live_readings(events: DataFrame) -> DataFrame:
    """Events as readings of live meters; errors carry no known source."""
    return events.selectExpr(
        "event_id AS record_id",
        "user_id AS building_id",
        "ts AS date_time",
        "CASE event_type WHEN 'view' THEN 'electricity' WHEN 'click' THEN 'gas' WHEN 'purchase' THEN 'fuel'"
        " WHEN 'signup' THEN 'steam' ELSE event_type END AS source",
        "CAST(value AS DECIMAL(10,2)) AS consumption_kwh",
    )
