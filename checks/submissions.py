"""Change batches and raw submissions derived from the given tables.

Each is (table, expressions), in SQL both engines read the same way.
"""

from __future__ import annotations

TRIPS_SUBMITTED = (
    "orders",
    (
        "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey ELSE -1 - o_orderkey END AS trip_id",
        "o_custkey + CASE WHEN o_orderstatus = 'P' THEN 100 ELSE 0 END AS user_id",
        "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'soon'"
        " ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'air' WHEN '2-HIGH' THEN 'car' WHEN '3-MEDIUM' THEN 'train'"
        " WHEN '5-LOW' THEN 'bike' ELSE 'teleport' END AS mode",
        "concat(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN '-' ELSE '' END,"
        " CAST(CAST(floor(o_totalprice / 40) AS BIGINT) AS STRING), '.255') AS distance_km",
    ),
)

READINGS_SUBMITTED = (
    "events",
    (
        "CASE WHEN event_id % 5 = 0 THEN event_id WHEN event_id % 7 = 0 THEN -event_id ELSE -1 - event_id END AS record_id",
        "CASE WHEN event_type = 'error' THEN -1 - user_id ELSE user_id END AS building_id",
        "CASE WHEN event_type = 'click' AND value > 100 THEN 'never' ELSE CAST(ts AS STRING) END AS date_time",
        "CASE event_type WHEN 'view' THEN 'electricity' WHEN 'click' THEN 'gas' WHEN 'purchase' THEN 'fuel'"
        " WHEN 'signup' THEN 'steam' ELSE event_type END AS source",
        "CAST(CAST(value AS DECIMAL(10,2)) - 5 AS STRING) AS consumption_kwh",
    ),
)

# The same, keys in eight rows each, spread over the files that arrive one after another.
READINGS_STREAMED = (
    "events",
    (
        "CASE WHEN event_id % 5 = 0 THEN event_id WHEN event_id % 7 = 0 THEN -event_id"
        " ELSE -1 - CAST(floor(event_id / 8) AS BIGINT) END AS record_id",
        *READINGS_SUBMITTED[1][1:],
        "event_id % 4 AS file",
    ),
)

INITIATIVES_SUBMITTED = (
    "part",
    (
        "-1 - p_partkey AS initiative_id",
        "CASE WHEN p_type = 'SMALL' THEN ' x ' ELSE concat(' ', p_name) END AS name",
        "repeat(p_type, CASE WHEN p_size > 45 THEN 200 ELSE 1 END) AS description",
        "CAST(p_size - 5 AS STRING) AS target_reduction_tco2e",
        "CASE p_type WHEN 'PROMO' THEN 'draft' WHEN 'LARGE' THEN NULL WHEN 'ECONOMY' THEN 'active' ELSE 'planned' END"
        " AS status",
        "CASE WHEN p_size = 30 THEN '2001-02-30' ELSE '2001-03-01' END AS start_date",
        "CASE WHEN p_size = 20 THEN '1 May' WHEN p_size > 40 THEN '2001-02-01'"
        " WHEN p_size > 20 THEN '2002-01-31' END AS end_date",
        "p_partkey AS created_by",
    ),
)

USERS_SUBMITTED = (
    "customer",
    (
        "-1 - c_custkey AS user_id",
        "concat(' USER', CAST(c_custkey - c_custkey % 2 + 1000 AS STRING),"
        " CASE WHEN c_mktsegment = 'MACHINERY' THEN '.example.edu ' ELSE '@Example.EDU ' END) AS email",
        "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' A ' ELSE ' Ada ' END AS first_name",
        "substr(c_name, 10) AS last_name",
        "c_mktsegment AS department",
    ),
)

BUILDINGS_SUBMITTED = (
    "supplier",
    (
        "-1 - s_suppkey AS building_id",
        "CASE WHEN s_nationkey % 4 = 0 THEN s_name WHEN s_nationkey % 4 = 3 THEN ' X '"
        " ELSE concat('Hall ', CAST(s_nationkey AS STRING)) END AS name",
        "concat(CAST(CAST(floor(s_acctbal) AS BIGINT) AS STRING), CASE WHEN s_nationkey % 5 = 0 THEN '.5' ELSE '' END)"
        " AS sq_footage",
        "'Research' AS primary_use",
        "CASE WHEN s_nationkey % 7 = 6 THEN 'POINT(1,2)' WHEN s_nationkey % 7 = 5 THEN NULL"
        " ELSE concat('POINT(', CAST(s_nationkey AS STRING), '.5 -7)') END AS location_gps",
    ),
)

PROGRESS_SUBMITTED = (
    "part",
    (
        "CASE WHEN p_type = 'MEDIUM' THEN -1 - p_partkey ELSE p_partkey END AS initiative_id",
        "CASE WHEN p_size > 10 THEN CAST(p_size - 13 AS STRING) END AS actual_reduction_tco2e",
        "CASE p_type WHEN 'PROMO' THEN 'completed' WHEN 'LARGE' THEN 'lost' WHEN 'SMALL' THEN 'active' END AS status",
        "TIMESTAMP '2001-07-01 08:00:00' AS sent_at",
    ),
)

# Line numbers repeat, so most live readings get several corrections.
READING_UPDATES = (
    "lineitem",
    (
        "l_orderkey AS record_id",
        "l_suppkey AS building_id",
        "l_shipdate AS date_time",
        "CASE l_linenumber % 4 WHEN 0 THEN 'electricity' WHEN 1 THEN 'gas' WHEN 2 THEN 'fuel' ELSE 'steam' END AS source",
        "CAST(l_quantity AS DECIMAL(10,2)) AS consumption_kwh",
        "l_shipdate AS updated_at",
    ),
)

# The same with unknown sources, negative amounts, missing times and buildings that do not exist.
READING_CORRECTIONS = (
    "lineitem",
    (
        "l_orderkey AS record_id",
        "CASE WHEN l_partkey % 9 = 1 THEN -l_suppkey ELSE l_suppkey END AS building_id",
        "CASE WHEN l_partkey % 9 <> 2 THEN l_shipdate END AS date_time",
        "CASE l_partkey % 9 WHEN 3 THEN 'plasma' WHEN 4 THEN NULL ELSE 'gas' END AS source",
        "CAST(CASE WHEN l_partkey % 9 = 3 OR l_partkey % 9 = 5 THEN -5 ELSE l_quantity END AS DECIMAL(10,2)) AS consumption_kwh",
        "l_shipdate AS updated_at",
    ),
)

TRIP_UPDATES = (
    "orders",
    (
        "CASE WHEN o_orderpriority = '1-URGENT' THEN -1 - o_orderkey ELSE o_orderkey END AS trip_id",
        "CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS user_id",
        "CAST(o_orderdate AS DATE) AS date",
        "CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'car' END AS mode",
        "CAST(o_custkey % 500 AS DECIMAL(8,2)) AS distance_km",
        "o_orderdate AS updated_at",
    ),
)

USER_UPDATES = (
    "customer",
    (
        "CASE WHEN c_mktsegment = 'FURNITURE' THEN -1 - c_custkey ELSE c_custkey END AS user_id",
        "'Ada' AS first_name",
        "c_mktsegment AS last_name",
        "CAST(NULL AS STRING) AS department",
        "TIMESTAMP '2001-07-01 08:00:00' AS sent_at",
    ),
)

# A third keeps its name, a third asks for a taken name, the rest for one of few new names.
BUILDING_UPDATES = (
    "supplier",
    (
        "s_suppkey AS building_id",
        "CASE s_nationkey % 3 WHEN 0 THEN s_name"
        " WHEN 1 THEN concat('Supplier#', lpad(CAST(s_suppkey + 1 AS STRING), 9, '0'))"
        " ELSE concat('Annex ', CAST(s_nationkey AS STRING)) END AS name",
        "CAST(20000 + s_nationkey AS INT) AS sq_footage",
        "'Research' AS primary_use",
        "TIMESTAMP '2001-07-01 08:00:00' AS sent_at",
    ),
)

INITIATIVE_UPDATES = (
    "part",
    (
        "CASE WHEN p_type = 'MEDIUM' THEN -1 - p_partkey ELSE p_partkey END AS initiative_id",
        "concat(p_brand, ' ', p_name) AS name",
        "p_type AS description",
        "CAST(p_size * 2 AS DECIMAL(10,2)) AS target_reduction_tco2e",
        "CASE WHEN p_size > 10 THEN CAST(p_size AS DECIMAL(10,2)) END AS actual_reduction_tco2e",
        "'active' AS status",
        "DATE '2001-03-01' AS start_date",
        "CAST(NULL AS DATE) AS end_date",
        "TIMESTAMP '2001-07-01 08:00:00' AS sent_at",
    ),
)


def as_sql(batch: tuple[str, tuple[str, ...]]) -> str:
    table, expressions = batch
    return f"SELECT {', '.join(expressions)} FROM {table}"
