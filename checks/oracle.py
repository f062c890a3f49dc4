"""The same questions in plain SQL, written from their definitions and not from the Spark plans."""

from __future__ import annotations

MODEL = """
WITH buildings AS (
  SELECT s_suppkey AS building_id, s_name AS name,
    CAST(15000 + (s_suppkey * 997) % 40001 AS INT) AS sq_footage,
    CASE s_nationkey % 7 WHEN 0 THEN 'Academic' WHEN 1 THEN 'Student Services' WHEN 2 THEN 'Administrative'
      WHEN 3 THEN 'Residential' WHEN 4 THEN 'Dining' WHEN 5 THEN 'Recreation' ELSE 'Research' END AS primary_use
  FROM supplier
), readings AS (
  SELECT l_orderkey * 10 + l_linenumber AS record_id, l_suppkey AS building_id,
    l_shipdate + to_hours(CAST(l_partkey % 24 AS INT)) AS date_time,
    CASE l_linenumber % 4 WHEN 0 THEN 'electricity' WHEN 1 THEN 'gas' WHEN 2 THEN 'fuel' ELSE 'steam' END AS source,
    CAST(CAST(CAST(l_quantity * 1000 AS BIGINT) + l_partkey % 100 AS DECIMAL(12,0))
      * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS consumption_kwh,
    l_shipdate AS created_at
  FROM lineitem
), energy AS (
  SELECT *, CAST(CASE source WHEN 'electricity' THEN consumption_kwh * CAST(0.0004 AS DECIMAL(4,4))
      WHEN 'gas' THEN consumption_kwh * CAST(0.0002 AS DECIMAL(4,4))
      WHEN 'fuel' THEN consumption_kwh * CAST(0.0003 AS DECIMAL(4,4))
      WHEN 'steam' THEN consumption_kwh * CAST(0.0001 AS DECIMAL(4,4)) ELSE 0 END AS DECIMAL(10,4)) AS co2e_emitted
  FROM readings
), users AS (
  SELECT c_custkey AS user_id, concat('user', CAST(c_custkey AS VARCHAR), '@example.edu') AS email,
    CASE c_custkey % 20 WHEN 0 THEN 'admin' WHEN 1 THEN 'guest' ELSE 'user' END AS role,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS department,
    substr(c_name, 1, 8) AS first_name, substr(c_name, 10) AS last_name,
    CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
  FROM customer
), logged AS (
  SELECT o_orderkey AS trip_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date, o_orderdate AS created_at,
    CASE o_orderkey % 7 WHEN 0 THEN 'car' WHEN 1 THEN 'bus' WHEN 2 THEN 'bike' WHEN 3 THEN 'walk'
      WHEN 4 THEN 'air' WHEN 5 THEN 'train' ELSE 'metro' END AS mode,
    CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS DECIMAL(12,0))
      * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS distance_km
  FROM orders
), trips AS (
  SELECT *, CAST(CASE mode WHEN 'car' THEN distance_km * CAST(0.21 AS DECIMAL(2,2))
      WHEN 'bus' THEN distance_km * CAST(0.08 AS DECIMAL(2,2)) WHEN 'air' THEN distance_km * CAST(0.25 AS DECIMAL(2,2))
      WHEN 'train' THEN distance_km * CAST(0.04 AS DECIMAL(2,2)) WHEN 'metro' THEN distance_km * CAST(0.03 AS DECIMAL(2,2))
      WHEN 'bike' THEN 0 WHEN 'walk' THEN 0
      ELSE distance_km * CAST(0.15 AS DECIMAL(2,2)) END AS DECIMAL(8,4)) AS co2e_emitted
  FROM logged
), initiatives AS (
  SELECT p_partkey AS initiative_id, p_name AS name, CAST(NULL AS VARCHAR) AS description,
    CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size END AS DECIMAL(10,2))
      AS target_reduction_tco2e,
    CAST(p_partkey % 60 AS DECIMAL(10,2)) AS actual_reduction_tco2e,
    CASE p_partkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS status,
    DATE '1999-01-01' + CAST(p_partkey % 900 AS INT) AS start_date,
    CASE WHEN p_partkey % 9 = 0 THEN NULL
      ELSE DATE '1999-01-01' + CAST(p_partkey % 900 + p_partkey % 400 AS INT) END AS end_date,
    CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 100 END AS created_by,
    CAST(DATE '1999-01-01' + CAST(p_partkey % 900 AS INT) AS TIMESTAMP) AS created_at,
    CAST(NULL AS TIMESTAMP) AS updated_at
  FROM part
), live AS (
  SELECT event_id AS record_id, user_id AS building_id, ts AS date_time,
    CASE event_type WHEN 'view' THEN 'electricity' WHEN 'click' THEN 'gas' WHEN 'purchase' THEN 'fuel'
      WHEN 'signup' THEN 'steam' ELSE event_type END AS source,
    CAST(value AS DECIMAL(10,2)) AS consumption_kwh
  FROM events
), metered AS (
  SELECT e.*, b.name, b.primary_use, b.sq_footage FROM energy e JOIN buildings b USING (building_id)
), travelled AS (
  SELECT t.*, p.role, p.department, p.email, concat(p.first_name, ' ', p.last_name) AS user_name
  FROM trips t JOIN users p USING (user_id)
)
"""

TODAY = "DATE '2001-07-01'"
YEAR = "BETWEEN DATE '2000-07-01' AND DATE '2001-07-01'"
QUARTER = "BETWEEN DATE '2001-04-02' AND DATE '2001-07-01'"
MONTH = "BETWEEN DATE '2001-06-01' AND DATE '2001-07-01'"

SQL: dict[str, str] = {}


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def R(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def Q(a: str, b: str) -> str:
    """a / b as double, NULL for b = 0."""
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def more(*ctes: str) -> str:
    return ", " + ", ".join(ctes) + " "


def sql(name: str, body: str, ctes: str = "") -> None:
    SQL[name] = MODEL + ctes + body


# --- pieces used by several questions -------------------------------------------------------
SUM_CO2E, SUM_KWH, SUM_KM = "SUM(co2e_emitted)", "SUM(consumption_kwh)", "SUM(distance_km)"
MEAN_CO2E, MEAN_KWH, MEAN_KM = Q(SUM_CO2E, "COUNT(co2e_emitted)"), Q(SUM_KWH, "COUNT(consumption_kwh)"), Q(SUM_KM, "COUNT(distance_km)")


def zero(x: str) -> str:
    return D(f"COALESCE({x}, 0)")


def recent(months: int, column: str = "date") -> str:
    return f"{column} >= {TODAY} - INTERVAL '{months} months'"


LAST_30 = f"date_time >= {TODAY} - INTERVAL '30 days'"


def on_days(span: str) -> str:
    return f"CAST(date_time AS DATE) {span}"


def month(column: str) -> str:
    return f"CAST(date_trunc('month', {column}) AS DATE)"


def info(source: str, number: int, size: int) -> str:
    return f"""
SELECT CAST({number} AS BIGINT) AS current_page, CAST(ceil(n / {size}.0) AS BIGINT) AS total_pages, n AS total_records,
  {number} < ceil(n / {size}.0) AS has_next, {number} > 1 AS has_prev FROM (SELECT COUNT(*) AS n FROM {source}) c"""


# --- overview -------------------------------------------------------------------------------
sql("campus_overview", f"""
SELECT (SELECT count(*) FROM buildings) AS total_buildings, {D("e")} AS annual_energy_co2e, {D("t")} AS annual_transport_co2e,
  {D("e + t")} AS total_annual_co2e, (SELECT count(*) FILTER (WHERE status = 'active') FROM initiatives) AS active_initiatives
FROM (SELECT COALESCE({SUM_CO2E}, 0) AS e FROM energy WHERE {recent(12, "date_time")}) x,
  (SELECT COALESCE({SUM_CO2E}, 0) AS t FROM trips WHERE {recent(12)}) y
""")


def scopes(energy_filter: str, trip_filter: str, columns: str) -> str:
    both = "scope(emission_scope, data_source, kg, record_count)"
    return f"""
SELECT emission_scope, {R("kg", 2)} AS total_co2e_kg, record_count{columns},
  {R(Q("kg", "(SELECT SUM(kg) FROM scope)") + " * 100", 1)} AS percentage FROM scope""", more(f"""{both} AS (
  SELECT 'Scope 1 & 2 (Energy)', 'energy', {SUM_CO2E}, COUNT(*) FROM energy WHERE {energy_filter}
  UNION ALL SELECT 'Scope 3 (Transportation)', 'transportation', {SUM_CO2E}, COUNT(*) FROM trips WHERE {trip_filter})""")


sql("scope_breakdown", *scopes(recent(12, "date_time"), recent(12), ""))
sql("scope_breakdown_range", *scopes(on_days(YEAR), f"date {YEAR}", ", data_source"))
sql("monthly_trend_by_scope", f"""
SELECT month, source, {D("SUM(kg)")} AS monthly_co2e FROM (
  SELECT {month("date_time")} AS month, 'energy' AS source, co2e_emitted AS kg FROM energy WHERE {on_days(YEAR)}
  UNION ALL SELECT {month("date")}, 'transportation', co2e_emitted FROM trips WHERE date {YEAR}) x
GROUP BY month, source""")
sql("carbon_footprint_summary", f"""
SELECT DATE '2000-07-01' AS start_date, DATE '2001-07-01' AS end_date, {D("e + t")} AS total_co2e_kg,
  CAST(round(CAST(e + t AS DECIMAL(28,8)) / 1000, 3) AS DOUBLE) AS total_co2e_tonnes, {D("e")} AS energy_co2e_kg,
  {D("t")} AS transport_co2e_kg, COALESCE((SELECT name FROM per ORDER BY total DESC, building_id LIMIT 1), 'N/A')
    AS top_emitting_building, (SELECT count(*) FROM per) AS total_buildings, CAST(365 AS BIGINT) AS report_period_days
FROM (SELECT COALESCE(round({SUM_CO2E}, 2), 0) AS e FROM energy WHERE {on_days(YEAR)}) x,
  (SELECT COALESCE(round({SUM_CO2E}, 2), 0) AS t FROM trips WHERE date {YEAR}) y
""", more(f"""per AS (SELECT building_id, name, round({SUM_CO2E}, 2) AS total FROM metered
  WHERE {on_days(YEAR)} GROUP BY building_id, name)"""))

# --- buildings ------------------------------------------------------------------------------
BUILDING = "building_id, name, primary_use, sq_footage"


def with_readings(condition: str) -> str:
    """Every building beside each of its readings meeting the condition, once alone without any."""
    return f"buildings LEFT JOIN (SELECT * EXCLUDE (created_at) FROM energy WHERE {condition}) m USING (building_id)"


PERFORMANCE = f"""
SELECT {BUILDING}, {zero(SUM_CO2E)} AS total_co2e, {zero(SUM_KWH)} AS total_consumption_kwh,
  COALESCE({Q(SUM_CO2E, "sq_footage")}, 0) AS co2e_per_sqft
FROM {with_readings("TRUE")} GROUP BY {BUILDING}
"""
sql("building_performance", PERFORMANCE)
sql("building_performance_top", PERFORMANCE + " ORDER BY total_co2e DESC, building_id LIMIT 10")


def emitters(condition: str, tail: str, extra: str = "") -> str:
    return f"""
SELECT name AS building_name, primary_use, sq_footage, COUNT(*) AS total_records, {R(SUM_CO2E, 2)} AS total_co2e_kg,
  {R(Q(SUM_CO2E, "sq_footage"), 4)} AS co2e_per_sqft{extra}
FROM metered WHERE {condition} GROUP BY {BUILDING} {tail}"""


FIRST_FIVE = "ORDER BY total_co2e_kg DESC, building_id LIMIT 5"
sql("top_buildings_quarter", emitters(recent(3, "date_time"), FIRST_FIVE))
sql("top_buildings", emitters(on_days(MONTH), FIRST_FIVE))
sql("building_breakdown_range", emitters(on_days(YEAR), ""))
sql("top_buildings_range", emitters(
    on_days(QUARTER), "QUALIFY rank <= 10", f""", {R(MEAN_KWH, 2)} AS avg_consumption_kwh,
  {R(SUM_KWH, 2)} AS total_consumption_kwh,
  row_number() OVER (ORDER BY round({SUM_CO2E}, 2) DESC, building_id) AS rank"""))
sql("buildings_vs_campus_average", f"""
SELECT building_id, name AS building_name, {R("total", 2)} AS total_co2e_kg, {R("a", 2)} AS campus_avg_co2e,
  {R("i", 4)} AS campus_avg_intensity,
  CASE WHEN a > 0 THEN {R("(CAST(round(total, 2) AS DOUBLE) / a - 1) * 100", 1)} END AS vs_average_percent
FROM per, (SELECT {Q("SUM(total)", "COUNT(total)")} AS a,
  {Q("SUM(CAST(intensity AS DECIMAL(28,16)))", "COUNT(intensity)")} AS i FROM per) c
""", more(f"""per AS (SELECT building_id, name, {SUM_CO2E} AS total, {Q(SUM_CO2E, "sq_footage")} AS intensity
  FROM metered WHERE {on_days(QUARTER)} GROUP BY {BUILDING})"""))

for _name in ("building_efficiency", "building_efficiency_partitioned"):
    sql(_name, f"""
SELECT building_id, name AS building_name, primary_use, sq_footage, {R("kwh", 1)} AS avg_daily_kwh,
  {R("intensity", 6)} AS co2e_per_sqft, 1 + (SELECT count(*) FROM stats lower WHERE lower.intensity < stats.intensity)
    AS efficiency_rank,
  ['Excellent', 'Good', 'Average', 'Needs Improvement'][
    1 + CAST(intensity >= cut[1] AS INT) + CAST(intensity >= cut[2] AS INT) + CAST(intensity >= cut[3] AS INT)]
    AS efficiency_rating, {R("spread", 1)} AS consumption_variability, {D("low")} AS min_kwh, {D("high")} AS max_kwh
FROM stats, (SELECT quantile_cont(intensity, [0.25, 0.5, 0.75]) AS cut FROM stats) q""", more(f"""stats AS (
  SELECT {BUILDING}, {MEAN_KWH} AS kwh, {MEAN_CO2E} / sq_footage AS intensity, stddev_samp(consumption_kwh) AS spread,
    min(consumption_kwh) AS low, max(consumption_kwh) AS high
  FROM metered WHERE {recent(1, "date_time")} GROUP BY {BUILDING})"""))


def ranked(sign: str) -> str:
    """Ranks counted as 1 + number of buildings ahead."""
    return f"""
SELECT * EXCLUDE (place), ['Needs Improvement', 'Average', 'Good', 'Excellent', 'Excellent'][1 + CAST(floor(place * 4) AS INT)]
  AS efficiency_rating
FROM (SELECT *, (count(*) OVER () - efficiency_rank + 1) / CAST(count(*) OVER () AS DOUBLE) AS place FROM (
  SELECT *, 1 + (SELECT count(*) FROM per o WHERE o.total_co2e > per.total_co2e) AS emission_rank,
    1 + (SELECT count(*) FROM per o WHERE o.co2e_per_sqft {sign} per.co2e_per_sqft) AS efficiency_rank
  FROM per) r) x""", more(f"""per AS (
  SELECT {BUILDING}, {zero(SUM_CO2E)} AS total_co2e, {zero(SUM_KWH)} AS total_consumption_kwh,
    COALESCE({Q(SUM_CO2E, "sq_footage")}, 0) AS co2e_per_sqft, COUNT(record_id) AS record_count
  FROM {with_readings(LAST_30)} GROUP BY {BUILDING})""")


sql("building_performance_ranked", *ranked(">"))
sql("building_performance_partitioned", *ranked(">"))
sql("building_performance_lowest_first", *ranked("<"))


def by_use(source: str, records: str) -> str:
    return f"""
SELECT primary_use, COUNT(*) AS building_count, CAST(SUM(sq_footage) AS BIGINT) AS total_sq_footage,
  {Q("SUM(sq_footage)", "COUNT(*)")} AS avg_sq_footage, {zero(SUM_CO2E)} AS total_co2e,
  COALESCE({Q(SUM_CO2E, records)}, 0) AS avg_co2e_per_record, {zero(SUM_KWH)} AS total_consumption_kwh,
  COALESCE({Q(SUM_CO2E, "SUM(sq_footage)")}, 0) AS co2e_per_sqft
FROM {source} GROUP BY primary_use"""


sql("building_type_summary", by_use(with_readings(LAST_30), "COUNT(record_id)"))
sql("building_type_summary_dedup", by_use(f"""buildings LEFT JOIN (
  SELECT building_id, COUNT(*) AS n, {SUM_CO2E} AS co2e_emitted, {SUM_KWH} AS consumption_kwh
  FROM energy WHERE {LAST_30} GROUP BY building_id) m USING (building_id)""", "SUM(n)"))
sql("building_recent", f"""
SELECT building_id, name AS building_name, COUNT(record_id) AS total_records, {zero(SUM_KWH)} AS total_consumption_kwh,
  {zero(SUM_CO2E)} AS total_co2e_emitted, COALESCE({MEAN_KWH}, 0) AS avg_consumption_kwh,
  COALESCE({MEAN_CO2E}, 0) AS avg_co2e_emitted, COALESCE({Q(SUM_CO2E, "sq_footage")}, 0) AS co2e_per_sqft
FROM {with_readings(LAST_30)} GROUP BY {BUILDING}""")
sql("building_source_mix", f"""
SELECT building_id, source, COUNT(*) AS record_count, {D(SUM_KWH)} AS total_consumption_kwh, {D(SUM_CO2E)} AS total_co2e_emitted
FROM energy WHERE {LAST_30} GROUP BY building_id, source""")
sql("building_listing", """
SELECT building_id, name, sq_footage, primary_use, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM buildings QUALIFY row_number() OVER (ORDER BY name, building_id) BETWEEN 6 AND 10""")

# --- energy ---------------------------------------------------------------------------------
sql("energy_source_breakdown", f"""
SELECT source, COUNT(*) AS record_count, {D(SUM_KWH)} AS total_consumption_kwh, {D(SUM_CO2E)} AS total_co2e_kg,
  {MEAN_KWH} AS avg_consumption_kwh FROM energy WHERE {on_days(YEAR)} GROUP BY source""")
sql("monthly_energy_trend", f"""
SELECT {month("date_time")} AS month, {D(SUM_CO2E)} AS monthly_co2e FROM energy WHERE {recent(6, "date_time")} GROUP BY month""")
# Compared with the latest earlier month that has readings.
sql("monthly_building_mom", f"""
SELECT month, building_id, name AS building_name, {D("kwh")} AS monthly_kwh, {D("kg")} AS monthly_co2e,
  {D("earlier")} AS previous_month_co2e,
  {R("(CAST(kg AS DOUBLE) - CAST(earlier AS DOUBLE)) / NULLIF(CAST(earlier AS DOUBLE), 0) * 100", 2)}
    AS month_over_month_change_percent
FROM (SELECT *, (SELECT arg_max(o.kg, o.month) FROM per o WHERE o.building_id = per.building_id AND o.month < per.month)
  AS earlier FROM per) x""", more(f"""per AS (
  SELECT {month("date_time")} AS month, building_id, name, {SUM_KWH} AS kwh, {SUM_CO2E} AS kg
  FROM metered WHERE {recent(6, "date_time")} GROUP BY 1, 2, 3)"""))


def by_building(condition: str) -> str:
    return f"""
SELECT building_id, name AS building_name, primary_use, sq_footage, COUNT(record_id) AS total_records,
  {D(SUM_KWH)} AS total_consumption_kwh, {D(SUM_CO2E)} AS total_co2e_emitted, {MEAN_KWH} AS avg_consumption_kwh,
  {MEAN_CO2E} AS avg_co2e_emitted, {Q(SUM_CO2E, "sq_footage")} AS co2e_per_sqft
FROM {with_readings(condition)} GROUP BY {BUILDING}"""


sql("energy_summary_by_building", by_building(on_days(MONTH)))
sql("energy_summary_public", by_building(f"{on_days(YEAR)} AND source = 'gas' AND {LAST_30}"))
for _period, _unit in (("hourly", "hour"), ("daily", "day"), ("weekly", "week"), ("monthly", "month")):
    sql(f"energy_trends_{_period}", f"""
SELECT CAST(date_trunc('{_unit}', date_time) AS TIMESTAMP) AS period, COUNT(*) AS record_count,
  {D(SUM_KWH)} AS total_consumption_kwh, {D(SUM_CO2E)} AS total_co2e_emitted, {MEAN_KWH} AS avg_consumption_kwh,
  {MEAN_CO2E} AS avg_co2e_emitted FROM energy WHERE {on_days(MONTH)} GROUP BY period""")
sql("peak_hours", f"""
SELECT name AS building_name, CAST(h AS VARCHAR) || ':00' AS peak_hour, {R("kwh", 1)} AS peak_kwh,
  {R("kg", 3)} AS peak_co2e_kg, place AS consumption_rank
FROM (SELECT *, 1 + (SELECT count(*) FROM per o WHERE o.building_id = per.building_id AND o.kwh > per.kwh) AS place
  FROM per) x WHERE place <= 3""", more(f"""per AS (
  SELECT building_id, name, hour(date_time) AS h, {MEAN_KWH} AS kwh, {MEAN_CO2E} AS kg
  FROM metered WHERE {LAST_30} GROUP BY 1, 2, 3)"""))
sql("daily_energy_activity", f"""
SELECT CAST(date_time AS DATE) AS date, {D(SUM_CO2E)} AS daily_energy_co2e, COUNT(DISTINCT building_id) AS active_buildings
FROM energy WHERE {on_days(QUARTER)} GROUP BY 1 QUALIFY row_number() OVER (ORDER BY CAST(date_time AS DATE) DESC) <= 30""")


def reading_page(condition: str, low: int, high: int) -> str:
    return f"""
SELECT record_id, date_time, source, {D("consumption_kwh")} AS consumption_kwh, {D("co2e_emitted")} AS co2e_emitted,
  name AS building_name, primary_use, sq_footage
FROM metered WHERE {condition} QUALIFY row_number() OVER (ORDER BY date_time DESC, record_id DESC, name DESC,
  metered.consumption_kwh DESC, source DESC) BETWEEN {low} AND {high}"""


sql("energy_listing", reading_page("TRUE", 101, 150))
sql("energy_listing_public", reading_page(LAST_30, 1, 50))
sql("energy_listing_deep", f"""
SELECT record_id, date_time, source, {D("consumption_kwh")} AS consumption_kwh, {D("co2e_emitted")} AS co2e_emitted,
  name AS building_name, primary_use, sq_footage
FROM metered ORDER BY date_time DESC, record_id DESC, building_id DESC, metered.consumption_kwh DESC, source DESC LIMIT 50 OFFSET 50000""")
sql("energy_listing_after", reading_page("(date_time, record_id) < (TIMESTAMP '1999-01-01 05:00:00', 0)", 1, 100))
sql("energy_listing_info", info("metered", 3, 50))

# --- transport ------------------------------------------------------------------------------
sql("transport_mode_breakdown", f"""
SELECT mode, COUNT(*) AS trip_count, {D(SUM_KM)} AS total_distance_km, {D(SUM_CO2E)} AS total_co2e_kg,
  {MEAN_KM} AS avg_distance_km FROM trips WHERE date {YEAR} GROUP BY mode""")


def with_trips(condition: str) -> str:
    """Every user beside each of their trips meeting the condition, once alone without any."""
    return f"users LEFT JOIN (SELECT * EXCLUDE (created_at) FROM trips WHERE {condition}) m USING (user_id)"


sql("user_footprint", f"""
SELECT user_id, email, first_name, last_name, department, {zero(SUM_CO2E)} AS total_transport_co2e,
  COUNT(trip_id) AS total_trips
FROM {with_trips("TRUE")} WHERE role = 'user' GROUP BY 1, 2, 3, 4, 5""")


def patterns(condition: str, tail: str = "") -> tuple[str, str]:
    return f"""
SELECT user_id, user_name AS full_name, department, n AS total_trips, CAST(round(km, 1) AS DOUBLE) AS total_distance_km,
  CAST(round(kg, 2) AS DOUBLE) AS total_co2e_kg, {R(Q("km", "n"), 1)} AS avg_trip_distance_km, modes AS transport_modes_used,
  rank() OVER (ORDER BY kg DESC) AS co2e_rank, {R("percent_rank() OVER (ORDER BY kg) * 100", 1)} AS co2e_percentile
FROM per {tail}""", more(f"""per AS (
  SELECT user_id, user_name, department, COUNT(*) AS n, {SUM_KM} AS km, {SUM_CO2E} AS kg,
    array_to_string(list_sort(list_distinct(list(mode))), ', ') AS modes
  FROM travelled WHERE {condition} GROUP BY 1, 2, 3)""")


FIRST_TWENTY = "ORDER BY total_co2e_kg DESC, user_id LIMIT 20"
for _name in ("user_transport_patterns", "user_transport_patterns_partitioned"):
    sql(_name, *patterns(f"role = 'user' AND {recent(3)}"))
sql("user_transport_patterns_range", *patterns(f"date {QUARTER}", FIRST_TWENTY))
sql("user_transport_patterns_department", *patterns(f"date {YEAR} AND department = 'MACHINERY'", FIRST_TWENTY))
sql("user_recent_trip_stats", f"""
SELECT user_id, department, COUNT(trip_id) AS total_trips, {D(SUM_KM)} AS total_distance_km, {D(SUM_CO2E)} AS total_co2e_kg
FROM {with_trips("TRUE")} WHERE role = 'user' AND (date IS NULL OR {recent(3)}) GROUP BY 1, 2""")
sql("department_summary", f"""
SELECT department, COUNT(DISTINCT user_id) AS user_count, COUNT(*) AS total_trips, {D(SUM_KM)} AS total_distance_km,
  {D(SUM_CO2E)} AS total_co2e_kg, {MEAN_CO2E} AS avg_co2e_per_user,
  {Q(SUM_CO2E, "COUNT(DISTINCT user_id)")} AS avg_co2e_per_distinct_user
FROM travelled WHERE date {QUARTER} GROUP BY department""")
sql("user_activity_summary", f"""
SELECT COUNT(DISTINCT user_id) AS total_users, COUNT(DISTINCT CASE WHEN trip_id IS NOT NULL THEN user_id END) AS active_users,
  COUNT(trip_id) AS total_trips, {D(SUM_CO2E)} AS total_transport_co2e
FROM {with_trips(f"date {MONTH}")} WHERE role = 'user'""")
for _name, _months in (("personal_footprint", 3), ("personal_footprint_year", 12)):
    sql(_name, f"""
SELECT user_id, COUNT(trip_id) AS total_trips, {zero(SUM_KM)} AS total_distance_km, {zero(SUM_CO2E)} AS total_co2e_kg,
  COALESCE({MEAN_KM}, 0) AS avg_trip_distance FROM {with_trips(recent(_months))} GROUP BY user_id""")
sql("user_vs_campus_average", f"""
SELECT u.user_id, {D("COALESCE(total, 0)")} AS user_co2e, COALESCE(a, 0) AS campus_avg_co2e,
  {R("CAST(COALESCE(total, 0) AS DOUBLE) / NULLIF(a, 0) * 100 - 100", 1)} AS percentage_vs_average
FROM users u LEFT JOIN per ON u.user_id = per.user_id, (SELECT {Q("SUM(total)", "COUNT(total)")} AS a FROM per WHERE role = 'user') c""", more(f"""per AS (
  SELECT user_id, role, {SUM_CO2E} AS total FROM travelled WHERE {recent(3)} GROUP BY user_id, role)"""))
sql("personal_monthly_trend", f"""
SELECT user_id, {month("date")} AS month, {D(SUM_CO2E)} AS monthly_co2e, COUNT(*) AS monthly_trips
FROM trips WHERE {recent(6)} GROUP BY 1, 2""")
sql("personal_mode_breakdown", f"""
SELECT user_id, mode, COUNT(*) AS trip_count, {D(SUM_KM)} AS total_distance, {D(SUM_CO2E)} AS total_co2e,
  {MEAN_KM} AS avg_distance FROM trips WHERE {recent(3)} GROUP BY user_id, mode""")
sql("personal_weekly_trend", f"""
SELECT user_id, CAST(date_trunc('week', date) AS TIMESTAMP) AS week, COUNT(*) AS weekly_trips,
  {D(SUM_KM)} AS weekly_distance, {D(SUM_CO2E)} AS weekly_co2e FROM trips WHERE {recent(3)} GROUP BY 1, 2""")
TRIP = f"""trip_id, date, mode, {D("distance_km")} AS distance_km, {D("co2e_emitted")} AS co2e_emitted, created_at"""
NEWEST_TRIP = "ORDER BY date DESC, created_at DESC, trip_id DESC"
sql("trip_listing", f"""
SELECT user_id, {TRIP} FROM trips QUALIFY row_number() OVER (PARTITION BY user_id {NEWEST_TRIP}) <= 5""")


def all_trips(condition: str, low: int) -> str:
    return f"""
SELECT {TRIP}, user_name, email, department FROM travelled WHERE {condition}
QUALIFY row_number() OVER ({NEWEST_TRIP}) BETWEEN {low} AND {low + 49}"""


sql("trip_listing_admin", all_trips("TRUE", 51))
sql("trip_listing_admin_deep", all_trips("TRUE", 10501))
sql("trip_listing_filtered", all_trips(f"mode = 'train' AND department = 'BUILDING' AND date {YEAR}", 1))
sql("trip_listing_after", all_trips("(date, created_at, trip_id) < (DATE '2001-06-01', TIMESTAMP '2001-06-01', 0)", 1))
sql("own_trips", f"SELECT user_id, {TRIP} FROM trips WHERE user_id = 1")
sql("trip_listing_info", info("travelled", 2, 50))
sql("trip_listing_info_user", info("travelled WHERE user_id = 1", 1, 5))
sql("building_listing_info", info("buildings", 2, 5))
sql("user_directory", """
SELECT user_id, email, role, first_name, last_name, department, created_at, updated_at FROM users""")

# --- initiatives ----------------------------------------------------------------------------
TARGET, ACTUAL = "target_reduction_tco2e", "actual_reduction_tco2e"
SHARE = f"{Q(ACTUAL, TARGET)} * 100"
SUM_TARGET, SUM_ACTUAL = f"SUM({TARGET})", f"SUM({ACTUAL})"


def rate(actual: str, target: str) -> str:
    return f"COALESCE({R(f'CASE WHEN {target} > 0 THEN {Q(actual, target)} * 100 END', 1)}, 0)"


def count_of(status: str) -> str:
    return f"COUNT(*) FILTER (WHERE status = '{status}')"


CREATED = """initiatives LEFT JOIN (SELECT user_id AS created_by, email, concat(first_name, ' ', last_name) AS created_by_name
  FROM users) c USING (created_by)"""
sql("initiative_effectiveness", f"""
SELECT initiative_id, name AS initiative_name, status, {D(TARGET)} AS target_reduction_tco2e,
  {D(ACTUAL)} AS actual_reduction_tco2e, share AS achievement_percentage,
  date_diff('day', start_date, end_date) AS planned_duration_days,
  CASE WHEN status = 'active' OR (status = 'completed' AND end_date IS NOT NULL)
    THEN date_diff('day', start_date, {TODAY}) END AS actual_duration_days,
  created_by_name, created_at, start_date, end_date,
  COALESCE((SELECT label FROM (VALUES (100, 'Excellent'), (75, 'Good'), (50, 'Fair')) v(low, label)
    WHERE share >= low ORDER BY low DESC LIMIT 1), 'Needs Improvement') AS effectiveness_rating
FROM (SELECT *, {R(SHARE, 1)} AS share FROM {CREATED}) x""")
sql("initiative_effectiveness_summary", f"""
SELECT COUNT(*) AS total_initiatives, {count_of("completed")} AS completed_count, {count_of("active")} AS active_count,
  {zero(SUM_TARGET)} AS total_target, {zero(SUM_ACTUAL)} AS total_actual,
  {R(f"COALESCE(AVG({SHARE}) FILTER (WHERE {TARGET} > 0), 0)", 1)} AS avg_achievement_rate
FROM initiatives WHERE status IN ('active', 'completed')""")
SUMS = f"{zero(SUM_TARGET)} AS total_target_reduction, {zero(SUM_ACTUAL)} AS total_actual_reduction"
sql("initiative_progress", f"""
SELECT COUNT(*) AS total_initiatives, {count_of("active")} AS active_initiatives,
  {count_of("completed")} AS completed_initiatives, {SUMS}, {rate(SUM_ACTUAL, SUM_TARGET)} AS achievement_rate
FROM initiatives""")
sql("initiative_overview", f"""
SELECT COUNT(*) AS total_initiatives, {count_of("active")} AS active_initiatives,
  {count_of("completed")} AS completed_initiatives, {count_of("planned")} AS planned_initiatives, {SUMS},
  COALESCE({Q(SUM_TARGET, f"COUNT({TARGET})")}, 0) AS avg_target_reduction,
  COALESCE({Q(SUM_ACTUAL, f"COUNT({ACTUAL})")}, 0) AS avg_actual_reduction,
  {rate(SUM_ACTUAL, SUM_TARGET)} AS overall_achievement_rate
FROM initiatives""")
sql("initiative_status_breakdown", f"""
SELECT status, COUNT(*) AS initiative_count, {zero(SUM_TARGET)} AS total_target, {zero(SUM_ACTUAL)} AS total_actual,
  COALESCE({Q(SUM_TARGET, f"COUNT({TARGET})")}, 0) AS avg_target, COALESCE({Q(SUM_ACTUAL, f"COUNT({ACTUAL})")}, 0) AS avg_actual,
  {rate(SUM_ACTUAL, SUM_TARGET)} AS achievement_rate
FROM initiatives GROUP BY status""")
sql("top_initiatives", f"""
SELECT initiative_id, name, {D(TARGET)} AS target_reduction_tco2e, {D(ACTUAL)} AS actual_reduction_tco2e, status,
  {R(SHARE, 1)} AS achievement_rate
FROM initiatives x WHERE x.{TARGET} > 0 AND status IN ('active', 'completed')
QUALIFY row_number() OVER (ORDER BY {Q("x." + ACTUAL, "x." + TARGET)} DESC, initiative_id) <= 5""")
sql("active_initiatives_top", f"""
SELECT initiative_id, name, description, {D(TARGET)} AS target_reduction_tco2e, {D(ACTUAL)} AS actual_reduction_tco2e, status,
  start_date, end_date
FROM initiatives x WHERE status = 'active'
QUALIFY row_number() OVER (ORDER BY x.{TARGET} DESC NULLS FIRST, initiative_id) <= 5""")


def initiative_page(email: str, condition: str, tail: str) -> str:
    return f"""
SELECT initiative_id, name, description, {zero(TARGET)} AS target_reduction_tco2e, {zero(ACTUAL)} AS actual_reduction_tco2e,
  {rate(ACTUAL, TARGET)} AS achievement_rate, status, start_date, end_date, created_at, updated_at, created_by_name,
  {email} AS created_by_email
FROM {CREATED} WHERE {condition} {tail}"""


sql("initiative_listing", initiative_page("email", "TRUE", """
QUALIFY row_number() OVER (ORDER BY COALESCE(list_position(['active', 'planned', 'completed'], status), 4),
  created_at DESC, initiative_id) BETWEEN 21 AND 40"""))
sql("initiative_listing_public", initiative_page("CAST(NULL AS VARCHAR)", "status = 'active'", ""))
sql("initiative_listing_info", info("initiatives WHERE status = 'completed'", 1, 20))

# --- one day --------------------------------------------------------------------------------
PER_DAY = more(f"""per_day AS (
  SELECT CAST(date_time AS DATE) AS d, 'energy' AS fact, {SUM_CO2E} AS kg, COUNT(DISTINCT building_id) AS active FROM energy GROUP BY 1
  UNION ALL SELECT date, 'trips', {SUM_CO2E}, COUNT(DISTINCT user_id) FROM trips GROUP BY 1)""")


def kg_on(days_back: int, fact: str | None = None) -> str:
    which = f" AND fact = '{fact}'" if fact else ""
    return f"COALESCE(SUM(kg) FILTER (WHERE d = {TODAY} - {days_back}{which}), 0)"


def mean_day(condition: str) -> str:
    keep = f"FILTER (WHERE fact = 'energy' AND d >= {TODAY} - 30{condition})"
    return f"(CAST(SUM(kg) {keep} AS DOUBLE) / COUNT(kg) {keep})"


def change(base: str) -> str:
    return R(f"(CAST(e + t AS DOUBLE) - CAST({base} AS DOUBLE)) / NULLIF(CAST({base} AS DOUBLE), 0) * 100", 1)


def figures(mean: str) -> str:
    return f"""(SELECT {kg_on(0, "energy")} AS e, {kg_on(0, "trips")} AS t, {kg_on(1)} AS y, {mean} AS m,
  COALESCE(MAX(active) FILTER (WHERE d = {TODAY} AND fact = 'energy'), 0) AS active_buildings,
  COALESCE(MAX(active) FILTER (WHERE d = {TODAY} AND fact = 'trips'), 0) AS active_users FROM per_day) f"""


sql("daily_dashboard", f"""
SELECT {TODAY} AS report_date, {R("e", 2)} AS today_energy_co2e_kg, {R("t", 2)} AS today_transport_co2e_kg,
  {R("e + t", 2)} AS today_total_co2e_kg, {R("y", 2)} AS yesterday_total_co2e_kg, {R("m", 2)} AS monthly_avg_co2e_kg,
  {change("y")} AS day_over_day_change_percent, {change("m")} AS vs_monthly_avg_percent
FROM {figures(mean_day(""))}""", PER_DAY)
sql("daily_summary", f"""
SELECT {TODAY} AS report_date, {R("e + t", 2)} AS total_co2e_kg, {R("e", 2)} AS energy_co2e_kg, {R("t", 2)} AS transport_co2e_kg,
  {R("y", 2)} AS previous_day_total, {R("COALESCE(m, 0)", 2)} AS monthly_average, {change("y")} AS day_over_day_change,
  {change("m")} AS vs_monthly_average, active_buildings, active_users
FROM {figures(mean_day(f" AND d < {TODAY}"))}""", PER_DAY)
sql("realtime_snapshot", f"""
SELECT {TODAY} AS report_date, {D("e")} AS energy_co2e, {D("t")} AS transport_co2e, {D("e + t")} AS total_co2e,
  {D("y")} AS yesterday_total, {change("y")} AS change_percent FROM {figures("NULL")}""", PER_DAY)
