"""SQL for the quality, maintenance, synthetic-data and streaming jobs."""

from __future__ import annotations

from checks import submissions as given
from checks.oracle import MONTH, SQL, TODAY, D, more, sql

LOADED = "TIMESTAMP '2001-07-01 12:00:00'"


def batch(name: str, source) -> str:
    return f"{name} AS ({given.as_sql(source)})"


def errors(*rules: tuple[str, str]) -> str:
    """Messages of broken rules; a rule that is NULL is broken."""
    parts = ", ".join(f"CASE WHEN NOT COALESCE({holds}, FALSE) THEN '{text}' END" for text, holds in rules)
    return f"concat_ws('; ', {parts})"


def iso(column: str) -> str:
    return f"TRY_CAST({column} AS TIMESTAMP) IS NOT NULL"


def number(column: str, bounds: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE) {bounds}"


# --- row quality ----------------------------------------------------------------------------
TRIP_ERRORS = errors(
    ("date must be an ISO date", iso("date")),
    ("mode is unknown", "mode IN ('car','bus','bike','walk','air','train','metro')"),
    ("distance_km must be 0 to 10000", number("distance_km", "BETWEEN 0 AND 10000")),
)
TRIPS_CHECKED = more(batch("raw", given.TRIPS_SUBMITTED), f"""checked AS (
  SELECT trip_id, user_id, CAST(TRY_CAST(date AS TIMESTAMP) AS DATE) AS date, mode,
    TRY_CAST(distance_km AS DECIMAL(8,2)) AS distance_km, {TRIP_ERRORS} AS errors FROM raw)""")
sql("validate_trips", f"SELECT trip_id, date, {D('distance_km')} AS distance_km, errors FROM checked", TRIPS_CHECKED)

READING_ERRORS = errors(
    ("building_id is malformed", "building_id >= 0"),
    ("date_time must be an ISO time", iso("date_time")),
    ("source is unknown", "source IN ('electricity','gas','fuel','steam')"),
    ("consumption_kwh must be 0 to 1000000", number("consumption_kwh", "BETWEEN 0 AND 1000000")),
)
READINGS_CHECKED = more(batch("raw", given.READINGS_SUBMITTED), f"""checked AS (
  SELECT record_id, building_id, TRY_CAST(date_time AS TIMESTAMP) AS date_time, source,
    TRY_CAST(consumption_kwh AS DECIMAL(10,2)) AS consumption_kwh, {READING_ERRORS} AS errors FROM raw)""")
sql("validate_readings",
    f"SELECT record_id, date_time, {D('consumption_kwh')} AS consumption_kwh, errors FROM checked", READINGS_CHECKED)

INITIATIVE_ERRORS = errors(
    ("name must have 3 to 200 characters", "length(name) BETWEEN 3 AND 200"),
    ("description must have at most 1000 characters", "(description IS NULL OR length(trim(description)) <= 1000)"),
    ("target_reduction_tco2e must not be negative",
     f"(target_reduction_tco2e IS NULL OR {number('target_reduction_tco2e', '>= 0')})"),
    ("status is unknown", "(status IS NULL OR status IN ('planned','active','completed','cancelled'))"),
    ("start_date must be an ISO date", f"(start_date IS NULL OR {iso('start_date')})"),
    ("end_date must be an ISO date", f"(end_date IS NULL OR {iso('end_date')})"),
    ("end_date must not be before start_date",
     "COALESCE(CAST(TRY_CAST(end_date AS TIMESTAMP) AS DATE) >= CAST(TRY_CAST(start_date AS TIMESTAMP) AS DATE), TRUE)"),
)
INITIATIVES_CHECKED = more(batch("submitted", given.INITIATIVES_SUBMITTED),
                           "raw AS (SELECT * REPLACE (trim(name) AS name) FROM submitted)", f"""checked AS (
  SELECT initiative_id, name, description, TRY_CAST(target_reduction_tco2e AS DECIMAL(10,2)) AS target_reduction_tco2e,
    status, CAST(TRY_CAST(start_date AS TIMESTAMP) AS DATE) AS start_date,
    CAST(TRY_CAST(end_date AS TIMESTAMP) AS DATE) AS end_date, created_by, {INITIATIVE_ERRORS} AS errors FROM raw)""")
sql("validate_initiatives", f"""
SELECT initiative_id, name, {D("target_reduction_tco2e")} AS target_reduction_tco2e, start_date, end_date, errors
FROM checked""", INITIATIVES_CHECKED)

USER_ERRORS = errors(
    ("email", "email LIKE '%_@_%._%'"),
    ("first_name must have 2 to 50 characters", "length(first_name) BETWEEN 2 AND 50"),
    ("last_name must have 2 to 50 characters", "length(last_name) BETWEEN 2 AND 50"),
    ("department must have at most 100 characters", "(department IS NULL OR length(department) <= 100)"),
)
USERS_CHECKED = more(batch("submitted", given.USERS_SUBMITTED), """raw AS (
  SELECT * REPLACE (lower(trim(email)) AS email, trim(first_name) AS first_name) FROM submitted)""",
                     f"checked AS (SELECT *, {USER_ERRORS} AS errors FROM raw)")
sql("validate_users", "SELECT user_id, email, first_name, errors FROM checked", USERS_CHECKED)

BUILDING_ERRORS = errors(
    ("name must have 2 to 100 characters", "length(name) BETWEEN 2 AND 100"),
    ("sq_footage must be a whole number from 1 to 10000000",
     "sq_footage NOT LIKE '%.%' AND TRY_CAST(sq_footage AS BIGINT) BETWEEN 1 AND 10000000"),
    ("primary_use must have 2 to 50 characters", "length(primary_use) BETWEEN 2 AND 50"),
    ("location_gps must be POINT(x y)", "(location_gps IS NULL OR location_gps LIKE 'POINT(% %)')"),
)
BUILDINGS_CHECKED = more(batch("submitted", given.BUILDINGS_SUBMITTED),
                         "raw AS (SELECT * REPLACE (trim(name) AS name) FROM submitted)",
                         f"checked AS (SELECT *, {BUILDING_ERRORS} AS errors FROM raw)")
sql("validate_buildings", """
SELECT building_id, name, CASE WHEN sq_footage NOT LIKE '%.%' THEN TRY_CAST(sq_footage AS INT) END AS sq_footage,
  CASE WHEN location_gps LIKE 'POINT(% %)' THEN CAST(split_part(substr(location_gps, 7), ' ', 1) AS DOUBLE) END AS x,
  CASE WHEN location_gps LIKE 'POINT(% %)' THEN CAST(rtrim(split_part(location_gps, ' ', 2), ')') AS DOUBLE) END AS y,
  errors FROM checked""", BUILDINGS_CHECKED)

PROGRESS_ERRORS = errors(
    ("actual_reduction_tco2e must be a non-negative number",
     f"(actual_reduction_tco2e IS NULL OR {number('actual_reduction_tco2e', '>= 0')})"),
    ("status is unknown", "(status IS NULL OR status IN ('planned','active','completed','cancelled'))"),
    ("nothing to change", "(actual_reduction_tco2e IS NOT NULL OR status IS NOT NULL)"),
)
PROGRESS_CHECKED = more(batch("raw", given.PROGRESS_SUBMITTED), f"""checked AS (
  SELECT initiative_id, TRY_CAST(actual_reduction_tco2e AS DECIMAL(10,2)) AS actual_reduction_tco2e, status,
    {PROGRESS_ERRORS} AS errors FROM raw)""")
sql("validate_progress",
    f"SELECT initiative_id, {D('actual_reduction_tco2e')} AS actual_reduction_tco2e, errors FROM checked",
    PROGRESS_CHECKED)

# --- constraints ----------------------------------------------------------------------------
_REQUIRED = {
    "buildings": ("buildings", "building_id name sq_footage primary_use"),
    "users": ("users", "user_id email role first_name last_name"),
    "energy_consumption": ("energy", "record_id building_id date_time source consumption_kwh"),
    "transportation_log": ("trips", "trip_id user_id date mode distance_km"),
    "initiatives": ("initiatives", "initiative_id name status"),
}
_VALUE = {
    "buildings": {"sq_footage > 0": "sq_footage > 0"},
    "users": {"role in set": "role IN ('admin','user','guest')"},
    "energy_consumption": {"source in set": "source IN ('electricity','gas','fuel','steam')",
                           "consumption_kwh >= 0": "consumption_kwh >= 0"},
    "transportation_log": {"mode in set": "mode IN ('car','bus','bike','walk','air','train','metro')",
                           "distance_km >= 0": "distance_km >= 0"},
    "initiatives": {"target_reduction_tco2e >= 0": "target_reduction_tco2e >= 0",
                    "actual_reduction_tco2e >= 0": "actual_reduction_tco2e >= 0",
                    "status in set": "status IN ('planned','active','completed','cancelled')",
                    "end_date >= start_date": "end_date >= start_date"},
}
_UNIQUE = {"buildings": "building_id name", "users": "user_id email", "energy_consumption": "record_id",
           "transportation_log": "trip_id", "initiatives": "initiative_id"}
_PARENT = {"energy_consumption": ("building_id", "buildings", "building_id"),
           "transportation_log": ("user_id", "users", "user_id"), "initiatives": ("created_by", "users", "user_id")}


def violations() -> str:
    rows = []
    for table, (source, columns) in _REQUIRED.items():
        counts = {f"{c} not null": f"SELECT count(*) FROM {source} WHERE {c} IS NULL" for c in columns.split()}
        counts |= {r: f"SELECT count(*) FROM {source} WHERE NOT ({holds})" for r, holds in _VALUE[table].items()}
        counts |= {f"{c} unique": f"SELECT count({c}) - count(DISTINCT {c}) FROM {source}" for c in _UNIQUE[table].split()}
        if table in _PARENT:
            child, parent, key = _PARENT[table]
            counts[f"{child} references {parent}"] = (
                f"SELECT count(*) FROM {source} c WHERE {child} IS NOT NULL"
                f" AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{child})")
        rows += [f"SELECT '{table}' AS table_name, '{rule}' AS rule, ({q}) AS violations" for rule, q in counts.items()]
    return " UNION ALL ".join(rows)


sql("table_violations", violations())
sql("duplicate_record_ids", "SELECT record_id, count(*) AS rows FROM energy GROUP BY record_id HAVING count(*) > 1")
sql("orphan_live_readings", """
SELECT building_id, count(*) AS rows FROM live WHERE building_id NOT IN (SELECT building_id FROM buildings) GROUP BY 1""")
sql("energy_with_factor_table", f"""
SELECT source, {D('''SUM(CAST(CASE source WHEN 'electricity' THEN consumption_kwh * CAST(0.0005 AS DECIMAL(4,4))
  WHEN 'steam' THEN consumption_kwh * CAST(0.0002 AS DECIMAL(4,4)) ELSE 0 END AS DECIMAL(10,4)))''')} AS total_co2e
FROM energy GROUP BY source""")

# --- appends --------------------------------------------------------------------------------
CO2E = """CAST(CASE source WHEN 'electricity' THEN consumption_kwh * CAST(0.0004 AS DECIMAL(4,4))
  WHEN 'gas' THEN consumption_kwh * CAST(0.0002 AS DECIMAL(4,4)) WHEN 'fuel' THEN consumption_kwh * CAST(0.0003 AS DECIMAL(4,4))
  WHEN 'steam' THEN consumption_kwh * CAST(0.0001 AS DECIMAL(4,4)) ELSE 0 END AS DECIMAL(10,4))"""
TRIP_CO2E = """CAST(CASE mode WHEN 'car' THEN distance_km * CAST(0.21 AS DECIMAL(2,2))
  WHEN 'bus' THEN distance_km * CAST(0.08 AS DECIMAL(2,2)) WHEN 'air' THEN distance_km * CAST(0.25 AS DECIMAL(2,2))
  WHEN 'train' THEN distance_km * CAST(0.04 AS DECIMAL(2,2)) WHEN 'metro' THEN distance_km * CAST(0.03 AS DECIMAL(2,2))
  WHEN 'bike' THEN 0 WHEN 'walk' THEN 0 ELSE distance_km * CAST(0.15 AS DECIMAL(2,2)) END AS DECIMAL(8,4))"""
READING = f"record_id, building_id, date_time, source, {D('consumption_kwh')} AS consumption_kwh"
TRIP = f"trip_id, user_id, date, mode, {D('distance_km')} AS distance_km"
# A key is unique: an insert of a known one is refused, and of several rows with one key only one goes in.
FIT_READINGS = """(SELECT *, record_id IN (SELECT record_id FROM energy) AS known, row_number() OVER (PARTITION BY record_id
    ORDER BY building_id DESC, date_time DESC, source DESC, consumption_kwh DESC) AS place FROM checked
  WHERE errors = '' AND building_id IN (SELECT building_id FROM buildings)) fit"""
NEW_READINGS = f"""SELECT {READING}, {LOADED} AS created_at, {D(CO2E)} AS co2e_emitted FROM {FIT_READINGS} WHERE place = 1 AND NOT known"""
REFUSED_READINGS = f"""SELECT record_id, 'unknown building_id' AS reason FROM checked
WHERE errors = '' AND building_id NOT IN (SELECT building_id FROM buildings)
UNION ALL SELECT record_id, 'record_id exists' FROM {FIT_READINGS} WHERE place = 1 AND known
UNION ALL SELECT record_id, 'record_id repeated in the batch' FROM {FIT_READINGS} WHERE place = 2"""
sql("append_readings", f"""SELECT {READING}, created_at, {D("co2e_emitted")} AS co2e_emitted FROM energy
UNION ALL {NEW_READINGS}""", READINGS_CHECKED)
sql("append_readings_refused", REFUSED_READINGS, READINGS_CHECKED)
sql("append_trips", f"""SELECT {TRIP}, created_at, {D("co2e_emitted")} AS co2e_emitted FROM trips
UNION ALL SELECT {TRIP}, {LOADED}, {D(TRIP_CO2E)} FROM checked
WHERE errors = '' AND user_id IN (SELECT user_id FROM users) AND trip_id NOT IN (SELECT trip_id FROM trips)""", TRIPS_CHECKED)
sql("append_trips_refused", """SELECT trip_id, CASE WHEN user_id NOT IN (SELECT user_id FROM users) THEN 'unknown user_id'
  ELSE 'trip_id exists' END AS reason FROM checked
WHERE errors = '' AND (user_id NOT IN (SELECT user_id FROM users) OR trip_id IN (SELECT trip_id FROM trips))""", TRIPS_CHECKED)

BUILDING_VERDICT = """verdict AS (SELECT *, building_id = min(building_id) OVER (PARTITION BY name) AS first,
  name IN (SELECT name FROM buildings) AS known FROM checked WHERE errors = '')"""
sql("append_buildings_unique", f"""
SELECT building_id, name, sq_footage, CAST(NULL AS TIMESTAMP) AS created_at FROM buildings
UNION ALL SELECT building_id, name, CAST(sq_footage AS INT), {LOADED} FROM verdict WHERE first AND NOT known
""", BUILDINGS_CHECKED + more(BUILDING_VERDICT))
sql("append_buildings_refused", """SELECT building_id,
  CASE WHEN first THEN 'name exists' ELSE 'name repeated in the batch' END AS reason
FROM verdict WHERE NOT (first AND NOT known)""", BUILDINGS_CHECKED + more(BUILDING_VERDICT))
USER_VERDICT = """verdict AS (SELECT *, user_id = min(user_id) OVER (PARTITION BY email) AS first,
  email IN (SELECT email FROM users) AS known FROM checked WHERE errors = '')"""
sql("append_users_unique", f"""
SELECT user_id, email, role, first_name, CAST(NULL AS TIMESTAMP) AS created_at FROM users
UNION ALL SELECT user_id, email, 'user', first_name, {LOADED} FROM verdict WHERE first AND NOT known
""", USERS_CHECKED + more(USER_VERDICT))
sql("append_users_refused", """SELECT user_id,
  CASE WHEN first THEN 'email exists' ELSE 'email repeated in the batch' END AS reason
FROM verdict WHERE NOT (first AND NOT known)""", USERS_CHECKED + more(USER_VERDICT))
INITIATIVE = f"""initiative_id, name, {D("target_reduction_tco2e")} AS target_reduction_tco2e,
  {D("actual_reduction_tco2e")} AS actual_reduction_tco2e, status, start_date, end_date, created_by, created_at, updated_at"""
sql("append_initiatives", f"""SELECT {INITIATIVE} FROM initiatives
UNION ALL SELECT initiative_id, name, {D("target_reduction_tco2e")}, 0,
  CASE WHEN u.role = 'admin' THEN COALESCE(status, 'planned') ELSE 'planned' END, start_date, end_date, created_by,
  {LOADED}, {LOADED}
FROM checked c JOIN users u ON u.user_id = c.created_by WHERE errors = ''""", INITIATIVES_CHECKED)

# --- updates --------------------------------------------------------------------------------
READING_LATEST = more(batch("sent", given.READING_UPDATES), """latest AS (SELECT * FROM sent QUALIFY row_number()
  OVER (PARTITION BY record_id ORDER BY updated_at DESC, building_id DESC, date_time DESC, source DESC, consumption_kwh DESC) = 1)""")
sql("upsert_readings", f"""SELECT {READING}, created_at, {D(CO2E)} AS co2e_emitted FROM (
  SELECT v.record_id, CASE WHEN n.record_id IS NULL THEN v.building_id ELSE n.building_id END AS building_id,
    CASE WHEN n.record_id IS NULL THEN v.date_time ELSE n.date_time END AS date_time,
    CASE WHEN n.record_id IS NULL THEN v.source ELSE n.source END AS source,
    CASE WHEN n.record_id IS NULL THEN v.consumption_kwh ELSE n.consumption_kwh END AS consumption_kwh,
    v.date_time AS created_at
  FROM live v LEFT JOIN latest n ON n.record_id = v.record_id) x""", READING_LATEST)
# Only updates that keep every rule and name a building count; of those of a key the newest.
CORRECTED = more(batch("sent", given.READING_CORRECTIONS), """judged AS (SELECT *, concat_ws('; ',
    CASE WHEN date_time IS NULL THEN 'date_time must be an ISO time' END,
    CASE WHEN source IS NULL OR source NOT IN ('electricity', 'gas', 'fuel', 'steam') THEN 'source is unknown' END,
    CASE WHEN consumption_kwh NOT BETWEEN 0 AND 1000000 THEN 'consumption_kwh must be 0 to 1000000' END) AS broken,
    building_id IN (SELECT building_id FROM buildings) AS known FROM sent)""", """latest AS (SELECT * FROM judged WHERE broken = '' AND known
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC, building_id DESC, date_time DESC, source DESC, consumption_kwh DESC) = 1)""")
sql("correct_readings", f"""SELECT {READING}, created_at, {D(CO2E)} AS co2e_emitted FROM (
  SELECT v.record_id, COALESCE(n.building_id, v.building_id) AS building_id, COALESCE(n.date_time, v.date_time) AS date_time,
    COALESCE(n.source, v.source) AS source, CASE WHEN n.record_id IS NULL THEN v.consumption_kwh ELSE n.consumption_kwh END AS consumption_kwh,
    v.date_time AS created_at
  FROM live v LEFT JOIN latest n ON n.record_id = v.record_id) x""", CORRECTED)
sql("correct_readings_refused", """SELECT record_id, broken AS reason FROM judged WHERE broken <> ''
UNION ALL SELECT record_id, 'unknown building_id' FROM judged WHERE broken = '' AND NOT known
UNION ALL SELECT record_id, 'not found' FROM latest WHERE record_id NOT IN (SELECT record_id FROM live)""", CORRECTED)
TRIP_SENT = more(batch("sent", given.TRIP_UPDATES))
sql("upsert_trips", f"""SELECT {TRIP}, created_at, {D(TRIP_CO2E)} AS co2e_emitted FROM (
  SELECT t.trip_id, t.user_id, COALESCE(n.date, t.date) AS date, COALESCE(n.mode, t.mode) AS mode,
    COALESCE(n.distance_km, t.distance_km) AS distance_km, t.created_at
  FROM trips t LEFT JOIN sent n ON n.trip_id = t.trip_id AND n.user_id = t.user_id) x""", TRIP_SENT)
sql("upsert_trips_refused", """
SELECT n.trip_id, CASE WHEN t.trip_id IS NULL THEN 'not found' ELSE 'not the owner' END AS reason
FROM sent n LEFT JOIN trips t ON t.trip_id = n.trip_id WHERE t.user_id IS NULL OR t.user_id <> n.user_id""", TRIP_SENT)
RENAMES = more(batch("sent", given.BUILDING_UPDATES), """asked AS (SELECT n.*, b.name AS old FROM sent n
  JOIN buildings b ON b.building_id = n.building_id)""", """judged AS (SELECT *, row_number() OVER (PARTITION BY name
  ORDER BY CASE WHEN old = name THEN 0 ELSE 1 END, building_id) = 1
  AND (old = name OR name NOT IN (SELECT name FROM buildings)) AS granted FROM asked)""")
sql("upsert_buildings", f"""SELECT b.building_id, COALESCE(j.name, b.name) AS name,
  COALESCE(j.sq_footage, b.sq_footage) AS sq_footage, COALESCE(j.primary_use, b.primary_use) AS primary_use,
  CAST(NULL AS TIMESTAMP) AS created_at, CASE WHEN j.name IS NOT NULL THEN {LOADED} END AS updated_at
FROM buildings b LEFT JOIN judged j ON j.building_id = b.building_id AND j.granted""", RENAMES)
sql("upsert_buildings_refused", "SELECT building_id, 'name exists' AS reason FROM judged WHERE NOT granted", RENAMES)
sql("upsert_initiatives", f"""
SELECT i.initiative_id, COALESCE(n.name, i.name) AS name, COALESCE(n.description, i.description) AS description,
  {D("CASE WHEN n.name IS NULL THEN i.target_reduction_tco2e ELSE n.target_reduction_tco2e END")} AS target_reduction_tco2e,
  {D("CASE WHEN n.name IS NULL THEN i.actual_reduction_tco2e ELSE COALESCE(n.actual_reduction_tco2e, 0) END")}
    AS actual_reduction_tco2e,
  COALESCE(n.status, i.status) AS status, COALESCE(n.start_date, i.start_date) AS start_date,
  CASE WHEN n.name IS NULL THEN i.end_date END AS end_date, i.created_by, i.created_at,
  CASE WHEN n.name IS NOT NULL THEN {LOADED} END AS updated_at
FROM initiatives i LEFT JOIN sent n ON n.initiative_id = i.initiative_id""", more(batch("sent", given.INITIATIVE_UPDATES)))
sql("upsert_users", f"""
SELECT u.user_id, u.email, u.role, COALESCE(n.first_name, u.first_name) AS first_name,
  COALESCE(n.last_name, u.last_name) AS last_name, CASE WHEN n.user_id IS NULL THEN u.department END AS department,
  u.created_at, CASE WHEN n.user_id IS NOT NULL THEN {LOADED} END AS updated_at
FROM users u LEFT JOIN sent n ON n.user_id = u.user_id""", more(batch("sent", given.USER_UPDATES)))
sql("patch_initiative_progress", f"""
SELECT i.initiative_id, i.name, i.description, {D("i.target_reduction_tco2e")} AS target_reduction_tco2e,
  {D("COALESCE(n.actual_reduction_tco2e, i.actual_reduction_tco2e)")} AS actual_reduction_tco2e,
  COALESCE(n.status, i.status) AS status, i.start_date, i.end_date, i.created_by, i.created_at,
  CASE WHEN n.initiative_id IS NOT NULL THEN {LOADED} END AS updated_at
FROM initiatives i LEFT JOIN (SELECT * FROM checked WHERE errors = '') n ON n.initiative_id = i.initiative_id
""", PROGRESS_CHECKED)

# --- deletes --------------------------------------------------------------------------------
sql("delete_trips", f"""SELECT {TRIP}, created_at, {D("co2e_emitted")} AS co2e_emitted FROM trips
WHERE (trip_id, user_id) NOT IN (SELECT trip_id, user_id FROM sent)""", TRIP_SENT)
sql("delete_trips_refused", """SELECT DISTINCT trip_id, user_id, 'not found' AS reason FROM sent
WHERE (trip_id, user_id) NOT IN (SELECT trip_id, user_id FROM trips)""", TRIP_SENT)
LIVE = f"SELECT {READING}, {D(CO2E)} AS co2e_emitted, date_time AS created_at FROM live"
sql("delete_readings", f"{LIVE} WHERE record_id NOT IN (SELECT l_orderkey FROM lineitem)")
sql("delete_initiatives", f"SELECT {INITIATIVE}, description FROM initiatives WHERE status <> 'cancelled'")
BUSY = more("busy AS (SELECT DISTINCT building_id FROM energy)")
sql("delete_buildings_guarded", """SELECT building_id, name FROM buildings
WHERE building_id NOT IN (SELECT user_id FROM users) OR building_id IN (SELECT building_id FROM busy)""", BUSY)
sql("delete_buildings_guarded_live", """SELECT building_id, name FROM buildings
WHERE building_id NOT IN (SELECT user_id FROM users) OR building_id IN (SELECT building_id FROM live)""")
sql("delete_buildings_refused", """SELECT user_id AS building_id,
  CASE WHEN user_id IN (SELECT building_id FROM buildings) THEN 'has readings' ELSE 'not found' END AS reason FROM users
WHERE user_id NOT IN (SELECT building_id FROM buildings) OR user_id IN (SELECT building_id FROM busy)""", BUSY)
sql("delete_cascade_readings", f"""SELECT {READING}, created_at, {D("co2e_emitted")} AS co2e_emitted FROM energy
WHERE building_id NOT IN (SELECT building_id FROM buildings WHERE primary_use = 'Dining')""")
sql("delete_cascade_trips", f"""SELECT {TRIP}, created_at, {D("co2e_emitted")} AS co2e_emitted FROM trips
WHERE user_id NOT IN (SELECT user_id FROM users WHERE role = 'guest')""")
sql("delete_cascade_initiatives", """SELECT initiative_id, CASE WHEN created_by IN
  (SELECT user_id FROM users WHERE role = 'guest') THEN NULL ELSE created_by END AS created_by FROM initiatives""")

for _versioned, _same in (("updates", "upsert_readings"), ("deletes", "delete_readings"), ("appends", "append_readings")):
    SQL[f"versioned_{_versioned}"] = SQL[_same]

# --- the report from shared totals ----------------------------------------------------------
for _section, _same in (
    ("summary", "carbon_footprint_summary"), ("scopes", "scope_breakdown_range"), ("buildings", "building_breakdown_range"),
    ("monthly_trend", "monthly_trend_by_scope"), ("energy_sources", "energy_source_breakdown"),
    ("transport_modes", "transport_mode_breakdown"),
):
    SQL[f"footprint_{_section}"] = SQL[_same]

_ITEMS = (
    ("summary", "''", "total_co2e_kg"), ("scopes", "emission_scope", "total_co2e_kg"), ("buildings", "building_name", "total_co2e_kg"),
    ("monthly_trend", "month || ' ' || source", "monthly_co2e"), ("energy_sources", "source", "total_co2e_kg"),
    ("transport_modes", "mode", "total_co2e_kg"),
)
SQL["carbon_footprint_document"] = " UNION ALL ".join(
    f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, CAST({amount} AS DOUBLE) AS co2e FROM ({SQL['footprint_' + section]}) AS s_{section}"
    for section, item, amount in _ITEMS
)

# --- nested documents -----------------------------------------------------------------------
sql("reading_documents", f"""SELECT record_id AS id, date_time, name, primary_use, sq_footage
FROM metered""")
sql("trip_documents", f"""SELECT trip_id AS id, '{{"id":' || trip_id || ',"mode":"' || mode || '","date":"' || date
  || '","user":{{"name":"' || user_name || '","email":"' || email || '"'
  || COALESCE(',"department":"' || department || '"', '') || '}}}}' AS document
FROM travelled""")


# --- synthetic data -------------------------------------------------------------------------
def noise(draw: str, *keys: str, seed: int = 0) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}:{draw}', {text})), 1, 8) AS BIGINT) / 4294967296.0)"


def amount(base: str, spread: str, draw: str, kind: str) -> str:
    return f"CAST(CAST(CAST({base} AS DOUBLE) + {draw} * CAST({spread} AS DOUBLE) AS DECIMAL(28,8)) AS {kind})"


_KEYS = ("building_id", "day", "source")
_DAYS = "unnest(generate_series({TODAY} - INTERVAL '{n}', {TODAY}, INTERVAL '1 day'))"
sql("synth_readings_daily", f"""
SELECT building_id, date_time, source, {D("consumption_kwh")} AS consumption_kwh, {D(CO2E)} AS co2e_emitted FROM (
  SELECT building_id, CAST(day AS TIMESTAMP) + to_hours(CAST(8 + floor({noise("hour", *_KEYS)} * 12 + 0.5) AS INT)) AS date_time,
    source, {amount("base", "base / 2", noise("kwh", *_KEYS), "DECIMAL(10,2)")} AS consumption_kwh
  FROM (SELECT *, CAST(sq_footage AS DOUBLE) * CASE source WHEN 'electricity' THEN CAST(0.018 AS DOUBLE)
      ELSE CAST(0.0045 AS DOUBLE) END AS base FROM (
    SELECT building_id, sq_footage, CAST(unnest(generate_series({TODAY} - INTERVAL '6 months', {TODAY}, INTERVAL '1 day')) AS DATE) AS day
    FROM buildings) d, (VALUES ('electricity'), ('gas')) s(source)) r
  WHERE {noise("kept", *_KEYS)} > 0.1) x""")
sql("synth_readings_hourly", f"""
SELECT building_id, date_time, source, {D("consumption_kwh")} AS consumption_kwh, {D(CO2E)} AS co2e_emitted FROM (
  SELECT building_id, CAST({TODAY} AS TIMESTAMP) - to_hours(CAST(back AS INT)) AS date_time, 'electricity' AS source,
    {amount("CAST(sq_footage AS DOUBLE) * CAST(0.020 AS DOUBLE)", "CAST(sq_footage AS DOUBLE) * CAST(0.0045 AS DOUBLE)",
            noise("hourly", "building_id", "back"), "DECIMAL(10,2)")} AS consumption_kwh
  FROM buildings, generate_series(1, 168) g(back)) x""")
_TRIP_KEYS = ("user_id", "date", "mode")
sql("synth_trips", f"""
SELECT user_id, date, mode, {D("distance_km")} AS distance_km, {D(TRIP_CO2E)} AS co2e_emitted FROM (
  SELECT user_id, date, mode, {amount("base", "spread", noise("km", *_TRIP_KEYS), "DECIMAL(8,2)")} AS distance_km
  FROM (SELECT user_id, CAST(unnest(generate_series({TODAY} - INTERVAL '3 months', {TODAY}, INTERVAL '1 day')) AS DATE) AS date
    FROM users WHERE role = 'user') d,
    (VALUES ('car', 0.3, 5, 25), ('bus', 0.25, 8, 15), ('bike', 0.2, 2, 8), ('walk', 0.15, 0.5, 3), ('metro', 0.08, 12, 20),
      ('train', 0.015, 25, 50), ('air', 0.005, 200, 800)) m(mode, p, base, spread)
  WHERE {noise("mode", *_TRIP_KEYS)} < p AND {noise("day", *_TRIP_KEYS)} > 0.7) x""")
sql("synth_trips_recent", f"""
SELECT user_id, date, mode, {D("distance_km")} AS distance_km, {D(TRIP_CO2E)} AS co2e_emitted FROM (
  SELECT user_id, date, (['car', 'bus', 'bike', 'walk', 'metro'])[CAST(floor({noise("pick", "user_id", "date")} * 5 + 1) AS INT)] AS mode,
    {amount("2", "20", noise("recent km", "user_id", "date"), "DECIMAL(8,2)")} AS distance_km
  FROM (SELECT user_id, {TODAY} - CAST(back AS INT) AS date FROM users, generate_series(0, 6) g(back)
    WHERE role = 'user' AND {noise("chosen", "user_id")} > 0.3) d) x""")
sql("sample_trips", f"""SELECT {TRIP}, created_at, {D("co2e_emitted")} AS co2e_emitted FROM trips
WHERE {noise("sample", "trip_id", seed=7)} < 0.1""")

# --- streams --------------------------------------------------------------------------------
WINDOW_SUMS = f"""count(*) AS record_count, {D("SUM(consumption_kwh)")} AS total_consumption_kwh,
  {D(f"SUM({CO2E})")} AS total_co2e_emitted FROM live"""
sql("stream_daily_rollup", f"SELECT CAST(date_trunc('day', date_time) AS TIMESTAMP) AS period, {WINDOW_SUMS} GROUP BY 1")
sql("stream_hourly_trend", f"""
SELECT CAST(date_trunc('hour', date_time) AS TIMESTAMP) AS period, building_id, {WINDOW_SUMS} GROUP BY 1, 2""")
sql("stream_late_readings", """
SELECT record_id, CAST(record_id % 4 AS INT) AS batch FROM live l WHERE date_trunc('day', date_time) + INTERVAL '1 day'
  <= (SELECT max(date_time) FROM live b WHERE b.record_id % 4 < l.record_id % 4) - INTERVAL '1 day'""")
# A key belongs to the first file that has a good row of it; what comes later is refused, once a key and file.
STREAMED = more(batch("raw", given.READINGS_STREAMED), f"""checked AS (
  SELECT record_id, building_id, TRY_CAST(date_time AS TIMESTAMP) AS date_time, source, file,
    TRY_CAST(consumption_kwh AS DECIMAL(10,2)) AS consumption_kwh, {READING_ERRORS} AS errors FROM raw)""",
  """fit AS (SELECT *, record_id IN (SELECT record_id FROM energy) AS known, file > min(file) OVER (PARTITION BY record_id) AS later,
    row_number() OVER (PARTITION BY record_id, file ORDER BY building_id DESC, date_time DESC, source DESC, consumption_kwh DESC) AS place
  FROM checked WHERE errors = '' AND building_id IN (SELECT building_id FROM buildings))""")
sql("stream_ingest", f"""SELECT {READING}, {LOADED} AS created_at, {D(CO2E)} AS co2e_emitted FROM fit
WHERE place = 1 AND NOT known AND NOT later""", STREAMED)
sql("stream_ingest_refused", """SELECT record_id, errors AS reason FROM checked WHERE errors <> ''
UNION ALL SELECT record_id, 'unknown building_id' FROM checked WHERE errors = '' AND building_id NOT IN (SELECT building_id FROM buildings)
UNION ALL SELECT record_id, 'record_id exists' FROM fit WHERE place = 1 AND (known OR later)
UNION ALL SELECT record_id, 'record_id repeated in the batch' FROM fit WHERE place = 2 AND NOT later""", STREAMED)
