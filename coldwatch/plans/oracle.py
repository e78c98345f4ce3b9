"""What the named queries must return, as SQL over the same tables.

Written independently of the operators: rules as a union of selects, ranking
and latest-per-key with window functions, segments with self-joins.
"""

from __future__ import annotations

TELEMETRY = """
telemetry AS (
  SELECT event_id, ts,
    CASE WHEN id % 109 = 0 THEN NULL ELSE 'TRUCK-' || CAST(101 + u AS VARCHAR) END AS truck_id,
    CASE u % 3 WHEN 0 THEN 'RT-LAG-ABJ' WHEN 1 THEN 'RT-PHC-MKD' ELSE 'RT-BEN-ABJ' END AS route_id,
    4 + CAST((id * 97 + k * 3) % 6000 AS DOUBLE) / 1000 AS latitude,
    3 + CAST((id * 89 + k * 5) % 5000 AS DOUBLE) / 1000 AS longitude,
    CASE WHEN id % 103 = 0 THEN NULL ELSE CAST((id * 71 + k * 13) % 1050 AS DOUBLE) / 10 END AS speed_kmh,
    CAST((id * 31) % 3600 AS DOUBLE) / 10 AS heading_degrees,
    CAST(k % 61 + 20 AS DOUBLE) / 10 AS gps_accuracy_m,
    CASE WHEN id % 97 = 0 THEN NULL ELSE CAST((id * 37 + k * 11) % 190 - 230 AS DOUBLE) / 10 END AS temperature_c,
    CAST((id * 53 + k * 7) % 320 + 600 AS DOUBLE) / 10 AS humidity_pct,
    CASE WHEN event_type = 'error' AND k >= 80 THEN 'FAULT' ELSE 'ON' END AS compressor_status,
    'RUNNING' AS engine_status,
    CAST((id * 29 + k * 17) % 960 + 40 AS DOUBLE) / 10 AS fuel_level_pct,
    CAST((id * 43 + k * 19) % 300 + 1160 AS DOUBLE) / 100 AS battery_voltage,
    CAST((id * 61 + k * 23) % 200 + CASE WHEN id % 8 = 0 THEN 680 ELSE 1000 END AS DOUBLE) / 10 AS tire_pressure_psi,
    50000 + CAST(id AS DOUBLE) / 10 AS odometer_km,
    CASE WHEN id % 101 = 0 THEN NULL WHEN event_type = 'signup' AND k < 30 THEN 'OPEN' ELSE 'CLOSED' END AS door_status,
    8000 + value AS cargo_weight_kg,
    CASE (id + k) % 10 WHEN 0 THEN 'LOADING' WHEN 1 THEN 'DOCKED' ELSE 'IN_TRANSIT' END AS status,
    CASE WHEN id % 107 = 0 THEN NULL ELSE 'DRV-00' || CAST(u % 5 + 1 AS VARCHAR) END AS driver_id,
    CASE WHEN id % 194 = 0 THEN CAST(k - 60 AS DOUBLE) / 2 END AS temperature
  FROM (SELECT event_id, ts, event_id AS id, user_id AS u, event_type, value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events)
)"""

# The bad messages of the wire fixture; the others are stood in for by '{}'.
WIRE = """
wire AS (
  SELECT 'telemetry' AS topic, event_id,
    CASE WHEN event_id % 127 = 0 THEN NULL
         WHEN event_id % 113 = 0 THEN substr(props, 1, length(props) - 1)
         WHEN event_id % 139 = 0 THEN props || ' x'
         WHEN event_id % 131 = 0 THEN '[' || regexp_extract(props, '([0-9]+)', 1) || ']'
         WHEN event_id % 137 = 0 THEN regexp_extract(props, '([0-9]+)', 1)
         WHEN event_id % 149 = 0 THEN props || '}'
         WHEN event_id % 151 = 0 THEN props || ',"x":{}'
         WHEN event_id % 157 = 0 THEN replace(props, '"', '''')
         WHEN event_id % 163 = 0 THEN regexp_extract(props, '([0-9]+)', 1) || ',"m":{"truck_id":"EVIL"}'
         ELSE '{}' END AS value
  FROM events
),
decoded AS (
  SELECT *, CASE WHEN value IS NULL OR NOT json_valid(value) THEN 'malformed'
                 WHEN json_type(value) <> 'OBJECT' THEN 'not_object'
                 ELSE 'ok' END AS decode_status
  FROM wire
)"""

# The rules, with their texts and thresholds.
# rule position, type, severity, message, action, threshold, reading, unit, sla, condition
_RULES = [
    (0, "TEMP_BREACH", "'CRITICAL'", "'Temperature excursion detected: ' || {v} || '°C exceeds -5°C threshold'",
     "DISPATCH_TECHNICIAN", "-5.0", "coalesce(temperature_c, temperature, -20.0)", "°C", "'HIGH'",
     "coalesce(temperature_c, temperature, -20.0) > -5"),
    (1, "HUMIDITY_BREACH", "'HIGH'", "'High humidity detected: ' || {v} || '% indicates seal compromise'",
     "INSPECT_DOOR_SEALS", "90.0", "humidity_pct", "%", "'MEDIUM'", "humidity_pct > 90"),
    (2, "DOOR_VIOLATION", "'CRITICAL'", "'Door open while moving at ' || {v} || ' km/h - immediate stop required'",
     "EMERGENCY_STOP", "5.0", "speed_kmh", "km/h", "'CRITICAL'", "door_status = 'OPEN' AND speed_kmh > 5"),
    (3, "SPEED_VIOLATION", "'MEDIUM'", "'Speed limit exceeded: ' || {v} || ' km/h (limit: 100 km/h)'",
     "NOTIFY_DRIVER", "100.0", "speed_kmh", "km/h", "'LOW'", "speed_kmh > 100"),
    (4, "LOW_FUEL", "CASE WHEN fuel_level_pct < 5 THEN 'CRITICAL' ELSE 'HIGH' END",
     "'Low fuel warning: ' || {v} || '% remaining'", "ROUTE_TO_FUEL_STATION", "15.0", "fuel_level_pct", "%",
     "CASE WHEN fuel_level_pct < 5 THEN 'HIGH' ELSE 'MEDIUM' END", "fuel_level_pct < 15"),
    (5, "BATTERY_LOW", "'MEDIUM'", "'Low battery voltage: ' || {v} || 'V (minimum: 11.8V)'",
     "SCHEDULE_MAINTENANCE", "11.8", "battery_voltage", "V", "'LOW'", "battery_voltage < CAST(11.8 AS DOUBLE)"),
    (6, "TIRE_PRESSURE_LOW", "CASE WHEN tire_pressure_psi < 70 THEN 'CRITICAL' ELSE 'HIGH' END",
     "'Low tire pressure: ' || {v} || ' PSI (minimum: 85 PSI)'", "STOP_AND_INSPECT", "85.0",
     "tire_pressure_psi", "PSI", "'HIGH'", "tire_pressure_psi < 85"),
    (7, "COMPRESSOR_FAULT", "'CRITICAL'", "'Refrigeration compressor fault detected'",
     "DISPATCH_TECHNICIAN", "ON", "compressor_status", "status", "'CRITICAL'", "compressor_status = 'FAULT'"),
]

_ALERT = (
    "event_id, alert_type, severity, alert_message, action_required, threshold, actual_value, unit,"
    " sla_impact, truck_id, timestamp, latitude, longitude, route_id, driver_id, status"
)
_PRIMARY = f"{_ALERT}, total_alerts, additional_alerts"


def _rule_select(rule: tuple) -> str:
    pos, name, severity, message, action, threshold, reading, unit, sla, condition = rule
    text = f"CAST({reading} AS VARCHAR)"
    return f"""SELECT {pos} AS pos, event_id, '{name}' AS alert_type, {severity} AS severity,
      {message.replace("{v}", text)} AS alert_message, '{action}' AS action_required,
      '{threshold}' AS threshold, {text} AS actual_value, '{unit}' AS unit, {sla} AS sla_impact,
      truck_id, ts AS timestamp, latitude, longitude, route_id,
      coalesce(driver_id, 'UNKNOWN') AS driver_id, status
    FROM telemetry WHERE {condition}"""


ALERTS = (
    "alerts_all AS (" + "\n  UNION ALL ".join(_rule_select(r) for r in _RULES) + ")"
)
PRIMARY = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY
      CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END,
      pos) AS rn
  FROM alerts_all
),
rest AS (
  SELECT event_id, CAST(count(*) AS INTEGER) AS total_alerts,
         string_agg(CASE WHEN rn > 1 THEN alert_type END, ',' ORDER BY rn) AS additional_alerts
  FROM ranked GROUP BY event_id
),
alerts_primary AS (
  SELECT r.* EXCLUDE (pos, rn), total_alerts, additional_alerts
  FROM ranked r JOIN rest USING (event_id) WHERE rn = 1
)"""
HISTORY = """
history AS (SELECT * FROM alerts_primary ORDER BY timestamp DESC, event_id DESC LIMIT 100)"""
TRUCK_RECENT = """
truck_recent AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY truck_id ORDER BY timestamp DESC, event_id DESC) AS INTEGER) AS recency
    FROM history WHERE truck_id IS NOT NULL)
  WHERE recency <= 10
)"""
FLEET = """
as_of AS (SELECT max(ts) AS now FROM events),
latest_alert AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY truck_id ORDER BY timestamp DESC, event_id DESC) AS n
    FROM alerts_primary WHERE truck_id IS NOT NULL AND truck_id <> '') WHERE n = 1
),
active AS (
  SELECT a.* EXCLUDE (n) FROM latest_alert a, as_of
  WHERE now - timestamp <= INTERVAL 86400 SECOND
),
messages AS (
  SELECT 0 AS topic_rank, event_id, truck_id, ts AS last_seen, latitude, longitude,
         coalesce(speed_kmh, 0.0) AS speed_kmh, coalesce(temperature_c, temperature) AS temperature_c,
         fuel_level_pct, door_status, status, driver_id, route_id
  FROM telemetry
  UNION ALL
  SELECT 1, event_id, truck_id, timestamp, latitude, longitude, 0.0, NULL, NULL, NULL, status, driver_id, route_id
  FROM alerts_primary
),
state AS (
  SELECT * EXCLUDE (n, topic_rank, event_id), truck_id IN (SELECT truck_id FROM active) AS has_active_alert
  FROM (SELECT *, row_number() OVER (PARTITION BY truck_id ORDER BY last_seen DESC, topic_rank DESC, event_id DESC) AS n
        FROM messages WHERE truck_id IS NOT NULL AND truck_id <> '') WHERE n = 1
),
sensor_state AS (
  SELECT * EXCLUDE (n, topic_rank, event_id), truck_id IN (SELECT truck_id FROM active) AS has_active_alert
  FROM (SELECT *, row_number() OVER (PARTITION BY truck_id ORDER BY last_seen DESC, event_id DESC) AS n
        FROM messages WHERE topic_rank = 0 AND truck_id IS NOT NULL AND truck_id <> '') WHERE n = 1
)"""
INTERVALS = """
begun AS (
  SELECT truck_id, timestamp, event_id, coalesce(timestamp - lag(timestamp) OVER own > INTERVAL 86400 SECOND, true) AS anew
  FROM alerts_primary WHERE truck_id IS NOT NULL AND truck_id <> ''
  WINDOW own AS (PARTITION BY truck_id ORDER BY timestamp, event_id)
),
intervals AS (
  SELECT truck_id, min(timestamp) AS active_from, max(timestamp) AS last_alert,
    max(timestamp) + INTERVAL 86400 SECOND AS active_until, count(*) AS alerts
  FROM (SELECT *, sum(anew::INT) OVER (PARTITION BY truck_id ORDER BY timestamp, event_id) AS n FROM begun)
  GROUP BY truck_id, n
)"""
FEED = """
feed AS (
  SELECT 'telemetry' AS topic, event_id, truck_id, ts AS timestamp, route_id, latitude, longitude, speed_kmh,
    heading_degrees, gps_accuracy_m, temperature_c, humidity_pct, compressor_status, engine_status,
    fuel_level_pct, battery_voltage, tire_pressure_psi, odometer_km, door_status, cargo_weight_kg, status,
    driver_id, temperature
  FROM telemetry
  UNION ALL BY NAME
  SELECT 'alerts' AS topic, * FROM alerts_primary
)"""
TRIPS = """
numbered AS (
  SELECT truck_id, event_id, ts, latitude, longitude, coalesce(speed_kmh, 0.0) AS speed,
         row_number() OVER (PARTITION BY truck_id ORDER BY ts, event_id) AS n
  FROM telemetry WHERE truck_id IS NOT NULL AND truck_id <> ''
),
pairs AS (
  SELECT b.*, a.ts AS start_ts, a.latitude AS lat1, a.longitude AS lon1,
         CAST(epoch_us(b.ts) - epoch_us(a.ts) AS DOUBLE) / 1000000 AS elapsed_s
  FROM numbered b LEFT JOIN numbered a ON a.truck_id = b.truck_id AND a.n = b.n - 1
)"""

# Names.
_METRIC_NAMES = {
    "total": "logistics_messages_total",
    "topic": "logistics_messages_by_topic",
    "type": "logistics_alerts_by_type",
    "severity": "logistics_alerts_by_severity",
    "errors": "logistics_errors_total",
}

# Waypoints as route, position, latitude, longitude, road type, place.
_WAYPOINTS = """
waypoints(route_id, segment, lat, lon, road_type, place) AS (VALUES
  ('RT-LAG-ABJ', 0, 6.4550, 3.3941, 'urban', 'Lagos Mainland'),
  ('RT-LAG-ABJ', 1, 6.5962, 3.3683, 'urban', 'Ikeja'),
  ('RT-LAG-ABJ', 2, 6.8256, 3.6472, 'highway', 'Ikorodu'),
  ('RT-LAG-ABJ', 3, 6.8926, 3.7196, 'highway', 'Sagamu Junction'),
  ('RT-LAG-ABJ', 4, 7.3768, 3.9398, 'urban', 'Ibadan'),
  ('RT-LAG-ABJ', 5, 7.7027, 4.4984, 'highway', 'Oshogbo'),
  ('RT-LAG-ABJ', 6, 8.4904, 4.5522, 'urban', 'Ilorin'),
  ('RT-LAG-ABJ', 7, 8.8500, 5.9667, 'highway', 'Mokwa'),
  ('RT-LAG-ABJ', 8, 9.0563, 7.4985, 'urban', 'Abuja FCT'),
  ('RT-PHC-MKD', 0, 4.8156, 7.0498, 'urban', 'Port Harcourt'),
  ('RT-PHC-MKD', 1, 5.1117, 7.3678, 'highway', 'Elele'),
  ('RT-PHC-MKD', 2, 5.4851, 7.0354, 'urban', 'Owerri'),
  ('RT-PHC-MKD', 3, 6.0072, 7.1194, 'highway', 'Okigwe'),
  ('RT-PHC-MKD', 4, 6.4584, 7.5464, 'urban', 'Enugu'),
  ('RT-PHC-MKD', 5, 6.8833, 7.3833, 'highway', 'Nsukka'),
  ('RT-PHC-MKD', 6, 7.7322, 8.5218, 'urban', 'Makurdi'),
  ('RT-BEN-ABJ', 0, 6.3392, 5.6175, 'urban', 'Benin City'),
  ('RT-BEN-ABJ', 1, 6.7428, 6.0922, 'highway', 'Ekpoma'),
  ('RT-BEN-ABJ', 2, 7.1706, 6.1360, 'urban', 'Auchi'),
  ('RT-BEN-ABJ', 3, 7.5629, 6.2343, 'highway', 'Okene'),
  ('RT-BEN-ABJ', 4, 8.0069, 6.7455, 'urban', 'Lokoja'),
  ('RT-BEN-ABJ', 5, 8.5000, 7.1500, 'highway', 'Abaji'),
  ('RT-BEN-ABJ', 6, 9.0600, 7.4800, 'urban', 'Abuja')
)"""

_KM = (
    "2 * 6371 * asin(least(1, sqrt(pow(sin(radians({b} - {a}) / 2), 2)"
    " + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
)
_HEADING = (
    "(degrees(atan2(sin(radians({d} - {c})) * cos(radians({b})),"
    " cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({d} - {c})))) + 360) % 360"
)


def _geo(template: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    body = template.format(a=f"CAST({lat1} AS DOUBLE)", b=f"CAST({lat2} AS DOUBLE)",
                           c=f"CAST({lon1} AS DOUBLE)", d=f"CAST({lon2} AS DOUBLE)")
    return f"round({body}, 6)"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n" + select


_TO_PRIMARY = (TELEMETRY, ALERTS, PRIMARY)
_TO_HISTORY = (*_TO_PRIMARY, HISTORY)
_TO_FLEET = (*_TO_PRIMARY, FLEET)


def _metrics(source: str) -> str:
    names = _METRIC_NAMES
    return f"""
SELECT '{names["total"]}' AS metric, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS label_value,
       CAST((SELECT count(*) FROM {source} WHERE decode_status <> 'malformed') + (SELECT count(*) FROM alerts_primary) AS BIGINT) AS value
UNION ALL SELECT '{names["topic"]}', 'topic', 'telemetry', (SELECT count(*) FROM {source} WHERE decode_status <> 'malformed')
UNION ALL SELECT '{names["topic"]}', 'topic', 'alerts', (SELECT count(*) FROM alerts_primary)
UNION ALL SELECT '{names["type"]}', 'type', alert_type, count(*) FROM alerts_primary GROUP BY alert_type
UNION ALL SELECT '{names["severity"]}', 'severity', severity, count(*) FROM alerts_primary GROUP BY severity
UNION ALL SELECT '{names["errors"]}', NULL, NULL, (SELECT count(*) FROM {source} WHERE decode_status <> 'ok')"""


# Telemetry as it comes back from the wire: the bad messages are gone.
_USABLE = TELEMETRY.replace(
    "FROM events)",
    "FROM events WHERE event_id IN (SELECT event_id FROM decoded WHERE decode_status = 'ok'))",
)
_ALL_OK = "every_message AS (SELECT event_id, 'ok' AS decode_status FROM events)"

_ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


def _json_text(name: str) -> str:
    return f"""CASE WHEN {name} IS NULL THEN '' ELSE '"{name}":"' || {name} || '",' END"""


_WIRE_VALUE = (
    """'{"alert_type":"' || alert_type || '","severity":"' || severity || '","alert_message":"' || alert_message"""
    """ || '","action_required":"' || action_required || '","threshold":'"""
    """ || CASE WHEN alert_type = 'COMPRESSOR_FAULT' THEN '"' || threshold || '"' ELSE threshold END"""
    """ || ',"actual_value":' || CASE WHEN alert_type = 'COMPRESSOR_FAULT' THEN '"' || actual_value || '"' ELSE actual_value END"""
    """ || ',"unit":"' || unit || '","sla_impact":"' || sla_impact || '",' || """
    + _json_text("truck_id")
    + """ || '"timestamp":"' || """
    + _ISO.format(t="timestamp")
    + """ || '","latitude":' || CAST(latitude AS VARCHAR) || ',"longitude":' || CAST(longitude AS VARCHAR)"""
    """ || ',"route_id":"' || route_id || '","driver_id":"' || driver_id || '","status":"' || status"""
    """ || '","total_alerts":' || CAST(total_alerts AS VARCHAR)"""
    """ || CASE WHEN additional_alerts IS NULL THEN '' ELSE ',"additional_alerts":["' || replace(additional_alerts, ',', '","') || '"]' END || '}'"""
)

_REQUIRED = (
    "truck_id ts route_id latitude longitude speed_kmh heading_degrees gps_accuracy_m temperature_c humidity_pct"
    " compressor_status engine_status fuel_level_pct battery_voltage tire_pressure_psi odometer_km door_status"
    " cargo_weight_kg status driver_id"
).split()
_MISSING = "concat_ws(',', {})".format(
    ", ".join(
        f"CASE WHEN {c} IS NULL THEN '{'timestamp' if c == 'ts' else c}' END" for c in _REQUIRED
    )
)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED)

# Names.
_ROUTE_NAMES = """
route_names(route_id, route_name, waypoints) AS (VALUES
  ('RT-LAG-ABJ', 'Lagos to Abuja Express', 9),
  ('RT-PHC-MKD', 'Port Harcourt to Makurdi', 7),
  ('RT-BEN-ABJ', 'Benin to Abuja', 7)
),
assigned AS (
  SELECT truck_id, s.route_id AS reported_route_id, coalesce(r.route_id, 'RT-LAG-ABJ') AS route_id,
         coalesce(route_name, 'Lagos to Abuja Express') AS route_name, coalesce(waypoints, 9) AS waypoints
  FROM sensor_state s LEFT JOIN route_names r ON r.route_id = s.route_id
)"""


def oracle_sql() -> dict[str, str]:
    """SQL text per named query."""
    sql = {
        "telemetry": _with(TELEMETRY, select="SELECT * FROM telemetry"),
        "telemetry_valid": _with(TELEMETRY, select=f"SELECT * FROM telemetry WHERE {_COMPLETE}"),
        "telemetry_invalid": _with(
            TELEMETRY,
            select=f"SELECT event_id, {_MISSING} AS missing_fields FROM telemetry WHERE NOT ({_COMPLETE})",
        ),
        "alerts_all": _with(TELEMETRY, ALERTS, select=f"SELECT {_ALERT} FROM alerts_all"),
        "alerts_primary": _with(*_TO_PRIMARY, select=f"SELECT {_PRIMARY} FROM alerts_primary"),
        "alerts_wire": _with(
            *_TO_PRIMARY,
            select=f"SELECT event_id, truck_id AS key, {_WIRE_VALUE} AS value FROM alerts_primary",
        ),
        "decode_errors": _with(
            WIRE,
            select="SELECT topic, event_id, value, decode_status, decode_status <> 'malformed' AS counted"
            " FROM decoded WHERE decode_status <> 'ok'",
        ),
        "wire_problems": _with(
            WIRE,
            _USABLE,
            select=f"SELECT event_id, {_MISSING} AS problems FROM telemetry WHERE NOT ({_COMPLETE})",
        ),
        "telemetry_decoded": _with(
            WIRE,
            _USABLE,
            select=f"SELECT * EXCLUDE (ts), {_ISO.format(t='ts')} AS timestamp FROM telemetry",
        ),
        "metrics_table": _with(WIRE, _USABLE, ALERTS, PRIMARY, select=_metrics("decoded")),
        "fleet_state_wire": _with(
            WIRE, _USABLE, ALERTS, PRIMARY, FLEET, select="SELECT * FROM state"
        ),
        "live_feed": _with(*_TO_PRIMARY, FEED, select="SELECT * FROM feed"),
        "messages_by_topic": _with(
            *_TO_PRIMARY,
            select="SELECT 'telemetry' AS topic, count(*) AS messages FROM events"
            " UNION ALL SELECT 'alerts', count(*) FROM alerts_primary",
        ),
        "alerts_by_type": _with(
            *_TO_PRIMARY,
            select="SELECT alert_type, count(*) AS alerts FROM alerts_primary GROUP BY alert_type",
        ),
        "alerts_by_severity": _with(
            *_TO_PRIMARY,
            select="SELECT severity, count(*) AS alerts FROM alerts_primary GROUP BY severity",
        ),
        "alert_history": _with(*_TO_HISTORY, select="SELECT * FROM history"),
        "alerts_recent": _with(
            *_TO_HISTORY,
            select="SELECT * FROM history ORDER BY timestamp DESC, event_id DESC LIMIT 50",
        ),
        "alerts_recent_severity": _with(
            *_TO_HISTORY,
            select="SELECT * FROM history WHERE severity = 'CRITICAL'"
            " ORDER BY timestamp DESC, event_id DESC LIMIT 50",
        ),
        "alerts_recent_type": _with(
            *_TO_HISTORY,
            select="SELECT * FROM history WHERE alert_type = 'LOW_FUEL'"
            " ORDER BY timestamp DESC, event_id DESC LIMIT 10",
        ),
        "truck_recent_alerts": _with(*_TO_HISTORY, TRUCK_RECENT, select="SELECT * FROM truck_recent"),
        "fleet_state": _with(*_TO_FLEET, select="SELECT * FROM state"),
        "fleet_state_telemetry": _with(*_TO_FLEET, select="SELECT * FROM sensor_state"),
        "alerts_active": _with(*_TO_FLEET, select="SELECT * EXCLUDE (event_id) FROM active"),
        "fleet_summary": _with(
            *_TO_FLEET,
            select="SELECT count(*) AS total_trucks, (SELECT count(*) FROM active) AS trucks_with_alerts,"
            " count(*) FILTER (status = 'IN_TRANSIT') AS trucks_in_transit,"
            " count(*) FILTER (status = 'DOCKED') AS trucks_docked,"
            " count(*) FILTER (status = 'LOADING') AS trucks_loading FROM state",
        ),
        "truck_detail": _with(
            *_TO_FLEET,
            HISTORY,
            TRUCK_RECENT,
            select="""
SELECT s.*, a.alert_type AS active_alert_type, a.severity AS active_severity, a.timestamp AS active_since,
  (SELECT string_agg(CAST(t.event_id AS VARCHAR) || ':' || t.alert_type, ',' ORDER BY t.recency)
   FROM truck_recent t WHERE t.truck_id = s.truck_id) AS recent_alerts
FROM state s LEFT JOIN active a USING (truck_id)""",
        ),
        "truck_route": _with(*_TO_FLEET, _ROUTE_NAMES, select="SELECT * FROM assigned"),
        "route_segments": _with(
            *_TO_FLEET,
            _ROUTE_NAMES,
            _WAYPOINTS,
            select=f"""
SELECT truck_id, w.route_id, w.segment, w.place AS start_name, v.place AS end_name, w.road_type,
  {_geo(_KM, "w.lat", "w.lon", "v.lat", "v.lon")} AS distance_km,
  {_geo(_HEADING, "w.lat", "w.lon", "v.lat", "v.lon")} AS heading_degrees,
  CAST(CASE w.road_type WHEN 'highway' THEN 70 WHEN 'urban' THEN 25 WHEN 'loading_zone' THEN 0 ELSE 40 END AS DOUBLE) AS min_speed_kmh,
  CAST(CASE w.road_type WHEN 'highway' THEN 100 WHEN 'urban' THEN 45 WHEN 'loading_zone' THEN 5 ELSE 60 END AS DOUBLE) AS max_speed_kmh
FROM assigned JOIN waypoints w ON w.route_id = assigned.route_id
JOIN waypoints v ON v.route_id = w.route_id
  AND v.segment = (w.segment + 1) % (SELECT count(*) FROM waypoints x WHERE x.route_id = w.route_id)""",
        ),
        "trip_segments": _with(
            TELEMETRY,
            TRIPS,
            select=f"""
SELECT truck_id, event_id, start_ts, ts AS end_ts, round(elapsed_s, 6) AS elapsed_s,
  {_geo(_KM, "lat1", "lon1", "latitude", "longitude")} AS distance_km,
  {_geo(_HEADING, "lat1", "lon1", "latitude", "longitude")} AS heading_degrees
FROM pairs WHERE start_ts IS NOT NULL""",
        ),
        "trip_summary": _with(
            TELEMETRY,
            TRIPS,
            select="""
SELECT truck_id, readings, round(elapsed_s, 6) AS elapsed_s, round(km, 6) AS distance_km,
       round(km * 0.3 / 400 * 100, 6) AS fuel_used_pct
FROM (SELECT truck_id, count(*) AS readings,
             CAST(sum(CAST(coalesce(elapsed_s, 0) AS DECIMAL(28, 6))) AS DOUBLE) AS elapsed_s,
             CAST(sum(CAST(speed / 3600 * coalesce(elapsed_s, 0) AS DECIMAL(28, 9))) AS DOUBLE) AS km
      FROM pairs GROUP BY truck_id)""",
        ),
    }
    for rule in _RULES:
        sql[f"rule_{rule[1].lower()}"] = _with(
            TELEMETRY, ALERTS, select=f"SELECT {_ALERT} FROM alerts_all WHERE pos = {rule[0]}"
        )
    sql["stream_alerts"] = sql["alerts_primary"]
    sql["stream_fleet_state"] = sql["fleet_state"]
    sql["stream_fleet_state_wire"] = sql["fleet_state_wire"]
    sql["stream_metrics_wire"] = sql["metrics_table"]
    intervals = _with(*_TO_PRIMARY, INTERVALS, select="SELECT * FROM intervals")
    sql["alert_intervals"] = intervals
    # Over is what ended before the newest alert of a known truck.
    sql["stream_alert_intervals"] = (
        f"{intervals} WHERE active_until < (SELECT max(last_alert) FROM intervals)"
    )
    sql["stream_consumer_wire"] = sql["fleet_state_wire"]
    sql["stream_consumer_metrics"] = sql["metrics_table"]
    sql["stream_dead_letters"] = sql["decode_errors"]
    from_wire = (WIRE, _USABLE, ALERTS, PRIMARY)
    sql["stream_alert_history"] = _with(*from_wire, HISTORY, select="SELECT * FROM history")
    sql["stream_consumer_feed"] = _with(*from_wire, FEED, select="SELECT * FROM feed")
    sql["stream_metrics"] = _with(*_TO_PRIMARY, _ALL_OK, select=_metrics("every_message"))
    return sql
