"""The rules once more, as plain Python over dicts, for comparison only."""

from __future__ import annotations

# Fixed values, here and in the conditions below: severities in order, thresholds.
ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def reading(record: dict, *names: str, default):
    for name in names:
        if record.get(name) is not None:
            return record[name]
    return default


def raised(record: dict) -> list[tuple[str, str, object]]:
    """(type, severity, value) of every alert, in rule order."""
    out = []
    temp = reading(record, "temperature_c", "temperature", default=-20.0)
    humidity = reading(record, "humidity_pct", default=70.0)
    speed = reading(record, "speed_kmh", default=0.0)
    fuel = reading(record, "fuel_level_pct", default=100.0)
    volts = reading(record, "battery_voltage", default=14.0)
    psi = reading(record, "tire_pressure_psi", default=110.0)
    if temp > -5:
        out.append(("TEMP_BREACH", "CRITICAL", temp))
    if humidity > 90:
        out.append(("HUMIDITY_BREACH", "HIGH", humidity))
    if record.get("door_status") == "OPEN" and speed > 5:
        out.append(("DOOR_VIOLATION", "CRITICAL", speed))
    if speed > 100:
        out.append(("SPEED_VIOLATION", "MEDIUM", speed))
    if fuel < 15:
        out.append(("LOW_FUEL", "CRITICAL" if fuel < 5 else "HIGH", fuel))
    if volts < 11.8:
        out.append(("BATTERY_LOW", "MEDIUM", volts))
    if psi < 85:
        out.append(("TIRE_PRESSURE_LOW", "CRITICAL" if psi < 70 else "HIGH", psi))
    if record.get("compressor_status") == "FAULT":
        out.append(("COMPRESSOR_FAULT", "CRITICAL", "FAULT"))
    return out


def primary(record: dict) -> tuple | None:
    """(type, severity, value, total, other types) of the primary alert."""
    alerts = raised(record)
    if not alerts:
        return None
    ranked = [a for level in ORDER for a in alerts if a[1] == level]
    (kind, severity, value), others = ranked[0], [a[0] for a in ranked[1:]]
    return kind, severity, value, len(alerts), others or None
