"""Threshold rules as data, compiled to column expressions.

A rule names the reading it looks at, the condition under which it fires and
its severity levels. ``RuleBook`` numbers all (rule, level) pairs from most to
least severe, equal severities in rule order, and gives each a bit. One pass
over the conditions then yields one integer per reading: the lowest bit is the
primary alert, the bit count is the number of alerts, and the texts are looked
up by bit number. Operators put that integer in a column first and look up in a
later projection, so no condition is evaluated once per alert field, and the
generated methods stay below the size the JIT compiler accepts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coldwatch.schemas import LEGACY_TEMPERATURE

Readings = dict[str, Column]

# What a rule assumes of a sensor that did not report.
HEALTHY_READINGS = {
    "temperature_c": -20.0,
    "humidity_pct": 70.0,
    "door_status": "CLOSED",
    "speed_kmh": 0.0,
    "fuel_level_pct": 100.0,
    "battery_voltage": 14.0,
    "tire_pressure_psi": 110.0,
    "compressor_status": "ON",
}

# Ranking of severities; any other ranks last.
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
UNKNOWN_RANK = 99

# One bit per (rule, level) in a non-negative bigint; more levels go into an array of numbers.
_BITS = 63

# Columns between ``look_up`` and ``describe``.
FACT, VALUE = "_fact", "_value"


@dataclass(frozen=True)
class Level:
    """One severity a rule can raise; the first whose condition holds is taken."""

    severity: str
    sla_impact: str
    only_if: Callable[[Readings], Column] | None = None


@dataclass(frozen=True)
class Rule:
    """``{v}`` in ``message`` stands for the reading, a number unless ``is_text``."""

    alert_type: str
    reading: str
    fires: Callable[[Readings], Column]
    levels: tuple[Level, ...]
    message: str
    action: str
    threshold: str
    unit: str
    is_text: bool = False


# The eight rules, in evaluation order.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        alert_type="TEMP_BREACH",
        reading="temperature_c",
        fires=lambda r: r["temperature_c"] > -5.0,
        levels=(Level("CRITICAL", "HIGH"),),
        message="Temperature excursion detected: {v}°C exceeds -5°C threshold",
        action="DISPATCH_TECHNICIAN",
        threshold="-5.0",
        unit="°C",
    ),
    Rule(
        alert_type="HUMIDITY_BREACH",
        reading="humidity_pct",
        fires=lambda r: r["humidity_pct"] > 90.0,
        levels=(Level("HIGH", "MEDIUM"),),
        message="High humidity detected: {v}% indicates seal compromise",
        action="INSPECT_DOOR_SEALS",
        threshold="90.0",
        unit="%",
    ),
    Rule(
        alert_type="DOOR_VIOLATION",
        reading="speed_kmh",
        fires=lambda r: (r["door_status"] == "OPEN") & (r["speed_kmh"] > 5.0),
        levels=(Level("CRITICAL", "CRITICAL"),),
        message="Door open while moving at {v} km/h - immediate stop required",
        action="EMERGENCY_STOP",
        threshold="5.0",
        unit="km/h",
    ),
    Rule(
        alert_type="SPEED_VIOLATION",
        reading="speed_kmh",
        fires=lambda r: r["speed_kmh"] > 100.0,
        levels=(Level("MEDIUM", "LOW"),),
        message="Speed limit exceeded: {v} km/h (limit: 100 km/h)",
        action="NOTIFY_DRIVER",
        threshold="100.0",
        unit="km/h",
    ),
    Rule(
        alert_type="LOW_FUEL",
        reading="fuel_level_pct",
        fires=lambda r: r["fuel_level_pct"] < 15.0,
        levels=(
            Level("CRITICAL", "HIGH", only_if=lambda r: r["fuel_level_pct"] < 5.0),
            Level("HIGH", "MEDIUM"),
        ),
        message="Low fuel warning: {v}% remaining",
        action="ROUTE_TO_FUEL_STATION",
        threshold="15.0",
        unit="%",
    ),
    Rule(
        alert_type="BATTERY_LOW",
        reading="battery_voltage",
        fires=lambda r: r["battery_voltage"] < 11.8,
        levels=(Level("MEDIUM", "LOW"),),
        message="Low battery voltage: {v}V (minimum: 11.8V)",
        action="SCHEDULE_MAINTENANCE",
        threshold="11.8",
        unit="V",
    ),
    Rule(
        alert_type="TIRE_PRESSURE_LOW",
        reading="tire_pressure_psi",
        fires=lambda r: r["tire_pressure_psi"] < 85.0,
        levels=(
            Level("CRITICAL", "HIGH", only_if=lambda r: r["tire_pressure_psi"] < 70.0),
            Level("HIGH", "HIGH"),
        ),
        message="Low tire pressure: {v} PSI (minimum: 85 PSI)",
        action="STOP_AND_INSPECT",
        threshold="85.0",
        unit="PSI",
    ),
    Rule(
        alert_type="COMPRESSOR_FAULT",
        reading="compressor_status",
        fires=lambda r: r["compressor_status"] == "FAULT",
        levels=(Level("CRITICAL", "CRITICAL"),),
        message="Refrigeration compressor fault detected",
        action="DISPATCH_TECHNICIAN",
        threshold="ON",
        unit="status",
        is_text=True,
    ),
)


def effective_readings() -> Readings:
    """Sensor columns as the rules see them, with healthy values for silent sensors.

    NaN fires no rule, but compares as the largest number here, so it is taken
    for a silent sensor as well.
    """
    readings = {}
    for name, healthy in HEALTHY_READINGS.items():
        reported = [name, LEGACY_TEMPERATURE] if name == "temperature_c" else [name]
        value = F.coalesce(*reported, F.lit(healthy))
        readings[name] = value if isinstance(healthy, str) else F.nanvl(value, F.lit(healthy))
    return readings


class RuleBook:
    """Columns for a rule list, to be used on a telemetry DataFrame."""

    def __init__(self, rules: Sequence[Rule] = DEFAULT_RULES):
        self.rules = tuple(rules)
        levels = [(rule, level) for rule in self.rules for level in rule.levels]
        if not levels:
            raise ValueError("a rule with a level is expected")
        self._as_bits = len(levels) <= _BITS
        # A stable sort: equal severities stay in rule order.
        self._variants = sorted(
            levels, key=lambda v: SEVERITY_RANK.get(v[1].severity, UNKNOWN_RANK)
        )
        self._readings = effective_readings()
        for rule in self.rules:
            self._readings.setdefault(rule.reading, F.col(rule.reading))

    def columns_used(self) -> list[str]:
        """Columns ``describe`` reads, besides the fired bits."""
        names = dict.fromkeys(rule.reading for rule in self.rules)
        if "temperature_c" in names:
            names[LEGACY_TEMPERATURE] = None
        return list(names)

    def _choose_level(self, rule: Rule, number: Callable[[int], int]) -> Column:
        """The number of the level that applies if ``rule`` fires."""
        chosen = None
        for level in reversed(rule.levels):
            mine = F.lit(number(self._variants.index((rule, level))))
            if chosen is None or level.only_if is None:
                chosen = mine
            else:
                chosen = F.when(level.only_if(self._readings), mine).otherwise(chosen)
        return chosen

    # --- per reading -----------------------------------------------------

    def fired(self) -> Column:
        """The variants a reading raises, as bits or sorted numbers; see ``raised``."""
        if not self._as_bits:
            return F.array_sort(self.each_variant())
        bits = [
            # A condition on a missing value is NULL, which is "does not fire".
            F.when(rule.fires(self._readings), self._choose_level(rule, lambda i: 1 << i))
            .otherwise(F.lit(0))
            .cast("bigint")
            for rule in self.rules
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    def each_variant(self) -> Column:
        """The variants a reading raises, as an array in rule order."""
        none = F.lit(-1)
        numbers = [
            F.when(rule.fires(self._readings), self._choose_level(rule, lambda i: i)).otherwise(none)
            for rule in self.rules
        ]
        return F.array_remove(F.array(*numbers), none)

    # --- from what fired ---------------------------------------------------

    def raised(self, fired: Column) -> Column:
        """Whether a reading raises anything."""
        return fired != 0 if self._as_bits else F.array_size(fired) > 0

    def primary_variant(self, fired: Column) -> Column:
        """The most severe variant: the position of the lowest bit, or the least number."""
        if not self._as_bits:
            return F.get(fired, F.lit(0))
        return F.bit_count(fired.bitwiseAND(-fired) - 1)

    def total(self, fired: Column) -> Column:
        return F.bit_count(fired) if self._as_bits else F.array_size(fired)

    def others(self, fired: Column) -> Column:
        """Types of the alerts after the primary one, ranked; NULL if there are none."""
        if not self._as_bits:
            types = F.array(*[F.lit(rule.alert_type) for rule, _ in self._variants])
            others = F.transform(F.slice(fired, 2, len(self._variants)), lambda v: F.get(types, v))
            return F.when(F.array_size(fired) > 1, others)
        rest = fired.bitwiseAND(fired - 1)
        names = [
            F.when(rest.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, rule.alert_type).otherwise("")
            for i, (rule, _) in enumerate(self._variants)
        ]
        return F.when(rest != 0, F.array_remove(F.array(*names), ""))

    def look_up(self, variant: Column) -> list[Column]:
        """What ``describe`` needs, as two columns: constants of the variant, and
        the reading as text. NULL if there is no such variant."""
        numeric = list(dict.fromkeys(r.reading for r in self.rules if not r.is_text))
        texts = list(dict.fromkeys(r.reading for r in self.rules if r.is_text))
        facts = self._constants(
            [
                {
                    "alert_type": rule.alert_type,
                    "severity": level.severity,
                    "before": rule.message.partition("{v}")[0],
                    "after": rule.message.partition("{v}")[2],
                    "quotes_reading": "{v}" in rule.message,
                    "action_required": rule.action,
                    "threshold": rule.threshold,
                    "unit": rule.unit,
                    "sla_impact": level.sla_impact,
                }
                for rule, level in self._variants
            ]
        )
        order = [*numeric, *texts]
        slot = F.get(
            self._constants([{"n": order.index(rule.reading)} for rule, _ in self._variants]),
            variant,
        )["n"]
        value = F.coalesce(
            self._pick(slot, numeric, "double").cast("string"),
            self._pick(slot - len(numeric), texts, "string"),
        )
        return [F.get(facts, variant).alias(FACT), value.alias(VALUE)]

    def describe(self) -> list[Column]:
        """The eight rule fields of an alert, after ``look_up``."""
        fact, value = F.col(FACT), F.col(VALUE)
        quoted = F.when(fact["quotes_reading"], value).otherwise("")
        return [
            fact["alert_type"].alias("alert_type"),
            fact["severity"].alias("severity"),
            F.concat(fact["before"], quoted, fact["after"]).alias("alert_message"),
            fact["action_required"].alias("action_required"),
            fact["threshold"].alias("threshold"),
            value.alias("actual_value"),
            fact["unit"].alias("unit"),
            fact["sla_impact"].alias("sla_impact"),
        ]

    @staticmethod
    def _constants(rows: list[dict]) -> Column:
        """A constant array of structs, as one SQL literal."""

        def literal(value: str | int | bool) -> str:
            if isinstance(value, str):
                return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
            return str(value).lower()

        structs = [
            "named_struct(" + ", ".join(f"'{k}', {literal(v)}" for k, v in row.items()) + ")"
            for row in rows
        ]
        return F.expr(f"array({', '.join(structs)})")

    def _pick(self, slot: Column, names: list[str], kind: str) -> Column:
        if not names:
            return F.lit(None).cast(kind)
        return F.get(F.array(*[self._readings[name].cast(kind) for name in names]), slot)
