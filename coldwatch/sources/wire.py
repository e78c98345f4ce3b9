"""JSON messages: decoding with error routing, and what a reading looks like on the wire.

A message is parsed into typed fields inside an object that ends in a mark, and once
more inside an array that must have one element. Text that goes on after its JSON
value, or that closes or extends a wrapper, cannot suit both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.functions.time import iso_utc, parse_utc
from coldwatch.schemas import (
    ALERT_WIRE_FIELDS,
    LEGACY_TEMPERATURE,
    MESSAGE_FIELDS,
    TELEMETRY_FIELDS,
)

OK = "ok"
MALFORMED = "malformed"
NOT_OBJECT = "not_object"

_DOCUMENT = "document"
_STRICT = {"allowSingleQuotes": "false"}


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds the parsed ``document``, its ``decode_status``, and the two outcomes
    the counters need: ``counted`` (it was JSON) and ``failed`` (it was unusable).

    A field of the wrong type reads as NULL, like one that is absent.
    """
    text = F.col(value).cast("string")
    fields = ", ".join(f"{name}: {kind}" for name, kind in MESSAGE_FIELDS.items())
    marked = F.from_json(
        F.concat(F.lit('{"m":'), text, F.lit(',"e":1}')), f"m struct<{fields}>, e int", _STRICT
    )
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    # Kept apart from what is made of it, so that each is parsed once.
    parsed = messages.withColumn("_marked", marked).withColumn("_one", F.size(listed) == 1)
    is_json = F.coalesce((F.col("_marked.e") == 1) & F.col("_one"), F.lit(False))
    document = F.when(is_json, F.col("_marked.m"))
    status = F.when(~is_json, MALFORMED).when(document.isNull(), NOT_OBJECT).otherwise(OK)
    return (
        parsed.withColumn(_DOCUMENT, document)
        .withColumn("decode_status", status)
        .withColumn("counted", is_json)
        .withColumn("failed", F.col(_DOCUMENT).isNull())
        .drop("_marked", "_one")
    )


def decode_errors(decoded: DataFrame) -> DataFrame:
    """The messages that could not be used, with the reason."""
    return decoded.where(F.col("failed"))


def _usable(decoded: DataFrame, usable_only: bool) -> DataFrame:
    """Message fields as columns. Unfolding the document also drops messages
    without one; filtering them out first would parse every message twice."""
    documents = F.when(F.col(_DOCUMENT).isNotNull(), F.array(_DOCUMENT))
    unfold = F.inline if usable_only else F.inline_outer
    others = [c for c in decoded.columns if c not in MESSAGE_FIELDS and c != _DOCUMENT]
    return decoded.select(*others, unfold(documents))


def telemetry_from_wire(decoded: DataFrame, usable_only: bool = True) -> DataFrame:
    """Readings of the usable messages. ``ts`` is the parsed ``timestamp``.

    With ``usable_only=False`` unusable messages stay, as readings without a
    value, so that one pass can count them and evaluate the others.
    """
    others = [c for c in decoded.columns if c not in MESSAGE_FIELDS and c != _DOCUMENT]
    return _usable(decoded, usable_only).select(
        *others,
        parse_utc(F.col("timestamp")).alias("ts"),
        *[name for name, _ in TELEMETRY_FIELDS],
        LEGACY_TEMPERATURE,
    )


def alerts_from_wire(decoded: DataFrame) -> DataFrame:
    """Alerts of the usable messages; the text ``timestamp`` becomes an instant."""
    others = [c for c in decoded.columns if c not in MESSAGE_FIELDS and c != _DOCUMENT]
    return _usable(decoded, usable_only=True).select(
        *others,
        *[
            parse_utc(F.col(name)).alias(name) if name == "timestamp" else F.col(name)
            for name, _ in ALERT_WIRE_FIELDS
        ],
    )


def with_wire_problems(decoded: DataFrame, value: str = "value") -> DataFrame:
    """The usable messages with their ``problems``: required telemetry fields that
    are absent or not of their type, in schema order. Text fields must be JSON
    strings, which takes a look at the untyped value."""

    def bad(name: str, kind: str) -> Column:
        absent = F.col(f"{_DOCUMENT}.{name}").isNull()
        if kind != "string":
            return absent
        found = F.schema_of_variant(F.col(f"_untyped.{name}"))
        return absent | ~F.coalesce(found == "STRING", F.lit(False))

    # Untyped are only the text fields: repeated keys and NaN elsewhere do not matter.
    texts = ", ".join(f"{name} variant" for name, kind in TELEMETRY_FIELDS if kind == "string")
    untyped = F.from_json(F.col(value).cast("string"), texts, _STRICT)
    both = F.array(F.struct(F.col(_DOCUMENT), untyped.alias("_untyped")))
    others = [c for c in decoded.columns if c != _DOCUMENT]
    # Unfolded like in ``_usable``: a filter on the problems must not parse again.
    usable = decoded.select(*others, F.inline(F.when(F.col(_DOCUMENT).isNotNull(), both)))
    problems = [F.when(bad(name, kind), F.lit(name)) for name, kind in TELEMETRY_FIELDS]
    return usable.withColumn("problems", F.array_compact(F.array(*problems))).drop("_untyped")


def telemetry_json() -> Column:
    """A reading as JSON text; absent values are left out."""
    body = F.struct(
        *[
            iso_utc(F.col("ts")).alias(name) if name == "timestamp" else F.col(name)
            for name, _ in TELEMETRY_FIELDS
        ],
        F.col(LEGACY_TEMPERATURE),
    )
    return F.to_json(body)


def telemetry_to_wire(telemetry: DataFrame) -> DataFrame:
    """Readings as keyed JSON messages."""
    return telemetry.select(
        "event_id", F.col("truck_id").alias("key"), telemetry_json().alias("value")
    )
