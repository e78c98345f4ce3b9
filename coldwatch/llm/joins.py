"""Joins whose hot keys are dealt to many tasks, whatever the session's settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import stored

SHARE = 1 << 16  # rows of one key in one task
KEYS = 10_000  # most keys that can be hot, so that their list is small enough to broadcast

SMALL = 4_000_000  # ids that are broadcast at most, some 100 MB


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``ids`` (key), each of which occurs once.

    Up to ``SMALL`` ids are broadcast, so that wide rows that are not wanted never move; more
    are joined as the planner likes.
    """
    ids = stored(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL else ids, key, "left_semi")


def skew_join(
    many: DataFrame, one: DataFrame, key: str | list[str], how: str = "inner", share: int = SHARE
) -> DataFrame:
    """``many`` joined with ``one``, which has a row per ``key`` at most; inner or left.

    A key of more than ``share`` rows of ``many`` (or of the ``KEYS``-th part of all, if
    that is more) is hot, so there are at most ``KEYS`` of them. Its rows are dealt by
    their other columns to as many tasks as they fill, and its row of ``one`` goes to each.
    Rows with a null key match nothing. No column may be named ``salts`` or ``salt``.
    """
    keys = [key] if isinstance(key, str) else key
    counts = stored(many.groupBy(keys).agg(F.count("*").alias("rows")), "key-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    limit = max(share, -(-total // KEYS))
    hot = counts.where(F.col("rows") > limit).dropna(subset=keys).select(
        *keys, F.ceil(F.col("rows") / limit).cast("int").alias("salts")
    )
    if hot.isEmpty():
        return many.join(one, keys, how)
    others = [f"`{c}`" for c in many.columns if c not in keys]
    dealt = F.pmod(F.xxhash64(*others), F.col("salts")) if others else F.lit(0)
    hot = F.broadcast(hot)
    left = many.join(hot, keys, "left").withColumn(
        "salt", F.coalesce(dealt.cast("int"), F.lit(0))
    )
    right = one.join(hot, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    )
    joined = left.drop("salts").join(right.drop("salts"), [*keys, "salt"], how)
    return joined.drop("salt")
