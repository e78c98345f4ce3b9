"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 30


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, by the smallest hashes of ``key``.

    A first cut by the expected share keeps the top-k small; rows are counted, not read.
    """
    count = max(rows.count(), 1)
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(SLOTS))
    share = min(SLOTS, 1 + int(SLOTS * (1.2 * most / count)))
    return rows.where(slot < share).orderBy(slot, key).limit(most)
