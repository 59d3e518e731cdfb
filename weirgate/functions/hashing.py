"""Random choices as hashes of a seed and stable ids: repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *ids: Column) -> Column:
    """Uniform 32-digit hex key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def uniform(seed: int | str, *ids: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the key."""
    head = F.substring(order_key(seed, *ids), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)
