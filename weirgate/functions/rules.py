"""Threshold rules as named boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule limits.
PACKETS_PER_SECOND = 10_000
BYTES_PER_SECOND = 100_000_000
LONG_CONNECTION_SECONDS = 3600

# Address patterns. The literal one is anchored at the start only,
# and its repeated group carries the colon, so a plain six-octet broadcast
# address does not match it.
MAC_LITERAL = r"^(?i)(?:00:00:00:00:00:00|([0-9a-f]{2}:)\1{5})"
MAC_REPEATED_OCTET = r"^(?i)(?:00:00:00:00:00:00|([0-9a-f]{2})(?::\1){5}$)"


def per_second(amount: Column, duration: Column) -> Column:
    """Rate, 0 where the duration is not positive."""
    return F.when(duration > 0, amount / duration).otherwise(F.lit(0.0))


def high_volume(packets: Column, octets: Column, duration: Column) -> Column:
    return (per_second(packets, duration) > PACKETS_PER_SECOND) | (
        per_second(octets, duration) > BYTES_PER_SECOND
    )


def long_connection(duration: Column) -> Column:
    return duration > LONG_CONNECTION_SECONDS


def invalid_mac(mac: Column, mode: str = "literal") -> Column:
    """``literal`` keeps the reference pattern; ``repeated_octet`` also catches ff:ff:ff:ff:ff:ff."""
    patterns = {"literal": MAC_LITERAL, "repeated_octet": MAC_REPEATED_OCTET}
    return F.coalesce(mac.rlike(patterns[mode]), F.lit(False))


def default_rules(mac_mode: str = "literal") -> dict[str, Column]:
    c = F.col
    return {
        "high_volume": high_volume(c("packets"), c("bytes"), c("duration_sec")),
        "long_connection": long_connection(c("duration_sec")),
        "invalid_src_mac": invalid_mac(c("eth_src"), mac_mode),
        "invalid_dst_mac": invalid_mac(c("eth_dst"), mac_mode),
    }


def judge(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Add ``reasons`` (names of the rules that fired) and ``blocked``.

    ``rules`` is the extension point: any name -> boolean column.
    """
    rules = default_rules() if rules is None else rules
    fired = [F.when(test, F.lit(name)) for name, test in rules.items()]
    reasons = F.array_compact(F.array(*fired)) if fired else F.array().cast("array<string>")
    return df.withColumn("reasons", reasons).withColumn("blocked", F.size("reasons") > 0)
