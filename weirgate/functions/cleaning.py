"""Cleaning and projection steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.rules import per_second
from weirgate.schemas import CATEGORICAL, IGNORED, LABEL, NUMERIC

NULL_TEXT = "NULL"
UNKNOWN = "unknown"
LLDP = 0x88CC
DAY_US = 86_400_000_000

# Ethertype code (decimal or hex spelling) to display name.
ETHERTYPES = {
    "2048": "IPv4 (0x0800)",
    "2054": "ARP (0x0806)",
    "34525": "IPv6 (0x86dd)",
    "0x0800": "IPv4",
    "0x0806": "ARP",
    "0x86dd": "IPv6",
    "N/A": "Não especificado",
}
# Fixed value: the name of a code that is not listed.
UNKNOWN_ETHERTYPE = "Desconhecido (%s)"


def finite(c: Column) -> Column:
    """±inf and NaN become null, so nothing downstream sees either."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def null_text(c: Column) -> Column:
    """The text sentinel for a missing match field becomes a real null."""
    return F.nullif(c, F.lit(NULL_TEXT))


def nullable_int(c: Column) -> Column:
    return c.try_cast("bigint")


def category_text(c: Column, dtype: T.DataType) -> Column:
    """Text form of a categorical; integral numbers never show a decimal point."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = finite(c)
        text = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(UNKNOWN))


def dpid_decimal(c: Column) -> Column:
    return F.lpad(c.cast("string"), 16, "0")


def dpid_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def first_present(match: Column, keys: list[str], default: str = "N/A") -> Column:
    return F.coalesce(*[F.try_element_at(match, F.lit(k)) for k in keys], F.lit(default))


def ethertype_name(code: Column) -> Column:
    name = F
    for key, text in ETHERTYPES.items():
        name = name.when(code == key, F.lit(text))
    return name.otherwise(F.format_string(UNKNOWN_ETHERTYPE, code))


def drop_unlabelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.dropna(subset=[label])


def drop_identifiers(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.drop(*IGNORED, label)


def present(columns: list[str], df: DataFrame) -> list[str]:
    return [c for c in columns if c in df.columns]


def keep_features(df: DataFrame) -> DataFrame:
    """Only the feature columns that exist, in model order."""
    return df.select(*present(NUMERIC + CATEGORICAL, df))


def infinities_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def add_missing(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Missing numeric columns become 0, missing categorical ones 'unknown'."""
    extra = {c: F.lit(0.0) for c in numeric if c not in df.columns}
    extra |= {c: F.lit(UNKNOWN) for c in categorical if c not in df.columns}
    return df.withColumns(extra) if extra else df


def fill_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: category_text(F.col(c), df.schema[c].dataType) for c in columns})


def drop_lldp(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ethertype") != LLDP)


def day_of(time_us: Column) -> Column:
    """Days since the epoch, without a time zone."""
    return F.floor(time_us / DAY_US).cast("int")


def newer_than(df: DataFrame, mark_us: int) -> DataFrame:
    """Rows after the mark; on a table laid out by day earlier days are not read."""
    if "day" in df.columns:
        df = df.filter(F.col("day") >= F.lit(mark_us // DAY_US))
    return df.filter(F.col("time_us") > F.lit(mark_us))


def live_features(df: DataFrame) -> DataFrame:
    """Live flow rows in the shape the models were trained on.

    Counters are renamed, rates use the rules' guarded division, and every other
    feature takes its default.
    """
    seconds = F.col("duration_sec")
    out = (
        df.withColumns({
            "packet_count": F.col("packets").cast("double"),
            "byte_count": F.col("bytes").cast("double"),
            "flow_duration_sec": seconds.cast("double"),
            "packet_count_per_second": per_second(F.col("packets"), seconds),
            "byte_count_per_second": per_second(F.col("bytes"), seconds),
        })
    )
    return add_missing(out, NUMERIC, CATEGORICAL)
