import pytest
from pyspark.sql import functions as F

from weirgate.functions import cleaning, rules


@pytest.mark.parametrize("mac, literal, repeated", [
    ("00:00:00:00:00:00", True, True),
    ("00:00:00:00:00:00:99", True, True),      # anchored at the start only
    ("ff:ff:ff:ff:ff:ff", False, True),        # no sixth colon
    ("AA:aa:AA:aa:AA:aa:", True, False),
    ("00:00:00:00:00:01", False, False),
    ("ab:cd:ab:cd:ab:cd", False, False),
    ("NULL", False, False),
    (None, False, False),
])
def test_invalid_mac(spark, mac, literal, repeated):
    row = spark.createDataFrame([(mac,)], "m string").select(
        rules.invalid_mac(F.col("m")), rules.invalid_mac(F.col("m"), "repeated_octet")).first()
    assert tuple(row) == (literal, repeated)


@pytest.mark.parametrize("packets, octets, seconds, high, long", [
    (10_000, 1, 1, False, False), (10_001, 1, 1, True, False), (1, 100_000_001, 1, True, False),
    (10**9, 10**12, 0, False, False), (1, 1, 3600, False, False), (1, 1, 3601, False, True),
])
def test_limits_are_strict(spark, packets, octets, seconds, high, long):
    df = spark.createDataFrame([(packets, octets, seconds)], "packets long, bytes long, duration_sec long")
    row = df.select(rules.high_volume(F.col("packets"), F.col("bytes"), F.col("duration_sec")),
                    rules.long_connection(F.col("duration_sec"))).first()
    assert tuple(row) == (high, long)


def test_reasons_and_own_rules(spark):
    df = spark.createDataFrame(
        [(20_001, 1, 2, "00:00:00:00:00:00", "a"), (1, 1, 1, "a", "b")],
        "packets long, bytes long, duration_sec long, eth_src string, eth_dst string")
    got = [(r.reasons, r.blocked) for r in rules.judge(df).collect()]
    assert got == [(["high_volume", "invalid_src_mac"], True), ([], False)]
    mine = rules.judge(df, {"tiny": F.col("packets") < 5}).collect()
    assert [r.reasons for r in mine] == [[], ["tiny"]]
    assert [r.blocked for r in rules.judge(df, {}).collect()] == [False, False]


def test_cleaning_edges(spark):
    df = spark.createDataFrame([(float("inf"), 6.0, 17), (float("nan"), None, None), (1.5, 6.5, 6)],
                               "v double, c double, n int")
    assert [r.v for r in cleaning.infinities_to_null(df, ["v"]).collect()] == [None, None, 1.5]
    assert [tuple(r) for r in cleaning.fill_categories(df.select("c", "n"), ["c", "n"]).collect()] == [
        ("6", "17"), ("unknown", "unknown"), ("6.5", "6")]
    codes = spark.createDataFrame([("2048",), ("0x86dd",), ("N/A",), ("9",)], "c string")
    assert [r[0] for r in codes.select(cleaning.ethertype_name(F.col("c"))).collect()] == [
        "IPv4 (0x0800)", "IPv6", "Não especificado", "Desconhecido (9)"]
    ids = spark.createDataFrame([(255,)], "d long").select(
        cleaning.dpid_decimal(F.col("d")), cleaning.dpid_hex(F.col("d"))).first()
    assert tuple(ids) == ("0000000000000255", "00000000000000ff")
