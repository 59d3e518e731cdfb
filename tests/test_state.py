from pyspark.sql import functions as F

from weirgate.operators import capture, evaluate, profile, state, voting
from weirgate.sources import flow_json

S = 1_000_000


def sightings(spark, seconds):
    return spark.createDataFrame([(1, 1, "a", "b", s * S, i) for i, s in enumerate(seconds)],
                                 "dpid long, in_port int, eth_src string, eth_dst string, time_us long, flow_id long")


def episodes(spark, seconds, **options):
    rows = state.block_episodes(sightings(spark, seconds), **options).orderBy("start_us").collect()
    return [(r.start_us // S, r.end_us // S, r.sightings) for r in rows]


def test_block_lifetimes(spark):
    assert episodes(spark, [0, 30, 59, 130, 400]) == [(0, 119, 3), (130, 190, 1), (400, 460, 1)]


def test_every_sighting_renews_both_timers(spark):
    assert episodes(spark, [0, 60, 120, 180]) == [(0, 240, 4)]
    assert episodes(spark, range(0, 361, 30)) == [(0, 420, 13)]
    assert len(episodes(spark, [0, 61])) == 2
    assert episodes(spark, [0, 30, 70], idle_seconds=60, hard_seconds=20) == [(0, 20, 1), (30, 50, 1), (70, 90, 1)]


def test_flagged_rows_are_dropped_at_their_own_time(spark):
    flagged = sightings(spark, [*range(0, 700, 37), 1000, 1061, 1200]).union(spark.createDataFrame(
        [(1, 1, None, "b", 5 * S, 100), (1, 1, "a", None, 6 * S, 101)], sightings(spark, [0]).schema))
    packets = spark.createDataFrame([], "packet_id long, time_us long, dpid long, in_port int, eth_src string, "
                                        "eth_dst string, ethertype int")
    for slice_rows in (state.SLICE_ROWS, 4):
        acted = state.effective_action(flagged, state.block_episodes(flagged), packets, slice_rows).collect()
        assert len(acted) == flagged.count() and {r.action for r in acted} == {"drop"}


def test_bins_do_not_depend_on_the_clock(spark):
    base = [3, 50, 109, 170, 171, 300, 359, 360, 421]
    shape = None
    for shift in (0, 7, 59, 61):
        rows = state.block_episodes(sightings(spark, [s + shift for s in base])).orderBy("start_us").collect()
        found = [(r.start_us // S - shift, r.last_us // S - shift, r.sightings) for r in rows]
        shape = shape or found
        assert found == shape
    assert shape == [(3, 109, 3), (170, 171, 2), (300, 360, 3), (421, 421, 1)]


def test_other_states_change_no_registration(spark):
    events = spark.createDataFrame([(1, 5, 1, "MAIN"), (2, 6, 1, "CONFIG"), (3, 6, 2, "MAIN"), (4, 7, 2, "DEAD")],
                                   "event_id long, time_us long, dpid long, state string")
    assert [r.dpid for r in state.active_switches(events).collect()] == [1]
    assert [r.dpid for r in state.active_switches(events, state.CAPTURE_LEAVES).collect()] == [2]


def test_switches_and_candidates(spark):
    events = spark.createDataFrame([(1, 5, 1, "MAIN"), (2, 6, 1, "DEAD"), (3, 6, 2, "DEAD"), (4, 6, 2, "MAIN")],
                                   "event_id long, time_us long, dpid long, state string")
    active = state.active_switches(events)
    assert [r.dpid for r in active.collect()] == [2]
    flagged = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 2, None), (4, None, 1)],
                                    "flow_id long, dpid long, in_port int")
    assert [r.flow_id for r in state.block_candidates(flagged, active).collect()] == [2]
    lost = {r.flow_id: r.reason for r in state.unblockable(flagged, active).collect()}
    assert lost == {1: "inactive_switch", 3: "no_port", 4: "inactive_switch"}


def test_mac_lookup_learns_source_first(spark):
    packets = spark.createDataFrame([
        (1, 10, 1, 7, "a", "b", 2048), (2, 11, 1, 8, "b", "a", 2048), (3, 12, 1, 9, "a", "a", 2048),
        (4, 13, 1, 5, "c", "a", 35020), (5, 14, 1, 6, "d", "c", 2048),
    ], "packet_id long, time_us long, dpid long, in_port int, eth_src string, eth_dst string, ethertype int")
    got = {r.packet_id: r.out_port for r in state.mac_lookup(packets).collect()}
    assert got == {1: None, 2: 7, 3: 9, 5: None}
    table = {r.mac: r.in_port for r in state.mac_table(packets).collect()}
    assert table == {"a": 9, "b": 8, "d": 6}


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 0), (3, None, None, None), (4, None, 1, 1), (5, 1, None, 0)],
                               "id int, a int, b int, c int")
    cols = {m: F.col(m) for m in "abc"}
    weights = {"a": 0.9, "b": 0.6}
    rows = df.select("id", voting.weighted_vote(cols, weights).alias("literal"),
                     voting.weighted_vote(cols, weights, normalize=True).alias("fair")).collect()
    # c has no known weight, so it counts 1
    assert [tuple(r) for r in rows] == [(1, 1, 0), (2, 0, 0), (3, None, None), (4, 1, 1), (5, 1, 0)]
    assert [tuple(r) for r in voting.model_counts(df, ["a", "b"]).orderBy("model").collect()] == [
        ("a", 2, 3), ("b", 1, 3)]
    nothing = df.filter("id = 3").withColumn("verdict", F.lit(None).cast("int"))
    assert voting.verdict_summary(nothing).isEmpty()


def test_report_with_an_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, p int")
    rows = {r["class"]: r for r in evaluate.class_report(df, "p").collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1, rows["1"].support) == (0.0, 0.0, 0.0, 2)
    assert rows["0"].precision == 1 / 3 and rows["macro avg"].recall == 0.5


def test_profile_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"7": [{"match": {"dl_type": "2054", "nw_src": "1.1.1.1"}, "packet_count": 3, "byte_count": 9}, {"match": {}}]}')
    (tmp_path / "b.json").write_text('{"8": []}')
    (tmp_path / "switches").mkdir()
    (tmp_path / "switches" / "s.json").write_text("[7, 8]")
    flows = flow_json.read_flow_documents(spark, str(tmp_path / "*.json"))
    switches = flow_json.read_switch_documents(spark, str(tmp_path / "switches"))
    assert sorted((r.dpid, r.flows) for r in profile.flows_per_switch(switches, flows).collect()) == [(7, 2), (8, 0)]
    assert sorted((r.eth_type, r.name, r.pct) for r in profile.ethertypes(flows).collect()) == [
        ("2054", "ARP (0x0806)", 50.0), ("N/A", "Não especificado", 50.0)]
    assert [(r.field, r.flows) for r in profile.ip_fields(flows).collect()] == [("nw_src", 1)]
    first = profile.first_flows(flows).collect()
    assert sorted((r.position, r.packet_count, r.field) for r in first if r.field) == [(1, 3, "dl_type"), (1, 3, "nw_src")]
    assert [(r.position, r.packet_count, r.value) for r in first if not r.field] == [(2, 0, None)]
    overall = [r for r in profile.summary(switches, flows).collect() if r.dpid is None][0]
    assert (overall.flows, overall.ip_flows, overall.has_ip_fields) == (2, 1, True)


def test_attack_capture_order(spark):
    rows = [(i, t * S, 1, p, 5, {"in_port": str(port), "eth_dst": d}, 1, 1)
            for i, (t, p, port, d) in enumerate([(0, 1, 2, "a"), (1, 1, 1, "b"), (2, 1, 1, "a"), (3, 0, 1, "a"), (11, 1, 1, "a")])]
    df = spark.createDataFrame(rows, "flow_id long, time_us long, dpid long, priority int, duration_sec long, "
                                     "match map<string,string>, packet_count long, byte_count long")
    got = capture.attack_capture(df).collect()
    assert [r.flow_id for r in got] == [2, 1, 0, 4] and {r.label for r in got} == {1}
    assert got[0].eth_src is None
