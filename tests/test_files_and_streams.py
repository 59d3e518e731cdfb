import pytest
from pyspark.sql import functions as F

from weirgate.functions import cleaning
from weirgate.functions.rules import judge
from weirgate.operators import capture
from weirgate.operators import state as batch_state
from weirgate.plans import views
from weirgate.schemas import FLOW_STATS
from weirgate.sources import flow_files
from weirgate.streaming import live, state

HEADER = "time_us,dpid,in_port,eth_src,eth_dst,packets,bytes,duration_sec\n"


def test_encodings(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + (HEADER + "1,1,NULL,é,NULL,1,1,1\n").encode("utf-8"))
    (tmp_path / "latin.csv").write_bytes((HEADER + "2,1,3,é,b,1,1,1\n").encode("latin-1"))
    (tmp_path / "plain.csv").write_text(HEADER + "3,NULL,3,a,b,1,1,1\n")
    rows = {r.time_us: r for r in flow_files.read_csv_any_encoding(spark, str(tmp_path), FLOW_STATS).collect()}
    assert rows[1].eth_src == "é" and rows[2].eth_src == "é"
    assert rows[1].in_port is None and rows[1].eth_dst is None and rows[3].dpid is None
    assert [r.file.rsplit("/", 1)[-1] for r in flow_files.non_utf8_files(spark, str(tmp_path)).collect()] == ["latin.csv"]
    only = flow_files.read_csv_any_encoding(spark, str(tmp_path / "latin.csv"), FLOW_STATS)
    assert [r.eth_src for r in only.collect()] == ["é"]


def rows_at(spark, *times):
    return spark.createDataFrame([(t, 1, 1, "a", "b", 1, 1, 1) for t in times], FLOW_STATS)


def test_create_append_archive(spark, tmp_path):
    one, two, three, old = (str(tmp_path / n) for n in ("one", "two", "three", "old"))
    flow_files.create_if_absent(spark, one, FLOW_STATS)
    flow_files.append(rows_at(spark, 1, 2), one)
    flow_files.create_if_absent(spark, one, FLOW_STATS)      # leaves the rows alone
    assert spark.read.parquet(one).count() == 2
    for _ in range(2):                                       # a retry archives nothing twice
        assert flow_files.archive(spark, one, old, two, FLOW_STATS).isEmpty()
    flow_files.append(rows_at(spark, 3), two)
    flow_files.archive(spark, two, old, three, FLOW_STATS)
    flow_files.archive(spark, three, old, str(tmp_path / "four"), FLOW_STATS)   # empty: nothing to archive
    assert sorted(r.time_us for r in flow_files.read_archive(spark, old, FLOW_STATS).collect()) == [1, 2, 3]


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError, match="scoring data is empty"):
        flow_files.require_rows(rows_at(spark, 1).limit(0), "scoring data")


def test_polls_restart_and_late_file(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "checkpoint"))

    def run():
        live.judge_to(live.read_polls(spark, landed, FLOW_STATS, 1), out, checkpoint, None).awaitTermination()
        return sorted(r.time_us for r in spark.read.parquet(out).collect())

    for t in (10, 20):
        flow_files.write_csv(rows_at(spark, t).coalesce(1), landed, mode="append")
    assert run() == [10, 20]
    assert run() == [10, 20]
    flow_files.write_csv(rows_at(spark, 5, 30).coalesce(1), landed, mode="append")     # 5 is late
    assert run() == [5, 10, 20, 30]


def test_retried_batch_repeats_nothing(spark, ev, tmp_path):
    flows = views.flow_stats(ev)
    pipeline = live.LivePipeline(
        views.add_votes, views.WEIGHTS, lambda: batch_state.active_switches(views.switch_state(ev)), str(tmp_path))
    for _ in range(2):
        pipeline.process(flows, 0)
    judged = judge(flows)
    kept = judged.filter(~F.col("blocked")).count()
    assert pipeline.read(spark, "stored").count() == pipeline.read(spark, "verdicts").count() == kept
    total = pipeline.read(spark, "summary").first()
    assert total.legitimate + total.attack == pipeline.read(spark, "verdicts").filter("verdict IS NOT NULL").count()


def test_streaming_state_equals_batch(spark, ev, tmp_path):
    landed = str(tmp_path / "landed")
    packets = views.packets(ev)
    packets.repartition(3).write.parquet(landed)
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = str(tmp_path / "out")
    state.upsert(state.learned_addresses(stream), out, str(tmp_path / "checkpoint")).awaitTermination()
    got = state.current(spark, out, ["dpid", "mac"]).select("dpid", "mac", "in_port")
    assert sorted(got.collect()) == sorted(batch_state.mac_table(packets).collect())


def test_streaming_episodes_equal_the_batch(spark, tmp_path):
    schema = "dpid long, in_port int, eth_src string, eth_dst string, time_us long"
    landed, out, checkpoint = (str(tmp_path / p) for p in ("landed", "out", "checkpoint"))
    polls = [[0, 60, 400], [120, 500, 30], [59, 130, 1000]]  # late sightings join bins already written
    for poll in polls:
        rows = [(1, 1, m, "b", t * 1_000_000) for t in poll for m in ("a", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).parquet(landed)
        state.upsert(state.block_sightings(stream), out, checkpoint).awaitTermination()
    got = sorted(map(str, state.block_episodes(spark, out).collect()))
    assert got == sorted(map(str, batch_state.block_episodes(spark.read.schema(schema).parquet(landed)).collect()))
    assert len(got) == 8


def test_time_filter_skips_days(spark, tmp_path):
    day = 86_400_000_000
    path = str(tmp_path / "flows")
    flow_files.append_by_day(rows_at(spark, 5, day + 5, day + 9, 2 * day), path)
    newer = cleaning.newer_than(spark.read.parquet(path), day + 5)
    assert sorted(r.time_us for r in newer.collect()) == [day + 9, 2 * day]
    files = [f for f in newer.inputFiles()]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for written, read in (("America/Sao_Paulo", "UTC"), ("UTC", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", written)
            other = str(tmp_path / written.replace("/", "-"))
            flow_files.append_by_day(rows_at(spark, day + 5, day + 9, 2 * day - 1), other)
            spark.conf.set("spark.sql.session.timeZone", read)
            assert cleaning.newer_than(spark.read.parquet(other), day + 5).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert files and "PartitionFilters: [isnotnull(day" in newer._jdf.queryExecution().toString()


def test_captures_run_as_streams(spark, ev, tmp_path):
    entries = views.match_maps(ev)
    landed = str(tmp_path / "landed")
    entries.write.parquet(landed)
    stream = spark.readStream.schema(entries.schema).parquet(landed)
    for name, rows in (("normal", capture.normal_capture), ("attack", capture.attack_capture)):
        live.store(rows(stream), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), None).awaitTermination()
        got = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.flow_id for r in got.collect()) == sorted(r.flow_id for r in rows(entries).collect())


def test_high_water_mark(spark):
    assert [r.time_us for r in cleaning.newer_than(rows_at(spark, 1, 2, 3), 2).collect()] == [3]
