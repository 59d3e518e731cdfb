"""The same answers as standalone DuckDB SQL over the raw tables.

Written independently of the Spark code: no text is shared between the two.
"""

from __future__ import annotations

from weirgate.plans import catalog
from weirgate.plans.views import RESPONSE_FLOWS, WEIGHTS
from weirgate.schemas import CATEGORICAL, MODEL_NAMES, NUMERIC

ORACLES: dict[str, str] = {}

VIEWS: dict[str, tuple[list[str], str]] = {
    "e": ([], """
        SELECT event_id, user_id, event_type, value, epoch_us(ts) AS time_us,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
        FROM events"""),
    "flow_raw": (["e"], """
        SELECT event_id AS flow_id, time_us,
          CASE WHEN k = 99 THEN NULL ELSE user_id % 3 + 1 END AS dpid,
          CASE WHEN k = 98 THEN NULL ELSE CAST(user_id % 6 + 1 AS INT) END AS in_port,
          CASE WHEN k = 98 THEN 'NULL' WHEN k = 13 THEN '00:00:00:00:00:00' WHEN k = 14 THEN 'ff:ff:ff:ff:ff:ff'
               ELSE concat('00:00:00:00:00:0', CAST(user_id % 6 + 1 AS STRING)) END AS eth_src,
          CASE WHEN k = 98 THEN 'NULL' WHEN k = 15 THEN 'AA:aa:AA:aa:AA:aa:'
               ELSE concat('00:00:00:00:00:0', CAST(event_id * 7 % 6 + 1 AS STRING)) END AS eth_dst,
          CAST(floor(value * 100) AS BIGINT) * (k + 1) AS packets,
          CAST(floor(value * 100) AS BIGINT) * (k + 1) * (64 + event_id % 1400) AS bytes,
          event_id % 4000 AS duration_sec,
          CAST(CASE WHEN k IN (98, 99) THEN 0 ELSE 1 END AS INT) AS priority,
          CASE WHEN k = 97 THEN CAST(NULL AS INT) WHEN event_type = 'error' OR value > 60 THEN 1 ELSE 0 END AS label
        FROM e"""),
    "flow_stats": (["flow_raw"], """
        SELECT * REPLACE (nullif(eth_src, 'NULL') AS eth_src, nullif(eth_dst, 'NULL') AS eth_dst) FROM flow_raw"""),
    "flow_features": (["e"], """
        SELECT time_us AS timestamp, event_id AS flow_id, user_id % 3 + 1 AS datapath_id,
          concat('10.1.1.', CAST(user_id % 6 + 1 AS STRING)) AS ip_src,
          concat('10.1.1.', CAST(event_id * 7 % 6 + 1 AS STRING)) AS ip_dst,
          concat('00:00:00:00:00:0', CAST(user_id % 6 + 1 AS STRING)) AS eth_src,
          concat('00:00:00:00:00:0', CAST(event_id * 7 % 6 + 1 AS STRING)) AS eth_dst,
          CASE WHEN k % 10 = 0 THEN NULL WHEN k % 2 = 0 THEN 443 ELSE 80 END AS tp_src,
          CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(1024 + k % 7 AS INT) END AS tp_dst,
          CASE WHEN k % 10 = 0 THEN 1 WHEN k % 3 = 0 THEN 17 ELSE 6 END AS ip_proto,
          CASE WHEN k % 10 = 0 THEN 0 ELSE NULL END AS icmp_code,
          CASE WHEN k % 10 = 0 THEN 8 ELSE NULL END AS icmp_type,
          CASE WHEN k % 4 = 0 THEN 'S' WHEN k % 4 = 1 THEN 'SA' ELSE NULL END AS flags,
          CASE WHEN k = 55 THEN NULL ELSE CAST(ds AS DOUBLE) END AS flow_duration_sec,
          CAST(dns AS DOUBLE) AS flow_duration_nsec,
          CAST(CASE WHEN k % 5 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS idle_timeout,
          CAST(0 AS DOUBLE) AS hard_timeout,
          CAST(p AS DOUBLE) AS packet_count, CAST(bt AS DOUBLE) AS byte_count,
          CASE WHEN ds = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(p AS DOUBLE) / ds END AS packet_count_per_second,
          CASE WHEN dns = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(p AS DOUBLE) / dns END AS packet_count_per_nsecond,
          CASE WHEN ds = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(bt AS DOUBLE) / ds END AS byte_count_per_second,
          CASE WHEN dns = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(bt AS DOUBLE) / dns END AS byte_count_per_nsecond,
          CASE WHEN k = 97 THEN CAST(NULL AS INT) WHEN event_type = 'error' OR value > 60 THEN 1 ELSE 0 END AS label
        FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) * (k + 1) AS p,
                CAST(floor(value * 100) AS BIGINT) * (k + 1) * (64 + event_id % 1400) AS bt,
                event_id % 4000 AS ds, (event_id * 7919) % 1000000000 AS dns FROM e)"""),
    "voted": (["flow_stats"], """
        SELECT *, label AS y,
          (label + CAST(flow_id % 37 = 0 AS INT)) % 2 AS knn,
          (label + CAST(flow_id % 53 = 0 AS INT)) % 2 AS random_forest,
          CASE WHEN flow_id % 101 = 0 THEN NULL ELSE (label + CAST(flow_id % 41 = 0 AS INT)) % 2 END AS decision_tree,
          CAST(NULL AS INT) AS svm
        FROM flow_stats WHERE label IS NOT NULL"""),
    "scores": (["voted"], f"""
        SELECT *, coalesce(knn * {WEIGHTS['knn']}::DOUBLE, 0) + coalesce(random_forest * {WEIGHTS['random_forest']}::DOUBLE, 0)
             + coalesce(decision_tree * {WEIGHTS['decision_tree']}::DOUBLE, 0) + coalesce(svm * {WEIGHTS['svm']}::DOUBLE, 0) AS mass,
          CASE WHEN knn IS NULL THEN 0 ELSE {WEIGHTS['knn']}::DOUBLE END
             + CASE WHEN random_forest IS NULL THEN 0 ELSE {WEIGHTS['random_forest']}::DOUBLE END
             + CASE WHEN decision_tree IS NULL THEN 0 ELSE {WEIGHTS['decision_tree']}::DOUBLE END
             + CASE WHEN svm IS NULL THEN 0 ELSE {WEIGHTS['svm']}::DOUBLE END AS weight
        FROM voted"""),
    "judged": (["scores"], """
        SELECT *, CAST(mass > 0.5 AS INT) AS literal, CAST(mass / weight > 0.5 AS INT) AS normalized FROM scores"""),
    "flagged": (["judged"], "SELECT * FROM judged WHERE normalized = 1"),
    "switch_state": ([], """
        SELECT event_id, epoch_us(ts) AS time_us, user_id % 3 + 1 AS dpid,
          CASE event_type WHEN 'signup' THEN 'MAIN' ELSE 'DEAD' END AS state
        FROM events WHERE event_type IN ('signup', 'error')"""),
    "latest": (["switch_state"], """
        SELECT dpid, state FROM (
          SELECT *, row_number() OVER (PARTITION BY dpid ORDER BY time_us DESC, event_id DESC) AS r FROM switch_state)
        WHERE r = 1"""),
    "active": (["latest"], "SELECT dpid FROM latest WHERE state = 'MAIN'"),
    "packets": (["flow_raw"], """
        SELECT flow_id AS packet_id, time_us, dpid, in_port, eth_src, eth_dst,
          CASE WHEN flow_id % 10 = 0 THEN 35020 WHEN flow_id % 10 < 3 THEN 2054 ELSE 2048 END AS ethertype
        FROM flow_raw WHERE dpid IS NOT NULL AND in_port IS NOT NULL"""),
    "lookups": (["packets"], """
        SELECT packet_id, time_us, dpid, eth_dst, last_value(port IGNORE NULLS) OVER (
            PARTITION BY dpid, mac ORDER BY time_us, packet_id, q
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS out_port, q
        FROM (SELECT packet_id, time_us, dpid, eth_dst, eth_src AS mac, in_port AS port, 0 AS q
              FROM packets WHERE ethertype <> 35020
              UNION ALL
              SELECT packet_id, time_us, dpid, eth_dst, eth_dst, NULL, 1 FROM packets WHERE ethertype <> 35020)"""),
    "episodes": (["flagged"], f"""
        SELECT dpid, in_port, eth_src, eth_dst, min(time_us) AS start_us, max(time_us) AS last_us,
          max(time_us) + {min(catalog.IDLE_SECONDS, catalog.HARD_SECONDS) * 1_000_000} AS end_us,
          count(*) AS sightings, 100 AS priority
        FROM (SELECT *, sum(fresh) OVER w AS episode
              FROM (SELECT *, CASE WHEN time_us - lag(time_us) OVER w <= {min(catalog.IDLE_SECONDS, catalog.HARD_SECONDS) * 1_000_000}
                               THEN 0 ELSE 1 END AS fresh
                    FROM flagged WHERE dpid IS NOT NULL AND in_port IS NOT NULL
                    WINDOW w AS (PARTITION BY dpid, in_port, eth_src, eth_dst ORDER BY time_us, flow_id))
              WINDOW w AS (PARTITION BY dpid, in_port, eth_src, eth_dst ORDER BY time_us, flow_id))
        GROUP BY dpid, in_port, eth_src, eth_dst, episode"""),
    "flow_fields": (["flow_stats"], f"""
        SELECT flow_id, dpid, flow_id // {RESPONSE_FLOWS} AS poll_id, packets, bytes,
          row_number() OVER (PARTITION BY dpid, flow_id // {RESPONSE_FLOWS} ORDER BY flow_id) AS position,
          unnest([{{'f': 'in_port', 'v': CAST(in_port AS VARCHAR)}}, {{'f': 'eth_src', 'v': eth_src}},
                  {{'f': 'eth_dst', 'v': eth_dst}},
                  {{'f': 'eth_type', 'v': CASE WHEN flow_id % 3 = 0 THEN '2048' END}},
                  {{'f': 'dl_type', 'v': CASE WHEN flow_id % 3 = 1 THEN '0x0806' END}},
                  {{'f': 'ipv4_src', 'v': CASE WHEN flow_id % 4 = 0 THEN '10.1.1.1' END}}]) AS kv
        FROM flow_stats WHERE dpid IS NOT NULL AND in_port IS NOT NULL"""),
    "fields": (["flow_fields"], """
        SELECT * EXCLUDE (kv), kv.f AS field, kv.v AS value FROM flow_fields WHERE kv.v IS NOT NULL"""),
    "totals": (["flow_stats"], """
        SELECT dpid, count(*) AS total FROM flow_stats
        WHERE dpid IS NOT NULL AND in_port IS NOT NULL GROUP BY dpid"""),
    "clean": (["flow_features"], "SELECT flow_id, label, " + ", ".join(
        f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in NUMERIC)
        + " FROM flow_features WHERE label IS NOT NULL"),
    "filled": (["clean"], "SELECT flow_id, label, " + ", ".join(
        f"coalesce({c}, (SELECT median({c}) FROM clean), 0) AS {c}" for c in NUMERIC) + " FROM clean"),
    "cells": (["filled"], "SELECT flow_id, label, unnest([" + ", ".join(
        f"{{'i': {i}, 'f': '{c}', 'v': {c}}}" for i, c in enumerate(NUMERIC)) + "]) AS s FROM filled"),
    "numbers": (["cells"], "SELECT flow_id, label, 0 AS block, s.i AS col, '' AS category, s.f AS feature, s.v AS v FROM cells"),
    "spread": (["numbers"], """
        SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM numbers GROUP BY feature"""),
    "scaled": (["numbers", "spread"], """
        SELECT flow_id, label, block, col, category, feature,
               (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v
        FROM numbers JOIN spread USING (feature)"""),
    "cats": (["flow_features"], "SELECT flow_id, label, s.i AS col, s.f AS col_name, s.v AS category FROM ("
             "SELECT flow_id, label, unnest([" + ", ".join(
                 f"{{'i': {i}, 'f': '{c}', 'v': coalesce(CAST({c} AS VARCHAR), 'unknown')}}"
                 for i, c in enumerate(CATEGORICAL)) + "]) AS s FROM flow_features)"),
    "vocabulary": (["cats"], """
        SELECT DISTINCT col, col_name, category FROM cats WHERE label IS NOT NULL"""),
    "hot": (["cats", "vocabulary"], """
        SELECT c.flow_id, c.label, 1 AS block, v.col, v.category, concat(v.col_name, '_', v.category) AS feature,
               CAST(c.category = v.category AS DOUBLE) AS v
        FROM cats c JOIN vocabulary v ON c.col = v.col"""),
    "matrix": (["scaled", "hot"], """
        SELECT * FROM scaled UNION ALL SELECT * FROM hot WHERE label IS NOT NULL"""),
    "by_class": (["matrix"], """
        SELECT block, col, category, feature, label, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_pop(v) AS s
        FROM matrix GROUP BY ALL"""),
    "anova": (["by_class"], """
        SELECT block, col, category, feature,
          CASE WHEN within > 1e-12 THEN (between_ / (classes - 1)) / (within / (total - classes)) END AS f
        FROM (SELECT block, col, category, feature, sum(n * s) AS within, count(*) AS classes, sum(n) AS total,
                sum(n * (m - grand) * (m - grand)) AS between_
              FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS grand FROM by_class
                    WINDOW w AS (PARTITION BY block, col, category))
              GROUP BY block, col, category, feature)"""),
    "best": (["anova"], f"""
        SELECT *, row_number() OVER (ORDER BY block, col, category) AS position
        FROM (SELECT * FROM anova ORDER BY round(f, 9) DESC NULLS LAST, block DESC, col DESC, category DESC
              LIMIT {catalog.TOP_K})"""),
    "live": (["flow_stats"], "SELECT flow_id, " + ", ".join({
        "packet_count": "CAST(packets AS DOUBLE)", "byte_count": "CAST(bytes AS DOUBLE)",
        "flow_duration_sec": "CAST(duration_sec AS DOUBLE)",
        "packet_count_per_second": "CASE WHEN duration_sec > 0 THEN packets / duration_sec ELSE 0 END",
        "byte_count_per_second": "CASE WHEN duration_sec > 0 THEN bytes / duration_sec ELSE 0 END",
    }.get(c, "CAST(0 AS DOUBLE)") + f" AS {c}" for c in NUMERIC) + ", "
        + ", ".join(f"'unknown' AS {c}" for c in CATEGORICAL) + " FROM flow_stats"),
    "near": (["scaled"], "SELECT flow_id, any_value(label) AS label, " + ", ".join(
        f"max(v) FILTER (WHERE feature = '{c}') AS x{i + 1}" for i, c in enumerate(catalog.NEAR_FEATURES))
        + " FROM scaled GROUP BY flow_id"),
    "capped": (["near"], """
        SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', flow_id))) <= 2000"""),
}


def _uniform(text: str) -> str:
    return f"(CAST(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _with(names: list[str]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order) + "\n"


def oracle(key: str, needs: list[str], body: str) -> None:
    ORACLES[f"q_{key}"] = _with(needs) + body


def _sig(expr: str) -> str:
    return f"CAST(format('{{:.8e}}', {expr}) AS DOUBLE)"


FEATURES = NUMERIC + CATEGORICAL
NO_INF = ", ".join(f"CASE WHEN isinf({c}) THEN NULL ELSE {c} END AS {c}" for c in NUMERIC)
RATES = """CASE WHEN duration_sec > 0 THEN packets / duration_sec ELSE 0 END > 10000
  OR CASE WHEN duration_sec > 0 THEN bytes / duration_sec ELSE 0 END > 100000000"""


def _literal_mac(m: str) -> str:
    return (f"coalesce(starts_with({m}, '00:00:00:00:00:00') OR (regexp_matches({m}, '^[0-9A-Fa-f]{{2}}:') "
            f"AND length({m}) >= 18 AND lower(substr({m}, 1, 18)) = repeat(lower(substr({m}, 1, 3)), 6)), false)")


def _repeated_mac(m: str) -> str:
    return (f"coalesce(starts_with({m}, '00:00:00:00:00:00') OR (regexp_matches({m}, '^[0-9A-Fa-f]{{2}}:') "
            f"AND lower({m}) = concat(repeat(lower(substr({m}, 1, 3)), 5), lower(substr({m}, 1, 2)))), false)")


TESTS = f"""CASE WHEN {RATES} THEN 'high_volume' END, CASE WHEN duration_sec > 3600 THEN 'long_connection' END,
  CASE WHEN {_literal_mac('eth_src')} THEN 'invalid_src_mac' END,
  CASE WHEN {_literal_mac('eth_dst')} THEN 'invalid_dst_mac' END"""
FIRED = f"concat_ws(',', {TESTS})"

RECORD = "flow_id, time_us, dpid, in_port, eth_src, eth_dst, packets, bytes, duration_sec"

oracle("csv_roundtrip", ["flow_features"], f"SELECT * REPLACE ({NO_INF}) FROM flow_features")
oracle("csv_encodings", ["flow_features"], "SELECT flow_id, 'é' || flags AS flags, ip_src FROM flow_features")
oracle("null_sentinel", ["flow_raw"], """SELECT flow_id, CAST(in_port AS BIGINT) AS in_port,
  nullif(eth_src, 'NULL') AS eth_src, nullif(eth_dst, 'NULL') AS eth_dst FROM flow_raw""")
oracle("json_flows", ["flow_stats"], f"""SELECT dpid, flow_id // {RESPONSE_FLOWS} AS poll_id,
  CAST(row_number() OVER (PARTITION BY dpid, flow_id // {RESPONSE_FLOWS} ORDER BY flow_id) AS INT) AS position,
  CAST(in_port AS VARCHAR) AS in_port, eth_src, eth_dst, packets AS packet_count, bytes AS byte_count
FROM flow_stats WHERE dpid IS NOT NULL AND in_port IS NOT NULL""")
oracle("json_switches", ["flow_stats"], f"""SELECT DISTINCT flow_id // {RESPONSE_FLOWS} AS poll_id, dpid
FROM flow_stats WHERE dpid IS NOT NULL""")
oracle("archive_union", ["flow_stats"], "SELECT * FROM flow_stats")

oracle("flow_project", ["flow_stats"], f"SELECT {RECORD} FROM flow_stats")
oracle("label_union", ["flow_stats"], f"""SELECT {RECORD}, 0 AS label FROM flow_stats
UNION ALL SELECT {RECORD}, 1 AS label FROM flow_stats WHERE priority = 1""")
oracle("attack_capture", ["flow_stats"], f"""SELECT {RECORD}, 1 AS label, time_us // 10000000 AS poll,
  CAST(row_number() OVER (PARTITION BY time_us // 10000000, dpid ORDER BY in_port NULLS FIRST, eth_dst NULLS FIRST, flow_id) AS INT) AS position
FROM flow_stats WHERE priority = 1""")
oracle("drop_null_label", ["flow_features"], "SELECT flow_id, label FROM flow_features WHERE label IS NOT NULL")
oracle("feature_columns", ["flow_features"],
       f"SELECT {NO_INF}, {', '.join(CATEGORICAL)} FROM flow_features WHERE label IS NOT NULL")
oracle("inf_to_null", ["flow_features"], f"SELECT flow_id, {NO_INF} FROM flow_features")
oracle("missing_columns", ["flow_features"], "SELECT flow_id, " + ", ".join(
    c if c == "packet_count" else f"CAST(0 AS DOUBLE) AS {c}" for c in NUMERIC) + ", " + ", ".join(
    c if c == "flags" else f"'unknown' AS {c}" for c in CATEGORICAL) + " FROM flow_features")
oracle("fill_unknown", ["flow_features"], "SELECT flow_id, " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'unknown') AS {c}" for c in CATEGORICAL) + " FROM flow_features")
oracle("rule_high_volume", ["flow_stats"], f"SELECT flow_id, ({RATES}) AS high_volume FROM flow_stats")
oracle("rule_long_connection", ["flow_stats"],
       "SELECT flow_id, duration_sec > 3600 AS long_connection FROM flow_stats")
oracle("rule_invalid_mac", ["flow_stats"], f"""SELECT flow_id,
  {_literal_mac('eth_src')} AS eth_src_literal, {_repeated_mac('eth_src')} AS eth_src_repeated_octet,
  {_literal_mac('eth_dst')} AS eth_dst_literal, {_repeated_mac('eth_dst')} AS eth_dst_repeated_octet
FROM flow_stats""")
oracle("rules_split", ["flow_stats"], f"""SELECT flow_id, dpid, in_port, eth_src, eth_dst, packets, bytes, duration_sec,
  CASE WHEN {FIRED} <> '' THEN 'block' ELSE 'store' END AS route, {FIRED} AS reasons
FROM flow_stats""")
oracle("rule_reasons", ["flow_stats"], f"""SELECT dpid, reason, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT dpid, bytes, unnest([{TESTS}]) AS reason FROM flow_stats) WHERE reason IS NOT NULL GROUP BY dpid, reason""")
oracle("high_water", ["flow_stats"],
       f"SELECT flow_id, time_us FROM flow_stats WHERE time_us > {catalog.MARK_US}")
oracle("flagged_flows", ["judged"], """SELECT flow_id, dpid, in_port, eth_src, eth_dst, literal AS prediction
FROM judged WHERE literal = 1""")
oracle("drop_lldp", ["packets"], "SELECT packet_id, ethertype FROM packets WHERE ethertype <> 35020")
oracle("dpid_format", ["flow_stats"], """SELECT flow_id, lpad(CAST(dpid AS VARCHAR), 16, '0') AS dpid_decimal,
  lpad(lower(to_hex(dpid)), 16, '0') AS dpid_hex FROM flow_stats""")
oracle("live_features", ["live"], f"SELECT flow_id, {', '.join(FEATURES)} FROM live")

oracle("block_candidates", ["flagged", "active"], """SELECT flow_id, dpid, in_port, eth_src, eth_dst
FROM flagged WHERE in_port IS NOT NULL AND dpid IN (SELECT dpid FROM active)""")
oracle("unblockable", ["flagged", "active"], """SELECT flow_id, dpid, in_port,
  CASE WHEN known IS NULL THEN 'inactive_switch' ELSE 'no_port' END AS reason
FROM (SELECT f.*, a.dpid AS known FROM flagged f LEFT JOIN active a ON f.dpid = a.dpid)
WHERE known IS NULL OR in_port IS NULL""")
oracle("mac_asof", ["lookups"], "SELECT packet_id, dpid, eth_dst, out_port FROM lookups WHERE q = 1")
oracle("mac_table", ["packets"], """SELECT dpid, eth_src AS mac, in_port FROM packets WHERE ethertype <> 35020
QUALIFY row_number() OVER (PARTITION BY dpid, eth_src ORDER BY time_us DESC, packet_id DESC) = 1""")
oracle("active_switches", ["latest"], "SELECT dpid, state FROM latest")
oracle("block_episodes", ["episodes"], "SELECT * FROM episodes")
oracle("effective_action", ["flow_stats", "episodes", "packets"], """
, learned AS (SELECT dpid, eth_src AS mac, min(struct_pack(t := time_us, i := packet_id)) AS since
              FROM packets WHERE ethertype <> 35020 GROUP BY dpid, eth_src),
acted AS (SELECT f.flow_id, f.dpid, f.in_port, f.eth_src, f.eth_dst,
    EXISTS (SELECT 1 FROM episodes e WHERE e.dpid = f.dpid AND e.in_port = f.in_port
            AND e.eth_src IS NOT DISTINCT FROM f.eth_src AND e.eth_dst IS NOT DISTINCT FROM f.eth_dst AND f.time_us >= e.start_us AND f.time_us < e.end_us) AS dropped,
    coalesce(l.since <= struct_pack(t := f.time_us, i := f.flow_id), false) AS known
  FROM flow_stats f LEFT JOIN learned l ON l.dpid = f.dpid AND l.mac = f.eth_dst
  WHERE f.dpid IS NOT NULL AND f.in_port IS NOT NULL)
SELECT flow_id, dpid, in_port, eth_src, eth_dst,
  CASE WHEN dropped THEN 'drop' WHEN known THEN 'forward' ELSE 'controller' END AS action,
  CASE WHEN dropped THEN 100 WHEN known THEN 1 ELSE 0 END AS priority FROM acted""")

oracle("vote_literal", ["judged"], "SELECT flow_id, y, literal AS verdict FROM judged")
oracle("vote_normalized", ["judged"], "SELECT flow_id, y, normalized AS verdict FROM judged")
VOTES = " UNION ALL ".join(f"SELECT '{m}' AS model, y, {m} AS p FROM voted WHERE {m} IS NOT NULL" for m in MODEL_NAMES)
oracle("model_counts", ["voted"], f"""SELECT model, CAST(sum(p) AS BIGINT) AS flagged, count(*) AS total
FROM ({VOTES}) GROUP BY model""")
oracle("verdict_summary", ["judged"], """SELECT count(*) FILTER (WHERE normalized = 0) AS legitimate,
  count(*) FILTER (WHERE normalized = 1) AS attack,
  round(100.0::DOUBLE * count(*) FILTER (WHERE normalized = 1) / count(*), 4) AS attack_pct FROM judged""")
oracle("accuracy", ["voted"], f"SELECT model, round(avg(CAST(y = p AS INT)), 9) AS accuracy FROM ({VOTES}) GROUP BY model")
oracle("confusion", ["voted"], """SELECT y, count(*) FILTER (WHERE decision_tree = 0) AS predicted_0,
  count(*) FILTER (WHERE decision_tree = 1) AS predicted_1 FROM voted WHERE decision_tree IS NOT NULL GROUP BY y""")
oracle("class_report", ["voted"], """
, r AS (SELECT c, CAST(count(*) FILTER (WHERE y = c AND decision_tree = c) AS DOUBLE) AS tp,
    count(*) FILTER (WHERE decision_tree = c) AS pp, count(*) FILTER (WHERE y = c) AS support
  FROM voted, (VALUES (0), (1)) t(c) WHERE decision_tree IS NOT NULL GROUP BY c),
m AS (SELECT c, coalesce(tp / nullif(pp, 0), 0) AS precision_, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM r),
f AS (SELECT *, coalesce(2.0::DOUBLE * precision_ * recall / nullif(precision_ + recall, 0), 0) AS f1 FROM m)
SELECT "class", round(p, 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT CAST(c AS VARCHAR) AS "class", precision_ AS p, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision_), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision_ * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)""")
oracle("auc", ["scores"], """
, s AS (SELECT 'vote_share' AS score, y, mass / weight AS v FROM scores
        UNION ALL SELECT 'duration_sec', y, CAST(duration_sec AS DOUBLE) FROM scores),
g AS (SELECT score, v, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY score, v),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY score ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_ FROM g)
SELECT score, round(CAST(sum(pos * (lower_ + neg / 2.0::DOUBLE)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c GROUP BY score""")
SCORE = f"""
, k AS (SELECT model AS algorithm, CAST(count(*) FILTER (WHERE p = 1 AND y = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE p = 1 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE p = 0 AND y = 1) AS DOUBLE) AS fn,
    CAST(count(*) FILTER (WHERE p = 0 AND y = 0) AS DOUBLE) AS tn FROM ({VOTES}) GROUP BY model),
m AS (SELECT algorithm, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall,
    2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS auc FROM k),
t AS (SELECT algorithm, round(accuracy, 4) AS accuracy, round("precision", 4) AS "precision", round(recall, 4) AS recall,
    round(f1, 4) AS f1, round(auc, 4) AS auc FROM m)
"""
oracle("score_table", ["voted"], SCORE + "SELECT * FROM t")
oracle("score_long", ["voted"], SCORE + "SELECT algorithm, metric, score FROM t UNPIVOT (score FOR metric IN "
       "(accuracy, \"precision\", recall, f1, auc))")

oracle("field_freq", ["fields", "totals"], """SELECT dpid, field, count(*) AS flows,
  round(count(*) * 100.0::DOUBLE / any_value(total), 4) AS pct,
  CAST(row_number() OVER (PARTITION BY dpid ORDER BY field) AS INT) AS position FROM fields JOIN totals USING (dpid) GROUP BY dpid, field""")
oracle("ip_fields", ["fields"], """SELECT dpid, field, count(*) AS flows FROM fields
WHERE field IN ('ipv4_src', 'ipv4_dst', 'nw_src', 'nw_dst', 'ip_src', 'ip_dst', 'IPv4_src', 'IPv4_dst') GROUP BY dpid, field""")
oracle("ethertype_dist", ["flow_stats", "totals"], """
, t AS (SELECT dpid, CASE flow_id % 3 WHEN 0 THEN '2048' WHEN 1 THEN '0x0806' ELSE 'N/A' END AS eth_type FROM flow_stats
        WHERE dpid IS NOT NULL AND in_port IS NOT NULL)
SELECT dpid, eth_type, CASE eth_type WHEN '2048' THEN 'IPv4 (0x0800)' WHEN '0x0806' THEN 'ARP' ELSE 'Não especificado' END AS name,
  count(*) AS flows, round(count(*) * 100.0::DOUBLE / any_value(total), 4) AS pct,
  CAST(row_number() OVER (PARTITION BY dpid ORDER BY eth_type) AS INT) AS position
FROM t JOIN totals USING (dpid) GROUP BY dpid, eth_type""")
oracle("flows_per_switch", ["flow_stats", "totals"], """SELECT dpid, coalesce(total, 0) AS flows
FROM (SELECT DISTINCT dpid FROM flow_stats WHERE dpid IS NOT NULL) LEFT JOIN totals USING (dpid)""")
oracle("first_flows", ["fields"], """SELECT dpid, poll_id, CAST(position AS INT) AS position, packets AS packet_count,
  bytes AS byte_count, field, value FROM fields WHERE position <= 5""")
oracle("profile_summary", ["flow_stats"], """SELECT dpid, count(in_port) AS flows,
  count(*) FILTER (WHERE in_port IS NOT NULL AND flow_id % 4 = 0) AS ip_flows,
  count(*) FILTER (WHERE in_port IS NOT NULL AND flow_id % 4 = 0) > 0 AS has_ip_fields
FROM flow_stats WHERE dpid IS NOT NULL GROUP BY ROLLUP (dpid)""")

oracle("class_counts", ["flow_features"], "SELECT label, count(*) AS n FROM flow_features GROUP BY label")
oracle("stratified_cap", ["flow_features"], """SELECT flow_id, label FROM flow_features WHERE label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', flow_id))) <= 2000""")
oracle("row_cap", ["flow_features"], f"""SELECT flow_id, label FROM flow_features
ORDER BY md5(concat('42:', flow_id)) LIMIT {catalog.ROW_CAP}""")
oracle("split", ["flow_features"], f"""SELECT flow_id, {_uniform("concat('42:split:', flow_id)")} < 0.3 AS is_test,
  CAST(floor({_uniform("concat('42:fold:', flow_id)")} * 5) AS INT) AS fold FROM flow_features""")



def _dealt(folds: int) -> str:
    """Fold of a row: its place within its class, in the order of a hash, dealt in turn."""
    return f"CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:fold:', flow_id))) - 1) % {folds} AS INT)"


oracle("stratified_folds", ["flow_features"], f"SELECT flow_id, label, {_dealt(5)} AS fold FROM flow_features")
oracle("median", ["clean"], "SELECT feature, median(v) AS median FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v FROM clean" for c in NUMERIC) + ") GROUP BY feature")
oracle("scale_stats", ["spread"], f"""SELECT feature, {_sig('m')} AS mean,
  {_sig('CASE WHEN s = 0 THEN 1 ELSE s END')} AS deviation FROM spread""")
oracle("categories", ["vocabulary"], "SELECT col_name AS \"column\", category FROM vocabulary")
oracle("impute", ["filled"], f"SELECT flow_id, {', '.join(NUMERIC)} FROM filled")
oracle("standardise", ["scaled"], "SELECT flow_id, feature, round(v, 6) AS value FROM scaled")
oracle("one_hot", ["hot"], "SELECT flow_id, feature, v AS value FROM hot")
oracle("anova_f", ["anova"], "SELECT feature, round(f, 6) AS f FROM anova")
oracle("select_k_best", ["best"],
       "SELECT CAST(position AS INT) AS position, feature, round(f, 6) AS f FROM best")
oracle("features_long", ["matrix", "best"], """SELECT flow_id, m.feature, round(v, 6) AS value
FROM matrix m JOIN best b USING (block, col, category)""")
oracle("features_score", ["live", "best", "spread"], "SELECT flow_id, b.feature, round(CASE WHEN b.block = 1 THEN "
       "CAST(b.category = 'unknown' AS DOUBLE) ELSE (n.v - s.m) / CASE WHEN s.s = 0 THEN 1 ELSE s.s END END, 6) AS value\n"
       "FROM (SELECT flow_id, unnest([" + ", ".join(f"{{'f': '{c}', 'v': {c}}}" for c in NUMERIC)
       + "], recursive := true) FROM live) n\nJOIN best b ON b.block = 0 AND b.feature = n.f OR b.block = 1 AND n.f = 'packet_count'\n"
       "LEFT JOIN spread s ON s.feature = b.feature")

DISTANCE2 = "sqrt(" + " + ".join(f"(q.x{i} - t.x{i}) * (q.x{i} - t.x{i})" for i in (1, 2, 3)) + ")"
DISTANCE1 = " + ".join(f"abs(q.x{i} - t.x{i})" for i in (1, 2, 3))
oracle("knn_predict", ["near", "capped"], f"""
, found AS (SELECT q.flow_id, any_value(q.label) AS y,
    min_by(t.label, struct_pack(d := {DISTANCE2}, i := t.flow_id), 5) AS labels
  FROM near q, capped t GROUP BY q.flow_id)
SELECT flow_id, y, CAST(list_sum(labels) * 2 > len(labels) AS INT) AS prediction FROM found""")
oracle("knn_grid", ["capped"], f"""
, f AS (SELECT *, {_dealt(3)} AS fold FROM capped),
found AS (SELECT q.flow_id, p.p, any_value(q.label) AS y, any_value(q.fold) AS fold,
    min(struct_pack(d := CASE WHEN p.p = 1 THEN {DISTANCE1} ELSE {DISTANCE2} END, i := t.flow_id, l := t.label), 7) AS near
  FROM f q JOIN f t ON q.fold <> t.fold, (VALUES (1), (2)) p(p) GROUP BY q.flow_id, p.p),
cut AS (SELECT flow_id, p, y, fold, k, unnest(near[1:k]) AS n FROM found, (VALUES (3), (5), (7)) g(k)),
votes AS (SELECT flow_id, p, k, any_value(y) AS y, any_value(fold) AS fold,
    2 * count(*) FILTER (WHERE n.l = 1) > count(*) AS uniform,
    CASE WHEN bool_or(n.d = 0) THEN 2 * count(*) FILTER (WHERE n.l = 1 AND n.d = 0) > count(*) FILTER (WHERE n.d = 0)
      ELSE coalesce(sum(1 / n.d) FILTER (WHERE n.l = 1), 0) > coalesce(sum(1 / n.d) FILTER (WHERE n.l = 0), 0) END AS distance
  FROM cut GROUP BY flow_id, p, k),
per AS (SELECT p, k, fold, avg(CAST((y = 1) = uniform AS INT)) AS u, avg(CAST((y = 1) = distance AS INT)) AS d
  FROM votes GROUP BY p, k, fold)
SELECT p, k, weights, round(accuracy, 9) AS accuracy FROM (
  SELECT p, k, 'uniform' AS weights, avg(u) AS accuracy FROM per GROUP BY p, k
  UNION ALL SELECT p, k, 'distance', avg(d) FROM per GROUP BY p, k)""")


oracle("gnb_predict", ["scaled"], """
, st AS (SELECT label AS c, feature, avg(v) AS m, var_pop(v) AS s, CAST(count(*) AS DOUBLE) AS n FROM scaled GROUP BY label, feature),
fl AS (SELECT 1e-9::DOUBLE * max(s) AS eps FROM (SELECT var_pop(v) AS s FROM scaled GROUP BY feature)),
pr AS (SELECT c, any_value(n) / (SELECT sum(n) FROM (SELECT any_value(n) AS n FROM st GROUP BY c)) AS prior FROM st GROUP BY c),
ll AS (SELECT x.flow_id, any_value(x.label) AS y, st.c,
    ln(any_value(prior)) + sum(-0.5 * (ln(2 * pi() * (st.s + eps)) + (x.v - st.m) * (x.v - st.m) / (st.s + eps))) AS score
  FROM scaled x JOIN st USING (feature) JOIN pr ON pr.c = st.c CROSS JOIN fl GROUP BY x.flow_id, st.c)
SELECT flow_id, y, c AS prediction FROM ll
QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY score DESC, c) = 1""")
oracle("gnb_grid", ["scaled"], f"""
, dealt AS (SELECT flow_id, {_dealt(5)} AS fold FROM (SELECT DISTINCT flow_id, label FROM scaled)),
x AS (SELECT flow_id, label, feature, v, fold FROM scaled JOIN dealt USING (flow_id)),
g AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) f(fold)),
st AS (SELECT g.fold, label AS c, feature, avg(v) AS m, var_pop(v) AS s, CAST(count(*) AS DOUBLE) AS n
  FROM x JOIN g ON x.fold <> g.fold GROUP BY g.fold, label, feature),
fl AS (SELECT fold, max(s) AS top FROM (SELECT g.fold, feature, var_pop(v) AS s FROM x JOIN g ON x.fold <> g.fold
  GROUP BY g.fold, feature) GROUP BY fold),
pr AS (SELECT fold, c, n / sum(n) OVER (PARTITION BY fold) AS prior FROM (SELECT fold, c, any_value(n) AS n FROM st GROUP BY fold, c)),
ll AS (SELECT x.flow_id, x.fold, sm.s AS smoothing, any_value(x.label) AS y, st.c,
    ln(any_value(prior)) + sum(-0.5 * (ln(2 * pi() * (st.s + sm.s * top)) + (x.v - st.m) * (x.v - st.m) / (st.s + sm.s * top))) AS score
  FROM x JOIN st ON st.fold = x.fold AND st.feature = x.feature JOIN pr ON pr.fold = x.fold AND pr.c = st.c JOIN fl ON fl.fold = x.fold
  CROSS JOIN (VALUES (1e-9::DOUBLE), (1e-8::DOUBLE), (1e-7::DOUBLE), (1e-6::DOUBLE), (1e-5::DOUBLE)) sm(s)
  GROUP BY x.flow_id, x.fold, sm.s, st.c),
best AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY flow_id, smoothing ORDER BY score DESC, c) = 1)
SELECT smoothing, round(avg(a), 9) AS accuracy FROM (
  SELECT smoothing, fold, avg(CAST(y = c AS INT)) AS a FROM best GROUP BY smoothing, fold) GROUP BY smoothing""")
oracle("smote", ["near"], f"""
, n AS (SELECT label, count(*) AS n FROM near GROUP BY label),
small AS (SELECT label, n, (SELECT max(n) FROM n) - n AS extra FROM n WHERE n < (SELECT max(n) FROM n)),
base AS (SELECT m.*, extra // n + CAST(row_number() OVER (PARTITION BY m.label ORDER BY md5(concat('42:base:', flow_id))) <= extra % n AS INT) AS copies
  FROM near m JOIN small USING (label)),
found AS (SELECT q.flow_id, min(struct_pack(d := {DISTANCE2}, i := t.flow_id), 5) AS others
  FROM base q JOIN base t ON q.label = t.label AND q.flow_id <> t.flow_id WHERE q.copies > 0 GROUP BY q.flow_id),
made AS (SELECT *, unnest(generate_series(1, CAST(copies AS BIGINT))) AS copy FROM base JOIN found USING (flow_id)),
chosen AS (SELECT *, others[1 + CAST(floor({_uniform("concat('42:neighbor:', flow_id, ':', copy)")} * 5) AS INT)].i AS neighbor_id,
    {_uniform("concat('42:gap:', flow_id, ':', copy)")} AS u FROM made)
SELECT c.flow_id AS base_id, CAST(c.copy AS INT) AS copy, c.neighbor_id, c.label,
  {', '.join(f'round(c.x{i} + u * (t.x{i} - c.x{i}), 6) AS x{i}' for i in (1, 2, 3))}
FROM chosen c JOIN near t ON t.flow_id = c.neighbor_id""")

JUDGED = f"SELECT flow_id, dpid, {FIRED} <> '' AS blocked, {FIRED} AS reasons FROM flow_stats"
oracle("stream_rules", ["flow_stats"], JUDGED)
oracle("stream_restart", ["flow_stats"], JUDGED)
oracle("stream_verdicts", ["flow_stats", "judged", "active"], f"""
, blocked AS (SELECT flow_id FROM flow_stats WHERE {FIRED} <> ''),
cause AS (SELECT flow_id, 'rule' AS cause FROM blocked
  UNION ALL SELECT flow_id, 'vote' FROM judged WHERE normalized = 1 AND flow_id NOT IN (SELECT flow_id FROM blocked))
SELECT flow_id, dpid, in_port, eth_src, eth_dst, cause FROM flow_stats JOIN cause USING (flow_id)
WHERE in_port IS NOT NULL AND dpid IN (SELECT dpid FROM active)""")
oracle("stream_switches", ["latest"], "SELECT dpid, state FROM latest")
ORACLES["q_stream_mac_table"] = ORACLES["q_mac_table"]
oracle("rule_models", ["flow_features"], f"""
SELECT flow_id, {', '.join(f'y AS {m}' for m in MODEL_NAMES)}, y AS verdict
FROM (SELECT flow_id, CAST((flags IS NOT DISTINCT FROM 'S') <> (ip_proto = 17) AS INT) AS y FROM flow_features)""")
oracle("rule_kernel", ["flow_features"], """
SELECT flow_id, CAST((flags IS NOT DISTINCT FROM 'S') <> (ip_proto = 17) AS INT) AS svm FROM flow_features""")
oracle("rule_linear", ["flow_features"], """
SELECT flow_id, CAST(flags IS NOT DISTINCT FROM 'S' AS INT) AS svm, CAST(1 AS BIGINT) AS trained, CAST(2 AS BIGINT) AS models
FROM flow_features""")
oracle("stream_block_episodes", ["episodes"], "SELECT * FROM episodes")
