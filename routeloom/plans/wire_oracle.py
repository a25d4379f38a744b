"""The queries of `wire` in DuckDB SQL: what goes into the encoders is what must come out."""

from __future__ import annotations

from .oracle import EVENTS, PREFIX_TEXT, _cooled, _with

#: The sets' origin: a path's last segment.
SET = "kind = 'announce' AND from_set"
K6 = "lower(printf('%x', 1 + (seq // 6) % 9))"
M6 = "lower(printf('%x', 1 + seq % 9))"
S6 = "lower(printf('%x', 1 + seq % 200))"
CHUNK = 500
TEXTS6 = f"""t6 AS (
    SELECT seq, seq % 6 AS k, '2001:db8:' || {K6} || ':' || {S6} || '::' AS whole, '2001:db8:' || {K6} || '::/48' AS block FROM r
), p6 AS (
    SELECT seq, k, block, CASE k WHEN 0 THEN whole || '/64' WHEN 1 THEN whole || '77/48' WHEN 2 THEN upper(whole) || '/64' WHEN 3 THEN whole || '1/128' WHEN 4 THEN whole || '/129' ELSE whole || ':/64' END AS text,
        CASE k WHEN 0 THEN 64 WHEN 1 THEN 48 WHEN 2 THEN 64 WHEN 3 THEN 128 END AS len,
        CASE k WHEN 0 THEN whole || '/64' WHEN 1 THEN block WHEN 2 THEN whole || '/64' WHEN 3 THEN whole || '1/128' END AS prefix
    FROM t6
)"""
BYTES = "concat(printf('%02x', len), printf('%02x', (net >> 24) & 255), printf('%02x', (net >> 16) & 255), CASE WHEN len > 16 THEN printf('%02x', (net >> 8) & 255) ELSE '' END)"

ORACLE_SQL: dict[str, str] = {
    "url_values": "SELECT event_id AS seq, 'leak ' || CAST(event_id AS VARCHAR) AS type, '10.' || CAST(event_id % 200 AS VARCHAR) || '.0.0/16' AS prefix, 'a b+c' AS \"limit\", '5%zz%4' AS odd, CAST(NULL AS VARCHAR) AS since FROM events",
    "update_decode": _with(
        EVENTS,
        f"""SELECT seq, kind, len, net, {SET} AS from_set, CASE WHEN kind = 'announce' THEN CAST(seq % 3 AS INTEGER) END AS origin_attr,
        CASE WHEN kind = 'announce' THEN '198.18.' || CAST(seq % 200 AS VARCHAR) || '.9' END AS next_hop, CASE WHEN kind = 'announce' THEN seq END AS med,
        CASE WHEN kind = 'announce' AND seq % 2 = 1 THEN 100 + seq % 50 END AS local_pref, CASE WHEN kind = 'announce' THEN CAST(least(seq % 70, 64) AS INTEGER) ELSE 0 END AS n_communities,
        CASE WHEN kind = 'announce' AND seq % 70 > 0 THEN (CAST(65000 AS BIGINT) << 16) | (seq & 65535) END AS community, path_text FROM r""",
    ),
    "update_mp6": _with(
        EVENTS,
        f"""SELECT seq, kind, '2001:db8:' || {M6} || ':' || {S6} || '::/64' AS prefix, CASE WHEN kind = 'announce' THEN '2001:db8::9' END AS next_hop,
        CASE WHEN kind = 'announce' THEN concat_ws(' ', 4200000000 + seq % 7, transit, origin_raw) ELSE '' END AS path_text FROM r""",
    ),
    "malformed_updates": _with(
        EVENTS,
        """SELECT seq, CASE seq % 8 WHEN 0 THEN '' WHEN 1 THEN 'EBADMARKER' WHEN 2 THEN 'EBADLEN' WHEN 3 THEN 'EBADTYPE' WHEN 4 THEN 'EATTRLEN' WHEN 5 THEN 'ESEGTYPE'
        WHEN 6 THEN 'EPREFIXLEN' ELSE 'EMISSING' END AS error FROM r WHERE kind = 'announce'""",
    ),
    "nlri_codec": _with(EVENTS, f"SELECT seq, {BYTES} AS wire, len, net FROM r"),
    "mrt_decode": _with(
        EVENTS,
        "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, round(ts, 6) AS ts, kind, len, net, '198.18.0.' || CAST(seq % 5 AS VARCHAR) AS peer, peer_asn, path_text FROM r",
    ),
    "mrt_replay_counts": _with(
        EVENTS
        + f""", n AS (SELECT count(*) AS n FROM r GROUP BY seq // {CHUNK}), o AS (SELECT sum(n) AS updates, sum(n // 10) AS skipped, sum(n // 100) AS errors FROM n)""",
        """SELECT CAST(updates + skipped + errors AS BIGINT) AS records, CAST(updates AS BIGINT) AS updates, CAST(0 AS BIGINT) AS rib_entries, CAST(errors AS BIGINT) AS errors, CAST(skipped AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS corrupt,
        (SELECT count(*) FROM r WHERE kind = 'announce') AS announces, (SELECT count(*) FROM r WHERE kind = 'withdraw') AS withdraws,
        (SELECT count(DISTINCT (len, net)) FROM r) AS distinct_prefixes, (SELECT count(DISTINCT nullif(origin, 0)) FROM r) AS distinct_origins FROM o""",
    ),
    "table_dump_decode": _with(
        EVENTS + ", two AS (SELECT r.*, e.k AS entry, (r.seq + e.k) % 5 AS peer_no FROM r, (VALUES (0), (1)) e(k) WHERE kind = 'announce')",
        """SELECT row_number() OVER (ORDER BY seq, entry) - 1 AS seq, CAST(floor(ts) AS DOUBLE) AS ts, kind, len, net, '198.18.0.' || CAST(peer_no AS VARCHAR) AS peer, 64600 + peer_no AS peer_asn, '198.18.9.9' AS next_hop, path_text FROM two""",
    ),
    "prefix6_parse": _with(f"{EVENTS}, {TEXTS6}", "SELECT seq, text, len, prefix FROM p6"),
    "prefix6_covers": _with(f"{EVENTS}, {TEXTS6}", "SELECT seq, block AS cover FROM p6 WHERE len > 48 AND block IN (SELECT block FROM p6 WHERE len = 48)"),
    "rov6": _with(
        f"{EVENTS}, {TEXTS6}, q AS (SELECT seq, len, CASE WHEN seq % 4 = 0 THEN 64999 ELSE 65001 + (seq // 6) % 9 END AS origin, 1 + (seq // 6) % 9 AS b FROM p6 WHERE len IS NOT NULL)",
        "SELECT seq, len, origin, CASE WHEN b > 7 THEN 'notfound' WHEN b < 7 AND origin = 65000 + b AND len <= 64 THEN 'valid' ELSE 'invalid' END AS rov FROM q",
    ),
    "vrp_dump": _with(
        EVENTS + ", v AS (SELECT DISTINCT len, net, origin FROM r WHERE kind = 'announce')",
        """SELECT len, net, CAST(origin AS BIGINT) AS asn, CASE WHEN origin % 4 = 0 THEN len + 4 ELSE len END AS max_len FROM v WHERE origin % 4 <> 2 AND NOT (origin % 3 = 2 AND len = 20)""",
    ),
    "alert_evidence": _with(
        _cooled(300),
        f"""SELECT a.id, a.type, CASE WHEN a.ord = 5 THEN '' ELSE {PREFIX_TEXT.replace('net', 'r.net').replace('len)', 'r.len)')} END AS prefix, CAST(a.observed_asn AS BIGINT) AS observed_asn, r.path_text AS as_path, r.peer, r.peer_asn, r.len,
        CASE WHEN a.ord = 2 THEN leak.leaked_to END AS leaked_to, CASE WHEN a.ord = 1 THEN stolen.cover_len END AS cover_len,
        CASE a.ord WHEN 4 THEN spike_prefix.window_count WHEN 5 THEN spike_peer.window_count END AS window_count
        FROM alerts a JOIN r ON r.seq = a.seq LEFT JOIN leak ON leak.seq = a.seq LEFT JOIN stolen ON stolen.seq = a.seq LEFT JOIN spike_prefix ON spike_prefix.seq = a.seq LEFT JOIN spike_peer ON spike_peer.seq = a.seq""",
        True,
    ),
    "alerts_filtered": _with(
        _cooled(300),
        f"""SELECT id, seq, type, severity, CAST(observed_asn AS BIGINT) AS observed_asn FROM alerts WHERE type = 'rpki_invalid' AND ts >= (SELECT quantile_cont(ts, 0.25) FROM r) AND len = 24 AND net = {167772160 + 3 * 65536 + 4352}
        ORDER BY id DESC LIMIT 40""",
        True,
    ),
}
