"""The registered queries in DuckDB SQL over the same tables."""

from __future__ import annotations

EVENTS = """
e AS (
    SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 48 AS slot FROM events
), x AS (
    SELECT seq, ts, CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'announce' END AS kind,
        CASE slot % 4 WHEN 0 THEN 16 WHEN 1 THEN 20 ELSE 24 END AS len,
        167772160 + (slot // 4) * 65536 + CASE slot % 4 WHEN 0 THEN 0 WHEN 1 THEN 4096 WHEN 2 THEN 4352 ELSE 8192 END AS net,
        'p' || CAST(seq % 5 AS VARCHAR) AS peer, 64600 + seq % 5 AS peer_asn,
        CASE WHEN k >= 97 THEN 64666 WHEN k >= 94 THEN 65100 + slot // 4 ELSE 65000 + slot // 4 END AS origin_raw,
        CASE WHEN k % 10 = 7 THEN '1299 64500 3356' WHEN k % 2 = 0 THEN '3356' ELSE '1299' END AS transit, k = 50 AS from_set
    FROM e
), r AS (
    SELECT *, CASE WHEN kind = 'announce' THEN concat_ws(' ', peer_asn, transit, origin_raw) ELSE '' END AS path_text,
        CASE WHEN kind = 'announce' THEN origin_raw ELSE 0 END AS origin
    FROM x
)"""

VRPS = "vrps AS (SELECT 16 AS vlen, 167772160 + b * 65536 AS vnet, 65000 + b AS asn, 20 AS max_len FROM range(9) t(b))"

ROV = (
    VRPS
    + """, rov AS (
    SELECT r.seq, r.len, r.net, r.origin,
        CASE WHEN bool_or(coalesce(asn = origin AND asn <> 0 AND len <= max_len, false)) THEN 'valid' WHEN bool_or(vlen IS NOT NULL) THEN 'invalid' ELSE 'notfound' END AS rov
    FROM r LEFT JOIN vrps ON vlen <= len AND (net >> (32 - vlen)) << (32 - vlen) = vnet
    WHERE kind = 'announce' AND origin <> 0 GROUP BY ALL
)"""
)

LIVE = """latest AS (
    SELECT len, net, peer, arg_max(kind, seq) AS kind, arg_max(path_text, seq) AS path_text, arg_max(origin, seq) AS origin, arg_max(ts, seq) AS last_updated, max(seq) AS last_seq,
        coalesce(max(seq) FILTER (kind = 'withdraw'), -1) AS gone
    FROM r GROUP BY ALL
), live AS (SELECT * FROM latest WHERE kind = 'announce'),
timed AS (
    SELECT live.*, f.first_seen, f.inserted_seq FROM live JOIN (
        SELECT r.len, r.net, r.peer, arg_min(r.ts, r.seq) AS first_seen, min(r.seq) AS inserted_seq
        FROM r JOIN live l ON r.len = l.len AND r.net = l.net AND r.peer = l.peer AND r.seq > l.gone WHERE r.kind = 'announce' GROUP BY ALL
    ) f USING (len, net, peer)
)"""

CHANGES = """changes AS (
    SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY len, net, peer ORDER BY seq) AS was FROM r) WHERE kind = 'announce' OR was = 'announce'
)"""


def _baseline(window: int, watched: list[tuple[int, int, int]] = ()) -> str:
    """watched: (len, net, origin)."""
    rows = ", ".join(f"({a}, {b}, {c})" for a, b, c in watched)
    watch = f"watch AS (SELECT * FROM (VALUES {rows}) t(len, net, worigin))" if watched else "watch AS (SELECT 0 AS len, 0 AS net, 0 AS worigin WHERE false)"
    return f"""{watch}, ann AS (SELECT * FROM r WHERE kind = 'announce' AND origin <> 0), first AS (
    SELECT len, net, CASE WHEN any_value(worigin) IS NULL THEN arg_min(ts, seq) ELSE 0.0 END AS first_ts, any_value(worigin) IS NOT NULL AS watched
    FROM ann LEFT JOIN watch USING (len, net) WHERE worigin IS NULL OR worigin = 0 GROUP BY len, net
), lock AS (
    SELECT len, net, first_ts, watched, min(seq) FILTER (ts - first_ts > {window}) AS lock_seq FROM ann JOIN first USING (len, net) GROUP BY ALL
), learned AS (
    SELECT * FROM (
        SELECT len, net, origin, seq, row_number() OVER (PARTITION BY len, net ORDER BY seq) AS rank
        FROM (SELECT len, net, origin, min(seq) AS seq FROM ann JOIN lock USING (len, net) WHERE seq < coalesce(lock_seq, 9e18) GROUP BY ALL)
    ) WHERE rank <= 4
    UNION ALL SELECT len, net, worigin, -1, 1 FROM watch WHERE worigin <> 0
), base AS (
    SELECT lock.len, lock.net, first_ts, lock_seq, coalesce(string_agg(CAST(origin AS VARCHAR), ' ' ORDER BY rank), '') AS origins, arg_min(origin, rank) AS main, lock.watched
    FROM lock LEFT JOIN learned USING (len, net) GROUP BY ALL
    UNION ALL SELECT len, net, 0.0, -1, CAST(worigin AS VARCHAR), worigin, true FROM watch WHERE worigin <> 0
), hijack AS (
    SELECT ann.*, main AS expected_asn, CASE WHEN watched THEN 'critical' ELSE 'warning' END AS severity
    FROM ann JOIN base USING (len, net)
    WHERE lock_seq < seq AND NOT from_set AND main IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM learned l WHERE l.len = ann.len AND l.net = ann.net AND l.origin = ann.origin)
), subprefix AS (
    SELECT ann.*, b.len AS cover_len, b.main AS expected_asn, CASE WHEN watched THEN 'critical' ELSE 'warning' END AS severity, b.net AS cover_net
    FROM ann JOIN base b ON b.len < ann.len AND (ann.net >> (32 - b.len)) << (32 - b.len) = b.net AND b.lock_seq < ann.seq AND b.main IS NOT NULL
    WHERE NOT from_set AND NOT EXISTS (SELECT 1 FROM learned l WHERE l.len = ann.len AND l.net = ann.net AND l.origin = ann.origin AND l.seq < ann.seq)
    QUALIFY row_number() OVER (PARTITION BY ann.seq ORDER BY b.len DESC) = 1
), stolen AS (
    SELECT * FROM subprefix s WHERE NOT EXISTS (SELECT 1 FROM learned l WHERE l.len = s.cover_len AND l.net = s.cover_net AND l.origin = s.origin)
)"""


RELS = "rels AS (SELECT * FROM (VALUES (3356, 64500, 'p2c'), (64500, 3356, 'c2p'), (1299, 64500, 'p2c'), (64500, 1299, 'c2p')) t(a, b, rel))"
LEAK = (
    RELS
    + """, hops AS (
    SELECT seq, CAST(p[i + 1] AS BIGINT) AS a, CAST(p[i] AS BIGINT) AS b, len(p) - i AS step
    FROM (SELECT seq, string_split(path_text, ' ') AS p FROM r WHERE kind = 'announce'), range(1, 255) t(i) WHERE i < len(p) AND len(p) >= 3
), rated AS (
    SELECT seq, hops.a, hops.b, step, rel, bool_or(rel IN ('p2c', 'peer')) OVER (PARTITION BY seq ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS descended
    FROM hops JOIN rels ON hops.a = rels.a AND hops.b = rels.b WHERE hops.a <> hops.b
), leak AS (
    SELECT seq, a AS leaker, b AS leaked_to FROM rated WHERE descended AND rel IN ('c2p', 'peer') QUALIFY row_number() OVER (PARTITION BY seq ORDER BY step) = 1
)"""
)


def _spike(name: str, key: str, window: int, factor: int, least: int) -> str:
    """A recursive fold over the rows of each key."""
    return f"""{name}_rows AS (SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM r),
{name}_fold AS (
    SELECT key, seq, ts, rn, ts AS start, ts AS first, CAST(1 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS prev, CAST(1 AS BIGINT) AS total FROM {name}_rows WHERE rn = 1
    UNION ALL
    SELECT k.key, k.seq, k.ts, k.rn,
        CASE WHEN k.ts - f.start >= {2 * window} THEN k.ts WHEN k.ts - f.start >= {window} THEN f.start + {window} ELSE f.start END, f.first,
        CASE WHEN k.ts - f.start >= {window} THEN 1 ELSE f.cur + 1 END,
        CASE WHEN k.ts - f.start >= {2 * window} THEN 0 WHEN k.ts - f.start >= {window} THEN f.cur ELSE f.prev END, f.total + 1
    FROM {name}_fold f JOIN {name}_rows k ON k.key = f.key AND k.rn = f.rn + 1
), {name} AS (
    SELECT seq, CAST(trunc(seen) AS BIGINT) AS window_count FROM (
        SELECT seq, cur + prev * greatest(0.0, 1.0 - (ts - start) / {window}.0) AS seen, CASE WHEN start > first THEN (total - cur) / (start - first) ELSE 0.0 END AS usual FROM {name}_fold
    ) WHERE seen > greatest({factor}.0 * usual * {window}.0, {least}.0)
)"""


W = 259200
SPIKES = _spike("spike_prefix", "len || ':' || net", 21600, 3, 4) + ", " + _spike("spike_peer", "peer", 21600, 3, 4)

CANDIDATES = (
    ", ".join((EVENTS, ROV, _baseline(W), LEAK, SPIKES))
    + """, candidates AS (
    SELECT seq, 0 AS ord, ts, 'hijack' AS type, severity, len, net, expected_asn, origin AS observed_asn, peer FROM hijack
    UNION ALL SELECT seq, 1, ts, 'subprefix', severity, len, net, expected_asn, origin, peer FROM stolen
    UNION ALL SELECT seq, 2, ts, 'leak', 'warning', len, net, 0, leaker, peer FROM leak JOIN r USING (seq)
    UNION ALL SELECT seq, 3, ts, 'rpki_invalid', 'warning', r.len, r.net, 0, r.origin, peer FROM rov JOIN r USING (seq) WHERE rov = 'invalid'
    UNION ALL SELECT seq, 4, ts, 'spike', 'info', len, net, 0, origin, peer FROM spike_prefix JOIN r USING (seq)
    UNION ALL SELECT seq, 5, ts, 'spike', 'info', 0, 0, 0, peer_asn, peer FROM spike_peer JOIN r USING (seq)
), keyed AS (
    SELECT *, concat_ws('|', type, len, net, observed_asn, ord = 5) AS key, row_number() OVER (PARTITION BY concat_ws('|', type, len, net, observed_asn, ord = 5) ORDER BY seq, ord) AS rn FROM candidates
)"""
)


def _cooled(seconds: int) -> str:
    return (
        CANDIDATES
        + f""", cooled AS (
    SELECT key, rn, seq, ord, 1 AS emitted, ts AS last FROM keyed WHERE rn = 1
    UNION ALL
    SELECT k.key, k.rn, k.seq, k.ord, CASE WHEN c.last <> 0 AND k.ts - c.last < {seconds} THEN 0 ELSE 1 END, CASE WHEN c.last <> 0 AND k.ts - c.last < {seconds} THEN c.last ELSE k.ts END
    FROM cooled c JOIN keyed k ON k.key = c.key AND k.rn = c.rn + 1
), alerts AS (
    SELECT row_number() OVER (ORDER BY seq, ord) AS id, candidates.* FROM candidates JOIN cooled USING (seq, ord) WHERE emitted = 1
)"""
    )


PREFIX_TEXT = "concat((net >> 24) & 255, '.', (net >> 16) & 255, '.', (net >> 8) & 255, '.', net & 255, '/', len)"
WATCHED = [(16, 167772160 + 65536, 65001), (20, 167772160 + 2 * 65536 + 4096, 65002), (16, 167772160 + 3 * 65536, 0)]
TYPES = ("hijack", "subprefix", "leak", "rpki_invalid", "spike")


def _with(body: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{body} {select}"


def _mask(n: int) -> str:
    return f"(net >> {32 - n}) << {32 - n}" if n else "CAST(0 AS BIGINT)"


ORACLE_SQL: dict[str, str] = {
    "rov_state": _with(f"{EVENTS}, {ROV}", "SELECT seq, len, net, origin, rov FROM rov"),
    "rpki_invalid": _with(f"{EVENTS}, {ROV}", "SELECT seq, len, net, origin AS observed_asn FROM rov WHERE rov = 'invalid'"),
    "rov_counts": _with(f"{EVENTS}, {ROV}", "SELECT rov, count(*) AS n FROM rov GROUP BY rov"),
    "prefix_format": _with(EVENTS, f"SELECT DISTINCT len, net, {PREFIX_TEXT} AS prefix FROM r"),
    "prefix_parse": _with(
        EVENTS + f", t AS (SELECT seq, {PREFIX_TEXT} AS text, net, len FROM (SELECT seq, net + seq % 200 AS net, CAST(seq % 35 AS INTEGER) AS len FROM r))",
        "SELECT seq, text, CASE WHEN len <= 32 THEN len END AS len, CASE WHEN len <= 32 THEN (net >> (32 - len)) << (32 - len) END AS net FROM t",
    ),
    "prefix_mask": _with(EVENTS, f"SELECT seq, {', '.join(f'{_mask(n)} AS m{n}' for n in (0, 8, 15, 20))}, CAST((net >> 12) & 1 AS INTEGER) AS bit19 FROM r"),
    "prefix_covers": _with(
        EVENTS + ", p AS (SELECT DISTINCT len, net FROM r)",
        "SELECT i.len, i.net, o.len AS cover_len, o.net AS cover_net FROM p i JOIN p o ON o.len <= i.len AND (i.net >> (32 - o.len)) << (32 - o.len) = o.net",
    ),
    "path_origin": _with(EVENTS, "SELECT seq, origin AS path_origin, origin AS event_origin FROM r"),
    "path_format": _with(EVENTS, "SELECT seq, path_text FROM r"),
    "path_parse": _with(
        EVENTS + ", p AS (SELECT seq, seq % 7 NOT IN (3, 5) AS ok, path_text, origin FROM r)",
        "SELECT seq, ok, CASE WHEN NOT ok THEN -1 WHEN path_text = '' THEN 0 ELSE CAST(len(string_split(path_text, ' ')) AS INTEGER) END AS hops, CASE WHEN ok THEN origin ELSE 0 END AS origin FROM p",
    ),
    "path_as4_merge": _with(
        EVENTS + ", p AS (SELECT seq, path_text, CASE WHEN path_text = '' THEN [] ELSE string_split(path_text, ' ') END AS p FROM r)",
        "SELECT seq, CASE WHEN seq % 3 = 0 AND len(p) >= 2 THEN concat_ws(' ', CASE WHEN len(p) > 2 THEN array_to_string(p[1:len(p) - 2], ' ') END, 4200000000 + seq % 9, 4200000001) ELSE path_text END AS path_text FROM p",
    ),
    "community_encode": _with(EVENTS, "SELECT seq, ((peer_asn << 16) | (seq & 65535)) & 4294967295 AS community FROM r"),
    "origin_attr_map": _with(EVENTS, "SELECT seq, CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS origin_attr FROM r"),
    "next_hop_select": _with(EVENTS, "SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN '192.0.2.' || CAST(seq % 250 AS VARCHAR) END, CASE WHEN seq % 2 = 0 THEN '2001:db8::1' END) AS next_hop FROM r"),
    "event_counts": _with(EVENTS, "SELECT count(*) FILTER (kind = 'announce') AS announces, count(*) FILTER (kind = 'withdraw') AS withdraws FROM r"),
    "distinct_prefix_origin": _with(EVENTS, "SELECT count(DISTINCT (len, net)) AS distinct_prefixes, count(DISTINCT nullif(origin, 0)) AS distinct_origins FROM r"),
    "rib_current": _with(f"{EVENTS}, {LIVE}", "SELECT len, net, peer, origin, path_text, last_updated, last_seq FROM live"),
    "rib_first_seen": _with(f"{EVENTS}, {LIVE}", "SELECT len, net, peer, first_seen, inserted_seq, last_updated FROM timed"),
    "rib_lookup": _with(
        f"{EVENTS}, {LIVE}",
        f"SELECT CAST(row_number() OVER (ORDER BY inserted_seq DESC) AS INTEGER) AS position, peer, origin, first_seen, last_updated FROM timed WHERE len = 20 AND net = {167772160 + 3 * 65536 + 4096}",
    ),
    "rib_history": _with(
        f"{EVENTS}, {CHANGES}, kept AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY len, net ORDER BY seq DESC) <= 32)",
        "SELECT len, net, CAST(row_number() OVER (PARTITION BY len, net ORDER BY seq) AS INTEGER) AS position, seq, kind, peer, origin FROM kept",
    ),
    "rib_more_specifics": _with(f"{EVENTS}, {LIVE}", f"SELECT len, net, peer, origin FROM live WHERE len > 13 AND {_mask(13)} = 167772160"),
    "rib_covering": _with(f"{EVENTS}, {LIVE}", f"SELECT len, net, peer, origin FROM live WHERE len <= 24 AND ({167772160 + 3 * 65536 + 4352} >> (32 - len)) << (32 - len) = net"),
    "rib_by_origin": _with(f"{EVENTS}, {LIVE}", "SELECT len, net, peer FROM live WHERE origin = 65003"),
    "rib_dominant_origin": _with(
        f"{EVENTS}, {LIVE}",
        "SELECT len, net, origin, votes FROM (SELECT len, net, origin, count(*) AS votes FROM live WHERE origin <> 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY len, net ORDER BY votes DESC, origin) = 1",
    ),
    "rib_stats": _with(f"{EVENTS}, {LIVE}", "SELECT (SELECT count(DISTINCT (len, net)) FROM r WHERE kind = 'announce') AS prefixes, (SELECT count(*) FROM r) AS events_applied, (SELECT count(*) FROM live) AS routes"),
    "effective_withdraws": _with(f"{EVENTS}, {CHANGES}", "SELECT seq, len, net, peer FROM changes WHERE kind = 'withdraw'"),
    "baseline_lock": _with(f"{EVENTS}, {_baseline(W)}", "SELECT len, net, first_ts, lock_seq FROM base"),
    "baseline_origins": _with(f"{EVENTS}, {_baseline(W)}", "SELECT len, net, origins FROM base"),
    "watch_seed": _with(f"{EVENTS}, {_baseline(W, WATCHED)}", "SELECT len, net, lock_seq, origins, watched FROM base"),
    "hijack": _with(f"{EVENTS}, {_baseline(W)}", "SELECT seq, len, net, expected_asn, origin AS observed_asn, severity FROM hijack"),
    "hijack_watched": _with(f"{EVENTS}, {_baseline(W, WATCHED)}", "SELECT seq, len, net, expected_asn, origin AS observed_asn, severity FROM hijack"),
    "subprefix": _with(f"{EVENTS}, {_baseline(W)}", "SELECT seq, len, net, cover_len, expected_asn, origin AS observed_asn, severity FROM stolen"),
    "leak": _with(f"{EVENTS}, {LEAK}", "SELECT seq, leaker, leaked_to FROM leak"),
    "rel_edges": _with(RELS, "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, rel FROM rels"),
    "spike_prefix": _with(f"{EVENTS}, {SPIKES}", "SELECT seq, len, net, window_count FROM spike_prefix JOIN r USING (seq)", True),
    "spike_peer": _with(f"{EVENTS}, {SPIKES}", "SELECT seq, peer, peer_asn, window_count FROM spike_peer JOIN r USING (seq)", True),
    "cooldown": _with(_cooled(86400), "SELECT seq, ord, type, observed_asn, CAST(emitted AS BIGINT) AS emitted FROM cooled JOIN candidates USING (seq, ord)", True),
    "alerts_all": _with(_cooled(300), "SELECT id, seq, ord, ts, type, severity, len, net, expected_asn, observed_asn, peer FROM alerts", True),
    "alerts_query": _with(_cooled(300), "SELECT id, seq, type, severity FROM (SELECT * FROM alerts ORDER BY id DESC LIMIT 60) WHERE severity IN ('warning', 'critical')", True),
    "alert_counts": _with(_cooled(300), f"SELECT t AS type, (SELECT count(*) FROM alerts WHERE type = t) AS count FROM (VALUES {', '.join(f'({t!r})' for t in TYPES)}) v(t)", True),
    "engine_stats": _with(
        _cooled(300),
        "SELECT (SELECT count(*) FROM r) AS events, (SELECT count(*) FROM cooled WHERE emitted = 0) AS suppressed, " + ", ".join(f"(SELECT count(*) FROM alerts WHERE type = '{t}') AS {t}" for t in TYPES),
        True,
    ),
    "vrp_load": """SELECT len, CAST(net AS BIGINT) AS net, CAST(asn AS BIGINT) AS asn, max_len FROM (VALUES (24, 16843008, 13335, 24), (24, 134744064, 15169, 24), (24, 3221225984, 64500, 28), (24, 3325256704, 64501, 24), (24, 3405803776, 64500, 24), (16, 172097536, 0, 16))
        t(len, net, asn, max_len)""",
    "ris_parse": _with(
        EVENTS,
        """SELECT seq, 0 AS item, kind, len, net, CASE WHEN kind = 'announce' AND from_set THEN path_text || ' 64999' ELSE path_text END AS path_text,
        kind = 'announce' AND from_set AS origin_from_set, CASE WHEN kind = 'announce' THEN '192.0.2.1' END AS next_hop, peer, peer_asn FROM r""",
    ),
    "feed_filter": _with(EVENTS, f"SELECT seq, len, net FROM r WHERE len >= 14 AND {_mask(14)} = {167772160 + 4 * 65536}"),
    "prefix_view": _with(
        f"{EVENTS}, {LIVE}, l AS (SELECT * FROM live WHERE len = 16 AND net = {167772160 + 5 * 65536})",
        "SELECT len, net, origin, count(*) AS votes, (SELECT count(*) FROM l) AS routes FROM l GROUP BY ALL ORDER BY votes DESC, origin LIMIT 1",
    ),
    "asn_prefixes": _with(f"{EVENTS}, {LIVE}", f"SELECT {PREFIX_TEXT} AS prefix, peer FROM live WHERE origin = 65007"),
    "carve_head": _with(EVENTS, "SELECT seq, kind, len, net FROM r WHERE seq < 400"),
}
