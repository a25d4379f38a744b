"""Schemas and limits of the routing-event model.

A prefix is (family, len, hi, lo): 128 bits left-aligned in two signed 64-bit numbers, so that one mask formula serves
both families; IPv4 takes the upper 32 bits of hi. AS numbers are BIGINT (they go up to 2^32 - 1). `seq` is the arrival
order that everything sequential is ordered by; timestamps may go backwards.
"""

from __future__ import annotations

ROUTE_EVENTS = (
    "seq bigint, ts double, kind string, family int, len int, hi bigint, lo bigint, path array<bigint>, origin_from_set boolean, "
    "origin_attr smallint, next_hop string, med bigint, local_pref bigint, communities array<bigint>, peer string, peer_asn bigint, source string"
)
VRPS = "family int, len int, hi bigint, lo bigint, asn bigint, max_len int"
RELATIONSHIPS = "a bigint, b bigint, rel string"
WATCHLIST = "family int, len int, hi bigint, lo bigint, origin bigint"
ALERTS = (
    "id bigint, seq bigint, ord int, ts double, type string, severity string, family int, len int, hi bigint, lo bigint, "
    "expected_asn bigint, observed_asn bigint, peer string, summary string, evidence string"
)

PREFIX = ("family", "len", "hi", "lo")
ANNOUNCE, WITHDRAW = "announce", "withdraw"

# Limits that are part of the semantics.
MAX_PATH = 255
MAX_COMMUNITIES = 64
MAX_BASELINE_ORIGINS = 4
HISTORY = 32
MAX_ROUTES_PER_MESSAGE = 4096
MAX_LINE_BYTES = 1 << 20
MAX_ASN = 4294967295
ALERT_QUERY_LIMIT = 100
COOLDOWN_SECONDS = 300.0

ALERT_TYPES = ("hijack", "subprefix", "leak", "rpki_invalid", "spike")
SEVERITIES = ("info", "warning", "critical")
ROV_STATES = ("notfound", "valid", "invalid")
