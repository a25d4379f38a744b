"""What the engine answers: views of a prefix, an AS, the alerts and the statistics, and metrics in text form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.aspath import format_path
from .functions.prefix import format_text, parse_text
from .operators import alerts as store
from .operators import rib
from .operators.rov import validate
from .schema import ALERT_TYPES, ROUTE_EVENTS
from .sinks.alerts import as_json


class BadRequest(ValueError):
    pass


def prefix_view(events: DataFrame, prefix: str) -> dict:
    """The dominant origin, live routes and history of a prefix; an unknown prefix has none of them."""
    if parse_text(prefix) is None:
        raise BadRequest(f"no prefix: {prefix!r}")
    own = rib.at_prefix(events, prefix)
    routes = rib.lookup(own, prefix)
    best = rib.dominant_origin(routes.select("family", "len", "hi", "lo", "origin")).first()
    return {
        "prefix": format_text(*parse_text(prefix)), "dominant_origin": best.origin if best else 0,
        "routes": [r.asDict() for r in routes.orderBy("position").select("peer", format_path(F.col("path")).alias("as_path"), "origin", "first_seen", "last_updated").collect()],
        "history": [r.asDict() for r in rib.history(own).orderBy("position").select("seq", "ts", "kind", "peer", "origin").collect()],
    }


def asn_prefixes(events: DataFrame, asn: str) -> DataFrame:
    """(prefix columns, peer) of the live routes with an origin; what follows the number is ignored."""
    digits = asn[: len(asn) - len(asn.lstrip("0123456789"))]
    return rib.by_origin(rib.live(events), int(digits or 0)).select("family", "len", "hi", "lo", "peer")


def alert_list(alerts: DataFrame, type: str | None = None, severity: str | None = None, prefix: str | None = None, since: float | None = None, limit: int = 0) -> list[dict]:  # noqa: A002
    p = parse_text(prefix) if prefix else None
    if prefix and p is None:
        return []
    found = store.query(alerts, type, severity, since, p, limit or store.ALERT_QUERY_LIMIT)
    return [json.loads(r.json) for r in as_json(found).orderBy(F.desc("id")).collect()]


def stats(events: DataFrame, judged: DataFrame) -> dict:
    """Counts of the routing table, the engine and the store. judged: candidates with emitted."""
    table = rib.stats(events).first().asDict()
    counts = {t: 0 for t in ALERT_TYPES} | {r.type: r.n for r in judged.where("emitted = 1").groupBy("type").agg(F.count("*").alias("n")).collect()}
    return {"rib": table, "engine": {"events": table["events_applied"], "suppressed": judged.where("emitted = 0").count()}, "alerts": counts}


def metrics(found: dict, namespace: str = "routeloom") -> str:
    """The statistics as text for a metrics collector."""
    lines = []

    def metric(name: str, kind: str, help_: str, *values: tuple[str, int]) -> None:
        lines.append(f"# HELP {namespace}_{name} {help_}")
        lines.append(f"# TYPE {namespace}_{name} {kind}")
        lines.extend(f"{namespace}_{name}{labels} {value}" for labels, value in values)

    metric("rib_prefixes", "gauge", "Prefixes ever announced", ("", found["rib"]["prefixes"]))
    metric("rib_routes", "gauge", "Live routes by prefix and peer", ("", found["rib"]["routes"]))
    metric("rib_events_total", "counter", "Events applied to the routing table", ("", found["rib"]["events_applied"]))
    metric("events_processed_total", "counter", "Events that the detectors have seen", ("", found["engine"]["events"]))
    metric("alerts_total", "counter", "Emitted alerts of each type", *((f'{{type="{t}"}}', found["alerts"][t]) for t in ALERT_TYPES))
    metric("alerts_suppressed_total", "counter", "Alerts suppressed by cooldown", ("", found["engine"]["suppressed"]))
    return "\n".join(lines) + "\n"


def rov(vrps: DataFrame, prefix: str, asn: int) -> str:
    """valid, invalid or notfound for one prefix and origin."""
    p = parse_text(prefix)
    if p is None:
        raise BadRequest(f"no prefix: {prefix!r}")
    row = vrps.sparkSession.createDataFrame([(0, *p, asn)], "seq bigint, family int, len int, hi bigint, lo bigint, origin bigint")
    return validate(row, vrps).first().rov


def stub_events(spark) -> DataFrame:
    """One announcement and one withdrawal, for a first run."""
    p = parse_text("192.0.2.0/24")
    rows = [
        (0, 0.0, "announce", *p, [64496, 64500], False, 0, "192.0.2.1", None, None, [], "stub", 64496, "stub"),
        (1, 1.0, "withdraw", *p, [], False, None, None, None, None, [], "stub", 64496, "stub"),
    ]
    return spark.createDataFrame(rows, ROUTE_EVENTS)
