"""The engine's answers over HTTP: read-only views of what a job has written, and a page that shows them.

GET /api/v1/prefixes/PREFIX, /api/v1/asns/ASN/prefixes, /api/v1/alerts?type&severity&prefix&since&limit, /api/v1/stats,
/metrics and /. A bad prefix is 400, an unknown path 404, another method 405. Each request reads the tables as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from . import api
from .functions.prefix import format_text
from .streaming.job import Engine

PAGE = """<!doctype html><meta charset="utf-8"><title>routing events</title>
<style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 10px;text-align:left}.critical{font-weight:bold}</style>
<h1>Routing events</h1><pre id="stats"></pre><table id="alerts"></table>
<script>
async function stats() { document.getElementById("stats").textContent = JSON.stringify(await (await fetch("/api/v1/stats")).json(), null, 1) }
async function alerts() {
  const table = document.getElementById("alerts"); table.replaceChildren()
  for (const a of (await (await fetch("/api/v1/alerts?limit=50")).json()).alerts) {
    const row = table.insertRow(); row.className = a.severity
    for (const c of ["id", "ts", "type", "severity", "prefix", "observed_asn", "peer", "summary"]) row.insertCell().textContent = a[c]
  }
}
stats(); alerts(); setInterval(stats, 3000); setInterval(alerts, 5000)
</script>"""


def answer(engine: Engine, target: str) -> tuple[int, str, str]:
    """(status, content type, body) for the target of a GET request."""
    parts = urlsplit(target)
    path = [unquote(p) for p in parts.path.split("/") if p]
    query = {k: v[0] for k, v in parse_qs(parts.query).items()}
    found = lambda x: (200, "application/json", json.dumps(x, default=str))
    try:
        if not path:
            return 200, "text/html; charset=utf-8", PAGE
        if path == ["metrics"]:
            return 200, "text/plain; version=0.0.4", api.metrics(engine.stats())
        if path[:2] == ["api", "v1"]:
            if path[2:] == ["stats"]:
                return found(engine.stats())
            if path[2:] == ["alerts"]:
                since = float(query["since"]) if "since" in query else None
                return found({"alerts": api.alert_list(engine.alerts(), query.get("type"), query.get("severity"), query.get("prefix"), since, int(query.get("limit", 0)))})
            if len(path) in (4, 5) and path[2] == "prefixes":  # the prefix's slash may be escaped or not
                return found(api.prefix_view(engine.events(), "/".join(path[3:])))
            if len(path) == 5 and path[2] == "asns" and path[4] == "prefixes":
                rows = api.asn_prefixes(engine.events(), path[3]).orderBy(*map(F.col, ("family", "hi", "lo", "len", "peer"))).collect()
                return found({"prefixes": [{"prefix": format_text(r.family, r.len, r.hi, r.lo), "peer": r.peer} for r in rows]})
    except ValueError as e:  # a bad prefix or number
        return 400, "application/json", json.dumps({"error": str(e)})
    return 404, "application/json", json.dumps({"error": "not found"})


def server(engine: Engine, port: int, host: str = "127.0.0.1", respond: Callable = answer) -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever, in a thread of its own beside a stream."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = respond(engine, self.path)
            self._send(status, kind, body.encode())

        def _refuse(self):
            self._send(405, "application/json", b'{"error": "method not allowed"}')

        do_POST = do_PUT = do_DELETE = do_PATCH = _refuse

        def _send(self, status: int, kind: str, body: bytes):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
