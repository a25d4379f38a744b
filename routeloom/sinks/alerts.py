"""Where alerts go: a table, JSON, a log, a webhook."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable
from queue import Full, Queue
from threading import Thread

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import format as format_prefix
from ..schema import PREFIX

log = logging.getLogger("routeloom.alerts")

#: Alerts that wait for a webhook at most; those that find the queue full are dropped and counted in the log.
WEBHOOK_QUEUE = 256


def prefix_text() -> Column:
    """The prefix's text, empty for alerts about a peer."""
    return F.when(F.col("family") == 0, "").otherwise(format_prefix(*(F.when(F.col("family") == 0, F.lit(d)).otherwise(F.col(c)) for c, d in zip(PREFIX, (4, 0, 0, 0)))))


def summary() -> Column:
    asn = F.concat(F.lit("AS"), F.col("observed_asn").cast("string"))
    expected = F.concat(F.lit("AS"), F.col("expected_asn").cast("string"))
    return (
        F.when(F.col("type") == "hijack", F.concat(F.lit("origin hijack: expected "), expected, F.lit(", seen "), asn))
        .when(F.col("type") == "subprefix", F.concat(F.lit("more-specific of a prefix of "), expected, F.lit(" from "), asn))
        .when(F.col("type") == "leak", F.concat(F.lit("route leak by "), asn))
        .when(F.col("type") == "rpki_invalid", F.concat(F.lit("RPKI invalid origin "), asn))
        .otherwise(F.lit("update rate spike"))
    )


def as_json(alerts: DataFrame) -> DataFrame:
    """(id, json): one document for each alert, its evidence as a document within, numbers as numbers."""
    fields = F.to_json(F.struct("id", "ts", "type", "severity", "prefix", "expected_asn", "observed_asn", "peer", summary().alias("summary")))
    # the evidence is a document already: it is put in as it stands
    document = F.concat(F.left(fields, F.length(fields) - 1), F.lit(',"evidence":'), F.coalesce("evidence", F.lit("null")), F.lit("}"))
    return alerts.withColumn("prefix", prefix_text()).select("id", document.alias("json"))


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Alerts as Parquet by type, one folder for each batch; repeated batches replace theirs."""

    def write(alerts: DataFrame, batch: int) -> None:
        alerts.write.mode("overwrite").partitionBy("type").parquet(f"{path}/batch={batch}")

    return write


def log_sink() -> Callable[[DataFrame, int], None]:
    """Every alert of a batch as a log line, in order of id; the driver holds one partition at a time."""

    def write(alerts: DataFrame, batch: int) -> None:
        for a in alerts.select("id", "type", "severity", "observed_asn", "peer").orderBy("id").toLocalIterator():
            level = logging.ERROR if a.severity == "critical" else logging.WARNING
            log.log(level, "alert id=%d type=%s severity=%s observed_asn=%d peer=%s", a.id, a.type, a.severity, a.observed_asn, a.peer)

    return write


def webhook_sink(url: str, timeout: float = 10.0, queue: int = WEBHOOK_QUEUE, post: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """POST of each alert by a thread of its own, best effort: a batch only puts its alerts into a bounded queue, and those that find it full are dropped and counted.

    The function it gives has `drain`, which waits until the queue is empty.
    """
    waiting: Queue[tuple[int, bytes]] = Queue(queue)

    def send(body: bytes) -> None:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()

    def work() -> None:
        while True:
            number, body = waiting.get()
            try:
                (post or send)(body)
            except (OSError, ValueError) as e:
                log.warning("webhook: alert %d not delivered: %s", number, e)
            finally:
                waiting.task_done()

    Thread(target=work, daemon=True).start()

    def write(alerts: DataFrame, batch: int) -> None:
        dropped = 0
        for row in as_json(alerts).orderBy("id").toLocalIterator():
            try:
                waiting.put_nowait((row.id, row.json.encode()))
            except Full:
                dropped += 1
        if dropped:
            log.warning("webhook: %d alerts of batch %d found the queue full and are dropped", dropped, batch)

    write.drain = waiting.join
    return write


def parse_json(text: str):
    """A strict JSON document, or None: nothing may follow it; of equal keys the first counts."""

    def first(pairs):
        out = {}
        for k, v in pairs:
            out.setdefault(k, v)
        return out

    try:
        return json.loads(text, object_pairs_hook=first, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return None
