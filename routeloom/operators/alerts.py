"""Candidate alerts of all detectors, cooldown, numbering, and the alert store's queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aspath import event_origin, format_path, severity_code
from ..schema import ALERT_QUERY_LIMIT, ALERT_TYPES, COOLDOWN_SECONDS, PREFIX, SEVERITIES
from . import baseline as base
from .folds import cooled, spikes
from .leak import leaks
from .rov import validate

#: Detectors in the order in which they judge an event.
ORDER = ("hijack", "subprefix", "leak", "rpki_invalid", "spike_prefix", "spike_peer")
KEY = ["type", *PREFIX, "observed_asn"]


@dataclass(frozen=True)
class Settings:
    baseline_window: float = 300.0
    spike_window: float = 60.0
    spike_factor: float = 10.0
    spike_min: int = 20
    cooldown: float = COOLDOWN_SECONDS
    relationships: list[tuple[int, int, str]] = field(default_factory=list)
    learn_watched: bool = False


def _alert(rows: DataFrame, detector: str, severity: Column, expected: Column, observed: Column, prefix: bool = True, **extra: Column) -> DataFrame:
    kind = "spike" if detector.startswith("spike") else detector
    zero = {"family": F.lit(0), "len": F.lit(0), "hi": F.lit(0).cast("bigint"), "lo": F.lit(0).cast("bigint")}
    evidence = F.to_json(F.struct(*[F.col(c) for c in PREFIX], format_path(F.col("path")).alias("as_path"), "peer", "peer_asn", "source", *(v.alias(k) for k, v in extra.items())))
    return rows.select(
        "seq", F.lit(ORDER.index(detector)).alias("ord"), "ts", F.lit(kind).alias("type"), severity.alias("severity"), *(F.col(c) if prefix else zero[c].alias(c) for c in PREFIX),
        expected.cast("bigint").alias("expected_asn"), observed.cast("bigint").alias("observed_asn"), "peer", evidence.alias("evidence"),
    )


def candidates(events: DataFrame, vrps: DataFrame | None, watchlist: DataFrame, settings: Settings) -> DataFrame:
    """What the detectors find before cooldown, one row for each event and detector."""
    # two detectors and the lengths of the prefixes read it: one row for each prefix, recomputed should it be lost
    known = base.baselines(events, watchlist, settings.baseline_window, settings.learn_watched).persist()
    rate = (settings.spike_window, settings.spike_factor, settings.spike_min)
    slim = spike_input(events)
    return found_by(events, vrps, known, settings, spikes(slim, list(PREFIX), *rate), spikes(slim, ["peer"], *rate))


def spike_input(events: DataFrame) -> DataFrame:
    return events.select("seq", "ts", *PREFIX, "path", "kind", "peer", "peer_asn", "source")


def found_by(events: DataFrame, vrps: DataFrame | None, known: DataFrame, settings: Settings, by_prefix: DataFrame, by_peer: DataFrame) -> DataFrame:
    """The candidates of all detectors, given the baselines after these events and the spikes."""
    hijack = _alert(base.hijacks(events, known), "hijack", F.col("severity"), F.col("expected_asn"), F.col("observed_asn"))
    sub = base.subprefixes(events, known)
    subprefix = _alert(sub, "subprefix", F.col("severity"), F.col("expected_asn"), F.col("observed_asn"), cover_len=F.col("cover_len"))
    warning, info, zero = F.lit("warning"), F.lit("info"), F.lit(0)
    leaked = leaks(events, settings.relationships)
    out = hijack.union(subprefix).union(_alert(leaked, "leak", warning, zero, F.col("leaker"), leaked_to=F.col("leaked_to")))
    if vrps is not None:
        ann = base.announces(events)
        invalid = validate(ann, vrps).where("rov = 'invalid'")
        out = out.union(_alert(invalid, "rpki_invalid", warning, zero, F.col("origin")))
    count = {"window_count": F.col("window_count")}
    out = out.union(_alert(by_prefix, "spike_prefix", info, zero, event_origin(F.col("kind"), F.col("path")), **count))
    return out.union(_alert(by_peer, "spike_peer", info, zero, F.col("peer_asn"), prefix=False, **count))


def emitted(found: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    return cooled(found, KEY, seconds)


#: Blocks of sequence numbers that are numbered on their own, and blocks of such blocks.
ID_BLOCK = 1 << 16


def numbered(alerts: DataFrame, offset: int = 0) -> DataFrame:
    """alerts with ids from offset + 1 in the order of (seq, ord): numbered within blocks of seq, after the counts of the blocks before.

    The counts are added up within blocks of ID_BLOCK blocks, and those in turn: 2^32 sequence numbers are one row of the last sum.
    """
    rows = alerts.withColumn("_block", F.expr(f"seq div {ID_BLOCK}"))
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_large", F.expr(f"_block div {ID_BLOCK}"))
    large = counts.groupBy("_large").agg(F.sum("_n").alias("_m"))
    large = large.select("_large", (F.sum("_m").over(Window.orderBy("_large")) - F.col("_m")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_large").orderBy("_block")) - F.col("_n")
    before = counts.withColumn("_within", within).join(large, "_large").select("_block", (F.col("_before") + F.col("_within")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("seq", "ord"))
    return rows.withColumn("_own", own).join(before, "_block").withColumn("id", F.lit(offset) + F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def query(alerts: DataFrame, type: str | None = None, severity: str | None = None, since: float | None = None, prefix: tuple | None = None, limit: int = ALERT_QUERY_LIMIT) -> DataFrame:  # noqa: A002
    """The newest alerts first. Type, time and prefix choose before the limit, severity (at least) after it; unknown names choose nothing."""
    if type in ALERT_TYPES:
        alerts = alerts.where(F.col("type") == type)
    if since is not None:
        alerts = alerts.where(F.col("ts") >= since)
    if prefix is not None:
        for name, value in zip(PREFIX, prefix):
            alerts = alerts.where(F.col(name) == value)
    newest = alerts.orderBy(F.desc("id")).limit(limit if limit > 0 else ALERT_QUERY_LIMIT)
    if severity in SEVERITIES:
        newest = newest.where(severity_code(F.col("severity")) >= SEVERITIES.index(severity))
    return newest


def counts(alerts: DataFrame) -> DataFrame:
    """(type, count) for all five types, zeros included."""
    types = alerts.sparkSession.createDataFrame([(t,) for t in ALERT_TYPES], "type string")
    return types.join(alerts.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("count"))
