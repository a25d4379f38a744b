"""The engine as a Structured Streaming job.

Every micro-batch appends its events, moves the keyed states on (baselines, spike trackers, cooldown, routing table),
judges the batch and appends its alerts. States are versions by batch number in the job's folder, which all executors
share; a batch that is repeated after a failure starts from the version before it and overwrites its own, so its effects
are those of one run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, baseline, rib
from ..operators.folds import continued_cooldown, continued_spikes
from ..operators.rib import KEY as ROUTE
from ..schema import PREFIX


#: Tables of which a batch's version replaces the one before.
STATES = ("baselines", "spike_prefix_state", "spike_peer_state", "candidates", "cooldown_state", "counts", "routes")


@dataclass
class Engine:
    """Judges batches of route events (with seq); folder holds its tables. sinks get the alerts of each batch (see sinks.alerts)."""

    spark: SparkSession
    folder: str
    settings: alerts.Settings
    vrps: DataFrame | None
    watchlist: DataFrame
    sinks: tuple[Callable[[DataFrame, int], None], ...] = ()
    #: Versions of the states that are kept, at least 2.
    versions: int = 8

    def path(self, table: str, batch: int | None = None) -> str:
        return f"{self.folder}/{table}" + (f"/batch={batch}" if batch is not None else "")

    def _prior(self, table: str, batch: int) -> DataFrame | None:
        return self.spark.read.parquet(self.path(table, batch - 1)) if batch else None

    def _keep(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(table, batch))
        return self.spark.read.parquet(self.path(table, batch))

    def next_seq(self, batch: int) -> int:
        """The arrival number that follows those of the batches before."""
        before = self._prior("counts", batch)
        return before.first().next_seq if before is not None else 0

    def process(self, events: DataFrame, batch: int) -> None:
        events = self._keep(events, "events", batch)
        s = self.settings
        known = baseline.baselines(events, self.watchlist, s.baseline_window, s.learn_watched, prior=self._prior("baselines", batch))
        known = self._keep(known, "baselines", batch)
        rate = (s.spike_window, s.spike_factor, s.spike_min)
        slim, found = alerts.spike_input(events), []
        for name, key in (("spike_prefix", list(PREFIX)), ("spike_peer", ["peer"])):
            rows, states = continued_spikes(slim, self._prior(f"{name}_state", batch), key, *rate)
            self._keep(states, f"{name}_state", batch)
            found.append(rows)
        candidates = self._keep(alerts.found_by(events, self.vrps, known, s, *found), "candidates", batch)
        judged, states = continued_cooldown(candidates, self._prior("cooldown_state", batch), alerts.KEY, s.cooldown)
        self._keep(states, "cooldown_state", batch)
        before = self._prior("counts", batch)
        offset, next_seq, suppressed = before.first()[:] if before is not None else (0, 0, 0)
        emitted = self._keep(alerts.numbered(judged.where("emitted = 1").drop("emitted"), offset), "alerts", batch)
        last = events.agg(F.max("seq")).first()[0]
        next_seq = next_seq if last is None else max(next_seq, last + 1)
        self._keep(self.spark.createDataFrame([(offset + (n := emitted.count()), next_seq, suppressed + candidates.count() - n)], "last_id bigint, next_seq bigint, suppressed bigint"), "counts", batch)
        self._keep(self._routes(events, batch), "routes", batch)
        for sink in self.sinks:
            sink(emitted, batch)
        self._forget(batch - max(2, self.versions))  # a batch that is repeated needs the version before it

    def _forget(self, batch: int) -> None:
        """Delete the states of a batch that no repetition needs. Events, routes of the newest batch and alerts stay."""
        if batch < 0:
            return
        jvm = self.spark.sparkContext._jvm
        for table in STATES:
            target = jvm.org.apache.hadoop.fs.Path(self.path(table, batch))
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _routes(self, events: DataFrame, batch: int) -> DataFrame:
        """The last event of each prefix and peer; routes are those that are announcements."""
        latest = events.select(*ROUTE, "seq", "ts", "kind", "path", "origin_attr", "next_hop")
        prior = self._prior("routes", batch)
        if prior is not None:
            latest = latest.unionByName(prior)
        columns = [c for c in latest.columns if c not in ROUTE]
        return latest.groupBy(*ROUTE).agg(F.max_by(F.struct(*columns), "seq").alias("r")).select(*ROUTE, "r.*")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a stream of route events; trigger as for writeStream.trigger, such as availableNow=True."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def alerts(self) -> DataFrame:
        return self.spark.read.parquet(self.path("alerts"))

    def events(self) -> DataFrame:
        return self.spark.read.parquet(self.path("events")).drop("batch")

    def stats(self) -> dict:
        """Counts of the routing table, the engine and the store, as they have been written."""
        table = rib.stats(self.events()).first().asDict()
        found = {r.type: r["count"] for r in alerts.counts(self.alerts()).collect()}
        suppressed = self.spark.read.parquet(self.path("counts")).agg(F.max("suppressed")).first()[0]  # a running count: the newest is the largest
        return {"rib": table, "engine": {"events": table["events_applied"], "suppressed": suppressed}, "alerts": found}
