"""Ordered folds: update-rate spikes and alert cooldown.

A key's rows are brought together by one hash exchange and sorted by arrival order; the fold then streams over them with
constant state, so that a key of any size needs no more memory than a small one.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import COOLDOWN_SECONDS


class Spike:
    """The rate tracker of one key: two buckets that approximate a sliding window, anchored at the key's first event."""

    __slots__ = ("start", "first", "current", "previous", "total")

    def __init__(self, ts: float, start: float | None = None, current: int = 0, previous: int = 0, total: int = 0):
        self.first, self.start = ts, ts if start is None else start
        self.current, self.previous, self.total = current, previous, total

    def add(self, ts: float, window: float, factor: float, least: int) -> int | None:
        """Count one event; the events in the sliding window if that is a spike."""
        age = ts - self.start
        if age >= 2 * window:
            self.start, self.current, self.previous = ts, 0, 0
        elif age >= window:
            self.start, self.previous, self.current = self.start + window, self.current, 0
        self.current += 1
        self.total += 1
        # the part of the previous bucket that the sliding window still has
        part = max(0.0, 1.0 - (ts - self.start) / window)
        seen = self.current + self.previous * part
        past = self.start - self.first
        usual = (self.total - self.current) / past if past > 0 else 0.0
        return int(seen) if seen > max(factor * usual * window, float(least)) else None


class Cooldown:
    """Suppresses alerts of a key within some seconds of the last one emitted; time 0 starts none."""

    __slots__ = ("last",)

    def __init__(self, last: float = 0.0):
        self.last = last

    def passes(self, ts: float, seconds: float) -> bool:
        if self.last != 0 and ts - self.last < seconds:
            return False
        self.last = ts
        return True


def streaming_fold(rows: DataFrame, key: list[str], order: list[str], fold: Callable[[], Callable[[dict], object | None]], value_type: str = "bigint", value: str = "value") -> DataFrame:
    """rows with the fold's value for each, where it isn't null. fold() makes a function of a row (as a dict) for every new key."""
    columns = rows.columns
    schema = rows.select(*columns, F.lit(None).cast(value_type).alias(value)).schema

    def run(batches):
        at, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(columns.index(k)).to_pylist() for k in key)))
            values = []
            for k, row in zip(keys, batch.to_pylist()):
                if state is None or k != at:
                    at, state = k, fold()
                values.append(state(row))
            keep = pa.array([v is not None for v in values])
            out = batch.append_column(value, pa.array(values, pa.int64() if value_type == "bigint" else None))
            yield out.filter(keep)

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, *key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def spikes(events: DataFrame, key: list[str], window: float = 60.0, factor: float = 10.0, least: int = 20) -> DataFrame:
    """Events at which a key's rate is a spike, with window_count. events need seq and ts besides the key."""
    window, least = window if window > 0 else 60.0, least if least > 0 else 20

    def fold():
        state: Spike | None = None

        def step(row):
            nonlocal state
            if state is None:
                state = Spike(row["ts"])
            return state.add(row["ts"], window, factor, least)

        return step

    return streaming_fold(events, key, ["seq"], fold, value="window_count")


def cooled(candidates: DataFrame, key: list[str], seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """candidates (seq, ord, ts and the key) with emitted: 1 where an alert is emitted, 0 where it is suppressed."""

    def fold():
        state = Cooldown()
        return lambda row: int(state.passes(row["ts"], seconds))

    return streaming_fold(candidates, key, ["seq", "ord"], fold, value="emitted")


STATE = "state array<double>"


def continued_fold(rows: DataFrame, prior: DataFrame | None, key: list[str], order: list[str], restore: Callable, step: Callable, save: Callable, value: str) -> tuple[DataFrame, DataFrame]:
    """A fold that goes on from the states of an earlier one: (rows with values that aren't null, states of all keys).

    restore(state or None, row) makes an object, step(object, row) gives a value, save(object) a list of numbers. The
    result is computed once for both parts; the caller keeps it.
    """
    columns = rows.columns
    first = rows.withColumn("_rank", F.lit(1)).withColumn("state", F.lit(None).cast("array<double>"))
    if prior is not None:
        first = first.unionByName(prior.select(*key, "state").withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    kept = first.withColumn(value, F.lit(None).cast("bigint"))
    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(kept.schema)])

    def run(batches):
        at, state = None, None

        def saved(k, s):
            return dict(zip(key, k)) | {"_rank": 0, "state": save(s)}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k = tuple(row[c] for c in key)
                if k != at:
                    if state is not None:
                        out.append(saved(at, state))
                    at, state = k, None
                if row["_rank"] == 0:
                    state = restore(row["state"], None)
                    continue
                if state is None:
                    state = restore(None, row)
                if (v := step(state, row)) is not None:
                    out.append(row | {value: v})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([saved(at, state)], schema=arrow)

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.repartition(spread, *key).sortWithinPartitions(*key, "_rank", *order).mapInArrow(run, kept.schema)
    return both.where("_rank = 1").select(*columns, value), both.where("_rank = 0").select(*key, "state")


def continued_spikes(events: DataFrame, prior: DataFrame | None, key: list[str], window: float, factor: float, least: int) -> tuple[DataFrame, DataFrame]:
    window, least = window if window > 0 else 60.0, least if least > 0 else 20

    def restore(saved, row):
        if saved is None:
            return Spike(row["ts"])
        first, start, current, previous, total = saved
        return Spike(first, start, int(current), int(previous), int(total))

    def save(s):
        return [s.first, s.start, float(s.current), float(s.previous), float(s.total)]

    return continued_fold(events, prior, key, ["seq"], restore, lambda s, row: s.add(row["ts"], window, factor, least), save, "window_count")


def continued_cooldown(candidates: DataFrame, prior: DataFrame | None, key: list[str], seconds: float) -> tuple[DataFrame, DataFrame]:
    return continued_fold(candidates, prior, key, ["seq", "ord"], lambda saved, _: Cooldown(saved[0] if saved else 0.0), lambda s, row: int(s.passes(row["ts"], seconds)), lambda s: [s.last], "emitted")
