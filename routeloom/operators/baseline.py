"""Learned baselines of prefixes, and the two detectors that compare announcements with them.

All comparisons follow arrival order: an announcement is judged by what was learned and locked before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aspath import event_origin
from ..schema import MAX_BASELINE_ORIGINS, PREFIX
from .coverjoin import cover_join


def announces(events: DataFrame) -> DataFrame:
    """Announcements with an origin, and the origin."""
    return events.withColumn("origin", event_origin(F.col("kind"), F.col("path"))).where("kind = 'announce' and origin <> 0")


def _seed(watchlist: DataFrame) -> DataFrame:
    """One row for each watched prefix; the last entry of a prefix counts (entries are ordered by seq if they have one)."""
    order = F.col("seq") if "seq" in watchlist.columns else F.lit(0)
    return watchlist.groupBy(*PREFIX).agg(F.max_by("origin", order).alias("watch_origin"))


def baselines(events: DataFrame, watchlist: DataFrame, window: float, learn_watched: bool = False, prior: DataFrame | None = None) -> DataFrame:
    """One row for each prefix announced or watched: first_ts, lock_seq (null: not locked), origins (in the order learned, at most 4), learned_seq of each, watched.

    The first announcement starts a prefix's window; those within it teach their origins; the first one after it locks the
    prefix and teaches nothing. A watched prefix with an origin is locked from the start with that origin alone (lock_seq
    -1). One without an origin has its window begin at time 0, so that its first announcement locks it without origins;
    with learn_watched its window begins at its first announcement. With prior, an earlier result, events go on from there.
    """
    if prior is not None:
        return _continued(events, prior, window)
    ann = announces(events).select(*PREFIX, "seq", "ts", "origin")
    seed = _seed(watchlist)
    first = ann.groupBy(*PREFIX).agg(F.min_by("ts", "seq").alias("first_ts"))
    first = first.join(F.broadcast(seed.where("watch_origin = 0")), list(PREFIX), "left")  # a watchlist has at most 256 entries
    if not learn_watched:
        first = first.withColumn("first_ts", F.when(F.col("watch_origin").isNotNull(), F.lit(0.0)).otherwise(F.col("first_ts")))
    first = first.withColumn("watched", F.col("watch_origin").isNotNull()).drop("watch_origin")
    fixed = F.broadcast(seed.where("watch_origin <> 0"))
    first = first.join(fixed.select(*PREFIX), list(PREFIX), "left_anti")
    timed = ann.join(first, list(PREFIX))
    late = F.col("ts") - F.col("first_ts") > window
    lock = timed.groupBy(*PREFIX).agg(F.any_value("first_ts").alias("first_ts"), F.any_value("watched").alias("watched"), F.min(F.when(late, F.col("seq"))).alias("lock_seq"))
    learned = timed.groupBy(*PREFIX, "origin").agg(F.min("seq").alias("learned_seq"))
    learned = learned.join(lock.select(*PREFIX, "lock_seq"), list(PREFIX)).where("lock_seq is null or learned_seq < lock_seq")
    # one row for each prefix and origin: the window is small
    ranked = learned.withColumn("r", F.row_number().over(Window.partitionBy(*PREFIX).orderBy("learned_seq"))).where(F.col("r") <= MAX_BASELINE_ORIGINS)
    taught = ranked.groupBy(*PREFIX).agg(F.array_sort(F.collect_list(F.struct("learned_seq", "origin"))).alias("l"))
    none = F.array().cast("array<bigint>")
    out = lock.join(taught, list(PREFIX), "left").select(
        *PREFIX, "first_ts", "lock_seq", F.coalesce(F.transform("l", lambda x: x["origin"]), none).alias("origins"),
        F.coalesce(F.transform("l", lambda x: x["learned_seq"]), none).alias("learned_seqs"), "watched",
    )
    minus = F.lit(-1).cast("bigint")
    seeded = seed.where("watch_origin <> 0").select(
        *PREFIX, F.lit(0.0).alias("first_ts"), minus.alias("lock_seq"), F.array("watch_origin").alias("origins"), F.array(minus).alias("learned_seqs"), F.lit(True).alias("watched")
    )
    unseen = seed.where("watch_origin = 0").join(first.select(*PREFIX), list(PREFIX), "left_anti").select(
        *PREFIX, F.lit(0.0).alias("first_ts"), F.lit(None).cast("bigint").alias("lock_seq"), none.alias("origins"), none.alias("learned_seqs"), F.lit(True).alias("watched")
    )
    return out.union(seeded).union(unseen)


def _continued(events: DataFrame, prior: DataFrame, window: float) -> DataFrame:
    """The baselines after later events: prefixes that are locked stay, others learn on."""
    fresh_rows = announces(events).select(*PREFIX, "seq", "ts", "origin")
    first = fresh_rows.groupBy(*PREFIX).agg(F.min_by("ts", "seq").alias("new_ts"))
    # a watched prefix without an origin that has been seen in no event yet has its window's beginning already
    state = first.join(prior, list(PREFIX), "left").where("lock_seq is null").select(
        *PREFIX, F.coalesce("first_ts", "new_ts").alias("first_ts"), F.coalesce("watched", F.lit(False)).alias("watched"), "origins", "learned_seqs"
    )
    timed = fresh_rows.join(state.select(*PREFIX, "first_ts"), list(PREFIX))
    lock = timed.groupBy(*PREFIX).agg(F.min(F.when(F.col("ts") - F.col("first_ts") > window, F.col("seq"))).alias("lock_seq"))
    before = state.select(*PREFIX, F.explode(F.arrays_zip("origins", "learned_seqs")).alias("o")).select(*PREFIX, F.col("o.origins").alias("origin"), F.col("o.learned_seqs").alias("seq"))
    learned = timed.select(*PREFIX, "origin", "seq").union(before).groupBy(*PREFIX, "origin").agg(F.min("seq").alias("learned_seq"))
    learned = learned.join(lock, list(PREFIX)).where("lock_seq is null or learned_seq < lock_seq")
    ranked = learned.withColumn("r", F.row_number().over(Window.partitionBy(*PREFIX).orderBy("learned_seq"))).where(F.col("r") <= MAX_BASELINE_ORIGINS)
    taught = ranked.groupBy(*PREFIX).agg(F.array_sort(F.collect_list(F.struct("learned_seq", "origin"))).alias("l"))
    none = F.array().cast("array<bigint>")
    moved = state.select(*PREFIX, "first_ts", "watched").join(lock, list(PREFIX)).join(taught, list(PREFIX), "left").select(
        *PREFIX, "first_ts", "lock_seq", F.coalesce(F.transform("l", lambda x: x["origin"]), none).alias("origins"),
        F.coalesce(F.transform("l", lambda x: x["learned_seq"]), none).alias("learned_seqs"), "watched",
    )
    return moved.union(prior.join(moved.select(*PREFIX), list(PREFIX), "left_anti").select(*moved.columns))


def _severity() -> Column:
    return F.when(F.col("watched"), "critical").otherwise("warning")


def hijacks(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Announcements of a locked prefix by an origin that isn't in its baseline: the event's columns, expected_asn, observed_asn, severity."""
    known = baseline.where("lock_seq is not null and size(origins) > 0").select(*PREFIX, "lock_seq", "origins", "watched")
    met = announces(events).where("not origin_from_set").join(known, list(PREFIX)).where("lock_seq < seq")
    out = met.where(~F.array_contains("origins", F.col("origin")))
    return out.withColumns({"expected_asn": F.col("origins")[0], "observed_asn": F.col("origin"), "severity": _severity()}).drop("origins", "watched", "lock_seq")


def subprefixes(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Announcements inside a locked prefix by an origin that neither the nearest locked cover nor the prefix itself has learned."""
    own = baseline.select(*PREFIX, F.explode(F.arrays_zip("origins", "learned_seqs")).alias("o")).select(*PREFIX, F.col("o.origins").alias("known"), F.col("o.learned_seqs").alias("known_seq"))
    ann = announces(events).where("not origin_from_set")
    same = [F.col(k) == F.col(f"_{k}") for k in PREFIX]
    own = own.withColumnsRenamed({k: f"_{k}" for k in PREFIX})
    new = ann.join(own, [*same, F.col("origin") == F.col("known"), F.col("known_seq") < F.col("seq")], "left_anti")
    locked = baseline.where("lock_seq is not null and size(origins) > 0").select(*PREFIX, "lock_seq", "origins", "watched")
    met = cover_join(new, locked, strict=True).where("lock_seq < seq")
    # of an event's covers, at most one for each length, the longest
    nearest = met.groupBy("seq").agg(F.max_by(F.struct(*(F.col(c) for c in ann.columns if c != "seq"), "cover_len", "origins", "watched"), F.col("cover_len")).alias("c")).select("seq", "c.*")
    found = nearest.where(~F.array_contains("origins", F.col("origin")))
    return found.select(*ann.columns, F.col("origins")[0].alias("expected_asn"), F.col("origin").alias("observed_asn"), "cover_len", _severity().alias("severity"))
