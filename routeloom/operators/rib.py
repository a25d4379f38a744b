"""The routing table: current routes, their history, and lookups.

A route is what a peer last announced for a prefix and did not withdraw. The state of a key is an aggregate with the
latest row by arrival order, so it is combined before the shuffle and a hot key costs no more than its rows' scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aspath import event_origin, path_origin
from ..functions.prefix import mask, parse_text
from ..schema import HISTORY, PREFIX

KEY = (*PREFIX, "peer")


def current(events: DataFrame) -> DataFrame:
    """One row for each live route: prefix, peer, path, origin, origin_attr, next_hop, first_seen, inserted_seq, last_updated, last_seq."""
    route = F.struct("seq", "ts", "kind", "path", "origin_attr", "next_hop", "peer_asn")
    latest = events.groupBy(*KEY).agg(
        F.max_by(route, F.col("seq")).alias("r"), F.coalesce(F.max(F.when(F.col("kind") == "withdraw", F.col("seq"))), F.lit(-1)).alias("withdrawn_seq")
    ).where("r.kind = 'announce'")
    # the first announcement after the last withdrawal put the route in
    keys = latest.select(*(F.col(k).alias(f"_{k}") for k in KEY), "withdrawn_seq")
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    since = events.where("kind = 'announce'").select(*KEY, "seq", "ts").join(keys, same).where(F.col("seq") > F.col("withdrawn_seq"))
    first = since.groupBy(*KEY).agg(F.min_by("ts", "seq").alias("first_seen"), F.min("seq").alias("inserted_seq"))
    out = latest.join(first, list(KEY))
    return out.select(
        *KEY, F.col("r.peer_asn").alias("peer_asn"), F.col("r.path").alias("path"), path_origin(F.col("r.path")).alias("origin"), F.col("r.origin_attr").alias("origin_attr"),
        F.col("r.next_hop").alias("next_hop"), "first_seen", "inserted_seq", F.col("r.ts").alias("last_updated"), F.col("r.seq").alias("last_seq"),
    )


def live(events: DataFrame) -> DataFrame:
    """The live routes without first_seen: one aggregate."""
    latest = events.groupBy(*KEY).agg(F.max_by(F.struct("kind", "path", "ts", "seq"), F.col("seq")).alias("r")).where("r.kind = 'announce'")
    return latest.select(*KEY, F.col("r.path").alias("path"), path_origin(F.col("r.path")).alias("origin"), F.col("r.ts").alias("last_updated"), F.col("r.seq").alias("last_seq"))


def changes(events: DataFrame) -> DataFrame:
    """Every announcement and every withdrawal of a route that was held; others change nothing."""
    before = F.lag("kind").over(Window.partitionBy(*KEY).orderBy("seq"))
    return events.withColumn("_before", before).where((F.col("kind") == "announce") | (F.col("_before") == "announce")).drop("_before")


def history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last changes of each prefix, with position 1 for the oldest kept."""
    recent = Window.partitionBy(*PREFIX).orderBy(F.desc("seq"))
    kept = changes(events).select(*PREFIX, "seq", "ts", "kind", "peer", event_origin(F.col("kind"), F.col("path")).alias("origin")).withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= keep)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*PREFIX).orderBy("seq"))).drop("_r")


def at_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of exactly this prefix; none if the text is no prefix."""
    p = parse_text(prefix)
    if p is None:
        return rows.limit(0)
    return rows.where((F.col("family") == p[0]) & (F.col("len") == p[1]) & (F.col("hi") == p[2]) & (F.col("lo") == p[3]))


def lookup(events: DataFrame, prefix: str) -> DataFrame:
    """The live routes of a prefix, the newest inserted peer first, with their position."""
    routes = current(at_prefix(events, prefix))
    return routes.withColumn("position", F.row_number().over(Window.partitionBy(*PREFIX).orderBy(F.desc("inserted_seq"))))


def more_specifics(routes: DataFrame, prefix: str) -> DataFrame:
    """Live routes strictly inside a prefix."""
    family, length, hi, lo = parse_text(prefix)
    masked = mask(F.col("hi"), F.col("lo"), F.lit(length))
    return routes.where((F.col("family") == family) & (F.col("len") > length) & (masked[0] == hi) & (masked[1] == lo))


def at_covers(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose prefix covers a prefix, itself included: a filter on at most 33 or 129 networks, so that events can be chosen before they are aggregated."""
    family, length, hi, lo = parse_text(prefix)
    masked = mask(F.lit(hi), F.lit(lo), F.col("len"))
    return rows.where((F.col("family") == family) & (F.col("len") <= length) & (F.col("hi") == masked[0]) & (F.col("lo") == masked[1]))


def covering(routes: DataFrame, prefix: str) -> DataFrame:
    """Live routes of the prefixes that cover a prefix, itself included; order by len for the least specific first. See at_covers for events."""
    return at_covers(routes, prefix)


def by_origin(routes: DataFrame, asn: int) -> DataFrame:
    return routes.where(F.col("origin") == asn)


def dominant_origin(routes: DataFrame) -> DataFrame:
    """(prefix, origin, votes): the origin most peers have; the lowest of equals; no row without an origin."""
    votes = routes.where("origin <> 0").groupBy(*PREFIX, "origin").agg(F.count("*").alias("votes"))
    best = F.max(F.struct(F.col("votes"), (-F.col("origin")).alias("o"))).alias("b")
    return votes.groupBy(*PREFIX).agg(best).select(*PREFIX, (-F.col("b.o")).alias("origin"), F.col("b.votes").alias("votes"))


def stats(events: DataFrame) -> DataFrame:
    """One row: prefixes ever announced, live routes, events applied."""
    one = F.struct(*PREFIX)
    seen = events.agg(F.countDistinct(F.when(F.col("kind") == "announce", one)).alias("prefixes"), F.count("*").alias("events_applied"))
    routes = live(events).agg(F.count("*").alias("routes"))
    return seen.join(F.broadcast(routes))  # one row each


def event_counts(events: DataFrame) -> DataFrame:
    """One row: announces, withdraws, distinct prefixes of all events, distinct origins."""
    origin = event_origin(F.col("kind"), F.col("path"))
    return events.agg(
        F.count_if(F.col("kind") == "announce").alias("announces"), F.count_if(F.col("kind") == "withdraw").alias("withdraws"),
        F.countDistinct(F.struct(*PREFIX)).alias("distinct_prefixes"), F.countDistinct(F.when(origin != 0, origin)).alias("distinct_origins"),
    )
