"""The registered queries of the routing engine, over the route events of sources.fixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspath
from ..functions.prefix import bit, format_v4, mask, parse_v4, v4_net
from ..operators import alerts, baseline, rib
from ..operators.coverjoin import cover_join
from ..operators.folds import spikes
from ..operators.leak import leaks, relationship_rows
from ..operators.rov import validate
from ..schema import PREFIX
from ..sources import fixture, live, vrp

WINDOW, SPIKE = 259200.0, (21600.0, 3.0, 4)
RELATIONS = relationship_rows(fixture.PROVIDERS, fixture.PEERS)
SETTINGS = alerts.Settings(WINDOW, *SPIKE, relationships=RELATIONS)
WATCHED = [("10.1.0.0/16", 65001), ("10.2.16.0/20", 65002), ("10.3.0.0/16", 0)]


def _net() -> Column:
    return v4_net(F.col("hi")).alias("net")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.route_events(spark, sf_dir)


def _announces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.announces(_events(spark, sf_dir))


def _baseline(spark: SparkSession, sf_dir: str, watched: list[tuple[str, int]] = ()) -> DataFrame:
    return baseline.baselines(_events(spark, sf_dir), fixture.watchlist(spark, watched), WINDOW).persist()


def _joined(numbers: Column) -> Column:
    return aspath.format_path(numbers)


def rov_state(spark, d):
    ann = _announces(spark, d)
    return validate(ann, fixture.vrps(spark)).select("seq", "len", _net(), "origin", "rov")


def rpki_invalid(spark, d):
    ann = _announces(spark, d)
    return validate(ann, fixture.vrps(spark)).where("rov = 'invalid'").select("seq", "len", _net(), F.col("origin").alias("observed_asn"))


def rov_counts(spark, d):
    return rov_state(spark, d).groupBy("rov").agg(F.count("*").alias("n"))


def _prefixes(spark, d):
    return _events(spark, d).select(*PREFIX).distinct()


def prefix_format(spark, d):
    return _prefixes(spark, d).select("len", _net(), format_v4(F.col("hi"), F.col("len")).alias("prefix"))


def prefix_parse(spark, d):
    texts = _events(spark, d).select("seq", format_v4(F.col("hi") + F.shiftleft(F.col("seq") % 200, 32), F.col("seq") % 35).alias("text"))
    p = texts.withColumn("p", parse_v4(F.col("text")))
    return p.select("seq", "text", F.col("p.len").alias("len"), v4_net(F.col("p.hi")).alias("net"))


def prefix_mask(spark, d):
    columns = [v4_net(mask(F.col("hi"), F.col("lo"), F.lit(n))[0]).alias(f"m{n}") for n in (0, 8, 15, 20)]
    return _events(spark, d).select("seq", *columns, bit(F.col("hi"), F.col("lo"), F.lit(19)).alias("bit19"))


def prefix_covers(spark, d):
    p = _prefixes(spark, d)
    return cover_join(p, p).select("len", _net(), "cover_len", v4_net(F.col("cover_hi")).alias("cover_net"))


def path_origin(spark, d):
    e = _events(spark, d)
    return e.select("seq", aspath.path_origin(F.col("path")).alias("path_origin"), aspath.event_origin(F.col("kind"), F.col("path")).alias("event_origin"))


def path_format(spark, d):
    return _events(spark, d).select("seq", aspath.format_path(F.col("path")).alias("path_text"))


def path_parse(spark, d):
    text = F.when(F.col("seq") % 7 == 3, F.concat(aspath.format_path(F.col("path")), F.lit(" 4294967296"))).when(F.col("seq") % 7 == 5, F.lit("12 x")).otherwise(aspath.format_path(F.col("path")))
    parsed = _events(spark, d).select("seq", aspath.parse_path(text).alias("p"))
    return parsed.select("seq", F.col("p").isNotNull().alias("ok"), F.coalesce(F.size("p"), F.lit(-1)).alias("hops"), F.coalesce(aspath.path_origin(F.col("p")), F.lit(0)).alias("origin"))


def path_as4_merge(spark, d):
    four = F.when(F.col("seq") % 3 == 0, F.array(F.lit(4200000000) + F.col("seq") % 9, F.lit(4200000001))).when(F.col("seq") % 3 == 1, F.array_repeat(F.lit(4200000002), 9)).otherwise(F.array().cast("array<bigint>"))
    return _events(spark, d).select("seq", aspath.format_path(aspath.merge_as4(F.col("path"), four)).alias("path_text"))


def community_encode(spark, d):
    return _events(spark, d).select("seq", aspath.community(F.col("peer_asn"), F.col("seq")).alias("community"))


def _origin_text() -> Column:
    k = F.col("seq") % 4
    return F.when(k == 0, "igp").when(k == 1, "egp").when(k == 2, "incomplete")


def origin_attr_map(spark, d):
    return _events(spark, d).select("seq", aspath.origin_attribute(_origin_text()).cast("int").alias("origin_attr"))


def next_hop_select(spark, d):
    classic = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("192.0.2."), (F.col("seq") % 250).cast("string")))
    other = F.when(F.col("seq") % 2 == 0, F.lit("2001:db8::1"))
    return _events(spark, d).select("seq", aspath.next_hop(classic, other).alias("next_hop"))


def event_counts(spark, d):
    return rib.event_counts(_events(spark, d)).select("announces", "withdraws")


def distinct_prefix_origin(spark, d):
    return rib.event_counts(_events(spark, d)).select("distinct_prefixes", "distinct_origins")


def rib_current(spark, d):
    return rib.live(_events(spark, d)).select("len", _net(), "peer", "origin", aspath.format_path(F.col("path")).alias("path_text"), "last_updated", "last_seq")


def rib_first_seen(spark, d):
    return rib.current(_events(spark, d)).select("len", _net(), "peer", "first_seen", "inserted_seq", "last_updated")


def rib_lookup(spark, d):
    return rib.lookup(_events(spark, d), "10.3.16.0/20").select("position", "peer", "origin", "first_seen", "last_updated")


def rib_history(spark, d):
    return rib.history(_events(spark, d)).select("len", _net(), "position", "seq", "kind", "peer", "origin")


def rib_more_specifics(spark, d):
    return rib.more_specifics(rib.live(_events(spark, d)), "10.0.0.0/13").select("len", _net(), "peer", "origin")


def rib_covering(spark, d):
    return rib.covering(rib.live(rib.at_covers(_events(spark, d), "10.3.17.0/24")), "10.3.17.0/24").select("len", _net(), "peer", "origin")


def rib_by_origin(spark, d):
    return rib.by_origin(rib.live(_events(spark, d)), 65003).select("len", _net(), "peer")


def rib_dominant_origin(spark, d):
    return rib.dominant_origin(rib.live(_events(spark, d))).select("len", _net(), "origin", "votes")


def rib_stats(spark, d):
    return rib.stats(_events(spark, d))


def effective_withdraws(spark, d):
    return rib.changes(_events(spark, d)).where("kind = 'withdraw'").select("seq", "len", _net(), "peer")


def baseline_lock(spark, d):
    return _baseline(spark, d).select("len", _net(), "first_ts", "lock_seq")


def baseline_origins(spark, d):
    return _baseline(spark, d).select("len", _net(), _joined(F.col("origins")).alias("origins"))


def watch_seed(spark, d):
    return _baseline(spark, d, WATCHED).select("len", _net(), "lock_seq", _joined(F.col("origins")).alias("origins"), "watched")


def hijack(spark, d):
    return baseline.hijacks(_events(spark, d), _baseline(spark, d)).select("seq", "len", _net(), "expected_asn", "observed_asn", "severity")


def hijack_watched(spark, d):
    return baseline.hijacks(_events(spark, d), _baseline(spark, d, WATCHED)).select("seq", "len", _net(), "expected_asn", "observed_asn", "severity")


def subprefix(spark, d):
    return baseline.subprefixes(_events(spark, d), _baseline(spark, d)).select("seq", "len", _net(), "cover_len", "expected_asn", "observed_asn", "severity")


def leak(spark, d):
    return leaks(_events(spark, d), RELATIONS).select("seq", "leaker", "leaked_to")


def rel_edges(spark, d):
    return fixture.relationships(spark)


def spike_prefix(spark, d):
    return spikes(_events(spark, d).select("seq", "ts", *PREFIX), list(PREFIX), *SPIKE).select("seq", "len", _net(), "window_count")


def spike_peer(spark, d):
    return spikes(_events(spark, d).select("seq", "ts", "peer", "peer_asn"), ["peer"], *SPIKE).select("seq", "peer", "peer_asn", "window_count")


def _candidates(spark, d):
    return alerts.candidates(_events(spark, d), fixture.vrps(spark), fixture.watchlist(spark), SETTINGS)


def cooldown(spark, d):
    return alerts.emitted(_candidates(spark, d), 86400.0).select("seq", "ord", "type", "observed_asn", "emitted")


def _alerts(spark, d):
    return alerts.numbered(alerts.emitted(_candidates(spark, d)).where("emitted = 1"))


def alerts_all(spark, d):
    return _alerts(spark, d).select("id", "seq", "ord", "ts", "type", "severity", "len", _net(), "expected_asn", "observed_asn", "peer")


def alerts_query(spark, d):
    return alerts.query(_alerts(spark, d), severity="warning", limit=60).select("id", "seq", "type", "severity")


def alert_counts(spark, d):
    return alerts.counts(_alerts(spark, d))


def engine_stats(spark, d):
    found = alerts.emitted(_candidates(spark, d)).agg(
        F.count_if(F.col("emitted") == 0).alias("suppressed"), *(F.count_if((F.col("emitted") == 1) & (F.col("type") == t)).alias(t) for t in alerts.ALERT_TYPES)
    )
    return _events(spark, d).agg(F.count("*").alias("events")).join(F.broadcast(found))  # one row each


ROAS = [
    ("1.1.1.0/24", "13335", "24"), ("8.8.8.0/24", "AS15169", "24"), ("192.0.2.0/24", "as64500", "28"), ("198.51.100.0/24", "64501", None), ("203.0.113.7/24", "64500", "24"),
    ("203.0.113.0/24", "64500", "24"), ("10.66.0.0/16", "0", "16"), ("10.0.0.0/33", "1", "33"), ("10.0.0.0/8", "4294967296", "8"), ("10.0.0.0/16", "7", "12"), ("10.0.0/16", "7", "16"),
]


def vrp_load(spark, d):
    rows = spark.createDataFrame(ROAS, "prefix string, asn string, maxLength string")
    return vrp.valid(rows, ipv6=False).select("len", _net(), "asn", "max_len")


def ris_parse(spark, d):
    """Every event as a line of a live feed, parsed again."""
    e = _events(spark, d)
    prefix = format_v4(F.col("hi"), F.col("len"))
    path = F.when(F.col("origin_from_set"), F.concat(F.lit("["), F.array_join(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x: x.cast("string")), ","), F.lit(",["), aspath.path_origin(F.col("path")).cast("string"), F.lit(",64999]]"))).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("path", lambda x: x.cast("string")), ","), F.lit("]")))
    body = F.when(
        F.col("kind") == "announce",
        F.concat(F.lit('"path":'), path, F.lit(',"origin":"igp","announcements":[{"next_hop":"192.0.2.1","prefixes":["'), prefix, F.lit('","10.0.0.0/99"]}]')),
    ).otherwise(F.concat(F.lit('"withdrawals":["'), prefix, F.lit('"]')))
    line = F.concat(F.lit('{"type":"ris_message","data":{"timestamp":'), F.col("ts").cast("decimal(20,6)").cast("string"), F.lit(',"peer":"'), F.col("peer"), F.lit('","peer_asn":"'), F.col("peer_asn").cast("string"), F.lit('",'), body, F.lit("}}"))
    parsed = live.parse_lines(e.select("seq", line.alias("value")), ipv6=False, order=("seq",))
    return parsed.select("seq", "item", "kind", "len", _net(), aspath.format_path(F.col("path")).alias("path_text"), "origin_from_set", "next_hop", "peer", "peer_asn")


def feed_filter(spark, d):
    return live.feed_filter(_events(spark, d), prefix="10.4.0.0/14").select("seq", "len", _net())


def prefix_view(spark, d):
    e = rib.at_prefix(_events(spark, d), "10.5.0.0/16")
    return rib.dominant_origin(rib.live(e)).select("len", _net(), "origin", "votes").join(F.broadcast(rib.live(e).agg(F.count("*").alias("routes"))))  # one row each


def asn_prefixes(spark, d):
    return rib.by_origin(rib.live(_events(spark, d)), 65007).select(format_v4(F.col("hi"), F.col("len")).alias("prefix"), "peer")


def carve_head(spark, d):
    return _events(spark, d).where("seq < 400").select("seq", "kind", "len", _net())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rov_state, rpki_invalid, rov_counts, prefix_format, prefix_parse, prefix_mask, prefix_covers, path_origin, path_format, path_parse, path_as4_merge, community_encode, origin_attr_map,
        next_hop_select, event_counts, distinct_prefix_origin, rib_current, rib_first_seen, rib_lookup, rib_history, rib_more_specifics, rib_covering, rib_by_origin, rib_dominant_origin,
        rib_stats, effective_withdraws, baseline_lock, baseline_origins, watch_seed, hijack, hijack_watched, subprefix, leak, rel_edges, spike_prefix, spike_peer, cooldown, alerts_all,
        alerts_query, alert_counts, engine_stats, vrp_load, ris_parse, feed_filter, prefix_view, asn_prefixes, carve_head,
    )
}
