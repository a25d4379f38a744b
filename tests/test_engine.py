import random

import pytest
from helpers import ann, frame, simulate, wd
from pyspark.sql import functions as F

from routeloom import api
from routeloom.functions.prefix import format_text, parse_text
from routeloom.operators import alerts, baseline, rib
from routeloom.operators.folds import cooled, spikes
from routeloom.operators.leak import leaks, relationship_rows
from routeloom.operators.rov import validate
from routeloom.schema import VRPS, WATCHLIST
from routeloom.sinks.alerts import as_json, log_sink, table_sink, webhook_sink
from routeloom.sources import fixture
from routeloom.streaming.job import Engine

ROAS = [("1.1.1.0/24", 13335, 24), ("8.8.8.0/24", 15169, 24), ("192.0.2.0/24", 64500, 28), ("203.0.113.0/24", 64500, 24), ("203.0.113.0/24", 64502, 26), ("10.66.0.0/16", 0, 16), ("2001:db8::/32", 64510, 48)]


def vrps(spark):
    return spark.createDataFrame([(*parse_text(p), asn, n) for p, asn, n in ROAS], VRPS)


def watch(spark, *entries):
    return spark.createDataFrame([(*parse_text(p), o) for p, o in entries], WATCHLIST)


def texts(rows):
    return sorted(format_text(r.family, r.len, r.hi, r.lo) for r in rows.collect())


def test_rib_votes(spark):
    p = "192.0.2.0/24"
    rows = [ann(1, 1, p, [1, 15169], peer="p1"), ann(2, 2, p, [2, 15169], peer="p2"), ann(3, 3, p, [3, 64666], peer="p3"), wd(4, 4, p, peer="p9"), ann(5, 5, p, [1, 15169], peer="p1")]
    view = api.prefix_view(frame(spark, rows), p)
    assert view["dominant_origin"] == 15169 and [r["peer"] for r in view["routes"]] == ["p3", "p2", "p1"] and len(view["history"]) == 4
    assert view["routes"][2]["first_seen"] == 1 and view["routes"][2]["last_updated"] == 5
    gone = rows + [wd(5 + i, 6, p, peer=f"p{i}") for i in (1, 2, 3)]
    view = api.prefix_view(frame(spark, gone), p)
    assert view["dominant_origin"] == 0 and view["routes"] == [] and len(view["history"]) == 7
    assert api.prefix_view(frame(spark, rows), "9.9.9.0/24")["routes"] == []
    with pytest.raises(api.BadRequest):
        api.prefix_view(frame(spark, rows), "9.9.9.0")


def test_rib_nesting_and_stats(spark):
    prefixes = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.128.0.0/9", "11.0.0.0/8"]
    events = frame(spark, [ann(i, i, p, [1, 100 + i]) for i, p in enumerate(prefixes)] + [wd(9, 9, "11.0.0.0/8")])
    live = rib.live(events)
    assert texts(rib.more_specifics(live, "10.0.0.0/8")) == ["10.1.0.0/16", "10.1.2.0/24", "10.128.0.0/9"]
    assert texts(rib.covering(live, "10.1.2.0/24")) == ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24"]
    assert texts(rib.by_origin(live, 103)) == ["10.128.0.0/9"]
    s = rib.stats(events).first()
    assert (s.prefixes, s.routes, s.events_applied) == (5, 4, 6)
    assert api.asn_prefixes(events, "103abc").count() == 1


def test_history_is_bounded(spark):
    events = frame(spark, [ann(i, i, "10.0.0.0/8", [1]) for i in range(50)])
    h = rib.history(events).orderBy("position").collect()
    assert [r.seq for r in h] == list(range(18, 50)) and h[0].position == 1


def test_rov(spark):
    cases = [("1.1.1.0/24", 13335, "valid"), ("1.1.1.0/25", 13335, "invalid"), ("1.1.1.0/24", 1, "invalid"), ("9.9.9.0/24", 1, "notfound"), ("192.0.2.16/28", 64500, "valid"), ("192.0.2.0/29", 64500, "invalid"),
             ("203.0.113.64/26", 64502, "valid"), ("203.0.113.64/26", 64500, "invalid"), ("10.66.0.0/16", 0, "invalid"), ("2001:db8:1::/48", 64510, "valid"), ("2001:db8:1::/49", 64510, "invalid"), ("1.1.0.0/16", 13335, "notfound")]
    rows = spark.createDataFrame([(i, *parse_text(p), asn) for i, (p, asn, _) in enumerate(cases)], "seq bigint, family int, len int, hi bigint, lo bigint, origin bigint")
    got = {r.seq: r.rov for r in validate(rows, vrps(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]
    assert validate(rows, vrps(spark).limit(0)).where("rov <> 'notfound'").count() == 0
    assert api.rov(vrps(spark), "8.8.8.0/24", 15169) == "valid"


def judged(spark, rows, entries=(), settings=alerts.Settings()):
    found = alerts.candidates(frame(spark, rows), vrps(spark), watch(spark, *entries), settings)
    return alerts.emitted(found, settings.cooldown)


def test_watched_hijack_and_cooldown(spark):
    p = "192.0.2.0/24"
    got = judged(spark, [ann(i, t, p, [1, 64666]) for i, t in enumerate((1100, 1150, 1500))], [(p, 64500)]).where("type = 'hijack'").orderBy("seq").collect()
    assert [(r.seq, r.emitted, r.severity, r.expected_asn) for r in got] == [(0, 1, "critical", 64500), (1, 0, "critical", 64500), (2, 1, "critical", 64500)]


def test_learned_origins(spark):
    p = "10.9.0.0/16"
    rows = [ann(0, 0, p, [1, 100]), ann(1, 100, p, [1, 200]), ann(2, 400, p, [1, 300]), ann(3, 500, p, [1, 300]), ann(4, 501, p, [1, 200])]
    known = baseline.baselines(frame(spark, rows), watch(spark), 300.0).first()
    assert known.origins == [100, 200] and known.lock_seq == 2
    got = judged(spark, rows).where("type = 'hijack'").collect()
    assert [(r.seq, r.severity) for r in got] == [(3, "warning")]  # the announcement that locks doesn't alert


def test_watch_without_origin(spark):
    p = "10.9.0.0/16"
    rows = [ann(0, 1000, p, [1, 100]), ann(1, 1400, p, [1, 300]), ann(2, 1401, p, [1, 300])]
    assert baseline.baselines(frame(spark, rows), watch(spark, (p, 0)), 300.0).first().origins == []
    assert baseline.baselines(frame(spark, rows), watch(spark, (p, 0)), 300.0, learn_watched=True).first().origins == [100]


def test_subprefixes(spark):
    entries = [("10.10.0.0/16", 64500), ("2001:db8::/32", 64510)]
    rows = [ann(0, 1, "10.10.99.0/24", [1, 64666]), ann(1, 2, "2001:db8:9::/48", [1, 64666]), ann(2, 3, "10.10.5.0/24", [1, 64500]), ann(3, 4, "10.10.98.0/24", [1, 64666], from_set=True), ann(4, 5, "10.10.99.0/24", [1, 64666])]
    known = baseline.baselines(frame(spark, rows), watch(spark, *entries), 300.0)
    got = baseline.subprefixes(frame(spark, rows), known).orderBy("seq").collect()
    assert [(r.seq, r.expected_asn, r.severity) for r in got] == [(0, 64500, "critical"), (1, 64510, "critical")]


@pytest.mark.parametrize("path, want", [
    ([1299, 64500, 3356, 65002], (64500, 1299)), ([6939, 64500, 3356, 65003], (64500, 6939)), ([1299, 1299, 64500, 64500, 3356, 65002], (64500, 1299)), ([3356, 64500, 65002], None), ([7, 8, 9], None), ([1299, 64500], None),
])
def test_leaks(spark, path, want):
    rels = relationship_rows([(3356, 64500), (1299, 64500)], [(6939, 64500)])
    got = leaks(frame(spark, [ann(0, 0, "10.0.0.0/8", path)]), rels).collect()
    assert [(r.leaker, r.leaked_to) for r in got] == ([want] if want else [])


def test_spikes(spark):
    flaps = [ann(i, 1000 + i, "10.0.0.0/8", [1, 2]) for i in range(30)]
    assert spikes(frame(spark, flaps), ["peer"]).count() == 10
    assert spikes(frame(spark, [ann(i, 1000 + 10 * i, "10.0.0.0/8", [1]) for i in range(100)]), ["peer"]).count() == 0


def test_cooldown_at_time_zero(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0.0), ("a", 1, 0, 10.0), ("a", 2, 0, 20.0), ("b", 3, 0, 20.0)], "k string, seq bigint, ord int, ts double")
    assert [r.emitted for r in cooled(rows, ["k"]).orderBy("seq").collect()] == [1, 1, 0, 1]


def random_events(n=1500, seed=3):
    rng, prefixes, rows = random.Random(seed), ["10.0.0.0/16", "10.0.16.0/20", "10.0.17.0/24", "10.1.0.0/16", "2001:db8::/32", "2001:db8:1::/48", "192.0.2.0/24", "203.0.113.0/24"], []
    for i in range(n):
        ts = i * 20 + rng.choice((0, 0, -300, 5))
        prefix, peer = rng.choice(prefixes), rng.randrange(4)
        origin = rng.choice((100, 100, 100, 64500, 64510, 300, 64666, 0))
        path = [600 + peer, *rng.choice(([1299, 64500, 3356], [3356], [6939, 64500, 1299], [64500])), origin] if rng.random() > 0.05 else []
        rows.append(ann(i, ts, prefix, path, peer=f"p{peer}", peer_asn=600 + peer, from_set=rng.random() < 0.1) if rng.random() < 0.75 else wd(i, ts, prefix, peer=f"p{peer}", peer_asn=600 + peer))
    return rows


RELS = relationship_rows([(3356, 64500), (1299, 64500)], [(6939, 64500)])
SETTINGS = alerts.Settings(3000.0, 600.0, 1.2, 4, 300.0, RELS)
WATCHED = [("10.0.0.0/16", 100), ("10.1.0.0/16", 0)]


def expected(rows):
    return simulate(rows, [(*parse_text(p), a, m) for p, a, m in ROAS], WATCHED, {(a, b): r for a, b, r in RELS}, 3000.0, 600.0, 1.2, 4, 300.0)


def test_against_simulator(spark):
    rows = random_events()
    want = expected(rows)
    got = sorted((r.seq, r.ord, r.type, r.observed_asn, r.emitted) for r in judged(spark, rows, WATCHED, SETTINGS).collect())
    assert got == want and len({w[1] for w in want}) == 6 and {w[4] for w in want} == {0, 1}


def test_stream_equals_batch(spark, tmp_path):
    rows = random_events(600, 5)
    want = [w[:4] for w in expected(rows) if w[4]]
    for k in range(0, 600, 200):
        frame(spark, rows[k : k + 200]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = []
    hook = webhook_sink("http://127.0.0.1:9/", queue=3, post=log.append)
    sinks = (table_sink(str(tmp_path / "out")), log_sink(), hook)
    engine = Engine(spark, str(tmp_path / "state"), SETTINGS, vrps(spark), watch(spark, *WATCHED), sinks)
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    engine.start(stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    hook.drain()
    got = engine.alerts().orderBy("id").collect()
    assert [(r.seq, r.ord, r.type, r.observed_asn) for r in got] == want
    assert [r.id for r in got] == list(range(1, len(want) + 1)) and log
    live = {(r.hi, r.len, r.peer) for r in rib.live(frame(spark, rows)).collect()}
    assert {(r.hi, r.len, r.peer) for r in spark.read.parquet(engine.path("routes", 2)).where("kind = 'announce'").collect()} == live
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_store_queries(spark):
    rows = judged(spark, random_events(300), WATCHED, SETTINGS)
    store = alerts.numbered(rows.where("emitted = 1")).cache()
    n = store.count()
    newest = alerts.query(store, limit=5).collect()
    assert [r.id for r in newest] == list(range(n, n - 5, -1))
    assert {r.type for r in alerts.query(store, type="leak", limit=500).collect()} == {"leak"}
    assert alerts.query(store, type="nonsense", severity="nonsense", limit=7).count() == 7
    ranks = [r.severity for r in alerts.query(store, limit=30).collect()]
    assert alerts.query(store, severity="critical", limit=30).count() == ranks.count("critical")  # after the limit
    assert alerts.query(store, since=5e9).count() == 0
    counts = {r.type: r["count"] for r in alerts.counts(store).collect()}
    assert set(counts) == set(alerts.ALERT_TYPES) and sum(counts.values()) == n
    first = api.alert_list(store, limit=1)[0]
    assert first["id"] == n and set(first) >= {"ts", "type", "severity", "prefix", "peer", "evidence"}
    assert as_json(store).count() == n
    found = api.stats(frame(spark, random_events(300)), rows)
    assert sum(found["alerts"].values()) == n and f"alerts_suppressed_total {found['engine']['suppressed']}" in api.metrics(found)


def test_stub_and_fixture(spark):
    events = api.stub_events(spark)
    assert rib.live(events).count() == 0 and rib.changes(events).count() == 2
    assert fixture.relationships(spark).where(F.col("rel") == "p2c").count() == 2
