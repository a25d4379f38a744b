import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions.prefix import format_text
from routeloom.sources import bgp, config, live, mrt, vrp
from routeloom.sources.bgp import p

SOUND = bgp.Update(withdrawn=[p("100.64.0.0/10")], nlri=[p("172.30.0.0/15")], path=[64801, 64802, 64803], origin=1, next_hop="198.18.0.7", med=41, communities=[64801 << 16 | 9])


def _body(withdrawn=b"", attributes=b"", nlri=b"", withdrawn_length=None, attributes_length=None):
    """An UPDATE's payload from its parts; a length given replaces the right one."""
    size = lambda part, n: (len(part) if n is None else n).to_bytes(2, "big")
    return size(withdrawn, withdrawn_length) + withdrawn + size(attributes, attributes_length) + attributes + nlri


def _parts(u):
    """(withdrawn, attributes as {type: [flags, value]}, nlri) of an encoded message."""
    c = bgp.header(bgp.encode_update(u, as4=False))[1]
    withdrawn, attributes, found = bytes(c.take(c.number(2))), c.part(c.number(2), "EBADLEN"), {}
    while attributes.left():
        flags, kind = attributes.number(1), attributes.number(1)
        found[kind] = [flags, bytes(attributes.take(attributes.number(1)))]
    return withdrawn, found, bytes(c.take(c.left()))


def _damaged(change=None, drop=(), **lengths):
    """The sound message with one thing changed: change(attributes) edits them, drop leaves some out."""
    withdrawn, found, nlri = _parts(SOUND)
    if change:
        change(found)
    data = b"".join(bytes([flags, kind, len(value)]) + value for kind, (flags, value) in found.items() if kind not in drop)
    return _body(lengths.pop("withdrawn", withdrawn), data, lengths.pop("nlri", nlri), **lengths)


def _set(kind, value, flags=None):
    def change(found):
        found[kind] = [found.get(kind, [0xC0])[0] if flags is None else flags, value]

    return change


DAMAGED = {
    "withdrawn routes longer than the message": (_damaged(withdrawn_length=600), "EBADLEN"),
    "attributes longer than the message": (_damaged(attributes_length=999), "EBADLEN"),
    "no length of the attributes": (_damaged()[:4], "EBADLEN"),
    "a withdrawn prefix of 57 bits": (_damaged(withdrawn=b"\x39" + bytes(8)), "EPREFIXLEN"),
    "an announced prefix that ends early": (_damaged(nlri=b"\x1f\xac\x1e"), "ETRUNC"),
    "an attribute's value that ends early": (_body(attributes=b"\x40\x02\x30\x02\x01"), "EATTRLEN"),
    "an attribute's head that ends early": (_body(attributes=b"\x80"), "ETRUNC"),
    "an origin of two bytes": (_damaged(_set(1, b"\0\1")), "EATTRLEN"),
    "an origin of 77": (_damaged(_set(1, b"\x4d")), "EATTRLEN"),
    "a path segment of type 4": (_damaged(_set(2, b"\x04\x01\xfd\x21")), "ESEGTYPE"),
    "a path segment with fewer numbers than it says": (_damaged(_set(2, b"\x02\x07\xfd\x21\xfd\x22")), "ETRUNC"),
    "a path of 260": (_body(attributes=b"\x50\x02" + (524).to_bytes(2, "big") + (b"\x02\x82" + b"\xfd\x21" * 130) * 2), "E2BIG"),
    "a next hop of three bytes": (_damaged(_set(3, b"\xc6\x12\0")), "EATTRLEN"),
    "a metric of five bytes": (_damaged(_set(4, bytes(5))), "EATTRLEN"),
    "communities of six bytes": (_damaged(_set(8, bytes(6))), "EATTRLEN"),
    "an unknown attribute that must be known": (_damaged(_set(201, b"x", 0x40)), "EATTRLEN"),
    "another family": (_damaged(_set(14, b"\0\7\1\4" + bytes(5), 0x80)), "EAFI"),
    "multicast": (_damaged(_set(15, b"\0\2\2", 0x80)), "EAFI"),
    "a next hop of 48 bytes": (_damaged(_set(14, b"\0\2\1\x30" + bytes(49), 0x80)), "EATTRLEN"),
    "routes without a next hop": (_damaged(drop=(3,)), "EMISSING"),
    "routes without a path": (_damaged(drop=(2,)), "EMISSING"),
    "routes without an origin": (_damaged(drop=(1,)), "EMISSING"),
}


@pytest.mark.parametrize("name", DAMAGED)
def test_damaged_updates(name):
    data, code = DAMAGED[name]
    with pytest.raises(bgp.BgpError) as e:
        bgp.update(data, as4=False)
    assert e.value.code == code and code in bgp.ERRORS


def test_sound_updates():
    assert bgp.update(_damaged(), False) == SOUND
    u = bgp.update(_damaged(_set(233, b"any", 0x80)), False)  # optional ones may be unknown
    assert u.unknown == 1 and u.nlri == SOUND.nlri
    only = bgp.update(_damaged(drop=tuple(range(1, 9)), nlri=b""), False)  # withdrawals need no attribute
    assert only.withdrawn == SOUND.withdrawn and only.nlri == [] and only.path is None


def test_headers():
    keepalive = b"\xff" * 16 + b"\0\x13\x04"
    assert bgp.header(keepalive)[0] == bgp.KEEPALIVE
    for data, code in ((keepalive[:18], "ETRUNC"), (b"\0" + keepalive[1:], "EBADMARKER"), (keepalive[:17] + b"\x14\x04\0", "EBADLEN"), (keepalive[:18] + b"\x09", "EBADTYPE"), (keepalive[:17] + b"\x12\x04", "EBADLEN")):
        with pytest.raises(bgp.BgpError) as e:
            bgp.header(data)
        assert e.value.code == code


def test_round_trips():
    u = bgp.Update(
        withdrawn=[p("100.72.0.0/13")], nlri=[p("172.20.8.0/21"), p("0.0.0.0/0")], path=[64811, 4199990007, 64813], from_set=True, origin=2, next_hop="198.18.3.3", med=70, local_pref=310,
        communities=[64811 << 16 | 5], mp_nlri=[p("fd00:12::/31")], mp_next_hop=bytes(14) + b"\2\1", mp_unreach=[p("fd00:99::/44")],
    )
    kind, payload = bgp.header(bgp.encode_update(u))
    assert kind == bgp.UPDATE and bgp.update(payload, True) == u
    two = bgp.Update(nlri=[p("172.24.0.0/14")], path=[64811, 4199990007, 4199990008], origin=0, next_hop="198.18.3.4", path4=([4199990007, 4199990008], False))
    got = bgp.update(bgp.header(bgp.encode_update(two, as4=False))[1], False)
    assert got.path == [64811, 4199990007, 4199990008]


def test_open():
    o = bgp.open_message(bytes.fromhex("045BA000B4C0000201" "0E" "020C" "010400010001" "4104FA56EA01"))
    assert (o.version, o.my_as, o.hold_time, o.as4, o.mp_ipv4, o.mp_ipv6) == (4, 23456, 180, 0xFA56EA01, True, False)


def test_fuzz():
    rng = random.Random(1)
    good = bytearray(bgp.encode_update(bgp.Update(nlri=[p("10.0.0.0/8")], path=[1, 2], origin=0, next_hop="1.1.1.1", communities=[5])))
    for k in range(4000):
        data = bytearray(good) if k % 2 else bytearray(rng.randbytes(rng.randrange(80)))
        if k % 2:
            data[rng.randrange(16, len(data))] = rng.randrange(256)
        for decode in (lambda d: bgp.header(d), lambda d: bgp.update(d[19:], True), lambda d: bgp.open_message(d[19:])):
            try:
                decode(bytes(data))
            except bgp.BgpError as e:
                assert e.code in bgp.ERRORS


def _dump():
    ann = lambda pre, o: bgp.encode_update(bgp.Update(nlri=[p(pre)], path=[6939, o], origin=0, next_hop="192.0.2.1"))
    keepalive = b"\xff" * 16 + b"\0\x13\x04"
    return [
        mrt.encode_message(100.5, "192.0.2.9", 6939, ann("10.0.0.0/8", 15169), mrt.BGP4MP_ET), mrt.encode_message(101, "192.0.2.9", 6939, ann("11.0.0.0/8", 13335)),
        mrt.encode_message(102, "2001:db8::9", 6939, bgp.encode_update(bgp.Update(withdrawn=[p("10.0.0.0/8")]))), mrt.encode_message(103, "192.0.2.9", 6939, keepalive),
    ]


def _table_dump():
    index = bytes(4) + b"\0\0" + b"\0\1" + b"\2" + bytes(4) + bytes([192, 0, 2, 7]) + (65001).to_bytes(4, "big")
    attrs = bytes.fromhex("40010100" "400206" "0201" "0000FDE9" "400304C0000201")
    entry = lambda i: i.to_bytes(2, "big") + (77).to_bytes(4, "big") + len(attrs).to_bytes(2, "big") + attrs
    rib = bytes(4) + b"\x08\x0a" + b"\0\2" + entry(0) + entry(5)
    return [mrt.encode_record(200, 13, 1, index), mrt.encode_record(200, 13, 2, rib)]


def test_mrt(spark, tmp_path):
    (tmp_path / "a.mrt").write_bytes(b"".join(_dump()))
    (tmp_path / "b.mrt").write_bytes(b"".join(_table_dump()))
    found = mrt.read_records(spark, str(tmp_path / "*.mrt")).cache()
    first = found.where("file like '%a.mrt'")
    s = mrt.replay_stats(first).first()
    assert (s.records, s.updates, s.announces, s.withdraws, s.distinct_prefixes, s.distinct_origins, s.skipped, s.errors) == (4, 3, 2, 1, 2, 2, 1, 0)
    rows = mrt.with_seq(mrt.events(found)).orderBy("seq").collect()
    assert [(r.kind, format_text(r.family, r.len, r.hi, r.lo), r.ts, r.peer) for r in rows] == [
        ("announce", "10.0.0.0/8", 100.5, "192.0.2.9"), ("announce", "11.0.0.0/8", 101.0, "192.0.2.9"), ("withdraw", "10.0.0.0/8", 102.0, "2001:db8::9"), ("announce", "10.0.0.0/8", 77.0, "192.0.2.7"),
    ]
    t = mrt.replay_stats(found.where("file like '%b.mrt'")).first()
    assert (t.records, t.rib_entries, t.errors) == (2, 1, 1)  # the second entry has no such peer


def test_mrt_corrupt_and_carved():
    data = b"".join(_dump())
    assert [r[2] for r in mrt.records(data[:-3])][-1] is None
    assert [r[2] for r in mrt.records(data + bytes(4) + b"\0\x10\0\4" + b"\x7f\xff\xff\xff")][-1] is None
    assert mrt.carve(data, 2) == b"".join(_dump()[:2])


def test_mrt_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mrt").write_bytes(b"".join(_dump()))
    stream = mrt.events(mrt.read_records(spark, str(tmp_path / "in"), streaming=True))
    q = stream.writeStream.format("memory").queryName("mrt_events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("mrt_events").count() == 3


def test_live_lines(spark):
    good = (
        '{"type":"ris_message","data":{"timestamp":1.5,"peer":"192.0.2.9","peer_asn":"6939","host":"rrc00","path":[6939,3356,[64500,64501]],"origin":"egp","community":[[6939,1],[1,2]],"med":5,'
        '"announcements":[{"next_hop":"2001:db8::1","prefixes":["10.0.0.0/8","bad","2001:db8::/32"]}],"withdrawals":["11.0.0.0/8"]}}'
    )
    lines = [good, "", "{", '{"type":"ris_error","data":{}}', '{"type":"ris_message"}', "[1]", "x" * (1 << 20)]
    df = spark.createDataFrame(list(enumerate(lines)), "line bigint, value string")
    rows = live.parse_lines(df, order=("line",)).orderBy("line", "item").collect()
    assert [(r.kind, format_text(r.family, r.len, r.hi, r.lo)) for r in rows] == [("withdraw", "11.0.0.0/8"), ("announce", "10.0.0.0/8"), ("announce", "2001:db8::/32")]
    assert rows[1].path == [6939, 3356, 64500, 64501] and rows[1].origin_from_set and rows[1].origin_attr == 1 and rows[1].next_hop == "2001:db8::1" and rows[1].communities == [6939 << 16 | 1, 1 << 16 | 2]
    assert rows[0].path == [] and rows[0].next_hop is None and rows[0].peer_asn == 6939
    assert live.feed_filter(live.parse_lines(df), host="rrc00", prefix="10.0.0.0/7").count() == 2
    assert live.feed_filter(live.parse_lines(df), host="rrc01").count() == 0


def test_vrps(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"metadata":{"n":1},"roas":[{"prefix":"1.1.1.0/24","asn":13335,"maxLength":24},{"prefix":"2001:db8::/32","asn":"AS64510","maxLength":48},{"prefix":"10.0.0.0/8","asn":"as1"},'
                                     '{"prefix":"10.0.0.0/8","asn":1,"maxLength":8},{"prefix":"bad","asn":1},{"prefix":"10.0.0.0/16","asn":1,"maxLength":8},{"asn":3}]}')  # fmt: skip
    got = vrp.load(spark, str(tmp_path / "v.json")).collect()
    assert sorted((format_text(r.family, r.len, r.hi, r.lo), r.asn, r.max_len) for r in got) == [("1.1.1.0/24", 13335, 24), ("10.0.0.0/8", 1, 8), ("2001:db8::/32", 64510, 48)]


def test_config():
    c = config.parse("# all\napi_port = 9090\nspike_factor=2.5 # x\nrislive_enabled = yes\nwatch = 192.0.2.0/24 64500\nwatch = 2001:db8::/32\nrel_provider = 3356 64500\nrel_peer = 1 2\n\n")
    assert (c.api_port, c.spike_factor, c.live_enabled, c.watch) == (9090, 2.5, True, [("192.0.2.0/24", 64500), ("2001:db8::/32", 0)])
    assert c.relationships() == [(1, 2, "peer"), (2, 1, "peer"), (3356, 64500, "p2c"), (64500, 3356, "c2p")]
    assert config.Config().baseline_window == 300 and config.Config().spike_min == 20
    for bad in ("nokey = 1", "watch = 10.0.0.0/40 1", "rel_peer = 1", "no equals"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_strict_json():
    from routeloom.sinks.alerts import parse_json

    assert parse_json('{"a":1,"a":2}') == {"a": 1}
    assert all(parse_json(t) is None for t in ('{"a":1}x', "{", "NaN", '{"a":}', "[" * 100000))


def test_vrp_asn(spark):
    texts = ["13335", "AS13335", "as1", "4294967296", "x", "1.0", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(vrp.asn(F.col("t"))).collect()
    assert [r[0] for r in got] == [13335, 13335, 1, None, None, 1, None]
