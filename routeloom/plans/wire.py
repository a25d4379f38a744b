"""Queries over the wire path and IPv6: messages, dumps and texts are encoded out of `events` and decoded again."""

from __future__ import annotations

import socket
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aspath import format_path
from ..functions.prefix import format as format_prefix
from ..functions.prefix import parse, v4_net
from ..functions.text import query_value
from ..operators import alerts
from ..operators.coverjoin import cover_join
from ..operators.rov import validate
from ..schema import VRPS
from ..sinks.alerts import as_json
from ..sources import bgp, fixture, mrt, vrp
from .queries import SETTINGS, _events

#: Events of one dump.
CHUNK = 500
PEERS = tuple(f"198.18.0.{k}" for k in range(5))
HOP = "198.18.9.9"


def _net() -> Column:
    return v4_net(F.col("hi")).alias("net")


def _slim(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("seq", "ts", "kind", "len", "hi", "path", "origin_from_set", "peer", "peer_asn")


def _update(row: dict) -> bgp.Update:
    prefix = (4, row["len"], row["hi"], 0)
    if row["kind"] == "withdraw":
        return bgp.Update(withdrawn=[prefix])
    seq = row["seq"]
    return bgp.Update(
        nlri=[prefix], path=row["path"], from_set=row["origin_from_set"], origin=seq % 3, next_hop=f"198.18.{seq % 200}.9", med=seq, local_pref=100 + seq % 50 if seq % 2 else None,
        communities=[(65000 << 16) | (seq & 65535)] * (seq % 70),
    )


def _rows(batches, schema: pa.Schema, make):
    for batch in batches:
        yield pa.RecordBatch.from_pylist([out for row in batch.to_pylist() for out in make(row)], schema=schema)


def update_decode(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an UPDATE message with two- or four-octet AS numbers, decoded."""
    fields = [("seq", pa.int64()), ("kind", pa.string()), ("len", pa.int32()), ("net", pa.int64()), ("path", pa.list_(pa.int64())), ("from_set", pa.bool_()), ("origin_attr", pa.int32()), ("next_hop", pa.string()), ("med", pa.int64()), ("local_pref", pa.int64()), ("n_communities", pa.int32()), ("community", pa.int64())]
    schema = pa.schema(fields)

    def make(row):
        as4 = row["seq"] % 2 == 0
        kind, payload = bgp.header(bgp.encode_update(_update(row), as4))
        u = bgp.update(payload, as4)
        for name, found in (("withdraw", u.withdrawn), ("announce", u.nlri)):
            for p in found:
                yield {
                    "seq": row["seq"], "kind": name, "len": p[1], "net": p[2] >> 32, "path": u.path or [], "from_set": u.from_set, "origin_attr": u.origin, "next_hop": u.hop(), "med": u.med,
                    "local_pref": u.local_pref, "n_communities": len(u.communities), "community": u.communities[0] if u.communities else None,
                }

    names = "seq bigint, kind string, len int, net bigint, path array<bigint>, from_set boolean, origin_attr int, next_hop string, med bigint, local_pref bigint, n_communities int, community bigint"
    out = _slim(spark, d).mapInArrow(lambda batches: _rows(batches, schema, make), names)
    return out.withColumn("path_text", format_path(F.col("path"))).drop("path")


def update_mp6(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an UPDATE with IPv6 routes in the multiprotocol attributes; two octets of an AS path go through AS4_PATH."""
    schema = pa.schema([("seq", pa.int64()), ("kind", pa.string()), ("prefix", pa.string()), ("next_hop", pa.string()), ("path", pa.list_(pa.int64()))])

    def make(row):
        seq, announce = row["seq"], row["kind"] == "announce"
        prefix = bgp.p(f"2001:db8:{1 + seq % 9:x}:{1 + seq % 200:x}::/64")
        if announce:
            path = [4200000000 + seq % 7, *row["path"][1:]]
            u = bgp.Update(mp_nlri=[prefix], mp_next_hop=socket.inet_pton(socket.AF_INET6, "2001:db8::9"), path=path, path4=(path, False), origin=0)
        else:
            u = bgp.Update(mp_unreach=[prefix])
        u = bgp.update(bgp.header(bgp.encode_update(u, as4=False))[1], as4=False)
        from ..functions.prefix import format_text

        for name, found in (("withdraw", u.mp_unreach), ("announce", u.mp_nlri)):
            for p in found:
                yield {"seq": seq, "kind": name, "prefix": format_text(*p), "next_hop": u.hop(), "path": u.path or []}

    out = _slim(spark, d).mapInArrow(lambda batches: _rows(batches, schema, make), "seq bigint, kind string, prefix string, next_hop string, path array<bigint>")
    return out.withColumn("path_text", format_path(F.col("path"))).drop("path")


#: How seq % 8 damages a message -> the error's name; 0 leaves it as it is.
DAMAGE = {0: "", 1: "EBADMARKER", 2: "EBADLEN", 3: "EBADTYPE", 4: "EATTRLEN", 5: "ESEGTYPE", 6: "EPREFIXLEN", 7: "EMISSING"}


def malformed_updates(spark: SparkSession, d: str) -> DataFrame:
    """The error of each announcement's message after one kind of damage."""
    schema = pa.schema([("seq", pa.int64()), ("error", pa.string())])

    def make(row):
        how, u = row["seq"] % 8, bgp.Update(nlri=[(4, row["len"], row["hi"], 0)], path=row["path"], origin=0, next_hop=HOP)
        if how == 7:
            u.next_hop = None
        data = bytearray(bgp.encode_update(u))
        if how == 1:
            data[row["seq"] % 16] = 0
        elif how == 2:
            data[16:18] = (len(data) + 1).to_bytes(2, "big")
        elif how == 3:
            data[18] = 9
        elif how == 4:
            data[26] = 3  # the origin
        elif how == 5:
            data[30] = 3  # the segment's type
        elif how == 6:
            data[-1 - (row["len"] + 7) // 8] = 33
        error = ""
        try:
            bgp.update(bgp.header(bytes(data))[1], True)
        except bgp.BgpError as e:
            error = e.code
        yield {"seq": row["seq"], "error": error}

    return _slim(spark, d).where("kind = 'announce'").mapInArrow(lambda batches: _rows(batches, schema, make), "seq bigint, error string")


def nlri_codec(spark: SparkSession, d: str) -> DataFrame:
    """Each prefix's bytes on the wire, and what they decode to."""
    schema = pa.schema([("seq", pa.int64()), ("wire", pa.string()), ("len", pa.int32()), ("net", pa.int64())])

    def make(row):
        data = bgp.encode_prefix((4, row["len"], row["hi"], 0))
        p = bgp.prefix(bgp.Cursor(data), 4)
        yield {"seq": row["seq"], "wire": data.hex(), "len": p[1], "net": p[2] >> 32}

    return _slim(spark, d).mapInArrow(lambda batches: _rows(batches, schema, make), "seq bigint, wire string, len int, net bigint")


KEEPALIVE = b"\xff" * 16 + b"\0\x13\x04"


def _dump(table: pa.Table) -> bytes:
    """Events of one chunk as a dump: messages with microseconds, a KEEPALIVE after every tenth, and a broken message after every hundredth."""
    out = []
    for n, row in enumerate(table.sort_by("seq").to_pylist()):
        peer, message = PEERS[row["seq"] % 5], bgp.encode_update(_update(row))
        out.append(mrt.encode_message(row["ts"], peer, row["peer_asn"], message, mrt.BGP4MP_ET))
        if n % 10 == 9:
            out.append(mrt.encode_message(row["ts"], peer, row["peer_asn"], KEEPALIVE))
        if n % 100 == 99:
            out.append(mrt.encode_message(row["ts"], peer, row["peer_asn"], message[:18] + b"\x07" + message[19:]))
    return b"".join(out)


def _table_dump(table: pa.Table) -> bytes:
    """Events of one chunk as a table dump: the peers' index, then a record for each announcement with entries of two peers."""
    index = bytes(4) + b"\0\0" + len(PEERS).to_bytes(2, "big") + b"".join(b"\2" + bytes(4) + socket.inet_aton(p) + (64600 + k).to_bytes(4, "big") for k, p in enumerate(PEERS))
    out = [mrt.encode_record(0, mrt.TABLE_DUMP_V2, mrt.PEER_INDEX, index)]
    for row in table.sort_by("seq").to_pylist():
        if row["kind"] == "announce":
            u = bgp.Update(path=row["path"], origin=0, next_hop=HOP)
            data = bgp.encode_update(u)
            attributes = data[23 : 23 + int.from_bytes(data[21:23], "big")]
            entry = lambda k: k.to_bytes(2, "big") + int(row["ts"]).to_bytes(4, "big") + len(attributes).to_bytes(2, "big") + attributes  # noqa: B023, E731
            body = row["seq"].to_bytes(4, "big") + bgp.encode_prefix((4, row["len"], row["hi"], 0)) + b"\0\2" + entry(row["seq"] % 5) + entry((row["seq"] + 1) % 5)
            out.append(mrt.encode_record(0, mrt.TABLE_DUMP_V2, mrt.RIB_IPV4, body))
    return b"".join(out)


def _dumps(spark: SparkSession, d: str, encode) -> DataFrame:
    """The records of dumps of CHUNK events each, as mrt.read_records gives them for files."""

    def run(key, table):
        return pa.table({"path": [f"{key[0].as_py():012d}"], "content": pa.array([encode(table)], pa.binary())})

    chunks = _slim(spark, d).withColumn("chunk", F.expr(f"seq div {CHUNK}"))
    return chunks.groupBy("chunk").applyInArrow(run, "path string, content binary").mapInArrow(mrt._decode, mrt.RECORD)


def mrt_decode(spark: SparkSession, d: str) -> DataFrame:
    """Events read from dumps, in the order of arrival."""
    rows = mrt.with_seq(mrt.events(_dumps(spark, d, _dump)))
    return rows.select("seq", F.round("ts", 6).alias("ts"), "kind", "len", _net(), "peer", "peer_asn", format_path(F.col("path")).alias("path_text"))


def mrt_replay_counts(spark: SparkSession, d: str) -> DataFrame:
    return mrt.replay_stats(_dumps(spark, d, _dump))


def table_dump_decode(spark: SparkSession, d: str) -> DataFrame:
    """Events of table dumps: the peer comes from the index before, the time is that of origination."""
    rows = mrt.with_seq(mrt.events(_dumps(spark, d, _table_dump)))
    return rows.select("seq", "ts", "kind", "len", _net(), "peer", "peer_asn", "next_hop", format_path(F.col("path")).alias("path_text"))


# ---- IPv6


def _block() -> Column:
    return F.expr("1 + (seq div 6) % 9")


def _texts6(spark: SparkSession, d: str) -> DataFrame:
    """(seq, text): prefixes of 2001:db8::/32 at three lengths, some with host bits, in capitals or broken."""
    k = F.col("seq") % 6
    whole = F.concat(F.lit("2001:db8:"), F.lower(F.hex(_block())), F.lit(":"), F.lower(F.hex(1 + F.col("seq") % 200)), F.lit("::"))
    text = F.when(k == 0, F.concat(whole, F.lit("/64"))).when(k == 1, F.concat(whole, F.lit("77/48"))).when(k == 2, F.concat(F.upper(whole), F.lit("/64"))).when(k == 3, F.concat(whole, F.lit("1/128")))
    text = text.when(k == 4, F.concat(whole, F.lit("/129"))).otherwise(F.concat(whole, F.lit(":/64")))
    return _events(spark, d).select("seq", text.alias("text"))


def prefix6_parse(spark: SparkSession, d: str) -> DataFrame:
    p = _texts6(spark, d).withColumn("p", parse("text"))
    canonical = F.when(F.col("p.len").isNotNull(), format_prefix(*(F.coalesce(F.col(f"p.{c}"), F.lit(v)) for c, v in (("family", 6), ("len", 0), ("hi", 0), ("lo", 0)))))
    return p.select("seq", "text", F.col("p.len").alias("len"), canonical.alias("prefix"))


def prefix6_covers(spark: SparkSession, d: str) -> DataFrame:
    """The /48 of each parsed prefix that is longer."""
    p = _texts6(spark, d).select("seq", parse("text").alias("p")).select("seq", "p.*").where("len is not null")
    outer = p.where("len = 48").select("family", "len", "hi", "lo").distinct()
    found = cover_join(p, outer, strict=True)
    return found.select("seq", format_prefix("family", "cover_len", "cover_hi", "cover_lo").alias("cover"))


def rov6(spark: SparkSession, d: str) -> DataFrame:
    """Validation of IPv6 prefixes: blocks 1 to 6 have a payload up to /64, 7 one of AS 0, the others none."""
    from ..functions.prefix import parse_text

    vrps = spark.createDataFrame([(*parse_text(f"2001:db8:{b}::/48"), 65000 + b if b < 7 else 0, 64) for b in range(1, 8)], VRPS)
    p = _texts6(spark, d).withColumn("origin", F.when(F.col("seq") % 4 == 0, F.lit(64999).cast("bigint")).otherwise(F.lit(65000) + _block())).select("seq", "origin", parse("text").alias("p"))
    return validate(p.select("seq", "origin", "p.*").where("len is not null"), vrps).select("seq", "len", "origin", "rov")


# ---- VRP dumps, alerts


def vrp_dump(spark: SparkSession, d: str) -> DataFrame:
    """A dump of payloads for the prefixes of the events, written as one JSON document and loaded."""
    from ..functions.prefix import format_v4

    seen = _events(spark, d).where("kind = 'announce'").select("len", format_v4(F.col("hi"), F.col("len")).alias("prefix"), F.element_at("path", -1).alias("origin")).distinct()
    # as numbers, with AS, out of range, with a length that is too short
    asn = F.when(F.col("origin") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("AS"), F.col("origin").cast("string")).alias("asn")))).when(F.col("origin") % 3 == 1, F.to_json(F.struct(F.col("origin").alias("asn")))).otherwise(F.to_json(F.struct((F.col("origin") + F.when(F.col("len") == 20, 2**32).otherwise(0)).cast("string").alias("asn"))))
    inner = F.substring(asn, 2, 100)  # without the opening brace
    longest = F.when(F.col("origin") % 2 == 0, F.concat(F.lit(',"maxLength":'), (F.col("len") + F.when(F.col("origin") % 4 == 0, 4).otherwise(-1)).cast("string"), F.lit("}"))).otherwise(F.lit("}"))
    one = F.concat(F.lit('{"prefix":"'), "prefix", F.lit('",'), F.left(inner, F.length(inner) - 1), longest)
    document = seen.select(one.alias("r")).agg(F.concat(F.lit('{"metadata":{"roas":1},"roas":['), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]}")).alias("value"))  # a few hundred prefixes and origins
    path = f"{_shared(spark)}/vrp-{uuid.uuid4().hex}"
    document.coalesce(1).write.text(path)
    return vrp.load(spark, path).select("len", _net(), "asn", "max_len")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session on this machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="routeloom-")).rstrip("/")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    found = alerts.candidates(_events(spark, d), fixture.vrps(spark), fixture.watchlist(spark), SETTINGS)
    return alerts.numbered(alerts.emitted(found).where("emitted = 1"))


def alert_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the alerts' JSON documents, those of the evidence included."""
    get = lambda path: F.get_json_object("json", f"$.{path}")
    return as_json(_alerts(spark, d)).select(
        "id", get("type").alias("type"), get("prefix").alias("prefix"), get("observed_asn").cast("bigint").alias("observed_asn"), get("evidence.as_path").alias("as_path"), get("evidence.peer").alias("peer"),
        get("evidence.peer_asn").cast("bigint").alias("peer_asn"), get("evidence.len").cast("int").alias("len"), get("evidence.leaked_to").cast("bigint").alias("leaked_to"), get("evidence.cover_len").cast("int").alias("cover_len"),
        get("evidence.window_count").cast("bigint").alias("window_count"),
    )


def alerts_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The newest 40 alerts of one type, prefix and time on."""
    from ..functions.prefix import parse_text

    store = _alerts(spark, d)
    since = _events(spark, d).agg(F.percentile("ts", 0.25)).first()[0]
    return alerts.query(store, type="rpki_invalid", since=since, prefix=parse_text("10.3.17.0/24"), limit=40).select("id", "seq", "type", "severity", "observed_asn")


def url_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of a request's query string: escapes, plus signs, a key that comes twice, one that is missing, an escape that is none."""
    seq = F.col("seq").cast("string")
    query = F.concat(F.lit("type=leak%20"), seq, F.lit("&prefix=10."), (F.col("seq") % 200).cast("string"), F.lit(".0.0%2F16&limit=a+b%2Bc&prefix=no&odd=5%zz%4&typed=x"))
    return _events(spark, d).select("seq", *(query_value(query, k).alias(k) for k in ("type", "prefix", "limit", "odd", "since")))


WIRE = (
    url_values,
    update_decode, update_mp6, malformed_updates, nlri_codec, mrt_decode, mrt_replay_counts, table_dump_decode, prefix6_parse, prefix6_covers, rov6, vrp_dump, alert_evidence, alerts_filtered,
)
QUERIES = {f.__name__: f for f in WIRE}
