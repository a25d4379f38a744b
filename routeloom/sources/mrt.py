"""Archived routing dumps (MRT), in batch and as a stream of files.

Spark lists and reads the files, so any store it knows will do. A dump can't be split (records have no sync marks), so a
file is one task's; archives come as many files. A table dump refers to the last peer index before it in its file.
"""

from __future__ import annotations

import socket
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bgp

TABLE_DUMP_V2, BGP4MP, BGP4MP_ET = 13, 16, 17
PEER_INDEX, RIB_IPV4, RIB_IPV6 = 1, 2, 4
#: Subtypes of BGP4MP with a message -> whether its AS numbers have 4 octets.
MESSAGES = {1: False, 4: True, 6: False, 7: True}
MAX_BODY, MAX_PEERS = 1 << 20, 1024

EVENT = (
    "struct<ts:double,kind:string,family:int,len:int,hi:bigint,lo:bigint,path:array<bigint>,origin_from_set:boolean,origin_attr:smallint,next_hop:string,"
    "med:bigint,local_pref:bigint,communities:array<bigint>,peer:string,peer_asn:bigint>"
)
#: before: events of the records before it in the file
RECORD = f"file string, rec_no bigint, before bigint, ts double, type int, subtype int, status string, error string, events array<{EVENT}>"
_EVENT_ARROW = pa.struct(
    [("ts", pa.float64()), ("kind", pa.string()), ("family", pa.int32()), ("len", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("path", pa.list_(pa.int64())), ("origin_from_set", pa.bool_()),
     ("origin_attr", pa.int16()), ("next_hop", pa.string()), ("med", pa.int64()), ("local_pref", pa.int64()), ("communities", pa.list_(pa.int64())), ("peer", pa.string()), ("peer_asn", pa.int64())]
)
_RECORD_ARROW = pa.schema(
    [("file", pa.string()), ("rec_no", pa.int64()), ("before", pa.int64()), ("ts", pa.float64()), ("type", pa.int32()), ("subtype", pa.int32()), ("status", pa.string()), ("error", pa.string()), ("events", pa.list_(_EVENT_ARROW))]
)


def _address(raw) -> str:
    return socket.inet_ntop(socket.AF_INET if len(raw) == 4 else socket.AF_INET6, bytes(raw))


def _event(u: bgp.Update | None, kind: str, prefix, ts: float, peer: tuple[str, int]) -> dict:
    out = {"ts": ts, "kind": kind, "family": prefix[0], "len": prefix[1], "hi": prefix[2], "lo": prefix[3], "peer": peer[0], "peer_asn": peer[1]}
    if kind == "withdraw":
        return out | {"path": [], "origin_from_set": False, "communities": []}
    return out | {"path": u.path or [], "origin_from_set": u.from_set, "origin_attr": u.origin, "next_hop": u.hop(), "med": u.med, "local_pref": u.local_pref, "communities": u.communities}


class Dump:
    """Decodes the records of one file in order."""

    def __init__(self):
        self.peers: list[tuple[str, int]] = []

    def record(self, ts: float, kind: int, subtype: int, body) -> tuple[str, str | None, list[dict]]:
        """(status, error, events): status is update, rib, index, skipped or error. A table record that breaks off keeps its earlier entries."""
        events: list[dict] = []
        try:
            c = bgp.Cursor(body)
            if kind in (BGP4MP, BGP4MP_ET):
                return self._message(ts, subtype, c, events)
            if kind == TABLE_DUMP_V2 and subtype == PEER_INDEX:
                self._index(c)
                return "index", None, events
            if kind == TABLE_DUMP_V2 and subtype in (RIB_IPV4, RIB_IPV6):
                self._table(4 if subtype == RIB_IPV4 else 6, c, events)
                return "rib", None, events
        except bgp.BgpError as e:
            return "error", e.code, events
        return "skipped", None, events

    def _message(self, ts: float, subtype: int, c: bgp.Cursor, events: list[dict]):
        try:  # what isn't a message, or has another family, is passed over
            as4 = MESSAGES[subtype]
            width = 4 if as4 else 2
            if c.left() < 2 * width + 4:
                raise bgp.BgpError("ETRUNC")
            asn = c.number(width)
            c.take(width + 2)
            size = {1: 4, 2: 16}[c.number(2)]
            peer = (_address(c.take(size)), asn)
            c.take(size)
        except (KeyError, bgp.BgpError):
            return "skipped", None, events
        kind, payload = bgp.header(c.data[c.at :])
        if kind != bgp.UPDATE:
            return "skipped", None, events
        u = bgp.update(payload, as4)
        for name, found in (("withdraw", u.withdrawn), ("withdraw", u.mp_unreach), ("announce", u.nlri), ("announce", u.mp_nlri)):
            events += [_event(u, name, p, ts, peer) for p in found]
        return "update", None, events

    def _index(self, c: bgp.Cursor) -> None:
        if c.left() < 8:
            raise bgp.BgpError("ETRUNC")
        c.take(4)
        c.take(c.number(2))
        self.peers = []
        for _ in range(c.number(2)):
            kind = c.number(1)
            c.take(4)
            if c.left() < (16 if kind & 1 else 4) + (4 if kind & 2 else 2):
                raise bgp.BgpError("ETRUNC")
            if len(self.peers) == MAX_PEERS:
                raise bgp.BgpError("E2BIG")
            address = _address(c.take(16 if kind & 1 else 4))
            self.peers.append((address, c.number(4 if kind & 2 else 2)))

    def _table(self, family: int, c: bgp.Cursor, events: list[dict]) -> None:
        c.take(4)
        prefix = bgp.prefix(c, family)
        for _ in range(c.number(2)):
            if c.left() < 8:
                raise bgp.BgpError("ETRUNC")
            peer, originated, size = c.number(2), float(c.number(4)), c.number(2)
            part = c.part(size, "ETRUNC")
            if peer >= len(self.peers):
                raise bgp.BgpError("EATTRLEN")
            u = bgp.Update()
            bgp.attributes(u, part, as4=True, abridged=True)
            events.append(_event(u, "announce", prefix, originated, self.peers[peer]))


def records(data):
    """(record number, ts, type, subtype, body) of a dump's bytes; the last is (n, None, None, None, None) if the file is corrupt there."""
    at, n, size = 0, 0, len(data)
    while at < size:
        if size - at < 12:
            yield n, None, None, None, None
            return
        ts, kind, subtype, length = struct.unpack_from(">IHHI", data, at)
        extra = 4 if kind == BGP4MP_ET else 0
        if length > MAX_BODY or size - at - 12 < length or length < extra:
            yield n, None, None, None, None
            return
        body = data[at + 12 + extra : at + 12 + length]
        yield n, ts + (struct.unpack_from(">I", data, at + 12)[0] / 1e6 if extra else 0.0), kind, subtype, body
        at, n = at + 12 + length, n + 1


def _decode(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            dump, out, before = Dump(), [], 0
            for n, ts, kind, subtype, body in records(memoryview(content.as_buffer()).cast("B")):
                status, error, events = dump.record(ts, kind, subtype, body) if kind is not None else ("corrupt", None, [])
                out.append({"file": path, "rec_no": n, "before": before, "ts": ts, "type": kind, "subtype": subtype, "status": status, "error": error, "events": events})
                before += len(events)
                if len(out) == 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD_ARROW)


def read_records(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 16) -> DataFrame:
    """One row for each record, with its status and events. Uncompressed files only."""
    if streaming:
        if path[-1] not in "/]*}":  # a stream reads folders and patterns: one file is a pattern that matches it alone
            path = f"{path[:-1]}[{path[-1]}]"
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    else:
        files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(_decode, RECORD)


def events(found: DataFrame) -> DataFrame:
    """The events of records, with file and place: their number in the file, in the order of arrival."""
    return found.select("file", "before", F.posexplode("events").alias("item", "e")).select("file", (F.col("before") + F.col("item")).alias("place"), "e.*", F.lit("mrt").alias("source"))


def with_seq(rows: DataFrame, offset: int = 0) -> DataFrame:
    """Adds seq from offset on, which orders events by file name and place. There is one small row for each file to add up."""
    counts = rows.groupBy("file").agg((F.max("place") + 1).alias("_n"))
    before = counts.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "file").withColumn("seq", F.lit(offset) + F.col("_before") + F.col("place")).drop("_before", "file", "place")


def replay_stats(found: DataFrame) -> DataFrame:
    """One row: records, updates, rib_entries, announces, withdraws, errors, skipped, distinct_prefixes, distinct_origins, corrupt."""
    e = F.explode_outer("events").alias("e")
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = found.agg(
        F.count_if(F.col("status") != "corrupt").alias("records"), is_("update").alias("updates"), F.coalesce(F.sum(F.when((F.col("type") == TABLE_DUMP_V2), F.size("events")).otherwise(0)), F.lit(0)).alias("rib_entries"),
        is_("error").alias("errors"), is_("skipped").alias("skipped"), is_("corrupt").alias("corrupt"),
    )
    flat = found.select(e).where("e is not null").select("e.*")
    origin = F.when(F.col("kind") == "announce", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(0).cast("bigint"))).otherwise(0)
    seen = flat.agg(
        F.count_if(F.col("kind") == "announce").alias("announces"), F.count_if(F.col("kind") == "withdraw").alias("withdraws"),
        F.countDistinct(F.struct("family", "len", "hi", "lo")).alias("distinct_prefixes"), F.countDistinct(F.when(origin != 0, origin)).alias("distinct_origins"),
    )
    return counts.join(F.broadcast(seen))  # one row each


def carve(data: bytes, n: int) -> bytes:
    """The bytes of the first n records of a dump."""
    at = 0
    for _ in range(n):
        if len(data) - at < 12:
            break
        at += 12 + struct.unpack_from(">I", data, at + 8)[0]
    return data[:at]


# ---- encoding, for fixtures


def encode_record(ts: float, kind: int, subtype: int, body: bytes) -> bytes:
    if kind == BGP4MP_ET:
        body = struct.pack(">I", round(ts % 1 * 1e6)) + body
    return struct.pack(">IHHI", int(ts), kind, subtype, len(body)) + body


def encode_message(ts: float, peer: str, asn: int, message: bytes, kind: int = BGP4MP) -> bytes:
    v6 = ":" in peer
    raw = socket.inet_pton(socket.AF_INET6 if v6 else socket.AF_INET, peer)
    return encode_record(ts, kind, 4, struct.pack(">IIHH", asn, 0, 0, 2 if v6 else 1) + raw + bytes(len(raw)) + message)
