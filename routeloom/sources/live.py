"""Live feed: one JSON document per line, each with withdrawals and announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aspath import communities, flatten_segments, origin_attribute
from ..functions.prefix import parse, parse_address, parse_v4
from ..schema import MAX_LINE_BYTES

_DATA = (
    "struct<timestamp:double,peer:string,peer_asn:string,host:string,type:string,path:array<string>,origin:string,med:bigint,community:array<array<bigint>>,"
    "announcements:array<struct<next_hop:string,prefixes:array<string>>>,withdrawals:array<string>>"
)
_LINE = f"type string, data {_DATA.replace('struct<', 'struct<', 1)}"


def parse_lines(lines: DataFrame, ipv6: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """Events of rows (value), one JSON document each: withdrawals first, then the announcements' prefixes, in order.

    Empty and oversize lines, lines that are no JSON object and other messages give no rows; prefixes that can't be parsed
    are left out one by one. `item` is an event's place in its line; columns named in `order` (such as a line's number) stay,
    and with item give the arrival order.
    """
    usable = lines.where((F.length("value") > 0) & (F.octet_length("value") < MAX_LINE_BYTES))
    m = usable.select(*order, F.from_json("value", _LINE).alias("m")).where("m.type = 'ris_message' and m.data is not null").select(*order, "m.data.*")
    path, from_set = flatten_segments(F.coalesce("path", F.array().cast("array<string>")))
    withdrawn = F.transform(F.coalesce("withdrawals", F.array().cast("array<string>")), lambda p: F.struct(F.lit("withdraw").alias("kind"), p.alias("prefix"), F.lit(None).cast("string").alias("hop")))
    announced = F.flatten(F.transform(
        F.coalesce("announcements", F.expr("cast(array() as array<struct<next_hop:string,prefixes:array<string>>>)")),
        lambda a: F.transform(F.coalesce(a["prefixes"], F.array().cast("array<string>")), lambda p: F.struct(F.lit("announce").alias("kind"), p.alias("prefix"), a["next_hop"].alias("hop"))),
    ))
    none = F.array().cast("array<bigint>")
    rows = m.select(
        *order, F.coalesce("timestamp", F.lit(0.0)).alias("ts"), F.coalesce("peer", F.lit("")).alias("peer"), F.coalesce(F.col("peer_asn").try_cast("bigint"), F.lit(0)).alias("peer_asn"),
        "host", path.alias("path"), from_set.alias("from_set"), origin_attribute(F.col("origin")).alias("origin_attr"), "med", communities(F.coalesce("community", F.expr("cast(array() as array<array<bigint>>)"))).alias("communities"),
        F.posexplode(F.concat(withdrawn, announced)).alias("item", "e"),
    )
    p = (parse if ipv6 else parse_v4)(F.col("e.prefix"))
    announce = F.col("e.kind") == "announce"
    rows = rows.withColumn("p", p).where("p.family is not null")
    hop = parse_address(F.col("e.hop")) if ipv6 else F.regexp_extract(F.col("e.hop"), r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    return rows.select(
        *order, "item", "ts", F.col("e.kind").alias("kind"), "p.family", "p.len", "p.hi", "p.lo", F.when(announce, F.col("path")).otherwise(none).alias("path"),
        (announce & F.col("from_set")).alias("origin_from_set"), F.when(announce, F.col("origin_attr")).alias("origin_attr"), F.when(announce & (hop != ""), hop).alias("next_hop"),
        F.when(announce, F.col("med")).alias("med"), F.lit(None).cast("bigint").alias("local_pref"), F.when(announce, F.col("communities")).otherwise(none).alias("communities"),
        "peer", "peer_asn", F.lit("live").alias("source"), "host",
    )


def read(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines landed as text files, in batch or as a stream."""
    return (spark.readStream if streaming else spark.read).text(path)


def feed_filter(events: DataFrame, host: str | None = None, prefix: str | None = None) -> DataFrame:
    """What a feed would send for a collector and a prefix with its more-specifics."""
    from ..functions.prefix import mask, parse_text

    if host and "host" in events.columns:
        events = events.where(F.col("host") == host)
    if prefix:
        family, length, hi, lo = parse_text(prefix)
        m = mask(F.col("hi"), F.col("lo"), F.lit(length))
        events = events.where((F.col("family") == family) & (F.col("len") >= length) & (m[0] == hi) & (m[1] == lo))
    return events
