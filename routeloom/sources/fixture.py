"""Route events derived from the table `events`, and the static tables that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import parse_text, v4_hi
from ..schema import RELATIONSHIPS, VRPS, WATCHLIST

_MAPPING = """
    SELECT seq, ts,
      CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'announce' END AS kind,
      4 AS family,
      CASE slot % 4 WHEN 0 THEN 16 WHEN 1 THEN 20 ELSE 24 END AS len,
      167772160 + (slot DIV 4) * 65536 + CASE slot % 4 WHEN 0 THEN 0 WHEN 1 THEN 4096 WHEN 2 THEN 4352 ELSE 8192 END AS net,
      concat('p', CAST(seq % 5 AS STRING)) AS peer, 64600 + seq % 5 AS peer_asn,
      CASE WHEN k >= 97 THEN 64666 WHEN k >= 94 THEN 65100 + slot DIV 4 ELSE 65000 + slot DIV 4 END AS origin_raw,
      CASE WHEN k % 10 = 7 THEN array(1299L, 64500L, 3356L) WHEN k % 2 = 0 THEN array(3356L) ELSE array(1299L) END AS transit,
      k = 50 AS from_set, CAST(floor(value) AS BIGINT) AS med, event_type, k
    FROM {e}
"""


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = events.select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("user_id") % 48).alias("slot"),
    )
    announce = F.col("kind") == "announce"
    none = F.array().cast("array<bigint>")
    return spark.sql(_MAPPING, e=e).select(
        "seq", "ts", "kind", "family", "len", v4_hi(F.col("net")).alias("hi"), F.lit(0).cast("bigint").alias("lo"),
        F.when(announce, F.concat(F.array("peer_asn"), "transit", F.array("origin_raw"))).otherwise(none).alias("path"),
        F.col("from_set").alias("origin_from_set"), F.lit(None).cast("smallint").alias("origin_attr"), F.lit(None).cast("string").alias("next_hop"),
        "med", F.lit(None).cast("bigint").alias("local_pref"), none.alias("communities"), "peer", "peer_asn", F.lit("fixture").alias("source"),
    )


def vrps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*parse_text(f"10.{b}.0.0/16"), 65000 + b, 20) for b in range(9)], VRPS)


#: (provider, customer) and (peer, peer) pairs
PROVIDERS = [(3356, 64500), (1299, 64500)]
PEERS: list[tuple[int, int]] = []


def watchlist(spark: SparkSession, entries: list[tuple[str, int]] = ()) -> DataFrame:
    return spark.createDataFrame([(*parse_text(p), origin) for p, origin in entries], WATCHLIST)


def relationships(spark: SparkSession) -> DataFrame:
    from ..operators.leak import relationship_rows

    return spark.createDataFrame(relationship_rows(PROVIDERS, PEERS), RELATIONSHIPS)
