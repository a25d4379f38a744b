"""Validated ROA payloads from a JSON dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import parse, parse_v4
from ..schema import MAX_ASN

_ROA = "prefix string, asn string, maxLength string"


def asn(text: Column) -> Column:
    """The number of an AS given as a number, `AS13335` or `13335`; null if it is none."""
    n = F.regexp_extract(F.trim(text), r"^(?:[Aa][Ss])?([0-9]{1,10})(?:\.0+)?$", 1).try_cast("bigint")
    return F.when(n <= MAX_ASN, n)


def valid(roas: DataFrame, ipv6: bool = True) -> DataFrame:
    """(family, len, hi, lo, asn, max_len) of rows (prefix, asn, maxLength) as texts: bad ones are left out, equal ones are one.

    A missing maximal length is the prefix's own; it must lie between that and the family's.
    """
    p = parse(F.col("prefix")) if ipv6 else parse_v4(F.col("prefix"))
    rows = roas.select(p.alias("p"), asn(F.col("asn")).alias("asn"), F.col("maxLength").alias("m"))
    rows = rows.select("p.*", "asn", F.coalesce(F.floor(F.col("m").try_cast("double")).try_cast("int"), F.when(F.col("m").isNull(), F.col("p.len"))).alias("max_len"))
    bits = F.when(F.col("family") == 6, 128).otherwise(32)
    ok = F.col("family").isNotNull() & F.col("asn").isNotNull() & F.col("max_len").between(F.col("len"), bits)
    return rows.where(ok).dropDuplicates()


def load(spark: SparkSession, path: str, ipv6: bool = True) -> DataFrame:
    """The VRPs of a dump {"roas": [{"prefix", "asn", "maxLength"}, ...]}. A dump is one document, so one task reads it."""
    dump = spark.read.schema(f"roas array<struct<{_ROA.replace(' string', ':string')}>>").option("multiLine", True).option("primitivesAsString", True).json(path)
    return valid(dump.select(F.explode("roas").alias("r")).select("r.*"), ipv6)
