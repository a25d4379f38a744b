"""Prefix and address functions as column expressions; texts with IPv6 go through Arrow UDFs on the C library's parser."""

from __future__ import annotations

import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PREFIX

PREFIX_TYPE = T.StructType([T.StructField("family", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])


def _mask64(x: Column, bits: Column) -> Column:
    """The first `bits` (0 to 64) bits of x. Shifts count modulo 64, so 0 and 64 are apart."""
    return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, x).otherwise(x.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - bits).cast("int"))))


def mask(hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """(hi, lo) with the bits from `length` on set to zero."""
    return _mask64(hi, length), _mask64(lo, length - 64)


def covers(outer: str, inner: str) -> Column:
    """Whether prefix columns named outer_* cover those named inner_*, inclusive. For joins prefer the equi-join of operators.coverjoin."""
    o, i = (lambda c: F.col(f"{outer}{c}")), (lambda c: F.col(f"{inner}{c}"))
    hi, lo = mask(i("hi"), i("lo"), o("len"))
    return (o("family") == i("family")) & (o("len") <= i("len")) & (hi == o("hi")) & (lo == o("lo"))


def bit(hi: Column, lo: Column, i: Column) -> Column:
    """Bit i of the address, from the left."""
    word, at = F.when(i < 64, hi).otherwise(lo), (F.lit(63) - i % 64).cast("int")
    return F.call_function("shiftrightunsigned", word, at).bitwiseAND(F.lit(1).cast("bigint")).cast("int")


def v4_hi(net: Column) -> Column:
    """The upper half of a prefix from an IPv4 network as a number."""
    return F.shiftleft(net.cast("bigint"), 32)


def v4_net(hi: Column) -> Column:
    return F.shiftrightunsigned(hi, 32)


def format_v4(hi: Column, length: Column) -> Column:
    net = v4_net(hi)
    octets = [(F.shiftrightunsigned(net, s).bitwiseAND(F.lit(255).cast("bigint"))).cast("string") for s in (24, 16, 8, 0)]
    return F.concat(F.concat_ws(".", *octets), F.lit("/"), length.cast("string"))


#: An octet without leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def parse_v4(text: Column) -> Column:
    """The prefix of a text `a.b.c.d/len` as a struct, host bits zeroed; null if it is none."""
    pattern = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}/(0*[0-9]{{1,2}})$"
    part = lambda i: F.try_to_number(F.regexp_extract(text, pattern, i), F.lit("999")).cast("bigint")
    net = sum(F.shiftleft(F.coalesce(part(i), F.lit(0).cast("bigint")), 8 * (4 - i)) for i in (1, 2, 3, 4))
    length = F.regexp_extract(text, r"/0*([0-9]{1,2})$", 1).try_cast("int")
    hi = _mask64(v4_hi(net), length)
    value = F.struct(F.lit(4).alias("family"), length.alias("len"), hi.alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    return F.when(text.rlike(pattern) & (length <= 32), value)


def parse_text(text: str | None) -> tuple[int, int, int, int] | None:
    """(family, len, hi, lo) of a prefix of either family, or None."""
    if text is None or "/" not in text:
        return None
    address, _, digits = text.partition("/")
    if not digits.isascii() or not digits.isdigit():
        return None
    family, bits = (6, 128) if ":" in address else (4, 32)
    length = int(digits)
    try:
        raw = socket.inet_pton(socket.AF_INET6 if family == 6 else socket.AF_INET, address)
    except (OSError, ValueError):
        return None
    if length > bits:
        return None
    value = int.from_bytes(raw.ljust(16, b"\0"), "big")
    value &= ((1 << length) - 1) << (128 - length)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return family, length, signed(value >> 64), signed(value & (1 << 64) - 1)


def format_text(family: int, length: int, hi: int, lo: int) -> str:
    raw = ((hi % (1 << 64)) << 64 | lo % (1 << 64)).to_bytes(16, "big")
    address = socket.inet_ntop(socket.AF_INET6, raw) if family == 6 else socket.inet_ntop(socket.AF_INET, raw[:4])
    return f"{address}/{length}"


@F.pandas_udf(PREFIX_TYPE)
def parse(texts: pd.Series) -> pd.DataFrame:
    """The prefix of a text of either family; all fields null if it is none."""
    rows = [parse_text(t) or (None,) * 4 for t in texts]
    # column by column: with a null among them, pandas would make floats of a frame's numbers
    return pd.DataFrame({c: pd.array([r[i] for r in rows], "Int64") for i, c in enumerate(PREFIX)})


@F.pandas_udf(T.StringType())
def format(family: pd.Series, length: pd.Series, hi: pd.Series, lo: pd.Series) -> pd.Series:  # noqa: A001
    return pd.Series([format_text(*p) for p in zip(family, length, hi, lo)], dtype=object)


@F.pandas_udf(T.StringType())
def parse_address(texts: pd.Series) -> pd.Series:
    """The address in its canonical form, or null."""
    out = []
    for t in texts:
        p = parse_text(f"{t}/{128 if ':' in t else 32}") if t is not None and "/" not in t else None
        out.append(format_text(*p).partition("/")[0] if p else None)
    return pd.Series(out, dtype=object)
