"""URL texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_decode(text: Column) -> Column:
    """%xx as bytes of UTF-8 and + as a space; what is no valid escape stays as it is."""
    # an escape without two hexadecimal digits is text
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_value(query: Column, key: str) -> Column:
    """The decoded value of the first `key=` in a query string; null if there is none."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{key}="))
    return url_decode(F.substring(F.try_element_at(pairs, F.lit(1)), len(key) + 2, 1 << 20))
