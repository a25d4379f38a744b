"""AS paths, communities, attributes and enumerations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALERT_TYPES, MAX_ASN, MAX_COMMUNITIES, MAX_PATH, SEVERITIES


def path_origin(path: Column) -> Column:
    """The last AS, 0 for an empty path."""
    return F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(0).cast("bigint"))


def event_origin(kind: Column, path: Column) -> Column:
    """The origin of an announcement, 0 for a withdrawal."""
    return F.when(kind == "announce", path_origin(path)).otherwise(F.lit(0).cast("bigint"))


def format_path(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), " ")


def parse_path(text: Column) -> Column:
    """The path of a text of AS numbers with spaces between; null if it holds anything else, a number too large, or too many. Empty is an empty path."""
    items = F.filter(F.split(text, " "), lambda s: s != "")
    numbers = F.transform(items, lambda s: F.when(s.rlike("^[0-9]{1,19}$"), s.try_cast("bigint")))
    ok = F.forall(numbers, lambda n: n.isNotNull() & (n <= MAX_ASN)) & (F.size(numbers) <= MAX_PATH)
    return F.when(ok, numbers)


def merge_as4(path: Column, path4: Column) -> Column:
    """The 4-octet path replaces the tail of the 2-octet one, if it isn't empty and not longer."""
    n, n4 = F.size(path), F.size(path4)
    return F.when((n4 > 0) & (n4 <= n), F.concat(F.slice(path, F.lit(1), n - n4), path4)).otherwise(path)


def flatten_segments(path: Column) -> tuple[Column, Column]:
    """(path, origin_from_set) of a live path whose items are numbers or nested lists, as texts."""
    numbers = F.flatten(F.transform(path, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda d: d.cast("bigint"))))
    from_set = F.coalesce(F.try_element_at(path, F.lit(-1)).startswith("["), F.lit(False))
    return F.slice(numbers, 1, MAX_PATH), from_set


def community(asn: Column, value: Column) -> Column:
    """A community as one number: the AS in the upper 16 bits, of 32."""
    return F.shiftleft(asn.cast("bigint"), 16).bitwiseOR(value.cast("bigint").bitwiseAND(F.lit(65535).cast("bigint"))).bitwiseAND(F.lit(0xFFFFFFFF))


def communities(pairs: Column) -> Column:
    """Communities of an array of [as, value], the first 64."""
    return F.slice(F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: community(p[0], p[1])), 1, MAX_COMMUNITIES)


def origin_attribute(text: Column) -> Column:
    """0 for igp, 1 for egp, 2 for any other text; null stays null."""
    return F.when(text.isNull(), None).when(text == "igp", 0).when(text == "egp", 1).otherwise(2).cast("smallint")


def next_hop(classic: Column, multiprotocol: Column) -> Column:
    """The classic next hop before the multiprotocol one."""
    return F.coalesce(classic, multiprotocol)


def _code(text: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(names):
        out = F.when(text == name, i).otherwise(out)
    return F.when(text.isNull(), -1).otherwise(out)


def type_code(text: Column) -> Column:
    """Number of an alert type, -1 if unknown."""
    return _code(text, ALERT_TYPES)


def severity_code(text: Column) -> Column:
    """Number of a severity by rising weight, -1 if unknown."""
    return _code(text, SEVERITIES)
