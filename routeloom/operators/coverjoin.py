"""Join of prefixes with the prefixes that cover them.

Each probe is expanded to its networks at the lengths that occur on the build side (at most 33 for IPv4 and 129 for
IPv6), so that the join is a hash equi-join on (family, length, network). A condition on masks instead would leave
only the family as a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import mask


def lengths(build: DataFrame) -> dict[int, list[int]]:
    """The prefix lengths that occur, by family: at most 162 values in all."""
    out: dict[int, list[int]] = {}
    for family, length in build.select("family", "len").distinct().orderBy("family", "len").collect():
        out.setdefault(family, []).append(length)
    return out


def cover_join(probe: DataFrame, build: DataFrame, strict: bool = False, how: str = "inner") -> DataFrame:
    """Rows of probe with each row of build whose prefix covers theirs; build's prefix columns become cover_len, cover_hi, cover_lo.

    strict leaves out equal prefixes. how is inner or left; left keeps probes without a cover, once.
    """
    present = lengths(build)
    build = build.withColumnsRenamed({"family": "cover_family", "len": "cover_len", "hi": "cover_hi", "lo": "cover_lo"})
    if not present:
        expanded = probe.withColumn("_len", F.lit(None).cast("int"))
    else:
        at = F.lit(None).cast("array<int>")
        for family, values in present.items():
            at = F.when(F.col("family") == family, F.array(*map(F.lit, values)).cast("array<int>")).otherwise(at)
        fits = F.filter(at, lambda n: n < F.col("len") if strict else n <= F.col("len"))
        expanded = probe.withColumn("_len", F.explode_outer(fits) if how == "left" else F.explode(fits))
    hi, lo = mask(F.col("hi"), F.col("lo"), F.col("_len"))
    expanded = expanded.withColumns({"_hi": hi, "_lo": lo})
    on = (F.col("family") == F.col("cover_family")) & (F.col("_len") == F.col("cover_len")) & (F.col("_hi") == F.col("cover_hi")) & (F.col("_lo") == F.col("cover_lo"))
    return expanded.join(build, on, how).drop("_len", "_hi", "_lo", "cover_family")
