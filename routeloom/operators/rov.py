"""Route-origin validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PREFIX
from .coverjoin import cover_join


def validate(routes: DataFrame, vrps: DataFrame) -> DataFrame:
    """routes with rov: valid if a covering VRP has the origin (not 0) and allows the length; else invalid if any covers; else notfound.

    routes have a prefix and an origin. The same prefixes and origins are validated once.
    """
    asked = routes.select(*PREFIX, "origin").distinct()
    met = cover_join(asked, vrps, how="left")
    match = (F.col("asn") == F.col("origin")) & (F.col("asn") != 0) & (F.col("len") <= F.col("max_len"))
    state = F.when(F.max(F.coalesce(match, F.lit(False))), "valid").when(F.max(F.col("cover_len").isNotNull()), "invalid").otherwise("notfound")
    states = met.groupBy(*PREFIX, "origin").agg(state.alias("rov"))
    return routes.join(states, [*PREFIX, "origin"]).select(*routes.columns, "rov")
