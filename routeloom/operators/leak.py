"""Route leaks: valley-free violations along AS paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P2C, C2P, PEER = "p2c", "c2p", "peer"


def relationship_rows(providers: list[tuple[int, int]], peers: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(a, b, rel) for ordered pairs, both directions; peer pairs replace provider pairs, later pairs earlier ones."""
    out: dict[tuple[int, int], str] = {}
    for provider, customer in providers:
        out[provider, customer], out[customer, provider] = P2C, C2P
    for a, b in peers:
        out[a, b] = out[b, a] = PEER
    return [(a, b, rel) for (a, b), rel in sorted(out.items())]


def leak(path: Column, rows: list[tuple[int, int, str]]) -> Column:
    """(leaker, leaked_to) of the first violation from the origin's end on, or null. rows: at most 8192, from relationship_rows."""
    if not rows:
        return F.lit(None).cast("struct<leaker:bigint,leaked_to:bigint>")
    relation = F.map_from_entries(F.array(*(F.struct(F.lit(f"{a}>{b}"), F.lit(rel)) for a, b, rel in rows)))
    back = F.reverse(path)
    pairs = F.zip_with(F.slice(back, F.lit(1), F.greatest(F.size(back) - 1, F.lit(0))), F.slice(back, 2, 255), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.lit(False).alias("descended"), F.lit(None).cast("bigint").alias("leaker"), F.lit(None).cast("bigint").alias("leaked_to"))

    def step(s: Column, e: Column) -> Column:
        rel = F.when(e["a"] != e["b"], F.try_element_at(relation, F.concat(e["a"].cast("string"), F.lit(">"), e["b"].cast("string"))))
        found = s["leaker"].isNull() & s["descended"] & rel.isin(C2P, PEER)
        hit = F.coalesce(found, F.lit(False))
        return F.struct(
            (s["descended"] | F.coalesce(rel.isin(P2C, PEER), F.lit(False))).alias("descended"),
            F.when(hit, e["a"]).otherwise(s["leaker"]).alias("leaker"), F.when(hit, e["b"]).otherwise(s["leaked_to"]).alias("leaked_to"),
        )

    end = F.aggregate(pairs, start, step)
    return F.when((F.size(path) >= 3) & end["leaker"].isNotNull(), F.struct(end["leaker"].alias("leaker"), end["leaked_to"].alias("leaked_to")))


def leaks(announces: DataFrame, rows: list[tuple[int, int, str]]) -> DataFrame:
    """Announcements with a violation, with leaker and leaked_to. Neither AS sets nor origins matter."""
    return announces.where("kind = 'announce'").withColumn("_leak", leak(F.col("path"), rows)).where("_leak is not null").select("*", "_leak.leaker", "_leak.leaked_to").drop("_leak")
