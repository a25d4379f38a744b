"""Connected components against a search, and the rows that the steps make."""

import random

import pytest

from routeloom.llm import components


def roots(edges):
    root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    for a, b in edges:
        if a in root and b in root and a != b:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    return root


def graphs():
    rng = random.Random(5)
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    yield [(i, i + 1) for i in range(40)]  # a path
    yield [(50, i) for i in range(50)] + [(0, i) for i in range(60, 90)] + [(200, i) for i in range(210, 260)]  # stars
    yield [(1, 2), (2, 1), (3, 3), (None, 4), (-5, 6), (2**62, -(2**62)), (6, 2**62)]
    yield []


@pytest.mark.parametrize("least", [1000, 3])
def test_against_a_search(spark, monkeypatch, least):
    monkeypatch.setattr(components, "CENTRE_LEAST", least)  # 3: the nodes of stars are centres
    for edges in graphs():
        found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == roots(edges)


def test_no_edge_is_listed_in_both_directions(spark, monkeypatch):
    """A step makes no rows by a Generate, and as many joined rows as edges at most."""
    plans, sizes = [], []

    def seen(df, cut=components.cut):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", seen)
    edges = spark.createDataFrame([(100 + i, j) for i in range(100) for j in range(8)], "a bigint, b bigint")
    assert {r.root for r in components.components(edges).collect()} == {0}
    assert len(plans) > 2 and not any("Generate" in p for p in plans)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 107
