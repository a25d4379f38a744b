"""Queries and their SQL on the smallest tables; the driver compares all of them on larger ones."""

import duckdb
import pandas as pd
import pytest

from routeloom.plans import oracle, queries, wire, wire_oracle

QUERIES, ORACLE_SQL = queries.QUERIES | wire.QUERIES, oracle.ORACLE_SQL | wire_oracle.ORACLE_SQL

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.parametrize("name", ["rov_state", "rib_first_seen", "rib_history", "watch_seed", "hijack_watched", "subprefix", "leak", "spike_prefix", "alerts_all", "ris_parse", "vrp_load", "prefix_parse", *wire.QUERIES])
def test_query(spark, name):
    assert set(QUERIES) == set(ORACLE_SQL)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(str(tuple(map(plain, r))) for r in f[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
