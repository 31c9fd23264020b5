"""Halves go to the even number, as the SQL's casts do."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from factloom.plans import catalog


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


EVENTS = [(1, 1, "signup", at(0.5), 10.0), (2, 1, "purchase", at(3601.5), 30.0), (3, 1, "purchase", at(86400.5), 260.0), (4, 2, "signup", at(2.5), 50.0), (5, 2, "purchase", at(100), 10.0)]
ORDERS = [(1, 1, "1", 105000.0, "O"), (2, 2, "1", 103000.0, "P"), (3, 1, "1", 101000.0, "P"), (4, 3, "1", 104000.0, "F"), (5, 3, "1", 107000.0, "P")]


@pytest.mark.parametrize("name", ["nearest_span_within", "merged_evidence_windows", "discover_until_known", "unnamed_rows_to_cases"])
def test_halves_equal_sql(spark, tmp_path, name):
    events = spark.createDataFrame(EVENTS, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
    orders = spark.createDataFrame([(k, c, p, t, s, at(0)) for k, c, p, t, s in ORDERS], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderstatus string, o_orderdate timestamp_ntz")
    con = duckdb.connect()
    for table, df in (("events", events), ("orders", orders)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    found = con.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == sorted(found.fetchall())
