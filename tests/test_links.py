"""Links of tracklets whose distances tie."""

from __future__ import annotations

import datetime


def test_ties_of_distance_fall_as_in_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    day = lambda n: datetime.datetime(2024, 1, n, 12)
    rows = [(1, day(1), 7, "z", 114.0), (2, day(6), 7, "a", 126.79), (3, day(6), 7, "b", 101.21)]  # as far to either side
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.a, r.b, r.gap) for r in entry.queries()["d27_link_tracklets"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {r[1:] for r in c.sql(entry.oracle_sql()["d27_link_tracklets"]).fetchall()} == {("z/146", "a/146", 5)}
