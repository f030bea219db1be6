"""Explanations against their SQL where a number lies just below one at which decimals change."""

import duckdb
from flightline.plans import agent_queries
from pyspark.sql import functions as F


def test_decimals_follow_the_number_itself(spark, tmp_path):
    # Steps of 100 less a unit in the last place, twice on end, so that both are there at the alert.
    assert 128.01 - 28.01 < 100 and round(128.01 - 28.01, 6) == 100
    rows = [(u, k, float(10 + (u * 7 + k * 3) % 20), "view") for u in range(6) for k in range(12)]
    rows += [(99, k, 128.01 if k in (5, 7) else 28.01, "view") for k in range(12)]
    events = spark.createDataFrame(rows, "user_id long, k long, value double, event_type string").selectExpr("user_id * 100 + k AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, k) AS ts", "user_id", "event_type", "value", "'' AS props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.sql(agent_queries.BOOK.sql["explanations"]).fetchall()
    got = agent_queries.explanations(spark, str(tmp_path)).select("user_id", "class", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert any("step = 100.0" in r["text"] for r in got)
