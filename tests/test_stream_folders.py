"""The streaming queries over an events table of several part files."""

import pytest
from pyspark.sql import functions as F

from flightline.plans import registry


@pytest.mark.parametrize("name", ["streaming_window_counts", "streaming_first_alert"])
def test_parts_in_no_order_give_the_rows_of_one_file(spark, sf, tmp_path, name):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    query = registry.queries()[name]
    one = query(spark, sf).collect()
    assert sorted(query(spark, str(tmp_path)).collect()) == sorted(one) and len(one) > 0


def test_no_parts_give_no_rows(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    assert registry.queries()["streaming_first_alert"](spark, str(tmp_path)).count() == 0
