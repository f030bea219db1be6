"""What a user does next with a result: filter, select, join, count."""

import pytest
from pyspark.sql import functions as F

from flightline.llm import bloom_cascade, queries
from flightline.llm.bloom_cascade import Rule



@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_results_can_be_filtered_joined_and_counted(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    key = df.columns[0]
    for column in df.columns:
        value = next((r[column] for r in rows if r[column] is not None), None)
        if value is not None:
            assert df.where(F.col(column) == F.lit(value)).count() == sum(r[column] == value for r in rows)
            break
    last = df.columns[-1]
    assert df.where(F.col(last).isNotNull()).select(key).count() == sum(r[last] is not None for r in rows)
    ids = spark.createDataFrame([(r[key],) for r in rows[:5]], f"wanted {df.schema[key].dataType.simpleString()}").distinct()
    assert df.join(ids, F.col(key) == F.col("wanted"), "left_semi").count() == sum(r[key] in {x[key] for x in rows[:5]} for r in rows)


def test_urls_are_filtered_by_verdict_under_ten_thousand_rules(spark):
    rules = [Rule("block" if k % 2 else "allow", f"h{k}.org", "/") for k in range(10_000)]
    urls = [f"http://{'www.' * (k % 2)}h{37 * k % 12_000}.org/x" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = bloom_cascade.filter_urls(pages, rules)
    by_key = {r.key: r.verdict for r in rules}
    expected = [by_key.get(f"h{37 * k % 12_000}.org/", "allow") for k in range(300)]
    assert got.where("verdict = 'block'").count() == expected.count("block")
    assert {r["page_id"]: r["verdict"] for r in got.where("page_id < 50").collect()} == dict(enumerate(expected[:50]))
