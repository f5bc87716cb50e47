import pytest
from harness import SF, assert_same

from weirflow.plans import connectors, streams


@pytest.mark.parametrize("name", list(streams.SQL))
def test_matches_sql(spark, name):
    assert assert_same(streams.QUERIES[name](spark, SF), streams.SQL[name]) > 0


def test_placement_covers_all_events(spark):
    rows = streams.key_group_placement(spark, SF).collect()
    assert sum(r.n_events for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(0 <= r.key_group < 256 and 0 <= r.operator_no < 7 for r in rows)


@pytest.mark.parametrize("name", list(connectors.SQL))
def test_connectors_give_back_what_they_got(spark, name):
    assert assert_same(connectors.QUERIES[name](spark, SF), connectors.SQL[name]) > 0
