import pytest
from harness import SF, assert_same

from weirflow.plans import problems


@pytest.mark.parametrize("name", list(problems.QUERIES))
def test_matches_sql(spark, name):
    assert assert_same(problems.QUERIES[name](spark, SF), problems.SQL[name]) > 0
