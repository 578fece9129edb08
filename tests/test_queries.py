"""Each registered query against its SQL on the smallest tables, or for rows where it has none."""

import pytest

from chronoweave.plans import catalogue
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got) or name == "stft_rank"
        return
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
