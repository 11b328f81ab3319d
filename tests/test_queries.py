import pytest
from compare import canonical, oracle

from registrum.plans import builds, catalogue, pages, studies  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = canonical([tuple(r) for r in df.collect()], df.columns)
    if name in catalogue.ORACLES:
        assert rows == oracle(SF, catalogue.ORACLES[name])
    else:
        assert rows[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
