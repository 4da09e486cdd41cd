import pytest
from compare import DATA, connect, same


from siltstone import catalogue


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE_SQL:
        same(got, duck.execute(catalogue.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "origin", "score"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
