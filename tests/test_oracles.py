"""Every registered query against its SQL, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as driver

QUERIES = driver.queries()
SQL = driver.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf, name):
    found = QUERIES[name](spark, sf)
    if name in SQL:
        assert oracle.differences(found, SQL[name], duck) == []
    else:
        assert found.count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_minutes(spark):
    first = driver.entry(spark).orderBy("meeting_id", "part").first()
    assert first.markdown.startswith("# Meeting 0\n\n## Speakers\n")


def test_estimate_of_vocabulary_is_close(spark, duck, sf):
    from minutary.oracles import TALK, TEXT_WORDS

    exact = duck.sql(f"SELECT count(DISTINCT w) FROM (SELECT unnest({TEXT_WORDS}) AS w FROM {TALK})").fetchall()[0][0]
    found = QUERIES["vocabulary_merged"](spark, sf).first().words
    assert abs(found - exact) <= 0.05 * exact
