"""Every registered engine query against its SQL on the smallest tables."""

import oracle
import pytest

from tidemill import queries, queries_more  # noqa: F401

PLAIN = [n for n in queries.QUERIES if n not in queries.SQL]


@pytest.fixture(scope="module")
def db(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, spark, data, db):
    assert oracle.compare(db, queries.QUERIES[name](spark, data), queries.SQL[name]) is None


@pytest.mark.parametrize("name", PLAIN)
def test_runs(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_relative_strength_index_covers_all_users(spark, data, db):
    ids = {r["event_id"] for r in queries.QUERIES["relative_strength_index"](spark, data).collect()}
    rows = db.execute("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events) WHERE i > 20").fetchall()
    assert {r[0] for r in rows} <= ids


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
