"""Events that fall in one millisecond: of those the one of the smallest id counts, in whatever order the table is stored and read."""

import datetime

import duckdb
import pytest
from compare import connect, same

from marlstone.plans.oracles import ORACLES
from marlstone.plans.queries import QUERIES

START = datetime.datetime(2024, 1, 13)
#: Seconds with events, and the microseconds of a second's events: four in one millisecond, then an earlier one.
SECONDS, MICROS = range(0, 4 * 86_400, 3_600), (500_000, 500_999, 500_001, 500_500, 20)


@pytest.fixture
def table(tmp_path):
    rows = [(START + datetime.timedelta(seconds=s, microseconds=us), round(1 + s / 3_600 + k / 10, 2)) for s in SECONDS for k, us in enumerate(MICROS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, 1, 'view', ?, '')", [(i, *r) for i, r in enumerate(rows)])

    def write(name, order):
        (tmp_path / name).mkdir()
        con.execute(f"COPY (SELECT * FROM e ORDER BY {order}) TO '{tmp_path}/{name}/events.parquet' (FORMAT parquet)")
        return str(tmp_path / name)

    return write


@pytest.mark.parametrize("name, days", [("source_metrics", 4), ("source_pruned_metrics", 2)])
def test_tied_events(spark, table, name, days):
    by_id = table("by_id", "event_id")
    con = connect(by_id)
    con.execute("SET threads = 1")
    assert same(QUERIES[name](spark, by_id), con, ORACLES[name]) == 24 * days
    for k, order in enumerate(("event_id DESC", "hash(event_id)")):
        assert same(QUERIES[name](spark, table(f"other{k}", order)), con, ORACLES[name]) == 24 * days
