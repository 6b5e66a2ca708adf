"""Trailing queries over signals longer than what they keep: at the reference's sizes nothing of sf0.01 goes."""

import duckdb
import pytest
from oracle import difference, duck

from sparkwave import oracles, queries

#: Samples of a channel.
LENGTHS = {3: 10_251, 5: 8400}


@pytest.fixture(scope="module")
def long(tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    each = " UNION ALL ".join(
        f"SELECT i * 16 + {c} AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, {c} + 16 * (i % 5) AS user_id, i % 997 / 4 AS value FROM range({n}) r(i)" for c, n in LENGTHS.items()
    )
    duckdb.sql(f"COPY ({each}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def kept(spark, folder, name):
    """channel and its first, last and number of idx; the rows are those of the SQL."""
    rows = queries.queries()[name](spark, folder).cache()
    assert difference(rows, oracles.oracle_sql()[name], duck(folder)) == ""
    got = {}
    for row in rows.collect():
        got.setdefault(row.channel, []).append(row.idx)
    return {c: (min(v), max(v), len(v)) for c, v in got.items()}


def test_recent_window_keeps_three_seconds(spark, long):
    assert kept(spark, long, "recent_window") == {3: (7250, 10_250, 3001), 5: (7250, 8399, 1150)}


def test_buffer_tail_keeps_a_hundred_chunks(spark, long):
    assert kept(spark, long, "buffer_tail") == {3: (300, 10_250, 9951), 5: (300, 8399, 8100)}


def test_plot_tail_keeps_three_thousand_points(spark, long):
    assert kept(spark, long, "plot_tail") == {3: (7251, 10_250, 3000), 5: (5400, 8399, 3000)}
