"""Registered queries: every name runs on the smallest data, oracles agree where DuckDB has them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

# A spread of cheap queries; tools/check.py compares all of them at a larger scale.
SAMPLE = [
    "time_range_scan", "bbox_filter", "scrape_extent", "count_in_range", "area_day_series", "geohash_grid", "grid_by_day",
    "trending_users", "tick_table", "square_grid", "geohash_decode", "replay_schedule", "csv_roundtrip", "json_props",
    "topic_demux", "quantiles", "histogram_sturges", "nested_bins_by_day", "consecutive_pairs", "stack_offsets", "hexbin",
    "box_search", "points_in_polygon", "tile_counts", "chord_flows", "tree_shares", "rank_warp", "time_floor", "week_of_year",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r.asDict(True).values()) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
