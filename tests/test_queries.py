"""Registered queries against their SQL on the small driver tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from catalogkit.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def answers(spark):
    """What each query gives: several run at a time, as planning takes most of their time here."""

    def answer(name):
        df = Q.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        return columns, [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]

    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(answer, name) for name in sorted(Q.ORACLES)}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(answers, duck, name):
    columns, got = answers[name].result()
    sql = duck.sql(Q.ORACLES[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in sql.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["w15_primary_video", "p28_track_checks"])
def test_tracks_with_one_number(spark, tmp_path, name):
    """Of video tracks with one number SQL takes the first of the table, not the last and not by language."""
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"COPY (SELECT i AS p_partkey, 'x' AS p_name, 'Brand#1' AS p_brand, 'y' AS p_type, 1 AS p_size FROM range(500) t(i)) TO '{tmp_path}/part.parquet'")
    row = "i // 2000 AS l_orderkey, i % 500 AS l_partkey, (hash(i) % 1000)::BIGINT AS l_suppkey, 7 AS l_linenumber, 1.0::DOUBLE AS l_quantity, 'R' AS l_returnflag, 'F' AS l_linestatus"
    c.sql(f"COPY (SELECT {row} FROM range(6000) t(i)) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    got = df.select(*sorted(df.columns)).collect()
    want = c.sql(f"SELECT {', '.join(sorted(df.columns))} FROM ({Q.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 500


def test_search_for_words_of_letters(spark, tmp_path):
    """Hashes that have letters only are words of the list; files of the sf0.1 table where one was dropped as an abbreviation."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT unnest([15007, 16822, 16528, 3, 4, 5])::BIGINT AS p_partkey, 'x' AS p_name, 'Brand#1' AS p_brand, 'y' AS p_type, 1 AS p_size) TO '{tmp_path}/part.parquet'")
    c.sql(f"COPY (SELECT 'ASIA' AS r_name) TO '{tmp_path}/region.parquet'")
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = Q.QUERIES["j30_search_with_retries"](spark, str(tmp_path)).select("title_id", "tmdb", "step", "wanted")
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT title_id, tmdb, step, wanted FROM ({Q.ORACLES['j30_search_with_retries']})").fetchall())
