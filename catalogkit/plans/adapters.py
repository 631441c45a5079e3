"""The driver tables in the shape of the catalogue's tables.

Each statement runs alike in Spark and DuckDB: as a view here, as a common table
expression in the SQL of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {
    "v_file": """
SELECT p_partkey AS file_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'movie' ELSE 'tv' END AS kind,
  CASE p_partkey % 6 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN 'mpeg4' WHEN 4 THEN 'vc1' ELSE 'theora' END AS codec,
  CASE p_size % 5 WHEN 0 THEN 720 WHEN 1 THEN 1280 WHEN 2 THEN 1920 WHEN 3 THEN 1440 ELSE 3840 END AS width,
  CASE p_size % 5 WHEN 0 THEN 576 WHEN 1 THEN 720 WHEN 2 THEN 800 WHEN 3 THEN 1080 ELSE 2160 END AS height,
  CAST(CASE WHEN p_size % 5 = 0 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS sar,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 25.0 ELSE 24.0 END AS DOUBLE) AS frame_rate,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 300 + (p_partkey * 37) % 7000 END AS DOUBLE) AS duration_s,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 300000 + (p_partkey * 7919) % 12000000 END AS bitrate,
  CASE WHEN p_size % 5 = 4 THEN 10 ELSE 8 END AS bit_depth,
  p_size % 5 = 4 AND p_partkey % 2 = 0 AS hdr,
  p_size % 10 = 4 AND p_partkey % 4 = 0 AS dolby_vision,
  CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 5) * 40 ELSE NULL END AS bars_px,
  1000000 * (1 + (p_partkey * 31) % 15000) AS size_bytes,
  p_name AS title, 1950 + p_size AS year,
  CAST(p_partkey AS VARCHAR(20)) AS tmdb,
  p_brand AS show, 1 + p_partkey % 4 AS season, 1 + CAST(FLOOR(p_partkey / 4) AS BIGINT) % 24 AS episode
FROM part
""",
    "v_track": """
SELECT l_partkey AS file_id, l_orderkey * 10 + l_linenumber AS track_no,
  CASE WHEN l_linenumber <= 3 THEN 'audio' WHEN l_linenumber <= 6 THEN 'subtitles' ELSE 'video' END AS type,
  CASE l_suppkey % 6 WHEN 0 THEN 'eng' WHEN 1 THEN 'en' WHEN 2 THEN NULL WHEN 3 THEN 'fre' WHEN 4 THEN 'ger' ELSE 'und' END AS language,
  CASE l_orderkey % 4 WHEN 0 THEN 'aac' WHEN 1 THEN 'ac3' WHEN 2 THEN 'dts' ELSE 'truehd' END AS codec,
  CASE l_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 8 END AS channels,
  l_returnflag = 'R' AS is_default, l_linestatus = 'F' AS forced,
  CASE l_orderkey % 5 WHEN 0 THEN 'English-FORCED-PGS' WHEN 1 THEN 'Non-Forced' WHEN 2 THEN 'unforced' ELSE NULL END AS name,
  CAST(l_quantity AS BIGINT) * 1000000 AS bytes
FROM lineitem
""",
    "v_title": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'movie' ELSE 'tv' END AS kind,
  CASE o_orderkey % 18 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'PROBED' WHEN 2 THEN 'SCREENED' WHEN 3 THEN 'IDENTIFIED' WHEN 4 THEN 'COMPARED' WHEN 5 THEN 'ROUTED' WHEN 6 THEN 'STAGED' WHEN 7 THEN 'REMUXED' WHEN 8 THEN 'TAGGED' WHEN 9 THEN 'READY' WHEN 10 THEN 'ENCODING' WHEN 11 THEN 'ENCODED' WHEN 12 THEN 'VERIFIED' WHEN 13 THEN 'PUBLISHED' WHEN 14 THEN 'CLEANUP' WHEN 15 THEN 'HELD' WHEN 16 THEN 'QUARANTINED' ELSE 'FAILED' END AS stage,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR(20)) END AS tmdb,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 97 AS VARCHAR(20)) END AS tvdb,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Show ' || CAST(o_custkey % 97 AS VARCHAR(20)) END AS show,
  1 + o_custkey % 3 AS season, 1 + CAST(FLOOR(o_orderkey / 7) AS BIGINT) % 20 AS episode,
  CASE WHEN o_orderkey % 10 = 0 THEN 2 + CAST(FLOOR(o_orderkey / 7) AS BIGINT) % 20 END AS episode_last,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 7) % 100003 END AS queue_order,
  o_orderkey % 8 AS attempts, o_orderdate AS updated_at
FROM orders
""",
    "v_history": """
SELECT event_id, user_id AS title_id,
  CASE event_type WHEN 'view' THEN 'PROBED' WHEN 'click' THEN 'SCREENED' WHEN 'signup' THEN 'IDENTIFIED' WHEN 'purchase' THEN 'PUBLISHED' ELSE 'HELD' END AS stage,
  ts AS at FROM events
""",
    "v_poll": """
SELECT event_id, 'import/' || CAST(user_id AS VARCHAR(20)) || '.mkv' AS path,
  CAST(FLOOR(value / 200) AS BIGINT) AS size, ts AS polled_at,
  CAST(event_id % 60 AS BIGINT) AS quiet_s FROM events
""",
    "v_login": """
SELECT event_id, CAST(user_id AS VARCHAR(20)) AS key, ts AS at, event_type IN ('error','view') AS failed, event_type = 'signup' AS ok FROM events
""",
    "v_crop_sample": """
SELECT l_partkey AS file_id, l_orderkey * 10 + l_linenumber AS offset_no,
  1920 AS cw, CASE WHEN l_quantity < 30 THEN 804 WHEN l_quantity < 45 THEN 1080 ELSE 816 END AS ch,
  0 AS cx, CASE WHEN l_quantity < 30 THEN 138 WHEN l_quantity < 45 THEN 0 ELSE 132 END AS cy FROM lineitem
""",
    "v_name": """
SELECT p_partkey AS name_id,
  CASE p_partkey % 6
   WHEN 0 THEN REPLACE(p_name, ' ', '.') || '.' || CAST(1950 + p_size AS VARCHAR(10)) || '.1080p.BluRay.x264-GRP' || CAST(p_partkey % 9 AS VARCHAR(4))
   WHEN 1 THEN p_name || ' (' || CAST(1950 + p_size AS VARCHAR(10)) || ') [tmdbid-' || CAST(p_partkey AS VARCHAR(20)) || '] [imdbid-tt' || CAST(1000000 + p_partkey AS VARCHAR(20)) || ']'
   WHEN 2 THEN p_name || ' - S0' || CAST(1 + p_partkey % 4 AS VARCHAR(4)) || 'E0' || CAST(1 + p_partkey % 8 AS VARCHAR(4)) || ' - ' || p_type || ' Part ' || CAST(1 + p_partkey % 3 AS VARCHAR(4))
   WHEN 3 THEN p_name || ' S02E0' || CAST(1 + p_partkey % 8 AS VARCHAR(4)) || '-E0' || CAST(2 + p_partkey % 8 AS VARCHAR(4)) || ' 720p'
   WHEN 4 THEN 'The ' || p_name || ': ' || p_type || '/' || p_brand || '? '
   ELSE p_name || ' Directors Cut ' || CAST(1950 + p_size AS VARCHAR(10)) || ' Extended' END AS name
FROM part
""",
    "v_episode": """
SELECT p_brand AS show, 1 + p_partkey % 4 AS season, 1 + CAST(FLOOR(p_partkey / 4) AS BIGINT) % 24 AS episode, p_partkey AS ordinal,
  p_name || CASE p_partkey % 5 WHEN 0 THEN ' (1)' WHEN 1 THEN ' (2)' WHEN 2 THEN ', Part Two' ELSE '' END AS title,
  20 + p_size AS runtime FROM part
""",
    "v_packet": """
SELECT l_partkey AS file_id, CASE WHEN l_linenumber = 7 THEN 'N/A' ELSE CAST(CAST(l_quantity AS BIGINT) * 1000 AS VARCHAR(20)) END AS line FROM lineitem
""",
    "v_setting": """
SELECT 'min_runtime_min.movie' AS key, '40' AS value_json UNION ALL SELECT 'grain_threshold.tv', '0.2' UNION ALL SELECT 'max_size_gb', '12.5'
""",
    "v_listing": """
SELECT 'lib/' || p_brand || '/' || CAST(p_partkey AS VARCHAR(20)) || '.mkv' AS path, 1000 + p_size AS size, p_partkey % 5 AS mtime FROM part WHERE p_partkey % 10 <> 0
""",
    "v_finding": """
SELECT 'lib/' || p_brand || '/' || CAST(p_partkey AS VARCHAR(20)) || '.mkv' AS path, 1000 + p_size AS size, CASE WHEN p_partkey % 4 = 0 THEN 9 ELSE p_partkey % 5 END AS mtime, p_partkey % 6 <> 0 AS measured, CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE '["names"]' END AS checks_json FROM part WHERE p_partkey % 7 <> 0
""",
}

_TABLE = re.compile(r"\bFROM (part|lineitem|orders|events)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the driver tables in ``sf_dir``."""
    found = _TABLE.search(VIEWS[name])
    if not found:
        return spark.sql(VIEWS[name])
    table = spark.read.parquet(f"{sf_dir}/{found[1]}.parquet")
    return spark.sql(_TABLE.sub("FROM {source}", VIEWS[name]), source=table)


def placed_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view with ``position``, the file and row that each of its rows comes from; for rows that nothing else orders."""
    found = _TABLE.search(VIEWS[name])
    source = F.struct("_metadata.file_path", "_metadata.row_index").alias("position")
    table = spark.read.parquet(f"{sf_dir}/{found[1]}.parquet").select("*", source)
    return spark.sql(_TABLE.sub(", position FROM {source}", VIEWS[name]), source=table)


def with_views(sql: str) -> str:
    """``sql`` with the views it names in front, as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if used and body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}" if used else body
