"""The register of queries, and pieces of SQL that several of them share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            # these column names are words of the other engine's grammar
            ORACLES[name] = with_views(re.sub(r"(?<![\w\".'])(show|at)\b(?! least| most)", r'"\1"', sql))
        return f

    return add


def oracle(name: str, sql: str) -> None:
    """Adds SQL to a query that is registered elsewhere."""
    query(name, sql)(QUERIES[name])


# Pieces of SQL that several queries share.
EFFICIENCY = "CASE lower(codec) WHEN 'h264' THEN 1.0 WHEN 'avc' THEN 1.0 WHEN 'hevc' THEN 1.7 WHEN 'h265' THEN 1.7 WHEN 'av1' THEN 2.2 WHEN 'vc1' THEN 0.9 WHEN 'mpeg4' THEN 0.7 WHEN 'msmpeg4v3' THEN 0.7 WHEN 'mpeg2video' THEN 0.45 ELSE 1.0 END"
WEIGHTED = f"CAST(NULLIF(bitrate, 0) AS DOUBLE) * CAST({EFFICIENCY} AS DOUBLE)"
CLASS = "CASE WHEN width * sar >= 3200 OR height >= 1800 THEN '2160' WHEN width * sar >= 1600 OR height >= 900 THEN '1080' WHEN width * sar >= 1100 OR height >= 700 THEN '720' ELSE 'SD' END"
KEPT = "lower(coalesce(language, 'und')) IN ('eng', 'en', 'und')"
NAMED = r"coalesce(regexp_matches(lower(name), '(^|[^a-z0-9])forced([^a-z0-9]|$)') AND NOT regexp_matches(lower(name), '(^|[^a-z0-9])(non|not|no|un)[\s_.-]*forced'), false)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_file")
