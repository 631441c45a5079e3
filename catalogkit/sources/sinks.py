"""Sinks S11 to S13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TARGET_LEVELS


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Report rows; nested columns become JSON where the format is flat."""
    if fmt == "csv":
        nested = [c for c, t in report.dtypes if t.startswith(("array", "struct", "map"))]
        report = report.withColumns({c: F.to_json(c) for c in nested})
    report.write.mode("overwrite").format(fmt).option("header", True).save(path)


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(target: str, pairs: list[tuple[str, Column]], more: Column | None = None) -> Column:
    head = f"  <Tag>\n    <Targets>\n      <TargetTypeValue>{TARGET_LEVELS[target]}</TargetTypeValue>\n      <TargetType>{target}</TargetType>\n    </Targets>"
    line = lambda n, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit("    <Simple><Name>"), n, F.lit("</Name><String>"), _escaped(v), F.lit("</String></Simple>")))
    lines = F.array_compact(F.array(*[line(F.lit(k), v.cast("string")) for k, v in pairs]))
    if more is not None:
        carried = F.transform(F.array_sort(F.map_entries(more)), lambda e: line(_escaped(e["key"]), e["value"]))
        lines = F.concat(lines, F.array_compact(F.coalesce(carried, F.array().cast("array<string>"))))
    return F.array_join(F.concat(F.array(F.lit(head)), lines, F.array(F.lit("  </Tag>"))), "\n")


def tag_xml(df: DataFrame) -> Column:
    """The tag document of a row (kind, title, tmdb, imdb, released, show, tvdb, season, episode, carried).

    A movie has one level, an episode three; null and empty values are left
    out, carried keys are sorted.
    """
    c = F.col
    carried = c("carried") if "carried" in df.columns else None
    movie = _tag("MOVIE", [("TITLE", c("title")), ("TMDB", c("tmdb")), ("IMDB", c("imdb")), ("DATE_RELEASED", c("released"))], carried)
    tv = F.concat_ws(
        "\n", _tag("COLLECTION", [("TITLE", c("show")), ("TVDB", c("tvdb")), ("TMDB", c("tmdb"))]), _tag("SEASON", [("PART_NUMBER", c("season"))]),
        _tag("EPISODE", [("TITLE", c("title")), ("PART_NUMBER", c("episode"))], carried),
    )
    body = F.when(c("kind") == "movie", movie).otherwise(tv)
    return F.concat(F.lit('<?xml version="1.0"?>\n<Tags>\n'), body, F.lit("\n</Tags>\n"))
