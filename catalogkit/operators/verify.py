"""Readiness and verification of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions.constants import DROPPED_KEYS, MOVIE_KEYS, STATISTICS_PREFIXES


def slash_names(tags: DataFrame) -> DataFrame:
    """Tag names that hold a slash."""
    return tags.where(F.contains("name", F.lit("/"))).select("path", "name").distinct()


def missing_targets(tags: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """U4: per file the wanted targets that no tag has."""
    present = tags.groupBy("path").agg(F.collect_set(F.when(F.col("target_type") != "", F.col("target_type"))).alias("present"))
    return present.select("path", F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), F.col("present"))).alias("missing"))


def carry_forward(tags: DataFrame) -> DataFrame:
    """Untargeted keys that a rewrite keeps; the last value of a name counts."""
    upper = F.upper("name")
    statistics = F.lit(False)
    for p in STATISTICS_PREFIXES:
        statistics = statistics | upper.startswith(p)
    rows = tags.where((F.coalesce("target_type", F.lit("")) == "") & ~F.col("track_targeted"))
    rows = rows.where((upper != "") & ~upper.contains("/") & ~upper.isin(*MOVIE_KEYS, *DROPPED_KEYS) & ~statistics)
    return rows.groupBy("path", "name").agg(F.max_by("value", "tag_no").alias("value"))


def _value(target: str, name: str) -> Column:
    return F.max(F.when((F.col("target_type") == target) & (F.col("name") == name), F.col("value")))


def _slashed() -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("name").contains("/"), F.concat(F.lit("flattened tag: "), "name"))))


def tag_problems_movie(tags: DataFrame, expected: DataFrame, required: tuple[str, ...] = MOVIE_KEYS) -> DataFrame:
    """Problems of movie tag blocks; ``expected`` has path and title, also of files without tags."""
    found = tags.groupBy("path").agg(F.bool_or(F.col("target_type") == "MOVIE").alias("has_movie"), _slashed().alias("slashed"), *[_value("MOVIE", k).alias(f"tag_{k}") for k in dict.fromkeys((*required, "TITLE"))])
    out = expected.join(found, "path", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    keys = [F.when(F.col("has_movie") & blank(f"tag_{k}"), f"MOVIE tag lacks {k}") for k in required]
    title = F.when(F.col("has_movie") & ~blank("tag_TITLE") & (F.col("tag_TITLE") != F.col("title")), "MOVIE title differs")
    problems = F.concat(F.coalesce("slashed", F.array().cast("array<string>")), F.array_compact(F.array(F.when(~F.col("has_movie"), "no MOVIE tag"), *keys, title)))
    return out.select("path", F.when(F.col("has_movie").isNull(), F.array(F.lit("no tags at all"))).otherwise(problems).alias("problems"))


def tag_problems_tv(tags: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems of episode tag blocks; ``expected`` has path, show and episode_title."""
    found = tags.groupBy("path").agg(
        F.collect_set(F.when(F.col("target_type") != "", F.col("target_type"))).alias("present"), _slashed().alias("slashed"),
        _value("COLLECTION", "TITLE").alias("tag_show"), _value("EPISODE", "TITLE").alias("tag_title"),
    )
    out = expected.join(found, "path", "left")
    missing = F.transform(F.array_except(F.array(*map(F.lit, ("COLLECTION", "SEASON", "EPISODE"))), F.col("present")), lambda t: F.concat(F.lit("no "), t, F.lit(" tag")))
    differs = lambda a, b, why: F.when((F.coalesce(F.col(a), F.lit("")) != "") & (F.col(a) != F.col(b)), why)
    problems = F.concat("slashed", missing, F.array_compact(F.array(differs("tag_show", "show", "COLLECTION title differs"), differs("tag_title", "episode_title", "EPISODE title differs"))))
    return out.select("path", F.when(F.col("present").isNull(), F.array(F.lit("no tags at all"))).otherwise(problems).alias("problems"))


def hdr_loss(pairs: DataFrame) -> DataFrame:
    """HDR that the output lost; pairs have src and out structs (colour tags, hdr, mastering_display, content_light, dolby_vision, their bitstream forms)."""
    s, o = F.col("src"), F.col("out")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    colours = [F.when((low(s[t]) != "") & (low(s[t]) != low(o[t])), F.concat(F.lit(f"{t} was "), low(s[t]), F.lit(", is "), F.when(low(o[t]) == "", "unset").otherwise(low(o[t])))) for t in ("color_primaries", "color_transfer", "color_space")]
    lost = [F.when((s[k].isNotNull() | s[b].isNotNull()) & o[k].isNull(), f"{k} is not declared") for k, b in (("mastering_display", "mastering_bitstream"), ("content_light", "content_light_bitstream"))]
    lost.append(F.when((s["dolby_vision"] | s["dv_in_bitstream"]) & ~o["dolby_vision"], "dolby_vision is not declared"))
    short = F.when(F.size(o["hdr_declaration_gap"]) > 0, F.concat(F.lit("declared short of the bitstream: "), F.array_join(o["hdr_declaration_gap"], ", ")))
    problems = F.array_compact(F.array(short, *colours, *lost))
    return pairs.withColumn("problems", F.when(s["hdr"] | o["hdr"], problems).otherwise(F.array().cast("array<string>")))


def segment_title_problem(actual: Column, expected: Column) -> Column:
    """P46."""
    return F.when(~actual.eqNullSafe(expected), F.concat(F.lit("segment title is "), F.coalesce(actual, F.lit("unset")), F.lit(", not "), F.coalesce(expected, F.lit("unset"))))


def readiness(files: DataFrame, *problems: DataFrame) -> DataFrame:
    """All problems of an output and whether there are none.

    ``files``: path, segment_title, expected_title, statistics_ratio; each other
    table has path and problems.
    """
    none = F.array().cast("array<string>")
    low = F.when(F.col("statistics_ratio") <= 0.5, F.format_string("statistics missing or stale, ratio %.4f", "statistics_ratio"))
    out = files.withColumn("all", F.array_compact(F.array(segment_title_problem(F.col("segment_title"), F.col("expected_title")), low)))
    for p in problems:
        out = out.join(p.select("path", F.col("problems").alias("more")), "path", "left").withColumn("all", F.concat("all", F.coalesce("more", none))).drop("more")
    return out.select("path", F.col("all").alias("problems"), (F.size("all") == 0).alias("ok"))


def pair_outputs(source: DataFrame, output: DataFrame, key: str = "title_id") -> DataFrame:
    """Source (src_*) and output (out_*) figures of each title."""
    s = source.select(key, *[F.col(c).alias(f"src_{c}") for c in source.columns if c != key])
    return s.join(output.select(key, *[F.col(c).alias(f"out_{c}") for c in output.columns if c != key]), key)


def verify(pairs: DataFrame, drift_s: float = 2.0) -> DataFrame:
    """Problems and notes of outputs; pairs have src_ and out_ packets and duration_s, telecine and statistics_ratio."""
    want = F.col("src_packets")
    film = F.floor(want * 4 / 5)
    off = F.abs(G.known(F.col("src_duration_s")) - G.known(F.col("out_duration_s"))) > drift_s
    count = F.when(F.col("telecine"), F.abs(F.col("out_packets") - film) > film * 0.01).otherwise(F.col("out_packets") != want)
    problems = F.array_compact(
        F.array(
            F.when(off, F.format_string("runs %.1f s, the source %.1f s", "out_duration_s", "src_duration_s")),
            F.when(count, F.format_string("%d packets, %d expected", F.col("out_packets"), F.when(F.col("telecine"), film).otherwise(want))),
            F.when(F.col("statistics_ratio") <= 0.5, "statistics missing or stale"),
        )
    )
    notes = F.array_compact(F.array(F.when(F.col("telecine"), "telecine removed, four of five frames kept"), F.when(off.isNull(), "a duration is unknown")))
    return pairs.withColumns({"problems": problems, "notes": notes, "ok": F.size(problems) == 0})


def remux_check(pairs: DataFrame, drift_s: float = 2.0) -> DataFrame:
    """Chapters kept (mp4), packets kept (avi); a drift of duration is only noted."""
    problems = F.array_compact(
        F.array(
            F.when((F.col("format") == "mp4") & (F.col("src_chapters") != F.col("out_chapters")), "chapters lost"),
            F.when((F.col("format") == "avi") & (F.col("src_packets") != F.col("out_packets")), "packets lost"),
        )
    )
    note = F.when(F.abs(F.col("src_duration_s") - F.col("out_duration_s")) > drift_s, "duration drifts")
    return pairs.withColumns({"problems": problems, "notes": F.array_compact(F.array(note))})
