"""Quality rules: the rule table and its evaluation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import figures as G
from ..functions.constants import MIN_KBPS
from .settle import small

# Report columns and their types, in display order.
COLUMNS: dict[str, str] = {
    "title": "text", "kind": "text", "broken": "text", "dolby_vision": "bool", "hdr": "bool", "hdr_format": "text", "display_pixels": "number",
    "display_width": "number", "display_height": "number", "picture_pixels": "number", "letterbox_px": "number", "audio_channels_max": "number",
    "bit_depth": "number", "codec": "text", "kbps": "number", "weighted_kbps": "number", "bpp": "number", "res_class": "text", "kbps_floor": "number",
    "subtitle_forced_tracks": "number", "pedigree": "text", "runtime_min": "number", "gb": "number", "pal_speedup": "bool", "kept_audio": "bool",
    "extras": "text", "container_format": "text", "foreign_tracks": "text", "audio_default_count": "number", "subtitle_default_count": "number",
    "subtitle_forced_default_count": "number", "subtitle_named_forced": "number", "video_language": "text", "tag_structure": "text", "names": "text",
    "component_rules": "text", "segment_title": "text", "statistics_ratio": "number", "hdr_declaration_gap": "text", "dv_record_gap": "bool",
    "episodes_in_file": "text", "profile": "text", "mastering_display": "text", "content_light": "text", "display_aspect": "number",
    "stored_width": "number", "stored_height": "number", "sar": "number", "variable_aspect": "text", "audio_codecs": "text", "audio_tracks": "number",
    "pix_fmt": "text", "frame_rate": "number", "frame_count": "number", "colour_primaries": "text", "colour_transfer": "text", "colour_space": "text",
    "colour_tagged": "bool", "subtitle_codecs": "text", "subtitle_tracks": "number", "chapters": "number", "cover_art": "number", "path": "text",
}
# Units, and columns that carry no rule.
UNITS = {"letterbox_px": "px", "kbps": "kbps", "weighted_kbps": "kbps", "kbps_floor": "kbps", "runtime_min": "min", "gb": "GB"}
UNRULED = ("title", "kind", "broken", "path", "kbps_floor")


class Rule(NamedTuple):
    key: str
    label: str
    column: str
    method: str
    value_key: str | None = None
    kind: str | None = None
    klass: str | None = None
    repairable: bool = False
    gates: bool = True
    checks: tuple[str, ...] = ()
    ignored: bool = False
    generated: bool = False

    @property
    def gating(self) -> bool:
        """Only what neither repairs nor needs the library holds an arrival."""
        return self.gates and not self.repairable and not self.checks


# The explicit rules.
EXPLICIT = (
    Rule("movie_display_width", "Movie display width", "display_width", "at least", value_key="min_display_width", kind="movie"),
    Rule("movie_display_height", "Movie display height", "display_height", "at least", value_key="min_display_height", kind="movie"),
    Rule("episode_display_width", "Episode display width", "display_width", "at least", value_key="min_display_width", kind="tv"),
    Rule("episode_display_height", "Episode display height", "display_height", "at least", value_key="min_display_height", kind="tv"),
    Rule("movie_runtime", "Movie runtime", "runtime_min", "at least", value_key="min_runtime_min", kind="movie"),
    Rule("episode_runtime", "Episode runtime", "runtime_min", "at least", value_key="min_runtime_min", kind="tv"),
    Rule("letterbox_bars", "Letterbox bars", "letterbox_px", "at most", value_key="letterbox_bars_px"),
    Rule("pal_speedup", "PAL speed-up", "pal_speedup", "absent"),
    Rule("kept_audio", "Kept-language audio", "kept_audio", "present"),
    Rule("extras_name", "Extras name", "extras", "absent"),
    Rule("min_kbps_sd", "SD video bitrate", "weighted_kbps", "at least", value_key="min_kbps_sd", klass="SD"),
    Rule("min_kbps_720", "720p video bitrate", "weighted_kbps", "at least", value_key="min_kbps_720", klass="720"),
    Rule("min_kbps_1080", "1080p video bitrate", "weighted_kbps", "at least", value_key="min_kbps_1080", klass="1080"),
    Rule("min_kbps_2160", "2160p video bitrate", "weighted_kbps", "at least", value_key="min_kbps_2160", klass="2160"),
    Rule("max_size_gb", "File size", "gb", "at most", value_key="max_size_gb", ignored=True),
    Rule("episodes_in_file", "Episodes in file", "episodes_in_file", "absent", checks=("episodes in file",)),
    Rule("dv_record", "Dolby Vision record", "dv_record_gap", "absent", gates=False),
    Rule("container", "Container", "container_format", "passes", repairable=True, checks=("container",)),
    Rule("foreign_tracks", "Foreign language tracks", "foreign_tracks", "passes", repairable=True, checks=("foreign tracks",)),
    Rule("default_audio", "Default audio tracks", "audio_default_count", "passes", repairable=True, checks=("audio default count",)),
    Rule("default_subtitles", "Default non-forced subtitles", "subtitle_default_count", "passes", repairable=True, checks=("subtitle defaults",)),
    Rule("forced_default", "Default forced subtitles", "subtitle_forced_default_count", "passes", repairable=True, checks=("forced subtitle default",)),
    Rule("named_forced", "Subtitles named forced", "subtitle_named_forced", "passes", repairable=True, checks=("forced by name only",)),
    Rule("video_language", "Video track language", "video_language", "passes", repairable=True, checks=("video language",)),
    Rule("tag_structure", "Tag structure", "tag_structure", "passes", repairable=True, checks=("tag structure",)),
    Rule("names", "Folder and file names", "names", "passes", repairable=True, checks=("folder name", "file name", "show folder", "season folder")),
    Rule("component_rules", "Path component rules", "component_rules", "passes", repairable=True, checks=("component rules",)),
    Rule("segment_title", "Segment title", "segment_title", "passes", repairable=True, checks=("segment title",)),
    Rule("stats_ratio_min", "Statistics ratio floor", "statistics_ratio", "above", value_key="stats_ratio_min", repairable=True),
    Rule("stats_ratio_max", "Statistics ratio ceiling", "statistics_ratio", "at most", value_key="stats_ratio_max", repairable=True),
    Rule("hdr_declaration", "HDR declaration gap", "hdr_declaration_gap", "passes", repairable=True, checks=("mastering display", "content light level")),
)


def rule_list() -> list[Rule]:
    """The explicit rules, and one off by default for every column without one."""
    ruled = {r.column for r in EXPLICIT}
    generated = [
        Rule(f"col_{c}", c.replace("_", " ").capitalize(), c, "at least" if t == "number" else "is", f"std_{c}", ignored=True, generated=True)
        for c, t in COLUMNS.items()
        if c not in ruled and c not in UNRULED
    ]
    return [*EXPLICIT, *generated]


# Standards that a profile may replace.
DEFAULT_PROFILES: dict[str, dict[str, object]] = {
    kind: {
        "min_display_width": 1920 if kind == "movie" else 0, "min_display_height": 800 if kind == "movie" else 0,
        "min_runtime_min": 40 if kind == "movie" else 15, "letterbox_bars_px": 20, "max_size_gb": 10,
        "stats_ratio_min": 0.5, "stats_ratio_max": 1.5, **{f"min_kbps_{c.lower()}": v for c, v in MIN_KBPS.items()},
    }
    for kind in ("movie", "tv")
}

RULE_SCHEMA = (
    "key string, label string, column string, method string, value_key string, kind string, klass string, repairable boolean, gates boolean,"
    " checks array<string>, ignored boolean, generated boolean, type string, unit string"
)


def default_rules(spark: SparkSession) -> DataFrame:
    """P27 as a table; its size is fixed by the columns."""
    rows = [(r.key, r.label, r.column, r.method, r.value_key, r.kind, r.klass, r.repairable, r.gating, list(r.checks), r.ignored, r.generated, COLUMNS[r.column], UNITS.get(r.column)) for r in rule_list()]
    return spark.createDataFrame(rows, RULE_SCHEMA)


_BROKEN = T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "label", "column", "reason")] + [T.StructField("repairable", T.BooleanType())])


def _breaks(r: Rule, value: Column, standard: object) -> Column | None:
    """P23 for a rule and a standard that are known: the test of a value that breaks it, null for no value; None if none can."""
    kind = COLUMNS[r.column]
    truthy = value != "" if kind == "text" else value.cast("boolean")
    if r.method == "absent":
        return truthy
    if r.method == "present":
        return ~truthy
    text = "" if standard is None else str(standard).strip().lower()
    if kind == "bool":
        return value.cast("boolean") != F.lit(text in ("yes", "true", "1", "on"))
    if kind == "text":
        return F.lower(F.trim(value)) != text if r.method == "is" else None
    try:
        number = F.lit(float(text))
    except ValueError:
        return None
    figure = value.try_cast("double")
    return {"at least": figure < number, "at most": figure > number, "above": figure <= number, "exactly": figure != number, "is": figure != number}.get(r.method)


def _reason(r: Rule, value: Column, standard: object) -> Column:
    """P24 for a rule and a standard that are known."""
    kind, unit = COLUMNS[r.column], f" {UNITS[r.column]}" if r.column in UNITS else ""
    if r.method == "present":
        return F.lit(f"{r.label}: none")
    if r.method == "absent":
        return F.concat(F.lit(f"{r.label}: "), value.cast("string")) if kind == "text" else F.lit(f"{r.label}: present")
    shown = value.cast("string") if kind == "text" else F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.concat(F.lit(f"{r.label} "), shown, F.lit(f"{unit}, standard {r.method} {standard}{unit}"))


def _failed(checks: Column, names: tuple[str, ...]) -> Column:
    return F.filter(checks, lambda c: c["check"].isin(*names) & ~c["ok"])


def broken_rules(values: DataFrame, profiles: dict[str, dict] | None = None, checks: Column | None = None, gating_only: bool = False) -> Column:
    """The broken rules of a row of report columns, folded into one expression.

    Rules of a column that ``values`` lacks, and check rules without ``checks``
    (an array of structs with check, ok and actual), are skipped.
    """
    profiles = profiles or DEFAULT_PROFILES
    out = []
    for r in rule_list():
        if gating_only and not r.gating:
            continue
        kinds = [k for k in ("movie", "tv") if r.kind in (None, k) and not profiles[k].get(f"ignore_{r.key}", r.ignored)]
        if not kinds:
            continue
        scope = F.col("kind").isin(*kinds)
        if r.checks:
            if checks is None:
                continue
            failed = _failed(checks, r.checks)
            broken = F.size(failed) > 0
            reason = F.concat(F.lit(f"{r.label}: "), F.array_join(F.transform(failed, lambda c: c["actual"]), "; "))
        elif r.column in values.columns:
            value = F.col(r.column)
            standards = {k: profiles[k].get(r.value_key) for k in kinds} if r.value_key else dict.fromkeys(kinds)
            if r.klass:
                scope = scope & (F.col("res_class") == r.klass)
            # kinds with one standard share one test
            tests = []
            for standard in dict.fromkeys(standards.values()):
                if (test := _breaks(r, value, standard)) is not None:
                    mine = [k for k in kinds if standards[k] == standard]
                    tests.append((F.col("kind").isin(*mine) & test, standard))
            if not tests:
                continue
            broken, reason = F.lit(False), F.when(F.lit(False), F.lit(""))
            for test, standard in tests:
                broken = broken | F.coalesce(test, F.lit(False))
                reason = reason.when(test, _reason(r, value, standard))
        else:
            continue
        row = F.struct(F.lit(r.key).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.column).alias("column"), reason.alias("reason"), F.lit(r.repairable).alias("repairable"))
        out.append(F.when(F.coalesce(scope & broken, F.lit(False)), row))
    return F.array_compact(F.array(*out)).cast(T.ArrayType(_BROKEN))


def evaluate_rules(values: DataFrame, profiles: dict[str, dict] | None = None, checks: Column | None = None, gating_only: bool = False) -> DataFrame:
    """Adds broken, severity, flags and broken_labels."""
    df = values.withColumn("broken", broken_rules(values, profiles, checks, gating_only))
    return df.withColumns({"severity": G.severity(F.col("broken")), "flags": G.flagged(F.col("broken")), "broken_labels": F.array_join(F.transform("broken", lambda b: b["label"]), ", ")})


def screen(values: DataFrame, profiles: dict[str, dict] | None = None) -> DataFrame:
    """Problems and warnings of arrivals; only gating rules count."""
    df = values.withColumn("found", broken_rules(values, profiles, None, True))
    unknown = F.when(~F.col("kind").isin("movie", "tv"), F.array(F.concat(F.lit("unknown kind "), F.col("kind")))).otherwise(F.array().cast("array<string>"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("letterbox_px").isNull() & G.is_letterbox_candidate(F.col("display_aspect")), F.format_string("display aspect %.3f may hide bars", "display_aspect")),
            F.when(F.col("runtime_min").isNull(), "no usable duration, runtime not judged"),
        )
    )
    return df.withColumns({"problems": F.concat(unknown, F.transform("found", lambda b: b["reason"])), "warnings": warnings}).drop("found")


def broken_rules_long(values: DataFrame, rules: DataFrame, standards: DataFrame, columns: list[str]) -> DataFrame:
    """One row per broken value rule.

    ``values`` has path, kind, res_class and the numeric ``columns``;
    ``standards`` has kind, value_key and standard. Rules and standards are
    counted before they are broadcast.
    """
    long = values.select("path", "kind", F.col("res_class").alias("own_class"), *[F.col(c).cast("double").alias(c) for c in columns])
    long = long.unpivot(["path", "kind", "own_class"], columns, "column", "value").where("value is not null")
    # every rule with the kinds it covers
    scoped = rules.withColumn("on_kind", F.explode(F.when(F.col("kind").isNull(), F.array(F.lit("movie"), F.lit("tv"))).otherwise(F.array("kind")))).drop("kind")
    scoped = scoped.where(~F.col("ignored") & (F.size("checks") == 0))
    scoped = scoped.join(small(standards.select(F.col("kind").alias("on_kind"), "value_key", "standard")), ["on_kind", "value_key"], "left")
    scoped = small(scoped)
    hit = long.join(scoped, (long["column"] == scoped["column"]) & (long["kind"] == scoped["on_kind"]) & (scoped["klass"].isNull() | (scoped["klass"] == long["own_class"])))
    passes = G.rule_passes(F.col("method"), F.col("value").cast("string"), F.col("standard").cast("string"), F.col("type"))
    return hit.where(~passes).select("path", F.col("key").alias("rule"), scoped["column"], "value", "standard", "repairable")


def broken_summary(broken: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels joined in order, and whether any rule repairs, per path."""
    named = broken.join(small(labels.select(F.col("key").alias("rule"), "label")), "rule")
    out = named.groupBy("path").agg(F.array_sort(F.collect_set("label")).alias("l"), F.max("repairable").alias("repair"), F.count("*").alias("n"))
    return out.select("path", F.array_join("l", ", ").alias("labels"), F.when(F.col("repair"), "repair").otherwise("below").alias("severity"), "n")


def describe_rules(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each rule with its current standard and whether it is ignored.

    ``profiles`` has kind, key and value; rules of both kinds read the movie profile.
    """
    kind = F.coalesce(F.col("kind"), F.lit("movie"))
    p = small(profiles.select(F.col("kind").alias("p_kind"), F.col("key").alias("p_key"), "value"))
    i = small(profiles.select(F.col("kind").alias("i_kind"), F.col("key").alias("i_key"), F.col("value").alias("ignore_value")))
    out = rules.join(p, (kind == F.col("p_kind")) & (F.col("value_key") == F.col("p_key")), "left")
    out = out.join(i, (kind == F.col("i_kind")) & (F.concat(F.lit("ignore_"), "key") == F.col("i_key")), "left")
    ignored = F.coalesce(F.lower("ignore_value").isin("true", "1", "yes"), F.col("ignored"))
    return out.select("key", "label", "column", "method", F.col("value").alias("standard"), ignored.alias("ignored"), "gates", "repairable", "generated")
