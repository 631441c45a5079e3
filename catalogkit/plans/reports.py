"""Registered queries of rules, audit rows, comparison and verification, and SQL for those registered elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import names as N
from ..operators import audit, compare, rules, standards, verify
from .adapters import view
from .base import CLASS, KEPT, NAMED, WEIGHTED, files, oracle, query
from .queries import _REPORT, _VOTES, _pair_attrs

C, L = F.col, F.lit


def _none() -> F.Column:
    return F.lit(None).cast("string")

def _values(spark, d) -> DataFrame:
    return standards.report_values(standards.attributes(files(spark, d), view(spark, d, "v_track")))


# Rules

_LABELS = "(VALUES ('movie_display_width', 'Movie display width', 'display_width'), ('movie_display_height', 'Movie display height', 'display_height'), ('movie_runtime', 'Movie runtime', 'runtime_min'), ('episode_runtime', 'Episode runtime', 'runtime_min'), ('letterbox_bars', 'Letterbox bars', 'letterbox_px'), ('pal_speedup', 'PAL speed-up', 'pal_speedup'), ('kept_audio', 'Kept-language audio', 'kept_audio'), ('min_kbps_sd', 'SD video bitrate', 'weighted_kbps'), ('min_kbps_720', '720p video bitrate', 'weighted_kbps'), ('min_kbps_1080', '1080p video bitrate', 'weighted_kbps'), ('min_kbps_2160', '2160p video bitrate', 'weighted_kbps')) t(rule, label, col)"
oracle("p26_flags", _REPORT + f"SELECT DISTINCT file_id, col AS \"column\", 'below' AS mark FROM b JOIN {_LABELS} ON t.rule = b.rule")
oracle("a18_broken_summary", _REPORT + f"SELECT CAST(file_id AS VARCHAR) AS path, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels, 'below' AS severity, count(*) AS n FROM b JOIN {_LABELS} ON t.rule = b.rule WHERE b.rule NOT IN ('pal_speedup', 'kept_audio', 'letterbox_bars') GROUP BY file_id")
_REASONS = f"""{_REPORT.rstrip()},
w AS (SELECT b.file_id, b.rule, t.label || CASE b.rule WHEN 'pal_speedup' THEN ': present' WHEN 'kept_audio' THEN ': none' ELSE ' ' || regexp_replace(CASE t.col WHEN 'display_width' THEN CAST(dw AS VARCHAR) WHEN 'display_height' THEN CAST(dh AS VARCHAR) WHEN 'runtime_min' THEN CAST(rt AS VARCHAR) WHEN 'letterbox_px' THEN CAST(bars_px AS VARCHAR) ELSE CAST(wk AS VARCHAR) END, '\\.0$', '') || u || ', standard ' || m || ' ' || s || u END AS reason
  FROM b JOIN v ON v.file_id = b.file_id JOIN {_LABELS} ON t.rule = b.rule LEFT JOIN (VALUES ('movie_display_width', 'at least', '1920', ''), ('movie_display_height', 'at least', '800', ''), ('movie_runtime', 'at least', '40', ' min'), ('episode_runtime', 'at least', '15', ' min'), ('letterbox_bars', 'at most', '20', ' px'), ('min_kbps_sd', 'at least', '1000', ' kbps'), ('min_kbps_720', 'at least', '2000', ' kbps'), ('min_kbps_1080', 'at least', '4000', ' kbps'), ('min_kbps_2160', 'at least', '8000', ' kbps')) k(rule, m, s, u) ON k.rule = b.rule)
"""


@query("p24_reasons", _REASONS + "SELECT file_id, rule, reason FROM w")
def p24(spark, d):
    r = standards.quality_report(files(spark, d), view(spark, d, "v_track"))
    return r.select("file_id", F.inline("broken")).select("file_id", "rule", "reason")


oracle(
    "p21_screen",
    _REASONS + """, a AS (SELECT file_id, bars_px, duration_s, round(round_even(width * sar, 0) / height, 3) AS aspect FROM v_file),
o AS (SELECT w.*, list_position(['movie_display_width', 'movie_display_height', 'movie_runtime', 'episode_runtime', 'letterbox_bars', 'pal_speedup', 'kept_audio', 'min_kbps_sd', 'min_kbps_720', 'min_kbps_1080', 'min_kbps_2160'], rule) AS n FROM w)
SELECT a.file_id, CAST((SELECT count(*) FROM o WHERE o.file_id = a.file_id) AS INT) AS n_problems, coalesce((SELECT string_agg(reason, '; ' ORDER BY n) FROM o WHERE o.file_id = a.file_id), '') AS problems,
  concat_ws('; ', CASE WHEN bars_px IS NULL AND (abs(aspect - 16.0/9) < 0.02 OR abs(aspect - 4.0/3) < 0.02) THEN 'display aspect ' || printf('%.3f', aspect) || ' may hide bars' END, CASE WHEN duration_s IS NULL THEN 'no usable duration, runtime not judged' END) AS warnings FROM a""",
)


@query(
    "p23_rule_passes",
    """SELECT file_id, CASE file_id % 7 WHEN 0 THEN height >= 1000 WHEN 1 THEN height <= 1000 WHEN 2 THEN height > 1000 WHEN 3 THEN height = 1080 WHEN 4 THEN NOT hdr WHEN 5 THEN hdr ELSE codec = 'h264' END AS passes FROM v_file""",
)
def p23(spark, d):
    k = C("file_id") % 7
    method = F.element_at(F.array(*map(L, ("at least", "at most", "above", "exactly", "absent", "present", "is"))), (k + 1).cast("int"))
    value = F.when(k < 4, C("height").cast("string")).when(k < 6, C("hdr").cast("string")).otherwise(F.upper("codec"))
    standard = F.when(k < 3, "1000").when(k == 3, "1080").when(k == 6, " H264 ")
    kind = F.when(k < 4, "number").when(k < 6, "bool").otherwise("text")
    return files(spark, d).select("file_id", G.rule_passes(method, value, standard, kind).alias("passes"))


@query("p25_severity", _REPORT + "SELECT v.file_id, CASE WHEN v.file_id % 4 = 0 THEN 'repair' WHEN EXISTS (SELECT 1 FROM b WHERE b.file_id = v.file_id) THEN 'below' END AS severity, CAST((SELECT count(*) FROM b WHERE b.file_id = v.file_id) + (v.file_id % 4 = 0)::INT AS BIGINT) AS n FROM v")
def p25(spark, d):
    values = _values(spark, d)
    checks = F.array(F.struct(L("container").alias("check"), (C("file_id") % 4 != 0).alias("ok"), L("avi").alias("actual")))
    return rules.evaluate_rules(values, checks=checks).select("file_id", "severity", F.size("broken").cast("long").alias("n"))


@query(
    "p27_p40_describe_rules",
    """WITH m AS (SELECT kind, max(width) AS w FROM v_file GROUP BY kind)
SELECT t.key, t.label, CAST(w AS VARCHAR) AS standard, false AS ignored, true AS gates FROM m JOIN (VALUES ('movie', 'movie_display_width', 'Movie display width'), ('tv', 'episode_display_width', 'Episode display width')) t(kind, key, label) ON t.kind = m.kind
UNION ALL SELECT 'movie_runtime', 'Movie runtime', NULL, true, true UNION ALL SELECT 'max_size_gb', 'File size', NULL, true, true""",
)
def p40(spark, d):
    widest = files(spark, d).groupBy("kind").agg(F.max("width").cast("string").alias("value"))
    profiles = widest.select("kind", L("min_display_width").alias("key"), "value").unionByName(widest.where("kind = 'movie'").select("kind", L("ignore_movie_runtime").alias("key"), L("true").alias("value")))
    out = rules.describe_rules(rules.default_rules(spark), profiles)
    return out.where(C("key").isin("movie_display_width", "episode_display_width", "movie_runtime", "max_size_gb")).select("key", "label", "standard", "ignored", "gates")


# Audit rows

oracle(
    "p28_track_checks",
    f"""WITH c AS (SELECT file_id, count(*) FILTER (WHERE type = 'audio' AND is_default) AS ad, count(*) FILTER (WHERE type = 'subtitles' AND is_default AND NOT forced) AS sd, count(*) FILTER (WHERE type = 'subtitles' AND forced AND is_default AND {KEPT}) AS fd,
  count(*) FILTER (WHERE type = 'subtitles' AND (forced OR {NAMED}) AND {KEPT}) AS ft, count(*) FILTER (WHERE type = 'subtitles' AND NOT forced AND {NAMED}) AS nf, count(*) FILTER (WHERE type IN ('audio', 'subtitles') AND NOT {KEPT}) AS fo, arg_min(coalesce(language, 'und'), track_no) FILTER (WHERE type = 'video') AS vl FROM v_track GROUP BY file_id),
l AS (SELECT f.file_id, list_filter([CASE WHEN f.file_id % 3 = 0 THEN 'container' END, CASE WHEN coalesce(fo, 0) > 0 THEN 'foreign tracks' END, CASE WHEN coalesce(ad, 0) <> 1 THEN 'audio default count' END, CASE WHEN coalesce(sd, 0) > 0 THEN 'subtitle defaults' END,
  CASE WHEN coalesce(fd, 0) <> CASE WHEN coalesce(ft, 0) > 0 THEN 1 ELSE 0 END THEN 'forced subtitle default' END, CASE WHEN coalesce(nf, 0) > 0 THEN 'forced by name only' END, CASE WHEN coalesce(vl, 'und') <> 'eng' THEN 'video language' END], lambda x: x IS NOT NULL) AS bad FROM v_file f LEFT JOIN c ON c.file_id = f.file_id)
SELECT file_id, CASE WHEN len(bad) = 0 THEN 'meets the standard' ELSE array_to_string(bad, ', ') END AS summary, CAST(len(bad) AS INT) AS n_failed FROM l""",
)
oracle(
    "p30_movie_naming",
    """WITH r AS (SELECT file_id, unnest([{'c': 'folder name', 'e': title || ' (' || year || ') [tmdbid-' || tmdb || ']', 'a': title || ' (' || year || ')'}, {'c': 'file name', 'e': title || ' (' || year || ').mkv', 'a': title || '.mkv'}]) AS s FROM v_file)
SELECT file_id, s.c AS "check", s.e AS expected, s.a AS actual, s.e = s.a AS ok FROM r""",
)
oracle(
    "p31_tv_naming",
    """WITH n AS (SELECT *, show || ' - S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || ' - ' || title || '.mkv' AS f FROM v_file),
r AS (SELECT file_id, unnest([{'c': 'show folder', 'e': show || ' (YYYY) [tvdbid-9] [tmdbid-' || tmdb || ']', 'a': show}, {'c': 'season folder', 'e': 'Season 0' || season, 'a': 'Season 0' || season}, {'c': 'file name', 'e': f, 'a': f}]) AS s FROM n)
SELECT file_id, s.c AS "check", s.e AS expected, s.a AS actual, s.e = s.a AS ok FROM r""",
)


@query("p29_tag_structure", "SELECT file_id, CASE WHEN kind = 'movie' THEN CASE WHEN file_id % 2 = 0 THEN 'MOVIE' ELSE 'none' END ELSE CASE WHEN file_id % 2 = 0 THEN 'COLLECTION, EPISODE, SEASON' ELSE 'EPISODE' END END || CASE WHEN file_id % 5 = 0 THEN ', flattened' ELSE '' END AS actual, file_id % 2 = 0 AND file_id % 5 <> 0 AS ok FROM v_file")
def p29(spark, d):
    i = C("file_id")
    even = F.when(C("kind") == "movie", F.array(L("MOVIE"), L("TRACK"))).otherwise(F.array(L("EPISODE"), L("SEASON"), L("COLLECTION")))
    present = F.when(i % 2 == 0, even).otherwise(F.array(L("EPISODE")))
    slashed = F.when(i % 5 == 0, F.array(L("a/b"))).otherwise(F.array().cast("array<string>"))
    return files(spark, d).select("file_id", audit.tag_structure_check(present, slashed, C("kind")).alias("c")).select("file_id", "c.actual", "c.ok")


@query("p34_segment_and_statistics", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'unset' WHEN file_id % 3 = 1 THEN 'x' ELSE title END AS segment, file_id % 3 = 2 AS segment_ok, CASE WHEN file_id % 4 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE > 0.5 AS statistics_ok FROM v_file")
def p34(spark, d):
    i = C("file_id")
    segment = audit.segment_title_check(C("title"), F.when(i % 3 == 1, "x").when(i % 3 == 2, C("title")))
    statistics = audit.statistics_check(F.when(i % 4 == 0, 0.25).otherwise(0.75))
    return files(spark, d).select("file_id", segment["actual"].alias("segment"), segment["ok"].alias("segment_ok"), statistics["ok"].alias("statistics_ok"))


def _checks(*pairs) -> F.Column:
    return F.array(*[audit.check_row(name, L("e"), L("a"), ok, "fix") for name, ok in pairs])


@query("p35_check_summary", "SELECT file_id, CASE WHEN file_id % 2 <> 0 AND file_id % 3 <> 0 THEN 'meets the standard' ELSE concat_ws(', ', CASE WHEN file_id % 2 = 0 THEN 'container' END, CASE WHEN file_id % 3 = 0 THEN 'names' END) END AS summary FROM v_file")
def p35(spark, d):
    i = C("file_id")
    return files(spark, d).select("file_id", audit.check_summary(_checks(("container", i % 2 != 0), ("names", i % 3 != 0))).alias("summary"))


@query("u9_replace_check", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'b,a' ELSE 'b' END AS names, file_id % 2 = 0 AS replaced FROM v_file")
def u9(spark, d):
    i = C("file_id")
    new = audit.check_row("a", F.when(i % 2 == 0, "new"), L("x"), L(True), "fix")
    out = audit.replace_check(_checks(("a", i % 2 != 0), ("b", i % 3 != 0)), new)
    rows = files(spark, d).select("file_id", out.alias("checks"))
    return rows.select("file_id", F.array_join(F.transform("checks", lambda c: c["check"]), ",").alias("names"), F.exists("checks", lambda c: c["expected"] == "new").alias("replaced"))


@query("p37_two_episode_rows", "SELECT file_id, 'Show - S0' || season || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || '-E' || lpad(CAST(episode + 1 AS VARCHAR), 2, '0') || ' - ' || title || '.mkv' AS proposed, printf('%.1f min, median of the others %.1f min (%.2fx), S%02dE%02d has no file', CAST(file_id AS DOUBLE), 10.0, file_id / 10.0, season, episode + 1) AS detail FROM v_file")
def p37(spark, d):
    rows = files(spark, d).select(
        "file_id", F.concat("title", L(".mkv")).alias("name"), L("Show").alias("show"), F.concat("title", L(" (1)")).alias("title"), "season", C("episode").alias("first"), (C("file_id") * 60.0).alias("duration_s"), L(600.0).alias("others_median")
    )
    return audit.two_episode_rows(rows).select("file_id", C("row.expected").alias("proposed"), "detail")


@query("p38_report_rows", "SELECT path, CASE WHEN k % 2 = 0 THEN 'Tag ' || k ELSE regexp_replace(split_part(path, '/', 3), '\\.mkv$', '') END AS title, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'differ' ELSE 'match' END AS names, CASE WHEN k % 5 <> 0 AND k % 4 = 0 THEN 'a' END AS component_rules, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'broken' ELSE 'not measured yet' END END AS reason FROM (SELECT path, CAST(regexp_extract(path, '(\\d+)\\.mkv$', 1) AS BIGINT) AS k FROM v_finding)")
def p38(spark, d):
    k = F.regexp_extract("path", r"(\d+)\.mkv$", 1).cast("long")
    checks = F.when(k % 5 != 0, _checks(("file name", k % 3 != 0), ("component rules", k % 4 != 0)))
    rows = view(spark, d, "v_finding").select("path", F.when(k % 2 == 0, F.concat(L("Tag "), k.cast("string"))).otherwise("").alias("tag_title"), checks.alias("checks"), F.when(k % 2 == 0, "broken").alias("unreadable"))
    return audit.report_rows(rows).select("path", "title", "names", "component_rules", "reason")


@query("p39_import_state", "SELECT f.path, CASE WHEN t.stage IS NOT NULL THEN lower(t.stage) WHEN f.k % 2 = 0 THEN 'awaiting detection' END AS import_state FROM (SELECT path, CAST(regexp_extract(path, '(\\d+)\\.mkv$', 1) AS BIGINT) AS k FROM v_finding) f LEFT JOIN v_title t ON t.id = f.k AND t.stage <> 'QUARANTINED'")
def p39(spark, d):
    k = F.regexp_extract("path", r"(\d+)\.mkv$", 1).cast("long")
    rows = view(spark, d, "v_finding").select("path", k.alias("imported_title_id"), F.concat(L("in/"), k.cast("string")).alias("import_path"))
    staged = rows.where("imported_title_id % 2 = 0").select(C("import_path").alias("path"))
    return audit.import_state(rows, view(spark, d, "v_title"), staged)


oracle("o6_sort_report", "SELECT CAST(file_id AS VARCHAR) AS path, title, CAST(round_even(NULLIF(bitrate, 0) / 1000.0, 0) AS DOUBLE) AS kbps FROM v_file")


# Comparison

oracle(
    "p73_crop_pair",
    """WITH a AS (SELECT file_id, CAST(floor(file_id / 2) AS BIGINT) AS entity, round(round_even(width * sar, 0) / height, 3) AS asp, round_even(width * sar, 0) * height AS px, bars_px, width * (height - bars_px) AS pic FROM v_file),
p AS (SELECT n.file_id AS nid, o.file_id AS oid, (abs(n.asp - 16.0/9) < 0.02 OR abs(n.asp - 4.0/3) < 0.02 OR abs(o.asp - 16.0/9) < 0.02 OR abs(o.asp - 4.0/3) < 0.02) AS w, n.bars_px AS nb, o.bars_px AS ob, n.pic AS np, o.pic AS op, n.px AS npx, o.px AS opx FROM a n JOIN a o ON n.entity = o.entity AND n.file_id > o.file_id)
SELECT nid AS new_file_id, oid AS old_file_id, w AS crop_wanted, CAST(CASE WHEN w THEN coalesce(nb, 0) END AS BIGINT) AS new_letterbox_px, CAST(CASE WHEN w THEN coalesce(ob, 0) END AS BIGINT) AS old_letterbox_px, CAST(CASE WHEN w THEN coalesce(np, npx) END AS BIGINT) AS new_picture_pixels, CAST(CASE WHEN w THEN coalesce(op, opx) END AS BIGINT) AS old_picture_pixels FROM p""",
)


@query("j1_j25_pairs", "SELECT n.file_id AS new_id, o.file_id AS old_id FROM v_file n JOIN v_file o ON floor(n.file_id / 4) = floor(o.file_id / 4) WHERE n.file_id % 3 = 0 OR o.file_id <> n.file_id")
def j1(spark, d):
    """Every file against those of its group; two in three arrived from the file they would meet."""
    i = C("file_id")
    f = files(spark, d).select("file_id", i.cast("string").alias("path"), F.floor(i / 4).alias("entity"), F.when(i % 3 != 0, i.cast("string")).alias("origin_path"))
    return compare.pair_up(f, f.drop("origin_path"), ["entity"]).select(C("new_file_id").alias("new_id"), C("old_file_id").alias("old_id"))


@query("j29_compare_siblings", _VOTES + "SELECT new_id AS id, old_id AS sibling_id, CASE WHEN w AND l THEN 'ambiguous' WHEN w THEN 'win' WHEN l THEN 'loss' ELSE 'ambiguous' END AS verdict FROM r")
def j29(spark, d):
    a = _pair_attrs(spark, d).drop("path")
    pairs = a.select(C("file_id").alias("id"), (C("file_id") - 1).alias("sibling_id")).where("id % 2 = 1")
    return compare.compare_siblings(pairs, a).select("id", "sibling_id", "verdict")


@query("p68_ambiguous_detail", "SELECT a.file_id, 'why' || CASE WHEN a.title <> b.title THEN '; titled ''' || b.title || ''' against ''' || a.title || '''' ELSE '' END AS detail FROM v_file a JOIN v_file b ON b.file_id = a.file_id + 1")
def p68(spark, d):
    f = files(spark, d)
    nxt = f.select((C("file_id") - 1).alias("file_id"), C("title").alias("other"))
    return f.join(nxt, "file_id").select("file_id", compare.ambiguous_detail(L("why"), C("title"), C("other")).alias("detail"))


# Tags and readiness

def _blocks(spark, d) -> DataFrame:
    """Tag rows of every file: levels, names and values that vary with its number."""
    i = C("file_id")
    one = lambda when, target, name, value: F.when(when, F.struct(L(target).alias("target_type"), name.alias("name"), value.alias("value")))
    every = L(True)
    rows = F.array_compact(
        F.array(
            one(i % 3 != 0, "COLLECTION", L("TITLE"), F.when(i % 4 == 0, "Other").otherwise(C("show"))), one(i % 5 != 0, "SEASON", L("PART_NUMBER"), C("season").cast("string")),
            one(every, "EPISODE", L("TITLE"), F.when(i % 7 == 0, "").otherwise(C("title"))), one(i % 2 == 0, "", L("a/b"), L("x")), one(every, "", F.concat(L("NOTE"), (i % 3).cast("string")), C("codec")), one(i % 4 == 1, "", L("BPS-eng"), L("9")),
        )
    )
    out = files(spark, d).select("file_id", F.concat(L("f/"), i.cast("string")).alias("path"), F.posexplode(rows).alias("tag_no", "r"))
    return out.select("path", "file_id", "tag_no", (C("file_id") % 6 == 0).alias("track_targeted"), "r.*")


@query(
    "p43_tag_problems_tv",
    """SELECT 'f/' || file_id AS path, concat_ws('; ', CASE WHEN file_id % 2 = 0 THEN 'flattened tag: a/b' END, CASE WHEN file_id % 3 = 0 THEN 'no COLLECTION tag' END, CASE WHEN file_id % 5 = 0 THEN 'no SEASON tag' END,
  CASE WHEN file_id % 3 <> 0 AND file_id % 4 = 0 THEN 'COLLECTION title differs' END) AS problems FROM v_file""",
)
def p43(spark, d):
    expected = files(spark, d).select(F.concat(L("f/"), C("file_id").cast("string")).alias("path"), "show", C("title").alias("episode_title"))
    return verify.tag_problems_tv(_blocks(spark, d), expected).select("path", F.array_join("problems", "; ").alias("problems"))


@query("u5_slash_names", "SELECT 'f/' || file_id AS path, 'a/b' AS name FROM v_file WHERE file_id % 2 = 0")
def u5(spark, d):
    return verify.slash_names(_blocks(spark, d))


@query("u4_missing_targets", "SELECT 'f/' || file_id AS path, concat_ws(',', CASE WHEN file_id % 3 = 0 THEN 'COLLECTION' END, 'MOVIE', CASE WHEN file_id % 5 = 0 THEN 'SEASON' END) AS missing FROM v_file")
def u4(spark, d):
    return verify.missing_targets(_blocks(spark, d), ("MOVIE", "COLLECTION", "SEASON")).select("path", F.array_join("missing", ",").alias("missing"))


@query("u6_carry_forward", "SELECT 'f/' || file_id AS path, 'NOTE' || (file_id % 3) AS name, codec AS value FROM v_file WHERE file_id % 6 <> 0")
def u6(spark, d):
    return verify.carry_forward(_blocks(spark, d))


@query(
    "p47_readiness",
    """SELECT 'f/' || file_id AS path, concat_ws('; ', CASE WHEN file_id % 4 = 0 THEN 'segment title is x, not ' || title END, CASE WHEN file_id % 5 = 0 THEN 'statistics missing or stale, ratio 0.2500' END, CASE WHEN file_id % 3 = 0 THEN 'tracks' END, CASE WHEN file_id % 7 = 0 THEN 'tags' END) AS problems,
  file_id % 4 <> 0 AND file_id % 5 <> 0 AND file_id % 3 <> 0 AND file_id % 7 <> 0 AS ok FROM v_file""",
)
def p47(spark, d):
    i = C("file_id")
    f = files(spark, d).withColumn("path", F.concat(L("f/"), i.cast("string")))
    rows = f.select("path", F.when(i % 4 == 0, "x").otherwise(C("title")).alias("segment_title"), C("title").alias("expected_title"), F.when(i % 5 == 0, 0.25).otherwise(1.0).alias("statistics_ratio"))
    more = lambda n, why: f.where(i % n == 0).select("path", F.array(L(why)).alias("problems"))
    return verify.readiness(rows, more(3, "tracks"), more(7, "tags")).select("path", F.array_join("problems", "; ").alias("problems"), "ok")
