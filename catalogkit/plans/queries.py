"""The registered queries: a view of the driver tables and an operator each, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import names as N
from ..functions.constants import CODEC_EFFICIENCY
from ..functions.vocabulary import Vocabulary
from ..operators import audit, compare, crops, episodes, resolve, rules, standards, state, tracks, verify
from ..sources import readers
from ..streaming import jobs
from .adapters import placed_view, view
from .base import CLASS, EFFICIENCY, KEPT, NAMED, ORACLES, QUERIES, WEIGHTED, query

def _files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_file")


def _attrs(spark: SparkSession, d: str) -> DataFrame:
    return standards.attributes(_files(spark, d), view(spark, d, "v_track"))


_REPORT = f"""
WITH c AS (SELECT file_id, bool_or(type = 'audio' AND {KEPT}) AS kept FROM v_track GROUP BY file_id),
v AS (SELECT f.file_id, f.kind, CAST(width * sar AS BIGINT) AS dw, height AS dh, {CLASS} AS cls, round_even(({WEIGHTED}) / 1000.0, 0) AS wk,
  round(NULLIF(duration_s, 0) / 60.0, 1) AS rt, bars_px, abs(frame_rate - 25.0) <= 0.01 AND height IN (576, 288) AS pal, coalesce(c.kept, false) AS kept
  FROM v_file f LEFT JOIN c ON c.file_id = f.file_id),
b AS (SELECT file_id, unnest(list_filter([
  CASE WHEN kind = 'movie' AND dw < 1920 THEN 'movie_display_width' END, CASE WHEN kind = 'movie' AND dh < 800 THEN 'movie_display_height' END,
  CASE WHEN kind = 'movie' AND rt < 40 THEN 'movie_runtime' END, CASE WHEN kind = 'tv' AND rt < 15 THEN 'episode_runtime' END,
  CASE WHEN bars_px > 20 THEN 'letterbox_bars' END, CASE WHEN pal THEN 'pal_speedup' END, CASE WHEN NOT kept THEN 'kept_audio' END,
  CASE WHEN cls = 'SD' AND wk < 1000 THEN 'min_kbps_sd' END, CASE WHEN cls = '720' AND wk < 2000 THEN 'min_kbps_720' END,
  CASE WHEN cls = '1080' AND wk < 4000 THEN 'min_kbps_1080' END, CASE WHEN cls = '2160' AND wk < 8000 THEN 'min_kbps_2160' END], lambda x: x IS NOT NULL)) AS rule FROM v)
"""


@query(
    "flagship_quality_report",
    _REPORT
    + """SELECT v.file_id, v.kind, v.cls AS res_class, CAST(v.dw AS BIGINT) AS display_width, CAST(v.wk AS BIGINT) AS weighted_kbps, v.rt AS runtime_min,
  coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM b WHERE b.file_id = v.file_id), '') AS broken,
  CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.file_id = v.file_id) THEN 'below' END AS severity FROM v""",
)
def flagship(spark, d):
    r = standards.quality_report(_files(spark, d), view(spark, d, "v_track"))
    broken = F.array_join(F.array_sort(F.transform("broken", lambda b: b["rule"])), ",")
    return r.select("file_id", "kind", "res_class", "display_width", F.col("weighted_kbps").cast("long").alias("weighted_kbps"), "runtime_min", broken.alias("broken"), "severity")


@query("p22_evaluate_rules", _REPORT + "SELECT rule, count(*) AS n FROM b GROUP BY rule")
def p22(spark, d):
    r = standards.quality_report(_files(spark, d), view(spark, d, "v_track"))
    return r.select(F.explode("broken").alias("b")).groupBy(F.col("b.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("p26_flags")
def p26(spark, d):
    r = standards.quality_report(_files(spark, d), view(spark, d, "v_track"))
    return r.select("file_id", F.explode("flags").alias("column", "mark"))


@query("p21_screen")
def p21(spark, d):
    return rules.screen(standards.report_values(_attrs(spark, d))).select("file_id", F.size("problems").alias("n_problems"), F.array_join("problems", "; ").alias("problems"), F.array_join("warnings", "; ").alias("warnings"))


@query("p13_weighted_bitrate", f"SELECT file_id, round({WEIGHTED}, 3) AS weighted FROM v_file")
def p13(spark, d):
    return _files(spark, d).select("file_id", F.round(G.weighted_bitrate(F.col("bitrate"), F.col("codec")), 3).alias("weighted"))


@query("p15_resolution_class", f"SELECT file_id, {CLASS} AS cls FROM v_file")
def p15(spark, d):
    return _files(spark, d).select("file_id", G.resolution_class(F.col("width") * F.col("sar"), F.col("height")).alias("cls"))


@query("p16_kbps_floor", f"SELECT file_id, CAST(CASE {CLASS} WHEN 'SD' THEN 1000 WHEN '720' THEN 2000 WHEN '1080' THEN 4000 ELSE 8000 END AS BIGINT) AS floor FROM v_file")
def p16(spark, d):
    return _files(spark, d).select("file_id", G.kbps_floor(G.resolution_class(F.col("width") * F.col("sar"), F.col("height"))).cast("long").alias("floor"))


@query(
    "p17_report_values",
    f"""SELECT file_id, CAST(round_even(NULLIF(bitrate, 0) / 1000.0, 0) AS BIGINT) AS kbps, CAST(round_even(({WEIGHTED}) / 1000.0, 0) AS BIGINT) AS weighted_kbps,
  CAST(round(CAST(NULLIF(bitrate, 0) / (CAST(width * sar AS BIGINT) * height * frame_rate) AS DECIMAL(38,12)), 3) AS DOUBLE) AS bpp, round(NULLIF(duration_s, 0) / 60.0, 1) AS runtime_min, CAST(round(CAST(size_bytes / 1e9 AS DECIMAL(38,12)), 2) AS DOUBLE) AS gb,
  abs(frame_rate - 25.0) <= 0.01 AND height IN (576, 288) AS pal_speedup FROM v_file""",
)
def p17(spark, d):
    v = standards.report_values(_attrs(spark, d))
    return v.select("file_id", F.col("kbps").cast("long").alias("kbps"), F.col("weighted_kbps").cast("long").alias("weighted_kbps"), "bpp", "runtime_min", "gb", "pal_speedup")


@query("p18_pal_speedup", "SELECT file_id, abs(frame_rate - 25.0) <= 0.01 AND height IN (576, 288) AS pal FROM v_file")
def p18(spark, d):
    return _files(spark, d).select("file_id", G.is_pal_speedup(F.col("frame_rate"), F.col("height")).alias("pal"))


@query("p19_letterbox_candidate", "SELECT file_id, abs(width * sar / height - 16.0/9) < 0.02 OR abs(width * sar / height - 4.0/3) < 0.02 AS candidate FROM v_file")
def p19(spark, d):
    return _files(spark, d).select("file_id", G.is_letterbox_candidate(F.col("width") * F.col("sar") / F.col("height")).alias("candidate"))


@query(
    "p11_attributes",
    f"""WITH c AS (SELECT file_id, count(*) FILTER (WHERE type = 'audio') AS a, count(*) FILTER (WHERE type = 'subtitles') AS s, max(CASE WHEN type = 'audio' THEN channels END) AS ch FROM v_track GROUP BY file_id)
SELECT f.file_id, CAST(round_even(width * sar, 0) AS BIGINT) AS display_width, CAST(round_even(width * sar, 0) * height AS BIGINT) AS display_pixels, round(round_even(width * sar, 0) / height, 3) AS display_aspect,
  CAST(CASE WHEN bars_px IS NOT NULL THEN round_even(width * sar, 0) * (height - bars_px) END AS BIGINT) AS picture_pixels, CAST(a AS BIGINT) AS audio_tracks, CAST(s AS BIGINT) AS subtitle_tracks, CAST(CASE WHEN c.file_id IS NOT NULL THEN coalesce(ch, 0) END AS BIGINT) AS audio_channels_max
FROM v_file f LEFT JOIN c ON c.file_id = f.file_id""",
)
def p11(spark, d):
    return _attrs(spark, d).select("file_id", "display_width", "display_pixels", "display_aspect", F.col("picture_pixels").cast("long").alias("picture_pixels"), "audio_tracks", "subtitle_tracks", F.col("audio_channels_max").cast("long").alias("audio_channels_max"))


@query(
    "p49_route",
    f"""SELECT file_id, CASE WHEN codec IN ('hevc', 'h265', 'av1') THEN 1 WHEN {CLASS} = 'SD' THEN 2 WHEN dolby_vision THEN 3 WHEN file_id % 2 = 0 THEN 6 ELSE 7 END AS gate,
  CASE WHEN codec IN ('hevc', 'h265', 'av1') OR {CLASS} = 'SD' THEN 'passthrough' ELSE 'encode' END AS action FROM v_file""",
)
def p49(spark, d):
    files = _files(spark, d).withColumns({"display_width": F.col("width") * F.col("sar"), "display_height": F.col("height"), "grainy": F.col("file_id") % 2 == 0})
    return crops.route(files).select("file_id", "gate", "action")


@query("p56_pools_a17_depths", "SELECT 'assess' AS pool, count(*) AS n FROM v_title WHERE stage NOT IN ('HELD','QUARANTINED','FAILED','PUBLISHED','CLEANUP') AND id % 3 = 0 UNION ALL SELECT 'cpu', count(*) FROM v_title WHERE stage NOT IN ('HELD','QUARANTINED','FAILED','PUBLISHED','CLEANUP') AND id % 3 > 0 UNION ALL SELECT 'gpu', count(*) FROM v_title WHERE stage NOT IN ('HELD','QUARANTINED','FAILED','PUBLISHED','CLEANUP') AND id % 3 = 2")
def a17(spark, d):
    pools = F.when(F.col("id") % 3 == 1, F.array(F.lit("cpu"))).when(F.col("id") % 3 == 2, F.array(F.lit("cpu"), F.lit("gpu"))).otherwise(F.array().cast("array<string>"))
    return state.queue_depths(view(spark, d, "v_title").withColumn("pools", pools))


@query("p50_sdr_stamp", f"SELECT file_id, CASE WHEN hdr THEN NULL WHEN {CLASS} = 'SD' THEN 'smpte170m' ELSE 'bt709' END AS stamp FROM v_file")
def p50(spark, d):
    return _files(spark, d).select("file_id", G.sdr_stamp(F.col("width") * F.col("sar"), F.col("height"), F.col("hdr"), F.lit(False)).alias("stamp"))


@query(
    "p55_crop_limit", "SELECT file_id, CAST(greatest(24 * pow(2, bit_depth - 8), least(floor((16 + file_id % 40) * 1.5), floor(pow(2, bit_depth) * 0.13))) AS BIGINT) AS crop_limit FROM v_file"
)
def p55(spark, d):
    return _files(spark, d).select("file_id", G.crop_limit(F.col("bit_depth"), F.lit(16) + F.col("file_id") % 40).alias("crop_limit"))


@query("p54_crop_positions", "SELECT file_id, i AS place, round(duration_s * 0.02 + i * least((duration_s * 0.92 - duration_s * 0.02) / 7, 900.0), 3) AS at FROM v_file, range(8) t(i) WHERE duration_s IS NOT NULL")
def p54(spark, d):
    return _files(spark, d).where("duration_s is not null").select("file_id", F.posexplode(G.crop_positions(F.col("duration_s"), 8)).alias("place", "at")).withColumn("place", F.col("place").cast("long"))


@query("f42_tolerance_vote", "SELECT a.file_id, coalesce(abs(a.bitrate - b.bitrate) / CAST(greatest(a.bitrate, b.bitrate) AS DOUBLE) > 0.25, false) AS differs FROM v_file a JOIN v_file b ON b.file_id = a.file_id + 1")
def f42(spark, d):
    f = _files(spark, d)
    nxt = f.select((F.col("file_id") - 1).alias("file_id"), F.col("bitrate").alias("b"))
    return f.join(nxt, "file_id").select("file_id", G.tolerance_vote(F.col("bitrate"), F.col("b"), 0.25).alias("differs"))


@query("j8_with_efficiency", f"SELECT file_id, round(CAST({EFFICIENCY} AS DOUBLE), 3) AS efficiency FROM v_file")
def j8(spark, d):
    table = spark.createDataFrame(list(CODEC_EFFICIENCY.items()), "codec string, efficiency double")
    return standards.with_efficiency(_files(spark, d), table).select("file_id", F.round("efficiency", 3).alias("efficiency"))


@query("j22_with_overrides", "SELECT file_id, CASE WHEN season = 2 THEN true END AS film FROM v_file")
def j22(spark, d):
    files = _files(spark, d).select("file_id", F.concat_ws("/", F.lit("lib"), "show", F.col("season").cast("string"), F.lit("x.mkv")).alias("path"))
    bodies = files.where("path like '%/2/x.mkv'").select(F.regexp_replace("path", "x.mkv$", "a.job").alias("path"), F.lit("film=yes").alias("body")).distinct()
    return readers.with_overrides(files, readers.parse_sidecars(bodies)).select("file_id", "film")


@query("p67_encoder_params", f"SELECT file_id, CASE WHEN codec IN ('hevc', 'h265', 'av1') OR {CLASS} = 'SD' THEN '' ELSE 'cpu: libx265 x265_preset=slow x265_crf=18' END AS summary FROM v_file")
def p67(spark, d):
    files = _files(spark, d).withColumns({"display_width": F.col("width") * F.col("sar"), "display_height": F.col("height"), "grainy": F.lit(False)})
    out = crops.encoder_params(crops.route(files), {"x265_preset": "slow", "x265_crf": 18}, ("x265_preset", "x265_crf"))
    return out.select("file_id", F.array_join("summaries", "; ").alias("summary"))


@query("p71_remux_check", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'chapters lost' WHEN file_id % 3 = 1 THEN 'packets lost' ELSE '' END AS problems FROM v_file")
def p71(spark, d):
    f = _files(spark, d).select("file_id", F.when(F.col("file_id") % 3 == 0, "mp4").when(F.col("file_id") % 3 == 1, "avi").otherwise("mkv").alias("format"))
    pairs = f.select("*", *[F.lit(v).alias(k) for k, v in (("src_chapters", 5), ("out_chapters", 4), ("src_packets", 9), ("out_packets", 8), ("src_duration_s", 1.0), ("out_duration_s", 1.0))])
    return verify.remux_check(pairs).select("file_id", F.array_join("problems", ",").alias("problems"))


@query("p70_movie_ladder")
def p70(spark, d):
    n = view(spark, d, "v_name").select(F.col("name_id").alias("title_id"), F.concat(F.lit("lib/"), "name", F.lit("/file.mkv")).alias("path"), "name")
    none = F.lit(None).cast("string")
    rows = n.withColumns({"origin": none, "tag_tmdb": none, "tag_imdb": none, "tag_title": F.col("name"), "tag_year": F.lit(None).cast("int"), "segment_title": none})
    return resolve.movie_ladder(rows).select("title_id", "place", "rung", "by_id", F.size("readings").alias("n_readings"))


@query("j16_link_imports", "SELECT f.path, t.id AS linked_id FROM v_finding f LEFT JOIN v_title t ON f.path = 'lib/Brand#' || t.id")
def j16(spark, d):
    t = view(spark, d, "v_title").select("id", F.concat(F.lit("lib/Brand#"), F.col("id").cast("string")).alias("source_path"))
    f = view(spark, d, "v_finding").select("path", F.col("path").alias("import_path"), F.lit(None).cast("long").alias("imported_title_id"))
    return state.link_imports(t, f).select("path", "linked_id")


@query("w16_title_by_job", "SELECT 'job ' || (id % 50) AS job_id, max(id) AS id FROM v_title GROUP BY 1")
def w16(spark, d):
    return state.title_by_job(view(spark, d, "v_title").withColumn("job_id", F.concat(F.lit("job "), (F.col("id") % 50).cast("string"))))


@query("a19_poster_urls", "SELECT DISTINCT 'u/' || (id % 40) AS poster_url FROM v_title")
def a19(spark, d):
    return state.poster_urls(view(spark, d, "v_title").withColumn("poster_url", F.concat(F.lit("u/"), (F.col("id") % 40).cast("string"))))


# Tracks

@query(
    "a3_track_counters",
    f"""SELECT file_id, count(*) FILTER (WHERE type = 'audio' AND is_default) AS audio_default_count, count(*) FILTER (WHERE type = 'subtitles' AND is_default AND NOT forced) AS subtitle_default_count,
  count(*) FILTER (WHERE type = 'subtitles' AND forced AND {KEPT}) AS subtitle_forced_count, count(*) FILTER (WHERE type = 'subtitles' AND forced AND is_default AND {KEPT}) AS subtitle_forced_default_count FROM v_track GROUP BY file_id""",
)
def a3(spark, d):
    return tracks.track_counters(view(spark, d, "v_track")).select("file_id", "audio_default_count", "subtitle_default_count", "subtitle_forced_count", "subtitle_forced_default_count")


@query("a4_foreign_languages", f"SELECT file_id, coalesce(string_agg(language, ',' ORDER BY CASE type WHEN 'audio' THEN 0 ELSE 1 END, track_no) FILTER (WHERE type IN ('audio', 'subtitles') AND NOT {KEPT}), '') AS languages FROM v_track GROUP BY file_id")
def a4(spark, d):
    return tracks.foreign_languages(view(spark, d, "v_track")).select("file_id", F.array_join("foreign_tracks", ",").alias("languages"))


@query("a5_packet_totals", "SELECT file_id, count(x) AS packets, CAST(sum(x) AS BIGINT) AS bytes FROM (SELECT file_id, try_cast(line AS BIGINT) AS x FROM v_packet) WHERE x IS NOT NULL GROUP BY file_id")
def a5(spark, d):
    return tracks.packet_totals(view(spark, d, "v_packet"))


@query(
    "p9_fill_from_packets",
    """WITH t AS (SELECT file_id, count(x) AS packets, sum(x) AS bytes FROM (SELECT file_id, try_cast(line AS BIGINT) AS x FROM v_packet) WHERE x IS NOT NULL GROUP BY file_id)
SELECT f.file_id, CAST(packets AS BIGINT) AS frame_count, CAST(coalesce(bitrate, round_even(bytes * 8 / duration_s, 0)) AS BIGINT) AS bitrate FROM v_file f LEFT JOIN t ON t.file_id = f.file_id""",
)
def p9(spark, d):
    out = tracks.fill_from_packets(_files(spark, d).withColumn("frame_count", F.lit(None).cast("long")), view(spark, d, "v_packet"))
    return out.select("file_id", "frame_count", F.col("bitrate").cast("long").alias("bitrate"))


@query("a6_statistics_ratio", "SELECT f.file_id, round(coalesce(s, 0) / CAST(size_bytes AS DOUBLE), 6) AS ratio FROM v_file f LEFT JOIN (SELECT file_id, sum(bytes) AS s FROM v_track GROUP BY file_id) t ON t.file_id = f.file_id")
def a6(spark, d):
    return tracks.statistics_ratio(view(spark, d, "v_track"), _files(spark, d)).select("file_id", F.round("statistics_ratio", 6).alias("ratio"))


@query("a7_max_channels", "SELECT file_id, CAST(coalesce(max(CASE WHEN type = 'audio' THEN channels END), 0) AS BIGINT) AS audio_channels_max FROM v_track GROUP BY file_id")
def a7(spark, d):
    return tracks.max_channels(view(spark, d, "v_track")).withColumn("audio_channels_max", F.col("audio_channels_max").cast("long"))


@query(
    "a8_joined_codecs",
    "WITH a AS (SELECT file_id, codec, min(track_no) AS f FROM v_track WHERE type = 'audio' GROUP BY file_id, codec), ids AS (SELECT DISTINCT file_id FROM v_track) SELECT i.file_id, string_agg(codec, ', ' ORDER BY f) AS audio_codecs FROM ids i LEFT JOIN a ON a.file_id = i.file_id GROUP BY i.file_id",
)
def a8(spark, d):
    return tracks.joined_codecs(view(spark, d, "v_track"))


@query("a9_forced_counts", f"SELECT file_id, count(*) FILTER (WHERE type = 'subtitles' AND (forced OR {NAMED}) AND {KEPT}) AS subtitle_forced_tracks, count(*) FILTER (WHERE type = 'subtitles' AND NOT forced AND {NAMED}) AS subtitle_named_forced FROM v_track GROUP BY file_id")
def a9(spark, d):
    return tracks.forced_counts(view(spark, d, "v_track"))


@query("f36_named_forced", f"SELECT track_no, {NAMED} AS named FROM v_track")
def f36(spark, d):
    return view(spark, d, "v_track").select("track_no", G.named_forced(F.col("name")).alias("named"))


@query("w6_track_selectors", "SELECT file_id, track_no, type[1] || row_number() OVER (PARTITION BY file_id, type ORDER BY track_no) AS selector FROM v_track")
def w6(spark, d):
    return tracks.track_selectors(view(spark, d, "v_track")).select("file_id", "track_no", "selector")


@query(
    "w7_flag_plan",
    f"""WITH t AS (SELECT *, type = 'subtitles' AND (forced OR {NAMED}) AND {KEPT} AS fs FROM v_track)
SELECT file_id, track_no, CASE type WHEN 'audio' THEN row_number() OVER (PARTITION BY file_id, type ORDER BY track_no) = 1 WHEN 'subtitles' THEN fs AND row_number() OVER (PARTITION BY file_id, type, fs ORDER BY track_no) = 1 ELSE is_default END AS want_default,
  forced OR fs AS want_forced, CASE WHEN type = 'video' THEN 'eng' ELSE language END AS want_language FROM t""",
)
def w7(spark, d):
    return tracks.flag_plan(view(spark, d, "v_track")).drop("type")


@query("w8_strip_plan", f"SELECT file_id, count(*) FILTER (WHERE type = 'audio' AND {KEPT}) AS n_audio, count(*) FILTER (WHERE type = 'subtitles' AND {KEPT}) AS n_subtitles, count(*) FILTER (WHERE type IN ('audio', 'subtitles') AND NOT {KEPT}) AS n_dropped FROM v_track GROUP BY file_id")
def w8(spark, d):
    p = tracks.strip_plan(view(spark, d, "v_track"))
    return p.select("file_id", *[F.size(c).cast("long").alias(n) for c, n in (("keep_audio", "n_audio"), ("keep_subtitles", "n_subtitles"), ("dropped", "n_dropped"))])


@query("w15_primary_video", "SELECT file_id, min(track_no) AS track_no, coalesce(arg_min(coalesce(language, '?'), track_no), 'und') AS video_language FROM v_track WHERE type = 'video' GROUP BY file_id")
def w15(spark, d):
    t = placed_view(spark, d, "v_track").withColumn("language", F.coalesce("language", F.lit("?")))
    return tracks.primary_video(t)


@query("p44_track_problems")
def p44(spark, d):
    return tracks.track_problems(view(spark, d, "v_track")).select("file_id", F.array_join("problems", "; ").alias("problems"))


@query(
    "u2_subtitle_loss",
    f"""WITH b AS (SELECT file_id, lower(coalesce(language, 'und')) AS language, forced OR {NAMED} AS forced, count(*) AS n FROM v_track WHERE type = 'subtitles' AND {KEPT} AND track_no % 2 = 0 GROUP BY ALL),
o AS (SELECT file_id, lower(coalesce(language, 'und')) AS language, forced, count(*) AS n FROM v_track WHERE type = 'subtitles' AND {KEPT} AND track_no % 2 = 1 GROUP BY ALL)
SELECT b.file_id, b.language, b.forced, b.n - coalesce(o.n, 0) AS lost FROM b LEFT JOIN o ON b.file_id = o.file_id AND b.language = o.language AND b.forced = o.forced WHERE b.n > coalesce(o.n, 0)""",
)
def u2(spark, d):
    t = view(spark, d, "v_track")
    return tracks.subtitle_loss(t.where("track_no % 2 = 0"), t.where("track_no % 2 = 1"))


# Pairs

_PAIR_COLS = ["file_id", "path", "title", "year", "codec", "bitrate", "hdr", "dolby_vision", "display_pixels", "display_aspect", "picture_pixels", "letterbox_px", "audio_channels_max", "bit_depth", "subtitle_forced_tracks"]


def _pair_attrs(spark, d):
    return _attrs(spark, d).withColumn("path", F.col("file_id").cast("string")).select(*_PAIR_COLS, F.floor(F.col("file_id") / 2).alias("entity"))


_VOTES = f"""
WITH c AS (SELECT file_id, coalesce(max(CASE WHEN type = 'audio' THEN channels END), 0) AS ch, count(*) FILTER (WHERE type = 'subtitles' AND (forced OR {NAMED}) AND {KEPT}) AS ft FROM v_track GROUP BY file_id),
a AS (SELECT f.file_id, CAST(floor(f.file_id / 2) AS BIGINT) AS entity, dolby_vision OR hdr AS hv, round_even(width * sar, 0) * height AS px, coalesce(bars_px, 0) AS bars,
  CASE WHEN bars_px IS NOT NULL THEN round_even(width * sar, 0) * (height - bars_px) END AS pic, ch, bit_depth AS depth, {WEIGHTED} AS rate, coalesce(ft, 0) AS ft FROM v_file f LEFT JOIN c ON c.file_id = f.file_id),
p AS (SELECT n.file_id AS new_id, o.file_id AS old_id, n.hv AS nhv, o.hv AS ohv,
  CASE WHEN n.hv <> o.hv THEN sign(CAST(n.hv AS INT) - CAST(o.hv AS INT)) ELSE 0 END AS g1,
  CASE WHEN n.bars = 0 AND o.bars = 0 AND abs(n.px - o.px) / CAST(greatest(n.px, o.px) AS DOUBLE) > 0.05 THEN sign(n.px - o.px) ELSE 0 END AS g2,
  CASE WHEN n.pic > 0 AND o.pic > 0 AND abs(n.pic - o.pic) / CAST(greatest(n.pic, o.pic) AS DOUBLE) > 0.05 THEN sign(n.pic - o.pic) ELSE 0 END AS g3,
  CASE WHEN n.ch > 0 AND o.ch > 0 THEN coalesce(sign(n.ch - o.ch), 0) ELSE 0 END AS g4, sign(n.depth - o.depth) AS g5,
  CASE WHEN abs(n.rate - o.rate) / greatest(n.rate, o.rate) > 0.25 THEN sign(n.rate - o.rate) ELSE 0 END AS g6, sign(n.ft - o.ft) AS g7
  FROM a n JOIN a o ON n.entity = o.entity AND n.file_id > o.file_id),
t AS (SELECT *, CASE WHEN ohv AND NOT nhv THEN [-1.0, 0, 0, 0, 0, 0, 0] ELSE [g1, g2, g3, g4, g5, g6, g7] END AS g FROM p),
r AS (SELECT new_id, old_id, g, list_contains(g, 1) AS w, list_contains(g, -1) AS l FROM t)
"""


@query(
    "a13_pair_comparison",
    _VOTES + "SELECT new_id, old_id, CASE WHEN w AND l THEN 'ambiguous' WHEN w THEN 'win' WHEN l THEN 'loss' ELSE 'ambiguous' END AS verdict, CAST(CASE WHEN (w AND l) OR NOT (w OR l) THEN NULL ELSE list_position(list_transform(g, lambda x: x <> 0), true) END AS BIGINT) AS gate, CAST(len(list_filter(g, lambda x: x <> 0)) AS BIGINT) AS n_votes FROM r",
)
def a13(spark, d):
    a = _pair_attrs(spark, d)
    out = compare.compare_pairs(a, a, ["entity"]).where("new_file_id > old_file_id")
    return out.select(F.col("new_file_id").alias("new_id"), F.col("old_file_id").alias("old_id"), "verdict", F.col("gate").cast("long").alias("gate"), F.col("n_votes").cast("long").alias("n_votes"))


@query(
    "a14_difference_table",
    """WITH a AS (SELECT file_id, CAST(floor(file_id / 2) AS BIGINT) AS entity, codec, CAST(bit_depth AS VARCHAR) AS bit_depth, CAST(bitrate AS VARCHAR) AS bitrate FROM v_file),
p AS (SELECT n.file_id AS new_id, o.file_id AS old_id, unnest([{'a': 'codec', 'n': n.codec, 'o': o.codec}, {'a': 'bit_depth', 'n': n.bit_depth, 'o': o.bit_depth}, {'a': 'bitrate', 'n': n.bitrate, 'o': o.bitrate}]) AS s FROM a n JOIN a o ON n.entity = o.entity AND n.file_id > o.file_id)
SELECT new_id, old_id, s.a AS attribute, s.n AS incoming, s.o AS incumbent, s.n IS DISTINCT FROM s.o AS differs, s.n IS NOT NULL AND s.o IS NOT NULL AS measurable FROM p""",
)
def a14(spark, d):
    a = _pair_attrs(spark, d)
    pairs = compare.compare_pairs(a, a, ["entity"]).where("new_file_id > old_file_id").withColumnsRenamed({"new_file_id": "new_id", "old_file_id": "old_id"})
    return compare.difference_table(pairs, ["codec", "bit_depth", "bitrate"], ["new_id", "old_id"]).drop("gate", "decided")


@query("j5_same_cut", "SELECT a.file_id, coalesce(abs(NULLIF(a.duration_s, 0) - NULLIF(b.duration_s, 0)) <= 30) AS same FROM v_file a JOIN v_file b ON b.file_id = a.file_id + 1")
def j5(spark, d):
    f = _files(spark, d)
    nxt = f.select((F.col("file_id") - 1).alias("file_id"), F.col("duration_s").alias("b"))
    none = F.lit(None).cast("long")
    return f.join(nxt, "file_id").select("file_id", G.same_cut(none, none, F.col("duration_s"), F.col("b")).alias("same"))


@query("p73_crop_pair")
def p73(spark, d):
    a = _pair_attrs(spark, d)
    pairs = compare.pair_up(a, a, ["entity"]).where("new_file_id > old_file_id")
    figures = _files(spark, d).where("bars_px is not null").select("file_id", "bars_px", (F.col("width") * (F.col("height") - F.col("bars_px"))).alias("picture_pixels"))
    return compare.crop_pair(pairs, figures).select("new_file_id", "old_file_id", "crop_wanted", "new_letterbox_px", "old_letterbox_px", "new_picture_pixels", "old_picture_pixels")


@query(
    "j4_siblings",
    """WITH t AS (SELECT *, greatest(coalesce(episode_last, episode), episode) AS last, stage IN ('ROUTED','STAGED','REMUXED','TAGGED','READY','ENCODING','ENCODED','VERIFIED') AS past FROM v_title WHERE stage NOT IN ('PUBLISHED','CLEANUP','QUARANTINED'))
SELECT a.id, min(b.id) AS sibling_id FROM t a JOIN t b ON a.kind = b.kind AND a.id <> b.id AND (b.id < a.id OR b.past)
  AND ((a.kind = 'movie' AND a.tmdb = b.tmdb) OR (a.kind = 'tv' AND a.tvdb = b.tvdb AND a.season = b.season AND a.episode <= b.last AND a.last >= b.episode)) GROUP BY a.id""",
)
def j4(spark, d):
    return state.siblings_in_flight(view(spark, d, "v_title").withColumn("imdb", F.lit(None).cast("string")))


# State and queue

_STOPPED = "('HELD','QUARANTINED','FAILED','PUBLISHED','CLEANUP')"


@query("a1_counts_by_stage", "SELECT stage, count(*) AS n FROM v_title GROUP BY stage")
def a1(spark, d):
    return state.counts_by_stage(view(spark, d, "v_title"))


@query("a2_audit_totals", "SELECT count(*) AS n, count(*) FILTER (WHERE checks_json <> '[]') AS with_findings, CAST(max(mtime) AS BIGINT) AS latest FROM v_finding")
def a2(spark, d):
    return state.audit_totals(view(spark, d, "v_finding")).withColumn("latest", F.col("latest").cast("long"))


@query("o1_recent_titles", "SELECT id, stage FROM v_title WHERE stage = 'HELD' ORDER BY updated_at DESC, id DESC LIMIT 1000")
def o1(spark, d):
    return state.recent_titles(view(spark, d, "v_title"), "HELD").select("id", "stage")


@query("o2_queue", f"SELECT id, CAST(row_number() OVER (ORDER BY queue_order NULLS LAST, id) AS BIGINT) AS place FROM v_title WHERE stage NOT IN {_STOPPED}")
def o2(spark, d):
    rows = state.queued(view(spark, d, "v_title")).select("id", "queue_order")
    return state.dense_rank_by(rows, [F.asc_nulls_last("queue_order"), F.asc("id")], "place").select("id", "place")


@query("o3_needs_decision", "SELECT id, stage FROM ((SELECT id, stage FROM v_title WHERE stage = 'HELD' ORDER BY updated_at DESC, id DESC LIMIT 1000) UNION ALL (SELECT id, stage FROM v_title WHERE stage = 'FAILED' ORDER BY updated_at DESC, id DESC LIMIT 1000))")
def o3(spark, d):
    return state.needs_decision(view(spark, d, "v_title")).select("id", "stage")


@query("o4_title_history", "SELECT event_id, title_id, stage FROM v_history WHERE title_id = 7 ORDER BY at, event_id LIMIT 200")
def o4(spark, d):
    return state.title_history(view(spark, d, "v_history"), 7).select("event_id", "title_id", "stage")


@query("u1_held_or_failed", "SELECT id, stage FROM v_title WHERE stage IN ('HELD', 'FAILED')")
def u1(spark, d):
    return state.held_or_failed(view(spark, d, "v_title")).select("id", "stage")


@query("w1_queue_positions", f"SELECT id, CAST(row_number() OVER (ORDER BY queue_order NULLS LAST, id) AS BIGINT) AS position FROM v_title WHERE stage NOT IN {_STOPPED} AND id % 11 <> 0")
def w1(spark, d):
    t = view(spark, d, "v_title")
    return state.queue_positions(t, t.where("id % 11 = 0"))


@query(
    "w3_place",
    f"""WITH q AS (SELECT *, id % 13 = 0 AS fresh FROM v_title WHERE stage NOT IN {_STOPPED}),
o AS (SELECT *, row_number() OVER (ORDER BY queue_order NULLS LAST, id) AS pos FROM q WHERE NOT fresh), l AS (SELECT show, max(pos) AS after FROM o WHERE kind = 'tv' GROUP BY show),
k AS (SELECT id, CAST(pos AS DOUBLE) AS key, 0 AS late FROM o UNION ALL SELECT q.id, CASE WHEN q.kind = 'tv' THEN after END, 1 FROM q LEFT JOIN l ON l.show = q.show WHERE fresh)
SELECT id, CAST(row_number() OVER (ORDER BY key NULLS LAST, late, id) AS BIGINT) AS queue_order FROM k""",
)
def w3(spark, d):
    t = view(spark, d, "v_title")
    return state.place(t, t.where("id % 13 = 0"))


@query(
    "o7_reorder",
    f"""WITH q AS (SELECT * FROM v_title WHERE stage NOT IN {_STOPPED}), u AS (SELECT id, CASE WHEN kind = 'tv' THEN CAST(substr(show, 6) AS BIGINT) ELSE 1000 + id END AS unit_no, season, episode FROM q)
SELECT id, CAST(row_number() OVER (ORDER BY unit_no, season, episode, id) AS BIGINT) AS queue_order FROM u""",
)
def o7(spark, d):
    t = view(spark, d, "v_title")
    movies = t.where("kind = 'movie'").select((F.col("id") + 1000).alias("unit_no"), "id", F.lit(None).cast("string").alias("show"))
    shows = t.where("kind = 'tv'").select(F.substring_index("show", " ", -1).cast("long").alias("unit_no"), F.lit(None).cast("long").alias("id"), "show").distinct()
    return state.reorder(t, movies.unionByName(shows))


@query("u3_validate_order", f"SELECT id, 'omitted' AS problem FROM v_title WHERE stage NOT IN {_STOPPED} AND id % 17 = 0 UNION ALL SELECT id, 'duplicate' FROM v_title WHERE stage NOT IN {_STOPPED} AND id % 17 = 1")
def u3(spark, d):
    q = state.queued(view(spark, d, "v_title")).select("id", F.lit(False).alias("locked"))
    asked = q.where("id % 17 <> 0").select("id")
    return state.validate_order(q, asked.unionByName(q.where("id % 17 = 1").select("id")))


@query("a20_show_tiles", "WITH p AS (SELECT id, row_number() OVER (ORDER BY queue_order NULLS LAST, id) AS position FROM v_title WHERE stage NOT IN ('HELD','QUARANTINED','FAILED','PUBLISHED','CLEANUP')) SELECT show, count(*) AS n, CAST(min(position) AS BIGINT) AS first, CAST(max(position) AS BIGINT) AS last FROM v_title t LEFT JOIN p ON p.id = t.id WHERE kind = 'tv' GROUP BY show")
def a20(spark, d):
    t = view(spark, d, "v_title")
    return state.show_tiles(t, state.queue_positions(t, t.where("false")))


@query("p62_retry_plan", "SELECT id, attempts >= 5 AS permanent, CASE WHEN attempts < 5 THEN 120.0 * pow(2, attempts) END AS delay_s FROM v_title")
def p62(spark, d):
    return state.retry_plan(view(spark, d, "v_title"), 0.0, 120.0, 5).select("id", "permanent", "delay_s")


@query("p57_classify_arrivals", "SELECT 'in/' || id || '.mkv' AS path, CASE WHEN id % 2 = 0 THEN 'new' WHEN stage IN ('PUBLISHED', 'CLEANUP') THEN 're-import' WHEN stage IN ('HELD', 'QUARANTINED', 'FAILED') THEN 'blocked' ELSE 'claimed' END AS state FROM v_title")
def p57(spark, d):
    t = view(spark, d, "v_title").withColumn("source_path", F.concat(F.lit("in/"), F.col("id").cast("string"), F.lit(".mkv")))
    return state.classify_arrivals(t.select(F.col("source_path").alias("path")), t.where("id % 2 <> 0")).select("path", "state")


@query(
    "p58_close_collected",
    "SELECT id, CASE WHEN stage IN ('PUBLISHED', 'CLEANUP') AND id % 4 = 1 THEN 'reject' ELSE 'delete' END AS action FROM v_title WHERE (stage IN ('PUBLISHED', 'CLEANUP') AND id % 4 IN (1, 2)) OR (stage = 'QUARANTINED' AND id % 4 = 2)",
)
def p58(spark, d):
    name = lambda area: F.concat(F.lit(f"{area}/"), F.col("id").cast("string"))
    t = view(spark, d, "v_title").withColumns({"output_path": name("out"), "quarantine_path": name("q"), "source_path": name("in")})
    there = t.where("id % 4 in (0, 3)").select(F.col("output_path").alias("path")).unionByName(t.where("id % 4 = 1").select(F.col("quarantine_path").alias("path")))
    return state.close_collected(t, there)


@query(
    "p59_apply_decisions",
    """SELECT id, CASE WHEN stage NOT IN ('HELD', 'FAILED') THEN 'not waiting for a decision' WHEN id % 2 = 0 AND stage <> 'HELD' THEN 'only a held title' WHEN id % 5 = 0 AND stage = 'HELD' THEN 'needs an identity' END AS error,
  CASE WHEN stage IN ('HELD', 'FAILED') AND NOT (id % 2 = 0 AND stage <> 'HELD') AND NOT (id % 5 = 0 AND stage = 'HELD') THEN 'DETECTED' END AS new_stage FROM v_title""",
)
def p59(spark, d):
    t = view(spark, d, "v_title").withColumns({"files_gone": F.lit(False), "identification_held": (F.col("id") % 5 == 0) & (F.col("stage") == "HELD")})
    wishes = t.select("id", F.when(F.col("id") % 2 == 0, "override").otherwise("retry").alias("action"))
    return state.apply_decisions(t, wishes).select("id", "error", "new_stage")


@query("p61_annotate_titles", "SELECT id, CASE stage WHEN 'DETECTED' THEN 'queued' WHEN 'ROUTED' THEN 'waiting for encoder' WHEN 'PUBLISHED' THEN 'ready to promote' WHEN 'CLEANUP' THEN 'ready to promote' WHEN 'HELD' THEN 'needs a decision' WHEN 'QUARANTINED' THEN 'rejected' ELSE lower(stage) END AS stage_label, CAST(CASE WHEN stage = 'HELD' THEN greatest(ceil((id - 500) / 60.0), 0) END AS BIGINT) AS retry_minutes FROM v_title")
def p61(spark, d):
    t = view(spark, d, "v_title").withColumn("retry_after", F.col("id"))
    return state.annotate_titles(t, F.lit(500)).select("id", "stage_label", F.col("retry_minutes").cast("long").alias("retry_minutes"))


@query("p65_reset_for_reimport", "SELECT id, CASE WHEN id % 3 = 0 THEN 'DETECTED' ELSE stage END AS stage, CASE WHEN id % 3 = 0 THEN NULL ELSE tvdb END AS tvdb, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE attempts END AS BIGINT) AS attempts FROM v_title")
def p65(spark, d):
    t = view(spark, d, "v_title")
    return state.reset_for_reimport(t, t.where("id % 3 = 0")).select("id", "stage", "tvdb", F.col("attempts").cast("long").alias("attempts"))


@query("u11_forget_titles", "SELECT (SELECT count(*) FROM v_title WHERE id % 2 <> 0) AS titles, (SELECT count(*) FROM v_history WHERE title_id NOT IN (SELECT id FROM v_title WHERE id % 2 = 0)) AS history")
def u11(spark, d):
    t, h = state.forget_titles(view(spark, d, "v_title"), view(spark, d, "v_history"), view(spark, d, "v_title").where("id % 2 = 0"))
    both = t.select(F.lit(1).alias("t"), F.lit(0).alias("h")).unionByName(h.select(F.lit(0).alias("t"), F.lit(1).alias("h")))
    return both.agg(F.sum("t").alias("titles"), F.sum("h").alias("history"))


@query("s14_insert_sources", "SELECT id, 'in/' || id AS source_path, 'DETECTED' AS stage FROM v_title WHERE id % 2 = 0")
def s14(spark, d):
    t = view(spark, d, "v_title").withColumn("source_path", F.concat(F.lit("in/"), F.col("id").cast("string")))
    return state.insert_sources(t.where("id % 2 <> 0"), t, 0.0)[0].select("id", "source_path", "stage")


@query("j19_supersede", "SELECT id, CASE WHEN id % 6 = 0 THEN 'QUARANTINED' ELSE stage END AS stage FROM v_title")
def j19(spark, d):
    t = view(spark, d, "v_title").withColumn("output_path", F.concat(F.lit("out/"), F.col("id").cast("string")))
    return state.supersede(t, t.where("id % 6 = 0").select(F.array("output_path").alias("supersedes"))).select("id", "stage")


# Audit

@query("j17_unseen_files", "SELECT l.path FROM v_listing l WHERE NOT EXISTS (SELECT 1 FROM v_finding f WHERE f.path = l.path AND f.size = l.size AND f.mtime = l.mtime AND f.measured)")
def j17(spark, d):
    return audit.unseen_files(view(spark, d, "v_listing"), view(spark, d, "v_finding")).select("path")


@query("j18_forget_missing", "SELECT path FROM v_finding WHERE path IN (SELECT path FROM v_listing)")
def j18(spark, d):
    return audit.forget_missing(view(spark, d, "v_finding"), view(spark, d, "v_listing")).select("path")


@query("s11_upsert", "SELECT path, CAST(size AS BIGINT) AS size, CAST(mtime AS BIGINT) AS mtime FROM v_listing UNION ALL SELECT path, CAST(size AS BIGINT), CAST(mtime AS BIGINT) FROM v_finding WHERE path NOT IN (SELECT path FROM v_listing)")
def s11(spark, d):
    cols = ["path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime")]
    return audit.upsert_by_key(view(spark, d, "v_finding").select(*cols), view(spark, d, "v_listing").select(*cols), "path")


@query("o5_audit_rows", "SELECT path, checks_json FROM v_finding ORDER BY path")
def o5(spark, d):
    return audit.audit_rows(view(spark, d, "v_finding")).select("path", "checks_json")


def _season_files(spark, d):
    """Files in season folders: a movie library's shows, some with two-episode files."""
    long = F.when(F.col("file_id") % 9 == 0, F.col("duration_s") * 4).otherwise(F.col("duration_s") / 10 + 1000)
    first = (F.col("file_id") % 40) * 2 + 1
    return _files(spark, d).select(
        F.concat_ws("/", "show", F.col("season").cast("string")).alias("folder"), F.col("file_id").alias("row_id"), F.col("season").alias("season_folder"), "season",
        first.alias("first"), F.when(F.col("file_id") % 5 == 0, first + 1).otherwise(first).alias("last"), long.alias("duration_s"),
    )


_SEASONS = "f AS (SELECT show || '/' || season AS folder, file_id AS row_id, (file_id % 40) * 2 + 1 AS first, CASE WHEN file_id % 5 = 0 THEN (file_id % 40) * 2 + 2 ELSE (file_id % 40) * 2 + 1 END AS last, CASE WHEN file_id % 9 = 0 THEN duration_s * 4 ELSE duration_s / 10 + 1000 END AS dur FROM v_file)"


@query("a23_others_median", f"WITH {_SEASONS} SELECT a.row_id, CAST((SELECT count(b.dur) FROM f b WHERE b.folder = a.folder AND b.row_id <> a.row_id) AS BIGINT) AS others, round((SELECT median(b.dur) FROM f b WHERE b.folder = a.folder AND b.row_id <> a.row_id), 6) AS others_median FROM f a")
def a23(spark, d):
    return audit.others_median(_season_files(spark, d)).select("row_id", F.col("others").cast("long").alias("others"), F.round("others_median", 6).alias("others_median"))


@query(
    "w14_two_episode_files",
    f"""WITH {_SEASONS}, m AS (SELECT a.*, (SELECT median(b.dur) FROM f b WHERE b.folder = a.folder AND b.row_id <> a.row_id) AS med, (SELECT count(b.dur) FROM f b WHERE b.folder = a.folder AND b.row_id <> a.row_id) AS n FROM f a)
SELECT row_id, round(med, 6) AS others_median FROM m WHERE first = last AND n >= 3 AND dur >= 1.8 * med AND NOT EXISTS (SELECT 1 FROM f c WHERE c.folder = m.folder AND c.first <= m.first + 1 AND c.last >= m.first + 1)""",
)
def w14(spark, d):
    return audit.two_episode_files(_season_files(spark, d)).select("row_id", F.round("others_median", 6).alias("others_median"))


@query("j20_next_unclaimed", f"WITH {_SEASONS} SELECT row_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.folder = a.folder AND b.first <= a.first + 1 AND b.last >= a.first + 1)")
def j20(spark, d):
    return audit.next_unclaimed(_season_files(spark, d)).select("row_id")


@query("p28_track_checks")
def p28(spark, d):
    t = view(spark, d, "v_track")
    c = tracks.track_counters(t).join(tracks.foreign_languages(t), "file_id").join(tracks.primary_video(placed_view(spark, d, "v_track")).select("file_id", "video_language"), "file_id", "left")
    files = _files(spark, d).select("file_id", F.when(F.col("file_id") % 3 == 0, "avi").otherwise("matroska,webm").alias("format_name"))
    out = audit.audit_track_checks(files, c)
    return out.select("file_id", audit.check_summary(F.col("checks")).alias("summary"), F.size(audit.failed_checks(F.col("checks"))).alias("n_failed"))


@query("o6_sort_report")
def o6(spark, d):
    r = standards.report_values(_attrs(spark, d)).withColumn("path", F.col("file_id").cast("string"))
    return audit.sort_report(r.select("path", "title", "kbps"), "title")


@query("p41_filter_report", f"SELECT file_id FROM (SELECT file_id, codec, round_even(NULLIF(bitrate, 0) / 1000.0, 0) AS kbps, {CLASS} AS cls FROM v_file) WHERE kbps > 5000 AND lower(codec) LIKE '%e%'")
def p41(spark, d):
    r = standards.report_values(_attrs(spark, d))
    return audit.filter_report(r, [("kbps", ">", "5000"), ("codec", "contains", "E")]).select("file_id")


@query("a24_shown_of_total", "SELECT count(*) FILTER (WHERE round_even(NULLIF(bitrate, 0) / 1000.0, 0) > 5000) AS shown, count(*) AS total FROM v_file")
def a24(spark, d):
    return audit.shown_of_total(standards.report_values(_attrs(spark, d)), [("kbps", ">", "5000")])


@query("j6_broken_rules_long", _REPORT + "SELECT CAST(file_id AS VARCHAR) AS path, rule FROM b WHERE rule NOT IN ('pal_speedup', 'kept_audio', 'letterbox_bars')")
def j6(spark, d):
    v = standards.report_values(_attrs(spark, d)).withColumn("path", F.col("file_id").cast("string"))
    rows = [(k, key, float(x)) for k, p in rules.DEFAULT_PROFILES.items() for key, x in p.items()]
    s = spark.createDataFrame(rows, "kind string, value_key string, standard double")
    return rules.broken_rules_long(v, rules.default_rules(spark), s, ["display_width", "display_height", "runtime_min", "weighted_kbps"]).select("path", "rule")


@query("a18_broken_summary")
def a18(spark, d):
    v = standards.report_values(_attrs(spark, d)).withColumn("path", F.col("file_id").cast("string"))
    rows = [(k, key, float(x)) for k, p in rules.DEFAULT_PROFILES.items() for key, x in p.items()]
    s = spark.createDataFrame(rows, "kind string, value_key string, standard double")
    r = rules.default_rules(spark)
    return rules.broken_summary(rules.broken_rules_long(v, r, s, ["display_width", "display_height", "runtime_min", "weighted_kbps"]), r)


# Crops

@query(
    "w12_rank_geometries",
    "SELECT file_id, CAST(ch AS BIGINT) AS ch, n, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n DESC, ch DESC, f) AS BIGINT) AS place FROM (SELECT file_id, cw, ch, cx, cy, count(*) AS n, min(offset_no) AS f FROM v_crop_sample GROUP BY ALL)",
)
def w12(spark, d):
    return crops.rank_geometries(view(spark, d, "v_crop_sample")).select("file_id", F.col("ch").cast("long").alias("ch"), "n", F.col("place").cast("long").alias("place"))


@query(
    "a11_crop_consensus",
    """WITH g AS (SELECT file_id, ch, count(*) AS n, min(offset_no) AS f FROM v_crop_sample GROUP BY file_id, ch), t AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, ch DESC, f) AS p FROM g)
SELECT file_id, CAST(CASE WHEN 1080 - ch < 20 THEN 0 ELSE 1080 - ch END AS BIGINT) AS bars_px, CAST(1920 * (1080 - CASE WHEN 1080 - ch < 20 THEN 0 ELSE 1080 - ch END) AS BIGINT) AS picture_pixels FROM t WHERE p = 1""",
)
def a11(spark, d):
    s = view(spark, d, "v_crop_sample")
    files = s.select("file_id", F.lit(1080).alias("height"), F.lit(1920).alias("display_width")).distinct()
    return crops.crop_consensus(s, files).select("file_id", F.col("bars_px").cast("long").alias("bars_px"), F.col("picture_pixels").cast("long").alias("picture_pixels"))


@query(
    "a12_secondary_aspect",
    """WITH g AS (SELECT file_id, ch, count(*) AS n, min(offset_no) AS f FROM v_crop_sample GROUP BY file_id, ch), t AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, ch DESC, f) AS p, sum(n) OVER (PARTITION BY file_id) AS total FROM g),
s AS (SELECT b.file_id, b.ch, b.n / CAST(b.total AS DOUBLE) AS share, row_number() OVER (PARTITION BY b.file_id ORDER BY b.p) AS r FROM t b JOIN t a ON a.file_id = b.file_id AND a.p = 1 WHERE b.p > 1 AND b.n / CAST(b.total AS DOUBLE) >= 0.06 AND abs(1920.0 / b.ch - 1920.0 / a.ch) >= 0.15)
SELECT file_id, CAST(ch AS BIGINT) AS height, round(share, 6) AS share FROM s WHERE r = 1""",
)
def a12(spark, d):
    return crops.secondary_aspect(view(spark, d, "v_crop_sample")).select("file_id", F.col("height").cast("long").alias("height"), "share")


# Names

@query("f7_ids_from_name", r"SELECT name_id, NULLIF(regexp_extract(name, '(?i)\[tmdbid-(\d+)\]', 1), '') AS tmdb, NULLIF(regexp_extract(name, '(?i)\[imdbid-(tt\d+)\]', 1), '') AS imdb, try_cast(regexp_extract(name, '\(((?:19|20)\d{2})\)', 1) AS BIGINT) AS year FROM v_name")
def f7(spark, d):
    return view(spark, d, "v_name").withColumn("i", N.ids_from_name(F.col("name"))).select("name_id", "i.tmdb", "i.imdb", F.col("i.year").cast("long").alias("year"))


@query("f8_title_before_ids", r"SELECT name_id, trim(regexp_replace(regexp_replace(name, '(?i)\[(?:tmdbid-\d+|imdbid-tt\d+|tvdbid-\d+)\]|\((?:19|20)\d{2}\)', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM v_name")
def f8(spark, d):
    return view(spark, d, "v_name").select("name_id", N.title_before_ids(F.col("name")).alias("title"))


@query("f2_to_filename", r"SELECT name_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(name, '[—–]', ' - ', 'g'), '/', '-'), '[\\:*?\"<>|]', '', 'g'), '\s+', ' ', 'g')) AS file_name FROM v_name")
def f2(spark, d):
    return view(spark, d, "v_name").select("name_id", N.to_filename(F.col("name")).alias("file_name"))


@query("f5_match_key", r"SELECT name_id, regexp_replace(trim(regexp_replace(lower(regexp_replace(replace(name, '&', ' and '), '[^0-9A-Za-z ]+', ' ', 'g')), '\s+', ' ', 'g')), '^the (.)', '\1') AS key FROM v_name")
def f5(spark, d):
    return view(spark, d, "v_name").select("name_id", N.match_key(F.col("name")).alias("key"))


@query("f6_validate_component", r"SELECT name_id, concat_ws(',', CASE WHEN contains(name, '/') THEN 'unsafe-/' END, CASE WHEN contains(name, ':') THEN 'unsafe-:' END, CASE WHEN contains(name, '?') THEN 'unsafe-?' END, CASE WHEN regexp_matches(name, '[. ]$') THEN 'trailing-period-or-space' END) AS problems FROM v_name")
def f6(spark, d):
    return view(spark, d, "v_name").select("name_id", F.array_join(N.validate_component(F.col("name")), ",").alias("problems"))


@query("p14_pedigree", r"SELECT name_id, CASE WHEN regexp_matches(regexp_extract(name, '[^/]*$'), '(?i)\bremux\b') THEN 'remux' WHEN regexp_matches(regexp_extract(name, '[^/]*$'), '(?i)\b(?:web-?dl|web-?rip|amzn|nf|dsnp|hmax|atvp)\b') THEN 'web' WHEN regexp_matches(regexp_extract(name, '[^/]*$'), '(?i)\b(?:blu-?ray|bdrip|brrip|dvdrip|hdtv|[xh]26[45]|hevc|avc)\b') THEN 'encode' END AS pedigree FROM v_name")
def p14(spark, d):
    return view(spark, d, "v_name").select("name_id", G.pedigree(F.col("name")).alias("pedigree"))


@query("f19_parse_episode")
def f19(spark, d):
    p = view(spark, d, "v_name").withColumn("p", N.parse_episode(F.col("name")))
    return p.select("name_id", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("season", "first", "last")])


@query("f14_edition")
def f14(spark, d):
    return view(spark, d, "v_name").select("name_id", N.edition_from_name(F.col("name")).alias("edition"), N.strip_edition(F.col("name")).alias("without"))


@query("f27_movie_readings")
def f27(spark, d):
    return N.with_movie_readings(view(spark, d, "v_name"), readings=F.col("name")).select("name_id", F.inline_outer("readings"))


@query("f22_classify")
def f22(spark, d):
    return view(spark, d, "v_name").select("name_id", N.classify(F.col("name")).alias("kind"))


@query("f17_movie_folder", "SELECT file_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) || ' (' || year || ') [tmdbid-' || tmdb || '] [imdbid-tt' || file_id || ']' AS folder FROM v_file")
def f17(spark, d):
    return _files(spark, d).select("file_id", N.movie_folder(F.col("title"), F.col("year"), F.col("tmdb"), F.col("file_id").cast("string")).alias("folder"))


@query("f18_episode_filename", "SELECT file_id, show || ' - S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || ' - ' || title || '.mkv' AS name FROM v_file")
def f18(spark, d):
    f = F.col
    return _files(spark, d).select("file_id", N.episode_filename(f("show"), f("season"), f("episode"), f("title")).alias("name"))


@query("p63_publish_path", "SELECT file_id, CASE kind WHEN 'movie' THEN title || ' (' || year || ') [tmdbid-' || tmdb || ']/' || title || ' (' || year || ').mkv' ELSE show || ' (' || year || ') [tmdbid-' || tmdb || ']/Season ' || lpad(CAST(season AS VARCHAR), 2, '0') || '/' || show || ' - S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || ' - ' || title || '.mkv' END AS path FROM v_file")
def p63(spark, d):
    none = F.lit(None).cast("string")
    rows = _files(spark, d).withColumns({"imdb": none, "tvdb": none, "show_year": F.col("year"), "episode_last": F.lit(None).cast("int"), "edition": none, "manual": F.lit(True)})
    return rows.select("file_id", state.publish_path().alias("path"))


@query("f23_parse_marker", r"SELECT ordinal, CASE WHEN regexp_matches(title, '(?i)\s*\(\d+\)\s*$') THEN trim(regexp_replace(title, '\s*\(\d+\)\s*$', '')) WHEN regexp_matches(title, '(?i), Part Two$') THEN regexp_replace(title, ', Part Two$', '') ELSE title END AS base, CAST(CASE WHEN title LIKE '%(1)' THEN 1 WHEN title LIKE '%(2)' OR title LIKE '%, Part Two' THEN 2 END AS BIGINT) AS number FROM v_episode")
def f23(spark, d):
    return view(spark, d, "v_episode").withColumn("m", N.parse_marker(F.col("title"))).select("ordinal", "m.base", F.col("m.number").cast("long").alias("number"))


@query("f44_url_key", "SELECT page_id, sha256(url) AS key FROM pages")
def f44(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", G.url_key(F.col("url")).alias("key"))


# Episodes

@query("a10_season_counts", "SELECT show, CAST(season AS BIGINT) AS season, count(*) AS n FROM v_episode GROUP BY show, season")
def a10(spark, d):
    return episodes.season_counts(view(spark, d, "v_episode")).withColumn("season", F.col("season").cast("long"))


@query(
    "w5_exact_index",
    r"WITH k AS (SELECT *, regexp_replace(trim(regexp_replace(lower(regexp_replace(title, '[^0-9A-Za-z ]+', ' ', 'g')), '\s+', ' ', 'g')), '^the (.)', '\1') AS key FROM v_episode) SELECT show, key, min(ordinal) AS ordinal FROM k GROUP BY show, key",
)
def w5(spark, d):
    return episodes.exact_index(view(spark, d, "v_episode")).select("show", "key", "ordinal")


@query("w4_base_index")
def w4(spark, d):
    return episodes.base_index(view(spark, d, "v_episode")).select("show", "base", "season", "episode", "ordinal")


def _probes(spark, d):
    c = view(spark, d, "v_episode")
    text = F.when(F.col("ordinal") % 4 == 0, F.upper("title")).when(F.col("ordinal") % 4 == 1, F.concat("title", F.lit(" extra words here"))).when(F.col("ordinal") % 4 == 2, F.regexp_replace("title", "e", "a")).otherwise(F.col("title"))
    return c.select(F.col("ordinal").alias("probe_id"), "show", text.alias("text"), "season", F.col("episode").alias("first"))


@query("j9_match_exact")
def j9(spark, d):
    return episodes.match_exact(_probes(spark, d), view(spark, d, "v_episode")).select("probe_id", "rung", "hit.season", "hit.episode", "hit.title")


@query("j10_match_contained")
def j10(spark, d):
    return episodes.match_contained(_probes(spark, d), view(spark, d, "v_episode")).select("probe_id", "hit.season", "hit.episode", F.round("share", 6).alias("share"), "accepted")


@query("j11_match_fuzzy")
def j11(spark, d):
    c = view(spark, d, "v_episode")
    rest = episodes.match_exact(_probes(spark, d), c).where("hit is null").select("probe_id", "show", "text")
    return episodes.match_fuzzy(rest, c).select("probe_id", "hit.season", "hit.episode", F.round("score", 6).alias("score"))


@query("j12_match_number", "WITH c AS (SELECT show, season, episode, min(title) AS title FROM v_episode GROUP BY ALL) SELECT f.file_id, c.title, CASE WHEN c.title IS NOT NULL THEN 'number' WHEN f.file_id % 2 = 0 THEN 'unlisted' ELSE 'none' END AS method FROM v_file f LEFT JOIN c ON c.show = f.show AND c.season = f.season AND c.episode = f.episode + 3")
def j12(spark, d):
    p = _files(spark, d).select("file_id", "show", "season", (F.col("episode") + 3).alias("first"), (F.col("file_id") % 2 == 0).alias("weak"))
    return episodes.match_number(p, view(spark, d, "v_episode")).select("file_id", "hit.title", "method")


@query("j13_episode_range")
def j13(spark, d):
    m = _files(spark, d).select("file_id", "show", "season", "episode", "title", (F.col("file_id") % 3).cast("int").alias("span"), "duration_s")
    return episodes.episode_range(m, view(spark, d, "v_episode"))


#: A vocabulary with one group, beside the built-in words and media sources.
SPARKS = Vocabulary(groups=frozenset({"sparks"}))


def _episode_files(spark, d):
    path = F.concat_ws("/", F.lit("lib"), "show", F.concat(F.lit("Season 0"), F.col("season").cast("string")), F.concat(N.episode_filename(F.col("show"), F.col("season"), F.col("episode"), F.col("title"))))
    return _files(spark, d).select("file_id", "show", path.alias("path"), F.lit(None).cast("string").alias("segment_title"), "season", F.col("episode").alias("first"), F.col("episode").alias("last"), F.lit(False).alias("weak"), "duration_s")


def _told_files(spark, d):
    """Files whose titles are told whole, with an ending, by the segment only, misspelt, too long, not at all, or with a part."""
    k, title = F.col("file_id") % 12, F.col("title")
    own = (
        F.when(k < 2, title).when(k == 2, F.concat(title, F.lit(" PDTV-SPARKS"))).when(k.isin(3, 4), F.lit("zzzz qqqq")).when(k == 5, F.concat(title, F.lit("x"))).when(k.isin(6, 7), F.concat(title, F.lit(" aa bb cc dd")))
        .when(k == 8, F.lit("zzzz qqqq")).when(k == 9, F.concat(title, F.lit(" (2)"))).when(k == 10, F.concat(title, F.lit(", Part Two (1080p)"))).otherwise(F.concat("show", F.lit(" "), title))
    )
    segment = F.when(k == 3, F.concat(title, F.lit(" extra words"))).when(k == 4, F.concat(title, F.lit(" [TVRip]")))
    path = F.concat_ws("/", F.lit("lib"), "show", F.concat(F.lit("Season 0"), F.col("season").cast("string")), F.concat(N.episode_filename(F.col("show"), F.col("season"), F.col("episode"), own)))
    return _files(spark, d).select("file_id", "show", path.alias("path"), segment.alias("segment_title"), "season", F.col("episode").alias("first"), F.col("episode").alias("last"), (k == 8).alias("weak"), "duration_s")


@query("j26_match_episodes")
def j26(spark, d):
    return episodes.match_episodes(_told_files(spark, d), view(spark, d, "v_episode"), vocab=SPARKS).select("file_id", "method", "hit.season", "hit.episode", F.round("score", 6).alias("score"))


@query("j27_identify_tv")
def j27(spark, d):
    return episodes.identify_tv(_told_files(spark, d), view(spark, d, "v_episode"), SPARKS).withColumn("score", F.round("score", 6))


# Identity

def _entities(spark, d):
    return _files(spark, d).select("tmdb", F.concat(F.lit("tt"), "tmdb").alias("imdb"), F.lit(None).cast("string").alias("tvdb"), F.col("title").alias("label"), "year")


def _entity_names(spark, d):
    return _entities(spark, d).select("tmdb", F.col("label").alias("name"))


@query(
    "j14_resolve_ids",
    "SELECT file_id AS title_id, tmdb, title AS label FROM v_file WHERE file_id % 3 <> 2",
)
def j14(spark, d):
    f = _files(spark, d)
    none = F.lit(None).cast("string")
    tmdb = F.when(F.col("file_id") % 3 != 1, F.col("tmdb"))
    imdb = F.when(F.col("file_id") % 3 == 1, F.concat(F.lit("tt"), "tmdb")).when(F.col("file_id") % 3 == 2, "tt0")
    return resolve.resolve_ids(f.select(F.col("file_id").alias("title_id"), tmdb.alias("tmdb"), imdb.alias("imdb"), none.alias("tvdb")), _entities(spark, d)).select("title_id", "tmdb", "label")


@query("j15_search_candidates")
def j15(spark, d):
    return resolve.search_candidates(_files(spark, d).where("kind = 'movie'").select(F.col("file_id").alias("title_id"), F.col("title").alias("name")), _entity_names(spark, d)).select("title_id", "tmdb", "shared", "rank")


@query("f29_w10_candidates")
def w10(spark, d):
    reads = _files(spark, d).where("kind = 'movie'").select(F.col("file_id").alias("title_id"), F.col("title").alias("name"), F.col("year").alias("name_year"))
    names = _entity_names(spark, d)
    dated = names.join(_entities(spark, d).select("tmdb", F.col("year").alias("entity_year")), "tmdb")
    hits = resolve.scored_candidates(reads, dated)
    scored = hits.join(_entities(spark, d).select("tmdb", F.col("year").alias("entity_year")), "tmdb").join(reads.select("title_id", "name_year"), "title_id")
    return resolve.top_candidates(scored.withColumns({"complete": F.lit(True), "pinned": F.lit(False)})).select("title_id", "tmdb", F.round("score", 6).alias("score"), "tied")


def _rungs(spark, d):
    f = _files(spark, d)
    rung = lambda place, name, by_id, tmdb: f.select(F.col("file_id").alias("title_id"), F.lit(place).alias("place"), F.lit(name).alias("rung"), F.lit(by_id).alias("by_id"), tmdb.alias("tmdb"), (F.col("file_id") % 7 != 0).alias("complete"))
    own = F.col("tmdb")
    return rung(0, "tag", True, own).unionByName(rung(1, "folder ids", True, F.when(F.col("file_id") % 5 == 0, "x").otherwise(own))).unionByName(rung(2, "file name", False, F.when(F.col("file_id") % 2 == 0, "y").otherwise(own)))


@query("a15_identity_votes", "SELECT file_id AS title_id, CASE WHEN file_id % 7 = 0 THEN 'incomplete' WHEN file_id % 5 = 0 THEN 'disagreement' ELSE 'resolved' END AS outcome, CASE WHEN file_id % 7 = 0 OR file_id % 5 <> 0 THEN tmdb END AS tmdb FROM v_file")
def a15(spark, d):
    return resolve.identity_votes(_rungs(spark, d)).select("title_id", "outcome", "tmdb")


@query("a21_best_guess", "SELECT file_id AS title_id, e AS tmdb FROM v_file, (VALUES ('a'), ('b'), ('c')) t(e) WHERE CASE e WHEN 'a' THEN 1 WHEN 'b' THEN file_id % 2 ELSE 0 END = 1")
def a21(spark, d):
    f = _files(spark, d).select(F.col("file_id").alias("title_id"))
    rows = f.withColumn("tmdb", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    score = F.when(F.col("tmdb") == "a", 1.0).when(F.col("tmdb") == "b", F.col("title_id") % 2).otherwise(0.0)
    return resolve.best_guess(rows.withColumn("score", score)).select("title_id", "tmdb")


@query(
    "j2_movie_incumbents",
    r"""WITH n AS (SELECT name_id AS i, name, NULLIF(regexp_extract(name, '\[tmdbid-(\d+)\]', 1), '') AS t, NULLIF(regexp_extract(name, '\[imdbid-(tt\d+)\]', 1), '') AS m, regexp_extract(name, '^(.*?\(\d{4}\))', 1) AS k FROM v_name),
q AS (SELECT f.file_id AS i, f.title || ' (' || f.year || ')' AS k, CASE f.file_id % 5 WHEN 0 THEN CAST(f.file_id AS VARCHAR) WHEN 2 THEN '0' WHEN 3 THEN '0' END AS t, CASE WHEN f.file_id % 5 IN (1, 2) THEN 'tt' || (1000000 + f.file_id) END AS m FROM v_file f),
by_id AS (SELECT q.i, min(n.name) AS folder FROM q JOIN n ON n.t = q.t OR (n.m = q.m AND NOT coalesce(q.t <> n.t, false)) GROUP BY q.i),
by_name AS (SELECT q.i, min(n.name) AS folder FROM q JOIN n ON n.k = q.k AND NOT coalesce(q.t <> n.t, false) AND NOT coalesce(q.m <> n.m, false) WHERE q.i NOT IN (SELECT i FROM by_id) GROUP BY q.i)
SELECT i AS title_id, folder, 'id' AS "by" FROM by_id UNION ALL SELECT i, folder, 'name' FROM by_name""",
)
def j2(spark, d):
    n = view(spark, d, "v_name").select("name_id", F.col("name").alias("folder"))
    i, none = F.col("name_id"), F.lit(None).cast("string")
    tmdb = F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 2, "0").when(i % 5 == 3, "0")
    imdb = F.when(i % 5 == 1, F.concat(F.lit("TT"), (i + 1000000).cast("string"))).when(i % 5 == 2, F.concat(F.lit("tt"), (i + 1000000).cast("string"))).otherwise(none)
    v = _files(spark, d).select(F.col("file_id").alias("name_id"), "title", "year")
    # by five: tmdb; imdb; imdb of a folder with another tmdb; another tmdb only; no id, only the name
    ids = n.join(v, "name_id").select(i.alias("title_id"), "title", "year", tmdb.alias("tmdb"), imdb.alias("imdb"))
    files = n.select("folder", F.concat("folder", F.lit(".mkv")).alias("name"))
    return resolve.movie_incumbents(ids, n.select("folder"), files).select("title_id", "folder", "by")


@query("f32_trailing_drops")
def f32(spark, d):
    i = F.col("file_id")
    tail = F.when(i % 4 == 0, "").when(i % 4 == 1, " the third").when(i % 4 == 2, " of the old days").otherwise(" x")
    name = F.concat(F.when(i % 4 == 3, "The ").otherwise(""), "title", tail)
    return resolve.trailing_drops(_files(spark, d).select(i.alias("title_id"), name.alias("name"), F.when(i % 5 != 0, F.col("year")).cast("int").alias("year")))


# Readiness and verification

@query("p48_verify", "SELECT file_id AS title_id, len(list_filter([file_id % 4 = 1, file_id % 4 = 2, file_id % 4 = 3], lambda x: x)) = 0 AS ok FROM v_file")
def p48(spark, d):
    f = _files(spark, d).select(F.col("file_id").alias("title_id"), F.lit(1000).alias("packets"), F.lit(100.0).alias("duration_s"))
    out = f.select("title_id", F.when(F.col("title_id") % 4 == 1, 999).otherwise(1000).alias("packets"), F.when(F.col("title_id") % 4 == 2, 90.0).otherwise(100.0).alias("duration_s"))
    pairs = verify.pair_outputs(f, out).withColumns({"telecine": F.lit(False), "statistics_ratio": F.when(F.col("title_id") % 4 == 3, 0.2).otherwise(1.0)})
    return verify.verify(pairs).select("title_id", "ok")


def _tags(spark, d):
    f = _files(spark, d).select(F.concat(F.lit("f/"), F.col("file_id").cast("string")).alias("path"), "file_id", "title", "tmdb")
    rows = F.array(
        *[F.struct(F.lit(t).alias("target_type"), F.lit(n).alias("name"), v.alias("value")) for t, n, v in (("MOVIE", "TITLE", F.col("title")), ("MOVIE", "TMDB", F.col("tmdb")), ("MOVIE", "IMDB", F.when(F.col("file_id") % 3 == 0, "").otherwise(F.lit("tt1"))), ("MOVIE", "DATE_RELEASED", F.lit("1999-01-02")), ("", "NOTE", F.lit("kept")), ("", "ENCODER", F.lit("dropped")))]
    )
    return f.select("path", F.lit("movie").alias("kind"), F.posexplode(rows).alias("tag_no", "r")).select("path", "kind", "tag_no", F.lit(False).alias("track_targeted"), "r.*")


@query("p36_tag_identity", "SELECT 'f/' || file_id AS path, title, tmdb, CASE WHEN file_id % 3 = 0 THEN NULL ELSE 'tt1' END AS imdb, CAST(1999 AS BIGINT) AS year FROM v_file")
def p36(spark, d):
    return audit.tag_identity(_tags(spark, d)).select("path", "title", "tmdb", "imdb", F.col("year").cast("long").alias("year"))


@query("p42_tag_problems_movie", "SELECT 'f/' || file_id AS path, CASE WHEN file_id % 3 = 0 THEN 'MOVIE tag lacks IMDB' ELSE '' END AS problems FROM v_file")
def p42(spark, d):
    expected = _files(spark, d).select(F.concat(F.lit("f/"), F.col("file_id").cast("string")).alias("path"), "title")
    return verify.tag_problems_movie(_tags(spark, d), expected).select("path", F.array_join("problems", "; ").alias("problems"))


@query("p30_movie_naming")
def p30(spark, d):
    path = F.concat_ws("/", F.lit("lib"), F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.concat("title", F.lit(".mkv")))
    rows = _files(spark, d).select("file_id", path.alias("path"), "title", "year", "tmdb", F.lit(None).cast("string").alias("imdb"))
    return audit.movie_naming_checks(rows).select("file_id", F.inline("checks")).select("file_id", "check", "expected", "actual", "ok")


@query("p31_tv_naming")
def p31(spark, d):
    rows = _episode_files(spark, d).join(_files(spark, d).select("file_id", "title", "tmdb", "episode"), "file_id").withColumn("tvdb", F.lit("9"))
    return audit.tv_naming_checks(rows).select("file_id", F.inline("checks")).select("file_id", "check", "expected", "actual", "ok")


@query("p32_component_check", r"SELECT name_id, NOT (regexp_matches(name, '[:?]') OR regexp_matches(name, '[. ]$') OR regexp_matches(name, ' /')) AS ok FROM v_name")
def p32(spark, d):
    return view(spark, d, "v_name").select("name_id", audit.component_check(F.col("name"), F.lit("movie"))["ok"].alias("ok"))


# Streams' batch twins

@query("w9_stable_polls", "SELECT event_id FROM (SELECT event_id, size, quiet_s, lag(size) OVER (PARTITION BY path ORDER BY polled_at, event_id) AS b FROM v_poll) WHERE quiet_s >= 30 AND b = size")
def w9(spark, d):
    return jobs.stable_polls(view(spark, d, "v_poll")).select("event_id")


@query("t1_first_stable", "SELECT path, arg_min(size, (polled_at, event_id)) AS size FROM (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY polled_at, event_id) AS b FROM v_poll) WHERE quiet_s >= 30 AND b = size GROUP BY path")
def t1(spark, d):
    return jobs.first_stable(view(spark, d, "v_poll")).select("path", "size")


@query("t2_current_stage", "SELECT title_id, arg_max(stage, (at, event_id)) AS stage FROM v_history GROUP BY title_id")
def t2(spark, d):
    return jobs.current_stage(view(spark, d, "v_history")).select("title_id", "stage")


@query(
    "t6_lockouts",
    """WITH c AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY key ORDER BY at, event_id ROWS UNBOUNDED PRECEDING) AS g FROM v_login),
f AS (SELECT *, lag(at, 2) OVER (PARTITION BY key, g ORDER BY at, event_id) AS nth FROM c WHERE failed)
SELECT event_id, key FROM f WHERE at - nth < INTERVAL 864000 SECOND""",
)
def t6(spark, d):
    return jobs.lockouts(view(spark, d, "v_login"), 3, 864_000).select("event_id", "key")


@query("t5_due_holds")
def t5(spark, d):
    h = view(spark, d, "v_history").where("stage = 'HELD'").select("title_id", F.col("at").cast("timestamp").alias("at"))
    return jobs.due_holds(h.withColumn("retry_after", F.col("at") + F.expr("interval 1 day")), F.lit("2030-01-01").cast("timestamp")).select("title_id", F.unix_timestamp("retry_after").alias("due"))


@query("t3_progress_blocks")
def t3(spark, d):
    e = view(spark, d, "v_poll")
    lines = F.array(F.concat(F.lit("frame="), F.col("size").cast("string")), F.lit("fps=25"), F.lit("total=1000000"), F.lit("progress=continue"))
    rows = e.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("title_id"), "event_id", F.posexplode(lines).alias("i", "line"))
    return jobs.progress_blocks(rows.select("title_id", (F.col("event_id") * 4 + F.col("i")).alias("seq"), "line"))


# the other groups register themselves
from . import identity, probes, reports, titles  # noqa: E402, F401
