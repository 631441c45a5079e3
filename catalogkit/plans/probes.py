"""Registered queries of sources, sinks and probe documents: documents are built from the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import helpers as H
from ..operators import probe, standards
from ..operators.settle import shared_folder
from ..sources import readers, sinks
from .adapters import view
from .base import files, oracle, query

C = F.col


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/made-{uuid.uuid4().hex}"


def _documents(spark, d) -> DataFrame:
    """path and body: a probe document of each file, as its tool writes it."""
    f = files(spark, d)
    i = C("file_id")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    light = F.struct(F.lit("Content light level metadata").alias("side_data_type"), (i % 1000).alias("max_content"), (i % 400).alias("max_average"))
    record = F.struct(F.lit("DOVI configuration record").alias("side_data_type"), (i % 9).cast("int").alias("dv_profile"), F.lit(6).alias("dv_level"))
    screen = F.struct(F.lit("Mastering display metadata").alias("side_data_type"), F.concat(text(i % 50000), F.lit("/50000")).alias("red_x"), F.lit("10000000/10000").alias("max_luminance"))
    side = F.concat_ws(",", F.when(C("hdr"), F.to_json(light)), F.when(C("dolby_vision"), F.to_json(record)), F.when(i % 2 == 0, F.to_json(screen)))
    video = F.struct(
        F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.upper("codec").alias("codec_name"), "width", "height", F.when(C("sar") > 1, "3:2").when(i % 5 == 1, "0:1").otherwise("1:1").alias("sample_aspect_ratio"),
        F.when(C("bit_depth") == 10, "yuv420p10le").otherwise("yuv420p").alias("pix_fmt"), F.concat(text(C("frame_rate").cast("int")), F.lit("/1")).alias("r_frame_rate"), text(C("bitrate")).alias("bit_rate"),
        F.when(C("hdr"), "bt2020").when(i % 3 == 0, "unknown").when(i % 3 == 1, "bt709").otherwise(none).alias("color_primaries"), F.when(C("hdr") & (i % 4 == 0), "smpte2084").when(C("hdr") & (i % 8 == 2), "arib-std-b67").otherwise("bt709").alias("color_transfer"),
        F.when(i % 5 == 0, F.create_map(F.lit("BPS-eng"), text(i * 1000))).when(i % 5 == 1, F.create_map(F.lit("number_of_bytes"), text(C("size_bytes")), F.lit("NUMBER_OF_FRAMES"), text(i * 7))).otherwise(F.create_map(F.lit("language"), F.lit("ENG"))).alias("tags"),
        F.when(i % 7 == 0, "0").otherwise(text(i * 3)).alias("nb_frames"), F.when(i % 6 != 0, text(C("duration_s"))).alias("duration"),
    )
    one = lambda k, kind, codec, **more: F.struct(F.lit(k).alias("index"), F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"), *[v.alias(n) for n, v in more.items()])
    tags = lambda lang: F.create_map(F.lit("language"), lang, F.lit("title"), F.concat(F.lit("t"), text(i)))
    flag = lambda name, on: F.create_map(F.lit(name), F.when(on, 1).otherwise(0))
    parts = [
        F.when(i % 11 != 0, F.regexp_replace(F.to_json(video), r"\}$", "")), F.when(i % 3 == 0, F.to_json(one(1, "video", "MJPEG", width=F.lit(600), height=F.lit(900)))),
        F.to_json(one(2, "audio", "AAC", channels=F.when(i % 4 != 0, 2 + i % 4), tags=tags(F.when(i % 2 == 0, "ENG").otherwise("fre")), disposition=flag("default", i % 2 == 0))),
        F.when(i % 2 == 1, F.to_json(one(3, "subtitle", "SUBRIP", disposition=flag("forced", i % 4 == 1)))), F.when(i % 13 == 0, F.to_json(one(4, "attachment", "TTF"))),
    ]
    parts[0] = F.concat(parts[0], F.lit(',"side_data_list":['), side, F.lit("]}"))
    head = F.struct(F.lit("matroska,webm").alias("format_name"), text(C("duration_s")).alias("duration"), text(C("size_bytes")).alias("size"), F.create_map(F.lit("title"), F.when(i % 2 == 0, C("title")).otherwise(" ")).alias("tags"))
    chapters = F.to_json(F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.struct(k.alias("id"))))
    body = F.concat(F.lit('{"streams":['), F.concat_ws(",", *parts), F.lit('],"format":'), F.to_json(head), F.lit(',"chapters":'), chapters, F.lit("}"))
    return f.select(F.concat(F.lit("lib/"), text(i), F.lit(".mkv")).alias("path"), body.alias("body"))


def _probed(spark, d) -> DataFrame:
    return probe.container_summary(readers.parse_ffprobe(_documents(spark, d), "body"))


_PATH = "'lib/' || file_id || '.mkv' AS path"


@query("s3_read_ffprobe", f"SELECT {_PATH}, CAST((file_id % 11 <> 0)::INT + (file_id % 3 = 0)::INT + 1 + (file_id % 2 = 1)::INT + (file_id % 13 = 0)::INT AS BIGINT) AS streams, CAST(1 + file_id % 4 AS BIGINT) AS chapters, CAST(duration_s AS VARCHAR) AS duration FROM v_file")
def s3(spark, d):
    folder = _scratch(spark)
    docs = _documents(spark, d)
    docs.select(F.to_json(F.struct("path", "body")).alias("value")).write.text(folder)
    again = spark.read.schema("path string, body string").json(folder)
    return readers.parse_ffprobe(again, "body").select("path", F.size("streams").cast("long").alias("streams"), F.size("chapters").cast("long").alias("chapters"), F.col("format.duration").alias("duration"))


@query(
    "s4_identify_tracks",
    "SELECT 'lib/' || file_id || '.mkv' AS path, track_no AS id, type, coalesce(language, 'und') AS language, is_default, forced, name FROM v_track",
)
def s4(spark, d):
    t = view(spark, d, "v_track")
    properties = F.struct(F.concat(F.lit("A_"), F.upper("codec")).alias("codec_id"), "language", C("is_default").alias("default_track"), C("forced").alias("forced_track"), C("name").alias("track_name"))
    one = F.struct(C("track_no").alias("id"), "type", properties.alias("properties"))
    docs = t.groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("tracks"))
    folder = _scratch(spark)
    docs.select(F.to_json(F.struct(F.concat(F.lit("lib/"), C("file_id").cast("string"), F.lit(".mkv")).alias("path"), "tracks")).alias("value")).write.text(folder)
    again = spark.read.schema(f"path string, {probe.IDENTIFY_SCHEMA}").json(folder)
    return readers.identify_tracks(again).select("path", C("id").cast("long").alias("id"), "type", "language", "is_default", "forced", "name")


@query("s5_packet_sizes", "SELECT CAST(count(x) AS BIGINT) AS lines, CAST(sum(x) AS BIGINT) AS bytes FROM (SELECT try_cast(line AS BIGINT) AS x FROM v_packet)")
def s5(spark, d):
    folder = _scratch(spark)
    view(spark, d, "v_packet").select(F.concat("line", F.lit(",")).alias("value")).write.text(folder)
    return readers.read_packet_sizes(spark, folder).agg(F.count("size").alias("lines"), F.sum("size").alias("bytes"))


@query(
    "p1_split_streams",
    f"SELECT {_PATH}, CASE WHEN file_id % 11 <> 0 THEN upper(codec) END AS video, CAST((file_id % 3 = 0)::INT AS BIGINT) AS covers, CAST(1 AS BIGINT) AS audio, CAST((file_id % 2 = 1)::INT AS BIGINT) AS subtitles, CAST((file_id % 13 = 0)::INT AS BIGINT) AS other, CASE WHEN file_id % 11 = 0 THEN 'no decodable video stream' END AS error FROM v_file",
)
def p1(spark, d):
    s = probe.split_streams(readers.parse_ffprobe(_documents(spark, d), "body"))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return s.select("path", C("video.codec_name").alias("video"), n("cover_art", "covers"), n("audio", "audio"), n("subtitles", "subtitles"), n("other", "other"), "error")


@query(
    "p2_video_summary",
    f"""SELECT {_PATH}, codec, CAST(CASE WHEN sar > 1 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS sar, CAST(round_even(width * sar, 0) AS BIGINT) AS display_width, CAST(round_even(width * sar, 0) * height AS BIGINT) AS display_pixels,
  round(round_even(width * sar, 0) / height, 6) AS display_aspect, CAST(bit_depth AS BIGINT) AS bit_depth, CAST(24 * pow(2, bit_depth - 8) AS BIGINT) AS crop_limit, frame_rate, CASE WHEN file_id % 5 IN (0, 1) THEN 'und' ELSE 'eng' END AS language
FROM v_file WHERE file_id % 11 <> 0""",
)
def p2(spark, d):
    v = C("video")
    rows = _probed(spark, d).where("video is not null")
    return rows.select(
        "path", v["codec"].alias("codec"), v["sar"].alias("sar"), v["display_width"].alias("display_width"), v["display_pixels"].cast("long").alias("display_pixels"), F.round(v["display_aspect"], 6).alias("display_aspect"),
        v["bit_depth"].cast("long").alias("bit_depth"), v["cropdetect_limit"].alias("crop_limit"), v["frame_rate"].alias("frame_rate"), v["language"].alias("language"),
    )


@query(
    "p3_track_summaries",
    f"""SELECT {_PATH}, 'aac' AS audio_codec, CAST(CASE WHEN file_id % 4 <> 0 THEN 2 + file_id % 4 ELSE 0 END AS BIGINT) AS channels, CASE WHEN file_id % 2 = 0 THEN 'eng' ELSE 'fre' END AS audio_language, 't' || file_id AS audio_title, file_id % 2 = 0 AS audio_default,
  CASE WHEN file_id % 2 = 1 THEN 'subrip' END AS subtitle_codec, CASE WHEN file_id % 2 = 1 THEN 'und' END AS subtitle_language, CASE WHEN file_id % 2 = 1 THEN file_id % 4 = 1 END AS forced, CASE WHEN file_id % 3 = 0 THEN 'mjpeg' END AS cover, CASE WHEN file_id % 13 = 0 THEN 'ttf' END AS other FROM v_file""",
)
def p3(spark, d):
    first = lambda c: F.try_element_at(C(c), F.lit(1))
    a, s = first("audio"), first("subtitles")
    return _probed(spark, d).select(
        "path", a["codec"].alias("audio_codec"), a["channels"].cast("long").alias("channels"), a["language"].alias("audio_language"), a["title"].alias("audio_title"), a["default"].alias("audio_default"),
        s["codec"].alias("subtitle_codec"), s["language"].alias("subtitle_language"), s["forced"].alias("forced"), first("cover_art")["codec"].alias("cover"), first("other")["codec"].alias("other"),
    )


@query(
    "p4_hdr",
    f"""SELECT {_PATH}, hdr, CASE WHEN hdr AND file_id % 4 = 0 THEN 'hdr10' WHEN hdr AND file_id % 8 = 2 THEN 'hlg' WHEN hdr THEN 'bt2020' ELSE 'none' END AS hdr_format, hdr OR file_id % 3 = 1 AS tagged FROM v_file WHERE file_id % 11 <> 0""",
)
def p4(spark, d):
    v = C("video")
    return _probed(spark, d).where("video is not null").select("path", v["hdr"].alias("hdr"), v["hdr_format"].alias("hdr_format"), v["colour_tagged"].alias("tagged"))


@query(
    "p5_side_data",
    f"""SELECT {_PATH}, dolby_vision, CAST(CASE WHEN dolby_vision THEN file_id % 9 END AS BIGINT) AS profile, round(CASE WHEN file_id % 2 = 0 THEN (file_id % 50000) / 50000.0 END, 6) AS red_x, CAST(CASE WHEN file_id % 2 = 0 THEN 1000 END AS DOUBLE) AS max_luminance,
  CAST(CASE WHEN hdr THEN file_id % 1000 END AS BIGINT) AS max_content, CAST(CASE WHEN hdr THEN file_id % 400 END AS BIGINT) AS max_average FROM v_file WHERE file_id % 11 <> 0""",
)
def p5(spark, d):
    v = C("video")
    return _probed(spark, d).where("video is not null").select(
        "path", v["dolby_vision"].alias("dolby_vision"), v["dv"]["dv_profile"].cast("long").alias("profile"), F.round(v["mastering_display"]["red_x"], 6).alias("red_x"), v["mastering_display"]["max_luminance"].alias("max_luminance"),
        v["content_light"]["max_content"].cast("long").alias("max_content"), v["content_light"]["max_average"].cast("long").alias("max_average"),
    )


@query(
    "p8_video_bitrate",
    f"SELECT {_PATH}, CAST(CASE WHEN file_id % 5 = 0 THEN file_id * 1000 WHEN file_id % 5 = 1 AND file_id % 6 <> 0 AND duration_s > 0 THEN round_even(size_bytes * 8.0 / duration_s, 0) ELSE bitrate END AS BIGINT) AS bitrate FROM v_file WHERE file_id % 11 <> 0",
)
def p8(spark, d):
    return _probed(spark, d).where("video is not null").select("path", C("video.bitrate").alias("bitrate"))


@query("p9_frame_count", f"SELECT {_PATH}, CAST(CASE WHEN file_id % 5 = 1 THEN file_id * 7 WHEN file_id % 7 <> 0 THEN file_id * 3 END AS BIGINT) AS frames FROM v_file WHERE file_id % 11 <> 0")
def p9_frames(spark, d):
    return _probed(spark, d).where("video is not null").select("path", C("video.frame_count").alias("frames"))


@query(
    "p10_durations",
    f"SELECT {_PATH}, coalesce(duration_s, 0.0) AS duration_s, CAST(coalesce(CASE WHEN file_id % 5 = 1 THEN file_id * 7 WHEN file_id % 7 <> 0 THEN file_id * 3 END, round_even(frame_rate * duration_s, 0)) AS BIGINT) AS frames FROM v_file WHERE file_id % 11 <> 0",
)
def p10(spark, d):
    v = C("video")
    duration = G.usable_duration(v["duration"], C("container_duration"))
    return _probed(spark, d).where("video is not null").select("path", duration.alias("duration_s"), G.total_frames(v["frame_count"], v["frame_rate"], duration).alias("frames"))


@query(
    "p6_bitstream_hdr",
    """SELECT file_id, CAST(min(CASE WHEN track_no % 3 = 0 THEN track_no END) % 1000 AS BIGINT) AS max_content, CAST(min(CASE WHEN track_no % 4 = 1 THEN track_no END) AS DOUBLE) AS max_luminance, bool_or(track_no % 50 = 7) AS dv FROM v_track GROUP BY file_id""",
)
def p6(spark, d):
    n = C("track_no")
    side = "array<struct<side_data_type:string,max_content:string,max_average:string," + ",".join(f"{k}:string" for k in probe.MASTERING_KEYS) + ">>"
    parts = F.concat_ws(
        ",", F.when(n % 3 == 0, F.to_json(F.struct(F.lit("Content light level metadata").alias("side_data_type"), (n % 1000).cast("string").alias("max_content")))),
        F.when(n % 4 == 1, F.to_json(F.struct(F.lit("Mastering display metadata").alias("side_data_type"), F.concat(n.cast("string"), F.lit("/1")).alias("max_luminance")))),
        F.when(n % 50 == 7, F.to_json(F.struct(F.lit("Dolby Vision RPU Data").alias("side_data_type")))),
    )
    frames = view(spark, d, "v_track").select("file_id", n.alias("frame_no"), F.from_json(F.concat(F.lit("["), parts, F.lit("]")), side).alias("side_data_list"))
    out = probe.bitstream_hdr(frames)
    return out.select("file_id", C("content_light_bitstream.max_content").cast("long").alias("max_content"), C("mastering_bitstream.max_luminance").alias("max_luminance"), C("dv_in_bitstream").alias("dv"))


def _gaps(spark, d) -> DataFrame:
    """Files whose container declares what the bitstream carries, or a little less."""
    i = C("file_id")
    screen = lambda far: F.struct(*[(F.lit(0.3) + F.when(far, F.lit(0.001 if "lum" not in k else 0.0)).otherwise(0.0) if "lum" not in k else F.lit(1000.0) + F.when(far, 0.5).otherwise(0.0)).alias(k) for k in probe.MASTERING_KEYS])
    light = lambda c: F.struct(c.cast("int").alias("max_content"), F.lit(100).alias("max_average"))
    v = F.struct(
        F.when(i % 2 == 0, screen(F.lit(False))).alias("mastering_bitstream"), F.when(i % 6 != 0, screen(i % 4 == 0)).alias("mastering_display"),
        F.when(i % 3 == 0, light(i % 1000)).alias("content_light_bitstream"), F.when(i % 5 != 0, light(F.when(i % 9 == 0, i % 1000 + 1).otherwise(i % 1000))).alias("content_light"),
        (i % 7 == 0).alias("dv_in_bitstream"), C("dolby_vision").alias("dolby_vision"), C("hdr").alias("hdr"), F.lit("bt2020").alias("color_primaries"), F.lit(None).cast("string").alias("color_transfer"), F.lit("bt2020nc").alias("color_space"),
    )
    rows = files(spark, d).select("file_id", v.alias("video"))
    return rows.withColumn("video", C("video").withField("hdr_declaration_gap", G.hdr_gap(C("video"))))


_GAP = "CASE WHEN file_id % 2 = 0 AND (file_id % 6 = 0 OR file_id % 4 = 0) THEN 'mastering_display' END, CASE WHEN file_id % 3 = 0 AND (file_id % 5 = 0 OR file_id % 9 = 0) THEN 'content_light' END, CASE WHEN file_id % 7 = 0 AND NOT dolby_vision THEN 'dolby_vision' END"


@query("p7_hdr_gap", f"SELECT file_id, concat_ws(',', {_GAP}) AS gap FROM v_file")
def p7(spark, d):
    return _gaps(spark, d).select("file_id", F.array_join("video.hdr_declaration_gap", ",").alias("gap"))


@query(
    "p33_hdr_checks",
    f"""WITH g AS (SELECT file_id, dolby_vision, [{_GAP}] AS gap FROM v_file WHERE hdr),
r AS (SELECT file_id, unnest([{{'c': 'color primaries', 'a': 'bt2020', 'ok': true}}, {{'c': 'color transfer', 'a': NULL, 'ok': true}}, {{'c': 'color space', 'a': 'bt2020nc', 'ok': true}},
  {{'c': 'mastering display', 'a': CASE WHEN file_id % 6 = 0 THEN 'absent' WHEN file_id % 4 = 0 THEN 'L 1000.5-1000.5 cd/m2' ELSE 'L 1000-1000 cd/m2' END, 'ok': NOT coalesce(list_contains(gap, 'mastering_display'), false)}},
  {{'c': 'content light level', 'a': CASE WHEN file_id % 5 = 0 THEN 'absent' ELSE 'MaxCLL ' || (file_id % 1000 + CASE WHEN file_id % 9 = 0 THEN 1 ELSE 0 END) || ', MaxFALL 100' END, 'ok': NOT coalesce(list_contains(gap, 'content_light'), false)}},
  {{'c': 'dolby vision', 'a': CASE WHEN dolby_vision THEN 'present' ELSE 'absent' END, 'ok': NOT coalesce(list_contains(gap, 'dolby_vision'), false)}}]) AS s FROM g)
SELECT file_id, s.c AS "check", s.a AS actual, s.ok AS ok FROM r""",
)
def p33(spark, d):
    from ..operators import audit

    return _gaps(spark, d).select("file_id", audit.hdr_checks(C("video")).alias("checks")).where("checks is not null").select("file_id", F.inline("checks")).select("file_id", "check", "actual", "ok")


@query(
    "p45_hdr_loss",
    f"""WITH g AS (SELECT *, [{_GAP}] AS gap FROM v_file WHERE hdr)
SELECT file_id, concat_ws('; ', CASE WHEN len(list_filter(gap, lambda x: x IS NOT NULL)) > 0 THEN 'declared short of the bitstream: ' || array_to_string(list_filter(gap, lambda x: x IS NOT NULL), ', ') END,
  CASE WHEN file_id % 3 = 0 THEN 'color_primaries was bt2020, is unset' END, CASE WHEN file_id % 6 = 0 THEN 'mastering_display is not declared' END, CASE WHEN file_id % 5 = 0 AND file_id % 3 = 0 THEN 'content_light is not declared' END,
  CASE WHEN (dolby_vision OR file_id % 7 = 0) AND NOT dolby_vision THEN 'dolby_vision is not declared' END) AS problems FROM g""",
)
def p45(spark, d):
    from ..operators import verify

    i = C("file_id")
    rows = _gaps(spark, d).where("video.hdr").select("file_id", C("video").alias("src"), C("video").withField("color_primaries", F.when(i % 3 != 0, "BT2020")).alias("out"))
    return verify.hdr_loss(rows).select("file_id", F.array_join("problems", "; ").alias("problems"))


@query("p12_with_crop", "SELECT file_id, CAST(CASE WHEN p = 0 THEN NULL ELSE picture END AS BIGINT) AS picture_pixels, CAST(CASE WHEN p = 0 THEN NULL ELSE bars END AS BIGINT) AS letterbox_px FROM (SELECT f.file_id, file_id % 2 AS p, round_even(width * sar, 0) * (height - file_id % 50) AS picture, file_id % 50 AS bars FROM v_file f)")
def p12(spark, d):
    attrs = standards.attributes(files(spark, d), view(spark, d, "v_track")).drop("picture_pixels", "letterbox_px")
    shown = F.bround(C("width") * C("sar"))
    i = C("file_id")
    crops = files(spark, d).where("file_id % 2 = 1").select("file_id", (shown * (C("height") - i % 50)).cast("long").alias("picture_pixels"), (i % 50).alias("bars_px"), F.lit(None).cast("struct<width:int,height:int,share:double>").alias("secondary"))
    return standards.with_crop(attrs, crops).select("file_id", C("picture_pixels").cast("long").alias("picture_pixels"), C("letterbox_px").cast("long").alias("letterbox_px"))


# Texts and tables of sources

@query("s1_read_state", "SELECT 'titles' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM v_title UNION ALL SELECT 'history', count(*), CAST(sum(event_id) AS BIGINT) FROM v_history UNION ALL SELECT 'findings', count(*), CAST(sum(size) AS BIGINT) FROM v_finding UNION ALL SELECT 'settings', count(*), NULL FROM region")
def s1(spark, d):
    folder = _scratch(spark)
    tables = {
        "titles": view(spark, d, "v_title").select("id", "kind", "stage"), "history": view(spark, d, "v_history").select(C("event_id").alias("id"), "title_id", "stage"),
        "findings": view(spark, d, "v_finding").select("path", C("size").cast("long").alias("size")), "settings": spark.read.parquet(f"{d}/region.parquet").select(C("r_name").alias("key")),
    }
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    state = readers.read_state(spark, folder)
    total = {"titles": F.sum("id"), "history": F.sum("id"), "findings": F.sum("size"), "settings": F.lit(None).cast("long")}
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), total[name].alias("total")) for name, df in state.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s2_json_columns", "SELECT path, CAST(CASE WHEN checks_json = '[]' THEN 0 ELSE 1 END AS BIGINT) AS n_checks, CASE WHEN checks_json = '[]' THEN NULL ELSE 'names' END AS first_check, CAST(CASE WHEN size % 3 = 0 THEN size END AS BIGINT) AS measured, CASE WHEN checks_json = '[]' THEN '[]' ELSE '[\"names\"]' END AS back FROM v_finding")
def s2(spark, d):
    bad = F.when(C("size") % 3 == 0, F.concat(F.lit('{"size":'), C("size").cast("string"), F.lit("}"))).when(C("size") % 3 == 1, "{oops").otherwise("")
    rows = view(spark, d, "v_finding").withColumn("measured_json", bad)
    out = readers.decode_json_columns(rows.drop("measured"), {"checks": "array<string>", "measured": "struct<size:long>"})
    again = readers.encode_json_columns(out.withColumn("kept", C("checks")), ["kept"])
    return again.select("path", F.size("checks").cast("long").alias("n_checks"), F.try_element_at("checks", F.lit(1)).alias("first_check"), C("measured.size").alias("measured"), C("kept_json").alias("back"))


def _tag_rows(spark, d) -> DataFrame:
    i = C("file_id")
    rows = files(spark, d).select(
        F.concat(F.lit("f/"), i.cast("string")).alias("path"), "file_id", "kind", F.concat("title", F.lit(" <&> ")).alias("title"), F.when(i % 2 == 0, C("tmdb")).alias("tmdb"), F.concat(F.lit("tt"), C("tmdb")).alias("imdb"),
        C("year").cast("string").alias("released"), "show", F.lit(None).cast("string").alias("tvdb"), C("season").cast("string").alias("season"), C("episode").cast("string").alias("episode"),
        F.create_map(F.lit("B"), F.lit("2"), F.lit("A"), C("show")).alias("carried"),
    )
    return rows.withColumn("xml", sinks.tag_xml(rows))


_TAGS_SQL = """r AS (SELECT 'f/' || file_id AS path, CASE kind WHEN 'movie' THEN [
  {'t': 'MOVIE', 'n': 'TITLE', 'v': title || ' <&> '}, {'t': 'MOVIE', 'n': 'TMDB', 'v': CASE WHEN file_id % 2 = 0 THEN tmdb END}, {'t': 'MOVIE', 'n': 'IMDB', 'v': 'tt' || tmdb}, {'t': 'MOVIE', 'n': 'DATE_RELEASED', 'v': CAST(year AS VARCHAR)}, {'t': 'MOVIE', 'n': 'A', 'v': show}, {'t': 'MOVIE', 'n': 'B', 'v': '2'}]
  ELSE [{'t': 'COLLECTION', 'n': 'TITLE', 'v': show}, {'t': 'COLLECTION', 'n': 'TMDB', 'v': CASE WHEN file_id % 2 = 0 THEN tmdb END}, {'t': 'SEASON', 'n': 'PART_NUMBER', 'v': CAST(season AS VARCHAR)}, {'t': 'EPISODE', 'n': 'TITLE', 'v': title || ' <&> '}, {'t': 'EPISODE', 'n': 'PART_NUMBER', 'v': CAST(episode AS VARCHAR)}, {'t': 'EPISODE', 'n': 'A', 'v': show}, {'t': 'EPISODE', 'n': 'B', 'v': '2'}] END AS l FROM v_file),
tags AS (SELECT path, s.t AS target_type, s.n AS name, trim(s.v) AS value FROM (SELECT path, unnest(l) AS s FROM r) WHERE s.v IS NOT NULL)"""


@query("s13_s6_tag_xml", f"WITH {_TAGS_SQL} SELECT path, target_type, name, value FROM tags")
def s13(spark, d):
    return readers.parse_tag_xml(_tag_rows(spark, d).select("path", "xml"), "xml").select("path", "target_type", "name", F.trim("value").alias("value"))


@query("s13_tag_xml_size", "SELECT 'f/' || file_id AS path, kind, position('&lt;&amp;&gt;' IN 'x') = 0 AS escaped FROM v_file")
def s13_size(spark, d):
    x = C("xml")
    whole = F.when(C("kind") == "movie", F.contains(x, F.lit("<TargetTypeValue>50</TargetTypeValue>"))).otherwise(F.contains(x, F.lit("<TargetTypeValue>70</TargetTypeValue>")) & F.contains(x, F.lit("<TargetTypeValue>60</TargetTypeValue>")))
    return _tag_rows(spark, d).select("path", "kind", (F.contains(x, F.lit("&lt;&amp;&gt;")) & whole).alias("escaped"))


@query(
    "s7_j24_release_groups",
    "SELECT name_id, name_id % 6 = 0 AND (name_id % 9 IN (1, 3) OR name_id % 9 >= 6) AS is_group FROM v_name",
)
def s7(spark, d):
    """GRP1 and GRP3 are literal groups, GRP6 to GRP9 a pattern, as the suppliers of the table would list them."""
    folder = _scratch(spark)
    listed = spark.read.parquet(f"{d}/region.parquet").select(F.explode(F.array(F.lit("GRP1"), F.lit("grp3"), F.lit("GRP[6-9]"))).alias("value")).distinct()
    listed.write.text(f"{folder}/groups")
    spark.read.parquet(f"{d}/nation.parquet").select(F.lower("n_name").alias("value")).write.text(f"{folder}/words")
    spark.read.parquet(f"{d}/region.parquet").select(F.concat_ws("\t", "r_name", F.lower("r_name")).alias("value")).write.text(f"{folder}/sources")
    vocab = readers.read_vocab(spark, f"{folder}/sources", f"{folder}/groups", f"{folder}/words")
    from ..operators import resolve

    return resolve.with_release_group(view(spark, d, "v_name"), vocab.groups).select("name_id", "is_group")


@query("s7_read_vocab", "SELECT 'sources' AS list, count(*) AS n FROM region UNION ALL SELECT 'words', count(DISTINCT lower(n_name)) FROM nation UNION ALL SELECT 'patterns', count(*) FROM region UNION ALL SELECT 'literals', count(DISTINCT p_brand) FROM part")
def s7_vocab(spark, d):
    folder = _scratch(spark)
    region = spark.read.parquet(f"{d}/region.parquet")
    patterns = region.select(F.concat("r_name", F.lit("[0-9]+")).alias("value"))
    patterns.unionByName(spark.read.parquet(f"{d}/part.parquet").select(C("p_brand").alias("value")).distinct()).write.text(f"{folder}/groups")
    spark.read.parquet(f"{d}/nation.parquet").select(F.lower("n_name").alias("value")).write.text(f"{folder}/words")
    region.select(F.concat_ws("\t", "r_name", F.lower("r_name")).alias("value")).write.text(f"{folder}/sources")
    v = readers.read_vocab(spark, f"{folder}/sources", f"{folder}/groups", f"{folder}/words")
    n = lambda df, name: df.agg(F.lit(name).alias("list"), F.count("*").alias("n"))
    return n(v.sources, "sources").unionByName(n(v.words, "words")).unionByName(n(v.groups.where("is_pattern"), "patterns")).unionByName(n(v.groups.where("not is_pattern"), "literals"))


@query("s8_sidecars", "SELECT 'd' || file_id AS directory, file_id % 2 = 0 AS film, lower(codec) AS output_codec, CAST(CASE WHEN file_id % 3 <> 0 THEN file_id % 50 + 0.5 END AS DOUBLE) AS crf, CASE WHEN file_id % 5 = 0 THEN '0:0' END AS crop FROM v_file")
def s8(spark, d):
    i = C("file_id")
    lines = F.concat_ws("\n", F.lit("# made"), F.concat(F.lit("film = "), F.when(i % 2 == 0, "yes").otherwise("off")), F.concat(F.lit("Codec="), F.upper("codec"), F.lit(" # target")), F.concat(F.lit("crf="), F.when(i % 3 == 0, "none").otherwise((i % 50 + 0.5).cast("string"))), F.when(i % 5 == 0, "crop=0:0"))
    return readers.parse_sidecars(files(spark, d).select(F.concat(F.lit("d"), i.cast("string"), F.lit("/a.job")).alias("path"), lines.alias("body"))).select("directory", "film", "output_codec", "crf", "crop")


@query("s9_video_listing", "SELECT path FROM (SELECT 'lib/' || CASE WHEN file_id % 7 = 0 THEN '.hidden/' ELSE '' END || CASE WHEN file_id % 11 = 0 THEN '.' ELSE '' END || file_id || CASE file_id % 5 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' WHEN 2 THEN '.txt' WHEN 3 THEN '.mkv.part' ELSE '.m2ts' END AS path, file_id FROM v_file) WHERE file_id % 7 <> 0 AND file_id % 11 <> 0 AND file_id % 5 IN (0, 1, 4)")
def s9(spark, d):
    i = C("file_id")
    ending = F.when(i % 5 == 0, ".mkv").when(i % 5 == 1, ".MP4").when(i % 5 == 2, ".txt").when(i % 5 == 3, ".mkv.part").otherwise(".m2ts")
    path = F.concat(F.lit("lib/"), F.when(i % 7 == 0, ".hidden/").otherwise(""), F.when(i % 11 == 0, ".").otherwise(""), i.cast("string"), ending)
    return readers.video_listing(files(spark, d).select(path.alias("path")))


@query(
    "s10_a22_u10_catalogue",
    "SELECT show, CAST(season AS BIGINT) AS season, CAST(episode AS BIGINT) AS episode, min(title) AS title, CAST(max(runtime) AS BIGINT) AS runtime, CAST((SELECT count(*) FROM (SELECT DISTINCT show FROM v_episode)) * 2 AS BIGINT) AS names FROM v_episode GROUP BY ALL",
)
def s10(spark, d):
    """Provider documents of every show, with its seasons and episodes nested, written and read back."""
    from ..operators import episodes

    e = view(spark, d, "v_episode")
    season = e.groupBy("show", "season").agg(F.collect_list(F.struct(C("episode").cast("int").alias("episode"), "title", C("runtime").cast("int").alias("runtime"))).alias("episodes"))
    shows = season.groupBy("show").agg(F.collect_list(F.struct(C("season").cast("int").alias("season"), "episodes")).alias("seasons"))
    docs = shows.select(C("show").alias("id"), F.lit("tv").alias("kind"), C("show").alias("title"), F.concat("show", F.lit(" original")).alias("original"), F.array("show").alias("alternatives"), "seasons")
    folder = _scratch(spark)
    docs.write.json(folder)
    _, names, seasons = readers.read_catalogue(spark, folder)
    total = names.agg(F.count("*").alias("names"))
    return episodes.episode_catalogue(seasons).select("show", C("season").cast("long").alias("season"), C("episode").cast("long").alias("episode"), "title", C("runtime").cast("long").alias("runtime")).join(F.broadcast(total))


@query("s12_write_report", "SELECT file_id, kind, title, CASE WHEN file_id % 2 = 0 THEN '[\"a\",\"b\"]' ELSE '[]' END AS flags FROM v_file")
def s12(spark, d):
    folder = _scratch(spark)
    flags = F.when(C("file_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    sinks.write_report(files(spark, d).select("file_id", "kind", "title", flags.alias("flags")), folder, "csv")
    return spark.read.option("header", True).option("escape", "\\").schema("file_id long, kind string, title string, flags string").csv(folder)


# Figures of files and tracks

@query("p51_grain_class", "SELECT file_id, round_even((size_bytes - d) / size_bytes, 4) AS grain_ratio, (size_bytes - d) / size_bytes >= 0.2 AS grainy FROM (SELECT file_id, CAST(size_bytes AS DOUBLE) AS size_bytes, CAST(size_bytes - (file_id % 40) * (size_bytes // 100) AS DOUBLE) AS d FROM v_file)")
def p51(spark, d):
    size = C("size_bytes").cast("double")
    less = (C("size_bytes") - (C("file_id") % 40) * F.floor(C("size_bytes") / 100)).cast("double")
    return files(spark, d).select("file_id", G.grain_class(size, less, 0.2).alias("g")).select("file_id", "g.*")


@query("p52_field_class", "SELECT file_id, CASE WHEN (file_id % 50) / CAST(10 + file_id % 30 + 60 AS DOUBLE) >= 0.3 THEN 'telecine' WHEN 10 + file_id % 30 > 30 THEN 'interlaced' ELSE 'progressive' END AS fields FROM v_file")
def p52(spark, d):
    i = C("file_id")
    return files(spark, d).select("file_id", G.field_class(F.lit(10), i % 30, F.lit(30), F.lit(30), i % 50, 0.3).alias("fields"))


@query("p53_crop_plausible", "SELECT file_id, offset_no, CASE WHEN ch = 804 AND file_id % 5 = 0 THEN 'uneven bars' WHEN file_id % 7 = 0 THEN 'too little of the picture kept' END AS why FROM v_crop_sample")
def p53(spark, d):
    i = C("file_id")
    lifted = F.when((C("ch") == 804) & (i % 5 == 0), C("cy") - 30).otherwise(C("cy"))
    height = F.when((i % 7 == 0) & ~((C("ch") == 804) & (i % 5 == 0)), C("ch") * 3).otherwise(F.lit(1080))
    centred = F.when((i % 7 == 0) & ~((C("ch") == 804) & (i % 5 == 0)), C("ch")).otherwise(lifted)
    return view(spark, d, "v_crop_sample").select("file_id", "offset_no", G.crop_plausible(C("cw"), C("ch"), C("cx"), centred, F.lit(1920), height).alias("why"))


@query("f37_texts_to_figures", "SELECT file_id, CAST(3600 * (file_id % 5) + 60 * (file_id % 60) + 1.5 AS DOUBLE) AS seconds, CASE WHEN file_id % 4 = 0 THEN 1.0 ELSE round((file_id % 40 + 1) / 9.0, 6) END AS ratio, CAST(bit_depth AS BIGINT) AS depth FROM v_file")
def f37(spark, d):
    i = C("file_id")
    clock = F.concat((i % 5).cast("string"), F.lit(":"), (i % 60).cast("string"), F.lit(":1.5"))
    ratio = F.when(i % 4 == 0, "0:1").otherwise(F.concat((i % 40 + 1).cast("string"), F.when(i % 2 == 0, ":").otherwise("/"), F.lit("9")))
    return files(spark, d).select("file_id", G.hms_to_seconds(clock).alias("seconds"), F.round(G.ratio_text(ratio, 1.0), 6).alias("ratio"), G.bit_depth(F.when(C("bit_depth") == 10, "p010le").otherwise("yuv420p")).cast("long").alias("depth"))


@query("f38_year_of", "SELECT order_id, CAST(y AS BIGINT) AS year FROM (SELECT o_orderkey AS order_id, year(o_orderdate) AS y FROM orders)")
def f38(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(C("o_orderkey").alias("order_id"), G.year_of(F.concat(F.lit("on "), C("o_orderdate").cast("string"))).cast("long").alias("year"))


@query("f39_summaries", "SELECT file_id, 'MaxCLL ' || (file_id % 1000) || ', MaxFALL ' || (file_id % 400) AS light, CASE WHEN file_id % 3 <> 0 THEN width || 'x' || height || ' in ' || CAST(round_even((file_id % 100), 0) AS BIGINT) || '% of samples' END AS aspect FROM v_file")
def f39(spark, d):
    i = C("file_id")
    light = F.struct((i % 1000).cast("int").alias("max_content"), (i % 400).cast("int").alias("max_average"))
    other = F.when(i % 3 != 0, F.struct(C("width").alias("width"), C("height").alias("height"), ((i % 100) / 100).alias("share")))
    return files(spark, d).select("file_id", G.content_light_summary(light).alias("light"), G.variable_aspect(other).alias("aspect"))


@query("f40_speed_mismatch", "SELECT a.file_id, a.frame_rate <> b.frame_rate AS noted, CASE WHEN a.frame_rate > b.frame_rate THEN 'incoming' WHEN a.frame_rate < b.frame_rate THEN 'incumbent' END AS who FROM v_file a JOIN v_file b ON b.file_id = a.file_id + 1")
def f40(spark, d):
    f = files(spark, d)
    nxt = f.select((C("file_id") - 1).alias("file_id"), C("frame_rate").alias("other"))
    note = G.speed_mismatch(F.lit(1000), F.lit(1001), C("frame_rate"), C("other"))
    return f.join(nxt, "file_id").select("file_id", note.isNotNull().alias("noted"), F.substring_index(note, " ", 1).alias("who"))


@query("f41_fingerprint", "SELECT page_id, lower(lpad(hex(CAST((octet_length(encode(url)) + 72340172838076673 * 2) % 18446744073709551616 AS UBIGINT)), 16, '0')) AS oshash FROM pages")
def f41(spark, d):
    word = F.lit(bytearray(b"\x01" * 8 + b"tail"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", H.oshash(F.octet_length("url").cast("long"), word, word).alias("oshash"))


@query("f43_eta", "SELECT file_id, CAST(floor(greatest(CASE WHEN file_id % 2 = 0 THEN floor(100000 * 4 / 5) ELSE 100000 END - file_id, 0) / frame_rate) AS BIGINT) AS eta_s FROM v_file")
def f43(spark, d):
    return files(spark, d).select("file_id", G.eta_seconds(C("file_id"), F.lit(100000), C("frame_rate"), C("file_id") % 2 == 0).alias("eta_s"))


@query("p46_segment_title", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'segment title is unset, not ' || title WHEN file_id % 3 = 1 THEN 'segment title is x, not ' || title END AS problem FROM v_file")
def p46(spark, d):
    from ..operators import verify

    i = C("file_id")
    return files(spark, d).select("file_id", verify.segment_title_problem(F.when(i % 3 == 1, "x").when(i % 3 == 2, C("title")), C("title")).alias("problem"))


@query("j21_pair_outputs", "SELECT a.file_id AS title_id, CAST(a.bitrate AS BIGINT) AS src_bitrate, CAST(a.bitrate + 1 AS BIGINT) AS out_bitrate FROM v_file a WHERE a.file_id % 2 = 0")
def j21(spark, d):
    from ..operators import verify

    f = files(spark, d).select(C("file_id").alias("title_id"), C("bitrate").cast("long").alias("bitrate"))
    return verify.pair_outputs(f, f.where("title_id % 2 = 0").withColumn("bitrate", C("bitrate") + 1)).select("title_id", "src_bitrate", "out_bitrate")


oracle(
    "p44_track_problems",
    """WITH c AS (SELECT file_id, count(*) FILTER (WHERE type = 'audio' AND is_default) AS ad, count(*) FILTER (WHERE type = 'subtitles' AND is_default AND NOT forced) AS sd,
  count(*) FILTER (WHERE type = 'subtitles' AND forced AND lower(coalesce(language, 'und')) IN ('eng','en','und')) AS sf, count(*) FILTER (WHERE type = 'subtitles' AND forced AND is_default AND lower(coalesce(language, 'und')) IN ('eng','en','und')) AS sfd,
  count(*) FILTER (WHERE type = 'subtitles' AND NOT forced AND name = 'English-FORCED-PGS') AS nf, count(*) FILTER (WHERE type IN ('audio','subtitles') AND lower(coalesce(language, 'und')) NOT IN ('eng','en','und')) AS fo,
  arg_min(coalesce(language, 'und'), track_no) FILTER (WHERE type = 'video') AS vl FROM v_track GROUP BY file_id)
SELECT file_id, concat_ws('; ', CASE WHEN ad <> 1 THEN ad || ' default audio tracks, 1 is needed' END, CASE WHEN sd > 0 THEN sd || ' default subtitles that are not forced' END, CASE WHEN sf > 0 AND sfd <> 1 THEN sfd || ' default forced subtitles, 1 is needed' END,
  CASE WHEN nf > 0 THEN nf || ' subtitles forced by name only' END, CASE WHEN fo > 0 THEN fo || ' foreign tracks' END, CASE WHEN vl <> 'eng' THEN 'video language is ' || vl END) AS problems FROM c""",
)
