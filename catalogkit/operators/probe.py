"""Probe documents to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions.constants import IMAGE_CODECS, MASTERING_KEYS

_SIDE = "array<struct<side_data_type:string,dv_profile:int,dv_level:int,rpu_present_flag:int,bl_present_flag:int,el_present_flag:int,max_content:string,max_average:string," + ",".join(
    f"{k}:string" for k in MASTERING_KEYS
) + ">>"
_STREAM = (
    "struct<index:int,codec_type:string,codec_name:string,profile:string,width:int,height:int,sample_aspect_ratio:string,pix_fmt:string,field_order:string,"
    "r_frame_rate:string,avg_frame_rate:string,nb_frames:string,bit_rate:string,duration:string,color_primaries:string,color_transfer:string,color_space:string,"
    f"channels:int,tags:map<string,string>,disposition:map<string,int>,side_data_list:{_SIDE}>"
)
PROBE_SCHEMA = f"streams array<{_STREAM}>, format struct<format_name:string,duration:string,size:string,tags:map<string,string>>, chapters array<struct<id:bigint>>"
IDENTIFY_SCHEMA = (
    "tracks array<struct<id:int,type:string,properties:struct<codec_id:string,language:string,default_track:boolean,forced_track:boolean,track_name:string>>>,"
    " container struct<properties:struct<title:string>>"
)


def _is_cover(s: Column) -> Column:
    return F.lower(s["codec_name"]).isin(*IMAGE_CODECS) | (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 0)


def split_streams(probe_df: DataFrame) -> DataFrame:
    """Video, audio, subtitles, cover_art and other of each document; ``error`` where no video is left."""
    kind = lambda name: F.filter("streams", lambda s: s["codec_type"] == name)
    videos = F.filter(kind("video"), lambda s: ~F.coalesce(_is_cover(s), F.lit(False)))
    other = F.filter("streams", lambda s: ~s["codec_type"].isin("video", "audio", "subtitle"))
    video = F.try_element_at(videos, F.lit(1))
    return probe_df.withColumns(
        {
            "video": video, "cover_art": F.filter(kind("video"), lambda s: F.coalesce(_is_cover(s), F.lit(False))), "audio": kind("audio"), "subtitles": kind("subtitle"),
            "other": F.concat(F.slice(videos, 2, F.greatest(F.size(videos), F.lit(1))), other), "error": F.when(video.isNull(), "no decodable video stream"),
        }
    )


def video_summary(s: Column) -> Column:
    """P2, P4, P5, P8, P9 of one stream."""
    width, height = F.coalesce(s["width"], F.lit(0)), F.coalesce(s["height"], F.lit(0))
    sar = G.ratio_text(s["sample_aspect_ratio"], 1.0)
    shown = F.bround(width * sar).cast("long")
    colours = (s["color_primaries"], s["color_transfer"], s["color_space"])
    dv = G.dolby_vision(s["side_data_list"])
    values = {
        "codec": F.lower(F.coalesce(s["codec_name"], F.lit(""))), "profile": s["profile"], "width": width, "height": height, "sar": sar, "display_width": shown, "display_height": height,
        "display_pixels": shown * height, "display_aspect": F.coalesce(shown / G.known(height), F.lit(0.0)), "pix_fmt": s["pix_fmt"], "bit_depth": G.bit_depth(s["pix_fmt"]),
        "cropdetect_limit": (24 * F.pow(F.lit(2.0), G.bit_depth(s["pix_fmt"]) - 8)).cast("long"), "field_order": s["field_order"], "frame_rate": G.ratio_text(s["r_frame_rate"], 0.0),
        "avg_frame_rate": G.ratio_text(s["avg_frame_rate"], 0.0), "frame_count": G.frame_count(s["tags"], s["nb_frames"]), "bitrate": G.video_bitrate(s["tags"], s["duration"], s["bit_rate"]),
        "duration": s["duration"].try_cast("double"), "color_primaries": colours[0], "color_transfer": colours[1], "color_space": colours[2],
        "language": G.language_of(s["tags"]["language"]), "hdr": G.is_hdr(*colours), "hdr_format": G.hdr_format(*colours), "colour_tagged": G.colour_tagged(colours[0]),
        "dolby_vision": dv.isNotNull(), "dv": dv, "mastering_display": G.mastering_display(s["side_data_list"]), "content_light": G.content_light(s["side_data_list"]),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _flag(s: Column, name: str) -> Column:
    return F.coalesce(s["disposition"][name], F.lit(0)) != 0


def audio_summary(s: Column) -> Column:
    """P3."""
    return F.struct(F.lower(s["codec_name"]).alias("codec"), F.coalesce(s["channels"], F.lit(0)).alias("channels"), G.language_of(s["tags"]["language"]).alias("language"), s["tags"]["title"].alias("title"), _flag(s, "default").alias("default"))


def subtitle_summary(s: Column) -> Column:
    """P3."""
    return F.struct(F.lower(s["codec_name"]).alias("codec"), G.language_of(s["tags"]["language"]).alias("language"), s["tags"]["title"].alias("title"), _flag(s, "default").alias("default"), _flag(s, "forced").alias("forced"))


def cover_summary(s: Column) -> Column:
    """P3."""
    return F.struct(s["index"].alias("index"), F.lower(s["codec_name"]).alias("codec"), s["width"].alias("width"), s["height"].alias("height"))


def other_summary(s: Column) -> Column:
    """P3."""
    return F.struct(s["index"].alias("index"), s["codec_type"].alias("type"), F.lower(s["codec_name"]).alias("codec"))


def container_summary(probe_df: DataFrame) -> DataFrame:
    """One typed row per probe document."""
    df = split_streams(probe_df)
    title = F.nullif(F.trim(F.coalesce(F.col("format.tags")["title"], F.lit(""))), F.lit(""))
    return df.select(
        "path", "error", F.when(F.col("video").isNotNull(), video_summary(F.col("video"))).alias("video"), F.transform("audio", audio_summary).alias("audio"),
        F.transform("subtitles", subtitle_summary).alias("subtitles"), F.transform("cover_art", cover_summary).alias("cover_art"), F.transform("other", other_summary).alias("other"),
        F.coalesce(F.size("chapters"), F.lit(0)).alias("chapters"), F.col("format.duration").try_cast("double").alias("container_duration"), F.col("format.format_name").alias("format_name"),
        title.alias("segment_title"), F.coalesce(F.col("format.size").try_cast("long"), F.lit(0)).alias("size_bytes"),
    )


def bitstream_hdr(frames: DataFrame) -> DataFrame:
    """First mastering and content-light figures over a file's frames (file_id, frame_no, side_data_list), and any DV."""
    md, cl = G.mastering_display(F.col("side_data_list")), G.content_light(F.col("side_data_list"))
    dv = F.exists("side_data_list", lambda x: x["side_data_type"].startswith("Dolby Vision"))
    rows = frames.select("file_id", "frame_no", md.alias("md"), cl.alias("cl"), F.coalesce(dv, F.lit(False)).alias("dv"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("frame_no")))
    return rows.groupBy("file_id").agg(first("md").alias("mastering_bitstream"), first("cl").alias("content_light_bitstream"), F.bool_or("dv").alias("dv_in_bitstream"))
