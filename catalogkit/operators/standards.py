"""Report values of files (P11, P12, P17) and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from . import rules, tracks as tracks_ops
from .settle import small


def attributes(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """One flat record per file, with the counters of its tracks.

    ``files``: file_id, kind, codec, width, height, sar, frame_rate, duration_s,
    bitrate, bit_depth, hdr, dolby_vision, bars_px, size_bytes, and what else
    it has. Zero figures become null where zero means unknown.
    """
    shown = F.bround(F.col("width") * F.col("sar")).cast("long")
    df = files.withColumns({"display_width": shown, "display_height": F.col("height")})
    df = df.withColumns(
        {
            "display_pixels": F.col("display_width") * F.col("display_height"),
            "display_aspect": G.known(F.round(F.col("display_width") / G.known(F.col("display_height")), 3)),
            "letterbox_px": F.col("bars_px"),
            "picture_pixels": F.when(F.col("bars_px").isNotNull(), F.col("display_width") * (F.col("height") - F.col("bars_px"))),
            "weighted_video_bitrate": G.weighted_bitrate(F.col("bitrate"), F.col("codec")),
        }
    )
    return df.join(tracks_ops.track_counters(tracks), "file_id", "left")


def with_efficiency(files: DataFrame, table: DataFrame) -> DataFrame:
    """The efficiency of each file's codec (codec, efficiency); 1 for a codec that is not listed.

    The table is counted before it is broadcast.
    """
    t = table.select(F.lower("codec").alias("_codec"), F.col("efficiency").alias("_efficiency"))
    out = files.join(small(t), F.lower("codec") == F.col("_codec"), "left")
    return out.withColumn("efficiency", F.coalesce("_efficiency", F.lit(1.0))).drop("_codec", "_efficiency")


def with_crop(attrs: DataFrame, crops: DataFrame) -> DataFrame:
    """picture_pixels, letterbox_px and variable_aspect out of crop figures (file_id, picture_pixels, bars_px, secondary)."""
    c = crops.select("file_id", F.col("picture_pixels").alias("c_pixels"), F.col("bars_px").alias("c_bars"), G.variable_aspect(F.col("secondary")).alias("variable_aspect"))
    return attrs.drop("variable_aspect").join(c, "file_id", "left").withColumns({"picture_pixels": F.col("c_pixels"), "letterbox_px": F.col("c_bars")}).drop("c_pixels", "c_bars")


def report_values(attrs: DataFrame, profile: dict | None = None) -> DataFrame:
    """The report columns that derive from a probe."""
    rate, weighted = G.known(F.col("bitrate")), F.col("weighted_video_bitrate")
    df = attrs.withColumn("res_class", G.resolution_class(F.col("display_width"), F.col("display_height")))
    return df.withColumns(
        {
            "kbps": F.bround(rate / 1000.0),
            "weighted_kbps": F.bround(weighted / 1000.0),
            "bpp": F.round(rate / (G.known(F.col("display_pixels")) * G.known(F.col("frame_rate"))), 3),
            "kbps_floor": G.kbps_floor(F.col("res_class"), profile),
            "runtime_min": F.round(G.known(F.col("duration_s")) / 60.0, 1),
            "gb": F.round(G.known(F.col("size_bytes")) / 1e9, 2),
            "pal_speedup": G.is_pal_speedup(F.col("frame_rate"), F.col("height")),
            "kept_audio": F.coalesce("kept_audio", F.lit(False)),
        }
    )


def quality_report(files: DataFrame, tracks: DataFrame, profiles: dict | None = None) -> DataFrame:
    """The flagship: files and tracks to values, broken rules, severity and flags.

    Files and tracks meet once, on file_id; rules are part of the expression.
    """
    return rules.evaluate_rules(report_values(attributes(files, tracks)), profiles)
