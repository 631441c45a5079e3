"""Crop, field and routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as G


def rank_geometries(samples: DataFrame) -> DataFrame:
    """The geometries of a file's samples (file_id, offset_no, cw, ch, cx, cy) by count, height and first offset.

    Samples are counted before they are ranked, so only geometries are sorted.
    """
    g = samples.groupBy("file_id", "cw", "ch", "cx", "cy").agg(F.count("*").alias("n"), F.min("offset_no").alias("first"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), F.desc("ch"), F.asc("first")))
    return g.withColumn("place", place)


def crop_consensus(samples: DataFrame, files: DataFrame, min_bars: int = 20) -> DataFrame:
    """The first geometry with its bars and picture area; bars under the floor count as none.

    ``files``: file_id, height, display_width.
    """
    top = rank_geometries(samples).where("place = 1").drop("place", "first")
    bars = F.col("height") - F.col("ch")
    real = F.when(bars < min_bars, 0).otherwise(bars)
    out = top.join(files.select("file_id", "height", "display_width"), "file_id")
    return out.select("file_id", "cw", "ch", "n", real.alias("bars_px"), (F.col("display_width") * (F.col("height") - real)).alias("picture_pixels"))


def secondary_aspect(samples: DataFrame, share: float = 0.06, delta: float = 0.15) -> DataFrame:
    """The first other geometry with enough samples and another aspect."""
    ranked = rank_geometries(samples)
    totals = ranked.groupBy("file_id").agg(F.sum("n").alias("total"), F.max(F.when(F.col("place") == 1, F.col("cw") / F.col("ch"))).alias("aspect"))
    others = ranked.where("place > 1").join(totals, "file_id")
    ok = others.where((F.col("n") / F.col("total") >= share) & (F.abs(F.col("cw") / F.col("ch") - F.col("aspect")) >= delta))
    first = ok.groupBy("file_id").agg(F.min_by(F.struct(F.col("cw").alias("width"), F.col("ch").alias("height"), (F.col("n") / F.col("total")).alias("share")), "place").alias("s"))
    return first.select("file_id", "s.width", "s.height", F.round("s.share", 6).alias("share"))


# Encoders, and codecs that pass through.
X265, SVT, AV1_QSV, HEVC_QSV = "libx265", "libsvtav1", "av1_qsv", "hevc_qsv"
PASSTHROUGH_CODECS = ("hevc", "h265", "av1")


def route(files: DataFrame, profile: dict | None = None, gpu: bool = True, hevc_gpu: bool | None = None) -> DataFrame:
    """Action, gate, encoder, devices, reason and notes of each file.

    ``files``: codec, display_width, display_height, dolby_vision, grainy and,
    where overrides exist, film and output_codec.
    """
    profile = profile or {}
    hevc_gpu = gpu if hevc_gpu is None else hevc_gpu
    codec = F.lower(F.coalesce("codec", F.lit("")))
    has = lambda c, kind: F.col(c) if c in files.columns else F.lit(None).cast(kind)
    film, target = has("film", "boolean"), F.lower(F.coalesce(has("output_codec", "string"), F.lit(profile.get("output_codec", "hevc"))))
    grain = F.coalesce(film, F.col("grainy"), F.lit(False))
    policy = str(profile.get("hevc_devices", "cpu")).lower()
    fell_back = policy in ("gpu", "both") and not hevc_gpu
    policy = "cpu" if fell_back else policy
    devices = {"gpu": ("gpu",), "both": ("cpu", "gpu")}.get(policy, ("cpu",))
    hevc = HEVC_QSV if policy == "gpu" else X265

    def decision(action: str, gate: int, encoder: str | None, pools: tuple[str, ...], reason: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(gate).alias("gate"), F.lit(encoder).cast("string").alias("encoder"),
            F.array(*map(F.lit, pools)).cast("array<string>").alias("devices"), F.lit(reason).alias("reason"),
        )

    av1 = target == "av1"
    sd = G.is_sd(F.col("display_width"), F.col("display_height"))
    chain = (
        F.when(codec.isin(*profile.get("passthrough_codecs", PASSTHROUGH_CODECS)), decision("passthrough", 1, None, (), "already in a target codec"))
        .when(sd & F.lit(not profile.get("encode_sd", False)), decision("passthrough", 2, None, (), "SD, and SD encoding is off"))
        .when(F.col("dolby_vision"), decision("encode", 3, X265, ("cpu",), "Dolby Vision, which AV1 would lose"))
        .when(av1 & grain, decision("encode", 4, SVT, ("cpu",), "AV1 with grain needs the CPU"))
        .when(av1, decision("encode", 5, AV1_QSV if gpu else SVT, ("gpu",) if gpu else ("cpu",), "AV1 without grain"))
        .when(grain, decision("encode", 6, hevc, devices, "grainy source"))
        .otherwise(decision("encode", 7, hevc, devices, "clean source"))
    )
    notes = F.array_compact(
        F.array(
            F.when(film.isNotNull(), "grain set by the sidecar"),
            F.when((F.col("d.gate") == 5) & F.lit(not gpu), "no GPU, AV1 on the CPU"),
            F.when(F.col("d.gate").isin(6, 7) & F.lit(fell_back), "no GPU for HEVC, CPU instead"),
        )
    )
    out = files.withColumn("d", chain).withColumn("notes", F.when(F.col("d.gate") <= 2, F.array().cast("array<string>")).otherwise(notes))
    return out.select(*files.columns, "d.*", "notes")


def encoder_params(decisions: DataFrame, profile: dict, keys: tuple[str, ...]) -> DataFrame:
    """The profile's encoder settings kept with each decision, and their line per device."""
    snapshot = F.struct(*[F.lit(None if profile.get(k) is None else str(profile[k])).cast("string").alias(k) for k in keys])
    line = F.array_join(F.array(*[F.concat(F.lit(f"{k}="), F.lit(str(profile[k]))) for k in keys if profile.get(k) is not None]), " ")
    return decisions.withColumns({"params": snapshot, "summaries": F.transform("devices", lambda d: F.concat(d, F.lit(": "), F.col("encoder"), F.lit(" "), line))})
