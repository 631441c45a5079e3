"""Pairs of files: gates, votes and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import names as N

# What a gate's winner has.
GATES = {
    1: "carries HDR or Dolby Vision", 2: "has the larger display", 3: "has the larger picture without bars", 4: "has more audio channels",
    5: "has the greater bit depth", 6: "has the higher weighted bitrate", 7: "has more forced subtitles", 8: "has the better source",
}
#: Attributes that a gate decides on.
GATE_OF = {
    "dolby_vision": 1, "hdr": 1, "display_width": 2, "display_height": 2, "display_pixels": 2, "picture_pixels": 3, "letterbox_px": 3,
    "audio_channels_max": 4, "bit_depth": 5, "weighted_video_bitrate": 6, "subtitle_forced_tracks": 7, "pedigree": 8,
}

_VOTE = "struct<gate:int,verdict:string,incoming:bigint,incumbent:bigint>"


def pair_up(arrivals: DataFrame, incumbents: DataFrame, keys: list[str]) -> DataFrame:
    """Arrivals (columns new_*) with every incumbent (old_*) of their entity, never with their own origin."""
    new = arrivals.select([F.col(c).alias(f"new_{c}") for c in arrivals.columns])
    old = incumbents.select([F.col(c).alias(f"old_{c}") for c in incumbents.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"new_{k}") == F.col(f"old_{k}"))
    return drop_self_origin(new.join(old, cond))


def drop_self_origin(pairs: DataFrame) -> DataFrame:
    """J25."""
    if "new_origin_path" not in pairs.columns:
        return pairs
    return pairs.where(~F.col("old_path").eqNullSafe(F.col("new_origin_path")) | F.col("new_origin_path").isNull())


def gate_votes(pixel_tolerance: float = G.PIXEL_TOLERANCE, bitrate_tolerance: float = G.BITRATE_TOLERANCE) -> tuple[Column, Column]:
    """(votes, notes) of a pair row; a vote is won if the arrival's figure is larger."""
    n, o = (lambda c: F.col(f"new_{c}")), (lambda c: F.col(f"old_{c}"))
    bar = lambda c: F.coalesce(c, F.lit(0))

    def cast(gate: int, when: Column, new: Column, old: Column) -> Column:
        return F.when(
            F.coalesce(when, F.lit(False)),
            F.struct(F.lit(gate).alias("gate"), F.when(new > old, "win").otherwise("loss").alias("verdict"), new.cast("long").alias("incoming"), old.cast("long").alias("incumbent")),
        )

    new_hv, old_hv = (n("dolby_vision") | n("hdr")).cast("int"), (o("dolby_vision") | o("hdr")).cast("int")
    bars = (bar(n("letterbox_px")) != 0) | (bar(o("letterbox_px")) != 0)
    rate = lambda side: G.weighted_bitrate(side("bitrate"), side("codec"))
    new_rate, old_rate = rate(n), rate(o)
    new_forced, old_forced = bar(n("subtitle_forced_tracks")), bar(o("subtitle_forced_tracks"))
    both = lambda c: G.known(n(c)).isNotNull() & G.known(o(c)).isNotNull()
    first = cast(1, new_hv != old_hv, new_hv, old_hv)
    others = [
        cast(2, ~bars & G.tolerance_vote(n("display_pixels"), o("display_pixels"), pixel_tolerance), n("display_pixels"), o("display_pixels")),
        cast(3, G.tolerance_vote(n("picture_pixels"), o("picture_pixels"), pixel_tolerance), n("picture_pixels"), o("picture_pixels")),
        cast(4, both("audio_channels_max") & (n("audio_channels_max") != o("audio_channels_max")), n("audio_channels_max"), o("audio_channels_max")),
        cast(5, n("bit_depth") != o("bit_depth"), n("bit_depth"), o("bit_depth")),
        cast(6, G.tolerance_vote(new_rate, old_rate, bitrate_tolerance), F.bround(new_rate), F.bround(old_rate)),
        cast(7, new_forced != old_forced, new_forced, old_forced),
    ]
    lost = F.coalesce(new_hv < old_hv, F.lit(False))
    none = F.array().cast(f"array<{_VOTE}>")
    votes = F.when(lost, F.array(first)).otherwise(F.array_compact(F.array(first, *others)))
    notes = F.when(lost, F.array().cast("array<string>")).otherwise(
        F.array_compact(
            F.array(
                F.when(bars, F.format_string("bars present (%d and %d px), gate 2 deferred", bar(n("letterbox_px")), bar(o("letterbox_px")))),
                F.when(~bars & ~both("display_pixels"), "display size unknown, gate 2 skipped"),
                F.when(~both("picture_pixels"), "picture area unknown, gate 3 skipped"),
                F.when(new_rate.isNull() | old_rate.isNull(), "bitrate unknown, gate 6 skipped"),
            )
        )
    )
    return F.coalesce(votes, none), notes


def tally_votes(votes: Column, new_pedigree: Column | None = None, old_pedigree: Column | None = None) -> Column:
    """Verdict, gate, n_votes and reason of an array of votes; the pedigree breaks a tie without votes."""
    wins, losses = F.exists(votes, lambda v: v["verdict"] == "win"), F.exists(votes, lambda v: v["verdict"] == "loss")
    a = G.pedigree_rank(new_pedigree) if new_pedigree is not None else F.lit(-1)
    b = G.pedigree_rank(old_pedigree) if old_pedigree is not None else F.lit(-1)
    ranked = (a >= 0) & (b >= 0) & (a != b)
    gate = F.when(wins & losses, F.lit(None).cast("int")).when(F.size(votes) > 0, F.try_element_at(votes, F.lit(1))["gate"]).when(ranked, 8)
    verdict = F.when(wins & losses, "ambiguous").when(wins, "win").when(losses, "loss").when(ranked & (a > b), "win").when(ranked, "loss").otherwise("ambiguous")
    listed = F.array_join(F.transform(votes, lambda v: F.concat(F.lit("gate "), v["gate"].cast("string"), F.when(v["verdict"] == "win", " for the incoming").otherwise(" for the incumbent"))), "; ")
    what = G.lookup(GATES)[gate]
    side = F.when(verdict == "win", "the incoming ").otherwise("the incumbent ")
    agree = F.when(F.size(votes) > 1, F.concat(F.lit(" ("), F.size(votes).cast("string"), F.lit(" gates agree)"))).otherwise("")
    reason = F.when(wins & losses, F.concat(F.lit("the gates disagree: "), listed)).when(gate.isNull(), "no gate shows a clear difference").otherwise(F.concat(side, what, agree))
    return F.struct(verdict.alias("verdict"), gate.alias("gate"), F.size(votes).alias("n_votes"), reason.alias("reason"))


def compare_pairs(arrivals: DataFrame, incumbents: DataFrame, keys: list[str], profile: dict | None = None) -> DataFrame:
    """Each pair with its verdict, deciding gate, votes and notes."""
    profile = profile or {}
    votes, notes = gate_votes(profile.get("pixel_tolerance", G.PIXEL_TOLERANCE), profile.get("bitrate_tolerance", G.BITRATE_TOLERANCE))
    pairs = pair_up(arrivals, incumbents, keys).withColumns({"votes": votes, "notes": notes})
    has = "new_pedigree" in pairs.columns
    tally = tally_votes(F.col("votes"), F.col("new_pedigree") if has else None, F.col("old_pedigree") if has else None)
    pairs = pairs.withColumn("t", tally).select("*", "t.*").drop("t")
    if "new_frame_count" in pairs.columns:
        note = G.speed_mismatch(*[F.col(c) for c in ("new_frame_count", "old_frame_count", "new_frame_rate", "old_frame_rate")])
        pairs = pairs.withColumn("notes", F.array_compact(F.concat(F.array(note), F.col("notes"))))
    return pairs


def compare_siblings(siblings: DataFrame, attrs: DataFrame, key: str = "file_id") -> DataFrame:
    """The verdict text of pairs (id, sibling_id) in flight; nothing is rejected."""
    new = siblings.join(attrs.select([F.col(c).alias(f"new_{c}") for c in attrs.columns]), F.col("id") == F.col(f"new_{key}"))
    both = new.join(attrs.select([F.col(c).alias(f"old_{c}") for c in attrs.columns]), F.col("sibling_id") == F.col(f"old_{key}"))
    tally = tally_votes(gate_votes()[0])
    return both.withColumn("t", tally).select("id", "sibling_id", F.col("t.verdict").alias("verdict"), F.concat_ws(": ", "t.verdict", "t.reason").alias("note"))


def difference_table(pairs: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """A row per pair and attribute: both values, differs, measurable, decided."""
    gates = F.transform("votes", lambda v: v["gate"])
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("attribute"), F.lit(GATE_OF.get(a)).cast("int").alias("gate"),
                F.col(f"new_{a}").cast("string").alias("incoming"), F.col(f"old_{a}").cast("string").alias("incumbent"),
            )
            for a in names
        ]
    )
    out = pairs.select(*ids, gates.alias("gates"), F.inline(rows))
    decided = F.coalesce(F.array_contains("gates", F.col("gate")), F.lit(False))
    return out.select(
        *ids, "attribute", "gate", "incoming", "incumbent", (~F.col("incoming").eqNullSafe(F.col("incumbent"))).alias("differs"),
        (F.col("incoming").isNotNull() & F.col("incumbent").isNotNull()).alias("measurable"), decided.alias("decided"),
    )


def ambiguous_detail(reason: Column, new_title: Column, old_title: Column) -> Column:
    """The reason, and that the two segment titles differ as file names."""
    differ = N.to_filename(new_title) != N.to_filename(old_title)
    return F.concat(reason, F.when(F.coalesce(differ, F.lit(False)), F.concat(F.lit("; titled '"), old_title, F.lit("' against '"), new_title, F.lit("'"))).otherwise(""))


def crop_pair(pairs: DataFrame, crops: DataFrame) -> DataFrame:
    """Crop figures of both sides, looked up only where one may hide bars; a measured file without a crop has none."""
    wanted = G.is_letterbox_candidate(F.col("new_display_aspect")) | G.is_letterbox_candidate(F.col("old_display_aspect"))
    out = pairs.withColumn("crop_wanted", wanted)
    for side in ("new", "old"):
        c = crops.select(F.col("file_id").alias("c_id"), F.col("bars_px").alias("c_bars"), F.col("picture_pixels").alias("c_pixels"))
        out = out.join(c, F.col("crop_wanted") & (F.col(f"{side}_file_id") == F.col("c_id")), "left")
        out = out.withColumns(
            {
                f"{side}_letterbox_px": F.when(F.col("crop_wanted"), F.coalesce("c_bars", F.lit(0))),
                f"{side}_picture_pixels": F.when(F.col("crop_wanted"), F.coalesce("c_pixels", F.col(f"{side}_display_pixels"))),
            }
        ).drop("c_id", "c_bars", "c_pixels")
    return out
