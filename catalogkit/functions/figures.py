"""Figures of a probe: colours, rates, classes, crops, rules and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CLASS_BOUNDS, CLASSES, CODEC_EFFICIENCY, DEPTH_ENDINGS, KEEP_LANGS, MASTERING_KEYS, MIN_KBPS, PEDIGREE_WORDS, PEDIGREES, REQUIRED, REQUIRED_MANUAL

PIXEL_TOLERANCE, BITRATE_TOLERANCE, EDITION_RUNTIME_S = 0.05, 0.25, 30.0


def lookup(values: dict) -> Column:
    """A small fixed table as a map column."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def known(c: Column) -> Column:
    """Null where a figure is zero, which means unknown."""
    return F.nullif(c, F.lit(0))


# Colours and HDR


def is_hdr(primaries: Column, transfer: Column, space: Column) -> Column:
    """P4."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(primaries).startswith("bt2020") | low(space).startswith("bt2020") | low(transfer).isin("smpte2084", "arib-std-b67")


def hdr_format(primaries: Column, transfer: Column, space: Column) -> Column:
    """P4."""
    t = F.lower(F.coalesce(transfer, F.lit("")))
    return F.when(t == "smpte2084", "hdr10").when(t == "arib-std-b67", "hlg").when(is_hdr(primaries, transfer, space), "bt2020").otherwise("none")


def colour_tagged(primaries: Column) -> Column:
    """P4."""
    p = F.lower(F.coalesce(primaries, F.lit("")))
    return (p != "") & ~p.isin("unknown", "unspecified", "n/a")


def ratio_text(s: Column, default: float) -> Column:
    """``a:b`` or ``a/b`` as a number; the default for a missing, malformed or zero ratio."""
    parts = F.split(s, "[:/]", 2)
    value = F.try_divide(F.get(parts, 0).try_cast("double"), known(F.get(parts, 1).try_cast("double")))
    bad = s.isNull() | s.isin("", "N/A", "0:1", "0/1")
    return F.when(bad, F.lit(default)).otherwise(F.coalesce(value, F.lit(default)))


def hms_to_seconds(s: Column) -> Column:
    """F37."""
    p = F.split(s, ":")
    return F.when(F.size(p) == 3, F.get(p, 0).try_cast("double") * 3600 + F.get(p, 1).try_cast("double") * 60 + F.get(p, 2).try_cast("double"))


def bit_depth(pix_fmt: Column) -> Column:
    """8 unless the pixel format's ending says more."""
    out = F.when(F.lit(False), 8)
    for ending, depth in DEPTH_ENDINGS:
        out = out.when(F.lower(pix_fmt).endswith(ending), depth)
    return out.otherwise(8)


def side_data(side: Column, kind: str) -> Column:
    """The first side-data entry of a kind, null without one."""
    return F.try_element_at(F.filter(side, lambda x: x["side_data_type"] == kind), F.lit(1))


def dolby_vision(side: Column) -> Column:
    """P5: profile, level and flags of the configuration record."""
    found = F.try_element_at(F.filter(side, lambda x: x["dv_profile"].isNotNull() | (x["side_data_type"] == "DOVI configuration record")), F.lit(1))
    keys = ("dv_profile", "dv_level", "rpu_present_flag", "bl_present_flag", "el_present_flag")
    return F.when(found.isNotNull(), F.struct(*[found[k].alias(k) for k in keys]))


def mastering_display(side: Column) -> Column:
    """P5."""
    found = side_data(side, "Mastering display metadata")
    return F.when(found.isNotNull(), F.struct(*[ratio_text(found[k].cast("string"), 0.0).alias(k) for k in MASTERING_KEYS]))


def content_light(side: Column) -> Column:
    """P5."""
    found = side_data(side, "Content light level metadata")
    number = lambda k: F.coalesce(found[k].try_cast("int"), F.lit(0)).alias(k)
    return F.when(found.isNotNull(), F.struct(number("max_content"), number("max_average")))


def same_mastering(a: Column, b: Column) -> Column:
    """Luminance within a thousandth of the larger, chromaticity within 0.0001; false if either is missing."""
    out = a.isNotNull() & b.isNotNull()
    for k in MASTERING_KEYS:
        x, y = F.coalesce(a[k], F.lit(0.0)), F.coalesce(b[k], F.lit(0.0))
        off = F.abs(x - y)
        out = out & (off / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)) <= 1e-3 if "luminance" in k else off <= 1e-4)
    return out


def hdr_gap(video: Column) -> Column:
    """What the bitstream carries and the container does not declare."""
    light = video["content_light_bitstream"]
    return F.array_compact(
        F.array(
            F.when(video["mastering_bitstream"].isNotNull() & ~same_mastering(video["mastering_bitstream"], video["mastering_display"]), "mastering_display"),
            F.when(light.isNotNull() & ~light.eqNullSafe(video["content_light"]), "content_light"),
            F.when(F.coalesce(video["dv_in_bitstream"], F.lit(False)) & ~F.coalesce(video["dolby_vision"], F.lit(False)), "dolby_vision"),
        )
    )


def mastering_summary(md: Column) -> Column:
    """F39; figures in their shortest form."""
    short = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.coalesce(c, F.lit(0.0))), r"0+$", ""), r"\.$", "")
    return F.when(md.isNotNull(), F.concat(F.lit("L "), short(md["min_luminance"]), F.lit("-"), short(md["max_luminance"]), F.lit(" cd/m2")))


def content_light_summary(cl: Column) -> Column:
    """F39."""
    return F.when(cl.isNotNull(), F.format_string("MaxCLL %d, MaxFALL %d", cl["max_content"], cl["max_average"]))


def variable_aspect(sec: Column) -> Column:
    """F39."""
    return F.when(sec.isNotNull(), F.format_string("%dx%d in %.0f%% of samples", sec["width"], sec["height"], sec["share"] * 100))


# Rates and durations


def _tag(tags: Column, *names: str) -> Column:
    """The value of the first tag whose upper-case name is, or starts with, one of ``names``."""
    folded = F.transform_keys(tags, lambda k, v: F.upper(k))

    def dashed(name: str) -> Column:
        return F.try_element_at(F.map_values(F.map_filter(folded, lambda k, v: k.startswith(name + "-"))), F.lit(1))

    return F.coalesce(*[folded[n] for n in names], *map(dashed, names))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def video_bitrate(tags: Column, duration: Column, bit_rate: Column) -> Column:
    """The statistics tag, else bytes over duration, else the stream's own figure."""
    stated = _positive(_tag(tags, "BPS").try_cast("long"))
    counted = F.bround(_positive(_tag(tags, "NUMBER_OF_BYTES").try_cast("double")) * 8 / _positive(duration.try_cast("double"))).cast("long")
    return F.coalesce(stated, counted, _positive(bit_rate.try_cast("long")))


def frame_count(tags: Column, nb_frames: Column) -> Column:
    """P9."""
    return F.coalesce(_positive(_tag(tags, "NUMBER_OF_FRAMES").try_cast("long")), _positive(nb_frames.try_cast("long")))


def usable_duration(video: Column, container: Column) -> Column:
    """P10: the video's duration, else the container's, else 0."""
    return F.coalesce(known(video.try_cast("double")), known(container.try_cast("double")), F.lit(0.0))


def total_frames(frames: Column, rate: Column, duration: Column) -> Column:
    """P10."""
    return F.coalesce(known(frames.cast("long")), F.bround(known(rate) * known(duration)).cast("long"))


def weighted_bitrate(bitrate: Column, codec: Column, table: dict[str, float] = CODEC_EFFICIENCY) -> Column:
    """The bitrate in h264 terms; null for an unknown bitrate."""
    return known(bitrate).cast("double") * F.coalesce(lookup(table)[F.lower(codec)], F.lit(1.0))


def pedigree(path: Column) -> Column:
    """P14."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(F.lit(False), "")
    for label, words in PEDIGREE_WORDS.items():
        out = out.when(name.rlike(rf"(?i)\b(?:{words})\b"), label)
    return out


def pedigree_rank(label: Column) -> Column:
    return F.coalesce(lookup({p: i for i, p in enumerate(PEDIGREES)})[label], F.lit(-1))


def resolution_class(width: Column, height: Column, bounds: dict[str, tuple[int, int]] = CLASS_BOUNDS) -> Column:
    """The highest class whose width or height is reached."""
    out = F.when(F.lit(False), "")
    for cls in CLASSES:
        w, h = bounds[cls]
        out = out.when((F.coalesce(width, F.lit(0)) >= w) | (F.coalesce(height, F.lit(0)) >= h), cls)
    return out.otherwise("SD")


def is_sd(width: Column, height: Column, bounds: dict[str, tuple[int, int]] = CLASS_BOUNDS) -> Column:
    """P50."""
    return resolution_class(width, height, bounds) == "SD"


def kbps_floor(cls: Column, profile: dict | None = None) -> Column:
    """P16."""
    profile = profile or {}
    return lookup({c: profile.get(f"min_kbps_{c.lower()}", v) for c, v in MIN_KBPS.items()})[cls]


def is_pal_speedup(rate: Column, height: Column) -> Column:
    """P18."""
    return F.coalesce((F.abs(rate - 25.0) <= 0.01) & height.isin(576, 288), F.lit(False))


def is_letterbox_candidate(aspect: Column) -> Column:
    """P19."""
    near = (F.abs(aspect - 16 / 9) < 0.02) | (F.abs(aspect - 4 / 3) < 0.02)
    return F.coalesce((aspect != 0) & near, F.lit(False))


def sdr_stamp(width: Column, height: Column, hdr: Column, tagged: Column) -> Column:
    """P50: the primaries to stamp; null for HDR or tagged files."""
    return F.when(hdr | tagged, F.lit(None).cast("string")).when(is_sd(width, height), "smpte170m").otherwise("bt709")


def grain_class(clean: Column, denoised: Column, threshold: float) -> Column:
    """Ratio (4 digits) and whether the unrounded ratio reaches the threshold."""
    ratio = (known(clean) - known(denoised)) / known(clean)
    return F.struct(F.bround(ratio, 4).alias("grain_ratio"), (ratio >= threshold).alias("grainy"))


def field_class(tff: Column, bff: Column, progressive: Column, undetermined: Column, repeated: Column, share: float) -> Column:
    """P52."""
    frames = known(tff + bff + progressive + undetermined)
    return F.when(repeated / frames >= share, "telecine").when(tff + bff > progressive, "interlaced").otherwise("progressive")


def crop_plausible(cw: Column, ch: Column, cx: Column, cy: Column, w: Column, h: Column, uneven: int = 16, kept: float = 0.5) -> Column:
    """Null for a plausible crop, else why not."""
    bars = F.abs((h - ch - cy) - cy)
    sides = F.abs((w - cw - cx) - cx)
    return F.when((cw <= 0) | (ch <= 0), "empty crop").when((bars > uneven) | (sides > uneven), "uneven bars").when((cw * ch) / known(w * h) < kept, "too little of the picture kept")


def crop_positions(duration: Column, n: int) -> Column:
    """N offsets from 2 % to 92 % of the duration, at most 900 s apart."""
    start, end = duration * 0.02, duration * 0.92
    step = F.least((end - start) / max(1, n - 1), F.lit(900.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(start + i * step, 3))


def crop_limit(depth: Column, black: Column, factor: float = 1.5, cap: float = 0.13) -> Column:
    """P55."""
    return F.greatest(24 * F.pow(F.lit(2.0), depth - 8), F.least(F.floor(black * factor), F.floor(F.pow(F.lit(2.0), depth) * cap))).cast("long")


# Tracks and names


def language_of(language: Column) -> Column:
    return F.lower(F.coalesce(language, F.lit("und")))


def named_forced(name: Column) -> Column:
    """``forced`` as a word of a track's name, unless a negation stands before it."""
    hits = F.regexp_extract_all(F.lower(name), F.lit(r"(?<![a-z0-9])(non|not|no|un)?[\s_.-]*forced(?![a-z0-9])"), F.lit(1))
    return F.coalesce(F.exists(hits, lambda x: x == ""), F.lit(False))


def forced_subtitle(forced: Column, name: Column, language: Column, keep: tuple[str, ...] = KEEP_LANGS) -> Column:
    """F36."""
    return (F.coalesce(forced, F.lit(False)) | named_forced(name)) & language_of(language).isin(*keep)


def year_of(s: Column) -> Column:
    """F38."""
    return F.regexp_extract(s, r"(\d{4})", 1).try_cast("int")


def same_cut(frames_a: Column, frames_b: Column, seconds_a: Column, seconds_b: Column, tolerance: float = EDITION_RUNTIME_S) -> Column:
    """Frame counts within 1, else durations within the tolerance, else null."""
    a, b = known(frames_a), known(frames_b)
    return F.coalesce(F.abs(a - b) <= 1, F.abs(known(seconds_a) - known(seconds_b)) <= tolerance)


def speed_mismatch(frames_a: Column, frames_b: Column, rate_a: Column, rate_b: Column) -> Column:
    """a note when one cut runs at two rates, null otherwise."""
    a, b = known(rate_a), known(rate_b)
    off = (F.abs(known(frames_a) - known(frames_b)) <= 1) & (F.abs(a - b) >= 0.01)
    fast, slow = F.greatest(a, b), F.least(a, b)
    who = F.when(a > b, "incoming").otherwise("incumbent")
    return F.when(off, F.concat(who, F.format_string(" plays the same frames at %.3f fps, not %.3f: %.1f%% too fast", fast, slow, (fast / slow - 1) * 100)))


def tolerance_vote(a: Column, b: Column, tolerance: float) -> Column:
    """true if both are known and differ by more than the tolerance, against the larger."""
    x, y = known(a), known(b)
    return F.coalesce(F.abs(x - y) / F.greatest(x, y) > tolerance, F.lit(False))


def eta_seconds(frame: Column, total: Column, fps: Column, telecine: Column | None = None) -> Column:
    """F43."""
    if telecine is not None:
        total = F.when(telecine, F.floor(total * 4 / 5)).otherwise(total)
    return F.floor(F.greatest(total - frame, F.lit(0)) / _positive(fps)).cast("long")


def url_key(url: Column) -> Column:
    """F44."""
    return F.sha2(url, 256)


def missing_fields(kind: Column, identity: dict[str, Column], manual: Column) -> Column:
    """required fields that are absent or empty; 0 is a value."""

    def missing(names: tuple[str, ...]) -> Column:
        return F.array_compact(F.array(*[F.when(F.coalesce(identity[n].cast("string"), F.lit("")) == "", F.lit(n)) for n in names if n in identity]))

    pick = lambda k: F.when(manual, missing(REQUIRED_MANUAL[k])).otherwise(missing(REQUIRED[k]))
    return F.when(kind == "movie", pick("movie")).otherwise(pick("tv"))


def year_accepted(entity_year: Column, name_year: Column, pinned: Column) -> Column:
    """years at most 1 apart, or either unknown, or pinned by an id."""
    return pinned | F.coalesce(F.abs(entity_year - name_year) <= 1, F.lit(True))


# Rules


def rule_passes(method: Column, value: Column, standard: Column, kind: Column) -> Column:
    """Whether a text value meets a standard; figures that are not numbers pass."""
    truthy = ~F.lower(F.coalesce(value, F.lit(""))).isin("", "0", "0.0", "false")
    yes = F.lower(F.trim(standard)).isin("yes", "true", "1", "on")
    number = lambda c: F.when(F.lower(c).isin("true", "false"), F.when(F.lower(c) == "true", 1.0).otherwise(0.0)).otherwise(c.try_cast("double"))
    v, s = number(value), number(standard)
    text = F.when(method == "is", F.lower(F.trim(value)).eqNullSafe(F.lower(F.trim(F.coalesce(standard, F.lit("")))))).otherwise(True)
    figures = F.when(method == "at least", v >= s).when(method == "at most", v <= s).when(method == "above", v > s).when(method.isin("exactly", "is"), v == s)
    return (
        F.when(method == "absent", ~truthy).when(method == "present", truthy)
        .when(kind == "bool", truthy == F.coalesce(yes, F.lit(False))).when(kind == "text", text)
        .otherwise(F.coalesce(figures, F.lit(True)))
    )


def shown(value: Column, unit: Column) -> Column:
    """A value as text: yes or no, whole numbers without a point, and the unit."""
    low = F.lower(value)
    plain = F.when(low == "true", "yes").when(low == "false", "no").when(value.rlike(r"^-?\d+\.0$"), F.regexp_replace(value, r"\.0$", "")).otherwise(F.coalesce(value, F.lit("none")))
    return F.concat(plain, F.when(unit.isNotNull(), F.concat(F.lit(" "), unit)).otherwise(""))


def rule_reason(label: Column, method: Column, value: Column, standard: Column, unit: Column) -> Column:
    """P24."""
    absent = F.when(F.lower(value).isin("true", "false"), "present").otherwise(shown(value, unit))
    return (
        F.when(method == "absent", F.concat(label, F.lit(": "), absent))
        .when(method == "present", F.concat(label, F.lit(": none")))
        .otherwise(F.concat(label, F.lit(" "), shown(value, unit), F.lit(", standard "), method, F.lit(" "), shown(standard, unit)))
    )


def severity(broken: Column) -> Column:
    """P25: repair, below or null of an array of broken rules."""
    return F.when(F.exists(broken, lambda b: b["repairable"]), "repair").when(F.size(broken) > 0, "below")


def flagged(broken: Column) -> Column:
    """Column to repair or below; repair wins."""
    columns = F.array_distinct(F.transform(broken, lambda b: b["column"]))
    marks = F.transform(columns, lambda c: F.when(F.exists(broken, lambda b: (b["column"] == c) & b["repairable"]), "repair").otherwise("below"))
    return F.map_from_arrays(columns, marks)
