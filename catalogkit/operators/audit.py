"""Library audit: check rows, naming, listings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import names as N

_ROW = "struct<check:string,expected:string,actual:string,ok:boolean,repair:string,surface:string>"


def check_row(check: str, expected: Column, actual: Column, ok: Column, repair: str, surface: str | None = None) -> Column:
    """One check; the repair is named only where it fails."""
    return F.struct(
        F.lit(check).alias("check"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"), F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(~F.coalesce(ok, F.lit(False)), repair).alias("repair"), F.lit(surface).cast("string").alias("surface"),
    )


def audit_track_checks(files: DataFrame, counters: DataFrame) -> DataFrame:
    """Files (file_id, format_name) with the counters of their tracks; adds ``checks``.

    ``counters``: as of ``tracks.track_counters``, with foreign_tracks (array) and video_language.
    """
    df = files.join(counters, "file_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    forced = F.when(z("subtitle_forced_tracks") > 0, 1).otherwise(0)
    fmt, lang = F.lower(F.coalesce("format_name", F.lit(""))), F.coalesce("video_language", F.lit("und"))
    none = lambda c: F.when(c == "", "none").otherwise(c)
    foreign = F.array_join(F.coalesce("foreign_tracks", F.array().cast("array<string>")), ", ")
    checks = [
        check_row("container", F.lit("matroska"), F.when(fmt == "", "unknown").otherwise(fmt), fmt.contains("matroska"), "remux"),
        check_row("foreign tracks", F.lit("none"), none(foreign), foreign == "", "strip"),
        check_row("audio default count", F.lit(1), z("audio_default_count"), z("audio_default_count") == 1, "flags"),
        check_row("subtitle defaults", F.lit(0), z("subtitle_default_count"), z("subtitle_default_count") == 0, "flags"),
        check_row("forced subtitle default", forced, z("subtitle_forced_default_count"), z("subtitle_forced_default_count") == forced, "flags"),
        check_row("forced by name only", F.lit(0), z("subtitle_named_forced"), z("subtitle_named_forced") == 0, "flags"),
        check_row("video language", F.lit("eng"), lang, lang == "eng", "flags"),
    ]
    return df.withColumn("checks", F.array(*checks))


def tag_structure_check(present: Column, slashed: Column, kind: Column) -> Column:
    """P29."""
    wanted = F.when(kind == "movie", F.array(F.lit("MOVIE"))).otherwise(F.array(*map(F.lit, ("COLLECTION", "SEASON", "EPISODE"))))
    flat = F.size(slashed) > 0
    actual = F.array_join(F.array_sort(F.array_intersect(present, wanted)), ", ")
    actual = F.concat(F.when(actual == "", "none").otherwise(actual), F.when(flat, ", flattened").otherwise(""))
    expected = F.when(kind == "movie", "MOVIE target").otherwise("COLLECTION, SEASON and EPISODE targets")
    return check_row("tag structure", expected, actual, (F.size(F.array_except(wanted, present)) == 0) & ~flat, "tags")


def _naming(check: str, expected: Column, actual: Column) -> Column:
    expected = F.coalesce(expected, F.lit("unbuildable"))
    return check_row(check, expected, actual, expected == actual, "naming")


def _incomplete(*checks: str) -> Column:
    return F.array(*[check_row(c, F.lit("(from tag)"), F.lit("tag incomplete"), F.lit(False), "naming") for c in checks])


def movie_naming_checks(df: DataFrame) -> DataFrame:
    """Names of (path, title, year, tmdb, imdb) against what the tags give; adds ``checks``."""
    path, title, year, tmdb, imdb = (F.col(c) for c in ("path", "title", "year", "tmdb", "imdb"))
    name, stem, parent = N.basename(path), N.stem(path), N.parent_name(path)
    manual = F.coalesce(tmdb, F.lit("")).eqNullSafe("") | F.coalesce(imdb, F.lit("")).eqNullSafe("")
    folder = N.movie_folder(title, year, tmdb, imdb, manual)
    prefix = F.when(F.startswith(stem, F.concat(folder, F.lit(" - "))), F.length(folder)).when(F.startswith(stem, F.concat(parent, F.lit(" - "))), F.length(parent))
    edition = F.when(prefix.isNotNull(), F.substring(stem, prefix + 4, F.length(stem)))
    rows = F.array(_naming("folder name", folder, parent), _naming("file name", N.movie_filename(title, year, edition, folder), name))
    complete = (F.coalesce(title, F.lit("")) != "") & year.isNotNull()
    return df.withColumn("checks", F.when(complete, rows).otherwise(_incomplete("folder name", "file name")))


def tv_naming_checks(df: DataFrame, max_span: int = 3) -> DataFrame:
    """Names of (path, title, show, tvdb, tmdb, season, episode); the show's year comes from its folder."""
    path, title, show, tvdb, tmdb, season, episode = (F.col(c) for c in ("path", "title", "show", "tvdb", "tmdb", "season", "episode"))
    df = df.withColumn("_parsed", N.parse_episode(N.stem(path), None, max_span))
    parsed = F.col("_parsed")
    show_dir = N.parent_name(path, 2)
    year = F.coalesce(F.try_element_at(F.regexp_extract_all(show_dir, F.lit(r"\(((?:19|20)\d{2})\)"), F.lit(1)), F.lit(-1)), F.lit("YYYY"))
    last = F.when((parsed["season"] == season) & (parsed["first"] == episode), N.last_episode(parsed, title))
    rows = F.array(
        _naming("show folder", N.show_folder(show, year, tvdb, tmdb), show_dir),
        _naming("season folder", N.season_folder(season), N.parent_name(path)),
        _naming("file name", N.episode_filename(show, season, episode, title, last), N.basename(path)),
    )
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    complete = full(show) & full(tvdb) & full(tmdb) & full(title) & season.isNotNull() & episode.isNotNull()
    return df.withColumn("checks", F.when(complete, rows).otherwise(_incomplete("show folder", "season folder", "file name"))).drop("_parsed")


def component_check(path: Column, kind: Column) -> Column:
    """The rules of path components over the last two (movie) or three (tv)."""
    parts = [N.basename(path), N.parent_name(path), F.when(kind == "tv", N.parent_name(path, 2))]

    def problems(part: Column) -> Column:
        return F.transform(F.coalesce(N.validate_component(part), F.array().cast("array<string>")), lambda x: F.concat(part, F.lit(": "), x))

    found = F.flatten(F.array(*map(problems, parts)))
    text = F.array_join(found, "; ")
    return check_row("component rules", F.lit("none"), F.when(text == "", "none").otherwise(text), F.size(found) == 0, "naming")


def hdr_checks(video: Column) -> Column:
    """What the container declares against what the bitstream carries; null unless HDR."""
    absent = lambda c: F.coalesce(c, F.lit("absent"))
    gap = video["hdr_declaration_gap"]
    rows = [check_row(t.replace("_", " "), video[t], video[t], F.lit(True), "none", "container") for t in ("color_primaries", "color_transfer", "color_space")]
    for key, label, text in (("mastering_display", "mastering display", G.mastering_summary), ("content_light", "content light level", G.content_light_summary)):
        bitstream = video["mastering_bitstream" if key == "mastering_display" else "content_light_bitstream"]
        rows.append(check_row(label, absent(text(bitstream)), absent(text(video[key])), ~F.array_contains(gap, key), "hdr", "bitstream"))
    dv = F.when(video["dolby_vision"], "present").otherwise("absent")
    carried = F.when(video["dolby_vision"] | video["dv_in_bitstream"], "present").otherwise("absent")
    rows.append(check_row("dolby vision", carried, dv, ~F.array_contains(gap, "dolby_vision"), "none", "bitstream"))
    return F.when(video["hdr"], F.array(*rows))


def segment_title_check(tag_title: Column, segment: Column) -> Column:
    """P34."""
    ok = (F.coalesce(tag_title, F.lit("")) != "") & segment.eqNullSafe(tag_title)
    return check_row("segment title", F.coalesce(tag_title, F.lit("(tag TITLE)")), F.coalesce(segment, F.lit("unset")), ok, "segment")


def statistics_check(ratio: Column, floor: float = 0.5) -> Column:
    """P34."""
    r = F.round(ratio, 4)
    return check_row("statistics ratio", F.lit(f"> {floor}"), r, r > floor, "statistics")


def failed_checks(checks: Column) -> Column:
    """P35."""
    return F.transform(F.filter(checks, lambda c: ~c["ok"]), lambda c: c["check"])


def check_summary(checks: Column) -> Column:
    """P35."""
    failed = failed_checks(checks)
    return F.when(F.size(failed) == 0, "meets the standard").otherwise(F.array_join(failed, ", "))


def replace_check(checks: Column, row: Column) -> Column:
    """A check row takes the place of that of the same name; a null row only removes (pass its name in ``row['check']``)."""
    return F.concat(F.filter(checks, lambda c: c["check"] != row["check"]), F.when(row["expected"].isNotNull(), F.array(row)).otherwise(F.array().cast(f"array<{_ROW}>")))


def tag_identity(tags: DataFrame) -> DataFrame:
    """Identity of each file out of tag rows (path, kind, target_type, name, value)."""
    blank = F.nullif(F.trim("value"), F.lit(""))
    at = lambda kind, target, name: F.max(F.when((F.col("kind") == kind) & (F.col("target_type") == target) & (F.col("name") == name), blank))
    either = lambda *cs: F.coalesce(*cs)
    return tags.groupBy("path").agg(
        either(at("movie", "MOVIE", "TITLE"), at("tv", "EPISODE", "TITLE")).alias("title"),
        at("tv", "COLLECTION", "TITLE").alias("show"),
        either(at("movie", "MOVIE", "TMDB"), at("tv", "COLLECTION", "TMDB")).alias("tmdb"),
        at("movie", "MOVIE", "IMDB").alias("imdb"),
        at("tv", "COLLECTION", "TVDB").alias("tvdb"),
        G.year_of(at("movie", "MOVIE", "DATE_RELEASED")).alias("year"),
        at("tv", "SEASON", "PART_NUMBER").try_cast("int").alias("season"),
        at("tv", "EPISODE", "PART_NUMBER").try_cast("int").alias("episode"),
        F.array_sort(F.collect_set(F.when(F.col("target_type") != "", F.col("target_type")))).alias("present"),
        F.array_sort(F.collect_set(F.when(F.col("name").contains("/"), F.col("name")))).alias("flattened"),
    )


def unseen_files(listing: DataFrame, findings: DataFrame) -> DataFrame:
    """Files whose path, size and time are not stored as measured."""
    return listing.join(findings.where("measured").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def forget_missing(findings: DataFrame, listing: DataFrame) -> DataFrame:
    """Findings whose file still exists."""
    return findings.join(listing.select("path"), "path", "left_semi")


def upsert_by_key(base: DataFrame, changes: DataFrame, key: str, keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """Changed rows replace stored ones; of ``keep_cols`` the stored value stays where the change has none."""
    if not keep_cols:
        return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)
    old = base.select(key, *[F.col(c).alias(f"old_{c}") for c in keep_cols])
    new = changes.join(old, key, "left")
    new = new.select(*[F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) if c in keep_cols and c in changes.columns else F.col(f"old_{c}").alias(c) if c in keep_cols else F.col(c) for c in base.columns if c in changes.columns or c in keep_cols])
    return base.join(changes.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def audit_rows(findings: DataFrame, kind: str | None = None) -> DataFrame:
    """By path, in code-point order."""
    return (findings if kind is None else findings.where(F.col("kind") == kind)).orderBy("path")


def others_median(durations: DataFrame, group: str = "folder") -> DataFrame:
    """For each row, the median of the other known durations of its group, and how many there are.

    Ranks replace collected lists: the median of the others is read off the two
    or three ranks around the group's middle, so no group is gathered.
    """
    df = durations.withColumn("d", G.known(F.col("duration_s")))
    w = Window.partitionBy(group).orderBy("d", "row_id")
    ranked = df.where("d is not null").withColumn("r", F.row_number().over(w))
    n = ranked.groupBy(group).agg(F.count("*").alias("n"))
    mid = ranked.join(n, group).where("r between floor((n + 1) / 2) - 1 and floor((n + 1) / 2) + 2")
    pick = lambda k: F.max(F.when(F.col("r") == k, F.col("d")))
    half = F.floor((F.col("n") + 1) / 2)
    mid = mid.withColumn("half", half).groupBy(group, "n", "half").agg(pick(F.col("half") - 1).alias("a"), pick(F.col("half")).alias("b"), pick(F.col("half") + 1).alias("c"))
    out = df.join(ranked.select(group, "row_id", "r"), [group, "row_id"], "left").join(mid, group, "left")
    others = F.col("n") - F.col("r").isNotNull().cast("int")
    # after removal of rank r the k-th of the others is rank k, or k + 1 from r on
    at = lambda k: F.when(k == F.col("half") - 1, F.col("a")).when(k == F.col("half"), F.col("b")).when(k == F.col("half") + 1, F.col("c"))
    shift = lambda k: k + (F.coalesce(F.col("r"), F.lit(1 << 30)) <= k).cast("int")
    low, high = shift(F.floor((others + 1) / 2)), shift(F.floor(others / 2) + 1)
    median = (at(low) + at(high)) / 2
    return out.select(*durations.columns, F.coalesce(others, F.lit(0)).alias("others"), median.alias("others_median"))


def next_unclaimed(parsed: DataFrame) -> DataFrame:
    """Rows (folder, first, last, ...) whose next number no file of the folder holds."""
    claims = parsed.select("folder", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("claimed")).distinct()
    return parsed.join(claims, (parsed["folder"] == claims["folder"]) & (parsed["first"] + 1 == claims["claimed"]), "left_anti")


def two_episode_files(files: DataFrame, ratio: float = 1.8, min_others: int = 3) -> DataFrame:
    """Single-numbered files long enough for two episodes, next number free.

    ``files``: folder, row_id, season_folder, season, first, last, duration_s.
    """
    coded = files.where("first is not null and season_folder <> 0")
    measured = others_median(coded)
    alone = measured.where((F.col("first") == F.col("last")) & (F.col("others") >= min_others) & (F.col("duration_s") >= ratio * F.col("others_median")))
    claims = coded.select(F.col("folder").alias("c_folder"), F.explode(F.sequence("first", F.greatest("first", "last"))).alias("claimed")).distinct()
    return alone.join(claims, (F.col("folder") == F.col("c_folder")) & (F.col("first") + 1 == F.col("claimed")), "left_anti")


def two_episode_rows(outliers: DataFrame) -> DataFrame:
    """Proposed name and detail of each outlier (name, show, title, season, first, duration_s, others_median)."""
    title = F.coalesce(F.nullif(N.parse_marker(F.coalesce("title", F.lit("TITLE")))["base"], F.lit("")), F.col("title"))
    proposed = N.episode_filename(F.coalesce("show", F.lit("SHOW")), F.col("season"), F.col("first"), title, F.col("first") + 1)
    detail = F.format_string(
        "%.1f min, median of the others %.1f min (%.2fx), S%02dE%02d has no file",
        F.col("duration_s") / 60, F.col("others_median") / 60, F.col("duration_s") / F.col("others_median"), F.col("season").cast("int"), (F.col("first") + 1).cast("int"),
    )
    row = check_row("episodes in file", proposed, F.col("name"), F.lit(False), "none")
    return outliers.withColumns({"row": row, "detail": detail})


def report_rows(findings: DataFrame) -> DataFrame:
    """Title, names and components of a finding (path, tag_title, checks, unreadable)."""
    named = ("folder name", "file name", "show folder", "season folder")
    has = lambda *names: F.exists("checks", lambda c: c["check"].isin(*names) & ~c["ok"])
    part = lambda name: F.try_element_at(F.transform(F.filter("checks", lambda c: (c["check"] == name) & ~c["ok"]), lambda c: c["actual"]), F.lit(1))
    return findings.select(
        "path", F.coalesce(F.nullif("tag_title", F.lit("")), N.stem(F.col("path"))).alias("title"),
        F.when(F.col("checks").isNull(), F.lit(None)).when(has(*named), "differ").otherwise("match").alias("names"),
        part("component rules").alias("component_rules"), part("episodes in file").alias("episodes_in_file"),
        F.when(F.col("checks").isNull(), F.coalesce("unreadable", F.lit("not measured yet"))).alias("reason"),
    )


def import_state(findings: DataFrame, titles: DataFrame, listing: DataFrame) -> DataFrame:
    """The title that repairs a finding, or that its copy waits to be detected."""
    t = titles.where("stage <> 'QUARANTINED'").select(F.col("id").alias("imported_title_id"), "stage")
    staged = listing.select(F.col("path").alias("import_path"), F.lit(True).alias("staged"))
    out = findings.join(t, "imported_title_id", "left").join(staged, "import_path", "left")
    return out.select("path", F.when(F.col("stage").isNotNull(), F.lower("stage")).when(F.col("staged"), "awaiting detection").alias("import_state"))


def report_filter(filters: list[tuple[str, str, str]], severity: str | None = None) -> Column:
    """All of (column, comparison, value) and the severity (``clean``: none). Comparisons: < > = yes no contains.

    A blank value fails a comparison.
    """
    keep = F.lit(True)
    for column, how, value in filters:
        c = F.col(column)
        number = c.cast("double") if how in "<>=" else c
        test = {
            "<": lambda n=number, v=value: n < float(v) - 1e-9, ">": lambda n=number, v=value: n > float(v) + 1e-9, "=": lambda n=number, v=value: F.abs(n - float(v)) <= 1e-9,
            "yes": lambda c=c: c.cast("boolean"), "no": lambda c=c: ~c.cast("boolean"), "contains": lambda c=c, v=value: F.contains(F.lower(c.cast("string")), F.lit(v.lower())),
        }[how]()
        keep = keep & F.coalesce(test, F.lit(False))
    if severity is not None:
        keep = keep & (F.col("severity").isNull() if severity == "clean" else F.coalesce(F.col("severity") == severity, F.lit(False)))
    return keep


def filter_report(df: DataFrame, filters: list[tuple[str, str, str]], severity: str | None = None) -> DataFrame:
    """P41."""
    return df.where(report_filter(filters, severity))


def shown_of_total(report: DataFrame, filters: list[tuple[str, str, str]], severity: str | None = None) -> DataFrame:
    """Rows that pass the filters, and all rows, in one pass."""
    return report.agg(F.count_if(report_filter(filters, severity)).alias("shown"), F.count("*").alias("total"))


def natural_key(text: Column) -> Column:
    """A text whose order is that of its words and numbers, case folded."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def sort_report(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    """Numbers, booleans and natural text; blanks last either way, ties by path."""
    c = natural_key(F.nullif(column, F.lit(""))) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last(), "path")
