"""Sources S1 to S10."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import VIDEO_EXTENSIONS
from ..operators.probe import IDENTIFY_SCHEMA, PROBE_SCHEMA

# Columns of the state tables.
STATE = {
    "titles": (
        "id long, source_path string, kind string, stage string, title string, year int, show string, season int, episode int, episode_last int, tmdb string, imdb string,"
        " tvdb string, job_id string, work_path string, output_path string, quarantine_path string, origin_path string, poster_url string, encoder string, grain_ratio double,"
        " reasons_json string, supersedes_json string, reason string, attempts int, retry_after double, overridden int, queue_order int, created_at double, updated_at double"
    ),
    "history": "id long, title_id long, stage string, detail string, at double",
    "findings": (
        "id long, path string, kind string, size long, mtime double, checks_json string, measured_json string, summary string, import_path string, imported_title_id long,"
        " duration_s double, audited_at double"
    ),
    "settings": "key string, value_json string, updated_at double",
}


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four state tables with their fixed schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in STATE.items()}


#: JSON columns that are empty lists or maps when they are malformed or empty.
JSON_DEFAULTS = {"reasons": "[]", "supersedes": "[]", "checks": "[]", "measured": "{}"}


def decode_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """``name_json`` texts to typed ``name`` columns; malformed or empty is null, or the column's default."""
    for name, schema in schemas.items():
        text = F.col(f"{name}_json")
        value = F.from_json(F.when(F.trim(text) != "", text), schema)
        if name in JSON_DEFAULTS:
            value = F.coalesce(value, F.from_json(F.lit(JSON_DEFAULTS[name]), schema))
        df = df.withColumn(name, value).drop(f"{name}_json")
    return df


def encode_json_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """S2, back: typed columns to JSON texts."""
    for name in names:
        df = df.withColumn(f"{name}_json", F.to_json(name)).drop(name)
    return df


def read_ffprobe(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per probe document (a file each): path, streams, format, chapters."""
    return spark.read.schema(PROBE_SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def parse_ffprobe(df: DataFrame, text: str) -> DataFrame:
    """S3 for documents held in a column."""
    return df.withColumn("_p", F.from_json(text, PROBE_SCHEMA)).select("*", "_p.*").drop("_p", text)


def read_identify(spark: SparkSession, path: str) -> DataFrame:
    """Track rows (path, track_no, id, type, codec_id, language, is_default, forced, name) of identification documents."""
    docs = spark.read.schema(IDENTIFY_SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    return identify_tracks(docs)


def identify_tracks(docs: DataFrame) -> DataFrame:
    """S4 for documents already read."""
    rows = docs.select("path", F.posexplode("tracks").alias("track_no", "t"))
    p = F.col("t.properties")
    return rows.select(
        "path", "track_no", F.col("t.id").alias("id"), F.col("t.type").alias("type"), p["codec_id"].alias("codec_id"), F.coalesce(p["language"], F.lit("und")).alias("language"),
        F.coalesce(p["default_track"], F.lit(False)).alias("is_default"), F.coalesce(p["forced_track"], F.lit(False)).alias("forced"), p["track_name"].alias("name"),
    )


def read_packet_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of text lines that are numbers."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    return lines.select("path", packet_size(F.col("value")).alias("size")).where("size is not null")


def packet_size(line: Column) -> Column:
    """A line's number, a trailing comma taken off; null if it is none."""
    return F.regexp_replace(F.trim(line), ",+$", "").try_cast("long")


_SIMPLE = "array<struct<Name:string,String:string>>"
_TAGS = f"Tag array<struct<Targets:struct<TargetTypeValue:int,TargetType:string,TrackUID:string>,Simple:{_SIMPLE}>>"


def parse_tag_xml(df: DataFrame, xml_col: str) -> DataFrame:
    """Tag rows (path, tag_no, target_type, track_targeted, name, value); ``error`` for bodies that do not parse.

    An empty body gives no rows.
    """
    body = F.trim(F.coalesce(xml_col, F.lit("")))
    # the reader is lenient, so what does not open and close as tags counts as unparseable
    ok = body.rlike(r"(?s)^(?:<\?xml.*?\?>\s*)?(?:<!DOCTYPE[^>]*>\s*)?<Tags\b.*</Tags>$|^<Tags\s*/>$")
    rows = df.where(body != "").select("path", F.when(~ok, "tag XML does not parse").alias("error"), F.from_xml(F.when(ok, body), _TAGS).alias("x"))
    tags = rows.select("path", "error", F.posexplode_outer("x.Tag").alias("tag_no", "t"))
    simples = tags.select(
        "path", "error", "tag_no", F.upper(F.trim(F.coalesce("t.Targets.TargetType", F.lit("")))).alias("target_type"), F.col("t.Targets.TrackUID").isNotNull().alias("track_targeted"),
        F.explode_outer("t.Simple").alias("s"),
    )
    return simples.select("path", "tag_no", "target_type", "track_targeted", F.trim("s.Name").alias("name"), F.coalesce("s.String", F.lit("")).alias("value"), "error")


class Vocab(NamedTuple):
    sources: DataFrame
    groups: DataFrame
    words: DataFrame


def read_vocab(spark: SparkSession, sources: str, groups: str, words: str) -> Vocab:
    """Media sources (label, pattern), groups (name, is_pattern) and words; a group with regex signs is a pattern."""
    s = spark.read.schema("label string, pattern string").csv(sources, sep="\t", quote="")
    g = spark.read.text(groups).select(F.trim("value").alias("name")).where("name <> ''")
    g = g.select(F.when(F.col("name").rlike(r"[()\[\]|?*+\\^$]"), F.col("name")).otherwise(F.lower("name")).alias("name"), F.col("name").rlike(r"[()\[\]|?*+\\^$]").alias("is_pattern"))
    w = spark.read.text(words).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    return Vocab(s, g, w)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Overrides of each directory: film, codec, crf, crop and fields."""
    return parse_sidecars(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body")))


def parse_sidecars(df: DataFrame) -> DataFrame:
    """S8 for bodies held in a column (path, body); ``#`` starts a comment, later keys win."""
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    at = lambda key: F.try_element_at(F.transform(F.filter("pairs", lambda p: p["k"] == key), lambda p: p["v"]), F.lit(-1))
    yes = lambda c: F.when(F.lower(c).isin("1", "yes", "true", "on"), True).when(F.lower(c).isin("0", "no", "false", "off"), False)
    rows = df.withColumn("pairs", pairs)
    return rows.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("directory"), yes(at("film")).alias("film"), F.lower(at("codec")).alias("output_codec"), at("crf").try_cast("double").alias("crf"),
        at("crop").alias("crop"), F.lower(at("fields")).alias("fields"),
    )


def with_overrides(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the overrides of their directory."""
    return files.withColumn("directory", F.regexp_replace("path", "/[^/]*$", "")).join(sidecars, "directory", "left").drop("directory")


def list_videos(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, size, mtime) of video files under the roots; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return video_listing(files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("mtime")))


def video_listing(listing: DataFrame) -> DataFrame:
    """S9 for a listing table: no dot-files or dot-folders, no ``.part``, only video endings."""
    endings = "|".join(e[1:] for e in VIDEO_EXTENSIONS)
    return listing.where(F.col("path").rlike(rf"(?i)\.(?:{endings})$") & ~F.col("path").rlike(r"(?:^|/)\.[^/]") & ~F.lower("path").endswith(".part"))


_PROVIDER = (
    "id string, kind string, title string, original string, alternatives array<string>, year int, imdb string, tvdb string, poster_path string,"
    " seasons array<struct<season:int,episodes:array<struct<episode:int,title:string,runtime:int>>>>"
)


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, names, seasons) out of provider documents, one JSON document a line."""
    from ..operators.resolve import entity_names

    docs = spark.read.schema(_PROVIDER).json(path)
    entities = docs.select(F.col("id").alias("tmdb"), "kind", F.col("title").alias("label"), "year", "imdb", "tvdb", "poster_path")
    names = entity_names(docs.select(F.col("id").alias("tmdb"), F.col("title").alias("label"), "original", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives")))
    return entities, names, docs.where("kind = 'tv'").select(F.col("id").alias("show"), "seasons")
