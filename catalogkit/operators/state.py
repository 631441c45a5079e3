"""Titles, queue and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import names as N
from ..functions.constants import COMPLETE, PIPELINE, STAGE_LABELS, STOPPED
from .settle import settle, small


def dense_rank_by(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers all rows from 1 without a single-task window.

    Rows are dealt to ranges, numbered within each range, and shifted by the
    rows of the ranges before it; only one count per range reaches the driver.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = settle(ranged)
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    shifts, before = [], 0
    for part, n in counts:
        shifts.append((part, before))
        before += n
    shift = spark.createDataFrame(shifts, "_range int, _shift long")
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(shift), "_range").withColumn(name, (n + F.col("_shift")).cast("long")).drop("_range", "_shift")


def counts_by_stage(titles: DataFrame) -> DataFrame:
    """A1."""
    return titles.groupBy("stage").agg(F.count("*").alias("n"))


def audit_totals(findings: DataFrame) -> DataFrame:
    """A2: findings, those with failed checks, and the latest time."""
    return findings.agg(F.count("*").alias("n"), F.count_if(~F.col("checks_json").isin("[]", "")).alias("with_findings"), F.max("mtime").alias("latest"))


def queued(titles: DataFrame) -> DataFrame:
    return titles.where(~F.col("stage").isin(*STOPPED, *COMPLETE))


def _queue_order() -> list[Column]:
    return [F.asc_nulls_last("queue_order"), F.asc("id")]


def queue_rows(titles: DataFrame) -> DataFrame:
    """O2: what is neither stopped nor complete, in queue order."""
    return queued(titles).orderBy(*_queue_order())


def recent_titles(titles: DataFrame, stage: str | None = None, limit: int = 1000) -> DataFrame:
    """O1: newest first; the limit is the feature."""
    rows = titles if stage is None else titles.where(F.col("stage") == stage)
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def held_or_failed(titles: DataFrame) -> DataFrame:
    """U1."""
    return titles.where(F.col("stage") == "HELD").unionByName(titles.where(F.col("stage") == "FAILED"))


def needs_decision(titles: DataFrame, limit: int = 1000) -> DataFrame:
    """O3: the newest held and failed titles, ``limit`` of each."""
    both = recent_titles(titles, "HELD", limit).unionByName(recent_titles(titles, "FAILED", limit))
    return both.orderBy(F.desc("updated_at"), F.desc("id"))


def title_history(history: DataFrame, title_id: int, limit: int = 200) -> DataFrame:
    """O4."""
    return history.where(F.col("title_id") == title_id).orderBy("at", "event_id").limit(limit)


def queue_positions(titles: DataFrame, claims: DataFrame) -> DataFrame:
    """Positions of queued titles that no worker has claimed."""
    free = queued(titles).join(claims.select("id"), "id", "left_anti")
    return dense_rank_by(free.select("id", "queue_order"), _queue_order(), "position").select("id", "position")


def processing_order(claims: DataFrame) -> DataFrame:
    """Claims by time."""
    return dense_rank_by(claims, [F.asc("claimed_at"), F.asc("id")], "position")


def place(titles: DataFrame, new_ids: DataFrame) -> DataFrame:
    """New titles go behind the last queued title of their show, else to the back; then all are renumbered."""
    rows = queued(titles).join(new_ids.select("id", F.lit(True).alias("is_new")), "id", "left")
    is_new = F.coalesce("is_new", F.lit(False))
    old = dense_rank_by(rows.where(~is_new).select("id", "kind", "show", "queue_order"), _queue_order(), "pos")
    last = old.where("kind = 'tv' and show is not null").groupBy("show").agg(F.max("pos").alias("after"))
    fresh = rows.where(is_new).select("id", "kind", "show").join(last, "show", "left")
    after = F.when(F.col("kind") == "tv", F.col("after").cast("double"))
    both = old.select("id", F.col("pos").cast("double").alias("key"), F.lit(0).alias("late")).unionByName(fresh.select("id", after.alias("key"), F.lit(1).alias("late")))
    return dense_rank_by(both, [F.asc_nulls_last("key"), F.asc("late"), F.asc("id")], "queue_order").select("id", "queue_order")


def reorder(titles: DataFrame, units: DataFrame) -> DataFrame:
    """New queue order of units (unit_no, id or show); a show stands for its episodes."""
    rows = queued(titles).select("id", "kind", "show", F.coalesce("season", F.lit(0)).alias("s"), F.coalesce("episode", F.lit(0)).alias("e"))
    by_id = rows.join(units.where("id is not null").select("unit_no", "id"), "id")
    by_show = rows.where("kind = 'tv'").join(units.where("id is null").select("unit_no", "show"), "show")
    both = by_id.select("unit_no", "id", "s", "e").unionByName(by_show.select("unit_no", "id", "s", "e"))
    return dense_rank_by(both, [F.asc("unit_no"), F.asc("s"), F.asc("e"), F.asc("id")], "queue_order").select("id", "queue_order")


def validate_order(queue: DataFrame, units: DataFrame) -> DataFrame:
    """Problems of a wished order of ids: duplicate, unknown, locked or omitted. ``queue`` has id and locked."""
    asked = units.groupBy("id").agg(F.count("*").alias("n"))
    out = queue.withColumn("queued", F.lit(True)).join(asked, "id", "full")
    problem = F.when(F.col("queued").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("locked") & F.col("n").isNotNull(), "locked").when(~F.col("locked") & F.col("n").isNull(), "omitted")
    return out.select("id", problem.alias("problem")).where("problem is not null")


def queue_depths(titles: DataFrame) -> DataFrame:
    """Queued titles per pool; two pools count in both, none counts as assess. ``titles`` has pools."""
    pools = F.when(F.size("pools") > 0, F.col("pools")).otherwise(F.array(F.lit("assess")))
    return queued(titles).select(F.explode(pools).alias("pool")).groupBy("pool").agg(F.count("*").alias("n"))


def poster_urls(titles: DataFrame) -> DataFrame:
    """A19."""
    return titles.where("poster_url <> ''").select("poster_url").distinct()


def show_tiles(titles: DataFrame, positions: DataFrame) -> DataFrame:
    """Episodes of each show and the stretch of the queue they take."""
    tv = titles.where("kind = 'tv' and show is not null").select("id", "show").join(positions, "id", "left")
    return tv.groupBy("show").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


def title_by_job(titles: DataFrame) -> DataFrame:
    """The newest title of each job."""
    return titles.where("job_id is not null").groupBy("job_id").agg(F.max("id").alias("id"))


def _place_in(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Numbers the rows of each group from 0; the ranges that do it may split a group."""
    numbered = settle(dense_rank_by(df, [F.asc(group), F.asc(order)], "_n"))
    first = numbered.groupBy(group).agg(F.min("_n").alias("_first"))
    return numbered.join(first, group).withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first")


def unique_targets(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Target paths made unique by ``.n`` before the ending; ``moves`` has id and target, ``existing`` path.

    The moves of a target, by id, take its free forms in order: the plain one
    is number 0, then .1, .2 and so on, less those that exist.
    """
    form = r"^(.*?)(?:\.(0|[1-9][0-9]{0,8}))?(\.[^./]*)?$"
    part = lambda n: F.regexp_extract("path", form, n)
    numbered = existing.where(part(2) != "").select(F.concat(part(1), part(3)).alias("target"), part(2).cast("long").alias("number")).where("number > 0")
    wanted = moves.groupBy("target").agg(F.count("*").alias("moves"))
    taken = settle(existing.select(F.col("path").alias("target"), F.lit(0).cast("long").alias("number")).unionByName(numbered).distinct().join(wanted, "target", "left_semi"))
    ends = wanted.join(taken.groupBy("target").agg(F.count("*").alias("taken")), "target", "left")
    numbers = ends.select("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("moves") + F.coalesce("taken", F.lit(0)) - 1)).alias("number"))
    free = _place_in(numbers.join(taken, ["target", "number"], "left_anti"), "target", "number", "place")
    out = _place_in(moves.select("id", "target"), "target", "id", "place").join(free, ["target", "place"])
    base, ending = F.regexp_extract("target", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("target", r"^(.*?)(\.[^./]*)?$", 2)
    return out.select("id", F.when(F.col("number") == 0, F.col("target")).otherwise(F.concat(base, F.lit("."), F.col("number").cast("string"), ending)).alias("path"))


def siblings_in_flight(titles: DataFrame) -> DataFrame:
    """The lowest other title in flight for the same movie or overlapping episodes.

    Episode spans are short, so they are listed and overlap becomes equality.
    """
    past = F.array_position(F.array(*[F.lit(s) for s in PIPELINE]), F.col("stage")) > PIPELINE.index("COMPARED") + 1
    rows = titles.where(~F.col("stage").isin(*COMPLETE, "QUARANTINED")).withColumn("past", past)
    movie = rows.where("kind = 'movie'").select("id", "past", F.coalesce(F.concat(F.lit("tmdb "), "tmdb"), F.concat(F.lit("imdb "), "imdb")).alias("key"))
    last = F.greatest(F.coalesce("episode_last", "episode"), F.col("episode"))
    tv = rows.where("kind = 'tv' and tvdb is not null").select("id", "past", "tvdb", "season", F.explode(F.sequence("episode", last)).alias("e"))
    tv = tv.select("id", "past", F.concat_ws(" ", F.lit("tv"), "tvdb", F.col("season").cast("string"), F.col("e").cast("string")).alias("key"))
    keyed = movie.unionByName(tv).where("key is not null")
    # the lowest id of a key, and the two lowest past comparison: no pairs are made
    ahead = keyed.where("past")
    first = ahead.groupBy("key").agg(F.min("id").alias("ahead"))
    second = ahead.join(first, "key").where("id > ahead").groupBy("key").agg(F.min("id").alias("next_ahead"))
    lows = keyed.groupBy("key").agg(F.min("id").alias("low")).join(first, "key", "left").join(second, "key", "left")
    joined = keyed.join(lows, "key")
    other = F.when(F.col("ahead") == F.col("id"), F.col("next_ahead")).otherwise(F.col("ahead"))
    best = F.least(F.when(F.col("low") < F.col("id"), F.col("low")), other)
    return joined.withColumn("sibling", best).groupBy("id").agg(F.min("sibling").alias("sibling_id")).where("sibling_id is not null")


def resolve_profile(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Kind, key and value; a stored value (its own kind first) beats the default."""
    own = settings.select(F.col("key").alias("own_key"), F.col("value_json").alias("own"))
    shared = settings.select(F.col("key").alias("shared_key"), F.col("value_json").alias("shared"))
    own, shared = small(own), small(shared)
    out = defaults.join(own, F.concat_ws(".", "key", "kind") == F.col("own_key"), "left").join(shared, F.col("key") == F.col("shared_key"), "left")
    return out.select("kind", "key", F.coalesce("own", "shared", "value").alias("value"))


def link_imports(titles: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the title that their import became, by import path or stored id."""
    by_path = titles.select(F.col("id").alias("path_title"), F.col("source_path").alias("import_path"))
    return findings.join(by_path, "import_path", "left").withColumn("linked_id", F.coalesce("imported_title_id", "path_title")).drop("path_title")


def supersede(titles: DataFrame, winners: DataFrame) -> DataFrame:
    """A title whose output a winner replaced becomes rejected; ``winners`` has supersedes (paths)."""
    beaten = winners.select(F.explode("supersedes").alias("output_path")).distinct()
    hit = titles.join(beaten.withColumn("beaten", F.lit(True)), "output_path", "left")
    return hit.withColumn("stage", F.when(F.col("beaten"), "QUARANTINED").otherwise(F.col("stage"))).drop("beaten").select(*titles.columns)


def classify_arrivals(listing: DataFrame, titles: DataFrame) -> DataFrame:
    """What to do with each scanned file."""
    t = titles.select(F.col("source_path").alias("path"), "id", "stage")
    state = F.when(F.col("id").isNull(), "new").when(F.col("stage").isin(*COMPLETE), "re-import").when(F.col("stage").isin(*STOPPED), "blocked").otherwise("claimed")
    return listing.join(t, "path", "left").select("path", "id", state.alias("state"))


def close_collected(titles: DataFrame, listing: DataFrame) -> DataFrame:
    """Complete or rejected titles whose files are gone: rejected or deleted."""
    there = lambda c: listing.select(F.col("path").alias(c), F.lit(True).alias(f"has_{c}"))
    out = titles
    for c in ("output_path", "quarantine_path", "source_path"):
        out = out.join(there(c), c, "left").withColumn(f"has_{c}", F.coalesce(f"has_{c}", F.lit(False)))
    nothing = ~F.col("has_output_path") & ~F.col("has_quarantine_path") & ~F.col("has_source_path")
    action = F.when(F.col("stage").isin(*COMPLETE) & ~F.col("has_output_path") & F.col("has_quarantine_path"), "reject")
    action = action.when((F.col("stage").isin(*COMPLETE) | (F.col("stage") == "QUARANTINED")) & nothing, "delete")
    return out.select("id", action.alias("action")).where("action is not null")


def apply_decisions(titles: DataFrame, decisions: DataFrame) -> DataFrame:
    """The stage or the error that an operator's decision gives. ``titles`` has files_gone and identification_held."""
    d = decisions.select("id", "action").join(titles.select("id", "stage", "files_gone", "identification_held"), "id", "left")
    a = F.col("action")
    waiting = F.col("stage").isin("HELD", "FAILED")
    error = (
        F.when(F.col("stage").isNull(), "unknown title")
        .when((a == "forget") & ~F.col("files_gone"), "files remain")
        .when((a != "forget") & ~waiting, "not waiting for a decision")
        .when(a.isin("override", "identify") & (F.col("stage") != "HELD"), "only a held title")
        .when(a.isin("retry", "override") & F.col("identification_held"), "needs an identity")
        .when(~a.isin("forget", "retry", "override", "discard", "identify"), "unknown decision")
    )
    stage = F.when(a.isin("retry", "override", "identify"), "DETECTED").when(a == "discard", "QUARANTINED").when(a == "forget", "FORGOTTEN")
    return d.select("id", "action", F.when(error.isNull(), stage).alias("new_stage"), error.alias("error"))


def validate_identity(df: DataFrame) -> DataFrame:
    """Problems of operators' identities (kind, name, year, tmdb, imdb, tvdb, season, episode)."""
    shape = lambda c, p, why: F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(p), why)
    tv = F.col("kind") == "tv"
    checks = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name"), F.when(F.col("year").isNull(), "no year"), shape("year", r"^(?:19|20)\d{2}$", "bad year"),
            shape("tmdb", r"^\d+$", "bad tmdb id"), shape("imdb", r"^tt\d+$", "bad imdb id"), shape("tvdb", r"^\d+$", "bad tvdb id"),
            F.when(tv & F.col("season").isNull(), "no season"), F.when(tv & F.col("episode").isNull(), "no episode"),
        )
    )
    return df.withColumn("problems", checks)


def annotate_titles(titles: DataFrame, now: Column) -> DataFrame:
    """Stage label and minutes until the retry, rounded up."""
    wait = F.when((F.col("stage") == "HELD") & F.col("retry_after").isNotNull(), F.greatest(F.ceil((F.col("retry_after") - now) / 60), F.lit(0)))
    label = F.coalesce(G.lookup(STAGE_LABELS)[F.col("stage")], F.lower("stage"))
    return titles.withColumns({"stage_label": label, "retry_minutes": wait, "forceable": F.col("stage") == "HELD"})


def retry_plan(titles: DataFrame, now: float, base: float, max_attempts: int) -> DataFrame:
    """The delay after each failed attempt, base x 2 ** attempts, or a hold for good at the limit."""
    gone = F.col("attempts") >= max_attempts
    delay = F.when(~gone, F.lit(float(base)) * F.pow(F.lit(2.0), F.col("attempts")))
    return titles.select("id", "attempts", gone.alias("permanent"), delay.alias("delay_s"), (F.lit(float(now)) + delay).alias("retry_after"))


def due_for_retry(titles: DataFrame, now: float, max_attempts: int) -> DataFrame:
    """P62."""
    return titles.where((F.col("stage") == "HELD") & (F.col("retry_after") <= now) & (F.col("attempts") < max_attempts))


def publish_path() -> Column:
    """The path under the library of an identity's row (kind, title, year, tmdb, imdb, tvdb, show, show_year, season, episode, episode_last, edition, manual)."""
    c = F.col
    folder = N.movie_folder(c("title"), c("year"), c("tmdb"), c("imdb"), c("manual"))
    movie = F.concat(folder, F.lit("/"), N.movie_filename(c("title"), c("year"), c("edition"), folder))
    show = N.show_folder(c("show"), c("show_year"), c("tvdb"), c("tmdb"), c("manual"))
    tv = F.concat(show, F.lit("/"), N.season_folder(c("season")), F.lit("/"), N.episode_filename(c("show"), c("season"), c("episode"), c("title"), c("episode_last")))
    return F.when(c("kind") == "movie", movie).otherwise(tv)


def normalise_reasons(reasons: Column) -> Column:
    """An array of (stage, text) without empty texts, out of a JSON text, list or struct."""
    listed = F.from_json(reasons, "array<struct<stage:string,text:string>>")
    one = F.from_json(reasons, "struct<stage:string,text:string>")
    texts = F.transform(F.from_json(reasons, "array<string>"), lambda t: F.struct(F.lit(None).cast("string").alias("stage"), t.alias("text")))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("stage"), reasons.alias("text")))
    s = F.trim(reasons)
    out = F.when(s.rlike(r"^\[\s*\{"), listed).when(s.startswith("["), texts).when(s.startswith("{"), F.array(one)).when(s != "", plain)
    return F.coalesce(F.filter(out, lambda r: F.coalesce(r["text"], F.lit("")) != ""), F.array().cast("array<struct<stage:string,text:string>>"))


def merge_reasons(*reasons: Column) -> Column:
    """U8: the reasons of all gates in one array."""
    none = F.array().cast("array<struct<stage:string,text:string>>")
    return F.concat(*[F.coalesce(r, none) for r in reasons])


def identification_held() -> Column:
    """Whether a hold comes from identification."""
    return (F.col("stage") == "HELD") & F.coalesce(F.exists("reasons", lambda r: r["stage"] == "IDENTIFIED"), F.lit(False))


#: Columns that a re-import keeps.
KEPT_ON_REIMPORT = ("id", "kind", "source_path", "created_at", "queue_order")


def reset_for_reimport(titles: DataFrame, ids: DataFrame) -> DataFrame:
    """Identity and results are cleared, the id stays, the stage is the first."""
    hit = titles.join(ids.select("id", F.lit(True).alias("reset")), "id", "left")
    value = lambda c: F.lit("DETECTED") if c == "stage" else F.lit(0).cast(dict(titles.dtypes)[c]) if c == "attempts" else F.lit(None).cast(dict(titles.dtypes)[c])
    return hit.select(*[F.col(c) if c in KEPT_ON_REIMPORT else F.when(F.coalesce("reset", F.lit(False)), value(c)).otherwise(F.col(c)).alias(c) for c in titles.columns])


def apply_override(problems: DataFrame, titles: DataFrame, stage: str) -> DataFrame:
    """An overridden title passes a stage with its problems recorded, except identification."""
    out = problems.join(titles.select("id", "overridden"), "id", "left")
    let = F.coalesce(F.col("overridden"), F.lit(False)) & F.lit(stage != "IDENTIFIED")
    return out.select("id", "problems", ((F.size("problems") == 0) | let).alias("passes"), F.when(let, F.col("problems")).alias("recorded"))


def import_eligible(findings: DataFrame, titles: DataFrame, listing: DataFrame, free_bytes: int) -> DataFrame:
    """Why a finding cannot be imported for repair; null if it can."""
    name = N.basename(F.col("path"))
    names = listing.select(N.basename(F.col("path")).alias("name")).distinct().withColumn("there", F.lit(True))
    flight = titles.where(~F.col("stage").isin("QUARANTINED", *COMPLETE)).select(F.col("id").alias("imported_title_id"), F.lit(True).alias("flying"))
    out = findings.withColumn("name", name).join(names, "name", "left").join(flight, "imported_title_id", "left")
    why = F.when(F.col("flying"), "already in the pipeline").when(F.col("there"), "name already in import").when(F.col("size") > free_bytes, "not enough space")
    return out.select("path", why.alias("refused"))


def forget_titles(titles: DataFrame, history: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids."""
    gone = ids.select("id")
    return titles.join(gone, "id", "left_anti"), history.join(gone.withColumnRenamed("id", "title_id"), "title_id", "left_anti")


def insert_sources(titles: DataFrame, arrivals: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(new titles, their history rows): arrivals (id, source_path, kind) whose path has no title yet."""
    fresh = arrivals.dropDuplicates(["source_path"]).join(titles.select("source_path"), "source_path", "left_anti")
    rows = fresh.select("id", "source_path", "kind", F.lit("DETECTED").alias("stage"), F.lit(float(now)).alias("created_at"), F.lit(float(now)).alias("updated_at"))
    return rows, rows.select(F.col("id").alias("title_id"), "stage", F.lit("detected").alias("detail"), F.col("created_at").alias("at"))


def eligible_pools() -> Column:
    """Pools that may take a routed title (action, devices); null asks for a new assessment."""
    return F.when(F.col("action") == "passthrough", F.array(F.lit("passthrough"))).when(F.size("devices") > 0, F.col("devices"))
