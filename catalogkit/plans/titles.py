"""Registered queries of titles, queue and streams that need more than one view, and SQL for those registered elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from ..streaming import jobs
from .adapters import view
from .base import files, oracle, query

C, L = F.col, F.lit


@query("w2_processing_order", "SELECT id, CAST(row_number() OVER (ORDER BY (id * 37) % 1009, id) AS BIGINT) AS position FROM v_title")
def w2(spark, d):
    claims = view(spark, d, "v_title").select("id", ((C("id") * 37) % 1009).alias("claimed_at"))
    return state.processing_order(claims).select("id", "position")


@query(
    "w17_unique_targets",
    """WITH m AS (SELECT id, show, row_number() OVER (PARTITION BY show ORDER BY id) AS r FROM v_title WHERE kind = 'tv'),
x AS (SELECT DISTINCT show, unnest(CASE CAST(substr(show, 6) AS INT) % 4 WHEN 0 THEN [0, 2] WHEN 1 THEN [2] WHEN 2 THEN [1, 3, 4] ELSE [] END) AS n FROM m),
f AS (SELECT t.show, n, row_number() OVER (PARTITION BY t.show ORDER BY n) AS r FROM (SELECT show, unnest(range(count(*) + 5)) AS n FROM m GROUP BY show) t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.show = t.show AND x.n = t.n))
SELECT id, 'q/' || m.show || CASE WHEN n = 0 THEN '' ELSE '.' || n END || '.mkv' AS path FROM m JOIN f ON f.show = m.show AND f.r = m.r""",
)
def w17(spark, d):
    """A fourth of the shows have the plain name and .2 already, a fourth .2 alone, a fourth .1, .3 and .4."""
    tv = view(spark, d, "v_title").where("kind = 'tv'")
    moves = tv.select("id", F.concat(L("q/"), "show", L(".mkv")).alias("target"))
    k = F.substring_index("show", " ", -1).cast("int") % 4
    there = F.when(k == 0, F.array(L(""), L(".2"))).when(k == 1, F.array(L(".2"))).when(k == 2, F.array(L(".1"), L(".3"), L(".4"), L(".05"))).otherwise(F.array(L(".x")))
    existing = tv.select("show", F.explode(there).alias("n")).distinct().select(F.concat(L("q/"), "show", "n", L(".mkv")).alias("path"))
    return state.unique_targets(moves, existing)


@query(
    "j7_resolve_profile",
    """WITH k AS (SELECT DISTINCT kind FROM v_file), r AS (SELECT r_regionkey AS i, lower(r_name) AS key FROM region)
SELECT kind, key, CASE WHEN i % 2 = 0 AND kind = 'tv' THEN key || ' tv' WHEN i % 3 = 0 THEN key || ' all' ELSE key || ' default' END AS value FROM k, r""",
)
def j7(spark, d):
    """Settings named after regions: some stored for one kind, some for both, the rest by default."""
    r = spark.read.parquet(f"{d}/region.parquet").select(C("r_regionkey").alias("i"), F.lower("r_name").alias("key"))
    own = r.where("i % 2 = 0").select(F.concat("key", L(".tv")).alias("key"), F.concat("key", L(" tv")).alias("value_json"))
    shared = r.where("i % 3 = 0").select("key", F.concat("key", L(" all")).alias("value_json"))
    kinds = files(spark, d).select("kind").distinct()
    defaults = r.join(F.broadcast(kinds)).select("kind", "key", F.concat("key", L(" default")).alias("value"))
    return state.resolve_profile(own.unionByName(shared), defaults)


@query(
    "p60_validate_identity",
    """SELECT id, concat_ws(', ', CASE WHEN id % 2 = 0 THEN 'no name' END, CASE WHEN id % 3 = 0 THEN 'no year' END, CASE WHEN id % 3 = 1 THEN 'bad year' END, CASE WHEN id % 5 = 0 THEN 'bad tmdb id' END, CASE WHEN id % 7 = 0 THEN 'bad imdb id' END,
  CASE WHEN id % 11 = 0 THEN 'bad tvdb id' END, CASE WHEN kind = 'tv' AND id % 13 = 0 THEN 'no episode' END) AS problems FROM v_title""",
)
def p60(spark, d):
    i = C("id")
    rows = view(spark, d, "v_title").select(
        "id", "kind", F.when(i % 2 == 0, "  ").otherwise("x").alias("name"), F.when(i % 3 == 1, 123).when(i % 3 == 2, 1999).alias("year"), F.when(i % 5 == 0, "7a").otherwise("7").alias("tmdb"),
        F.when(i % 7 == 0, "8").otherwise("tt8").alias("imdb"), F.when(i % 11 == 0, "").otherwise("9").alias("tvdb"), "season", F.when(i % 13 != 0, C("episode")).alias("episode"),
    )
    return state.validate_identity(rows).select("id", F.array_join("problems", ", ").alias("problems"))


_REASONS = "CASE id % 5 WHEN 0 THEN 'SCREENED:too small' WHEN 1 THEN ':a,:b' WHEN 2 THEN 'IDENTIFIED:one' WHEN 3 THEN ':plain text' ELSE '' END"


def _reasons() -> F.Column:
    i = C("id")
    texts = F.when(i % 5 == 0, '[{"stage":"SCREENED","text":"too small"},{"stage":"X","text":""}]').when(i % 5 == 1, '["a","b",""]').when(i % 5 == 2, '{"stage":"IDENTIFIED","text":"one"}').when(i % 5 == 3, "plain text")
    return state.normalise_reasons(texts)


def _shown(reasons: F.Column) -> F.Column:
    return F.array_join(F.transform(reasons, lambda r: F.concat(F.coalesce(r["stage"], L("")), L(":"), r["text"])), ",")


@query("p64_normalise_reasons", f"SELECT id, {_REASONS} AS reasons FROM v_title")
def p64(spark, d):
    return view(spark, d, "v_title").select("id", _shown(_reasons()).alias("reasons"))


@query("u8_merge_reasons", f"SELECT id, concat_ws(',', NULLIF({_REASONS}, ''), CASE WHEN id % 2 = 0 THEN 'ROUTED:' || stage END) AS reasons FROM v_title")
def u8(spark, d):
    more = F.when(C("id") % 2 == 0, F.array(F.struct(L("ROUTED").alias("stage"), C("stage").alias("text"))))
    return view(spark, d, "v_title").select("id", _shown(state.merge_reasons(_reasons(), more)).alias("reasons"))


@query("p69_apply_override", "SELECT id, id % 2 <> 0 OR id % 3 = 0 AS passes, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'why' ELSE '' END END AS recorded, id % 2 <> 0 AS identified FROM v_title")
def p69(spark, d):
    t = view(spark, d, "v_title").select("id", (C("id") % 3 == 0).alias("overridden"))
    problems = t.select("id", F.when(C("id") % 2 == 0, F.array(L("why"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    out = state.apply_override(problems, t, "SCREENED").select("id", "passes", F.array_join("recorded", ",").alias("recorded"))
    return out.join(state.apply_override(problems, t, "IDENTIFIED").select("id", C("passes").alias("identified")), "id")


@query(
    "p72_import_eligible",
    """WITH f AS (SELECT path, size, CAST(regexp_extract(path, '(\\d+)\\.mkv$', 1) AS BIGINT) AS k FROM v_finding)
SELECT f.path, CASE WHEN t.id IS NOT NULL THEN 'already in the pipeline' WHEN k % 4 = 0 THEN 'name already in import' WHEN size > 1040 THEN 'not enough space' END AS refused
FROM f LEFT JOIN v_title t ON t.id = f.k AND f.k % 2 = 0 AND t.stage NOT IN ('QUARANTINED', 'PUBLISHED', 'CLEANUP')""",
)
def p72(spark, d):
    k = F.regexp_extract("path", r"(\d+)\.mkv$", 1).cast("long")
    f = view(spark, d, "v_finding").select("path", "size", k.alias("k"))
    rows = f.select("path", "size", F.when(C("k") % 2 == 0, C("k")).alias("imported_title_id"))
    there = f.where("k % 4 = 0").select(F.concat(L("import/"), C("k").cast("string"), L(".mkv")).alias("path"))
    return state.import_eligible(rows, view(spark, d, "v_title"), there, 1040)


# Streams' batch twins

oracle("t5_due_holds", "SELECT title_id, CAST(floor(epoch(CAST(max(at) AS TIMESTAMP))) AS BIGINT) + 86400 AS due FROM v_history WHERE stage = 'HELD' GROUP BY title_id")
oracle("t3_progress_blocks", "SELECT title_id, CAST(arg_max(size, event_id) AS BIGINT) AS frame, CAST(25.0 AS DOUBLE) AS fps, CAST(floor(greatest(1000000 - arg_max(size, event_id), 0) / 25.0) AS BIGINT) AS eta_s, 'continue' AS progress FROM (SELECT *, CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) AS title_id FROM v_poll) GROUP BY title_id")


@query("t4_findings", "SELECT path, CAST(max(s) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS versions FROM (SELECT path, 1000 + size AS s FROM v_listing UNION ALL SELECT path, 1001 + size FROM v_listing WHERE size % 2 = 0) GROUP BY path")
def t4(spark, d):
    """The audit stream over two files of a listing: all paths, then those that changed."""
    import uuid

    from ..operators.settle import shared_folder

    folder = f"{shared_folder(spark)}/made-{uuid.uuid4().hex}"
    rows = view(spark, d, "v_listing").select("path", C("size").cast("long").alias("size"), C("mtime").cast("double").alias("mtime"))
    step = lambda df: df.write.mode("append").parquet(f"{folder}/in")
    assess = lambda f: f.withColumns({"measured": L(True), "checks_json": L("[]")})
    found = None
    for n, part in enumerate((rows, rows.where("size % 2 = 0").withColumn("size", C("size") + 1))):
        step(part)
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        running = jobs.continuous_audit(stream, f"{folder}/findings", assess, f"{folder}/checkpoint")
        running.processAllAvailable()
        running.stop()
        now = jobs.read_findings(spark, f"{folder}/findings").select("path", "size", L(n).alias("n"))
        found = now if found is None else found.unionByName(now)
    last = found.where("n = 1").select("path", "size")
    changed = found.groupBy("path").agg(F.count_distinct("size").alias("versions"))
    return last.join(changed, "path").select("path", (C("size") + 1000).alias("size"), "versions")
