"""Operators on small tables, and sources and streams against their batch twins."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from catalogkit.operators import audit, compare, crops, resolve, rules, state, verify
from catalogkit.operators.probe import container_summary
from catalogkit.sources import readers, sinks
from catalogkit.streaming import jobs


def pair(spark, new, old):
    base = {"file_id": 1, "path": "p", "key": 1, "codec": "h264", "bitrate": 1000, "hdr": False, "dolby_vision": False, "display_pixels": 100, "picture_pixels": None, "letterbox_px": None, "audio_channels_max": 2, "bit_depth": 8, "subtitle_forced_tracks": 0, "pedigree": None}
    schema = "file_id long, path string, key int, codec string, bitrate long, hdr boolean, dolby_vision boolean, display_pixels long, picture_pixels long, letterbox_px int, audio_channels_max int, bit_depth int, subtitle_forced_tracks long, pedigree string"
    make = lambda d: spark.createDataFrame([tuple({**base, **d}.values())], schema)
    return compare.compare_pairs(make(new), make(old), ["key"]).first()


def test_gates(spark):
    r = pair(spark, {}, {"hdr": True})
    assert (r.verdict, r.gate, r.n_votes) == ("loss", 1, 1)
    r = pair(spark, {"display_pixels": 200}, {"letterbox_px": 280})
    assert r.n_votes == 0 and r.verdict == "ambiguous" and "deferred" in r.notes[0]
    r = pair(spark, {"display_pixels": 200, "bit_depth": 10}, {"audio_channels_max": 6})
    assert r.verdict == "ambiguous" and r.gate is None and r.n_votes == 3
    assert pair(spark, {"pedigree": "remux"}, {"pedigree": "web"}).gate == 8
    a, b = {"bit_depth": 10, "bitrate": 5000}, {"audio_channels_max": 6}
    swap = {"win": "loss", "loss": "win", "ambiguous": "ambiguous"}
    assert pair(spark, a, b).verdict == swap[pair(spark, b, a).verdict]


def test_rules(spark):
    assert len(rules.rule_list()) == 65 and len(rules.COLUMNS) == 63
    values = spark.createDataFrame([("movie", 1280.0, False, "1080", 500.0)], "kind string, display_width double, kept_audio boolean, res_class string, weighted_kbps double")
    checks = F.array(F.struct(F.lit("container").alias("check"), F.lit(False).alias("ok"), F.lit("avi").alias("actual")))
    r = rules.evaluate_rules(values, checks=checks).first()
    assert [b.rule for b in r.broken] == ["movie_display_width", "kept_audio", "min_kbps_1080", "container"] and r.severity == "repair"
    assert r.flags == {"display_width": "below", "kept_audio": "below", "weighted_kbps": "below", "container_format": "repair"}
    assert r.broken[3].reason == "Container: avi" and r.broken[0].reason == "Movie display width 1280, standard at least 1920"
    assert rules.default_rules(spark).count() == 65


def test_outliers_and_medians(spark):
    rows = [("f", i, 1, 1, n, n, d) for i, (n, d) in enumerate([(1, 22.0), (2, 22.0), (3, 23.0), (4, 45.0)])]
    files = spark.createDataFrame(rows, "folder string, row_id long, season_folder int, season int, first int, last int, duration_s double")
    assert [r["first"] for r in audit.two_episode_files(files).collect()] == [4]
    more = files.unionByName(files.where("first = 1").withColumns({"row_id": F.lit(9).cast("long"), "first": F.lit(5), "last": F.lit(5)}))
    assert audit.two_episode_files(more).count() == 0


def test_state(spark):
    t = spark.createDataFrame([(1, "tv", "A", "HELD", 0), (2, "tv", "A", "PROBED", 1), (3, "tv", "B", "PROBED", 2), (4, "movie", None, "PROBED", 3), (5, "tv", "A", "PROBED", None)], "id long, kind string, show string, stage string, queue_order int")
    placed = {r.id: r.queue_order for r in state.place(t, spark.createDataFrame([(5,)], "id long")).collect()}
    assert placed == {2: 1, 5: 2, 3: 3, 4: 4}
    row = lambda s: spark.createDataFrame([(s,)], "s string").select(state.normalise_reasons(F.col("s")).alias("r")).first().r
    assert [tuple(x) for x in row('[{"stage":"A","text":"x"},{"stage":"B","text":""}]')] == [("A", "x")]
    assert [x.text for x in row("plain")] == ["plain"] and [x.text for x in row('["a","b"]')] == ["a", "b"] and row(None) == []
    retry = state.retry_plan(spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, attempts int"), 0.0, 120.0, 9).collect()
    assert [r.delay_s for r in retry] == [120.0, 240.0, 480.0]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0)], "path string, size long, duration_s double")
    change = spark.createDataFrame([("b", 3, None), ("c", 4, None)], "path string, size long, duration_s double")
    once = audit.upsert_by_key(base, change, "path", ("duration_s",))
    assert sorted(map(tuple, once.select("path", "size", "duration_s").collect())) == [("a", 1, 5.0), ("b", 3, 6.0), ("c", 4, None)]
    assert sorted(map(str, audit.upsert_by_key(once, change, "path", ("duration_s",)).collect())) == sorted(map(str, once.collect()))


def test_routing(spark):
    files = spark.createDataFrame([("hevc", 1920, 1080, False, False), ("h264", 720, 576, False, True), ("h264", 1920, 1080, True, True), ("h264", 1920, 1080, False, True), ("h264", 1920, 1080, False, False)], "codec string, display_width int, display_height int, dolby_vision boolean, grainy boolean")
    assert [r.gate for r in crops.route(files).collect()] == [1, 2, 3, 6, 7]
    assert [r.encoder for r in crops.route(files, {"output_codec": "av1"}, gpu=False).collect()] == [None, None, "libx265", "libsvtav1", "libsvtav1"]
    both = crops.route(files, {"hevc_devices": "both"}).collect()[4]
    assert both.devices == ["cpu", "gpu"] and both.encoder == "libx265"


def test_probe_documents(spark, tmp_path):
    doc = {
        "streams": [
            {"index": 0, "codec_type": "video", "codec_name": "HEVC", "width": 720, "height": 576, "sample_aspect_ratio": "64:45", "pix_fmt": "yuv420p10le", "r_frame_rate": "25/1", "color_transfer": "smpte2084", "tags": {"BPS-eng": "5000"}, "side_data_list": [{"side_data_type": "Content light level metadata", "max_content": 1000, "max_average": 400}]},
            {"index": 1, "codec_type": "video", "codec_name": "mjpeg"},
            {"index": 2, "codec_type": "audio", "codec_name": "AAC", "channels": 6, "disposition": {"default": 1}},
        ],
        "format": {"format_name": "matroska,webm", "duration": "10.5", "size": "99"}, "chapters": [{"id": 1}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"streams": [], "format": {}}))
    rows = container_summary(readers.read_ffprobe(spark, str(tmp_path))).orderBy("path").collect()
    v = rows[0].video
    assert (v.codec, v.display_width, v.bit_depth, v.hdr_format, v.bitrate, v.content_light.max_content) == ("hevc", 1024, 10, "hdr10", 5000, 1000)
    assert len(rows[0].cover_art) == 1 and rows[0].audio[0].default and rows[0].chapters == 1 and rows[1].error


def test_tags(spark):
    row = spark.createDataFrame([("p", "movie", "A & B", "7", "tt8", "1999", {"z": "1", "a": "<x>"})], "path string, kind string, title string, tmdb string, imdb string, released string, carried map<string,string>")
    row = row.withColumns({c: F.lit(None).cast("string") for c in ("show", "tvdb", "season", "episode")})
    xml = row.select("path", sinks.tag_xml(row).alias("xml"))
    tags = readers.parse_tag_xml(xml, "xml").collect()
    assert [(t.target_type, t.name, t.value) for t in tags] == [("MOVIE", "TITLE", "A & B"), ("MOVIE", "TMDB", "7"), ("MOVIE", "IMDB", "tt8"), ("MOVIE", "DATE_RELEASED", "1999"), ("MOVIE", "a", "<x>"), ("MOVIE", "z", "1")]
    expected = spark.createDataFrame([("p", "A & B"), ("q", "x")], "path string, title string")
    problems = {r.path: r.problems for r in verify.tag_problems_movie(readers.parse_tag_xml(xml, "xml"), expected).collect()}
    assert problems == {"p": [], "q": ["no tags at all"]}
    assert readers.parse_tag_xml(spark.createDataFrame([("r", "<oops")], "path string, x string"), "x").first().error


def test_sources(spark, tmp_path):
    side = readers.parse_sidecars(spark.createDataFrame([("d/x.job", "# c\nfilm=yes\ncrf = 18.5\ncodec=AV1\n")], "path string, body string")).first()
    assert (side.directory, side.film, side.crf, side.output_codec) == ("d", True, 18.5, "av1")
    listing = spark.createDataFrame([("a/b.mkv",), ("a/.b.mkv",), (".a/b.mkv",), ("a/b.mkv.part",), ("a/b.txt",)], "path string")
    assert [r.path for r in readers.video_listing(listing).collect()] == ["a/b.mkv"]
    df = readers.decode_json_columns(spark.createDataFrame([("oops",), ('[{"check":"a"}]',), (None,)], "checks_json string"), {"checks": "array<struct<check:string>>"})
    assert [len(r.checks) for r in df.collect()] == [0, 1, 0]
    (tmp_path / "g.txt").write_text("GRP\nX[0-9]+\n")
    (tmp_path / "s.txt").write_text("BluRay\tBlu.?Ray\n")
    (tmp_path / "w.txt").write_text("the\n")
    v = readers.read_vocab(spark, str(tmp_path / "s.txt"), str(tmp_path / "g.txt"), str(tmp_path / "w.txt"))
    names = spark.createDataFrame([("Movie 1999-GRP",), ("Movie-X12",), ("Movie-War",)], "name string")
    assert {r.name: r.is_group for r in resolve.with_release_group(names, v.groups).collect()} == {"Movie 1999-GRP": True, "Movie-X12": True, "Movie-War": False}


def test_initials(spark):
    df = spark.createDataFrame([("lotr return", "Lord of the Rings: The Return of the King")], "w string, n string")
    assert df.select(resolve.expand_initials(F.col("w"), F.col("n"))).first()[0].startswith("lord of the rings")


@pytest.fixture()
def polls(spark, tmp_path):
    rows = [(i, f"p{i % 3}", 10 if i > 5 else i, 40 if i % 4 else 5, f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, path string, size long, quiet_s long, at string").select("event_id", "path", "size", "quiet_s", F.to_timestamp("at").alias("polled_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "polls"))
    return df, str(tmp_path / "polls")


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_arrival_stream_equals_batch(spark, polls):
    df, path = polls
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = run(jobs.stable_arrivals(stream), "arrivals").select("path", "size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.first_stable(df).select("path", "size").collect()))


def test_lockout_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 2}", f"2024-01-01 00:{i:02d}:00", i % 9 != 0, i % 9 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, key string, t string, failed boolean, ok boolean").select("event_id", "key", F.to_timestamp("t").alias("at"), "failed", "ok")
    df.coalesce(1).write.parquet(str(tmp_path / "l"))
    got = run(jobs.lockout_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "l"))), "locked")
    want = sorted(r.event_id for r in jobs.lockouts(df).collect())
    assert want and sorted(r.event_id for r in got.collect()) == want


def test_progress_stream_equals_batch(spark, tmp_path):
    lines = ["frame=10", "fps=5", "total=110", "progress=continue", "frame=60", "progress=continue", "frame=99"]
    df = spark.createDataFrame([(t, i, x) for t in (1, 2) for i, x in enumerate(lines)], "title_id long, seq long, line string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = run(jobs.encode_progress(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))), "progress", "update")
    want = sorted(map(tuple, jobs.progress_blocks(df).collect()))
    assert want[0] == (1, 60, 5.0, 10, "continue") and sorted(map(tuple, got.collect())) == want


def test_silent_titles_are_forgotten(spark, tmp_path):
    """With a time to live, a block does not go on after a long silence."""
    lines = lambda *x: spark.createDataFrame([(1, i, t) for i, t in x], "title_id long, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    lines((0, "frame=10"), (1, "progress=continue"))
    stream = jobs.encode_progress(spark.readStream.schema("title_id long, seq long, line string").parquet(str(tmp_path / "t")), "2 seconds")
    q = stream.writeStream.format("memory").queryName("silent").outputMode("update").start()
    try:
        told = lambda: [r.frame for r in spark.table("silent").collect()]
        for n in (1, 2):
            until = time.time() + 60
            while len(told()) < n and time.time() < until:
                time.sleep(0.5)
            if n == 1:
                time.sleep(4)
                lines((2, "progress=continue"))
        assert told() == [10, None]
    finally:
        q.stop()


def test_restart_from_the_checkpoint(spark, tmp_path):
    """A job that is stopped and started again goes on with the state of its checkpoint."""
    start = datetime.datetime(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame([(i, "k", start + datetime.timedelta(minutes=m), True, False) for i, m in x], "event_id long, key string, at timestamp, failed boolean, ok boolean")
    found = []

    def step(more):
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        stream = jobs.lockout_stream(spark.readStream.schema(more.schema).parquet(str(tmp_path / "r")), n=3)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: found.extend(r.event_id for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()

    step(rows((1, 0), (2, 1)))
    assert found == []
    step(rows((3, 2), (4, 30)))
    assert found == [3]


def test_continuous_audit(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "path string, size long, mtime double")
    source, seen = str(tmp_path / "listing"), []

    def assess(files):
        seen.append(files.count())
        return files.withColumns({"measured": F.lit(True), "checks_json": F.lit("[]")})

    def step(more):
        more.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(more.schema).parquet(source)
        jobs.continuous_audit(stream, str(tmp_path / "findings"), assess, str(tmp_path / "checkpoint")).processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    step(rows(("a", 1, 1.0), ("b", 1, 1.0)))
    step(rows(("a", 1, 1.0), ("b", 2, 2.0), ("c", 1, 1.0)))
    assert seen == [2, 2]
    found = lambda: sorted((r.path, r.size) for r in jobs.read_findings(spark, str(tmp_path / "findings")).collect())
    assert found() == [("a", 1), ("b", 2), ("c", 1)]
    # a version holds what changed; what a fold replaced is emptied at the next one
    assert spark.read.parquet(str(tmp_path / "findings/v2")).count() == 2
    monkeypatch.setattr(jobs, "COMPACT", 3)
    step(rows(("d", 1, 1.0)))
    assert found() == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]
    held = lambda *versions: [spark.read.parquet(str(tmp_path / f"findings/v{v}")).count() for v in versions]
    assert held(0, 2, 4, 5) == [2, 2, 1, 4]
    # a reader that began before the fold still finds its versions
    reader = jobs.read_findings(spark, str(tmp_path / "findings"))
    for n in (9, 10, 11):
        step(rows(("a", n, float(n))))
        assert found() == [("a", n), ("b", 2), ("c", 1), ("d", 1)]
    assert held(0, 2, 4, 5, 11) == [0, 0, 0, 4, 4] and reader.count() == 4


def test_retry_timers(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "2024-01-01 00:05:00"), (1, "2024-01-01 00:01:00", "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:00", "2024-01-01 02:00:00"), (3, "2024-01-01 01:00:00", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "title_id long, a string, r string").select("title_id", F.to_timestamp("a").alias("at"), F.to_timestamp("r").alias("retry_after"))
    df.coalesce(1).write.parquet(str(tmp_path / "h"))
    got = run(jobs.retry_timers(spark.readStream.schema(df.schema).parquet(str(tmp_path / "h"))), "due")
    assert [r.title_id for r in got.collect()] == [1]
    assert [r.title_id for r in jobs.due_holds(df, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()] == [1]


def test_search_by_frequent_words(spark):
    # two words held by every name, beyond any share; only the year tells entities apart
    names = spark.createDataFrame([(f"{i:04}", f"green house {i % 5}", 1900 + i % 100) for i in range(400)], "tmdb string, name string, entity_year int")
    readings = spark.createDataFrame([(1, "green hause", 1950), (2, "green house 3", 1998), (3, "nothing else", 1950)], "title_id long, name string, name_year int")
    got = {}
    for r in resolve.search_candidates(readings.drop("name_year"), names.drop("entity_year")).collect():
        got.setdefault(r.title_id, []).append((r["rank"], r.tmdb, r.shared))
    assert sorted(got) == [1, 2]
    assert sorted(got[1]) == [(n + 1, f"{n:04}", 1) for n in range(10)]
    assert [t for _, t, _ in sorted(got[2])] == [f"{5 * n + 3:04}" for n in range(10)]
    dated = {(r.title_id, r.tmdb): r.score for r in resolve.scored_candidates(readings, names).collect()}
    want = {1: range(1949, 1952), 2: range(1997, 2000)}
    assert {t for t, _ in dated} == {1, 2}
    assert all(1900 + int(e) % 100 in want[t] for t, e in dated)
    assert sum(t == 1 for t, _ in dated) == resolve.SEARCH_LIMIT
    # a misspelt title beyond the first ten by number
    more = names.selectExpr("tmdb", "name").union(spark.createDataFrame([("9999", "green houses tall")], "tmdb string, name string"))
    one = resolve.scored_candidates(spark.createDataFrame([(7, "green hauses tall")], "title_id long, name string"), more).collect()
    assert ("9999", 7) in {(r.tmdb, r.title_id) for r in one}


def test_unique_targets(spark):
    moves = [(1, "q/a.mkv"), (2, "q/a.mkv"), (3, "q/b.mkv"), (4, "q/b.mkv"), (5, "q/none"), (6, "q/none"), (7, "q/c.mkv")]
    existing = ["q/a.mkv", "q/a.2.mkv", "q/b.2.mkv", "q/b.02.mkv", "q/none", "q/x.mkv"]
    out = state.unique_targets(spark.createDataFrame(moves, "id long, target string"), spark.createDataFrame([(e,) for e in existing], "path string"))
    want, seen = {}, set(existing)
    for i, target in moves:
        base, dot, ending = target.rpartition(".") if "." in target else (target, "", "")
        n, path = 0, target
        while path in seen:
            n += 1
            path = f"{base}.{n}{dot}{ending}"
        seen.add(path)
        want[i] = path
    assert {r.id: r.path for r in out.collect()} == want
    claims = spark.createDataFrame([(3, 5.0), (1, 5.0), (2, 1.0)], "id long, claimed_at double")
    assert {r.id: r.position for r in state.processing_order(claims).collect()} == {2: 1, 1: 2, 3: 3}


def test_search_counts_frequent_words(spark):
    """A reading of frequent words only meets its names, and the result is that of counting every shared word."""
    import random

    draw = random.Random(5)
    vocabulary = ["old", "house", "number", *(f"w{i}" for i in range(40))]
    named = [(str(i), " ".join(draw.sample(vocabulary[:3], draw.randint(0, 3)) + draw.sample(vocabulary[3:], draw.randint(0, 2)))) for i in range(200)]
    reads = [(i, " ".join(draw.sample(vocabulary[:3], draw.randint(0, 3)) + draw.sample(vocabulary[3:], draw.randint(0, 2)))) for i in range(60)] + [(99, "old house")]
    names = spark.createDataFrame(named, "tmdb string, name string")
    got = {}
    for r in resolve.search_candidates(spark.createDataFrame(reads, "title_id long, name string"), names, frequent=20).collect():
        got.setdefault((r.title_id, r.name), []).append((r["rank"], r.tmdb))
    for i, name in reads:
        words = set(name.split())
        key = lambda n: " ".join(n.split())
        scored = sorted((-(1 << 20 if key(n) == key(name) else len(words & set(n.split()))), t) for t, n in named if (words & set(n.split())) or key(n) == key(name))
        assert [t for _, t in sorted(got.get((i, name), []))] == [t for _, t in scored[:10]], name
    assert got[(99, "old house")]


def test_fuzzy_equals_brute_force(spark):
    """Blocked fuzzy matches are those of comparing every pair, with the arguments in their order."""
    import difflib
    import random

    from catalogkit.operators import episodes

    draw = random.Random(3)
    vocabulary = "the night of king a day stone winter rising dark fall light part".split()
    titles = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 4))) for _ in range(120)] + ["a", "ab", "abc", "b"]
    catalogue = [(draw.choice("xy"), i % 3, i, i, t, 20) for i, t in enumerate(titles)]

    def changed(t):
        t = list(t)
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(t) + 1)
            t[i : i + draw.randint(0, 1)] = draw.choice("abcdeilnorst ")
        return "".join(t)

    probes = [(i, draw.choice("xy"), changed(draw.choice(titles))) for i in range(150)] + [(900, "x", "a"), (901, "x", ""), (902, "z", "night")]
    c = spark.createDataFrame(catalogue, "show string, season int, episode int, ordinal int, title string, runtime int")
    for cutoff in (0.82, 0.6):
        got = {r.probe_id: (r.hit.title, round(r.score, 6)) for r in episodes.match_fuzzy(spark.createDataFrame(probes, "probe_id long, show string, text string"), c, cutoff).collect()}
        want, key = {}, lambda s: " ".join(s.split()).removeprefix("the ") if s.strip() != "the" else "the"
        for i, show, text in probes:
            options = {}
            for s, *_, t, _ in sorted(catalogue, key=lambda r: -r[3]):
                if s == show:
                    options[key(t)] = t
            near = [(difflib.SequenceMatcher(None, k, key(text)).ratio(), k) for k in options]
            near = [x for x in near if x[0] >= cutoff]
            if near:
                k = max(near)[1]
                want[i] = (options[k], round(difflib.SequenceMatcher(None, key(text), k).ratio(), 6))
        assert got == want


def test_incumbents_by_code(spark):
    """Codes are found anywhere in a name, also in longer numbers and either case; a range comes first."""
    schema = "title_id int, show string, show_year int, tvdb string, tmdb string, season int, episode int, episode_last int"
    rows = [(1, 1, 2, None), (2, 1, 2, 3), (3, 1, 12, None), (4, 2, 5, 6), (5, 1, 99, None), (6, 1, None, None), (7, 100, 1, None), (8, 1, 2, 2)]
    ids = spark.createDataFrame([(i, "Show", 1999, "7", None, *r) for i, *r in rows], schema)
    names = [(1, "b s01e02.mkv"), (1, "c S01E02-E03.mkv"), (1, "a xS01E0212 y.mkv"), (2, "S02E05-E06.mkv"), (2, "A S02E05.mkv"), (2, "S01E99.mkv"), (100, "S100E01 S100E02"), (1, "S01E12"), (1, "S1E99"), (None, "S01E99")]
    files = spark.createDataFrame([("Show (1999) [tvdbid-7]", *n) for n in names], "folder string, season int, name string")
    got = {r.title_id: r.file for r in resolve.tv_incumbents(ids, files.select("folder").distinct(), files).collect()}
    assert got == {1: "a xS01E0212 y.mkv", 2: "c S01E02-E03.mkv", 3: "S01E12", 4: "S02E05-E06.mkv", 5: None, 6: None, 7: "S100E01 S100E02", 8: "a xS01E0212 y.mkv"}


def test_incumbents_of_a_large_season(spark):
    """60,000 episodes and 60,000 files of one season are not paired out."""
    rows = spark.range(60_000)
    ids = rows.select(F.col("id").alias("title_id"), F.lit("Show").alias("show"), F.lit(1999).alias("show_year"), F.lit("7").alias("tvdb"), F.lit(None).cast("string").alias("tmdb"), F.lit(1).alias("season"), (F.col("id") % 50).cast("int").alias("episode"), F.lit(None).cast("int").alias("episode_last"))
    files = rows.select(F.lit("Show (1999) [tvdbid-7]").alias("folder"), F.lit(1).alias("season"), F.format_string("S01E%02d - %05d.mkv", F.col("id") % 50, F.col("id")).alias("name"))
    began = time.time()
    out = resolve.tv_incumbents(ids, files.select("folder").distinct(), files)
    assert out.where(F.col("file") == F.format_string("S01E%02d - %05d.mkv", F.col("title_id") % 50, F.col("title_id") % 50)).count() == 60_000 and time.time() - began < 60
