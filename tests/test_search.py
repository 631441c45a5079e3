"""Search by names against comparing every pair."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from catalogkit.operators import resolve
from catalogkit.operators.episodes import fuzzy_pairs


def norm(s):
    return " ".join("".join(c if c.isalnum() else " " for c in s).lower().split())


def key(s):
    n = norm(s)
    return n[4:] if n.startswith("the ") and len(n) > 4 else n


def score(wanted, name):
    w, o = key(wanted), key(name)
    filename = " ".join("".join(c for c in name.replace("/", "-") if c not in '\\:*?"<>|').split())
    if " ".join(wanted.split()) == filename or (w == o != ""):
        return 1.0
    if not w or not o:
        return 0.0
    return 0.9 if f" {w} " in f" {o} " else difflib.SequenceMatcher(None, w, o).ratio()


def expanded(wanted, name):
    ws, os_ = norm(wanted).split(), norm(name).split()
    out = []
    for w in ws:
        runs = [os_[i : i + len(w)] for i in range(len(os_) - len(w) + 1) if "".join(x[0] for x in os_[i : i + len(w)]) == w]
        out.append(" ".join(runs[0]) if len(w) >= 2 and w not in os_ and runs else w)
    return " ".join(out) if out != ws else None


def beside(wanted, name):
    """Whether a run of the reading's words spells a run of the name's, with the same word beside it or none."""
    ws, os_ = norm(wanted).split(), norm(name).split()
    for i in range(len(ws)):
        for j in range(i + 1, len(ws) + 1):
            if any(len(w) < 2 for w in ws[i:j]):
                continue
            sig = "".join(ws[i:j])
            for a in range(len(os_) - len(sig) + 1):
                b = a + len(sig)
                if "".join(x[0] for x in os_[a:b]) == sig and sig not in os_:
                    if (i and a and os_[a - 1] == ws[i - 1]) or (not i and j < len(ws) and b < len(os_) and os_[b] == ws[j]) or (not i and j == len(ws)):
                        return True
    return False


def plain(readings, names, k=10, cutoff=0.82):
    out = {}
    for i, wanted, year in readings:
        best = {}
        for tmdb, name, entity_year in names:
            if year is not None and entity_year is not None and abs(year - entity_year) > 1:
                continue
            s = score(wanted, name)
            e = expanded(wanted, name) if beside(wanted, name) else None
            s = max(s, score(e, norm(name)) if e else 0.0)
            if s >= cutoff:
                best[tmdb] = max(best.get(tmdb, 0.0), round(s, 9))
        out[i] = sorted(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
    return {i: v for i, v in out.items() if v}


def found(spark, readings, names, dated=True):
    r = spark.createDataFrame(readings, "title_id long, name string, name_year int")
    n = spark.createDataFrame(names, "tmdb string, name string, entity_year int")
    rows = resolve.scored_candidates(r, n) if dated else resolve.scored_candidates(r.drop("name_year"), n.drop("entity_year"))
    out = {}
    for x in rows.collect():
        out.setdefault(x.title_id, []).append((x.tmdb, round(x.score, 9)))
    return {i: sorted(v) for i, v in out.items()}


def drawn(seed, n_names, n_readings):
    draw = random.Random(seed)
    words = ["the", "lord", "of", "rings", "return", "king", "house", "tall", "green", "old", "ring", "so", "on", "night", "day", "Ray's"]
    name = lambda: " ".join(draw.choices(words, k=draw.randint(1, 6)))
    names = [(str(i), name(), draw.choice([1999, 2000, 2001, 2004, None])) for i in range(n_names)] + [("A", "Lord of the Rings: The Return of the King", 2003), ("B", "Ab", 2000), ("C", "", 2000), ("D", "?!", 2000)]

    def reading():
        _, base, year = draw.choice(names)
        kind, ws = draw.randrange(5), base.split()
        if kind == 0 and len(base) > 3:
            at = draw.randrange(len(base))
            base = base[:at] + draw.choice("aeioux") + base[at + 1 :]
        elif kind == 1 and len(ws) > 2:
            a = draw.randrange(len(ws) - 1)
            b = draw.randint(a + 2, len(ws))
            base = " ".join(ws[:a] + ["".join(w[0] for w in ws[a:b])] + ws[b:])
        elif kind == 2:
            base = " ".join(ws[draw.randrange(2) :])
        elif kind == 3:
            base = base.upper() + " " + draw.choice(words)
        return base, draw.choice([year, None, 2000])

    return [(i, *reading()) for i in range(n_readings)] + [(900, "lotr", None), (901, "lotr trotk", 2003), (902, "lotr Return of the King", 2004), (903, "of", None), (904, "a", None), (905, "?!", 2000)], names


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_pair(spark, seed):
    readings, names = drawn(seed, 150, 120)
    want = plain(readings, names)
    assert found(spark, readings, names) == want
    assert ("A", 0.9) in want[900] and ("A", 1.0) in want[901] and len(want) > 60


def test_undated(spark):
    readings, names = drawn(3, 60, 40)
    undated = [(t, n, None) for t, n, _ in names]
    assert found(spark, readings, names, dated=False) == plain([(i, n, None) for i, n, _ in readings], undated)
    with pytest.raises(ValueError):
        resolve.scored_candidates(spark.createDataFrame(readings, "title_id long, name string, name_year int"), spark.createDataFrame(names, "tmdb string, name string, entity_year int"), cutoff=0.5)


def test_one_word_in_all_names(spark):
    """20,000 names that share a word are not paired out."""
    rows = spark.range(20_000)
    word = F.substring(F.md5(F.col("id").cast("string")), 1, 10)
    names = rows.select(F.col("id").cast("string").alias("tmdb"), F.concat(F.lit("harbour "), word).alias("name"))
    readings = rows.where("id % 40 = 0").select(F.col("id").alias("title_id"), F.concat(F.lit("harbor "), word).alias("name"))
    began = time.time()
    got = resolve.scored_candidates(readings, names)
    assert got.where("cast(title_id as string) = tmdb").count() == 500 and time.time() - began < 240


def test_many_sets_that_share_a_word(spark, monkeypatch):
    """100,000 distinct sets of frequent words that share one word; sets beyond LISTED words give the same."""
    names = spark.range(100_000).selectExpr("cast(id as string) as tmdb", "concat('harbour w', id % 300, ' v', id div 300) as name")
    readings = spark.range(0, 100_000, 97).selectExpr("id as title_id", "concat('v', id div 300, ' harbour w', (id + 1) % 300) as name")
    got = {}
    for r in resolve.search_candidates(readings, names, frequent=100).collect():
        got.setdefault(r.title_id, []).append((r["rank"], r.tmdb, r.shared))
    assert len(got) == 1031
    for i in (0, 97, 9700, 99_910):
        w, v = (i + 1) % 300, i // 300
        both = [n for n in (v * 300 + w,) if n < 100_000]
        two = sorted({str(n) for n in range(w, 100_000, 300)} | {str(n) for n in range(v * 300, min(v * 300 + 300, 100_000))} - {str(n) for n in both})
        want = [(str(n), 3) for n in both] + [(n, 2) for n in two if n not in map(str, both)]
        assert [(t, s) for _, t, s in sorted(got[i])] == want[:10], i
    few = names.where("cast(tmdb as int) % 500 = 0")
    some = readings.where("title_id < 5000")
    rows = lambda: sorted(map(tuple, resolve.search_candidates(some, few, frequent=3).collect()))
    listed = rows()
    monkeypatch.setattr(resolve, "LISTED", 2)
    assert rows() == listed != []


def test_similar_names_of_few_letters(spark):
    """20,000 names of hexadecimal digits share most letter pairs with many others; their marks leave few to compare, and lose none."""
    word = F.md5(F.col("id").cast("string"))
    names = spark.range(20_000).select(F.lit("").alias("show"), F.concat(F.substring(word, 1, 8), F.lit(" "), F.substring(word, 9, 8)).alias("key"))
    probes = names.select("show", F.translate("key", "0", "1").alias("p_key"))
    began = time.time()
    got = fuzzy_pairs(probes, names, 0.82)
    assert got.count() > 20_000 and time.time() - began < 90
    few = [r.key for r in names.limit(300).collect()]
    asked = [k.replace("0", "1") for k in few] + [k[:7] + k[9:] for k in few[:50]]
    frame = lambda rows, name: spark.createDataFrame([("", r) for r in rows], f"show string, {name} string")
    met = {(r.p_key, r.key) for r in fuzzy_pairs(frame(asked, "p_key"), frame(few, "key"), 0.82).collect()}
    assert {(p, k) for p in asked for k in few if difflib.SequenceMatcher(None, p, k).ratio() >= 0.82} <= met


def test_candidate_score_shuffles_little(spark):
    """Scores equal those of each pair by itself, also for entities that are spread; names are shuffled once, readings twice."""
    pairs = spark.createDataFrame([(i, ["Lost Harbour", "LH", "Harbour Lots", "Night"][i % 4], str(i % 3)) for i in range(60)] + [(60, None, "0"), (61, "x", "9"), (62, "x", None), (None, "LH", "1"), (3, "Night", "0")], "title_id int, wanted string, tmdb string")
    names = spark.createDataFrame([("0", "The Lost Harbour"), ("0", None), ("1", "Lost Harbor"), ("1", "Lost Harbor"), ("1", "Tales of the Lost Harbour"), ("2", "Night"), ("4", "LH")], "tmdb string, name string")
    each = resolve.pair_scores(pairs.join(names.where("name is not null"), "tmdb").where("wanted is not null")).groupBy("title_id", "wanted", "tmdb").agg(F.max("score").alias("score"))
    want = sorted(map(repr, map(tuple, each.collect())))
    for hot in (100_000, 5):
        out = resolve.candidate_score(pairs, names, hot)
        assert sorted(map(repr, map(tuple, out.collect()))) == want
    plan = resolve.candidate_score(pairs, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
