"""Entities: ids, names, scores, votes and incumbents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import helpers as H
from ..functions import names as N
from ..functions.vocabulary import DEFAULT, PATTERNS, Vocabulary
from .episodes import BLOCKED, fuzzy_pairs
from .settle import settle, small

NAME_CUTOFF, CONTAINED_SCORE, SEARCH_LIMIT = 0.82, 0.9, 10


def entity_names(details: DataFrame) -> DataFrame:
    """(tmdb, name, is_label): the label, and the other names without it."""
    others = F.array_except(F.array_distinct(F.array_compact(F.concat(F.array("original"), F.col("alternatives")))), F.array("label"))
    rows = F.concat(F.array(F.struct(F.col("label").alias("name"), F.lit(True).alias("is_label"))), F.transform(others, lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_label"))))
    return details.select("tmdb", F.inline(rows))


def name_score(title: Column, wanted: Column, name: Column, contained: float = CONTAINED_SCORE) -> Column:
    """1 for an equal name, ``contained`` for one that holds the words, else the similarity."""
    key, other = N.match_key(wanted), N.match_key(name)
    inside = F.contains(F.concat(F.lit(" "), other, F.lit(" ")), F.concat(F.lit(" "), key, F.lit(" ")))
    same = N.title_matches_name(name, title) | ((key == other) & (key != ""))
    rest = H.similarity(F.when(~same & ~inside, key), other)
    return F.when(same, 1.0).when((key == "") | (other == ""), 0.0).when(inside, contained).otherwise(rest)


def _initial_runs(word: Column, others: Column) -> Column:
    """The first run of words whose initials spell ``word``; null without one."""
    n = F.length(word)
    starts = F.sequence(F.lit(1), F.greatest(F.size(others) - n + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.slice(others, i, n))
    return F.try_element_at(F.filter(runs, lambda r: F.array_join(F.transform(r, lambda w: F.substring(w, 1, 1)), "") == word), F.lit(1))


def expand_initials(wanted: Column, name: Column) -> Column:
    """``wanted`` with abbreviations written out as the words of ``name`` they spell; null if none does."""

    def expanded(x: Column) -> Column:
        def expand(w: Column) -> Column:
            run = _initial_runs(w, x["others"])
            return F.when((F.length(w) >= 2) & ~F.array_contains(x["others"], w) & run.isNotNull(), F.array_join(run, " ")).otherwise(w)

        return N.let(F.array_join(F.transform(x["words"], expand), " "), lambda out: F.when(out != F.array_join(x["words"], " "), out))

    words = F.struct(F.split(N.normalise_for_match(wanted), " ").alias("words"), F.split(N.normalise_for_match(name), " ").alias("others"))
    return N.let(words, expanded)


def spells_initials(words: Column, names: Column) -> Column:
    """whether each word spells a run of initials in one of ``names`` (an array)."""
    split = F.transform(names, lambda n: F.split(F.lower(n), r"[^0-9a-z]+"))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.exists(split, lambda o: _initial_runs(w, o).isNotNull()))


def pair_scores(distinct: DataFrame) -> DataFrame:
    """pairs (wanted, name) with the better score of the name and its expansion."""
    distinct = distinct.withColumn("as_run", expand_initials(F.col("wanted"), F.col("name")))
    own = name_score(F.col("wanted"), F.col("wanted"), F.col("name"))
    as_run = F.when(F.col("as_run").isNotNull(), name_score(F.col("as_run"), F.col("as_run"), F.col("name")))
    return distinct.withColumn("score", F.greatest(own, F.coalesce(as_run, F.lit(0.0))))


#: Pairs of one entity from which on they are spread, and over how many groups.
HOT, SPREAD = 100_000, 64


def candidate_score(pairs: DataFrame, names: DataFrame, hot: int = HOT) -> DataFrame:
    """the best score of (title_id, wanted, tmdb) over the entity's names, and its expansions.

    Pairs and names are shuffled once, by entity, and once more with their scores,
    without names. Of equal (wanted, tmdb) pairs the first meets the names and the
    others take its score. An entity of over ``hot`` pairs is spread by its
    readings, its names go along.
    """
    pairs = pairs.select("title_id", "wanted", "tmdb").where("wanted is not null and tmdb is not null")
    often = small(settle(pairs.groupBy("tmdb").count().where(F.col("count") > hot).select(F.col("tmdb").alias("often"))))
    is_hot = F.col("often").isNotNull()
    spread = lambda df: df.join(often, F.col("tmdb") == F.col("often"), "left")
    group = F.when(is_hot, F.pmod(F.xxhash64("wanted"), F.lit(SPREAD)).cast("int")).otherwise(0)
    groups = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    named = spread(names.select("tmdb", "name").where("name is not null")).select(F.col("tmdb").alias("n_tmdb"), F.explode(groups).alias("n_group"), "name")
    equal = Window.partitionBy("tmdb", "group", "wanted")
    dealt = spread(pairs).select("title_id", "wanted", "tmdb", group.alias("group")).repartition("tmdb", "group")
    dealt = dealt.withColumn("n", F.row_number().over(equal.orderBy("title_id")))
    met = dealt.join(named, (F.col("tmdb") == F.col("n_tmdb")) & (F.col("group") == F.col("n_group")) & (F.col("n") == 1), "left")
    own = pair_scores(met).select("title_id", "wanted", "tmdb", F.when(F.col("name").isNotNull(), F.col("score")).alias("own"))
    best = own.withColumn("score", F.max("own").over(Window.partitionBy("tmdb", "wanted"))).where("score is not null")
    return best.groupBy("title_id", "wanted", "tmdb").agg(F.max("score").alias("score"))


def _words(key: Column) -> Column:
    return F.filter(F.array_distinct(F.split(key, " ")), lambda w: w != "")


#: Names that a word may stand in before it counts as frequent.
FREQUENT = 1000
#: Frequent words of a set whose subsets are listed; larger sets meet word by word.
LISTED = 12


def subsets(words: Column) -> Column:
    """Every subset of a sorted array of words but the empty one, as words in order, each after a blank."""
    doubled = lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.lit(" "), w)))
    return F.filter(F.aggregate(words, F.array(F.lit("")), doubled), lambda s: s != "")


def search_candidates(readings: DataFrame, names: DataFrame, k: int = SEARCH_LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """At most ``k`` entities per reading (title_id, name) that share words with it, most words first.

    Every word counts, however frequent. Readings and names meet on words in at
    most ``frequent`` names; there all shared words are counted. Those that
    share frequent words only meet by subsets of such words: of the entities
    that hold a subset the first ``k`` stand for all, as no other can come
    before them, so no set of words meets all sets that share a word with it.
    Equal keys come first, so no equal name is lost.
    """
    keyed = names.select("tmdb", N.match_key(F.col("name")).alias("key")).distinct()
    wanted = readings.select("title_id", "name", N.match_key(F.col("name")).alias("key")).distinct()
    keys = wanted.select("key").distinct().withColumn("own", _words(F.col("key")))
    bags = settle(keyed.withColumn("word", F.explode(_words(F.col("key")))).groupBy("tmdb").agg(F.array_sort(F.collect_set("word")).alias("bag")))
    often = small(settle(bags.select(F.explode("bag").alias("word")).groupBy("word").count().where(F.col("count") > frequent).select("word", F.lit(True).alias("often"))))

    def told_apart(df: DataFrame, key: str, listed: str) -> tuple[DataFrame, DataFrame]:
        """Rows by rare word, and rows with the set of their frequent words."""
        flagged = df.withColumn("word", F.explode(listed)).join(often, "word", "left")
        rare = flagged.where("often is null").drop("often")
        return rare, flagged.where("often").groupBy(key).agg(F.array_sort(F.collect_set("word")).alias("set"))

    rare_keys, key_sets = told_apart(keys, "key", "own")
    rare_bags, bag_sets = told_apart(bags, "tmdb", "bag")
    by_rare = rare_keys.join(rare_bags, "word").select("tmdb", "key", F.size(F.array_intersect("own", "bag")).cast("long").alias("shared")).distinct()
    of_set = settle(top_k(bag_sets, ["set"], [F.asc("tmdb")], k).select("tmdb", F.col("set").alias("bag_set")))
    sets = settle(key_sets.select("set").distinct())
    held = of_set.where(F.size("bag_set") <= LISTED).select("tmdb", F.explode(subsets(F.col("bag_set"))).alias("part"))
    held = top_k(held, ["part"], [F.asc("tmdb")], k).drop("rank")
    asked = sets.where(F.size("set") <= LISTED).select("set", F.explode(subsets(F.col("set"))).alias("part"))
    met = asked.join(held, "part").groupBy("set", "tmdb").agg(F.max(F.size(F.split(F.ltrim("part"), " "))).cast("long").alias("shared"))
    # sets of very many frequent words, on either side
    by_word = lambda df, name: df.withColumn("word", F.explode(name))
    bags_of = of_set.select("bag_set").distinct()
    large = by_word(sets.where(F.size("set") > LISTED), "set").join(by_word(bags_of, "bag_set"), "word")
    large = large.unionByName(by_word(sets.where(F.size("set") <= LISTED), "set").join(by_word(bags_of.where(F.size("bag_set") > LISTED), "bag_set"), "word"))
    large = large.groupBy("set", "bag_set").agg(F.count("*").alias("shared")).join(of_set, "bag_set").select("set", "tmdb", "shared")
    by_set = key_sets.join(met.unionByName(large), "set").select("tmdb", "key", "shared")
    equal = top_k(keyed, ["key"], [F.asc("tmdb")], k).select("tmdb", "key", F.lit(1 << 20).cast("long").alias("shared"))
    found = by_rare.unionByName(by_set).unionByName(keys.join(equal, "key").select("tmdb", "key", "shared"))
    best = top_k(found.groupBy("key", "tmdb").agg(F.max("shared").alias("shared")), ["key"], [F.desc("shared"), F.asc("tmdb")], k)
    return wanted.join(best, "key").select("title_id", "name", "tmdb", "shared", "rank")


class Searchable(NamedTuple):
    """Entities' names made ready once for every search: tmdb, entity_year, key, text (as a file name) and norm."""

    rows: DataFrame
    dated: bool


def searchable(names: DataFrame) -> Searchable:
    """``names``: tmdb, name and perhaps entity_year."""
    dated = "entity_year" in names.columns
    year = F.col("entity_year").cast("int") if dated else F.lit(None).cast("int")
    rows = names.select("tmdb", year.alias("entity_year"), N.match_key(F.col("name")).alias("key"), N.to_filename(F.col("name")).alias("text"), N.normalise_for_match(F.col("name")).alias("norm"))
    return Searchable(settle(rows.distinct()), dated)


def word_runs(key: Column) -> Column:
    """Every run of words of a text."""

    def runs(words: Column) -> Column:
        from_word = lambda _, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))
        return F.array_distinct(F.flatten(F.transform(words, from_word)))

    return N.let(F.split(key, " "), runs)


def _beside(words: Column, i: Column, n: Column) -> tuple[Column, Column]:
    """The words before and after the ``n`` words from place ``i`` on; null where there are none."""
    return F.when(i > 0, F.get(words, i - 1)), F.get(words, i + n)


def abbreviation_keys(norm: Column) -> Column:
    """what a reading's words, taken as abbreviations, must meet: initials, side and the word beside them.

    Neighbouring abbreviations spell one run, so every run of words of two
    letters or more is tried; the word before it, else that after it, must be
    there too. A reading that is nothing else has no such word.
    """

    def keys(words: Column) -> Column:
        def key(i: Column, n: Column) -> Column:
            before, after = _beside(words, i, n)
            run = F.slice(words, i + 1, n)
            row = F.struct(F.array_join(run, "").alias("initials"), F.when(before.isNotNull(), "L").when(after.isNotNull(), "R").otherwise("").alias("side"), F.coalesce(before, after, F.lit("")).alias("beside"))
            return F.when(F.forall(run, lambda w: F.length(w) >= 2), row)

        from_word = lambda _, i: F.array_compact(F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: key(i, n)))
        return F.flatten(F.transform(words, from_word))

    return N.let(F.split(norm, " "), keys)


def initial_keys(norm: Column) -> Column:
    """the same keys of a name: each run of two words or more by its initials, with the word before, after, and neither."""

    def keys(words: Column) -> Column:
        def three(i: Column, n: Column) -> Column:
            before, after = _beside(words, i, n)
            run = F.slice(words, i + 1, n)
            initials = F.array_join(F.transform(run, lambda w: F.left(w, F.lit(1))), "")
            row = lambda side, word: F.struct(initials.alias("initials"), F.lit(side).alias("side"), word.alias("beside"), F.array_join(run, " ").alias("run"))
            return F.array_compact(F.array(F.when(before.isNotNull(), row("L", before)), F.when(after.isNotNull(), row("R", after)), row("", F.lit(""))))

        from_word = lambda _, i: F.when(F.size(words) - i >= 2, F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.size(words) - i, F.lit(2))), lambda n: three(i, n))))
        return F.flatten(F.array_compact(F.transform(words, from_word)))

    return N.let(F.split(norm, " "), keys)


def scored_candidates(readings: DataFrame, names: DataFrame | Searchable, k: int = SEARCH_LIMIT, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """(title_id, wanted, tmdb, score): the ``k`` entities of each reading whose names score best, from ``cutoff`` on.

    No pair of names is compared because of a word they share. Equal names meet
    by their keys; names that hold all words of a reading, in order, by their
    runs of words; similar ones by their rarest letter pairs, as many as any
    name of that similarity must share; abbreviations by the initials of a run
    of words and the word beside it. Of names with one key, run and year the
    first ``k`` entities stand for all, as no other can come before them. If
    ``readings`` has name_year and ``names`` entity_year, only accepted years
    take a place among the ``k``.
    """
    if cutoff < BLOCKED:
        raise ValueError(f"the cutoff must be at least {BLOCKED}")
    told = names if isinstance(names, Searchable) else searchable(names)
    dated = "name_year" in readings.columns and told.dated
    wanted = readings.select(F.col("name").alias("wanted")).where("wanted is not null").distinct()
    wanted = settle(wanted.select("wanted", N.match_key(F.col("wanted")).alias("key"), N.collapse(F.col("wanted")).alias("text"), N.normalise_for_match(F.col("wanted")).alias("norm")))

    def first_of(column: str) -> DataFrame:
        rows = told.rows.select(column, "entity_year", "tmdb").distinct()
        return top_k(rows, [column, "entity_year"], [F.asc("tmdb")], k).drop("rank")

    scored = lambda df, score: df.select("wanted", "tmdb", "entity_year", F.lit(score).cast("double").alias("score"))
    of_key = first_of("key")
    equal = scored(wanted.where("key <> ''").join(of_key, "key"), 1.0)
    alike = scored(wanted.join(first_of("text"), "text"), 1.0)
    # names that hold the reading
    keys = wanted.where("key <> ''").select("key").distinct()
    runs = told.rows.select("key", "entity_year", "tmdb").distinct().select("entity_year", "tmdb", F.explode(word_runs(F.col("key"))).alias("key")).join(small(keys), "key", "left_semi")
    holds = scored(wanted.join(top_k(runs.distinct(), ["key", "entity_year"], [F.asc("tmdb")], k), "key"), CONTAINED_SCORE)
    # names that are similar
    whole = F.lit("").alias("show")
    # settled, else what follows is asked of every meeting, before its marks are
    pairs = settle(fuzzy_pairs(keys.select(whole, F.col("key").alias("p_key")), told.rows.where("key <> ''").select(whole, "key").distinct(), cutoff))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    near = pairs.where(~F.contains(spaced("key"), spaced("p_key"))).withColumn("score", H.similarity(F.col("p_key"), F.col("key"))).where(F.col("score") >= cutoff)
    near = near.join(of_key, "key").join(wanted.select("wanted", F.col("key").alias("p_key")), "p_key").select("wanted", "tmdb", "entity_year", "score")
    # names that the reading abbreviates
    short = settle(wanted.select("norm", F.inline(abbreviation_keys(F.col("norm")))).distinct())
    listed = ["initials", "side", "beside"]
    spelled = told.rows.select("norm", "key", "entity_year", "tmdb").distinct().select("norm", "key", "entity_year", "tmdb", F.inline(initial_keys(F.col("norm")))).join(small(short.select(*listed).distinct()), listed, "left_semi")
    spelled = settle(spelled.where(~F.array_contains(F.split("norm", " "), F.col("initials"))))
    is_whole = N.match_key(F.col("run")) == F.col("key")
    alone = top_k(spelled.where("side = ''").withColumn("whole", is_whole).select("initials", "whole", "entity_year", "tmdb", "norm").distinct(), ["initials", "whole", "entity_year"], [F.asc("tmdb"), F.asc("norm")], k)
    alone = alone.join(short.where("side = ''").select("initials", F.col("norm").alias("own")), "initials").select("own", "norm", "tmdb", "entity_year")
    beside = spelled.where("side <> ''").join(short.where("side <> ''").withColumnRenamed("norm", "own"), listed).select("own", "norm").distinct()
    beside = beside.join(first_of("norm"), "norm").select("own", "norm", "tmdb", "entity_year")
    met = settle(alone.unionByName(beside).distinct())
    expanded = met.select("own", "norm").distinct().withColumn("as_run", expand_initials(F.col("own"), F.col("norm"))).where("as_run is not null")
    expanded = settle(expanded).withColumn("score", name_score(F.col("as_run"), F.col("as_run"), F.col("norm"))).where(F.col("score") >= cutoff)
    abbreviated = expanded.join(met, ["own", "norm"]).join(wanted.select("wanted", F.col("norm").alias("own")), "own").select("wanted", "tmdb", "entity_year", "score")

    good = equal.unionByName(alike).unionByName(holds).unionByName(near).unionByName(abbreviated).where(F.col("score") >= cutoff)
    good = settle(good.groupBy("wanted", "tmdb", "entity_year").agg(F.max("score").alias("score")))
    rows = readings.select("title_id", F.col("name").alias("wanted"), (F.col("name_year").cast("int") if dated else F.lit(None).cast("int")).alias("name_year")).distinct()
    if dated:
        met = rows.select("wanted", "name_year").distinct().join(good, "wanted").where(G.year_accepted(F.col("entity_year"), F.col("name_year"), F.lit(False)))
        best = top_k(met.groupBy("wanted", "name_year", "tmdb").agg(F.max("score").alias("score")), ["wanted", "name_year"], [F.desc("score"), F.asc("tmdb")], k)
        best = best.withColumnsRenamed({"wanted": "w", "name_year": "y"})
        return rows.join(best, (F.col("wanted") == F.col("w")) & F.col("name_year").eqNullSafe(F.col("y"))).select("title_id", "wanted", "tmdb", "score")
    best = top_k(good.groupBy("wanted", "tmdb").agg(F.max("score").alias("score")), ["wanted"], [F.desc("score"), F.asc("tmdb")], k)
    return rows.join(best, "wanted").select("title_id", "wanted", "tmdb", "score")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_candidates(scored: DataFrame, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """Per title the complete candidates at the best score (ties stay), or the best incomplete one.

    ``scored``: title_id, tmdb, score, complete, entity_year, name_year, pinned.
    """
    ok = scored.where((F.col("score") >= F.when(F.col("pinned"), 0.0).otherwise(cutoff)) & G.year_accepted(F.col("entity_year"), F.col("name_year"), F.col("pinned")))
    top = ok.groupBy("title_id").agg(F.max("score").alias("top"), F.max(F.when(F.col("complete"), F.col("score"))).alias("top_complete"))
    joined = ok.join(top, "title_id")
    # an incomplete candidate that scores higher than every complete one is kept instead
    wins = F.coalesce(F.col("top_complete") >= F.col("top"), F.lit(False))
    best = joined.where(F.when(wins, F.col("complete") & (F.col("score") == F.col("top_complete"))).otherwise(F.col("score") == F.col("top")))
    n = F.count("*").over(Window.partitionBy("title_id"))
    return best.select("title_id", "tmdb", "score", "complete", (n > 1).alias("tied"))


def best_reading(results: DataFrame) -> DataFrame:
    """The best result per (title_id, rung); equal top scores of different complete entities tie."""
    w = Window.partitionBy("title_id", "rung")
    order = [F.desc("score"), F.desc("complete"), F.asc("place")]
    ranked = results.withColumns({"n": F.row_number().over(w.orderBy(*order)), "top": F.max("score").over(w)})
    at_top = ranked.where("score = top and complete").groupBy("title_id", "rung").agg(F.count_distinct("tmdb").alias("entities"))
    return ranked.where("n = 1").join(at_top, ["title_id", "rung"], "left").select("title_id", "rung", "tmdb", "score", "complete", (F.coalesce("entities", F.lit(0)) > 1).alias("tied"))


def best_guess(scored: DataFrame) -> DataFrame:
    """All candidates at a title's highest score."""
    return scored.join(scored.groupBy("title_id").agg(F.max("score").alias("score")), ["title_id", "score"])


def resolve_ids(pinned: DataFrame, entities: DataFrame) -> DataFrame:
    """Pinned ids (title_id, tmdb, imdb, tvdb) to entities; a differing second id drops the candidate, a gap is filled."""
    e = entities.select([F.col(c).alias(f"e_{c}") for c in ("tmdb", "imdb", "tvdb", "label", "year")])
    hits = [pinned.join(e, F.col(k) == F.col(f"e_{k}")) for k in ("tmdb", "imdb", "tvdb")]
    both = hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()
    differs = F.lit(False)
    for k in ("tmdb", "imdb", "tvdb"):
        differs = differs | F.coalesce(F.col(k) != F.col(f"e_{k}"), F.lit(False))
    filled = [F.coalesce(f"e_{k}", k).alias(k) for k in ("tmdb", "imdb", "tvdb")]
    gap = F.array_compact(F.array(*[F.when(F.col(f"e_{k}").isNull() & F.col(k).isNotNull(), k) for k in ("tmdb", "imdb", "tvdb")]))
    return both.where(~differs).select("title_id", *filled, F.col("e_label").alias("label"), F.col("e_year").alias("year"), gap.alias("filled"))


def identity_votes(rungs: DataFrame) -> DataFrame:
    """Per title the distinct entities of complete rungs, the agreeing rungs and the outcome.

    ``rungs``: title_id, place, rung, by_id, tmdb, complete. If the id rungs agree
    on one entity, names lose their vote.
    """
    votes = rungs.where("complete")
    ids = votes.where("by_id").groupBy("title_id").agg(F.count_distinct("tmdb").alias("id_entities"))
    counted = votes.join(ids, "title_id", "left").where("by_id or coalesce(id_entities, 0) <> 1")
    out = counted.groupBy("title_id").agg(
        F.array_sort(F.collect_set("tmdb")).alias("entities"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "rung"))), lambda x: x["rung"])).alias("rungs"),
    )
    first = rungs.groupBy("title_id").agg(F.min_by("tmdb", "place").alias("first"))
    done = first.join(out, "title_id", "left")
    n = F.coalesce(F.size("entities"), F.lit(0))
    outcome = F.when(F.col("entities").isNull() | (n == 0), "incomplete").when(n == 1, "resolved").otherwise("disagreement")
    tmdb = F.when(outcome == "resolved", F.col("entities")[0]).when(outcome == "incomplete", F.col("first"))
    return done.select("title_id", outcome.alias("outcome"), tmdb.alias("tmdb"), "entities", "rungs")


def agreeing_rungs(votes: DataFrame) -> DataFrame:
    """A16."""
    return identity_votes(votes).where("outcome = 'resolved'").select("title_id", "rungs")


def hold_guesses(titles: DataFrame, tied: DataFrame, resolved: DataFrame, scored: DataFrame) -> DataFrame:
    """Entities to offer for a held title: tied ones, else the resolved one, else the best guesses."""
    listed = lambda df, name: df.groupBy("title_id").agg(F.array_sort(F.collect_set("tmdb")).alias(name))
    out = titles.select("title_id").join(listed(tied, "t"), "title_id", "left").join(listed(resolved, "r"), "title_id", "left").join(listed(best_guess(scored), "g"), "title_id", "left")
    return out.select("title_id", F.coalesce("t", "r", "g", F.array().cast("array<string>")).alias("guesses"))


def drop_abbreviations(name: Column, is_word: Column) -> Column:
    """(rest, removed) without leading words that are no words; ``is_word`` is an array of booleans, one per word."""
    words = F.split(F.trim(name), r"\s+")
    first = F.array_position(is_word, True)
    rest = F.array_join(F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.size(words)), " ")
    removed = F.array_join(F.slice(words, 1, F.greatest(first - 1, F.lit(0)).cast("int")), " ")
    return F.when(first > 1, F.struct(rest.alias("rest"), removed.alias("removed")))


def unknown_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens of two or more letters that are in no word list."""
    clean = F.regexp_replace("token", r"""^[ .,:;!?'"()\[\]{}_-]+|[ .,:;!?'"()\[\]{}_-]+$""", "")
    rows = tokens.withColumn("word", F.lower(clean)).where(clean.rlike(r"^\p{L}{2,}$"))
    return rows.join(words.select("word").distinct(), "word", "left_anti")


def with_release_group(names: DataFrame, groups: DataFrame) -> DataFrame:
    """Names with ``is_group``: whether the word after the last hyphen is a release group.

    ``groups``: name, is_pattern. Literals join. Patterns, a vocabulary written
    by hand, are read into anchored alternations, so that each distinct word is
    tested where it is and no table of words meets a table of patterns.
    """
    word = N.group_word(F.col("name"))
    literal = groups.where("not is_pattern").select(F.lower("name").alias("literal")).distinct()
    rules = sorted(r["name"] for r in groups.where("is_pattern").select("name").distinct().collect())
    out = names.withColumn("word", word).join(small(literal), F.lower("word") == F.col("literal"), "left")
    by_rule = F.lit(False)
    for at in range(0, len(rules), PATTERNS):
        by_rule = by_rule | F.col("word").rlike("^(?:" + "|".join(f"(?:{r})" for r in rules[at : at + PATTERNS]) + ")$")
    return out.select(*names.columns, (F.col("literal").isNotNull() | F.coalesce(by_rule, F.lit(False))).alias("is_group"))


def trailing_drops(names: DataFrame) -> DataFrame:
    """F32: names (title_id, name, year) with 1..n last words dropped, at least half kept, only with a year."""
    words = F.split(F.trim("name"), r"\s+")
    most = F.floor(F.size(words) / 2).cast("int")
    rows = names.where("year is not null").withColumn("w", words).where(most >= 1).withColumn("dropped", F.explode(F.sequence(F.lit(1), most)))
    rows = rows.withColumn("short", F.array_join(F.slice("w", F.lit(1), F.size("w") - F.col("dropped")), " "))
    return rows.where(~F.lower("short").isin("the", "a", "an", "")).select("title_id", F.col("short").alias("name"), "year", "dropped")


def search_with_retries(readings: DataFrame, names: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates of readings (title_id, name, year); titles without one go on with abbreviations dropped, then last words.

    ``words`` is the list of known words.
    """

    told = searchable(names)

    def found(rows: DataFrame, step: int) -> DataFrame:
        return settle(scored_candidates(rows.select("title_id", "name"), told).select("title_id", "tmdb", "wanted", "score", F.lit(step).alias("step")))

    readings = settle(readings)
    first = found(readings, 1)
    rest = settle(readings.join(first.select("title_id").distinct(), "title_id", "left_anti"))
    tokens = settle(rest.select("title_id", "name", "year", F.posexplode(F.split(F.trim("name"), r"\s+")).alias("at", "token")))
    unknown = unknown_words(tokens.select("token").distinct(), words).select("token", F.lit(False).alias("known"))
    flags = tokens.join(unknown, "token", "left").groupBy("title_id", "name", "year").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("known", F.lit(True)).alias("k")))).alias("f"))
    short = settle(flags.withColumn("d", drop_abbreviations(F.col("name"), F.transform("f", lambda x: x["k"]))).where("d is not null").select("title_id", F.col("d.rest").alias("name"), "year"))
    second = found(short, 2)
    left = rest.join(second.select("title_id").distinct(), "title_id", "left_anti")
    drops = settle(trailing_drops(left.select("title_id", "name", "year")))
    third = found(drops, 3).join(drops.select("title_id", F.col("name").alias("wanted"), "dropped"), ["title_id", "wanted"])
    least = third.groupBy("title_id").agg(F.min("dropped").alias("dropped"))
    third = third.join(least, ["title_id", "dropped"]).drop("dropped")
    return first.unionByName(second).unionByName(third)


def movie_ladder(df: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The rungs of a movie, in order; ``df``: title_id, path, origin, tag_tmdb, tag_imdb, tag_title, tag_year, segment_title."""
    named = N.with_movie_readings(df, vocab, _segment=F.col("segment_title"), _file=N.stem(F.col("path")), _folder=N.parent_name(F.col("path")))
    return _ladder(
        named,
        [
            ("embedded tag", F.struct(F.col("tag_tmdb").alias("tmdb"), F.col("tag_imdb").alias("imdb"), F.lit(None).cast("string").alias("tvdb")), _one_reading(F.col("tag_title"), F.col("tag_year"))),
            ("file name ids", _ids(N.stem(F.col("path"))), None),
            ("folder ids", _ids(N.parent_name(F.col("path"))), None),
            ("origin folder ids", _ids(N.parent_name(F.col("origin"))), None),
            ("segment title", None, F.col("_segment")),
            ("file name", None, F.col("_file")),
            ("folder", None, F.col("_folder")),
        ],
    )


def show_ladder(df: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The rungs of a show, in order; ``df``: title_id, path, origin, tag_tvdb, tag_tmdb, tag_show."""
    tag = F.struct(F.col("tag_tmdb").alias("tmdb"), F.lit(None).cast("string").alias("imdb"), F.col("tag_tvdb").alias("tvdb"))
    return _ladder(
        df,
        [
            ("embedded tag", tag, _one_reading(F.col("tag_show"), F.lit(None).cast("int"))),
            ("folder ids", _ids(N.parent_name(F.col("path"))), None),
            ("upper folder ids", _ids(N.parent_name(F.col("path"), 2)), None),
            ("origin folder ids", _ids(N.parent_name(F.col("origin"))), None),
            ("origin upper folder ids", _ids(N.parent_name(F.col("origin"), 2)), None),
            ("file name", None, N.clean_show_name(N.stem(F.col("path")), N.parent_name(F.col("path")), N.season_from_folder(F.col("path")), vocab)),
        ],
    )


def _ids(name: Column) -> Column:
    found = N.ids_from_name(F.coalesce(name, F.lit("")))
    return F.struct(*[found[k].alias(k) for k in ("tmdb", "imdb", "tvdb")])


def _one_reading(name: Column, year: Column) -> Column:
    row = F.struct(name.alias("name"), year.cast("int").alias("year"), F.lit(None).cast("string").alias("label"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.array(row))


def _ladder(df: DataFrame, rungs: list[tuple[str, Column | None, Column | None]]) -> DataFrame:
    no_ids = F.lit(None).cast("struct<tmdb:string,imdb:string,tvdb:string>")
    no_readings = F.lit(None).cast("array<struct<name:string,year:int,label:string>>")
    rows = F.array(
        *[F.struct(F.lit(name).alias("rung"), (no_ids if ids is None else ids).alias("ids"), F.coalesce(no_readings if r is None else r, F.array().cast("array<struct<name:string,year:int,label:string>>")).alias("readings")) for name, ids, r in rungs]
    )
    out = df.select("title_id", F.posexplode(rows).alias("place", "r")).select("title_id", "place", "r.*")
    has_id = F.coalesce("ids.tmdb", "ids.imdb", "ids.tvdb").isNotNull()
    return out.where(has_id | (F.size("readings") > 0)).withColumn("by_id", has_id)


def identification_outcome(resolved: DataFrame) -> DataFrame:
    """Why a title stays unidentified. ``resolved``: title_id, outcome, entities, tied, same_year, name_year, weak_unlisted, missing (array)."""
    tie = F.when(F.col("name_year").isNull(), "the name gives no year").when(F.col("same_year"), "both were released in the same year").otherwise("the readings differ")
    text = (
        F.when(F.col("outcome") == "disagreement", F.concat(F.lit("sources disagree: "), F.array_join("entities", ", ")))
        .when(F.col("tied"), F.concat(F.lit("several entities fit: "), tie))
        .when(F.col("weak_unlisted"), "a bare number is no listed episode")
        .when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", ")))
        .when(F.col("outcome") != "resolved", "nothing found")
    )
    return resolved.select("title_id", text.alias("problem"))


def apply_pinned(titles: DataFrame, entities: DataFrame) -> DataFrame:
    """operators' fields over an entity's, differences noted; without an entity the identity is manual."""
    e = entities.select(F.col("tmdb").alias("e_tmdb"), F.col("label").alias("e_title"), F.col("year").alias("e_year"), F.col("imdb").alias("e_imdb"))
    out = titles.join(e, F.col("tmdb") == F.col("e_tmdb"), "left")
    notes = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"e_{c}"), F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(" instead of "), F.col(f"e_{c}").cast("string"))) for c in ("title", "year", "imdb")]))
    return out.select("title_id", *[F.coalesce(F.col(c), F.col(f"e_{c}")).alias(c) for c in ("title", "year", "imdb")], "tmdb", F.col("e_tmdb").isNull().alias("manual"), notes.alias("notes"))


def poster_url(identities: DataFrame, entities: DataFrame, base: str = "https://images.example/w342") -> DataFrame:
    """P74."""
    return identities.join(entities.select("tmdb", "poster_path"), "tmdb", "left").withColumn("poster_url", F.concat(F.lit(base), F.col("poster_path")))


def first_folder(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first folder by name."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("folder"))
    return matches.withColumn("_n", n).where("_n = 1").drop("_n")


def pick_file(files: DataFrame, edition: bool = False) -> DataFrame:
    """A folder's first file by name, plain ones before editions (or the other way round)."""
    is_edition = F.contains(N.stem(F.col("name")), F.concat("folder", F.lit(" - ")))
    n = F.row_number().over(Window.partitionBy("folder").orderBy(is_edition.cast("int") if not edition else -is_edition.cast("int"), "name"))
    return files.withColumn("_n", n).where("_n = 1").drop("_n")


def movie_incumbents(identities: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """The folder and file that a movie (title_id, title, year, tmdb, imdb) already has.

    Ids first, in the order of names; a folder with another tmdb id conflicts.
    Only a title without a folder by id falls back on the name, which is a key
    (every prefix of a folder that ends in a year), not a search.
    """
    f = folders.withColumn("ids", N.ids_from_name(F.col("folder"))).select("folder", F.col("ids.tmdb").alias("f_tmdb"), F.lower("ids.imdb").alias("f_imdb"))
    agreement = lambda df: df.where(~F.coalesce(F.col("tmdb") != F.col("f_tmdb"), F.lit(False)))
    by_tmdb = identities.join(f, F.col("tmdb") == F.col("f_tmdb"))
    by_imdb = agreement(identities.join(f, F.lower("imdb") == F.col("f_imdb")))
    by_id = first_folder(by_tmdb.unionByName(by_imdb).select("title_id", "folder").distinct(), ["title_id"]).withColumn("by", F.lit("id"))
    key = F.concat(N.to_filename(F.col("title")), F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    prefixes = f.select("folder", "f_tmdb", "f_imdb", F.explode(N.name_prefix_keys(F.col("folder"))).alias("key"))
    rest = identities.join(by_id.select("title_id"), "title_id", "left_anti").withColumn("key", key)
    named = agreement(rest.join(prefixes, "key")).where(~F.coalesce(F.lower("imdb") != F.col("f_imdb"), F.lit(False)))
    by_name = first_folder(named.select("title_id", "folder").distinct(), ["title_id"]).withColumn("by", F.lit("name"))
    return by_id.unionByName(by_name).join(pick_file(files), "folder", "left").select("title_id", "folder", "by", F.col("name").alias("file"))


def episode_codes(name: Column) -> Column:
    """Every text in a name that may be an episode's code: SxxEyy or SxxEyy-Ezz, and what starts one, as a code may go on in longer numbers."""
    found = F.regexp_extract_all(F.upper(name), F.lit(r"(S-?\d+E-?\d+(?:-E-?\d+)?)"), F.lit(1))
    # no code is shorter than S01E01 or longer than three whole numbers
    starts = lambda m: F.transform(F.sequence(F.lit(6), F.least(F.greatest(F.length(m), F.lit(6)), F.lit(40))), lambda n: F.left(m, n))
    return F.array_distinct(F.flatten(F.transform(found, starts)))


def tv_incumbents(identities: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """The file that an episode (title_id, show, show_year, tvdb, tmdb, season, episode, episode_last) already has.

    ``files``: folder (of the show), season, name. A range's code comes before the single one.
    Of the files of a season the first by name with each code stands for all, so
    that episodes meet codes and no season is paired out.
    """
    f = folders.withColumn("ids", N.ids_from_name(F.col("folder"))).select("folder", F.col("ids.tvdb").alias("f_tvdb"), F.col("ids.tmdb").alias("f_tmdb"))
    by_id = identities.join(f, F.col("tvdb") == F.col("f_tvdb")).unionByName(identities.join(f, (F.col("tmdb") == F.col("f_tmdb")) & ~F.coalesce(F.col("tvdb") != F.col("f_tvdb"), F.lit(False))))
    key = F.concat(N.to_filename(F.col("show")), F.lit(" ("), F.col("show_year").cast("string"), F.lit(")"))
    prefixes = f.select("folder", "f_tvdb", "f_tmdb", F.explode(N.name_prefix_keys(F.col("folder"))).alias("key"))
    named = identities.withColumn("key", key).join(prefixes, "key").where(~F.coalesce(F.col("tvdb") != F.col("f_tvdb"), F.lit(False)))
    ranked = by_id.select("title_id", "folder", F.lit(0).alias("r")).unionByName(named.select("title_id", "folder", F.lit(1).alias("r")))
    chosen = ranked.groupBy("title_id").agg(F.min(F.struct("r", "folder")).alias("c")).select("title_id", "c.folder")
    single = N.episode_code(F.col("season"), F.col("episode"))
    whole = N.episode_code(F.col("season"), F.col("episode"), F.col("episode_last"))
    codes = F.array(F.struct(F.lit(0).alias("rank"), whole.alias("code")), F.struct(F.lit(1).alias("rank"), single.alias("code")))
    asked = identities.join(chosen, "title_id").select("title_id", "folder", "season", F.inline(codes))
    first = files.select("folder", "season", "name", F.explode(episode_codes(F.col("name"))).alias("code")).groupBy("folder", "season", "code").agg(F.min("name").alias("name"))
    best = asked.join(first, ["folder", "season", "code"]).groupBy("title_id").agg(F.min(F.struct("rank", "name")).alias("b"))
    return chosen.join(best, "title_id", "left").select("title_id", "folder", F.col("b.name").alias("file"))


def find_incumbents(identities: DataFrame, areas: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Movie incumbents over areas of (folders, files), with why one is missing."""
    out = None
    for place, (folders, files) in enumerate(areas):
        rows = identities.select("title_id").join(movie_incumbents(identities, folders, files), "title_id", "left").withColumn("area", F.lit(place))
        out = rows if out is None else out.unionByName(rows)
    why = F.when(F.col("folder").isNull(), "no folder").when(F.col("file").isNull(), "no file in the folder")
    return out.withColumn("missing", why)
