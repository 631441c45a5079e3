"""Episode titles against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import names as N
from ..functions.vocabulary import DEFAULT, Vocabulary
from .settle import settle

FUZZY_CUTOFF, CONTAINED_SHARE = 0.82, 0.5


def episode_catalogue(seasons: DataFrame) -> DataFrame:
    """(show, season, episode, title, runtime) out of nested seasons; rows without numbers go, runtime 0 is unknown."""
    rows = seasons.select("show", F.inline("seasons")).distinct().select("show", "season", F.inline("episodes"))
    rows = rows.where("season is not null and episode is not null")
    return rows.groupBy("show", "season", "episode").agg(F.min("title").alias("title"), F.nullif(F.max("runtime"), F.lit(0)).alias("runtime"))


def season_counts(catalogue: DataFrame) -> DataFrame:
    """A10."""
    return catalogue.groupBy("show", "season").agg(F.count("*").alias("n"))


def keyed(catalogue: DataFrame) -> DataFrame:
    """The catalogue with its match keys: key of the title, base and part number of its marker."""
    if {"key", "base", "part"} <= set(catalogue.columns):
        return catalogue
    # the marker as a column of its own is worked out once a row
    rows = catalogue.withColumn("_marker", N.parse_marker(F.col("title")))
    return rows.withColumns({"key": N.match_key(F.col("title")), "base": N.match_key(F.col("_marker.base")), "part": F.col("_marker.number")}).drop("_marker")


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def exact_index(catalogue: DataFrame) -> DataFrame:
    """The first catalogue row of each (show, key)."""
    return _first(keyed(catalogue), ["show", "key"], ["ordinal"])


def part_index(catalogue: DataFrame) -> DataFrame:
    """The first catalogue row of each (show, base, part)."""
    return _first(keyed(catalogue).where("part is not null"), ["show", "base", "part"], ["ordinal"])


def base_index(catalogue: DataFrame) -> DataFrame:
    """The lowest (season, episode) of each (show, base)."""
    return _first(keyed(catalogue), ["show", "base"], ["season", "episode", "ordinal"])


_HIT = ["season", "episode", "title", "runtime"]


def _named(df: DataFrame, keys: list[str], hit: str) -> DataFrame:
    return df.select(*keys, F.struct(*_HIT).alias(hit))


def match_exact(probes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Probes (probe_id, show, text) with the catalogue row of the first exact rung, and that rung."""
    p = probes.withColumn("_marker", N.parse_marker(F.col("text")))
    p = p.withColumns({"p_key": N.match_key(F.col("text")), "p_base": N.match_key(F.col("_marker.base")), "p_part": F.col("_marker.number")})
    exact, base, part = exact_index(catalogue), base_index(catalogue), part_index(catalogue)
    joins = [
        (_named(exact, ["show", "key"], "h1"), {"key": "p_key"}),
        (_named(part, ["show", "base", "part"], "h2"), {"base": "p_base", "part": "p_part"}),
        (_named(base, ["show", "base"], "h3"), {"base": "p_key"}),
        (_named(exact, ["show", "key"], "h4"), {"key": "p_base"}),
        (_named(base, ["show", "base"], "h5"), {"base": "p_base"}),
    ]
    out = p
    for i, (side, on) in enumerate(joins):
        side = side.select([F.col(c).alias(f"j{i}_{c}") if c in on or c == "show" else F.col(c) for c in side.columns])
        cond = F.col("show") == F.col(f"j{i}_show")
        for theirs, ours in on.items():
            cond = cond & (F.col(f"j{i}_{theirs}") == F.col(ours))
        out = out.join(side, cond, "left")
    # a probe with a part that is not listed must not land on the first part
    rungs = [F.col("h1"), F.col("h2"), F.col("h3"), F.col("h4"), F.when(F.col("p_part").isNull(), F.col("h5"))]
    rung = F.coalesce(*[F.when(r.isNotNull(), i + 1) for i, r in enumerate(rungs)])
    return out.select(*probes.columns, "p_key", "p_base", "p_part", F.coalesce(*rungs).alias("hit"), rung.alias("rung"))


def match_contained(probes: DataFrame, catalogue: DataFrame, min_share: float = CONTAINED_SHARE) -> DataFrame:
    """The longest catalogue base that starts a probe on whole words.

    Every word prefix of a probe is a key, so the join is an equality. ``probes``:
    probe_id, show, text, season, first (its own number). ``accepted`` is false
    for a hit that covers too little and is not the file's own number.
    """
    marker = F.col("_marker")
    p = probes.withColumn("_marker", N.parse_marker(F.col("text"))).withColumn("part", marker["number"]).withColumn("words", F.split(N.match_key(F.when(marker["number"].isNotNull(), marker["base"]).otherwise(F.col("text"))), " "))
    p = p.withColumn("base", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", F.lit(1), n), " "))))
    base = _named(base_index(catalogue).where("base <> ''"), ["show", "base"], "by_base")
    hits = p.join(base, ["show", "base"])
    best = hits.groupBy("probe_id").agg(F.max_by(F.struct("show", "base", "part", "by_base", "words", "season", "first"), F.struct(F.length("base"), "base")).alias("b")).select("probe_id", "b.*")
    part = _named(part_index(catalogue), ["show", "base", "part"], "by_part")
    out = best.join(part, ["show", "base", "part"], "left")
    hit = F.when(F.col("part").isNotNull(), F.col("by_part")).otherwise(F.col("by_base"))
    share = F.size(F.split("base", " ")) / F.size("words")
    own = (hit["season"] == F.col("season")) & (hit["episode"] == F.col("first"))
    return out.where(hit.isNotNull()).select("probe_id", hit.alias("hit"), share.alias("share"), ((share >= min_share) | F.coalesce(own, F.lit(False))).alias("accepted"))


#: Cutoff from which on similar texts must share pairs of letters.
BLOCKED = 0.7


def _letter_pairs(key: Column) -> Column:
    """The neighbouring letters of a text, each with the times it stood before, so that repeats count apart."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))
    return N.let(pairs, lambda ps: F.transform(ps, lambda p, i: F.concat(p, F.size(F.filter(F.slice(ps, F.lit(1), i), lambda q: q == p)).cast("string"))))


def _least_shared(total: Column, cutoff: float) -> Column:
    """Letter pairs that two texts of ``total`` letters share at least, if their similarity reaches the cutoff.

    Of total letters at most (1 - cutoff) * total are unmatched; each ends at
    most one matching stretch, and a stretch of n letters has n - 1 pairs.
    """
    return F.ceil(total * (1.5 * cutoff - 1) - 1 - 1e-9)


#: Words of 64 bits in which a text's letter pairs are marked.
MARKS = 4


def _with_marks(rows: DataFrame) -> DataFrame:
    """``rows`` with a bit for each of a text's letter pairs (``all``), by hash, in m0, m1, ..., and how many pairs share a bit with another (``spare``)."""
    bits = F.array_distinct(F.transform("all", lambda p: F.pmod(F.xxhash64(p), F.lit(64 * MARKS))))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))
    word = lambda at: F.aggregate(F.filter("bits", lambda b: F.floor(b / 64) == at), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(one(b)))
    return rows.withColumn("bits", bits).withColumns({**{f"m{at}": word(at) for at in range(MARKS)}, "spare": F.size("all") - F.size("bits")}).drop("bits")


def _most_shared() -> Column:
    """The most letter pairs that a probe and a key can share, by their marks."""
    both = [F.bit_count(F.col(f"p_m{at}").bitwiseAND(F.col(f"m{at}"))) for at in range(MARKS)]
    return sum(both, F.least("p_spare", "spare"))


def _prefixes(rows: DataFrame, counts: DataFrame, name: str, cutoff: float) -> DataFrame:
    """A row (show, ``name``, pair, all, first, size, marks) for each of the ``first`` rarest letter pairs of a text, enough to
    meet any similar text; ``all`` are its pairs, rarest first."""
    size = F.length(name)
    pairs = rows.select("show", name, F.explode(_letter_pairs(F.col(name))).alias("pair")).join(counts, ["show", "pair"], "left")
    ranked = pairs.groupBy("show", name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("pairs"))
    # the least partner is the shortest one
    least = _least_shared(size + F.ceil(size * cutoff / (2 - cutoff) - 1e-9), cutoff)
    first = F.greatest(F.size("pairs") - F.greatest(least, F.lit(0)) + 1, F.lit(1)).cast("int")
    listed = ranked.select("show", name, F.transform("pairs", lambda p: p["pair"]).alias("all"), first.alias("first"), least.alias("least"))
    listed = _with_marks(listed.withColumn("size", size))
    # texts so short that they need not share a pair meet under a mark of their own
    short = F.when(F.col("least") <= 0, F.array(F.lit(_SHORT))).otherwise(F.array().cast("array<string>"))
    return listed.select("show", name, "all", "first", "size", "spare", *[f"m{at}" for at in range(MARKS)], F.explode(F.concat(F.slice("all", F.lit(1), F.col("first")), short)).alias("pair"))


_SHORT = "short"


def fuzzy_pairs(probes: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """(show, p_key, key) of all pairs within a show whose similarity may reach the cutoff.

    Texts meet on their rarest letter pairs, so a show's titles are not paired
    out and a large show is spread over its letter pairs. Two texts that meet on
    several are kept where they meet on the rarest, so nothing is told apart
    afterwards; lengths, the marks of their letter pairs (a bound in a few machine
    words) and the count of shared pairs leave few to be compared.
    """
    probes, keys = settle(probes.select("show", "p_key").distinct()), settle(keys.select("show", "key").distinct())
    if cutoff < BLOCKED:
        return probes.join(keys, "show").where(H.similarity_bound(F.col("p_key"), F.col("key")) >= cutoff)
    counts = settle(keys.select("show", F.explode(_letter_pairs(F.col("key"))).alias("pair")).groupBy("show", "pair").agg(F.count("*").alias("n")))
    left, right = _prefixes(probes, counts, "p_key", cutoff), _prefixes(keys, counts, "key", cutoff)
    met = left.withColumnsRenamed({c: f"p_{c}" for c in left.columns if c not in ("show", "p_key", "pair")}).join(right, ["show", "pair"])
    total = F.col("p_size") + F.col("size")
    least = _least_shared(total, cutoff)
    met = met.where((2 * F.least("p_size", "size") >= cutoff * total - 1e-9) & (_most_shared() >= least))
    shared = F.array_intersect("p_all", "all")
    rarest = F.try_element_at(shared, F.lit(1))
    meets = F.coalesce((F.array_position("p_all", rarest) <= F.col("p_first")) & (F.array_position("all", rarest) <= F.col("first")), F.lit(False))
    kept = (F.size(shared) >= least) & F.when(F.col("pair") == _SHORT, ~meets).otherwise(rarest == F.col("pair"))
    return met.where(kept).select("show", "p_key", "key")


def match_fuzzy(probes: DataFrame, catalogue: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """The most similar title of the show, at least ``cutoff``; never for a probe with a part number.

    Only the rest after the exact joins comes here. A title is chosen by its
    similarity to the probe; the score is that of the probe to the title.
    """
    p = probes.where(N.parse_marker(F.col("text"))["number"].isNull()).withColumn("p_key", N.match_key(F.col("text")))
    p = settle(p.where("p_key is not null"))
    return p.join(_closest(p, catalogue, cutoff), ["show", "p_key"]).select("probe_id", "hit", "score")


def _closest(probes: DataFrame, catalogue: DataFrame, cutoff: float) -> DataFrame:
    """(show, p_key, hit, score): the closest catalogue title of each distinct key of a show."""
    c = exact_index(catalogue).select("show", "key", F.struct(*_HIT).alias("hit"))
    scored = fuzzy_pairs(probes, c, cutoff).withColumn("near", H.similarity(F.col("key"), F.col("p_key"))).where(F.col("near") >= cutoff)
    best = scored.groupBy("show", "p_key").agg(F.max_by("key", F.struct("near", "key")).alias("key"))
    return best.withColumn("score", H.similarity(F.col("p_key"), F.col("key"))).join(c, ["show", "key"]).select("show", "p_key", "hit", "score")


def match_number(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Files (file_id, show, season, first, weak) by their number; an unlisted weak number is told apart."""
    c = _first(catalogue, ["show", "season", "episode"], ["title"]).select("show", "season", F.col("episode").alias("first"), F.struct(*_HIT).alias("hit"))
    out = parsed.join(c, ["show", "season", "first"], "left")
    method = F.when(F.col("hit").isNotNull(), "number").when(F.col("weak"), "unlisted").otherwise("none")
    return out.select("file_id", "hit", method.alias("method"))


def episode_range(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Last episode and title of files whose names span several.

    ``matches``: file_id, show, season, episode, title (as matched), span (numbers
    after the first), duration_s. All numbers must be listed; one shared base is
    the title; else runtimes decide whether the file holds the first alone.
    """
    c = _first(catalogue, ["show", "season", "episode"], ["title"])
    numbered = matches.where("span > 0").select("file_id", "show", "season", F.explode(F.sequence("episode", F.col("episode") + F.col("span"))).alias("episode"))
    base = N.parse_marker(F.col("title"))["base"]
    listed = numbered.join(c.select("show", "season", "episode", base.alias("base"), "runtime"), ["show", "season", "episode"])
    sums = listed.groupBy("file_id").agg(
        F.count("*").alias("listed"), F.count_distinct("base").alias("bases"), F.min("base").alias("base"), F.sum("runtime").alias("together"), F.count("runtime").alias("timed")
    )
    first = c.select("show", "season", "episode", F.col("runtime").alias("alone"))
    out = matches.join(sums, "file_id", "left").join(first, ["show", "season", "episode"], "left")
    all_listed = F.coalesce(F.col("listed") == F.col("span") + 1, F.lit(False)) & (F.col("span") > 0)
    shared = (F.col("bases") == 1) & (F.col("base") != "")
    known = (F.col("timed") == F.col("span") + 1) & (F.col("duration_s") > 0)
    single = known & (F.abs(F.col("duration_s") - F.col("alone") * 60) < F.abs(F.col("duration_s") - F.col("together") * 60))
    spans = all_listed & (shared | ~F.coalesce(single, F.lit(False)))
    title = F.when(spans & shared, F.col("base")).otherwise(N.to_part_suffix(F.col("title")))
    return out.select("file_id", F.when(spans, F.col("episode") + F.col("span")).alias("last"), title.alias("title"), F.when(spans, shared).otherwise(True).alias("shared"))


def shared_words(a: Column, b: Column) -> Column:
    """Words that two titles share."""
    return F.array_intersect(F.split(N.match_key(a), " "), F.split(N.match_key(b), " "))


#: Kinds of keys in a title index: whole titles, bases with their part, and bases.
WHOLE, PART, BASE = "whole", "part", "base"


def title_index(catalogue: DataFrame) -> DataFrame:
    """One index of all keys, (show, kind, key, part, hit).

    Of rows with one whole key, or one base and part, the first counts; of
    those with one base that of the lowest number. ``part`` is -1 where a key
    has none.
    """
    row = lambda kind, key, part, *order: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), part.alias("part"), F.struct(*[o.cast("long").alias(f"o{i}") for i, o in enumerate(order)]).alias("order"))
    none, zero, at = F.lit(-1), F.lit(0), F.col("ordinal")
    rows = [row(WHOLE, "key", none, zero, zero, at), row(BASE, "base", none, F.col("season"), F.col("episode"), at), F.when(F.col("part").isNotNull(), row(PART, "base", F.col("part"), zero, zero, at))]
    keys = keyed(catalogue).select("show", F.struct(*_HIT).alias("hit"), F.inline(F.array_compact(F.array(*rows))))
    return keys.groupBy("show", "kind", "key", "part").agg(F.min_by("hit", "order").alias("hit"))


def _lookups(forms: Column, part: Column, text: Column) -> Column:
    """What one text of a file asks the index: the exact rungs of its forms, and every word prefix for containment.

    ``rank`` orders exact rungs (form, then rung); for a prefix it is its words,
    and for a prefix with the part number the same. ``use`` tells them apart.
    """
    row = lambda use, rank, kind, key, number: F.struct(F.lit(use).alias("use"), rank.alias("rank"), F.lit(kind).alias("kind"), key.alias("key"), number.alias("part"))
    none = F.lit(-1)

    def rungs(f: Column) -> Column:
        rank, marked, other = lambda n: f["form"] * 8 + n, f["part"].isNotNull(), f["base"] != f["key"]
        return F.array_compact(
            F.array(
                row("exact", rank(1), WHOLE, f["key"], none), F.when(marked, row("exact", rank(2), PART, f["base"], f["part"])), row("exact", rank(3), BASE, f["key"], none),
                F.when(other, row("exact", rank(4), WHOLE, f["base"], none)), F.when(other & ~marked, row("exact", rank(5), BASE, f["base"], none)),
            )
        )

    def prefixes(words: Column) -> Column:
        def of(n: Column) -> Column:
            head = F.array_join(F.slice(words, F.lit(1), n), " ")
            return F.array_compact(F.array(row("held", n, BASE, head, none), F.when(part.isNotNull(), row("part", n, PART, head, part))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), of))

    return F.filter(F.concat(F.flatten(F.transform(forms, rungs)), N.let(F.split(text, " "), prefixes)), lambda x: x["key"] != "")


def match_episodes(files: DataFrame, catalogue: DataFrame, cutoff: float = FUZZY_CUTOFF, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The catalogue row of each file, with method and score.

    ``files``: file_id, show, path, segment_title, season, first. Texts in order:
    the file's title, the segment title, the title without the show's name; each
    raw, cut at the first release token, and without tokens; then contained
    titles, then similar ones, before the next text. All exact rungs and
    contained titles of all texts meet one index of titles in one join; what no
    earlier text settled is compared by similarity.
    """
    catalogue = settle(keyed(catalogue))
    files = settle(files.withColumn("own", N.title_from_filename(F.col("path"), vocab=vocab)))
    stripped = lambda c: N.strip_release_tag(c, vocab)
    texts = F.posexplode(F.array("own", stripped(F.col("segment_title")), stripped(F.col("rest")))).alias("place", "raw")
    probes = settle(settle(files.withColumn("rest", N.without_show(F.col("own"), F.col("show")))).select("file_id", "show", "season", "first", texts).where("raw <> ''"))
    clean = F.btrim(F.regexp_replace(F.col("raw"), vocab.word, " "), F.lit(" ._-"))
    forms = settle(probes.select("file_id", "show", "season", "first", "place", F.posexplode(F.array("raw", N.cut_release_fields(F.col("raw"), vocab), clean)).alias("form", "text")))
    forms = forms.withColumn("m", N.parse_marker(F.col("text"))).select("file_id", "show", "season", "first", "place", "form", N.match_key(F.col("text")).alias("key"), N.match_key(F.col("m.base")).alias("base"), F.col("m.number").alias("part"))
    forms = forms.groupBy("file_id", "place").agg(*[F.first(c).alias(c) for c in ("show", "season", "first")], F.array_sort(F.collect_list(F.struct("form", "key", "base", "part"))).alias("forms"))
    cut, last = F.col("forms")[1], F.col("forms")[2]
    # a marker that only the cut text shows keeps a part that is not listed off the first part
    text = F.when(cut["part"].isNotNull(), cut["base"]).when(last["part"].isNotNull(), last["base"]).otherwise(last["key"])
    forms = settle(forms.select("file_id", "place", "show", "season", "first", "forms", F.coalesce(cut["part"], last["part"]).alias("number"), text.alias("text")))
    asked = forms.select("file_id", "place", "show", F.inline(_lookups(F.col("forms"), F.col("number"), F.col("text"))))
    met = asked.join(title_index(catalogue), ["show", "kind", "key", "part"])
    only = lambda use, c: F.when(F.col("use") == use, F.col(c))
    met = met.groupBy("file_id", "place").agg(
        F.min_by(only("exact", "hit"), only("exact", "rank")).alias("exact"), F.max_by(only("held", "hit"), only("held", "rank")).alias("held"), F.max(only("held", "rank")).alias("held_words"),
        F.max_by(only("part", "hit"), only("part", "rank")).alias("in_part"), F.max(only("part", "rank")).alias("part_words"),
    )
    rows = forms.join(met, ["file_id", "place"], "left")
    contained = F.when(F.col("number").isNull(), F.col("held")).when(F.col("part_words") == F.col("held_words"), F.col("in_part"))
    share = F.col("held_words") / F.size(F.split("text", " "))
    own = (contained["season"] == F.col("season")) & (contained["episode"] == F.col("first"))
    taken = contained.isNotNull() & ((share >= CONTAINED_SHARE) | F.coalesce(own, F.lit(False)))
    answer = lambda hit, method, score: F.struct("place", hit.alias("hit"), F.lit(method).alias("method"), score.cast("double").alias("score"))
    sure = F.when(F.col("exact").isNotNull(), answer(F.col("exact"), "exact", F.lit(1.0))).when(taken, answer(contained, "contains", share))
    rows = settle(rows.select("file_id", "show", "place", "number", last["key"].alias("p_key"), sure.alias("sure"), F.when(~taken, answer(contained, "contains", share)).alias("refused")))
    firm = rows.groupBy("file_id").agg(F.min(F.when(F.col("sure").isNotNull(), F.col("place"))).alias("firm"))
    # a similar title of an earlier text goes before a sure one of a later text
    open_ = settle(rows.join(firm, "file_id").where("number is null and p_key <> '' and (firm is null or place < firm)").select("file_id", "place", "show", "p_key"))
    close = open_.join(_closest(open_, catalogue, cutoff), ["show", "p_key"]).select("file_id", answer(F.col("hit"), "fuzzy", F.col("score")).alias("m"))
    found = rows.where("sure is not null").select("file_id", F.col("sure").alias("m")).unionByName(close)
    best = found.groupBy("file_id").agg(F.min_by("m", F.col("m.place")).alias("m"))
    # a refused hit wins if nothing else did and the listed title of the own number shares no word
    listed = catalogue.select("show", "season", F.col("episode").alias("first"), F.col("title").alias("listed"))
    refused = rows.where("refused.hit is not null").groupBy("file_id").agg(F.min_by("refused", "place").alias("refused"))
    out = files.join(best, "file_id", "left").join(refused, "file_id", "left").join(_first(listed, ["show", "season", "first"], ["listed"]), ["show", "season", "first"], "left")
    apart = F.col("listed").isNotNull() & (F.size(F.filter(shared_words(F.col("listed"), F.col("own")), lambda w: w != "")) == 0)
    chosen = F.coalesce(F.col("m"), F.when(apart, F.col("refused")))
    return out.select("file_id", chosen["hit"].alias("hit"), F.coalesce(chosen["method"], F.lit("none")).alias("method"), F.coalesce(chosen["score"], F.lit(0.0)).alias("score"))


def identify_tv(files: DataFrame, catalogue: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Title match, else number, then range, with the method and its score."""
    matched = settle(match_episodes(files, catalogue, vocab=vocab))
    numbers = match_number(files.select("file_id", "show", "season", "first", "weak"), catalogue).withColumnsRenamed({"hit": "n_hit", "method": "n_method"})
    both = matched.join(numbers, "file_id", "left").join(files.select("file_id", "show", "first", "last", "duration_s"), "file_id")
    hit = F.coalesce("hit", "n_hit")
    method = F.when(F.col("hit").isNotNull(), F.col("method")).otherwise(F.col("n_method"))
    span = F.coalesce(F.col("last") - F.col("first"), F.lit(0))
    rows = both.select("file_id", "show", hit.alias("h"), method.alias("method"), "score", "duration_s", span.alias("span"))
    ranged = episode_range(rows.where("h is not null").select("file_id", "show", "h.season", "h.episode", "h.title", "span", "duration_s"), catalogue)
    out = rows.join(ranged, "file_id", "left")
    return out.select("file_id", "show", F.col("h.season").alias("season"), F.col("h.episode").alias("episode"), "last", "title", "shared", "method", "score")
