"""Mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, its source's target divided
by the source's size. The whole part is taken for certain. The fractional
parts meet in pairs: a random share of words moves from one document to the
other until one of the two fractions is 0 or 1, so the expected copies of each
document and the source's words stay as they were. Blocks of documents are
folded this way, each block leaves at most one fractional document, and the
residuals of blocks meet in the next level of a reduction tree. A source's
words therefore miss its target by less than one document.

Only DataFrame functions are used. All randomness is a hash of the ids and the
seed, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a document of size 0 is never fractional and takes 0 words;
rows that repeat a document count as documents of their own, numbered where
they are equal, and share its copies alike but for one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents of one source that one fold takes, on average at most.
BLOCK = 64
#: Fractions this near to 0 or 1 count as integral.
EPS = 1e-9
#: Equal rows that one task numbers at most.
REPEATS = 1 << 14


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_order(sources: DataFrame, key: str = "source") -> DataFrame:
    """Adds ``rank``, from 0, by code point with null last.

    Ranges are numbered apart and shifted by the rows before them, so no task
    sees all the sources.
    """
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    ranged = common.cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % F.lit(1 << 33)))
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    shifts = spark.createDataFrame(rows, "part int, shift long")
    return ranged.join(F.broadcast(shifts), "part").select("*", (F.col("place") + F.col("shift")).alias("rank")).drop("part", "place", "shift")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size and target of each source.

    The whole size is shared by weight; a target stops at ``cap`` times its
    source's size and the excess is shared again among the others until none
    is above. Each round is one aggregate over the sources.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = common.cut(source_order(sizes))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        stopped = F.col("most") <= F.lit(level) * F.col("weight")
        n, full, open_weight = ranked.agg(
            F.count_if(stopped), F.sum(F.when(stopped, F.col("most")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - full) / open_weight, n
    return ranked.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _fold(level: int, seed: int) -> Column:
    """Folds ``items`` to done (items with 0 or 1) and kept (at most one fractional item)."""
    item = "struct<size:bigint,doc_id:bigint,mark:bigint,row:bigint,p:double>"
    item_type = T._parse_datatype_string(item)
    start = F.struct(
        F.lit(None).cast(item_type).alias("kept"),
        F.array().cast(T.ArrayType(item_type)).alias("done"),
    )

    def with_p(x: Column, p: Column) -> Column:
        whole = F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["mark"].alias("mark"), x["row"].alias("row"), whole.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        k = acc["kept"]
        # words that can move from x to k, and from k to x
        to_k = F.least((1 - k["p"]) * k["size"], x["p"] * x["size"])
        to_x = F.least(k["p"] * k["size"], (1 - x["p"]) * x["size"])
        u = (F.xxhash64(k["row"], x["row"], F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
        moved = F.when(u * (to_k + to_x) < to_x, to_k).otherwise(-to_x)
        new_k, new_x = with_p(k, k["p"] + moved / k["size"]), with_p(x, x["p"] - moved / x["size"])
        pair = F.struct(new_k.alias("k"), new_x.alias("x"))

        def settle(t: Column) -> Column:
            kf, xf = (t["k"]["p"] > 0) & (t["k"]["p"] < 1), (t["x"]["p"] > 0) & (t["x"]["p"] < 1)
            return F.struct(
                F.when(kf, t["k"]).when(xf, t["x"]).alias("kept"),
                F.concat(acc["done"], F.when(kf, F.array(t["x"])).when(xf, F.array(t["k"])).otherwise(F.array(t["k"], t["x"]))).alias("done"),
            )

        both = F.element_at(F.transform(F.array(pair), settle), 1)
        return F.when(k.isNull(), F.struct(x.alias("kept"), acc["done"].alias("done"))).otherwise(both)

    return F.aggregate("items", start, step)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row``, a hash that no two rows share: equal rows are counted, and the count is written out again as numbers.

    The rows are the same, however they were dealt out. Large counts are
    written out a stretch at a time by many tasks.
    """
    keys = rows.columns
    counts = common.cut(rows.groupBy(*keys).agg(F.count("*").alias("repeats")))
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.col("repeats") - 1) / REPEATS))
    last = F.least((F.col("stretch") + 1) * REPEATS, F.col("repeats")) - 1
    few = counts.where(F.col("repeats") <= REPEATS).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    many = counts.where(F.col("repeats") > REPEATS)
    out = few.select(*keys, "number")
    if not many.isEmpty():
        dealt = many.withColumn("stretch", F.explode(stretches)).repartition(*keys, "stretch")
        out = out.unionByName(dealt.withColumn("number", F.explode(F.sequence(F.col("stretch") * REPEATS, last))).select(*keys, "number"))
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("null")) if c in ("doc_id", "source") else F.col(c) for c in keys]
    return out.select(*keys, F.xxhash64(*filled, "number").alias("row"))


def round_copies(fractional: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """Rounds ``p`` of (source, doc_id, mark, size, p) to 0 or 1 within each source; 0 < p < 1 and size > 0."""
    rest = common.cut(numbered(fractional.select("source", "doc_id", "mark", "size", "p")))
    n = rest.count()
    done = []
    blocks, level = max(1, math.ceil(n / block)), 0
    while True:
        place = F.pmod(F.xxhash64(F.col("row"), F.lit(level), F.lit(seed)), F.lit(blocks))
        item = F.struct((-F.col("size")).alias("o"), "doc_id", "mark", "row", "p")
        items = F.transform(
            F.array_sort(F.collect_list(item)),
            lambda x: F.struct((-x["o"]).alias("size"), x["doc_id"].alias("doc_id"), x["mark"].alias("mark"), x["row"].alias("row"), x["p"].alias("p")),
        )
        folded = common.cut(rest.groupBy("source", place.alias("place")).agg(items.alias("items")).select("source", _fold(level, seed).alias("f")))
        done.append(folded.select("source", F.inline("f.done")))
        rest = folded.where("f.kept is not null").select("source", "f.kept.*")
        if blocks == 1:
            break
        blocks, level = max(1, math.ceil(blocks / block)), level + 1
    u = F.xxhash64(F.col("row"), F.lit(-1), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    out = rest.select("source", "size", "doc_id", "mark", "row", F.when(u < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    for d in done:
        out = out.unionByName(d)
    return out


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, mark (a hash of its text), source, size, source_size, target, copies, taken.

    ``docs`` needs doc_id, text and source.
    """
    sized = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark")))
    targets = common.cut(source_targets(sized, weights, cap))
    dim = common.small_or_not(targets.withColumnRenamed("source", "its_source"))
    rows = sized.join(dim, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = F.when(F.abs(share - F.round(share)) < EPS, F.round(share)).otherwise(share)
    rows = rows.withColumn("whole", F.floor(share)).withColumn("p", share - F.floor(share))
    is_open = (F.col("p") > 0) & (F.col("size") > 0)
    closed = rows.where(~is_open).withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long"))
    rounded = round_copies(rows.where(is_open), seed)
    opened = rounded.join(dim, F.col("source").eqNullSafe(F.col("its_source")), "left").withColumn(
        "copies", F.floor(F.col("target") / F.col("source_size")) + F.col("p").cast("long")
    )
    cols = ["doc_id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return closed.select(*cols).unionByName(opened.select(*cols))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """``plan`` without the marks."""
    return plan(docs, weights, cap, seed).drop("mark")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: the documents it takes, with all their columns, once for each copy.

    Added: mix_copy (from 1), mix_copies, mix_size, mix_source_size and
    mix_target. Documents without a copy are left out. Rows with one doc_id,
    text and source are one document here: the first by a hash of the other
    columns stands for all their copies.
    """
    key = ["doc_id", "mark", "source"]
    taken = plan(docs, weights, cap, seed).groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("n"), F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
    )
    taken = common.cut(taken.where("copies > 0").select(F.struct(*[F.col(c).alias(c) for c in (*key, "copies", "n", "size", "source_size", "target")]).alias("mix")))
    rows = docs.select(F.struct("*").alias("row"))
    own = F.col("row.doc_id").cast("long").eqNullSafe(F.col("mix.doc_id")) & F.col("row.source").eqNullSafe(F.col("mix.source")) & (_mark(F.col("row.text")) == F.col("mix.mark"))
    # nearly every document is taken: both sides are of the corpus's size
    met = rows.join(taken, own).select("row", "mix")
    out = met.where("mix.n = 1")
    if not taken.where("mix.n > 1").isEmpty():
        plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        out = out.unionByName(met.where("mix.n > 1").groupBy("mix").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in plain])).alias("row")).select("row", "mix"))
    copies = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))))
    return copies.select("row.*", "mix_copy", *[F.col("mix")[c].alias(f"mix_{c}") for c in ("copies", "size", "source_size", "target")])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
