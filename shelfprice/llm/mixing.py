"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

Each source's documents are cut into blocks of words. A source's share of all words fixes how many of
its blocks the mix takes (its quota). The quotas are split between the two halves of the output shards
by multivariate hypergeometric draws, and again below, until each shard has an exact quota of each
source; a shard then holds the next so many blocks of each source's random order, and shuffles them.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, numbered, pick

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) with the words to take from each source.

    Sources by code point, null last, weigh as in weights, repeating. Their targets share the sum of
    all sizes; one over ``most`` times its size stops there and the excess is shared again by weight.
    That is min(cap, level * weight), the level found by sorting sources by cap / weight. The windows
    below run over one row per source.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.col("source"))
    low_first = W.orderBy(F.col("rate"), F.col("source").isNull(), F.col("source"))
    every = W.partitionBy()
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("weight", F.element_at(kinds, (F.row_number().over(by_code) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("rate", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("below", F.coalesce(F.sum("cap").over(low_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(low_first.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("left"))
        .withColumn("at", F.min(F.when(F.col("level") <= F.col("rate"), F.struct("rate", "level"))).over(every)["level"])
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _draw(size: Column, marked: Column, taken: Column, u: Column) -> Column:
    """How many of ``taken`` items, drawn from ``size`` of which ``marked`` are marked, are marked.

    The inverse of the exact distribution by the ratios of neighbouring terms, over 12 standard
    deviations about the mean: what lies beyond has less weight than a double can hold.
    """

    def bounds(v: Column) -> Column:
        spread = F.ceil(12 * F.sqrt(v["mean"] * F.greatest((v["s"] - v["k"]) / F.greatest(v["s"], F.lit(1.0)), F.lit(0.0)))) + 12
        low = F.greatest(F.lit(0.0), v["n"] + v["k"] - v["s"], F.floor(v["mean"]) - spread)
        high = F.least(v["n"], v["k"], F.floor(v["mean"]) + spread)
        return F.struct(v["s"].alias("s"), v["k"].alias("k"), v["n"].alias("n"), v["u"].alias("u"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    def invert(v: Column) -> Column:
        """Two walks over the terms, the first one weighing 1: their sum, then where the sum passes u of it."""
        xs = F.when(v["high"] > v["low"], F.sequence(v["low"], v["high"] - 1)).otherwise(F.array().cast("array<long>"))
        ratio = lambda x: (v["k"] - x) * (v["n"] - x) / ((x + 1) * (v["s"] - v["k"] - v["n"] + x + 1))
        begin = lambda goal: F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("x"), goal.alias("goal"))

        def walk(a: Column, x: Column) -> Column:
            past = a["sum"] + a["w"]
            return F.struct((a["w"] * ratio(x)).alias("w"), past.alias("sum"), (a["x"] + (past < a["goal"]).cast("long")).alias("x"), a["goal"].alias("goal"))

        whole = _let(F.aggregate(xs, begin(F.lit(0.0)), walk), lambda a: a["sum"] + a["w"])
        return v["low"] + F.aggregate(xs, begin(v["u"] * whole), walk)["x"]

    mean = F.when(size > 0, taken.cast("double") * marked / size).otherwise(0.0)
    given = F.struct(size.cast("double").alias("s"), marked.cast("double").alias("k"), taken.cast("double").alias("n"), mean.alias("mean"), u.alias("u"))
    return _let(_let(given, bounds), invert)


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) from a digest of the key."""
    text = F.concat_ws("/", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) to (source, shard, n, first): each shard's share and the place in the source's order at which it begins.

    The tree has one array of quotas at each node, one level of nodes at a time; its leaves are shards.
    Nodes share out evenly: the left half gets half of its node's blocks, rounded down. A node holds one
    number per source; once there are a thousand nodes they are dealt to many tasks.
    """
    depth = max(0, (shards - 1).bit_length())
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))).alias("all")).select(
        F.col("all"), F.transform("all", lambda x: x["quota"]).alias("q"), F.lit(0).alias("shard")
    )
    for level in range(depth):
        width = 1 << (depth - level - 1)
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)

        def step(state: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), F.size(state["out"]))
            step_on = lambda got: F.struct((state["size"] - x).alias("size"), (state["take"] - got).alias("take"), F.concat(state["out"], F.array(got)).alias("out"))
            return _let(_draw(state["size"], x, state["take"], u), step_on)

        begin = F.struct(total.alias("size"), F.floor(total / 2).cast("long").alias("take"), F.array().cast("array<long>").alias("out"))
        node = node.withColumn("left", F.aggregate("q", begin, step)["out"])
        halves = F.array(
            F.struct(F.col("shard"), F.col("left").alias("q")),
            F.struct((F.col("shard") + width).alias("shard"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
        )
        node = node.select("all", F.explode(halves).alias("h")).select("all", F.col("h.q").alias("q"), F.col("h.shard").alias("shard"))
        if level == 9:
            node = node.repartition("shard")
    leaf = node.select("shard", F.explode(F.arrays_zip("all", "q")).alias("x")).select(F.col("x.all.source").alias("source"), "shard", F.col("x.q").alias("n"))
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return leaf.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mix_sources(
    docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most: float = 3.0,
    block_words: int | None = 256, shards: int | None = None, shard_words: int = 1 << 22, least_shards: int = 64, seed: int = 7, range_blocks: int = 50_000,
) -> DataFrame:
    """The mix as blocks: id, source, tag, copy, size, source_size, target, block, n_words, round, shard, slot.

    A document of n words gives ceil(n / block_words) blocks, or one where block_words is None. A target
    of q whole passes over the source and a rest asks for every block q times and, of the source's random
    order, as many leading blocks as come nearest to the rest: that number is the source's quota. The tree
    splits the quotas among the shards; a shard draws, of each source, as many blocks as its leaf says from
    where the shards before it stopped. What no leaf reaches is not taken. ``round`` numbers the passes
    from 1, ``slot`` is the place in its shard after the local shuffle.

    There is a shard for each shard_words words, least_shards at least, or as many as ``shards`` says,
    raised to a power of two. A source is sorted in ranges of its random key of about range_blocks blocks,
    so both follow the size of the input and a hot source is no single task. Sources are kinds of texts:
    a task holds a number for each.

    A block not taken, and the one block of a null or empty text, has null round, shard and slot, so each
    document has at least one row. Repeated rows are documents of their own, told apart by ``copy`` (equal
    texts under one id) and ``tag`` (other texts); a null id or source is a value like any other; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = pick(docs, id=id_col, text=text_col, source=source_col).select("id", "source", words.alias("size"), F.xxhash64("text").alias("tag"))
    alike = rows.groupBy("id", "source", "size", "tag").agg(F.count("*").cast("int").alias("copies"))
    rows = scratch.keep(alike.select("id", "source", "size", "tag", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")))

    sizes = scratch.keep(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    total = sizes.agg(F.sum("source_size").alias("words"), F.sum("docs").alias("docs")).first()
    all_words, n_blocks = total["words"] or 0, (total["docs"] or 0) + ((total["words"] or 0) // block_words if block_words else 0)
    shards = 1 << (max(shards or max(least_shards, ceil(all_words / shard_words)), 1) - 1).bit_length()
    digits = max(2, ceil(log(max(1, n_blocks / range_blocks), 16)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = source_targets(sizes.select("source", "source_size"), weights, most).select(F.col("source").alias("s1"), "source_size", "target", passes.alias("passes"))
    step = F.lit(block_words).cast("long") if block_words else F.greatest(F.col("size"), F.lit(1).cast("long"))
    last = F.greatest(F.ceil(F.col("size") / step).cast("long") - 1, F.lit(0).cast("long"))
    named = F.coalesce(F.col("id").cast("string"), F.lit(""))
    blocks = (
        rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        .withColumn("n_words", F.least(step, F.col("size") - F.col("block") * step))
        .withColumn("key", F.md5(F.concat_ws("/", F.lit(str(seed)), named, F.col("block").cast("string"))))
        .withColumn("range", F.substring("key", 1, digits))
    )
    # Each source's random order: ranges of the key are sorted on their own, after what lies before them.
    full = (F.col("n_words") > 0).cast("long")
    ranges = blocks.groupBy("source", "range").agg(F.sum("n_words").alias("words"), F.sum(full).alias("n"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("s2"), F.col("range").alias("r2"), F.sum("n").over(W.partitionBy("source")).alias("n_blocks"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    inside = W.partitionBy("source", "range").orderBy("key", "id", "tag", "copy", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    again = (F.col("upto") - F.col("n_words") / 2 <= rest) & (F.col("passes") < most)
    placed = scratch.keep(
        blocks.withColumn("upto", F.sum("n_words").over(inside)).withColumn("rank", F.sum(full).over(inside))
        .join(ranges, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
        .join(targets, F.col("source").eqNullSafe(F.col("s1")))
        .withColumn("upto", F.col("upto") + F.col("words_before")).withColumn("rank", F.when(F.col("n_words") > 0, F.col("rank") + F.col("n_before")))
        .withColumn("asked", F.when(F.col("n_words") > 0, F.col("passes") + again.cast("int")).otherwise(0))
        .select("id", "source", "tag", "copy", "size", "source_size", "target", "block", "n_words", "rank", "n_blocks", "passes", "asked")
    )
    # The tree: exact quotas, then which part of each source's order falls to which shard.
    quotas = placed.groupBy("source").agg(F.sum("asked").cast("long").alias("quota"))
    cell = shard_words // (block_words or 512) + 1
    whole = lambda c: F.floor(c / cell).cast("long")
    leaves = scratch.keep(split_quotas(quotas, shards, seed).where("n > 0").select(
        F.col("source").alias("s3"), "shard", "first", (F.col("first") + F.col("n")).alias("end"),
        F.explode(F.sequence(whole(F.col("first")), whole(F.col("first") + F.col("n") - 1))).alias("c3"),
    ))
    place = (F.col("round") - 1) * F.col("n_blocks") + F.col("rank") - 1
    turns = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("passes") + 1)).alias("round")).withColumn("place", place).withColumn("cell", whole(F.col("place")))
    here = F.col("source").eqNullSafe(F.col("s3")) & (F.col("cell") == F.col("c3")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end"))
    drawn = turns.join(leaves, here, "left").where(F.col("shard").isNotNull() | (F.col("round") == 1))
    shuffled = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit("slot"), named, F.col("block").cast("string"), F.col("round").cast("string")))
    local = W.partitionBy("shard").orderBy(shuffled, "id", "tag", "copy", "block", "round")
    out = ["id", "source", "tag", "copy", "size", "source_size", "target", "block", "n_words", "round", "shard", "slot"]
    live = drawn.where(F.col("shard").isNotNull()).withColumn("slot", F.row_number().over(local))
    idle = drawn.where(F.col("shard").isNull()).withColumns({"round": F.lit(None).cast("int"), "slot": F.lit(None).cast("int")})
    return live.select(*out).unionByName(idle.select(*out))


def taken_words(mix: DataFrame) -> DataFrame:
    """One row per document of mix_sources' blocks: id, source, tag, copy, size, source_size, target, taken, n_shards, placement.

    taken counts the words of the blocks that shards drew, n_shards the shards that drew any, placement is
    a digest of round, block, shard and slot of each. Documents of which nothing was drawn have 0, 0 and the
    digest of nothing; no rows give none.
    """
    drawn = F.filter(F.array_sort(F.collect_list(F.struct("round", "block", "shard", "slot", "n_words"))), lambda x: x["shard"].isNotNull())
    rows = mix.groupBy("id", "source", "tag", "copy", "size", "source_size", "target").agg(drawn.alias("drawn"))
    spelled = F.transform("drawn", lambda x: F.concat_ws(":", x["round"].cast("string"), x["block"].cast("string"), x["shard"].cast("string"), x["slot"].cast("string")))
    return rows.select(
        "id", "source", "tag", "copy", "size", "source_size", "target", F.aggregate("drawn", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("taken"),
        F.size(F.array_distinct(F.transform("drawn", lambda x: x["shard"]))).alias("n_shards"), F.md5(F.array_join(spelled, ",")).alias("placement"),
    )


def mixed_documents(docs: DataFrame, mix: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs as often as a mix of whole documents (block_words None) takes them, in the order of its shards.

    Each copy of a row (equal id and text) is drawn on its own, but which of several rows that differ in
    other columns a draw means is not told apart: the one of least other columns (as JSON) stands for all. Null and
    empty texts have no words and so no place in a mix; an empty table gives an empty one; columns may have
    any names.
    """
    plain, at, back = numbered(docs)
    turns = mix.where(F.col("round").isNotNull()).groupBy(F.col("id").alias("id2"), F.col("tag").alias("tag2")).agg(F.collect_list(F.struct("shard", "slot")).alias("turns"))
    tagged = plain.withColumn("tag", F.xxhash64(at(text_col))).withColumn("row", F.to_json(F.struct(*[c for c in plain.columns if c != at(text_col)])))
    one = tagged.groupBy(at(id_col), "tag").agg(F.min_by(F.struct(*plain.columns), "row").alias("one"))
    joined = one.join(turns, F.col(at(id_col)).eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2")))
    placed = joined.select("one.*", F.explode("turns").alias("turn"))
    return back(placed.repartition("turn.shard").sortWithinPartitions("turn.shard", "turn.slot"))
