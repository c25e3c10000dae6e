"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full sets and connected groups.

Texts with equal shingle sets are one class and stand in by one row. Classes that share a band are
compared with the least class of that bucket; what such a comparison leaves apart is compared further:
within small buckets by signature, within large families in blocks of classes. Of a family only classes
whose shingles others have often enough to be like any of them are left, and only those of unlike
components meet. So no bucket's pairs are all emitted, and yet each candidate pair of unlike classes is
either joined or compared on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean, local_groups, numbered, pick
from .textual import chunks, mix, shingles

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint32(0xFFFFFFFF)


def super_minhash(sets: list[np.ndarray], m: int = 128, items_at_once: int = 1 << 16) -> np.ndarray:
    """Signatures of m values (uint32), one row a set; an empty set keeps the largest value throughout.

    A signature holds minima over a set's items, so a large set is taken in slices: the memory does not
    grow with it.
    """
    out = np.full((len(sets), m), _EMPTY, np.uint32)
    run, size = [], 0
    for i, s in enumerate(sets):
        for at in range(0, len(s), items_at_once):
            part = s[at : at + items_at_once]
            if run and size + len(part) > items_at_once:
                _lower(out, run, m)
                run, size = [], 0
            run.append((i, part))
            size += len(part)
    _lower(out, run, m)
    return out


def _lower(out: np.ndarray, run: list[tuple[int, np.ndarray]], m: int) -> None:
    """Bring the items of some sets (row of out, items) into their signatures.

    Step j gives each element of a set a value in [j, j + 1) at place p[j] of a random permutation p of
    the m places, so the places an element takes differ. A set is done when all its places are taken:
    later steps only give larger values. The upper 8 bits hold j, the others the fraction.
    """
    if not run:
        return
    rows = [i for i, _ in run]
    owner = np.repeat(np.arange(len(run)), [len(x) for _, x in run])
    items = np.concatenate([x for _, x in run])
    own = np.full((len(run), m), _EMPTY, np.uint32)
    places = np.tile(np.arange(m, dtype=np.uint8), (len(items), 1))
    flat = own.reshape(-1)
    for j in range(m):
        if not len(items):
            break
        x = mix(items + np.uint64((j + 1) * int(_GOLDEN) % (1 << 64)))
        k = j + ((x >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
        every = np.arange(len(items))
        at = places[every, k]
        places[every, k] = places[:, j]
        value = (np.uint32(j) << np.uint32(24)) | (x & np.uint64(0xFFFFFF)).astype(np.uint32)
        np.minimum.at(flat, owner * m + at, value)
        going = (own == _EMPTY).any(axis=1)[owner]
        if not going.all():
            items, owner, places = items[going], owner[going], places[going]
    np.minimum.at(out, rows, own)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a signature: signatures x bands, as int64."""
    n, m = signatures.shape
    rows = signatures.reshape(n, bands, m // bands).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
    for r in range(m // bands):
        key = mix(key * _GOLDEN + rows[:, :, r])
    return key.view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    """A digest of a sorted set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketches(rows: DataFrame, size: int, m: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column("text").to_pylist()):
                sets = shingles(texts, size)
                signatures = super_minhash(sets, m)
                keys = band_keys(signatures, bands)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                        pa.array([s.tobytes() if f else None for s, f in zip(signatures.astype(np.uint8), full, strict=True)], pa.binary()),
                        batch.column("tag").slice(start, len(texts)),
                    ],
                    ["id", "n_shingles", "key", "bands", "sig", "tag"],
                )

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, key binary, bands array<long>, sig binary, tag long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _texts(scratch: Scratch, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, text) of the classes wanted: (key, who), who the id and text hash of the class's first row."""
    wanted = scratch.keep(wanted.select("key", F.col("who.id").alias("id2"), F.col("who.tag").alias("tag2")))
    same = rows["id"].eqNullSafe(wanted["id2"]) & (rows["tag"] == wanted["tag2"])
    # What is wanted grows with the documents, so it is never broadcast, however small it is here.
    return scratch.keep(rows.join(wanted.hint("merge"), same).groupBy("key").agg(F.first("text").alias("text")))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, right = 0, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            while at < batch.num_rows:
                end, size_here = at, 0
                while end < batch.num_rows and (end == at or size_here < 1 << 22):
                    size_here += len(left[end]) + len(right[end])
                    end += 1
                sets = [[s for _, t in chunks(side[at:end]) for s in shingles(t, size)] for side in (left, right)]
                keep = pa.array([_alike(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
                yield batch.slice(at, end - at).select(["a", "b"]).filter(keep)
                at = end

    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a binary, b binary")


def _near_by_signature(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs whose signatures agree in at least so many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    a = classes.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a binary, b binary")


def _small_buckets(members: DataFrame, least: int) -> DataFrame:
    """Candidate pairs (a, b) within buckets of bounded size, of classes not yet joined and near by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for bucket in batch.column("bucket").to_pylist():
                sigs = np.frombuffer(b"".join(x["sig"] for x in bucket), np.uint8).reshape(len(bucket), -1)
                near = (sigs[:, None, :] == sigs[None, :, :]).sum(axis=2) >= least
                for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                    if bucket[i]["root"] != bucket[j]["root"]:
                        pairs.add((bucket[i]["key"], bucket[j]["key"]))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    buckets = members.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("key", "root", "sig"))).alias("bucket")).select("bucket").distinct()
    return buckets.mapInArrow(lean(run), "a binary, b binary").distinct()


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(key, text) to (key, n, shingles), the shingles as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(batch.column("text").to_pylist()):
                sets = [s.view(np.int64) for s in shingles(part, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(start, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "n", "shingles"]
                )

    return texts.select("key", "text").mapInArrow(lean(run), "key binary, n long, shingles array<long>")


def _shingle_counts(sets: DataFrame, items_at_once: int = 1 << 20) -> DataFrame:
    """family, shingle, times, key of the shingles of some sets, added up in the worker: key is one class that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(batch.column("n").to_numpy()), 0
            while at < batch.num_rows:
                done = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + items_at_once, side="right")))
                part = batch.slice(at, done - at)
                family, lists = part.column("family").dictionary_encode(), part.column("shingles")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                shingle, code = lists.flatten().to_numpy(), family.indices.to_numpy()[owner]
                order = np.lexsort((shingle, code))
                owner, shingle, code = owner[order], shingle[order], code[order]
                first = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] - 1) | np.diff(code, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [family.dictionary.take(pa.array(code[first])), pa.array(shingle[first]), pa.array(np.diff(first, append=len(shingle))), part.column("key").take(pa.array(owner[first]))],
                    ["family", "shingle", "times", "key"],
                )
                at = done

    return sets.select("family", "key", "n", "shingles").mapInArrow(lean(run), "family binary, shingle long, times long, key binary")


def _families(scratch: Scratch, members: DataFrame, texts: DataFrame, size: int, percent: int, block: int, block_shingles: int = 200_000) -> DataFrame:
    """Links (a, b) within families of large buckets, compared on full sets in pairs of blocks: enough links to join what is alike.

    members: centre, key, root (the component so far). A family is what large buckets join. A class that has
    over 100 - percent of its shingles to itself in its family is like none of it and goes first: one count
    of shingles, combined in the workers before the shuffle. Of the rest, those outside of the family's largest component
    meet all classes of other components. Blocks hold about ``block`` classes or block_shingles shingles, so
    a task holds two blocks whatever the family's size.
    """
    stars = members.select(F.col("centre").alias("a"), F.col("key").alias("b"))
    family = components(scratch, stars).select(F.col("node").alias("key"), F.col("root").alias("family"))
    roots = members.select("key", "root").unionByName(members.select(F.col("centre").alias("key"), F.col("centre_root").alias("root"))).distinct()
    sets = scratch.keep(_sets(texts.join(family.select("key"), "key", "left_semi"), size).join(family, "key").join(roots, "key"))
    counted = _shingle_counts(sets).groupBy("family", "shingle").agg(F.sum("times").alias("times"), F.min("key").alias("key"))
    alone = counted.where("times = 1").groupBy("key").agg(F.count("*").alias("alone"))
    live = sets.join(alone, "key", "left").where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * percent).drop("alone")
    live = scratch.keep(live)
    of_root = live.groupBy("family", "root").agg(F.count("*").alias("classes"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.sum("classes") / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    largest = of_root.groupBy("family").agg(F.max_by("root", F.struct("classes", "root")).alias("largest"))
    sides = of_root.join(largest, "family").withColumn("apart", F.col("root") != F.col("largest"))
    sides = sides.groupBy("family", "largest", "apart").agg(blocks.alias("blocks"))
    plan = scratch.keep(
        sides.groupBy("family", "largest").agg(F.coalesce(F.max(F.when(F.col("apart"), F.col("blocks"))), F.lit(0)).alias("few"), F.coalesce(F.max(F.when(~F.col("apart"), F.col("blocks"))), F.lit(0)).alias("most"))
    )
    # Blocks 0 .. few - 1 hold what is outside of the largest component; each meets itself and all blocks after it.
    dealt = live.join(plan.where("few > 0"), "family").withColumn("h", F.xxhash64("key"))
    outside = F.col("root") != F.col("largest")
    dealt = dealt.withColumn("own", F.when(outside, F.pmod("h", "few")).otherwise(F.col("few") + F.pmod("h", "most")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("few") + F.col("most")).otherwise(F.col("few")) - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "n", "shingles")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        lengths, roots = part["n"].to_numpy(), np.unique(part["root"].to_numpy(), return_inverse=True)[1]
        n = len(part)
        owner = np.repeat(np.arange(n), lengths)
        _, token, times = np.unique(np.concatenate(part["shingles"].to_numpy()), return_inverse=True, return_counts=True)
        owner, token = owner[times[token] > 1], token[times[token] > 1]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], np.unique(token[order], return_inverse=True)[1]
        both = np.zeros((n, n))
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, 8192):
            lo, hi = np.searchsorted(token, [low, low + 8192])
            dense = np.zeros((n, 8192), np.float32)
            dense[owner[lo:hi], token[lo:hi] - low] = 1
            both += dense @ dense.T
        links = (100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)) & (roots[:, None] != roots[None, :])
        group = local_groups(links)
        joined = np.flatnonzero(group != np.arange(n))
        keys = part["key"].to_numpy()
        return pd.DataFrame({"a": keys[group[joined]], "b": keys[joined]})

    return dealt.groupBy("family", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = 5, percent: int = 80, m: int = 128, bands: int = 32, small: int = 48, block: int = 256,
) -> DataFrame:
    """id, n_shingles, component_id, kept, tag (xxhash64 of the text) and stays of each row.

    Words are parted by white space, A-Z lower-cased; a text with fewer than size words has them all as
    one shingle. Two texts are linked where 100 * shared >= percent * all shingles of the two;
    component_id is the least id reachable by links, kept whether that is the row's own. A null, empty or
    blank text has no shingles, links with nothing and is kept. Repeated rows are copies and all carry
    their component; rows without an id take part with a null id and count after all ids. ``stays`` marks
    one text of each component also where ids are null or repeated: that of the least id, null last, and
    then of the least tag. An empty table gives an empty one; other columns are not read.

    With 32 bands of 4 values a pair at similarity 0.8 shares a band but for a chance of 5e-8. Signatures
    only rule out pairs six standard deviations below the threshold; links are confirmed on full sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    share = percent / 100
    least = max(1, ceil(m * (share - 6 * (share * (1 - share) / m) ** 0.5)))
    rows = pick(docs, id=id_col, text=text_col).withColumn("tag", F.xxhash64("text"))
    sketches = scratch.keep(_sketches(rows, size, m, bands))
    who = F.struct(F.col("id").isNull().alias("nameless"), "id", "tag")
    classes = scratch.keep(sketches.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(who).alias("who"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    banded = classes.select("key", F.explode("bands").alias("band"))
    # Tables of one row a band or key are written before they are joined: then a hot band or key can be split.
    shared = scratch.keep(banded.groupBy("band").agg(F.min("key").alias("centre"), F.count("*").alias("n")).where("n > 1"))
    members = scratch.keep(banded.join(shared, "band").where("key <> centre"))

    # Each class against the least of each of its buckets.
    first = members.select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    first = scratch.keep(_near_by_signature(first, classes, least))
    met = members.select("key").unionByName(members.select(F.col("centre").alias("key"))).distinct()
    texts = _texts(scratch, classes.select("key", "who").join(met, "key"), rows)
    links = scratch.keep(_verified(first, texts, size, percent))

    # Buckets whose other classes are still apart.
    joined = components(scratch, links)
    root_of = lambda key, root: joined.select(F.col("node").alias(key), F.col("root").alias(root))
    rest = members.join(root_of("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = scratch.keep(rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band"))
    rest = scratch.keep(rest.join(apart, "band").select("band", "centre", "key", "root", (F.col("n") - 1).alias("n")))
    few = rest.where(F.col("n") <= small).join(classes.select("key", "sig"), "key").select("band", "key", "root", "sig")
    second = scratch.keep(_small_buckets(few, least).join(first, ["a", "b"], "left_anti"))
    # What the first links have joined are stars by now, so that few rounds are left.
    links = joined.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(_verified(second, texts, size, percent))
    many = rest.where(F.col("n") > small)
    if not many.isEmpty():
        many = many.select("centre", "key", "root").distinct().join(root_of("centre", "centre_root"), "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
        links = links.unionByName(scratch.keep(_families(scratch, scratch.keep(many), texts, size, percent, block)))

    grouped = components(scratch, links).withColumnRenamed("node", "key").join(classes.select("key", "who"), "key")
    lowest = grouped.groupBy("root").agg(F.min("who").alias("head"))
    heads = classes.select("key", "who").join(grouped.select("key", "root").join(lowest, "root").select("key", "head"), "key", "left")
    heads = scratch.keep(heads.select("key", F.coalesce("head", "who").alias("head")))
    out = sketches.select("id", "n_shingles", "key", "tag").join(heads, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("head.id")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select("id", "n_shingles", "component_id", kept.alias("kept"), "tag", (F.col("key").isNull() | (kept & (F.col("tag") == F.col("head.tag")))).alias("stays"))


def keep_one_each(docs: DataFrame, near: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that near_duplicates lets stay, once each where rows are equal in id and text; all columns as they are.

    Of rows equal in id and text the one of least other columns (as JSON, so of any type) is taken. Null and
    empty texts stay, one for each id; an empty table gives an empty one; columns may have any names.
    """
    plain, at, back = numbered(docs)
    kept = near.where("stays").select(F.col("id").alias("id2"), F.col("tag").alias("tag2")).distinct()
    tagged = plain.withColumn("tag", F.xxhash64(at(text_col))).withColumn("row", F.to_json(F.struct(*[c for c in plain.columns if c != at(text_col)])))
    same = F.col(at(id_col)).eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2"))
    here = tagged.join(kept, same, "left_semi").groupBy(at(id_col), "tag").agg(F.min_by(F.struct(*plain.columns), "row").alias("one"))
    return back(here.select("one.*"))
