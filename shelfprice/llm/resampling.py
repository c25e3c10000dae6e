"""Importance resampling towards a target: documents whose words and word pairs the target has more often go first.

Equal texts are grouped by the full text first. Features and weight are computed once for each distinct
text, its counts multiplied by how many rows have it, and the weight joined back to the rows; only then
comes the noise that is each document's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, lean, pick
from .textual import ALNUM, chunks, spans


def _crc_table() -> np.ndarray:
    """The table of CRC-32, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_START = np.uint32(0xFFFFFFFF)


def _advance(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the words' bytes: all words advance together, the longer ones further."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, left, out = starts[order], -sizes[order], state[order]
    for k in range(int(sizes.max(initial=0))):
        n = np.searchsorted(left, -k, side="left")
        out[:n] = _CRC[(out[:n] ^ buf[at[:n] + k]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def feature_buckets(texts: list[bytes], buckets: int, longest: int = 2) -> list[tuple[int, np.ndarray]]:
    """Of each text the number of words and the buckets of all runs of 1 to longest words: CRC-32 of the run, its words joined by a blank."""
    buf, starts, ends, first = spans(texts, ALNUM)
    n = len(starts)
    owner = np.searchsorted(first, np.arange(n), side="right") - 1
    blank = lambda state: _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
    state = _advance(np.full(n, _START), buf, starts, ends)
    found, owners = [(state ^ _START) % np.uint32(buckets)], [owner]
    for size in range(2, longest + 1):
        n -= 1
        if n < 1:
            break
        state = _advance(blank(state[:n]), buf, starts[size - 1 :], ends[size - 1 :])
        whole = owner[:n] == owner[size - 1 :]
        found.append(((state ^ _START) % np.uint32(buckets))[whole])
        owners.append(owner[:n][whole])
    both, whose = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    both, cuts = both[order], np.searchsorted(whose[order], np.arange(len(texts) + 1))
    return [(int(first[i + 1] - first[i]), both[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]


def _kind(buckets: int) -> str:
    """The smallest whole numbers that can name a bucket."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def text_features(texts: DataFrame, buckets: int, longest: int = 2) -> DataFrame:
    """(text, copies) to key (SHA-256 of the text, null of none), copies, n_words, n_features and features, the bucket of each."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for begin, data in chunks(column.to_pylist()):
                there = column.slice(begin, len(data)).is_valid().to_pylist()
                keys = [hashlib.sha256(b).hexdigest() if ok else None for b, ok in zip(data, there, strict=True)]
                counted = feature_buckets(data, buckets, longest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.string()), batch.column("copies").slice(begin, len(data)), pa.array([w for w, _ in counted], pa.int64()),
                        pa.array([len(f) for _, f in counted], pa.int64()), pa.array([f.astype(kind).tobytes() for _, f in counted], pa.binary()),
                    ],
                    ["key", "copies", "n_words", "n_features", "features"],
                )

    return texts.select("text", "copies").mapInArrow(lean(run), "key string, copies long, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all rows fall into each bucket. A task adds up in one array and sends a row a bucket."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one, copies in zip(batch.column("features").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(one, kind), copies)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return features.select("copies", "features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, both smoothed by one a bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[list(source)], t[list(target)] = list(source.values()), list(target.values())
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(features) to the floored mean of their gains, 0 without any."""
    kind = _kind(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, kind) for x in batch.column("features").to_pylist()]
            means = [int(gains[p].sum()) // len(p) if len(p) else 0 for p in parts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "n_words", "n_features")], pa.array(means, pa.int64())], ["key", "n_words", "n_features", "weight"])

    return features.select("key", "n_words", "n_features", "features").mapInArrow(run, "key string, n_words long, n_features long, weight long")


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g that depends on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scratch: Scratch, rows: DataFrame, order: list) -> DataFrame:
    """Rows with rank 1, 2, 3 ... in the order: ranges are sorted on their own and counted, so no task holds all rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # This number is the partition's, shifted, plus the place in it.
    dealt = scratch.keep(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row a range.
    placed = dealt.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return placed.withColumn("rank", F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1).drop("__part", "__at", "__before")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col="doc_id", text_col="text", target_text_col="text", buckets: int = 10_000, longest: int = 2, least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of each row: the highest scores are a draw, without replacement, towards the target.

    Features are all runs of 1 to longest words (letters, digits and what is beyond ASCII; A-Z lower-cased),
    hashed to buckets. The weight is the floored mean of a text's gains, 0 without features; the score adds
    the document's own noise. Of the N rows with at least least_words words the floor(percent * N / 100)
    highest scores have a rank from 1 on, ties by id; other rows have none.

    Null and empty texts have no words. Repeated rows are documents of their own with one score; a null id
    has a noise of its own and comes after other ids on ties; an empty target or table gives gains from the
    smoothing alone, or no rows. Very long texts are read whole. Other columns are not read. What the driver
    holds are two numbers a bucket.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    rows = pick(docs, id=id_col, text=text_col)
    grouped = lambda texts: text_features(texts.groupBy("text").agg(F.count("*").alias("copies")), buckets, longest)
    features = scratch.keep(grouped(rows))
    counts = [{r["bucket"]: r["n"] for r in bucket_counts(f, buckets).collect()} for f in (features, grouped(pick(target, text=target_text_col)))]
    # One row a distinct text, written before the join: then a text that very many rows have can be split.
    weights = scratch.keep(_weighed(features, _gains(*counts, buckets)))
    scratch.drop(features)
    keyed = rows.select("id", F.sha2("text", 256).alias("key"))
    scored = keyed.join(weights.withColumnRenamed("key", "key2"), F.col("key").eqNullSafe(F.col("key2"))).select(
        "id", "n_words", "n_features", "weight", (F.col("weight") + gumbel_noise(F.col("id"), seed)).alias("score")
    )
    # Equal rows are told apart by a number of their own, so that they need not be sorted in one task.
    scored = scratch.keep(scored.withColumn("tie", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= least_words
    drawn = scored.where(eligible).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("tie")]
    placed = ranked(scratch, scored.where(eligible), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return placed.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))).drop("tie")


def resampled(docs: DataFrame, drawn: DataFrame, *, id_col="doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, with all their columns; a null id is a value like any other."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    ids = drawn.where("rank is not null").select(F.col("id").alias("__id")).distinct()
    here = F.col(f"_{docs.columns.index(id_col)}").eqNullSafe(F.col("__id"))
    return plain.join(ids, here, "left_semi").toDF(*docs.columns)
