"""Removal of repeated byte strings by prefix doubling over positions.

A position's rank at a length says which string of that length begins there. A rank at twice the length is
the pair of the ranks at the position and at an offset of the length; ranks here are names, 64-bit
fingerprints of such pairs, so that a pair is made where the text is, in any order of tasks. Spark groups
the pairs of positions at growing lengths (16, 32, ... and at last the full length), and what no other
document has leaves after each round.

Not all positions are sent through the shuffles. Every window of the full length holds a sampled position:
the one of least 16-byte name among its places. Equal windows sample the same place, so only windows around
sampled positions whose names several documents have go on; equal surroundings of a sampled position go on
as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, pick
from .textual import mix, word_hashes

_BASE = 16
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A factor for each doubling, so that the places of a string weigh differently.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_PLACE = (1 << 24) - 1
_LIMIT = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _paired(low: np.ndarray, high: np.ndarray, round_: int) -> np.ndarray:
    """Names of pairs of names."""
    x = low * _FACTORS[round_]
    x += high
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    """mix() in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def names(buf: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Names of all positions at lengths 16, 32, 64 ... up to length, by the length, each from pairs of those at half of it."""
    now, size, out = _BYTES[buf], 1, {}
    for round_ in range(64):
        if 2 * size > length or len(now) <= size:
            return out
        now = _paired(now[:-size], now[size:], round_)
        size *= 2
        if size >= _BASE:
            now = _mixed(now)
            out[size] = now
    return out


def segments(texts: list, size: int, limit: int = _LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts (None: empty) as runs of about limit bytes: (text of each piece, its offset, pieces). A long text gives several pieces, each window of size bytes being in one of them."""
    run, rows, offsets, total = [], [], [], 0
    for i, t in enumerate(texts):
        data = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t)
        for offset in range(0, max(0, len(data) - size) + 1, limit) if len(data) >= size else ():
            piece = data[offset : offset + limit + size - 1]
            if run and total + len(piece) > limit:
                yield np.array(rows), np.array(offsets), run
                run, rows, offsets, total = [], [], [], 0
            run.append(piece)
            rows.append(i)
            offsets.append(offset)
            total += len(piece)
    if run:
        yield np.array(rows), np.array(offsets), run


def samples(pieces: list[bytes], size: int, length: int = _BASE) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of size bytes by the position they sample: (bytes, names up to length, begins of pieces, piece, first window, number of windows, sampled position)."""
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    name = names(buf, length)
    sizes = np.array([len(p) for p in pieces], np.int64)
    at = np.cumsum(sizes) - sizes
    least, reach, wide = name[_BASE] & np.uint64(~_PLACE & ((1 << 64) - 1)), 1, size - _BASE + 1
    least |= np.arange(len(least), dtype=np.uint64)
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    least &= np.uint64(_PLACE)
    # A run of windows with one sampled position ends where that changes, and where a piece's windows begin or end.
    begins = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, at, at + sizes - size + 1]))
    n = np.diff(begins, append=len(buf))
    owner = np.searchsorted(at, begins, side="right") - 1
    inside = begins < at[owner] + sizes[owner] - size + 1
    owner, begins, n = owner[inside], begins[inside], n[inside]
    return buf, name, at, owner, begins, n, least[begins].astype(np.int64)


def _sampled(rows: DataFrame, size: int) -> DataFrame:
    """(id, tag, text) to id, tag and the 16-byte name of each sampled position, runs of one name once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, pieces in segments(batch.column("text").to_pylist(), size):
                _, name, _, owner, _, _, spot = samples(pieces, size)
                found, whose = name[_BASE][spot], row[owner]
                new = np.flatnonzero((np.diff(found, prepend=found[:1] - np.uint64(1)) != 0) | (np.diff(whose, prepend=-1) != 0))
                take = pa.array(whose[new])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tag").take(take), pa.array(found[new].view(np.int64))], ["id", "tag", "name"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, tag int, name long")


def _levels(size: int) -> list[int]:
    """Lengths above the base at which one side of a sampled position, right or left of it, still lies within each window."""
    out, length = [], 2 * _BASE
    while length - _BASE <= (size - _BASE + 1) // 2:
        out.append(length)
        length *= 2
    return out


def _spots(marked: DataFrame, size: int) -> DataFrame:
    """(id, tag, text, names) to the sampled positions whose name is among names: id, tag, first window, number of windows, how far the first begins before the position, name of all bytes around, and names to the right and to the left at each level (0: not within a window)."""
    levels = _levels(size)
    sides = [f"{side}{length}" for length in levels for side in ("right", "left")]
    longest = max([_BASE, *levels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("names")
            for row, offset, pieces in segments(batch.column("text").to_pylist(), size):
                buf, name, at, owner, begins, n, spot = samples(pieces, size, longest)
                # A name and its row in one number: what is taken by chance is only more than is needed.
                own = mix(row[owner].astype(np.uint64)) ^ name[_BASE][spot]
                base = int(row[0])
                mine = lists.slice(base, int(row[-1]) - base + 1)
                whose = np.repeat(np.arange(base, base + len(mine)), mine.value_lengths().to_numpy(zero_copy_only=False))
                live = np.isin(own, mix(whose.astype(np.uint64)) ^ mine.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                owner, begins, n, spot = owner[live], begins[live], n[live], spot[live]
                ends = begins + n - 1 + size
                wide = []
                for length in levels:
                    table = name.get(length, np.zeros(1, np.uint64)).view(np.int64)
                    for fits, place in ((spot + length <= ends, spot), (spot + _BASE - length >= begins, spot + _BASE - length)):
                        wide.append(pa.array(np.where(fits, table[np.clip(place, 0, len(table) - 1)], 0)))
                take = pa.array(row[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("tag").take(take), pa.array((begins - at[owner] + offset[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((spot - begins).astype(np.int32)),
                        pa.array(word_hashes(buf, begins, ends).view(np.int64)), *wide,
                    ],
                    ["id", "tag", "start", "n", "lead", "around", *sides],
                )

    schema = f"id {marked.schema['id'].dataType.simpleString()}, tag int, start int, n int, lead int, around long"
    return marked.mapInArrow(lean(run), ", ".join([schema, *[f"{side} long" for side in sides]]))


def _mark(start: Column, n: Column, whole: Column) -> Column:
    """A run of n windows, and whether they are all lost, as one number."""
    return F.shiftleft(start.cast("long"), 32) + F.shiftleft(n.cast("long"), 1) + whole.cast("long")


def _marks(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of marks (null: none) as row, first window, number of windows, and whether all are lost."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row, x >> 32, (x >> 1) & 0x7FFFFFFF, (x & 1).astype(bool)


def _windows(marked: DataFrame, size: int) -> DataFrame:
    """(id, tag, text, marks) to one row a window of each mark that is not whole: id, tag, place, and the name of its size bytes, a pair of names that cover it."""
    half = _BASE
    while 2 * half <= size:
        half *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, start, n, whole = _marks(batch.column("marks"))
            whose, start, n = whose[~whole], start[~whole], n[~whole]
            piece_of = (whose << 32) | (start // _LIMIT)  # a mark's windows are within one piece
            order = np.argsort(piece_of, kind="stable")
            whose, start, n, piece_of = whose[order], start[order], n[order], piece_of[order]
            for row, offset, pieces in segments(batch.column("text").to_pylist(), size):
                key = (row << 32) | (offset // _LIMIT)
                low, high = np.searchsorted(piece_of, key[0]), np.searchsorted(piece_of, key[-1], side="right")
                mine = np.searchsorted(key, piece_of[low:high])
                sizes = np.array([len(p) for p in pieces], np.int64)
                at = np.cumsum(sizes) - sizes
                many, begins = n[low:high], start[low:high] - offset[mine] + at[mine]
                name = names(np.frombuffer(b"".join(pieces), np.uint8), half)[half]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                where = np.repeat(begins, many) + step
                both = mix(_paired(name[where], name[where + size - half], 63)).view(np.int64)
                take = pa.array(np.repeat(whose[low:high], many))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("tag").take(take), pa.array((np.repeat(start[low:high], many) + step).astype(np.int32)), pa.array(both)], ["id", "tag", "place", "window"]
                )

    return marked.mapInArrow(lean(run), f"id {marked.schema['id'].dataType.simpleString()}, tag int, place int, window long")


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """(id, text, marks, places) to id, n_bytes, spans and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, n, whole = _marks(batch.column("marks"))
            places = batch.column("places")
            alone = np.repeat(np.arange(len(places)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            row, start = np.concatenate([row[whole], alone]), np.concatenate([start[whole], places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)])
            n = np.concatenate([n[whole], np.ones(len(alone), np.int64)])
            # Runs of all texts at once: a text's places lie beyond all of the one before it.
            low, high = (row << 32) + start, (row << 32) + start + n - 1 + size
            order = np.argsort(low, kind="stable")
            low, reach = low[order], np.maximum.accumulate(high[order])
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(low)), bool), low[1:] > reach[:-1]]))
            begins, ends = low[new], reach[np.append(new[1:], len(low))[: len(new)] - 1]
            cuts = np.searchsorted(begins >> 32, np.arange(batch.num_rows + 1)).tolist()
            begins, ends = (begins & 0xFFFFFFFF).tolist(), (ends & 0xFFFFFFFF).tolist()
            n_bytes, spans, kept = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = text or b""
                n_bytes.append(len(data))
                a, b = begins[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]]
                spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)) if a else data)
            arrays = [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = 50) -> DataFrame:
    """id, n_bytes, spans, kept of each row: its UTF-8 bytes without those of any size-byte string that also begins in a document of a smaller id.

    spans are the longest runs of removed bytes, in order, end exclusive; kept is the rest, as bytes, since
    a run may end inside a character. Strings are judged on the input, so overlapping ones all count, and
    none reaches from one document into the next.

    Null and empty texts, and those under size bytes, lose nothing; rows without an id lose nothing and
    take nothing away; repeated rows and other texts under one id are one document, each judged against
    smaller ids; an empty table gives an empty one; very long texts are read whole, in pieces of a
    megabyte; other columns are not read. size is 17 at least. Strings are told by 64-bit names.
    """
    if size <= _BASE:
        raise ValueError(f"size must be over {_BASE}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")

    def done(df: DataFrame) -> DataFrame:
        """Written, after which Spark removes the shuffle files of what led there, as nothing reads them again."""
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            return scratch.keep(df)
        finally:
            spark.conf.set(_CLEANUP, before)

    def small(table: DataFrame) -> DataFrame:
        """A side of a join that has one row a key, a fraction of the other: hashed, so that neither positions nor texts are sorted. Its part grows with the data and the partitions alike."""
        return table.hint("shuffle_hash")

    rows = pick(docs, id=id_col, text=text_col).select("id", F.hash("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    long = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= size))
    by_text = [F.col("id").alias("id2"), F.col("tag").alias("tag2")]
    here = (F.col("id") == F.col("id2")) & (F.col("tag") == F.col("tag2"))
    # Round of 16 bytes. One row a name, written before the join: then a name that very many documents have can be split.
    spread = (F.min("id") < F.max("id")).alias("spread")
    sampled = done(_sampled(long, size))
    seen = done(sampled.groupBy("name").agg(spread).where("spread").select("name"))
    live = done(sampled.join(small(seen), "name", "left_semi").groupBy(*by_text).agg(F.collect_set("name").alias("names")))
    scratch.drop(seen, sampled)
    spots = done(_spots(long.join(small(live), here).select("id", "tag", "text", "names"), size))
    scratch.drop(live)
    # Equal surroundings of a sampled position are one class: all but the document that has it first lose it whole.
    sides = [c for c in spots.columns if c.startswith(("right", "left"))]
    classes = done(spots.groupBy("around").agg(F.min("id").alias("first"), F.max("id").alias("last"), *[F.first(c).alias(c) for c in sides]))
    # Rounds of 32 bytes and more: a class stays open if another that comes first elsewhere has its right or its left side.
    open_ = classes.select("around", "first", *sides, F.lit(True).alias("right"), F.lit(True).alias("left"))
    reach = _BASE
    for k, reach in zip(range(0, len(sides), 2), _levels(size), strict=True):
        rest = sides[k + 2 :]
        each = open_.select("around", "first", *rest, F.posexplode(F.array(*sides[k : k + 2])).alias("side", "wide")).where("wide <> 0")
        shared = done(each.groupBy("side", "wide").agg((F.min("first") < F.max("first")).alias("spread")).where("spread").select("side", "wide"))
        found = [F.bool_or(F.col("side") == i).alias(side) for i, side in enumerate(("right", "left"))]
        open_ = done(each.join(small(shared), ["side", "wide"], "left_semi").groupBy("around").agg(*[F.first(c).alias(c) for c in ("first", *rest)], *found))
    verdicts = done(classes.join(open_.select("around", "right", "left"), "around", "left").where("first < last or right or left").select("around", "first", "right", "left"))
    scratch.drop(classes, open_)
    # Only windows that hold a shared side can be shared: with the right one alone those that reach as far to the right, with the left one alone those that begin as far to the left.
    skip = F.when(F.col("left"), 0).otherwise(F.greatest(F.lit(0), F.col("lead") - (size - reach)))
    stop = F.when(F.col("right"), F.col("n")).otherwise(F.least("n", F.col("lead") - (reach - _BASE) + 1))
    whole = F.col("id") > F.col("first")
    mark = F.when(whole, _mark(F.col("start"), F.col("n"), F.lit(True))).otherwise(_mark(F.col("start") + skip, stop - skip, F.lit(False)))
    marks = spots.select("id", "tag", "start", "n", "lead", "around").join(small(verdicts), "around").where("id > first or right or left").groupBy(*by_text).agg(F.collect_set(mark).alias("marks"))
    marks = done(marks)
    scratch.drop(spots, verdicts)
    # The round of full length, window by window, for what is open in the document that has it first.
    some = marks.where(F.exists("marks", lambda m: m % 2 == 0))
    windows = done(_windows(long.join(small(some), here).select("id", "tag", "text", "marks"), size))
    least = done(windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("window", "least"))
    places = windows.join(small(least), "window").where(F.col("least") < F.col("id")).groupBy(*by_text).agg(F.collect_set("place").alias("places"))
    gone = done(marks.join(places, ["id2", "tag2"], "full_outer"))
    scratch.drop(windows, least, marks)
    return _cut(rows.join(small(gone), here, "left").select("id", "text", "marks", "places"), size)
