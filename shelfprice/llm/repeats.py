"""Substring dedup: all passages of a least length that stand in other documents too, by anchors and window hashes.

Each window of the least length holds an anchor, its 32 bytes of least gear hash; equal windows have equal
anchors, so only the surroundings of an anchor that several documents have are compared (winnowing). Of
equal windows the first (least id) stays and the others repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, lean, pick
from .textual import chunks, mix, word_hashes

_WINDOW = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rolling hash after each byte, over texts with a window of nothing between: (bytes, hashes, begins of texts).

    h(i) = gear(b(i)) + 2 h(i - 1) in 32 bits, so 32 bytes reach into it; by doubling, five steps give all.
    """
    gap = b"\0" * _WINDOW
    buf = np.frombuffer(gap.join(texts) + gap, np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + _WINDOW for t in texts])])
    h = _GEAR[buf]
    for begin, text in zip(at, texts, strict=False):
        h[begin + len(text) : begin + len(text) + _WINDOW] = 0
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return buf, h, at


def cut_points(texts: list[bytes], average: int = 24, least: int = 8, most: int = 384) -> list[list[int]]:
    """Where each text's chunks end. No chunk is under least bytes but the last, or over most; no character is cut."""
    buf, h, at = gear_hashes(texts)
    inner = (buf & 0xC0) == 0x80  # bytes inside a character
    found = np.flatnonzero(h < np.uint32((1 << 32) // average)) + 1
    for _ in range(3):
        found += inner[np.minimum(found, len(buf) - 1)]
    lows = np.searchsorted(found, at[:-1], side="right")
    out = []
    for begin, low, text in zip(at, lows, texts, strict=False):
        size, last, cuts = len(text), 0, []
        high = np.searchsorted(found, begin + size)
        for c in [*(found[low:high] - begin).tolist(), size]:
            while c - last > most:
                last += most
                while last < size and inner[begin + last]:
                    last -= 1
                cuts.append(last)
            if c > last and (c - last >= least or c == size):
                cuts.append(c)
                last = c
        out.append(cuts)
    return out


def _tag(text: bytes) -> int:
    """A hash of a whole text or a chunk, as a signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _edges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of a cut character each passage begins and ends with."""
    at = lambda i: buf[np.minimum(i, len(buf) - 1)]
    inner = [(at(starts + d) & 0xC0) == 0x80 for d in range(3)]
    lead = inner[0].astype(np.int32) + (inner[0] & inner[1]) + (inner[0] & inner[1] & inner[2])
    tail = np.zeros(len(ends), np.int32)
    for d, low in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        tail[buf[ends - d] >= low] = d
    return lead, tail


def anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Windows of size bytes by the anchor they hold: (bytes, begins of texts, text, first window, number of windows, anchor's end).

    An anchor is the 32 bytes of least hash in a window, the last such. It depends on the window alone, so
    equal windows have equal anchors, wherever they stand. Neighbouring windows with one anchor make one row.
    """
    buf, h, at = gear_hashes(texts)
    n = len(buf) - size + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(0, sizes - size + 1)
    if n < 1 or not count.any():
        none = np.zeros(0, np.int64)
        return buf, at, none, none, none, none
    places = (1 << 32) - 1 - np.arange(len(h), dtype=np.uint64)
    least, reach = (h.astype(np.uint64) << np.uint64(32)) | places, 1
    wide = size - _WINDOW + 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    owner = np.repeat(np.arange(len(texts)), count)
    begins = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[owner]
    ends = (1 << 32) - (least[begins + _WINDOW - 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(ends, prepend=-1) | np.diff(owner, prepend=-1))
    return buf, at, owner[new], begins[new], np.diff(new, append=len(owner)), ends[new]


def anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(id, text) to one row an anchor: id, tag (a hash of the whole text), hashes of the anchor and of all its windows' bytes, where they start, their number, cut characters at both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column("text").to_pylist()):
                buf, at, owner, begins, n, ends = anchors(texts, size)
                if len(owner):
                    stops = begins + n - 1 + size
                    lead, tail = _edges(buf, begins, stops)
                    tags = np.array([_tag(t) for t in texts], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(first + owner)), pa.array(tags[owner]), pa.array(word_hashes(buf, ends - _WINDOW, ends).view(np.int64)),
                            pa.array(word_hashes(buf, begins, stops).view(np.int64)), pa.array((begins - at[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(lead), pa.array(tail),
                        ],
                        ["id", "tag", "anchor", "around", "start", "n", "lead", "tail"],
                    )

    return docs.mapInArrow(lean(run), f"id {docs.schema['id'].dataType.simpleString()}, tag long, anchor long, around long, start int, n int, lead int, tail int")


def _tagged(rows: DataFrame) -> DataFrame:
    """(id, text) with the text's tag."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_tag(t) for t in data], pa.int64())], ["id", "text", "tag"])

    return rows.mapInArrow(lean(tag), f"id {rows.schema['id'].dataType.simpleString()}, text string, tag long")


def _surroundings(marked: DataFrame, size: int) -> DataFrame:
    """(text, marks) to each mark's anchor, around, crowded, first_id, last_id, nameless, the bytes of its windows and the cut characters of each (before + 4 * after)."""
    carried = ["anchor", "around", "crowded", "first_id", "last_id", "nameless"]
    kind = marked.schema["marks"].dataType.elementType["first_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marks")
            for first, texts in chunks(batch.column("text").to_pylist()):
                mine = lists.slice(first, len(texts))
                marks = pa.RecordBatch.from_struct_array(mine.flatten())
                owner = np.repeat(np.arange(len(texts)), mine.value_lengths().to_numpy(zero_copy_only=False))
                begins = np.cumsum([0, *[len(t) for t in texts[:-1]]])[owner] + marks.column("start").to_numpy()
                n = marks.column("n").to_numpy().astype(np.int64)
                data = b"".join(texts) + b" "
                firsts = np.cumsum(n) - n
                at = np.arange(n.sum()) - np.repeat(firsts - begins, n)
                lead, tail = _edges(np.frombuffer(data, np.uint8), at, at + size)
                cuts = pa.ListArray.from_arrays(pa.array(np.append(firsts, n.sum()).astype(np.int32)), pa.array((lead + 4 * tail).astype(np.int8)))
                whole = [data[x : x + k - 1 + size] for x, k in zip(begins.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[marks.column(c) for c in carried], pa.array(whole, pa.binary()), cuts], [*carried, "bytes", "cuts"])

    return marked.mapInArrow(lean(run), f"anchor long, around long, crowded boolean, first_id {kind}, last_id {kind}, nameless boolean, bytes binary, cuts array<tinyint>")


def repeated_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", min_bytes: int = 112, crowd: int = 1024) -> DataFrame:
    """Passages that other documents have too: id, tag, start, end, n_bytes, n_chunks, first_id, repeat_bytes, is_first.

    One row for each longest run of bytes that windows of min_bytes cover which stand under another id
    too, wherever they begin there: all such windows are found, whatever the text. Places are UTF-8 bytes,
    end exclusive; a character cut at an end is left out, and what then has less than min_bytes. A window
    comes first in the least id that has it; first_id is the least of the run's, repeat_bytes counts the
    bytes of windows that come first elsewhere, is_first says that all come first here, n_chunks counts the
    stretches of windows that have one anchor and one first id. Rows under one id are one document, and so
    are all rows without an id: what they repeat among themselves is no repeat; tag tells their texts apart.
    Null, empty and short texts have no rows; an empty table gives none; other columns are not read.

    min_bytes is 32 at least. Windows and texts are told by hashes of 64 bits. Where an anchor always has
    the same bytes around it, its windows repeat as one; windows are compared one by one only for anchors
    whose surroundings differ, once for all equal surroundings: in one task an anchor, but window by window
    over all tasks for anchors with more than crowd surroundings. What is found does not depend on crowd.
    """
    if min_bytes < _WINDOW:
        raise ValueError(f"min_bytes is under {_WINDOW}")
    rows, scratch = pick(docs, id=id_col, text=text_col), Scratch(docs.sparkSession, "repeats")
    pieces = anchor_rows(rows, min_bytes)
    ids = [F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max(F.col("id").isNull()).alias("nameless")]
    shared = (F.col("first_id") < F.col("last_id")) | (F.col("nameless") & F.col("first_id").isNotNull())
    # Only sums of fixed size go through the first shuffle; an anchor that a third of all rows have is added up before it.
    # They are written before the join, which then is of two plain tables: an anchor that many rows have can be split.
    seen = scratch.keep(pieces.groupBy("anchor").agg(*ids, (F.min("around") != F.max("around")).alias("varied")).where(shared).select("anchor", "first_id", "varied"))
    again = scratch.keep(pieces.join(seen, "anchor"))
    varied = again.where("varied").drop("first_id")
    marks = scratch.keep(varied.groupBy("anchor", "around").agg(*ids, F.min(F.struct("id", "tag", "start", "n")).alias("at")))
    crowds = scratch.keep(marks.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor", F.lit(True).alias("crowded")))
    marks = marks.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    marks = marks.groupBy(F.col("at.id").alias("id2"), F.col("at.tag").alias("tag2")).agg(
        F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.n").alias("n"), "anchor", "around", "crowded", "first_id", "last_id", "nameless")).alias("marks")
    )
    tagged = _tagged(rows)
    marked = tagged.join(marks, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2"))).select("text", "marks")
    around = scratch.keep(_surroundings(marked, min_bytes))

    def spread(surroundings: DataFrame) -> DataFrame:
        each = surroundings.select("anchor", "around", "first_id", "last_id", "nameless", "bytes", F.posexplode("cuts").alias("place", "cut"))
        return each.withColumn("window", F.xxhash64(F.substr("bytes", F.col("place") + 1, F.lit(min_bytes)))).drop("bytes")

    def stretches(windows: DataFrame) -> DataFrame:
        ordered = W.partitionBy("anchor", "around", "first_id").orderBy("place")
        return windows.withColumn("stretch", F.col("place") - F.dense_rank().over(ordered)).groupBy("anchor", "around", "first_id", "stretch").agg(
            F.min("place").alias("from"), F.max("place").alias("to"), F.min_by(F.col("cut").bitwiseAND(3), "place").cast("int").alias("lead"), F.max_by(F.shiftright("cut", 2), "place").cast("int").alias("tail")
        )

    def repeated(windows: DataFrame) -> DataFrame:
        same = W.partitionBy("anchor", "window")
        return windows.select(
            "anchor", "around", "place", "cut", F.min("first_id").over(same).alias("first_id"), F.max("last_id").over(same).alias("last_id"), F.max("nameless").over(same).alias("nameless")
        ).where(shared)

    # Dealt by anchor before windows are spread out: equal windows have equal anchors, so only surroundings are shuffled.
    few = repeated(spread(around.where("not crowded").repartition("anchor")))
    # The windows of a crowded anchor are spread out first and dealt one by one: each is a group of its own, no longer all of an anchor's.
    many = repeated(spread(around.where("crowded")))
    stretched = stretches(few).unionByName(stretches(many))
    one_by_one = varied.drop("lead", "tail").join(stretched, ["anchor", "around"])
    size = F.lit(min_bytes)
    found = again.where("not varied").select("id", "tag", (F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.col("n") - 1 + size - F.col("tail")).alias("end"), "first_id").unionByName(
        one_by_one.select("id", "tag", (F.col("start") + F.col("from") + F.col("lead")).alias("start"), (F.col("start") + F.col("to") + size - F.col("tail")).alias("end"), "first_id")
    )
    # Repeated rows count once; dealt by document, as the windows below need it.
    found = found.repartition("id", "tag").distinct().withColumn("is_first", F.col("id").eqNullSafe(F.col("first_id")))
    within = W.partitionBy("id", "tag").orderBy("start", "end", "first_id")
    before = within.rowsBetween(W.unboundedPreceding, -1)
    other = F.when(~F.col("is_first"), F.col("end"))
    fresh = F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True)).cast("int")
    counted = F.when(~F.col("is_first"), F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max(other).over(before), F.lit(0))))).otherwise(0).cast("long")
    runs = found.select("*", fresh.alias("fresh"), counted.alias("counted")).withColumn("run", F.sum("fresh").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return (
        runs.groupBy("id", "tag", "run")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), (F.max("end") - F.min("start")).cast("long").alias("n_bytes"), F.count("*").alias("n_chunks"), F.min("first_id").alias("first_id"),
            F.sum("counted").alias("repeat_bytes"), F.min("is_first").alias("is_first"),
        )
        .where(F.col("n_bytes") >= min_bytes)
        .drop("run")
    )


def cut_repeats(docs: DataFrame, spans: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, text of each row with the runs of repeated_spans that are not first cut out.

    Texts without such runs come back as they are, null ones too; repeated rows are cut alike; an empty
    table gives an empty one; other columns are not read.
    """
    rows = pick(docs, id=id_col, text=text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if text is not None and runs:
                    data, last, kept = text.encode(), 0, []
                    for r in sorted(runs, key=lambda r: r["start"]):
                        kept.append(data[last : r["start"]])
                        last = r["end"]
                    text = b"".join([*kept, data[last:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    gone = spans.where(~F.col("is_first")).groupBy(F.col("id").alias("id2"), F.col("tag").alias("tag2")).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    joined = _tagged(rows).join(gone, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2")), "left")
    return joined.select("id", "text", "runs").mapInArrow(lean(cut), f"id {kind}, text string")
