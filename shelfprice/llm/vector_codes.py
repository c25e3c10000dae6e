"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Vectors are kept as columnar blocks of whole numbers. A round is one treeAggregate over the blocks: the
distances to a part's entries grow dimension by dimension, sums and counts of the parts of each entry are
added up in whole-number tensors, and those merge through a tree of reductions. Whole numbers add up to
the same in any order, so a lost task that runs again changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Up to this size of components, sums of squares and of components stay within 64 bits.
_NARROW = 1 << 26
_MOST = (1 << 63) - 1


def _exact(x: float, scale: int) -> int:
    """floor(scale * x), also where it is beyond 64 bits: a number of 2 ** 53 or more is whole."""
    return int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale))


def _kept(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, size, narrow and numbers, floor(scale * x) of each component, of the vectors that can be coded.

    numbers holds 64-bit numbers where all are narrow, else decimal text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            there = column.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(there, column.value_lengths().fill_null(0).to_numpy(), 0)
            ends = np.cumsum(sizes)
            x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is no number
            fine = np.concatenate([[0], np.cumsum(np.isfinite(x))])
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(x * scale)
            small = np.concatenate([[0], np.cumsum(np.abs(y) < _NARROW)])
            at = np.flatnonzero(there & (fine[ends] - fine[ends - sizes] == sizes))
            narrow = (small[ends] - small[ends - sizes] == sizes)[at]
            spans = list(zip((ends - sizes)[at].tolist(), ends[at].tolist(), narrow.tolist(), strict=True))
            numbers = [y[a:b].astype("<i8").tobytes() if ok else ",".join(str(_exact(v, scale)) for v in x[a:b].tolist()).encode() for a, b, ok in spans]
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array(sizes[at].astype(np.int32)), pa.array(narrow), pa.array(numbers, pa.binary())], ["id", "label", "size", "narrow", "numbers"]
            )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, size int, narrow boolean, numbers binary")


def _matrix(numbers: list[bytes], narrow: list[bool], size: int, parts: int) -> np.ndarray:
    """Vectors as columns by part: (parts, components of a part, vectors), zeros where the last part is filled up."""
    wide = -(-size // parts)
    kind = np.int64 if all(narrow) else object
    out = np.zeros((len(numbers), parts * wide), kind)
    for i, (one, ok) in enumerate(zip(numbers, narrow, strict=True)):
        out[i, :size] = np.frombuffer(one, "<i8") if ok else [int(x) for x in one.split(b",")]
    return np.ascontiguousarray(out.T.reshape(parts, wide, len(numbers)))


def _blocks(kept: DataFrame, size: int, parts: int, rows: int) -> DataFrame:
    """One row a block of up to so many vectors: ids, labels, n, whether it is of 64-bit numbers, and the numbers by part, component and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                x = _matrix(part.column("numbers").to_pylist(), part.column("narrow").to_pylist(), size, parts)
                narrow = x.dtype != object
                data = x.astype("<i8").tobytes() if narrow else ",".join(map(str, x.ravel())).encode()
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [one("id"), one("label"), pa.array([part.num_rows], pa.int32()), pa.array([narrow]), pa.array([data], pa.binary())], ["ids", "labels", "n", "narrow", "data"]
                )

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    return kept.select("id", "label", "narrow", "numbers").mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, n int, narrow boolean, data binary")


def _block(data: bytes, narrow: bool, n: int, parts: int) -> np.ndarray:
    flat = np.frombuffer(data, "<i8") if narrow else np.array([int(x) for x in bytes(data).split(b",") if x], object)
    return flat.reshape(parts, -1, n)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part and vector the nearest entry (the first of equally near ones) and its squared distance."""
    parts, wide, n = x.shape
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    codes, least = np.zeros((parts, n), np.int64), np.zeros((parts, n), x.dtype)
    for p in range(parts):
        far = np.zeros((book.shape[1], n), x.dtype)
        for d in range(wide):
            step = x[p, d][None, :] - book[p, :, d][:, None]
            far += step * step
        codes[p] = far.argmin(axis=0)
        least[p] = far[codes[p], np.arange(n)]
    return codes, least


def _added(total: tuple[np.ndarray, np.ndarray], row, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts with a block's parts added to the entries that they are nearest to."""
    sums, counts = total
    x = _block(row["data"], row["narrow"], row["n"], len(book))
    if x.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    codes, _ = _nearest(x, book)
    for p in range(len(book)):
        np.add.at(sums[p], codes[p], x[p].T.astype(sums.dtype))
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def train_codebooks(blocks: DataFrame, book: np.ndarray, rounds: int, depth: int = 3) -> np.ndarray:
    """The codebooks (parts, entries, components of a part) after so many rounds: each entry becomes the floored mean of its parts, an unused one stays.

    A round sends the codebooks to the tasks and gets sums and counts of the same size back, whatever the
    number of vectors.
    """
    numbers = blocks.select("data", "narrow", "n").rdd
    for _ in range(rounds):
        zero = (np.zeros(book.shape, book.dtype), np.zeros(book.shape[:2], np.int64))
        sums, counts = numbers.treeAggregate(zero, lambda total, row, now=book: _added(total, row, now), _merged, depth)
        used = counts > 0
        if sums.dtype == object:
            book = book.astype(object)
        book = book.copy()
        book[used] = sums[used] // counts[used][:, None].astype(sums.dtype)
    return book


def _coded(blocks: DataFrame, book: np.ndarray, kinds: dict[str, str]) -> DataFrame:
    """id, label, code and error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n = one.column("n")[0].as_py()
                codes, least = _nearest(_block(one.column("data")[0].as_py(), one.column("narrow")[0].as_py(), n, len(book)), book)
                text = ["".join(f"{c:02x}" for c in column) for column in codes.T.tolist()]
                errors = [min(int(e), _MOST) for e in least.sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress_vectors(
    table: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block_rows: int = 2048, depth: int = 3,
) -> tuple[DataFrame, np.ndarray]:
    """id, label, code, error, label_error of each vector that can be coded, and the codebooks (parts, entries, components of a part).

    Components become floor(scale * x), vectors are cut into equal consecutive parts. A part's codebook
    begins as that part of the vectors of the least ids, as many as entries. The code has two hex digits a
    part, the error is the squared distance to the entries, label_error its sum over a label, null labels
    together.

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors are as long as
    that of the least id; others are left out too, and where the length is no multiple of parts the last one
    is filled up with zeros. Repeated rows are vectors of their own; equal ids are taken in the order of
    their components, null ids last; a table of fewer vectors than entries has that many entries; an empty
    one gives no rows and a codebook without entries. Components of any size are coded exactly; an error
    beyond 64 bits is given as the greatest long. Other columns are not read. Blocks are read again from the
    shared folder in each round, so a lost executor costs its tasks of that round.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries of 1 to 256 have a code of two hex digits")
    scratch = Scratch(table.sparkSession, "codes")
    rows = pick(table, id=id_col, vector=vector_col, label=label_col)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    kept = scratch.keep(_kept(rows, scale))
    order = [F.asc_nulls_last("id"), "numbers"]
    first = kept.orderBy(*order).limit(1).collect()
    size = first[0]["size"] if first else 0
    kept = kept.where(F.col("size") == size)
    heads = kept.orderBy(*order).limit(entries).collect()
    x = _matrix([bytes(r["numbers"]) for r in heads], [r["narrow"] for r in heads], size, parts)
    book = np.ascontiguousarray(x.transpose(0, 2, 1))
    if not heads:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), book
    blocks = scratch.keep(_blocks(kept, size, parts, block_rows))
    book = train_codebooks(blocks, book, rounds, depth)
    coded = scratch.keep(_coded(blocks, book, kinds))
    # One row a label, written before the join: then a label that very many rows have can be split.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    labels = scratch.keep(coded.groupBy("label").agg(total.alias("label_error"))).withColumnRenamed("label", "label2")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("label2"))).select("id", "label", "code", "error", "label_error")
    return out, book


def codebooks_digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def decompress(codes: DataFrame, book: np.ndarray, *, code_col="code", scale: int = 4096) -> DataFrame:
    """The rows with vector, what their code stands for: its entries' components divided by scale, zeros of a filled-up part with them.

    A null code gives a null vector; a code that the codebooks do not have is an error.
    """
    values = [[(book[p, e].astype(np.float64) / scale).tolist() for e in range(book.shape[1])] for p in range(len(book))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if c is None else [v for p, e in enumerate(bytes.fromhex(c)) for v in values[p][e]] for c in batch.column(code_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{fields}, vector array<double>")
