"""Near-duplicate embeddings by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Each vector lives in the
cell of its nearest pivot. A vector x of cell i within r of a vector y of cell j has, by the triangle
inequality, d(x, pj) <= d(y, pj) + r <= d(y, pi) + r <= d(x, pi) + 2r; and, the space being Euclidean, it
lies within r of the plane midway between the two pivots. So x visits the cells beyond its own for which
both hold, and all cells of a label are joined independently; a pair is met in the later of its two cells.
Large cells are joined in pairs of blocks, so no task holds a whole cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, local_groups, pick

_SLACK = 1e-9


def _unit(values) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it is null, empty, zero or not finite throughout."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def _classes(rows: DataFrame) -> DataFrame:
    """id, key, unit: key a digest of label and values, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for values, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                x = None if label is None else _unit(values)
                keys.append(None if x is None else hashlib.blake2b(repr(label).encode() + b"/" + (np.asarray(values, np.float64) + 0.0).tobytes(), digest_size=16).digest())
                units.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["id", "label", "key", "unit"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, key binary, unit binary")


def _cells(classes: DataFrame, pivots: list[bytes], radius: float) -> DataFrame:
    """Each class in its own cell (home) and in those it visits; cells of other dimensions are apart."""
    by_size: dict[int, np.ndarray] = {n: np.array([np.frombuffer(p) for p in pivots if len(p) == n]) for n in {len(p) for p in pivots}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_pylist()
            row, cell, home = [], [], []
            for n in {len(u) for u in units}:
                rows = np.array([i for i, u in enumerate(units) if len(u) == n])
                x = np.frombuffer(b"".join(units[i] for i in rows)).reshape(len(rows), -1)
                p = by_size.get(n, np.eye(1, n // 8))
                far = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
                own = far.argmin(axis=1)
                least = far[np.arange(len(rows)), own][:, None]
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[own]
                into = (far <= least + 2 * radius + _SLACK) & (far**2 - least**2 <= 2 * (radius + _SLACK) * apart + _SLACK)
                into &= np.arange(len(p)) > own[:, None]
                a, b = np.nonzero(into)
                row += [rows, rows[a]]
                cell += [own, b]
                home += [np.ones(len(rows), bool), np.zeros(len(a), bool)]
            if row:
                part = batch.take(pa.array(np.concatenate(row)))
                sizes = pa.array([len(u) // 8 for u in part.column("unit").to_pylist()], pa.int32())
                arrays = [part.column(c) for c in ("key", "label", "unit", "copies")]
                yield pa.RecordBatch.from_arrays([*arrays, sizes, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(home))], ["key", "label", "unit", "copies", "size", "cell", "home"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("key", "label", "unit", "copies").mapInArrow(run, f"key binary, label {label}, unit binary, copies long, size int, cell int, home boolean")


def _compare(part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of two blocks of a cell: for each class how many vectors it meets, and edges that join what the links join."""
    x = np.frombuffer(b"".join(part["unit"])).reshape(len(part), -1)
    own, home, copies = part["own"].to_numpy(), part["home"].to_numpy(), part["copies"].to_numpy()
    near = x @ x.T >= cosine
    near &= home[:, None] | home[None, :]
    np.fill_diagonal(near, False)
    if part["i"].iloc[0] != part["j"].iloc[0]:
        near &= own[:, None] != own[None, :]
    met = near @ copies
    keys, some = part["key"].to_numpy(), np.flatnonzero(met)
    head = some[local_groups(near[np.ix_(some, some)])]
    joined = np.flatnonzero(head != some)
    counts = pd.DataFrame({"a": keys[some], "b": None, "met": met[some]})
    links = pd.DataFrame({"a": keys[head[joined]], "b": keys[some[joined]], "met": 0})
    return pd.concat([counts, links]) if len(joined) else counts


def near_vectors(
    table: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", cosine: float = 0.98, most_pivots: int = 256, cell_rows: int = 4096, block: int = 1024,
) -> DataFrame:
    """id, n_links, component_id, kept of each vector; only vectors of one label are compared.

    n_links: other vectors at the cosine or above; component_id the least id reachable by links. A vector
    that is null, empty, zero or has a null or non-finite component, or whose label is null, links with
    nothing. Repeated rows are vectors of their own and link with each other; equal vectors are joined as
    one class with its number of copies. Vectors of other lengths never link. A row without an id is
    counted and keeps its component; ids come before it. An empty table gives an empty one.

    Pivots are the classes of least hash, one for each cell_rows classes, at most most_pivots of them:
    that bounds what the tasks carry. The result does not depend on them.
    """
    spark = table.sparkSession
    scratch, radius = Scratch(spark, "vectors"), float(np.sqrt(2 - 2 * cosine))
    rows = scratch.keep(_classes(pick(table, id=id_col, embedding=vector_col, label=label_col)))
    classes = scratch.keep(
        rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    )
    wanted = min(most_pivots, max(4, classes.count() // cell_rows))
    pivots = [bytes(r["unit"]) for r in classes.orderBy(F.xxhash64("key"), "key").select("unit").limit(wanted).collect()]
    cells = scratch.keep(_cells(classes, pivots, radius))
    blocks = cells.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = cells.join(blocks, ["label", "size", "cell"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")
    found = scratch.keep(dealt.groupBy("label", "size", "cell", "i", "j").applyInPandas(lambda part: _compare(part, cosine), "a binary, b binary, met long"))

    met = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("met").alias("met"))
    grouped = components(scratch, found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "key").join(classes.select("key", "first_id"), "key")
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("component"))
    grouped = grouped.join(lowest, "root").select("key", "component")
    facts = classes.select("key", "first_id", "copies").join(met, "key", "left").join(grouped, "key", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("links"), F.coalesce("component", "first_id").alias("component")
    )
    # A table of one row a class, written before the join: then a vector that many rows have can be split.
    out = rows.select("id", "key").join(scratch.keep(facts), "key", "left").select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
