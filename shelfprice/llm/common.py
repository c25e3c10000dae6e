"""What the operators share: exact-case column picking, tables in the shared folder, graph components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name, as new names; other columns may clash with them or with each other.

    ``pick(df, id="doc_id")`` returns one column ``id``. The first column of that exact name counts.
    """
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(name)}").alias(new) for new, name in wanted.items()])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back memory that it has freed: it lives on beside the next stage's tasks."""

    @functools.wraps(run)
    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return frugal


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """df with its columns as _0, _1 ..., the new name of a column by its exact old name, and the way back to all of df's columns."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain, lambda name: f"_{df.columns.index(name)}", lambda out: out.select(*plain.columns).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset a local session takes a local one; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shelfprice-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


class Scratch:
    """Tables written to the shared folder, so a lost executor costs no more than the step it was on."""

    #: The folders made and not removed yet: remove() takes those that a caller no longer reads.
    roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        Scratch.roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back: its lineage ends here."""
        path = f"{self.root}/{len(self.paths) + 1}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that keep returned and nothing reads any more."""
        for table in tables:
            for kept, path in self.paths:
                if kept is table:
                    files, where = _file_system(self.spark, path)
                    files.delete(where, True)

    @classmethod
    def remove(cls, spark: SparkSession, roots: list[str]) -> None:
        """Remove whole folders once what was built on them is written elsewhere."""
        for root in roots:
            files, where = _file_system(spark, root)
            files.delete(where, True)
        cls.roots = [r for r in cls.roots if r not in roots]


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components by pointer jumping along least neighbours.

    edges: (a, b), any orderable type. Returns (node, root), root the smallest node reachable, for each
    node with an edge to another: a written table. Each round finds m, the least of a node and its
    neighbours. An edge (u, v), v below u, becomes (u, m(v)) if v is m(u), else (v, m(u)): what was connected
    stays so, no round has more edges than the one before, and every edge sinks until it leads to a root.
    Then the minima are the result, so no round is run to see that nothing changes. The minima are a table
    of their own, one row a node, so the joins are of plain tables, whose large partitions can be split: a
    node with very many neighbours is no single group. What a round has read goes once it is written.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below, above = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), below.alias("below"), above.alias("above"))
        least = scratch.keep(least.select("u", F.least("u", "m").alias("m"), (F.col("below") > 1).alias("forks"), ((F.col("below") > 0) & (F.col("above") > 0)).alias("between")))
        forks, between = least.agg(F.bool_or("forks"), F.bool_or("between")).first()
        if not forks and not between:
            break
        jumped = least.where("m < u").select("u", F.col("m").alias("mid")).join(least.select(F.col("u").alias("mid"), F.col("m").alias("v")), "mid").select("u", "v")
        if forks:
            others = now.join(least.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            jumped = jumped.unionByName(others).distinct()
        old, now = now, scratch.keep(jumped)
        scratch.drop(old, least)
    scratch.drop(now)
    return least.select(F.col("u").alias("node"), F.col("m").alias("root"))


def local_groups(near: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the least member of each row's group."""
    group = np.arange(len(near))
    reach = near | np.eye(len(near), dtype=bool)
    while len(near):
        least = np.where(reach, group[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == group).all():
            break
        group = least
    return group
