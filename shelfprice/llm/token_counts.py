"""Token counts through a digest cache: stored counts are joined, only distinct misses are encoded and appended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, exists, lean, pick

#: Words whose counts a worker remembers; past that it forgets them all and begins again.
MEMO_WORDS = 1_000_000
CACHE = "digest binary, n_tokens long, version string"
_loaded: dict[str, tuple] = {}


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and the library's version: counts under another one are not reused."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def normalised(text: Column) -> Column:
    """The text (null: empty) with each run of ASCII white space as one blank and none at the ends.

    The tokenizers meant here drop white space between words, so texts that are equal so have equal counts.
    """
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))


def _counter(path: str):
    """text to number of tokens, in a worker: a text's words are encoded once each, by the library."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer, {}
    tokenizer, memo = _loaded[path]

    def count(texts: list[str]) -> list[int]:
        words = [t.split(" ") for t in texts]
        new = list({w for ws in words for w in ws} - memo.keys())
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list({w for ws in words for w in ws})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            memo.update(zip(part, (len(e.ids) for e in tokenizer.encode_batch(part, add_special_tokens=False)), strict=True))
        return [sum(map(memo.__getitem__, ws)) for ws in words]

    return count


def encode_misses(texts: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, text) to cache rows; text is normalised. path: the tokenizer's file on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64()), pa.repeat(version, len(n))], ["digest", "n_tokens", "version"])

    return texts.select("digest", "text").mapInArrow(lean(run), CACHE)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens of each text, by way of the cache table at cache_path, which grows.

    Texts are keyed by the digest of their normalised content. Digests that the cache lacks for this
    tokenizer version are encoded once each and appended; then all rows are joined to the cache. Which
    digests are missing is found without the texts: of a cache that has most of them, only the others' texts
    are shuffled. The cache is a table by version, so other versions' counts are not read. A null text
    counts as empty (0 tokens); null and repeated ids are rows like any other; other columns are not read;
    an empty table adds nothing. A rerun after a failure may append a digest twice, with equal counts.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    scratch = Scratch(spark, "tokens")
    rows = pick(docs, id=id_col, text=text_col).select(
        "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), normalised(F.col("text")).alias("text")
    )
    keyed = rows.withColumn("digest", F.unhex(F.md5("text")))
    stored = lambda: spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version)
    wanted = keyed
    if exists(spark, cache_path):
        missing = scratch.keep(keyed.select("digest").distinct().join(stored().select("digest").distinct(), "digest", "left_anti"))
        wanted = keyed.join(missing, "digest", "left_semi")
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    encode_misses(misses, tokenizer_path, version).write.mode("append").partitionBy("version").parquet(cache_path)
    # A table of one row a digest, written before the join: then a digest that many rows have can be split.
    cache = scratch.keep(stored().groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))
    return scratch.keep(keyed.select("id", "n_bytes", "digest")).join(cache, "digest").select("id", "n_bytes", "n_tokens")
