"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block meets a template where it contains at least the threshold's share of the template's words. Words
are ordered by their frequency in the whole corpus, rare first. A block that lacks the threshold's
complement of a template's rarest words cannot meet it, so blocks and templates are joined on those words
alone (prefix filter); the number of template words in the block (length) and the places of the first
word shared (position) bound the overlap before it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, pick
from .textual import ALNUM, chunks, spans, word_hashes

#: Phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that license texts are known by, the label of each, and words without which a block is another notice's.
TEMPLATES = (
    ("released under the mit license", "mit-notice", ("mit",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-grant"),
    ("licensed under the apache license version 2 0", "apache-notice", ("apache",)),
    ("this work is licensed under the gnu general public license version 3", "gpl-notice", ("general",)),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-grant"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-notice", ("lesser",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-grant"),
    ("licensed under the mozilla public license version 2 0", "mpl-notice", ("mozilla",)),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa", ("sa",)),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("nc",)),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("dedicated to the public domain under cc0 1 0", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    ("copyright all rights reserved no part may be reproduced without permission", "all-rights-reserved"),
)


def hash_words(text: str) -> np.ndarray:
    buf, starts, ends, _ = spans([text.encode()], ALNUM)
    return word_hashes(buf, starts, ends)


def block_bounds(first: int, last: int, line_ends: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Blocks of a text's words first .. last: its lines, long ones as windows that overlap by half, and such windows over all its lines."""
    edges = [first, *line_ends[(line_ends > first) & (line_ends < last)].tolist(), last]
    if len(edges) > 2:
        for at in range(first, max(first + 1, last - window + window // 2), window // 2):
            yield at, min(at + window, last)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = a
        while b - at > window:
            yield at, at + window
            at += window // 2
        if b > at:
            yield at, b


class Vocabulary:
    """The templates' words as numbers, by place in the corpus order (rare first)."""

    def __init__(self, templates, threshold: float, counts: dict[int, int] | None = None):
        sets = [frozenset(hash_words(t[0]).tolist()) for t in templates]
        words = sorted(set().union(*sets), key=lambda w: ((counts or {}).get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.keys = np.array(sorted(words), np.uint64)
        self.ranks = np.array([self.rank[int(k)] for k in self.keys], np.int32)
        self.longest = max(len(hash_words(t[0])) for t in templates)
        self.musts = [sorted({self.rank[int(w)] for word in (t[2] if len(t) > 2 else ()) for w in hash_words(word)}) for t in templates]
        self.sets = [sorted(self.rank[w] for w in s) for s in sets]
        self.need = [max(1, ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.prefixes = {r for s, n in zip(self.sets, self.need, strict=True) for r in s[: len(s) - n + 1]}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ranks[at], -1)


def _word_counts(rows: DataFrame, vocabulary: Vocabulary) -> dict[int, int]:
    """How often each template word occurs in all texts; as many numbers as the templates have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.keys), np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column("text").to_pylist()):
                buf, starts, ends, _ = spans(texts, ALNUM)
                found = vocabulary.find(word_hashes(buf, starts, ends))
                total += np.bincount(found[found >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["rank", "n"])

    words = {i: w for w, i in vocabulary.rank.items()}
    return {words[r["rank"]]: r["n"] for r in rows.select("text").mapInArrow(lean(run), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()}


def _scan(rows: DataFrame, vocabulary: Vocabulary, phrases, window: int) -> DataFrame:
    """Each text's base matches and those of its blocks that hold a prefix word: their template words, rare first."""
    kinds = [(hash_words(p), label) for p, label in phrases]
    least = min(vocabulary.need)
    window = max(window, 2 * vocabulary.longest)
    prefix = np.zeros(len(vocabulary.keys) + 1, bool)
    prefix[sorted(vocabulary.prefixes)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column("text").to_pylist()):
                buf, starts, ends, first = spans(texts, ALNUM)
                h = word_hashes(buf, starts, ends)
                n_words = np.diff(first)
                owner = np.repeat(np.arange(len(texts)), n_words)
                places, labels = [], [[] for _ in texts]
                for words, label in kinds:
                    n = max(0, len(h) - len(words) + 1)
                    hit = np.ones(n, bool)
                    for k, w in enumerate(words):
                        hit &= h[k : k + n] == w
                    at = np.flatnonzero(hit)
                    at = at[owner[at] == owner[at + len(words) - 1]]
                    places.append(at)
                    for d in np.unique(owner[at]):
                        labels[d].append(label)
                at = np.sort(np.concatenate(places))
                low, high = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[1:])
                ranks = vocabulary.find(h)
                rare = np.flatnonzero((ranks >= 0) & prefix[ranks])
                lines = np.searchsorted(starts, np.flatnonzero(buf == 10))
                blocks: list[list[list[int]]] = [[] for _ in texts]
                for d in np.unique(owner[rare]):
                    mine = rare[np.searchsorted(rare, first[d]) : np.searchsorted(rare, first[d + 1])]
                    ends_here = np.unique(lines[np.searchsorted(lines, first[d]) : np.searchsorted(lines, first[d + 1])])
                    for a, b in block_bounds(int(first[d]), int(first[d + 1]), ends_here, window):
                        if np.searchsorted(mine, a) < np.searchsorted(mine, b):
                            tokens = np.unique(ranks[a:b])
                            tokens = tokens[tokens >= 0]
                            if len(tokens) >= least:
                                blocks[d].append(tokens.tolist())
                some = high > low
                pick_at = lambda i: [int(at[x] - f) if ok else None for x, f, ok in zip(i, first[:-1], some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, len(texts)), pa.array(n_words.astype(np.int64)), pa.array((high - low).astype(np.int64)),
                        pa.array(pick_at(low), pa.int64()), pa.array(pick_at(high - 1), pa.int64()), pa.array(labels, pa.list_(pa.string())), pa.array(blocks, pa.list_(pa.list_(pa.int32()))),
                    ],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>")


def scan_licenses(docs: DataFrame, *, id_col="doc_id", text_col="text", phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8, window: int = 64) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates of each whole text.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Blocks are lines,
    those over window words cut to windows that overlap by half, and such windows over the whole text
    whatever its line ends; a window has at least twice the words of the longest template, so each passage
    of up to half a window stands whole in one block. A block meets a template (text, label and, if given,
    words that the block must have) where it has at least threshold of its distinct words and all that it
    must have; all such pairs are found. labels: base labels and the labels of
    the templates met; templates: (label, containment) of the latter; score: 1 where a base label is found,
    else the largest containment, else 0. Null and empty texts have no words and no labels; repeated rows
    and null ids are rows like any other; an empty table gives an empty one; other columns are not read.
    The templates are a parameter; their words are what tasks and the driver carry.
    """
    spark, rows = docs.sparkSession, pick(docs, id=id_col, text=text_col)
    scratch = Scratch(spark, "licenses")
    vocabulary = Vocabulary(templates, threshold, _word_counts(rows, Vocabulary(templates, threshold)))
    scanned = scratch.keep(_scan(rows, vocabulary, phrases, window).withColumn("row", F.monotonically_increasing_id()))
    blocks = scanned.select("row", F.posexplode("blocks").alias("block", "tokens"))
    prefix = [(r, t, i, len(s), n) for t, (s, n) in enumerate(zip(vocabulary.sets, vocabulary.need, strict=True)) for i, r in enumerate(s[: len(s) - n + 1])]
    prefix = spark.createDataFrame(prefix, "token int, template int, i int, size int, need int")
    whole = [(i, s, must, t[1]) for i, (s, must, t) in enumerate(zip(vocabulary.sets, vocabulary.musts, templates, strict=True))]
    whole = spark.createDataFrame(whole, "template int, words array<int>, must array<int>, label string")
    words = blocks.select("row", "block", F.size("tokens").alias("n"), F.posexplode("tokens").alias("j", "token"))
    shared = words.join(F.broadcast(prefix), "token").where("n >= need").groupBy("row", "block", "template").agg(
        F.min("i").alias("i"), F.min("j").alias("j"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("need").alias("need")
    )
    likely = shared.where(1 + F.least(F.col("size") - F.col("i") - 1, F.col("n") - F.col("j") - 1) >= F.col("need"))
    met = likely.join(blocks, ["row", "block"]).join(F.broadcast(whole), "template").withColumn("both", F.size(F.array_intersect("tokens", "words"))).where((F.col("both") >= F.col("need")) & (F.size(F.array_except("must", "tokens")) == 0))
    found = met.groupBy("row", "label").agg(F.max(F.col("both") / F.col("size")).alias("containment"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "containment"))).alias("templates"))
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform("templates", lambda t: t["label"]), none)
    best = F.coalesce(F.array_max(F.transform("templates", lambda t: t["containment"])), F.lit(0.0))
    return scanned.join(found, "row", "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", own))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"), "templates",
    )
