import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from shelfprice.llm import resampling

from .conftest import odd_texts, prose


def lower(text) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text) -> tuple[list[str], list[int]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]]


def brute(rows: list[tuple], target: list) -> list[tuple]:
    """(id, n_words, n_features, weight, score, rank) by the definition, in plain Python."""
    found = [runs(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in runs(x)[1])
    total = lambda c: sum(c.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t))))
    out = []
    for (i, _), (words, features) in zip(rows, found, strict=True):
        weight = sum(map(gain, features)) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    some = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for place, r in enumerate(some[: 25 * len(some) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=repr)


def test_odd_tables(odd, nothing, spark):
    target = spark.createDataFrame([(prose(40, 2),), (None,), ("",), (prose(40, 9),)], "text string")
    got = resampling.resample(odd, target)
    assert sorted((tuple(r) for r in got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == brute([(i, t) for i, t, _ in odd_texts()], [prose(40, 2), None, "", prose(40, 9)])
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(odd_texts())


def test_ranks_over_many_ranges(spark):
    rows = [(i % 150, prose(20 + i % 7, i % 90)) for i in range(400)] + [(None, prose(30, 1))] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(prose(500, 3),)], "text string"))
    assert sorted((tuple(r) for r in got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == brute_ranks(rows, got)
    drawn = got.where("rank is not null")
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, 25 * len(rows) // 100 + 1))
    assert resampling.resampled(frame, drawn).columns == frame.columns


def brute_ranks(rows, got):
    """The brute result, where rows that are equal in all but the text may share out their ranks among themselves."""
    want = brute(rows, [prose(500, 3)])
    assert sorted((r[:5] for r in want), key=repr) == sorted((tuple(r)[:5] for r in got.select("id", "n_words", "n_features", "weight", "score").collect()), key=repr)
    ranks = {r["rank"]: (r["score"], r["id"]) for r in got.collect() if r["rank"]}
    assert ranks == {r[5]: (r[4], r[0]) for r in want if r[5]}
    return sorted((tuple(r) for r in got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_a_hot_text_is_counted_once_with_its_copies(spark):
    rows = [(i, prose(25, 5)) for i in range(60)] + [(100 + i, prose(25, 6 + i)) for i in range(20)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(prose(25, 7),)], "text string"))
    assert sorted((tuple(r) for r in got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(rows, [prose(25, 7)])


def test_buckets_of_long_runs():
    texts = [b"one Two three four", b"", b"five", "zwei \xe4\xf6 drei".encode()]
    for longest in (1, 2, 3):
        for (n, found), text in zip(resampling.feature_buckets(texts, 997, longest), texts, strict=True):
            words = text.decode().lower().split()
            want = [zlib.crc32(" ".join(words[i : i + k]).encode()) % 997 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
            assert n == len(words) and sorted(found.tolist()) == sorted(want)


def test_a_text_of_many_megabytes():
    text = ("word " * 600_000).encode()
    ((n, found),) = resampling.feature_buckets([text], 10_000)
    assert n == 600_000 and len(found) == 1_199_999 and set(np.unique(found)) == {zlib.crc32(b"word") % 10_000, zlib.crc32(b"word word") % 10_000}
