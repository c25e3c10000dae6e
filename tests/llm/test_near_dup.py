import re
from itertools import combinations

import numpy as np
import pytest

from shelfprice.llm import near_dup, textual

from .conftest import odd_texts, prose


def brute(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """(id, n_shingles, component_id, kept) by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids) if ids and sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_odd_documents(odd, size):
    got = near_dup.near_duplicates(odd, size=size).select("id", "n_shingles", "component_id", "kept").collect()
    assert order(got) == order(brute([(i, t) for i, t, _ in odd_texts()], size, 80))


def test_families_and_chains(spark):
    """A family whose members link only by way of each other, in small and in large buckets."""
    rows, words = [], prose(120, 9).split()
    for i in range(90):
        w = list(words)
        for k in range(1 + i % 7):
            w[(i * 13 + k * 17) % 120] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # each is like the next and unlike those after
        w = prose(100, 77).split()
        w[: 3 * i] = prose(3 * i, 1000).split()
        rows.append((200 + i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = order(brute(rows, 4, 80))
    for small in (4, 48):  # 4: even small families take the way of the large
        got = near_dup.near_duplicates(frame, size=4, small=small, block=16).select("id", "n_shingles", "component_id", "kept").collect()
        assert order(got) == expected


def test_signatures_estimate_similarity():
    a = np.arange(400, dtype=np.uint64)
    sets = [textual.mix(a[:300]), textual.mix(a[100:400]), np.zeros(0, np.uint64), textual.mix(a[:3])]
    sig = near_dup.super_minhash([np.unique(s) for s in sets], 128)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15
    assert (sig[2] == 0xFFFFFFFF).all() and (sig[3] != 0xFFFFFFFF).all()
    assert (near_dup.super_minhash([np.unique(sets[3])], 128)[0] == sig[3]).all()


def test_a_large_set_is_taken_in_slices():
    items = np.unique(textual.mix(np.arange(5000, dtype=np.uint64)))
    sets = [items, items[:7], np.zeros(0, np.uint64), items[100:900]]
    assert (near_dup.super_minhash(sets, 128) == near_dup.super_minhash(sets, 128, items_at_once=300)).all()


def test_keep_one_each(spark):
    rows = [(1, prose(50, 1)), (1, prose(50, 1)), (2, prose(50, 1)), (3, prose(50, 2)), (None, prose(50, 1)), (None, None), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dup.keep_one_each(frame, near_dup.near_duplicates(frame))
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in kept.collect()) == [(0, True), (1, False), (3, False), (4, True)]


def test_one_of_a_group_stays_without_ids_or_with_one_for_all(spark):
    base = prose(60, 5)
    near = [base.replace(base.split()[k], "changed") for k in (10, 20, 30)]
    for doc in (None, 7):
        rows = [(doc, t, k) for k, t in enumerate([*near, base, prose(50, 6), prose(50, 6)])]
        frame = spark.createDataFrame(rows, "doc_id long, text string, Text int")
        kept = near_dup.keep_one_each(frame, near_dup.near_duplicates(frame)).collect()
        assert len(kept) == 2 and {r["Text"] for r in kept if r["text"] == prose(50, 6)} == {4}


def test_columns_of_clashing_names(odd):
    kept = near_dup.keep_one_each(odd, near_dup.near_duplicates(odd))
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in [1, 4, None, 5, 6, 7, 8, 9, 11, 12, 13, 14])


def test_nothing(nothing):
    assert near_dup.near_duplicates(nothing).count() == 0
