from collections import Counter

import pytest

from shelfprice.llm import mixing

from .conftest import odd_texts, prose


def water_fill(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Shares of the total by weight; what is over three times the size is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 500, "c": 70, None: 20}, {"a": 0, "b": 7}, {"b": 1, "c": 1, "d": 1000, "e": 3, "f": 0}])
def test_targets_share_the_total(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_tree_splits_quotas_exactly(spark):
    quotas = {"a": 1000, "b": 17, None: 333, "c": 0}
    tree = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 16, 7).collect()
    by_source, by_shard = Counter(), Counter()
    for r in tree:
        assert r["n"] >= 0
        by_source[r["source"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert dict(by_source) == quotas
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 1
    share = [r["n"] for r in tree if r["source"] == "a"]
    assert 45 <= min(share) and max(share) <= 80  # 62.5 blocks each, give or take chance


def test_odd_documents(odd):
    mix = mixing.mix_sources(odd, block_words=16, shards=4)
    rows = mixing.taken_words(mix).collect()
    assert len(rows) == len(odd_texts())
    words = lambda t: len((t or "").split()) if t is None or " " not in t else 6
    assert Counter((r["id"], r["size"]) for r in rows) == Counter((i, words(t)) for i, t, _ in odd_texts())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 16 for s, t in target.items())
    placed = mix.where("shard is not null").collect()
    assert len({(r["shard"], r["slot"]) for r in placed}) == len(placed)
    again = mixing.taken_words(mixing.mix_sources(odd.repartition(7), block_words=16, shards=4)).collect()
    key = lambda r: (str(r["id"]), str(r["source"]), r["size"], r["tag"], r["copy"])
    assert sorted(((*key(r), r["taken"]) for r in rows)) == sorted(((*key(r), r["taken"]) for r in again))


def test_shards_draw_exact_disjoint_quotas(spark):
    docs = spark.createDataFrame([(i, prose(20 + 7 * i % 90, 50 + i), "abc"[min(i % 4, 2)]) for i in range(120)], "doc_id long, text string, source string")
    results = {}
    for shards in (4, 32):
        mix = mixing.mix_sources(docs, block_words=16, shards=shards, shard_words=1 << 8)
        rows = [r for r in mix.collect() if r["shard"] is not None]
        assert len({(r["id"], r["tag"], r["copy"], r["block"], r["round"]) for r in rows}) == len(rows)
        sizes = Counter(r["shard"] for r in rows)
        assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
        for shard, n in sizes.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(1, n + 1))
        # The quotas drawn, split by the tree, are what the shards hold.
        quota = Counter(r["source"] for r in rows)
        leaves = mixing.split_quotas(spark.createDataFrame(list(quota.items()), "source string, quota long"), shards, 7).collect()
        assert Counter((r["source"], r["shard"]) for r in rows) == {(r["source"], r["shard"]): r["n"] for r in leaves if r["n"]}
        # A block of a later round was drawn in all rounds before it.
        drawn = {(r["id"], r["block"], r["round"]) for r in rows}
        assert all((i, b, k) in drawn for i, b, n in drawn for k in range(1, n))
        results[shards] = {r["id"]: (r["taken"], r["n_shards"], r["placement"]) for r in mixing.taken_words(mix).collect()}
        for i, (taken, n_shards, _) in results[shards].items():
            mine = [r for r in rows if r["id"] == i]
            assert taken == sum(r["n_words"] for r in mine) and n_shards == len({r["shard"] for r in mine})
    few, many = results[4], results[32]
    assert all(few[i][0] == many[i][0] for i in few) and any(few[i][2] != many[i][2] for i in few)


def test_whole_documents(spark, odd):
    for docs in (spark.createDataFrame(odd_texts(), "doc_id long, text string, source string"), odd):
        mixed = mixing.mixed_documents(docs, mixing.mix_sources(docs, block_words=None, shards=4))
        assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
        texts = {t for _, t, _ in odd_texts()}
        at = docs.columns.index("text")
        assert all(r[at] in texts for r in mixed.collect())


def test_nothing(nothing):
    assert mixing.taken_words(mixing.mix_sources(nothing)).count() == 0
