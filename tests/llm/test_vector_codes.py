import math

import numpy as np

from shelfprice.llm import vector_codes


def brute(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6):
    """Codes, errors and codebooks by the definition, in whole numbers of Python."""
    kept = [(i, [int(x) * 4096 if abs(x) >= 1 << 53 else math.floor(4096 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    wide = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    book = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), p)[1], []).append(cut(v, p))
            book[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(book[p])]
    coded = []
    for i, v, g in kept:
        best = [near(cut(v, p), p) for p in range(parts)]
        coded.append((i, g, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), (1 << 63) - 1)))
    sums: dict = {}
    for _, g, _, e in coded:
        sums[g] = min(sums.get(g, 0) + e, (1 << 63) - 1)
    return sorted([(*c, sums[c[1]]) for c in coded], key=repr), book


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, "x") for i, v, g in rows], "vec_id long, embedding array<double>, label int, id int, Label string").repartition(3)


def got(out):
    return sorted((tuple(r) for r in out.select("id", "label", "code", "error", "label_error").collect()), key=repr)


def odd(rng, n: int = 60, size: int = 16) -> list[tuple]:
    rows = [(i, [float(x) for x in rng.normal(size=size)], None if i % 7 == 0 else i % 3) for i in range(n)]
    bad = [None, [None, *[1.0] * (size - 1)], [float("nan")] * size, [float("inf")] + [0.0] * (size - 1)]
    rows += [(500 + i, v, 1) for i, v in enumerate(bad)]
    return rows + [(3, rows[3][1], 2), (3, rows[3][1], 2), (None, [0.0] * size, None), (900, [-0.0] * size, None)]


def test_codes_and_codebooks(spark):
    rows = odd(np.random.default_rng(3))
    want, book = brute(rows)
    for options in ({}, {"block_rows": 7, "depth": 2}):
        out, mine = vector_codes.compress_vectors(frame(spark, rows), **options)
        assert got(out) == want and mine.tolist() == book
    digest = vector_codes.codebooks_digest(mine)
    assert digest == vector_codes.codebooks_digest(np.array(book, object)) and len(digest) == 64
    back = {r["id"]: r["vector"] for r in vector_codes.decompress(out, mine).collect()}
    first = next(r for r in out.collect() if r["id"] == 5)
    error = sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(rows[5][1], back[5], strict=True))
    assert error == first["error"]


def test_components_beyond_64_bits(spark):
    rows = [(i, [x * (1e200 if i == 4 else 1e9 if (i or 0) % 2 else 1.0) for x in v], g) for i, v, g in odd(np.random.default_rng(4), 24) if v is not None and None not in v]
    want, book = brute(rows)
    out, mine = vector_codes.compress_vectors(frame(spark, rows), block_rows=5)
    assert mine.tolist() == book and got(out) == want


def test_few_vectors_and_none(spark):
    rows = odd(np.random.default_rng(5), 3)[:3]
    out, book = vector_codes.compress_vectors(frame(spark, rows))
    assert book.shape == (8, 3, 2) and got(out) == brute(rows)[0]
    out, book = vector_codes.compress_vectors(frame(spark, rows).limit(0))
    assert out.count() == 0 and book.shape[1] == 0 and out.columns == ["id", "label", "code", "error", "label_error"]
    out, book = vector_codes.compress_vectors(frame(spark, [(1, None, 1)]))
    assert out.count() == 0


def test_other_lengths_are_left_out_and_a_last_part_is_filled_up(spark):
    rows = [(i, [float(i + k) for k in range(10)], 0) for i in range(5)] + [(9, [1.0, 2.0], 0), (10, [], 0)]
    out, book = vector_codes.compress_vectors(frame(spark, rows))
    assert book.shape == (8, 5, 2) and out.count() == 5 and all(r["error"] == 0 for r in out.collect())
    empty, book = vector_codes.compress_vectors(frame(spark, [(1, [], 0), (2, [], 0)]))
    assert empty.count() == 2 and book.shape == (8, 2, 0)
