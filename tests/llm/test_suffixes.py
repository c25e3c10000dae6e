import random

import pytest

from shelfprice.llm import suffixes

from .conftest import odd_texts, prose


def brute(rows: list[tuple], size: int) -> list[tuple]:
    """(id, n_bytes, spans, kept) with every string of size bytes looked up in every text."""
    data = [(i, b"" if t is None else t.encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, b in data:
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if i is not None and first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        runs, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a) if gone.find(0, a) >= 0 else len(b)
            runs.append((a, at))
        out.append((i, len(b), tuple(runs), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(out) -> list[tuple]:
    return sorted(((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in out.select("id", "n_bytes", "spans", "kept").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_odd_tables(odd, nothing):
    rows = [(i, t) for i, t, _ in odd_texts()]
    assert got(suffixes.remove_repeats(odd)) == brute(rows, 50)
    assert suffixes.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError, match="over 16"):
        suffixes.remove_repeats(odd, size=16)


@pytest.mark.parametrize("size", [17, 50, 131])
def test_planted_passages(spark, size):
    """Passages of all lengths about the threshold at any place, some cut into each other, in texts of few letters."""
    rng = random.Random(size)
    passages = [prose(40, 900 + k)[: size + rng.randint(-3, 60)] for k in range(6)]
    rows = []
    for i in range(90):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 9)
            text += rng.choice(["", "é", "日本"]) + p[a : len(p) - rng.randint(0, 9)] + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 30)))
        rows.append((i if i % 13 else None, text))
    rows += [(7, "z" * 400), (8, "z" * 90), (9, "yz" * 200), (10, "z" * 49), (11, "z" * 50), (8, rows[8][1]), (8, rows[8][1])]
    assert got(suffixes.remove_repeats(frame(spark, rows), size=size)) == brute(rows, size)


def test_near_copies_and_a_hot_line(spark):
    rng = random.Random(5)
    base = prose(80, 77).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"other{rng.randrange(99)}"
        rows.append((i * 3 % 61, " ".join(words) + f"\nAll rights are reserved by the people of this very common line, number.\n{prose(6, i)}"))
    assert got(suffixes.remove_repeats(frame(spark, rows))) == brute(rows, 50)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    text = prose(3000, 4)
    cut = list(suffixes.segments([None, "", text, "short", text[:200]], 50, limit=1000))
    starts = sorted((int(r), int(o) + p) for rows, offsets, pieces in cut for r, o, piece in zip(rows, offsets, pieces, strict=True) for p in range(len(piece) - 49))
    assert starts == [(2, p) for p in range(len(text) - 49)] + [(4, p) for p in range(151)]
    assert all(text[o : o + len(p)].encode() == p for rows, offsets, pieces in cut for r, o, p in zip(rows, offsets, pieces, strict=True) if r == 2)
    # A window of two documents that pieces cut in other ways.
    long = prose(260_000, 6)
    rows = [(1, long), (2, "x" + long[500_000:1_600_000] + "y"), (3, long[-3_000:])]
    out = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert out == {1: [], 2: [(1, len(rows[1][1]) - 1)], 3: [(0, 3000)]}


def test_equal_windows_sample_the_same_place():
    rng = random.Random(2)
    shared = bytes(rng.randrange(256) for _ in range(90))
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randrange(80))) + shared + bytes(rng.randrange(256) for _ in range(40)) for _ in range(20)]
    _, name, at, owner, begins, n, spot = suffixes.samples(pieces, 50)
    found = []
    for k, piece in enumerate(pieces):
        here, low = piece.index(shared) + at[k], []
        for o, b, m, s in zip(owner, begins, n, spot, strict=True):
            if o == k:
                low += [(int(p - here), int(s - here), int(name[16][s])) for p in range(b, b + m) if here <= p <= here + 40]
        found.append(low)
    assert all(f == found[0] and len(f) == 41 for f in found)
