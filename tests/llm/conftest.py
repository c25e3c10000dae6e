import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, key string, score double, tag string, DOC_ID string, Text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    """n words, no two seeds alike."""
    x, out = seed * 2654435761 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"{WORDS[(x >> 33) % len(WORDS)]}{(x >> 40) % 50}")
    return " ".join(out)


def odd_texts() -> list[tuple]:
    """(doc_id, text, source): nulls, blanks, repeated rows, ties, one very long text, characters beyond ASCII."""
    long_text = prose(30_000, 1)
    base = prose(60, 2)
    near = base.replace(base.split()[30], "changed")
    return [
        (1, base, "a"), (1, base, "a"), (2, base, "b"), (3, near, "a"), (4, prose(60, 3), None), (None, base, "b"), (None, None, None), (5, None, "a"), (6, "", "c"), (7, " \t\n ", "c"),
        (8, long_text, "c"), (9, "one two", "a"), (10, "ONE  two", "b"), (11, "日本語 テキスト é ÄÖ x ① 😀", "d"), (12, "x" * 5000, "d"), (13, prose(60, 4), None), (14, "a\nb\r\n\nc", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts among extra columns whose names clash with the operators' and, but for case, with each other."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "id", 1, "k", 0.5, "t", "D", "T") for i, t, s in odd_texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
