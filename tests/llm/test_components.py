import numpy as np
import pytest

from shelfprice.llm.common import Scratch, components


def roots(edges: list[tuple]) -> list[tuple]:
    """(node, root) of each node with an edge to another, by joining one edge after the other."""
    group = {x: x for a, b in edges if a != b for x in (a, b)}

    def top(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return sorted((x, top(x)) for x in group)


def graphs() -> list[tuple]:
    """A path in order and one shuffled, a zigzag, a tree, a random graph, a clique, a circle, loops and repeated edges: disjoint."""
    rng = np.random.default_rng(3)
    p = rng.permutation(60)
    parts = [
        [(i, i + 1) for i in range(60)], [(p[i], p[i + 1]) for i in range(59)], [(i, 60 - i) for i in range(25)] + [(60 - i, i + 1) for i in range(25)],
        [(p[i], p[rng.integers(0, i)]) for i in range(1, 60)], [tuple(rng.integers(0, 60, 2)) for _ in range(55)], [(i, j) for i in range(12) for j in range(i)], [(i, (i + 7) % 60) for i in range(60)],
        [(1, 1), (2, 3), (3, 2), (2, 3), (4, 4), (4, 3)],
    ]
    return [(int(a) + 100 * k, int(b) + 100 * k) for k, part in enumerate(parts) for a, b in part]


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components(spark, kind):
    name = (lambda x: x) if kind == "long" else (lambda x: x.to_bytes(2, "big"))
    edges = [(name(a), name(b)) for a, b in graphs()]
    got = components(Scratch(spark, "test"), spark.createDataFrame(edges, f"a {kind}, b {kind}"))
    plain = (lambda x: x) if kind == "long" else bytes
    assert sorted((plain(r["node"]), plain(r["root"])) for r in got.collect()) == roots(edges)


def test_no_round_is_run_for_stars(spark):
    """Edges and minima are written, and no more; a node above all its neighbours takes one round, which ends with the same two."""
    stars = [(10 * k, 10 * k + i) for k in range(4) for i in range(1, 9)]
    upside_down = [(10 * k + 9, 10 * k + i) for k in range(4) for i in range(8)]
    for edges, tables in ((stars, 2), (upside_down, 4), ([], 2), ([(1, 1)], 2)):
        scratch = Scratch(spark, "test")
        got = components(scratch, spark.createDataFrame(edges, "a long, b long"))
        assert sorted(tuple(r) for r in got.collect()) == roots(edges)
        assert len(scratch.paths) == tables
