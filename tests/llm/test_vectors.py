import numpy as np

from shelfprice.llm import vectors


def brute(rows: list[tuple], cosine: float) -> list[tuple]:
    def unit(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if not ok:
            return None
        x = np.array(v, float) / max(abs(a) for a in v)
        return x / np.sqrt(np.sum(x**2))

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    near = [[i != j and units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine for j in range(n)] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        for j in range(n):
            if near[i][j]:
                group = [group[i] if g == group[j] else g for g in group]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids) if ids and any(near[i]) else rows[i][0]
        out.append((rows[i][0], sum(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for k in range(12):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * 0.12 * (k % 4)], c % 3))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, rows[0][1], None), (904, None, 0), (905, [0.0] * 16, 0), (906, [float("nan")] * 16, 0)]
    rows += [(907, [], 0), (908, [None, *[1.0] * 15], 0), (909, [1e200] * 16, 2), (910, [1e-200] * 16, 2), (None, rows[5][1], 0), (911, [1.0, 2.0], 0), (912, [2.0, 4.0], 0), (913, [-0.0, 1.0], 0), (914, [0.0, 1.0], 0)]
    frame = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, key string, Label int").repartition(3)
    for options in ({}, {"block": 8, "cell_rows": 10}):
        got = vectors.near_vectors(frame, cosine=0.98, **options).select("id", "n_links", "component_id", "kept").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 0.98)


def test_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
