import math

import numpy as np

from tidemark.llm import vectors


def expected(rows):
    def unit(v):
        if not v or None in v or not all(map(math.isfinite, v)) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [(i, label, unit(v) if label is not None else None) for i, v, label in rows]
    place, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while place[a] != a:
            a = place[a]
        return a

    for x in range(len(rows)):
        for y in range(x):
            (_, la, a), (_, lb, b) = units[x], units[y]
            if la == lb and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.98:
                links[x] += 1
                links[y] += 1
                place[find(x)] = find(y)
    low = {}
    for x, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(i, low.get(find(x), i))
    return sorted(((i, links[x], low.get(find(x)), i == low.get(find(x))) for x, (i, *_) in enumerate(rows)), key=str)


def sample():
    draw = np.random.default_rng(5)
    rows = []
    for group in range(12):
        centre = draw.standard_normal(32)
        for k in range(12):
            rows.append((len(rows), (centre + draw.normal(0, 0.13 if k else 0, 32)).tolist(), group % 3))
    rows += [(900 + k, v, label) for k, (v, label) in enumerate([
        (None, 1), ([], 1), ([0.0] * 32, 1), ([float("nan")] + [1.0] * 31, 1), ([None] + [1.0] * 31, 1),
        ([float("inf")] * 32, 1), (rows[0][1], None), (rows[0][1], 0), (rows[0][1], 1), (rows[0][1][:16], 0),
        ([1e-30 * x for x in rows[0][1]], 0)])]
    return rows + [rows[3], rows[3], (None, rows[40][1], 0), (None, draw.standard_normal(32).tolist(), 0)]


def run(spark, rows):
    made = spark.createDataFrame(
        [(i, label, v, "x", 1) for i, v, label in rows],
        "vec_id long, label int, embedding array<double>, node string, weight int").repartition(5)
    return sorted(map(tuple, vectors.near_duplicates(made).collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, sample()) == expected(sample())


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert run(spark, sample()) == expected(sample())


def test_labels_are_cut_into_cells_along_every_axis(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = sample() + [(2000 + k, draw.standard_normal(32).tolist(), k % 2) for k in range(300)]
    for block in (12, 40, 90):
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert run(spark, rows) == expected(rows)


def test_few_pairs_are_enumerated(spark, sf):
    """Pairs looked at, over all groups, against all pairs of equal labels."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet").where("label is not null and embedding is not null")
    looked = pairs = 0
    window = vectors.SPREAD * math.sqrt(2 - 2 * 0.98)
    for _, rows in table.toPandas().groupby("label"):
        x = np.unique(np.stack(rows.embedding.to_list()).astype("<f8"), axis=0)
        along = vectors._units([v.tobytes() for v in x]) @ vectors._directions(x.shape[1])
        pairs += len(x) * (len(x) - 1) // 2
        for mine in vectors.groups(vectors.allowed_misses()):
            looked += sum(len(i) for i, _ in vectors.neighbours(along[:, mine], window))
    assert looked < 0.2 * pairs


def test_neighbours_are_all_pairs_within_the_window_once():
    draw = np.random.default_rng(3)
    for axes in (1, 2, 4):
        place = draw.standard_normal((200, axes)).round(1)
        met = [tuple(sorted(p)) for i, j in vectors.neighbours(place, 0.5) for p in zip(i.tolist(), j.tolist())]
        near = {(i, j) for j in range(200) for i in range(j) if (np.abs(place[i] - place[j]) <= 0.5).all()}
        assert len(met) == len(set(met)) and near <= set(met)


def test_threshold_of_one(spark):
    rows = [(i, [1.0, 0.0] if i < 3 else [0.0, 1.0], "x") for i in range(5)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted((r.vec_id, r.n_links) for r in vectors.near_duplicates(made, 1.0).collect()) == [
        (0, 2), (1, 2), (2, 2), (3, 1), (4, 1)]


def test_the_supplied_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(map(tuple, vectors.near_duplicates(table).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_few_pairs_at_the_threshold_are_lost():
    misses = vectors.allowed_misses()
    draw = np.random.default_rng(1)
    hit = np.abs(draw.normal(0, 0.2, (200_000, vectors.PROJECTIONS))) <= vectors.SPREAD * 0.2
    assert ((~hit).sum(axis=1) > misses).mean() < 3e-4


def test_labels_alike_in_their_first_64_bytes(spark):
    one, other = "l" * 64 + "1", "l" * 64 + "2"
    rows = [(i, [1.0, 2.0, 3.0], one if i < 3 else other) for i in range(5)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(made).collect())
    assert found == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 1, 3), (4, 1, 3)]
