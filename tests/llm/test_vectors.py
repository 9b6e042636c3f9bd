"""Exact top-k search and centroid clustering against brute force, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from billweave.llm import clustering, top_k, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node long, units string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, non-finite values, repeated rows, ties, other lengths, huge values, and columns whose names operators use themselves."""
    chance = np.random.default_rng(5)
    rows = [(i, chance.standard_normal(64).round(1).tolist()) for i in range(90)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(40)]  # equal vectors under many ids
    rows += [(0, rows[0][1]), (0, rows[0][1]), (100, rows[100][1]), (100, rows[3][1])]  # repeated rows, and an id with two vectors
    rows += [(None, rows[5][1]), (None, rows[6][1]), (200, None), (201, []), (300, [1.0] * 3), (301, [1.0] * 70), (400, [-0.0] * 64)]
    rows += [(500, [math.nan] * 64), (501, [math.inf] * 64), (502, [None] * 64), (600, [3e38] * 64), (601, [-1.5] * 64)]
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def units(vec, scale):
    return [max(-clustering.LIMIT, min(clustering.LIMIT, math.floor(scale * float(np.float32(x))) if abs(x) < 1e30 else int(math.copysign(2**24, x)))) for x in vec]


def sound(vec):
    return vec is not None and all(x is not None and math.isfinite(x) for x in vec)


def best_plainly(rows, k, every, scale):
    kept = [(i, units(v, scale)) for i, v in rows if sound(v)]
    out = []
    for place, (query, q) in enumerate(kept):
        if query is None or query % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, u)), i) for other, (i, u) in enumerate(kept) if other != place]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(query, rank + 1, i, s) for rank, (s, i) in enumerate(scored[:k])]
    return out


def told(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("kind", ["even", "clusters", "few values", "wide", "one value"])
def test_index_finds_the_best_of_a_block(kind):
    chance = np.random.default_rng(3)
    values = {
        "even": chance.integers(-900, 900, (700, 16)),
        "clusters": chance.integers(-500, 500, (9, 32))[chance.integers(0, 9, 600)] + chance.integers(-20, 20, (600, 32)),
        "few values": chance.integers(-1, 2, (500, 6)),
        "wide": chance.integers(-(1 << 24), 1 << 24, (300, 64)),
        "one value": np.full((200, 5), 7),
    }[kind].astype(np.int64)
    ids = chance.permutation(len(values)).astype(np.int64)
    index = top_k.ImpactIndex(ids, np.ones(len(ids), bool), ids + 1, values)
    for query in [*values[:25], -values[1], np.zeros_like(values[0])]:
        scores = values @ query
        order = np.lexsort((ids, -scores))
        for worst in (None, int(scores[order[4]]), int(scores[order[0]]) + 1):
            places, found = index.top(query, 10, worst=worst)
            expected = [p for p in order[:10] if worst is None or scores[p] >= worst]
            assert places.tolist() == expected and found.tolist() == scores[expected].tolist()
        places, _ = index.top(query, 10, own=int(ids[order[2]]) + 1)
        assert places.tolist() == np.delete(order, 2)[:10].tolist()


def test_reading_stops_before_the_end(monkeypatch):
    chance = np.random.default_rng(4)
    values = chance.integers(-500, 500, (20, 64))[np.arange(4000) % 20] + chance.integers(-15, 15, (4000, 64))
    index = top_k.ImpactIndex(np.arange(4000), np.ones(4000, bool), np.arange(4000) + 1, values.astype(np.int64))
    read = []
    counted = np.bincount
    monkeypatch.setattr(top_k.np, "bincount", lambda x, *a, **b: read.append(len(x)) or counted(x, *a, **b))
    monkeypatch.setattr(top_k, "FEW", 250)
    for query in values[:20]:
        index.top(query.astype(np.int64), 10)
    assert sum(read) / 2 < 0.9 * 20 * 4000 * 64


def test_top_k_of_odd_rows(spark, odd_vectors, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    expected = told(best_plainly(rows, 10, 100, 1024))
    assert told(tuple(r) for r in top_k.top_k(odd_vectors).collect()) == expected
    assert told(tuple(r) for r in top_k.top_k(odd_vectors.repartition(7), k=3, every=50, scale=8).collect()) == told(best_plainly(rows, 3, 50, 8))
    assert top_k.top_k(odd_vectors.limit(0)).count() == 0
    assert top_k.top_k(odd_vectors.filter("vec_id = 601")).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    pack = top_k.packed
    monkeypatch.setattr(top_k, "packed", lambda most: pack(60 if most == top_k.BLOCK else 7))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert told(tuple(r) for r in top_k.top_k(vectors, every=10).collect()) == told(best_plainly(rows, 10, 10, 1024))


@pytest.mark.parametrize("count,dim,spread", [(1, 3, 50), (2, 2, 9), (5, 1, 3), (16, 64, 60), (40, 2, 4), (63, 5, 3)])
def test_tree_finds_the_nearest(count, dim, spread):
    chance = np.random.default_rng(count)
    centroids = chance.integers(-spread, spread, (count, dim)).astype(np.int64)
    vectors = np.concatenate([chance.integers(-spread, spread, (500, dim)), centroids, np.full((1, dim), clustering.LIMIT)]).astype(np.int64)
    squares = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    number, distance = clustering.VantageTree(centroids).nearest(vectors)
    assert number.tolist() == squares.argmin(axis=1).tolist()  # argmin takes the first of ties
    assert distance.tolist() == squares.min(axis=1).tolist()


def test_tree_prunes():
    chance = np.random.default_rng(1)
    centroids = chance.integers(-1000, 1000, (64, 4)).astype(np.int64)
    vectors = centroids[chance.integers(0, 64, 3000)] + chance.integers(-9, 9, (3000, 4))
    looked = []
    squares = clustering._squares
    tree = clustering.VantageTree(centroids)
    clustering._squares = lambda v, c: looked.append(len(v)) or squares(v, c)
    try:
        tree.nearest(vectors)
    finally:
        clustering._squares = squares
    assert sum(looked) < 0.6 * 64 * 3000


def clusters_plainly(rows, k, rounds, dim, scale, seed):
    kept = [(i, units(v, scale)) for i, v in rows if sound(v) and len(v) == dim]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), u) for i, u in kept)
    centroids = [tuple(u) for _, u in drawn[:k]]

    def nearest(u):
        return min((sum((x - y) ** 2 for x, y in zip(u, c)), number) for number, c in enumerate(centroids))

    for _ in range(rounds):
        of = {}
        for _, u in kept:
            of.setdefault(nearest(u)[1], []).append(u)
        centroids = [tuple(sum(x) // len(of[c]) for x in zip(*of[c])) if c in of else old for c, old in enumerate(centroids)]
    assigned = [(i, *nearest(u)) for i, u in kept]
    sums = {}
    for _, d, c in assigned:
        sums[c] = sums.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sums[c], sum(sums.values()), digest[c]) for i, d, c in assigned]


def test_clusters_of_odd_rows(spark, odd_vectors):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    for given in ({}, {"k": 5, "rounds": 2, "scale": 3, "seed": 9}, {"k": 500}, {"k": 2, "dim": 3}):
        expected = told(clusters_plainly(rows, **({"k": 16, "rounds": 3, "dim": 64, "scale": 64, "seed": 1} | given)))
        assert told(tuple(r) for r in clustering.clusters(odd_vectors.repartition(5), **given).collect()) == expected
    assert clustering.clusters(odd_vectors.limit(0)).collect() == []
    assert clustering.clusters(odd_vectors, dim=9).columns == clustering.clusters(odd_vectors).columns


def test_too_many_centroids_are_refused(spark, odd_vectors):
    with pytest.raises(ValueError):
        clustering.clusters(odd_vectors, k=1 << 20)


def shaped_vectors(kind, n=1500, dim=64):
    """Unit vectors in many small clusters; off: far from the origin's center; tight: a share in one group around the threshold."""
    chance = np.random.default_rng(7)
    centers = chance.standard_normal((n // 10, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = centers[chance.integers(0, len(centers), n)] + chance.standard_normal((n, dim)) * 0.33 / math.sqrt(dim)
    if kind.startswith("tight"):
        part = int(n * int(kind[5:]) / 100)
        x[:part] = centers[0] + chance.standard_normal((part, dim)) * 0.28 / math.sqrt(dim)
    if kind == "off":
        x = x + 2 / math.sqrt(dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["even", "off", "tight33", "tight60", "tight100"])
def test_near_vectors_meet(kind):
    x = shaped_vectors(kind)
    sample = x[np.random.default_rng(1).permutation(len(x))[:800]]
    learnt = vector_dedup.rotations(sample, vector_dedup.ROTATIONS)
    width, chunks, count = vector_dedup.plan(sample, np.zeros(len(sample), str), learnt, len(x), 0.93)
    codes = vector_dedup._codes(x, (learnt[0], learnt[1][:count], learnt[2][:count]), width, chunks)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(i) > 100 and (codes[i] == codes[j]).any(axis=1).mean() >= 0.99


def test_links_of_a_tight_group_and_of_short_vectors(spark):
    x = shaped_vectors("tight60", 400)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(1000 + k, [float(k % 3 + 1)] * (k % 7 + 1), 2) for k in range(21)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in vector_dedup.linked(frame).collect()}
    near = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert sum(found[k] for k in range(400)) >= 0.99 * near.sum() and all(found[k] <= near[k] for k in range(400))
    assert [found[1000 + k] for k in range(21)] == [2] * 21  # three of each length, all in one direction
