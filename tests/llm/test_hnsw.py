from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import hnsw


def groups(seed=1, dim=16):
    draw = np.random.default_rng(seed)
    rows = [draw.normal(size=dim) for _ in range(300)]
    for size in (2, 5, 120):
        centre = draw.normal(size=dim)
        rows += [centre + 0.04 * draw.normal(size=dim) for _ in range(size)]
    return [r.tolist() for r in rows]


def plain(rows):
    fine = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i in range(len(rows))}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fine:
        for j in fine:
            if i == j or len(rows[i][1]) != len(rows[j][1]):
                continue
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return [(k, links[i], None if k is None else find(k)) for i, (k, _) in enumerate(rows)]


def test_against_brute_force(spark):
    vectors = groups()
    rows = list(enumerate(vectors)) + [(1000 + k, vectors[0]) for k in range(40)] + [(2000, [2 * x for x in vectors[5]]), (300, vectors[300])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (None, vectors[0]), (3006, [1.0, 2.0]), (3007, [1.0, 2.0]), (3008, [-0.0, 1.0]), (3009, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], "vec_id long, embedding array<double>, node string, component_id string")
    got = sorted(hnsw.near_vectors(df, block_bytes=200 * 16 * 8).collect(), key=lambda r: (str(r.vec_id), r.n_links))
    expected = sorted(plain(rows + odd), key=lambda r: (str(r[0]), r[1]))
    # the contract asks for nine links of ten; in so small a graph all are found
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert hnsw.near_vectors(df.limit(0)).count() == 0
    assert hnsw.near_vectors(df.where("vec_id = 3002")).collect()[0].n_links == 0


@pytest.mark.parametrize("size", [1, 2, 30, 1500])
def test_beam_recall(size):
    draw = np.random.default_rng(size)
    vectors = draw.normal(size=(size, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    levels = -np.sort(-np.minimum(np.floor(-np.log(draw.random(size)) / np.log(hnsw.M)), 6)).astype(int)
    world = hnsw.SmallWorld.build(vectors, levels)
    ids, _ = world.nearest(vectors, min(48, size))
    best = np.argsort(-(vectors @ vectors.T), axis=1)[:, : min(10, size)]
    assert np.mean([len(np.intersect1d(a, b)) / len(b) for a, b in zip(ids, best)]) > 0.97


def shard_of(vectors):
    n = len(vectors)
    return hnsw.build_shard(pa.table({"shard": pa.array([0] * n, pa.int32()), "node": list(range(n)), "n": [1] * n, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))}))


def test_a_failed_audit_widens_the_beam():
    """Many groups that a beam of one does not see whole: it grows until the audited links are found, and so are the rest."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 24))
    vectors = np.repeat(centres, 25, axis=0) + 0.05 * draw.normal(size=(1500, 24))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    queries = pa.table({"node": list(range(1500)), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    real = sum(int(x) for x in ((vectors @ vectors.T >= 0.95).sum(axis=1) - 1))
    assert real > 20_000
    within, seen = hnsw.SmallWorld.within, []

    def dull(self, queries, least, width):
        """Loses what a beam of fewer than eight would not hold."""
        seen.append(width)
        for k, near in enumerate(within(self, queries, least, max(width, 8))):
            yield near[:width] if width < 8 else near

    hnsw.SmallWorld.within = dull
    try:
        got = hnsw._query(0.95, 0.99, 1, 64)(None, queries, shard_of(vectors)).to_pydict()
    finally:
        hnsw.SmallWorld.within = within
    assert seen[:4] == [1, 2, 4, 8] and set(got["width"]) == {8}
    assert sum(got["links"]) >= 0.99 * real


def test_wide_vectors_go_into_more_shards(spark):
    """3,072 dimensions: shards and blocks are bounded in bytes, and the result is that of brute force."""
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 3072))
    vectors = np.concatenate([base, base[:15] + 0.02 * draw.normal(size=(15, 3072))])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_bytes=8 * 3072 * 9, block_bytes=8 * 3072 * 12)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == plain(rows)
