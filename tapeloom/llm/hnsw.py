"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard queried by every vector.

Equal vectors are one node with a count, so copies cost nothing. A shard holds nodes of a bounded size; its graph is
built in one task and written to the shared folder. Blocks of queries meet the shards in a cogroup. A block's beam
widens until an audit of some of its queries against all vectors of the shard finds at least the wanted share of the
links. Beams that are full of links go on along the links themselves, so large groups are found whole. Cosines are
verified in double precision. A task returns a count of links per query and a spanning forest of the links it found,
never the pairs of a group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import components, stored

SHARDS, SHARD_ROWS = 4, 200_000
#: Bytes of the vectors of a shard, which are one value of a row, and of a block of queries; a task holds one of each.
SHARD_BYTES, BLOCK_BYTES = 256 << 20, 128 << 20
#: Neighbours in the upper layers and in the lowest, and the beam while building.
M, M0, BUILD_BEAM = 12, 24, 48


def beam_search(vectors, graph, queries, entries, width: int):
    """(ids, cosines) of the ``width`` best vectors that a beam finds for each query; -1 and -inf fill the rest."""
    import numpy as np

    n, expand = len(vectors), 4
    out_ids, out_cos = np.full((len(queries), width), -1), np.full((len(queries), width), -np.inf, dtype=np.float32)
    block = max(16, min(1024, (64 << 20) // max(n, 1)))
    for start in range(0, len(queries), block):
        q = queries[start : start + block]
        size = len(q)
        seen = np.zeros((size, n), dtype=bool)
        ids, cos = np.full((size, width), -1), np.full((size, width), -np.inf, dtype=np.float32)
        done = np.ones((size, width), dtype=bool)
        rows = np.arange(size)
        ids[:, 0] = entries[start : start + block]
        seen[rows, ids[:, 0]] = True
        cos[:, 0] = np.einsum("ad,ad->a", vectors[ids[:, 0]], q)
        done[:, 0] = False
        active = rows
        while active.size:
            waiting = np.where(done[active], -np.inf, cos[active])
            best = np.argpartition(-waiting, min(expand, width) - 1, axis=1)[:, :expand]
            alive = np.take_along_axis(waiting, best, axis=1).max(axis=1) > -np.inf
            active, best = active[alive], best[alive]
            if not active.size:
                break
            valid = ~done[active[:, None], best]
            done[active[:, None], best] = True
            chosen = ids[active[:, None], best]
            near, ok = [], []
            for e in range(best.shape[1]):
                found = graph[np.where(valid[:, e], chosen[:, e], 0)]
                fresh = (found >= 0) & valid[:, e, None]
                found = np.where(fresh, found, 0)
                fresh &= ~seen[active[:, None], found]
                at = np.nonzero(fresh)
                seen[active[at[0]], found[at]] = True
                near.append(found)
                ok.append(fresh)
            near, ok = np.concatenate(near, axis=1), np.concatenate(ok, axis=1)
            new = np.where(ok, np.einsum("amd,ad->am", vectors[near], q[active]), -np.inf).astype(np.float32)
            all_cos = np.concatenate([cos[active], new], axis=1)
            top = np.argpartition(-all_cos, width - 1, axis=1)[:, :width]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), top, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~ok], axis=1), top, axis=1)
            cos[active] = np.take_along_axis(all_cos, top, axis=1)
        ids[cos == -np.inf] = -1
        out_ids[start : start + block], out_cos[start : start + block] = ids, cos
    return out_ids, out_cos


def _diverse(vectors, ids, cos, keep: int):
    """Of candidates in order of cosine, those nearer to the node than to any kept before; the rest fills up."""
    import numpy as np

    order = np.argsort(-cos, axis=1, kind="stable")
    ids, cos = np.take_along_axis(ids, order, axis=1), np.take_along_axis(cos, order, axis=1)
    own = vectors[np.maximum(ids, 0)]
    between = np.einsum("aid,ajd->aij", own, own)
    kept, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(ids), dtype=int)
    for j in range(ids.shape[1]):
        closer = (np.where(kept, between[:, j], -np.inf) > cos[:, j, None]).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & ~closer & (count < keep)
        count += kept[:, j]
    rank = np.argsort(~kept, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, rank, axis=1)
    if out.shape[1] < keep:
        out = np.concatenate([out, np.full((len(out), keep - out.shape[1]), -1)], axis=1)
    return out


class SmallWorld:
    """Layers of a graph over unit vectors; nodes are in the order of their level, the highest first."""

    def __init__(self, vectors, layers):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors, levels):
        """``levels`` (descending) of the nodes decide the layers each stands in."""
        import numpy as np

        layers = []
        for level in range(int(levels[0]) if len(levels) else 0, -1, -1):
            size, keep = int((levels >= level).sum()), M if level else M0
            graph = np.full((size, keep), -1)
            done = min(size, 2 * keep)
            if done > 1:  # the first few know each other
                cos = vectors[:done] @ vectors[:done].T
                np.fill_diagonal(cos, -np.inf)
                ids = np.tile(np.arange(done), (done, 1))
                ids[np.arange(done), np.arange(done)] = -1
                graph[:done] = _diverse(vectors, ids, cos, keep)
            while done < size:
                stop = min(size, done * 2, done + 2048)
                new = vectors[done:stop]
                part = cls(vectors, [*(x for x in layers if len(x) <= done), graph[:done]])
                ids, cos = part.nearest(new, BUILD_BEAM)
                mates = new @ new.T  # of one batch, too
                np.fill_diagonal(mates, -np.inf)
                some = min(8, stop - done)
                own = np.argpartition(-mates, some - 1, axis=1)[:, :some]
                ids, cos = np.concatenate([ids, own + done], axis=1), np.concatenate([cos, np.take_along_axis(mates, own, axis=1)], axis=1)
                ids[cos == -np.inf] = -1
                graph[done:stop] = _diverse(vectors, ids, cos, keep)
                cls._link_back(vectors, graph, np.arange(done, stop), keep)
                done = stop
            layers.append(graph)
        return cls(vectors, layers)

    @staticmethod
    def _link_back(vectors, graph, new, keep: int) -> None:
        """Adds the links to ``new`` at their other ends, which then keep the most diverse."""
        import numpy as np

        source, target = np.repeat(new, graph.shape[1]), graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 512):
            some, width = nodes[low : low + 512], min(int(counts[low : low + 512].max()), 2 * keep)
            added = np.full((len(some), width), -1)
            for k, (s, c) in enumerate(zip(starts[low : low + 512], counts[low : low + 512])):
                mine = source[s : s + c]
                if c > width:
                    mine = mine[np.argsort(-(vectors[mine] @ vectors[some[k]]), kind="stable")[:width]]
                added[k, : len(mine)] = mine
            ids = np.concatenate([graph[some], added], axis=1)
            twice = (ids[:, :, None] == ids[:, None, :]) & np.tri(ids.shape[1], k=-1, dtype=bool)[None]
            ids[twice.any(axis=2)] = -1
            cos = np.einsum("amd,ad->am", vectors[np.maximum(ids, 0)], vectors[some])
            graph[some] = _diverse(vectors, ids, np.where(ids >= 0, cos, -np.inf), keep)

    def nearest(self, queries, width: int):
        import numpy as np

        entries = np.zeros(len(queries), dtype=np.int64)
        for graph in self.layers[:-1]:
            if len(graph):
                ids, cos = beam_search(self.vectors[: len(graph)], graph, queries, entries, 4)
                entries = ids[np.arange(len(ids)), np.argmax(cos, axis=1)]
        return beam_search(self.vectors[: len(self.layers[-1])], self.layers[-1], queries, entries, width)

    def within(self, queries, least: float, width: int):
        """Ids with cosine >= ``least`` (in single precision), one query after the other: a dense group is held once."""
        import numpy as np

        ids, cos = self.nearest(queries, min(width, max(len(self.vectors), 1)))
        graph = self.layers[-1]
        heads, tails = np.nonzero(graph >= 0)
        ends = graph[heads, tails]
        order = np.argsort(ends, kind="stable")
        back, begin = heads[order], np.searchsorted(ends[order], np.arange(len(graph) + 1))
        for k in range(len(queries)):
            mine = ids[k][cos[k] >= least]
            if len(mine):  # on along the links, in both directions
                known = np.zeros(len(self.vectors), dtype=bool)
                known[ids[k][ids[k] >= 0]] = True
                edge, found = mine, [mine]
                while len(edge):
                    near = np.unique(np.concatenate([graph[edge].ravel(), *(back[begin[x] : begin[x + 1]] for x in edge)]))
                    near = near[near >= 0]
                    near = near[~known[near]]
                    known[near] = True
                    edge = near[self.vectors[near] @ queries[k] >= least]
                    found.append(edge)
                mine = np.concatenate(found)
            yield mine


def _unit(column):
    """Rows of a list column as unit vectors in double precision."""
    import numpy as np

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    # scaled first, so that neither tiny nor huge components leave the range
    values = values / np.abs(values).max(axis=1, keepdims=True) if values.size else values
    return values / np.linalg.norm(values, axis=1, keepdims=True) if values.size else values


def build_shard(table: pa.Table) -> pa.Table:
    """One row (shard, dim, ids, copies, vectors, layers, sizes) of binaries from the rows (shard, node, n, embedding)."""
    import numpy as np

    nodes = table.column("node").to_numpy()
    draw = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0**53
    levels = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(M)), 6).astype(int)
    order = np.lexsort((nodes, -levels))
    exact = _unit(table.column("embedding"))[order]
    built = SmallWorld.build(exact.astype(np.float32), levels[order])
    layers = b"".join(np.ascontiguousarray(g, dtype="<i4").tobytes() for g in built.layers)
    sizes = np.array([g.shape for g in built.layers], dtype="<i4").ravel().tolist()
    return pa.table({
        "shard": table.column("shard").slice(0, 1), "ids": pa.array([nodes[order].astype("<i8").tobytes()], pa.binary()), "copies": pa.array([table.column("n").to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
        "vectors": pa.array([exact.astype("<f8").tobytes()], pa.binary()), "layers": pa.array([layers], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
    })


def _query(least: float, recall: float, width: int, audited: int):
    def run(key, queries: pa.Table, shards: pa.Table) -> pa.Table:
        import numpy as np

        out: dict[str, list] = {"node": [], "links": [], "other": [], "width": []}
        if queries.num_rows and shards.num_rows:
            row = shards.slice(0, 1).to_pylist()[0]
            ids, copies = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["copies"], dtype="<i8")
            exact = np.frombuffer(row["vectors"], dtype="<f8").reshape(len(ids), -1)
            layers, at = [], 0
            for size, keep in zip(row["sizes"][::2], row["sizes"][1::2]):
                layers.append(np.frombuffer(row["layers"], dtype="<i4", count=size * keep, offset=4 * at).reshape(size, keep).astype(np.int64))
                at += size * keep
            world = SmallWorld(exact.astype(np.float32), layers)
            nodes, mine = queries.column("node").to_numpy(), _unit(queries.column("embedding"))
            single, margin = mine.astype(np.float32), np.float32(least - 1e-4)
            order = np.argsort(nodes, kind="stable")
            checked = order[:: max(1, len(order) // audited)]
            truth = [np.flatnonzero(exact @ mine[k] >= least) for k in checked]
            wanted, beam = sum(map(len, truth)), width
            while True:
                hit = sum(len(np.intersect1d(a, b)) for a, b in zip(world.within(single[checked], margin, beam), truth))
                if hit >= recall * wanted or beam >= len(ids):
                    break
                beam *= 2
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for low in range(0, len(nodes), 2048):
                for k, near in enumerate(world.within(single[low : low + 2048], margin, beam), low):
                    near = near[exact[near] @ mine[k] >= least] if len(near) else near
                    near = near[ids[near] != nodes[k]]
                    links, others = int(copies[near].sum()), []
                    me = root(int(nodes[k]))
                    for x in ids[near].tolist():
                        r = root(x)
                        if r != me:  # this link joins two parts of what the task knows
                            parent[r] = me
                            others.append(x)
                    if links or others:
                        for x, n in zip(others or [int(nodes[k])], [links] + [0] * len(others)):
                            out["node"].append(int(nodes[k]))
                            out["links"].append(n)
                            out["other"].append(x)
                            out["width"].append(beam)
        return pa.table({"node": pa.array(out["node"], pa.int64()), "links": pa.array(out["links"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "width": pa.array(out["width"], pa.int32())})

    return run


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, recall: float = 0.99, width: int = 48, audited: int = 64,
    shards: int = SHARDS, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: vec_id, ``n_links``, ``component_id``, ``kept``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing: no links, a component
    of their own. So do rows without a vec_id (component null, kept null). Vectors of different lengths do not link.
    Rows of one vec_id are one item; equal vectors link always. Repeated rows come back as often as given.
    """
    values = F.col(embedding).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(values, lambda x: x != 0)
    # 0.0 and -0.0 are equal; hashes need one of them
    clean = F.transform(values, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), clean).alias("v"))
    rows = stored(rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("v")).alias("v")).withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "hnsw-rows")
    nodes = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).select(F.xxhash64("v").alias("node"), "first", "n", F.col("v").alias("embedding"), F.size("v").alias("dim")), "hnsw-nodes")
    found = None
    for dim, total in sorted((r["dim"], r["count"]) for r in nodes.groupBy("dim").count().collect()):  # a few lengths
        some = nodes.where(F.col("dim") == dim)
        room, size = max(1, min(shard_rows, shard_bytes // (8 * dim))), max(1, block_bytes // (8 * dim))
        parts, blocks = max(shards, -(-total // room)), max(3, -(-total // size))  # few blocks: the index goes to each
        placed = some.select(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(parts)).cast("int").alias("shard"), "node", "n", "embedding")
        index = stored(placed.groupBy("shard").applyInArrow(build_shard, "shard int, ids binary, copies binary, vectors binary, layers binary, sizes array<int>"), "hnsw-index")
        index = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        queries = some.select("node", "embedding", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard"))
        links = queries.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInArrow(_query(least, recall, width, audited), "node long, links long, other long, width int")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = df.sparkSession.createDataFrame([], "node long, links long, other long, width int")
    found = stored(found, "hnsw-links")
    first = nodes.select("node", "first")
    edges = found.where("node <> other").select("node", "other").join(first.withColumnRenamed("first", "a"), "node")
    edges = edges.join(first.select(F.col("node").alias("other"), F.col("first").alias("b")), "other").select("a", "b")
    # rows of one vec_id with different vectors are one item
    own = rows.where("v is not null").select("node", F.col("vec_id").alias("b")).distinct().join(first.withColumnRenamed("first", "a"), "node").select("a", "b")
    named = components(edges.union(own), "hnsw-components").select(F.col("node").alias("vec_id"), F.col("component").alias("_c"))
    counts = nodes.join(found.groupBy("node").agg(F.sum("links").alias("m")), "node", "left").select("node", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    done = rows.select("vec_id", "node").join(stored(counts, "hnsw-counts"), "node", "left").join(named, "vec_id", "left")
    component = F.coalesce("_c", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
