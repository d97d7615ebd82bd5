"""Suffix-array deduplication by bucket-pointer refinement.

Removed is every byte of a ``length``-byte string that starts anywhere else too. Suffixes are put into buckets by the
q-gram at their anchor: the least q-gram hash in the string, the leftmost of equals, so equal strings have the same
anchor at the same distance. Consecutive starts of one anchor share a row. Buckets of one row are done; rows of equal
context are one class, repeated whole. Buckets of several classes are refined by the identifiers of later offsets:
id(2q at p) from id(q at p) and id(q at p + q), and so on up to the length, and sorted. Buckets too large for a task are
refined again by the identifier of the part that all starts of a block of distances share (blocks of 32, 4, then 1), which
ends in plain counts, so no bucket is ever in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored, text_key

#: Starts of a text that are looked at together, which bounds memory for very long texts.
STEP = 1 << 18
#: Rows of a bucket that a task sorts; larger buckets are refined by blocks of distances first.
IN_TASK = 2000
BLOCKS = (32, 4, 1)
BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _constants(size: int):
    """Random values of the bytes, powers of the base and of its inverse modulo 2^64."""
    import numpy as np

    inverse = pow(BASE, -1, 1 << 64)
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    powers = np.ones(size, dtype=np.uint64)
    inverses = np.ones(size, dtype=np.uint64)
    powers[1:], inverses[1:] = np.uint64(BASE), np.uint64(inverse)
    return values, np.multiply.accumulate(powers), np.multiply.accumulate(inverses)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def gram_ids(raw, q: int):
    """64-bit identifiers of the q-grams of a uint8 array, by position."""
    import numpy as np

    size = 1 << max(12, (len(raw) + 1).bit_length())
    values, powers, inverses = _constants(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * powers[: len(raw)], out=sums[1:])
    n = len(raw) - q + 1
    return _mixed((sums[q:] - sums[:n]) * inverses[:n])


def anchors(text: bytes, length: int, q: int):
    """(first start, last start, anchor, q-gram id) of each run of starts with one anchor, as lists of ints."""
    import numpy as np

    width, out = length - q + 1, ([], [], [], [])
    for base in range(0, len(text) - length + 1, STEP):
        raw = np.frombuffer(text[base : base + STEP + length - 1], dtype=np.uint8)
        n = len(raw) - length + 1
        ids = gram_ids(raw, q)
        place = np.arange(len(ids), dtype=np.uint64)
        keys = (ids & ~np.uint64((1 << 20) - 1)) | place
        full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        full[: len(keys)] = keys
        table = full.reshape(-1, width)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(after[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:] - 1, n - 1]
        place = at[starts]
        for column, found in zip(out, (starts + base, ends + base, place + base, ids[place].view(np.int64))):
            column += found.tolist()
    return out


def repeated_starts(rows: list[tuple[int, int, int, bytes]], length: int, q: int) -> list[list[tuple[int, int]]]:
    """For rows (bucket, largest distance, smallest distance, context): runs of distances whose string another row of
    the bucket has at the same distance. A context starts at its largest distance.
    """
    import numpy as np

    whole = np.frombuffer(b"".join(c for *_, c in rows), dtype=np.uint8)
    ids, wide = gram_ids(whole, q), q
    while 2 * wide <= length:  # identifiers of twice the width from those of later offsets
        ids = _mixed(ids[: len(ids) - wide] * np.uint64(3) + ids[wide:])
        wide *= 2
    if wide < length:
        ids = _mixed(ids[: len(ids) - (length - wide)] * np.uint64(3) + ids[length - wide :])
    sizes = np.array([top - low + 1 for _, top, low, _ in rows])
    begin = np.r_[0, np.cumsum([len(c) for *_, c in rows])[:-1]]
    row = np.repeat(np.arange(len(rows)), sizes)
    step = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    bucket = np.array([b for b, *_ in rows], dtype=np.int64)[row]
    distance = np.array([t for _, t, _, _ in rows])[row] - step
    own = ids[begin[row] + step]
    keys = _mixed(own ^ _mixed(bucket.view(np.uint64) + distance.astype(np.uint64) * np.uint64(BASE)))
    order = np.argsort(keys, kind="stable")
    same = (keys[order][1:] == keys[order][:-1]) & (own[order][1:] == own[order][:-1]) & (distance[order][1:] == distance[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
    hit = np.zeros(len(keys), dtype=bool)
    hit[order] = np.r_[False, same] | np.r_[same, False]
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    edge = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])]) if len(hit) else []
    for first, after in zip(edge, [*edge[1:], len(hit)]):
        if hit[first]:
            out[row[first]].append((int(distance[after - 1]), int(distance[first])))
    return out


def _anchor_rows(texts: DataFrame, length: int, q: int) -> DataFrame:
    """(g, c1, c2, _t1, _t2, at, first, last) of the rows (_t1, _t2, text)."""
    schema = "g long, c1 long, c2 long, _t1 long, _t2 long, at long, first long, last long"
    names = ["g", "c1", "c2", "_t1", "_t2", "at", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                owner, raw, first, last, at, gram = [], [], [], [], [], []
                for k, value in enumerate(part.column(2)):
                    text = value.as_py()
                    s, e, a, g = anchors(text, length, q)
                    raw += [xxhash.xxh3_128_digest(text[x : y + length], z - x) for x, y, z in zip(s, e, a)]
                    owner += [k] * len(s)
                    first += s
                    last += e
                    at += a
                    gram += g
                c = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
                taken = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), part.column(0).take(taken), part.column(1).take(taken), *[pa.array(x, pa.int64()) for x in (at, first, last)]], names=names)

    return texts.mapInArrow(run, schema)


def _squeezed(texts: DataFrame) -> DataFrame:
    """The column ``text`` (bytes) compressed, for the exchanges that carry whole texts."""
    k = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = pa.array([tool.compress(x.as_py()) for x in batch.column(k)], pa.binary())
            yield batch.set_column(k, "text", small)

    return texts.mapInArrow(run, texts.schema)


def _contexts(wanted: DataFrame, length: int) -> DataFrame:
    """(key, c1, c2, top, low, context) of the rows (text, wanted: array of g, c1, c2, at, first, last)."""
    schema = "key long, c1 long, c2 long, top int, low int, context binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                text, rows = tool.decompress(batch.column(0)[k].as_py()), batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_pylist([
                    {"key": r["g"], "c1": r["c1"], "c2": r["c2"], "top": r["at"] - r["first"], "low": r["at"] - r["last"], "context": text[r["first"] : r["last"] + length]} for r in rows
                ], schema=_CONTEXT)

    return wanted.mapInArrow(run, schema)


_CONTEXT = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("top", pa.int32()), ("low", pa.int32()), ("context", pa.binary())])
_RUNS = "c1 long, c2 long, low int, top int"


def _solved(rows: DataFrame, length: int, q: int) -> DataFrame:
    """Runs (c1, c2, low, top) of repeated distances in buckets of at most ``IN_TASK`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def done(group: list[dict]) -> pa.RecordBatch:
            found = repeated_starts([(r["key"], r["top"], r["low"], r["context"]) for r in group], length, q)
            flat = [(r["c1"], r["c2"], low, top) for r, runs in zip(group, found) for low, top in runs]
            columns = list(zip(*flat)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["c1", "c2", "low", "top"])

        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                waiting += batch.slice(low, 2000).to_pylist()
                last = waiting[-1]["key"]
                cut = next((k for k in range(len(waiting) - 1, -1, -1) if waiting[k]["key"] != last), -1) + 1
                if cut:
                    yield done(waiting[:cut])
                    waiting = waiting[cut:]
        if waiting:
            yield done(waiting)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, _RUNS)


def _blocks(rows: DataFrame, size: int, length: int) -> DataFrame:
    """The rows cut into blocks of ``size`` distances; the key gets the block and the part common to its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(start, 500).to_pylist():
                    for block in range(r["low"] // size, r["top"] // size + 1):
                        low, top = max(r["low"], block * size), min(r["top"], block * size + size - 1)
                        start_of, end_of = r["top"] - block * size, r["top"] - (block + 1) * size + 1 + length
                        core = r["context"][start_of:end_of]  # shared by all strings of the block, inside every row's context
                        key = xxhash.xxh3_64_intdigest(core, (r["key"] ^ (block * 64 + size) * BASE) & (1 << 64) - 1)
                        out.append({"key": key - (1 << 64) if key >> 63 else key, "c1": r["c1"], "c2": r["c2"], "top": top, "low": low, "context": r["context"][r["top"] - top : r["top"] - low + length]})
                yield pa.RecordBatch.from_pylist(out, schema=_CONTEXT)

    return rows.mapInArrow(run, "key long, c1 long, c2 long, top int, low int, context binary")


def _refined(rows: DataFrame, length: int, q: int) -> DataFrame:
    """Runs of all buckets of :func:`_contexts` rows; buckets beyond ``IN_TASK`` rows go by blocks of distances."""
    found = None
    for size in (*BLOCKS, None):
        counts = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-buckets")
        if size is None:  # each bucket is one string now
            some = rows.join(counts, "key").select("c1", "c2", "low", "top")
            return found.union(some)
        some = rows.join(counts.where(F.col("n") <= IN_TASK).select("key"), "key")
        some = _solved(some.select("key", "c1", "c2", "top", "low", "context"), length, q)
        found = some if found is None else found.union(some)
        if counts.where(F.col("n") > IN_TASK).isEmpty():
            return found
        rows = stored(_blocks(rows.join(counts.where(F.col("n") > IN_TASK).select("key"), "key").select("key", "c1", "c2", "top", "low", "context"), size, length), "suffix-blocks")


def repeated_bytes(docs: DataFrame, text: str = "text", length: int = 400, q: int = 100) -> DataFrame:
    """Per distinct text with repeated strings: _t1, _t2 (its key) and ``spans``, an array of (low, high) byte ranges that may overlap."""
    texts = docs.select(*text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).where(F.length("text") >= length)
    found = _anchor_rows(texts, length, q)
    often = found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("low"), F.max("c1").alias("high"))
    often = stored(often.where("n > 1").select("g", (F.col("low") != F.col("high")).alias("mixed")), "suffix-grams")
    found = stored(found.join(often, "g"), "suffix-anchors")
    place = F.struct("_t1", "_t2", "at", "first", "last", "g")
    classes = stored(found.groupBy("c1", "c2", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")), "suffix-classes")
    wanted = classes.where("mixed").groupBy(F.col("p._t1").alias("_k1"), F.col("p._t2").alias("_k2"))
    wanted = stored(wanted.agg(F.collect_list(F.struct("p.g", "c1", "c2", "p.at", "p.first", "p.last")).alias("wanted")), "suffix-wanted")
    # copies of a text meet their list once each; the first of a list's copies is taken after the join
    carried = _squeezed(texts).groupBy("_t1", "_t2").agg(F.first("text").alias("text"))
    joined = carried.join(wanted, (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2"))).select("text", "wanted")
    runs = _refined(stored(_contexts(joined, length), "suffix-contexts"), length, q)
    whole = found.join(classes.where("n > 1").select("c1", "c2"), ["c1", "c2"]).select("_t1", "_t2", F.col("first").alias("low"), (F.col("last") + length).alias("high"))
    runs = stored(runs.groupBy("c1", "c2").agg(F.collect_set(F.struct("low", "top")).alias("runs")).join(classes.where("n = 1").select("c1", "c2"), ["c1", "c2"]), "suffix-runs")
    some = found.join(runs, ["c1", "c2"]).select("_t1", "_t2", "at", F.explode("runs").alias("r"))
    some = some.select("_t1", "_t2", (F.col("at") - F.col("r.top")).alias("low"), (F.col("at") - F.col("r.low") + length).alias("high"))
    return whole.union(some).groupBy("_t1", "_t2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, q: int = 100) -> DataFrame:
    """Per row: doc_id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes), ``kept_sha256``.

    Null texts are empty. Texts shorter than ``length`` lose nothing. Two rows of one text repeat each other, so both
    lose it all; that holds for rows of one doc_id too. Strings are judged on the input, not on what is left.
    """
    spans = stored(repeated_bytes(docs, text, length, q), "suffix-spans").select(F.col("_t1").alias("_k1"), F.col("_t2").alias("_k2"), "spans")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = _squeezed(rows)
    joined = rows.join(spans, (rows["_t1"] == spans["_k1"]) & (rows["_t2"] == spans["_k2"]), "left").select("doc_id", "text", "spans")
    kinds = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"), ("kept_sha256", "string"))
    schema = joined.select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in kinds]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                size, removed, runs, left = [], [], [], []
                for value, spans in zip(part.column(1), part.column(2)):
                    text = tool.decompress(value.as_py())
                    gone = merged([(s["low"], s["high"]) for s in spans.as_py() or ()])
                    size.append(len(text))
                    removed.append(sum(b - a for a, b in gone))
                    runs.append(len(gone))
                    cuts = [0, *(x for pair in gone for x in pair), len(text)]
                    left.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in left])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, runs)], pa.array(left, pa.binary()), digests], names=schema.names)

    return joined.mapInArrow(run, schema)
