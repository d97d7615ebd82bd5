"""SimHash near-duplicates: deletion-variant signatures of two segments, equality join, verification.

Fingerprints of 64 bits that differ in at most three bits have one 32-bit half that differs in at most one. Each half is
indexed exactly and once per bit with that bit as a wildcard; a wildcard row meets only rows that hold the other value of
the bit, so no pair is met through all 32 wildcards. Pairs of a key are joined where they are few. The members of a key
with many pairs are indexed again inside the remaining half (32, 16, then 8 bits, the same rule holds for every width),
after which at most 2^11 fingerprints can share a key. Links are verified by the number of differing bits in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import components, stored, text_key

#: Pairs of one key that are joined at once; keys above it are indexed further instead.
PAIRS_AT_ONCE = 4096
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 1 << 15


def _fingerprint(text: bytes | None, shingle: int) -> int:
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n, ones, digest, join = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64), xxhash.xxh64_digest, b" ".join
    for start in range(0, n, BLOCK):
        raw = b"".join([digest(join(words[i : i + shingle]), 42) for i in range(start, min(n, start + BLOCK))])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """The other columns of ``df`` and ``fingerprint`` (long) of each whole text; a null text is an empty one.

    Bytes ``A-Z`` are lower-cased, words are cut at ASCII white space; no words: zero. An input column named
    ``fingerprint`` is replaced.
    """
    rest = [c for c in df.columns if c not in (text, "fingerprint")]
    narrow = df.select(*rest, F.col(text).cast("binary").alias("_text"))
    schema = df.select(*rest, F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([_fingerprint(x.as_py(), shingle) for x in batch.column(len(rest))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], values], names=[*rest, "fingerprint"])

    return narrow.mapInArrow(run, schema)


def _variants(region: Column, low: int, width: int) -> Column:
    """Index rows of the two halves of ``width`` bits above bit ``low``: (half, wildcard or -1, masked value, side, low of the other half)."""
    half, rows = width // 2, []
    for name, (start, other) in enumerate(((low + half, low), (low, low + half))):
        value = F.shiftrightunsigned(region, start).bitwiseAND(F.lit((1 << half) - 1))
        rows.append(F.struct(F.lit(name).alias("half"), F.lit(-1).alias("bit"), value.alias("masked"), F.lit(2).alias("side"), F.lit(other).alias("low")))
        for bit in range(half):
            side = F.shiftrightunsigned(value, bit).bitwiseAND(F.lit(1))
            masked = value.bitwiseAND(F.lit(((1 << half) - 1) ^ (1 << bit)))
            rows.append(F.struct(F.lit(name).alias("half"), F.lit(bit).alias("bit"), masked.alias("masked"), side.cast("int").alias("side"), F.lit(other).alias("low")))
    return F.array(*rows)


def links(found: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct longs ``fingerprint`` of ``found`` with 1 to ``distance`` differing bits, at most 3.

    Keys are hashed with the keys above them; a collision only adds candidates, which the join's condition refuses.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments find up to 3 differing bits")
    rows = found.select("fingerprint", F.lit(0).cast("long").alias("key"), F.lit(0).alias("low"))
    out = []
    for width in (64, 32, 16):
        lows = [0] if width == 64 else range(0, 64, width)
        variants = reduce(lambda rest, low: F.when(F.col("low") == low, _variants(F.col("fingerprint"), low, width)).otherwise(rest), lows, F.lit(None))
        rows = rows.select("fingerprint", "key", F.explode(variants).alias("v"))
        rows = rows.select("fingerprint", F.xxhash64("key", F.lit(width), "v.half", "v.bit", "v.masked").alias("key"), F.col("v.side").cast("byte").alias("side"), "v.low")
        count = {s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"n{s}") for s in (0, 1, 2)}
        pairs = F.col("n0") * F.col("n1") + F.col("n2") * (F.col("n2") - 1) / 2
        full = stored(rows.groupBy("key").agg(*count.values()).select("key", pairs.alias("pairs")).where("pairs > 0"), "simhash-keys")
        rows = stored(rows.join(full, "key"), "simhash-rows")
        few = rows if width == 16 else rows.where(F.col("pairs") <= PAIRS_AT_ONCE)
        left = few.where("side <> 1").select("key", F.col("fingerprint").alias("a"), "side")
        right = few.where("side <> 0").select("key", F.col("fingerprint").alias("b"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        out.append(left.join(right, (left["key"] == right["key"]) & near & ((F.col("side") == 0) | (F.col("a") < F.col("b")))).select("a", "b"))
        rows = rows.where(F.col("pairs") > PAIRS_AT_ONCE).select("fingerprint", "key", "low")
        if width == 16 or rows.isEmpty():
            return reduce(DataFrame.union, out)


def _grouped(df: DataFrame, doc_id: str, text: str, shingle: int, distance: int) -> DataFrame:
    """Per row: doc_id, fingerprint (long), root (a fingerprint that names the component), component_id, text key."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("text"))
    rows = stored(fingerprints(narrow, "text", shingle), "simhash-prints")
    found = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(found, distance), "simhash-components").withColumnRenamed("node", "fingerprint")
    found = stored(found.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("root")), "simhash-roots")
    least = stored(found.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    return rows.join(stored(found.join(least, "root").select("fingerprint", "root", "component_id"), "simhash-named"), "fingerprint")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Per row: doc_id, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints at ``distance`` or fewer differing bits link; component_id is the smallest doc_id reachable (nulls are
    passed over; null if the component has no other). Null and empty texts share fingerprint zero. Repeated rows come
    back as often as they stand in the input. Copies share one fingerprint, so they cost one index entry.
    """
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return _grouped(df, doc_id, text, shingle, distance).select("doc_id", digits.alias("fingerprint"), "component_id")


# -- similar texts ---------------------------------------------------------------------------------------------------

#: Min-wise samples of a text's shingles, and how many of them a band joins.
SAMPLES, BAND = 256, 4
#: Bands that are compared; a pair of similarity 0.8 shares none of them with probability (1 - 0.8^4)^24 = 3e-6.
BANDS = 24
#: Texts of one band value that are paired at once; larger groups are linked by rounds and blocks instead.
GROUP_AT_ONCE = 32
#: Rounds in which the texts of a large group meet one of them, before all pairs of still different components do.
ROUNDS = 2
#: Texts on a side of a block of such pairs.
SIDE = 1024
#: By how much the share of equal samples may lie below the asked similarity: five standard errors. Sets decide.
SLACK = 0.125


def _samples(text: bytes | None, shingle: int):
    """The least hash of the text's shingles under each of ``SAMPLES`` permutations, as 32-bit integers."""
    import numpy as np
    import xxhash

    draw = np.random.default_rng(9)
    factors = draw.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    words = (text or b"").lower().split()
    n, digest, join = max(1, len(words) - shingle + 1), xxhash.xxh64_digest, b" ".join
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, n, 1 << 11):
        raw = b"".join([digest(join(words[i : i + shingle]), 7) for i in range(start, min(n, start + (1 << 11)))])
        hashes = np.frombuffer(raw, dtype=">u8").astype(np.uint64)
        np.minimum(least, (hashes[:, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """(_t1, shingles: sorted array of the distinct 64-bit hashes) of the rows (_t1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest, join = xxhash.xxh64_intdigest, b" ".join
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                sets = []
                for text in part.column(1):
                    words = (text.as_py() or b"").lower().split()
                    found = {digest(join(words[i : i + shingle]), 7) for i in range(max(1, len(words) - shingle + 1))}
                    sets.append(np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_t1", "shingles"])

    return df.select("_t1", F.col("text").cast("binary").alias("text")).mapInArrow(run, "_t1 long, shingles array<long>")


def _sketches(df: DataFrame, shingle: int) -> DataFrame:
    """(_t1, sketch: array of ints) of the rows (_t1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sketches = pa.array([_samples(x.as_py(), shingle) for x in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), sketches], names=["_t1", "sketch"])

    return df.select("_t1", F.col("text").cast("binary").alias("text")).mapInArrow(run, "_t1 long, sketch array<int>")


def _alike(pairs: DataFrame, once: DataFrame, least: float) -> DataFrame:
    """(a, b, equal) of the pairs (a, b) that agree in ``least`` samples or more."""
    wanted = pairs.select(F.col("a").alias("_t1")).union(pairs.select("b")).distinct()
    held = stored(once.join(wanted, "_t1", "left_semi"), "simhash-compared")
    left = held.select(F.col("_t1").alias("a"), F.col("sketch").alias("one"))
    right = held.select(F.col("_t1").alias("b"), F.col("sketch").alias("two"))
    equal = F.size(F.filter(F.zip_with("one", "two", lambda x, y: x == y), lambda x: x))
    return pairs.join(left, "a").join(right, "b").select("a", "b", equal.alias("equal")).where(F.col("equal") >= least)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of ``similarity`` or more."""
    left = sets.select(F.col("_t1").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("_t1").alias("b"), F.col("shingles").alias("two"))
    both, shared = pairs.select("a", "b").join(left, "a").join(right, "b"), F.size(F.array_intersect("one", "two"))
    return both.select("a", "b", shared.alias("shared"), (F.size("one") + F.size("two")).alias("total")).where(F.col("shared") >= F.lit(float(similarity)) * (F.col("total") - F.col("shared"))).select("a", "b")


def _apart(crowded: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (band, node, bands, component) of the groups that the links leave in several components; of each such
    band, ``n``, ``others`` (members outside its largest component, ``main``), and the most central member of all and of the others."""
    named = components(links, "simhash-linked")
    members = stored(crowded.join(named, "node", "left").select("band", "node", "bands", F.coalesce("component", "node").alias("component")), "simhash-named")
    parts = stored(members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("bands", "node")).alias("lead")), "simhash-parts")
    main = stored(parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1"), "simhash-main")
    rest = F.col("component") != F.col("main.component")
    groups = parts.join(main, "band").groupBy("band", F.col("main.component").alias("main")).agg(
        F.sum("n").alias("n"), F.sum(F.when(rest, F.col("n"))).alias("others"), F.max("lead")["node"].alias("centre"), F.max(F.when(rest, F.col("lead")))["node"].alias("other"))
    return members, stored(groups, "simhash-apart")


def _forest(table: pa.Table, least: float, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that join what of a block is similar and in different components, one per join.

    ``left`` rows meet the others. Pairs with ``least`` equal samples or more are candidates; the sorted sets of shingles
    decide. Whatever a link has joined is not compared again.
    """
    import numpy as np

    node, component, main, first = (table.column(c).to_numpy() for c in ("node", "component", "main", "left"))
    sketch = np.array(table.column("sketch").combine_chunks().values).reshape(-1, SAMPLES)
    sets = table.column("shingles").combine_chunks()
    starts, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    label, out = np.unique(component, return_inverse=True)[1], []
    second = np.flatnonzero(~first)
    for k in np.flatnonzero(first):
        met = second[(label[second] != label[k]) & ((component[second] == main[second]) | (node[second] > node[k]))]
        equal = (sketch[met] == sketch[k]).sum(axis=1)
        for j in met[equal >= least][np.argsort(-equal[equal >= least], kind="stable")].tolist():
            if label[j] == label[k]:
                continue
            one, two = values[starts[k] : starts[k + 1]], values[starts[j] : starts[j + 1]]
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if shared and shared >= similarity * (len(one) + len(two) - shared):
                out.append((min(int(node[k]), int(node[j])), max(int(node[k]), int(node[j]))))
                label[label == label[j]] = label[k]
    return out


def _block_links(members: DataFrame, groups: DataFrame, once: DataFrame, sets: DataFrame, least: float, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar texts of a band which are in different components.

    Members outside the largest component meet all members of the group, in blocks of about ``SIDE`` by ``SIDE``; a block
    returns fewer links than it has members.
    """
    lefts, rights = F.ceil(F.col("others") / SIDE).cast("int"), F.ceil(F.col("n") / SIDE).cast("int")
    rows = members.join(groups, "band").select("band", "node", "component", "main", lefts.alias("lefts"), rights.alias("rights"))
    rows = rows.join(once.withColumnRenamed("_t1", "node"), "node").join(sets.withColumnRenamed("_t1", "node"), "node")
    rows = stored(rows, "simhash-sides")
    dealt, every = (lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    rest = ["node", "component", "main", "sketch", "shingles"]
    left = rows.where("component <> main").select("band", dealt("lefts").alias("x"), every("rights").alias("y"), F.lit(True).alias("left"), *rest)
    right = rows.select("band", every("lefts").alias("x"), dealt("rights").alias("y"), F.lit(False).alias("left"), *rest)

    def compare(table: pa.Table) -> pa.Table:
        found = _forest(table, least, similarity)
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return left.union(right).groupBy("band", "x", "y").applyInArrow(compare, "a long, b long")


def similar_pairs(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) of text keys ``_t1`` with the components of all pairs at a Jaccard similarity of ``similarity`` or more.

    Candidates share a band of min-wise samples and lie above ``similarity`` less ``SLACK`` by all samples; the sets of
    shingles decide. The texts of a large group first meet the one of them that is in most large groups, as an original
    is; then one of those left over. After that, all pairs that are still in different components are compared in blocks,
    so no pair that could join two components is passed over.
    """
    once = stored(_sketches(texts, shingle).groupBy("_t1").agg(F.first("sketch").alias("sketch")), "simhash-sketches")
    bands = F.array(*[F.xxhash64(F.lit(k), F.slice("sketch", k * BAND + 1, BAND)) for k in range(BANDS)])
    rows = once.select(F.col("_t1").alias("node"), F.explode(bands).alias("band"))
    groups = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-bands")
    rows = stored(rows.join(groups, "band"), "simhash-members")
    few = rows.where(F.col("n") <= GROUP_AT_ONCE).select("band", "node")
    pairs = few.select("band", F.col("node").alias("a")).join(few.select("band", F.col("node").alias("b")), "band").where("a < b").select("a", "b")
    least = (similarity - SLACK) * SAMPLES
    close = stored(_alike(stored(pairs.distinct(), "simhash-pairs"), once, least), "simhash-close")
    crowded = rows.where(F.col("n") > GROUP_AT_ONCE).select("band", "node")
    wanted = close.select(F.col("a").alias("_t1")).union(close.select("b")).union(crowded.select("node")).distinct()
    sets = stored(_shingle_sets(texts.join(wanted, "_t1", "left_semi").groupBy("_t1").agg(F.first("text").alias("text")), shingle), "simhash-sets")
    links = stored(_verified(close, sets, similarity), "simhash-links")
    if crowded.isEmpty():
        return links
    crowded = stored(crowded.join(crowded.groupBy("node").agg(F.count(F.lit(1)).alias("bands")), "node"), "simhash-crowded")
    for turn in range(ROUNDS + 1):
        members, groups = _apart(crowded, links)
        if groups.isEmpty():
            return links
        if turn < ROUNDS:
            heads = stored(groups.select("band", F.col("other" if turn else "centre").alias("head")), "simhash-heads")
            heads = stored(heads.join(members.select("band", F.col("node").alias("head"), F.col("component").alias("_own")), ["band", "head"]), "simhash-heads")
            met = members.join(heads, "band").where(F.col("component") != F.col("_own")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
            close = stored(_alike(stored(met.distinct(), "simhash-pairs"), once, least), "simhash-close")
            links = links.union(stored(_verified(close, sets, similarity), "simhash-links"))
    return links.union(stored(_block_links(members, groups, once, sets, least, similarity), "simhash-links"))


def _distinctly_named(rows: DataFrame) -> DataFrame:
    """(doc_id, _t1, _t2, _name, text): ``_name`` is ``_t1``, but different texts (other ``_t2``) that share it get others."""
    clash = rows.groupBy("_t1").agg(F.min("_t2").alias("_least"), F.max("_t2").alias("_most")).where("_least <> _most")
    clash = stored(clash.select("_t1", "_least"), "simhash-clashes")
    if clash.isEmpty():  # as long as there are far fewer than 2^32 texts
        return rows.select("*", F.col("_t1").alias("_name"))
    name = F.when(F.col("_t2") != F.col("_least"), F.xxhash64("_t1", "_t2")).otherwise(F.col("_t1"))
    return rows.join(clash, "_t1", "left").select("doc_id", "_t1", "_t2", name.alias("_name"), "text")


def _similar(df: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Per row: doc_id, root (that names the group), text key; groups join texts of near fingerprints and similar texts."""
    narrow = _distinctly_named(df.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("text")))
    rows = stored(fingerprints(narrow), "simhash-prints")
    first = stored(rows.groupBy("fingerprint").agg(F.min("_name").alias("first")), "simhash-distinct")
    same = rows.select("fingerprint", "_name").distinct().join(first, "fingerprint").where("_name <> first").select(F.col("_name").alias("a"), F.col("first").alias("b"))
    near = links(first)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fingerprint").alias(end), F.col("first").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
    edges = same.union(near.select("a", "b")).union(similar_pairs(narrow.select(F.col("_name").alias("_t1"), "text"), shingle, similarity))
    named = components(edges, "simhash-components").withColumnRenamed("node", "_name")
    return rows.join(named, "_name", "left").select("doc_id", "_t1", "_t2", F.coalesce("component", "_name").alias("root"))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that with the smallest doc_id.

    Near copies have fingerprints at three or fewer bits, or ``similarity`` of their ``shingle``-word shingles in common,
    which three bits alone find too seldom. A null doc_id comes after all others; of repeated rows, and of texts under
    one doc_id, one stays. Null and empty texts are copies of each other.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t1", "_t2")
    chosen = _similar(docs, doc_id, text, shingle, similarity).groupBy("root").agg(F.min(order).alias("keep"))
    chosen = stored(chosen.select(F.col("keep.doc_id").alias("_id"), F.col("keep._t1").alias("_k1"), F.col("keep._t2").alias("_k2")), "simhash-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_own"), *text_key(F.col(text)))
    same = (rows["_t1"] == chosen["_k1"]) & (rows["_t2"] == chosen["_k2"]) & rows["_own"].eqNullSafe(chosen["_id"])
    return rows.join(chosen, same, "left_semi").dropDuplicates(["_t1", "_t2", "_own"]).select("_row.*")
