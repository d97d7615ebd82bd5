"""Best-fit packing with swap-based local search, solved on counts of lengths and carried out by Spark.

Documents become pieces of at most ``size`` tokens. How pieces fit together depends on their lengths alone, of which
there are ``size``: Spark counts them, the driver searches over bins of like content with multiplicities (at most
``size`` counts go in, patterns come out, and the pairs looked at are bounded), and Spark deals the pieces of each length to the places the patterns hold for
it by their rank, which is found with per-salt counts and offsets, so that no length is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored
from tapeloom.llm.tokens import VOCABULARY, encoder

Pattern = tuple[int, ...]

#: Pairs of patterns that the search looks at, at most: some seconds of the driver.
TRIES = 100_000


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32) per piece of each document's ids and ``end_id``.

    A null text is empty and gives one piece of the end id. Only longer documents are cut, so that the first piece takes
    what whole pieces of ``size`` leave over. Repeated rows give repeated pieces.
    """
    schema = df.select(F.col(doc_id).alias("doc_id"), F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(vocabulary).ids, end_id.to_bytes(4, "little")
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, value in enumerate(batch.column(1)):
                ids = ids_of(value.as_py() or "") + end
                n, at = len(ids) // 4, 0
                for number in range(-(-n // size)):
                    stop = (n % size or size) if number == 0 else at + size
                    rows.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=schema.names)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


# -- search over counts of lengths -----------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Best-fit decreasing on counts: patterns of lengths with the number of bins that hold them.

    Bins of like content are filled together, so the work follows the distinct lengths and not the pieces.
    """
    open_bins: dict[int, Counter[Pattern]] = {}  # by room
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            insort(rooms, room)
        open_bins[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = min(size // length, left)
                n = left // each
                put((length,) * each, size - length * each, n)
                left -= n * each
                continue
            room = rooms[k]
            pattern, n = next(iter(open_bins[room].items()))
            each = min(room // length, left)
            n = min(n, left // each)
            open_bins[room][pattern] -= n
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(k)
            put(pattern + (length,) * each, room - length * each, n)
            left -= n * each
    return sum((bins for bins in open_bins.values()), Counter())


def _swap(small: Pattern, large: Pattern, size: int) -> tuple[Pattern, Pattern] | None:
    """Both bins after the move or exchange that raises the sum of squared fills most: the larger gets the most it can.

    Tried are: one piece moved, one for one, two of the smaller bin for one of the larger.
    """
    room = size - sum(large)
    best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None
    held = Counter(small)
    ones = sorted(held)
    pairs = [(a, b) for a in ones for b in ones if a < b or a == b and held[a] > 1]
    for given in [*((a,) for a in ones), *pairs]:
        for back in [()] * (len(given) == 1) + [(b,) for b in set(large)]:
            gain = sum(given) - sum(back)
            if 0 < gain <= room and (best is None or gain > best[0]):
                best = (gain, given, back)
    if best is None:
        return None
    _, given, back = best
    one, two = list(small), list(large)
    for x in given:
        one.remove(x)
    for x in back:
        two.remove(x)
    return tuple(sorted([*one, *back], reverse=True)), tuple(sorted([*two, *given], reverse=True))


def local_search(bins: Counter[Pattern], size: int, tries: int = TRIES) -> Counter[Pattern]:
    """Empties underfull bins into others until none can be emptied or the number of bins is the least possible.

    The emptiest bin gives to the fullest that can take something; each step raises the sum of squared fills, so the
    search ends. Bins of one pattern are changed together, all of the scarcer of the two. A bin that can give nothing is
    set aside until others have changed. Full bins take no part. The search also ends after ``tries`` looked-at pairs of
    patterns, which bounds the driver's work whatever the counts; what it then holds is a packing like any other.
    """
    bins = Counter({p: n for p, n in bins.items() if n})
    total = sum(sum(p) * n for p, n in bins.items())
    fewest, used = -(-total // size), sum(bins.values())
    under = Counter({p: n for p, n in bins.items() if sum(p) < size})
    full, aside, gained = bins - under, Counter(), False
    order = sorted((sum(p), p) for p in under)

    def change(pattern: Pattern, n: int) -> None:
        if sum(pattern) == size:
            full[pattern] += n
            return
        if pattern not in under:
            insort(order, (sum(pattern), pattern))
        under[pattern] += n
        if not under[pattern]:
            drop(pattern)

    def drop(pattern: Pattern) -> int:
        order.pop(bisect_left(order, (sum(pattern), pattern)))
        return under.pop(pattern)

    while used > fewest and tries > 0 and (under or gained):
        if not under:  # once more with all that could give nothing, since others have changed
            under, aside, gained = aside, Counter(), False
            order = sorted((sum(p), p) for p in under)
            continue
        small = order[0][1]
        if not small:
            used -= drop(small)
            continue
        for _, large in reversed(order):
            if large == small and under[small] < 2:
                continue
            tries -= 1
            moved = _swap(small, large, size)
            if moved:
                n = under[small] // 2 if large == small else min(under[small], under[large])
                for p in (small, large):
                    change(p, -n)
                for p in moved:
                    change(p, n)
                gained = True
                break
            if tries <= 0:
                break
        else:
            aside[small] += drop(small)
    return Counter({p: n for p, n in (full + under + aside).items() if p})


# -- dealing ---------------------------------------------------------------------------------------------------------


def _places(bins: Counter[Pattern]) -> dict[str, list[int]]:
    """Runs of places: the pieces of ``length`` with ranks from ``rank`` on go to bins ``first``, ``first + 1`` ... at ``offset``."""
    out: dict[str, list[int]] = {"length": [], "rank": [], "first": [], "offset": []}
    taken: Counter[int] = Counter()
    number = 0
    for pattern, n in sorted(bins.items()):
        offset = 0
        for length in pattern:
            for name, x in (("length", length), ("rank", taken[length]), ("first", number), ("offset", offset)):
                out[name].append(x)
            taken[length] += n
            offset += length
        number += n
    return out


def pack(found: DataFrame, size: int = 1024, per_salt: int = 100_000) -> DataFrame:
    """``found`` (rows of :func:`pieces`) with ``sequence_id`` (long) and ``offset`` (long), gapless from 0.

    A length's pieces are ranked in groups of about ``per_salt`` rows or less, dealt by a hash of the row. Alike rows are
    interchangeable. No rows: no rows.
    """
    spark = found.sparkSession
    found = stored(found, "packing-pieces")
    salts = max(64, found.count() // per_salt)
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = stored(found.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    bins = local_search(best_fit(counts, size), size)
    places = spark.sparkContext.broadcast(_places(bins))  # patterns x pieces in a bin; follows distinct lengths, not rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    begin = by_salt.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin")).hint("merge")  # at most size x salts rows, which grow with the input: never broadcast
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = found.withColumn("_rank", F.row_number().over(order) - 1).join(begin, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_begin")).alias("_rank"))
    schema = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *[F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset")]).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = {k: np.array(v, dtype=np.int64) for k, v in places.value.items()}
        wide = int(table["rank"].max(initial=0)) + 1
        keys = table["length"] * wide + table["rank"]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
            at = order[np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), side="right") - 1]
            sequence = table["first"][at] + rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], names=schema.names)

    return ranked.mapInArrow(deal, schema)


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``size`` tokens: see pieces() and pack()."""
    return pack(pieces(df, doc_id, text, size, end_id, vocabulary), size)
