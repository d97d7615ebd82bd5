"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences without loss: after a word that ends with a sentence mark and after a newline. Sentences
are cut further where their words say so (winnowing): of every ``unit_words`` consecutive words of the text, after that
with the least hash, the last of equals. A unit so has at most ``unit_words`` words (8), and units of shared words are
the same from the eighth word on to the eighth from the end, wherever in a sentence they stand: any 50 shared words hold
34 in whole units, and so a whole run, since the shortest run of 24 words has 31 at most.

From each unit on, the shortest run of at least ``run`` consecutive units and ``least_words`` words is hashed, and back
from each unit that ends a line or the text. Runs are joined globally by 128 bits; units covered by any run that is not
the first of its kind are removed, first meaning the smallest (doc_id, text key, position). Words are hashed once a pass;
units and runs of a whole batch are found, and runs hashed from prefix sums, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_bytes, discard, stored, text_key

SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
MARK = np.isin(np.arange(256), tuple(b".!?"))
NEWLINE = 10
#: Odd bases of the two halves of a run's hash, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Units:
    """Units of several texts (UTF-8 bytes): places in bytes and words, the text of each, and whether it ends a line."""

    def __init__(self, texts: list[bytes], unit_words: int):
        import xxhash

        self.body = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.body, dtype=np.uint8)
        edges = np.diff(np.concatenate([[0], (~SPACE[data]).view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        self.hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.body.split())), dtype="<u8").reshape(-1, 2)
        of = np.searchsorted(self.begin, starts, side="right") - 1
        last = np.append(of[1:] != of[:-1], True)[: len(of)]
        lines = np.cumsum(data == NEWLINE, dtype=np.int32)
        line = last.copy()
        line[:-1] |= lines[starts[1:] - 1] > lines[ends[:-1] - 1]
        cut = line | MARK[data[ends - 1]]
        cut[_picked(self.hashes[:, 0], of, unit_words)] = True
        self.to = np.flatnonzero(cut) + 1  # in words, exclusive
        self.at = np.concatenate([[0], self.to[:-1]])[: len(self.to)]
        self.text, self.line = of[self.to - 1], line[self.to - 1]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # unit that begins each text
        after = np.append(starts, len(data))[self.to]
        self.end = np.where(last[self.to - 1], self.begin[self.text + 1] - 1, after)  # in bytes, with the white space after it

    def runs(self, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) in units of the shortest runs from each unit on, and back from each that ends a line."""
        n = len(self.to)
        unit = np.arange(n)
        ahead = np.maximum(unit + run, np.searchsorted(self.to, self.at + least_words) + 1)
        fits = ahead <= n
        fits[fits] = self.text[ahead[fits] - 1] == self.text[fits]
        back = np.minimum(unit + 1 - run, np.searchsorted(self.at, self.to - least_words, side="right") - 1)
        holds = self.line & (back >= 0)
        holds[holds] = self.text[back[holds]] == self.text[holds]
        both = np.unique(np.concatenate([unit[fits] * (n + 1) + ahead[fits], back[holds] * (n + 1) + unit[holds] + 1]))
        return both // (n + 1), both % (n + 1)

    def named(self, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the words of each run."""
        start, stop, out = self.at[low], self.to[high - 1], []
        for k, base in enumerate(BASES):
            power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(self.hashes), base, dtype=np.uint64)))
            inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(self.hashes), pow(base, -1, 1 << 64), dtype=np.uint64)))
            total = np.append(np.uint64(0), np.cumsum(self.hashes[:, k] * power[:-1]))
            x = (total[stop] - total[start]) * inverse[start]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(BASES[1 - k])
            out.append((x ^ (x >> np.uint64(29))).view(np.int64))
        return out


def _picked(hashes: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """Places of the least of ``width`` consecutive hashes of one text; the last one of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    least, where = hashes[:n].copy(), np.arange(n)
    for j in range(1, width):
        lower = hashes[j : n + j] <= least
        least[lower] = hashes[j : n + j][lower]
        where[lower] = np.flatnonzero(lower) + j
    return where[of[:n] == of[width - 1 :]]


def _span_rows(df: DataFrame, run: int, least_words: int, unit_words: int, names_only: bool) -> DataFrame:
    """(h1, n) with n = 2 where a text repeats the run, or (doc_id, _t1, at, to, h1, h2), of the runs of (doc_id, _t1, text)."""
    key = df.select("doc_id", "_t1").schema
    fields = "h1 long, n int" if names_only else f"doc_id {key['doc_id'].dataType.simpleString()}, _t1 long, at int, to int, h1 long, h2 long"
    names = [x.split()[0] for x in fields.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, 2 << 20):
            units = Units([x or b"" for x in batch.column(2).to_pylist()], unit_words)
            low, high = units.runs(run, least_words)
            h1, h2 = units.named(low, high)
            text = units.text[low]
            if names_only:
                order = np.lexsort((h1, text))
                h1, text = h1[order], text[order]
                fresh = np.append(True, (h1[1:] != h1[:-1]) | (text[1:] != text[:-1]))[: len(h1)]
                first = np.flatnonzero(fresh)
                count = np.diff(np.append(first, len(h1)))
                yield pa.RecordBatch.from_arrays([pa.array(h1[first]), pa.array(np.minimum(count, 2).astype(np.int32))], names=names)
            else:
                taken = pa.array(text)
                own = units.first[text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array((low - own).astype(np.int32)), pa.array((high - own).astype(np.int32)), pa.array(h1), pa.array(h2)], names=names)

    return df.select("doc_id", "_t1", F.col("text").cast("binary").alias("text")).mapInArrow(cut, fields)


def without(texts: list[bytes], cuts: list[list[tuple[int, int]]], unit_words: int) -> tuple[list[bytes], list[int]]:
    """The texts without the units that the cuts (first, last + 1) cover, and the number of units cut."""
    units, left, removed = Units(texts, unit_words), [], []
    for k, pairs in enumerate(cuts):
        first, last = int(units.first[k]), int(units.first[k + 1])
        gone = np.zeros(last - first + 1, dtype=bool)
        for low, high in pairs:
            gone[low:high] = True
        edges = np.concatenate([[units.begin[k]], units.end[first:last]]).tolist()
        left.append(b"".join(units.body[edges[i] : edges[i + 1]] for i in np.flatnonzero(~gone[:-1]).tolist()))
        removed.append(int(gone.sum()))
    return left, removed


def remove_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = 3, least_words: int = 24, unit_words: int = 8) -> DataFrame:
    """``docs`` with repeated spans cut from the text, and ``n_removed``: units cut (replaced if it stands there).

    Null and empty texts stay as they are. Rows of one doc_id and text are one document and come back alike, as often as
    given; a null doc_id comes after all others. All columns of ``docs`` are kept. Texts without a repeated span are not
    touched; what crosses the network is 8 bytes a run, the repeated runs with their places, and each row once.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = named.select("*", text_key(F.col("text"))[0])
    once = named.select("doc_id", "_t1", "text")
    often = _span_rows(once, run, least_words, unit_words, names_only=True).groupBy("h1").agg(F.sum("n").alias("n")).where("n > 1").select("h1")
    often = stored(often, "span-keys")
    spans = stored(_span_rows(once, run, least_words, unit_words, names_only=False).join(often, "h1"), "span-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t1", "at")
    first = stored(spans.groupBy("h1", "h2").agg(F.min(place).alias("first")), "span-firsts")
    again = spans.join(first, ["h1", "h2"]).where(place != F.col("first"))
    cuts = stored(again.groupBy("doc_id", "_t1").agg(F.collect_set(F.struct("at", "to")).alias("cuts")), "span-cuts")
    discard(often, spans, first)
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("_t1").alias("_t"), "cuts")
    rows = named.select("_row", "doc_id", "_t1")
    joined = rows.join(cuts, (rows["_t1"] == cuts["_t"]) & rows["doc_id"].eqNullSafe(cuts["_id"]), "left").select("_row", "cuts")
    whole = joined.select("_row", F.when(F.col("cuts").isNotNull(), F.col(f"_row.`{text}`")).cast("binary").alias("text"), "cuts")
    schema = whole.select("_row", F.col("text").cast("string").alias("text"), F.lit(0).cast("int").alias("n_removed")).schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, 2 << 20):
            cuts = [[(c["at"], c["to"]) for c in x or ()] for x in batch.column(2).to_pylist()]
            some = [k for k, x in enumerate(cuts) if x]
            texts, removed = [None] * len(cuts), [0] * len(cuts)
            taken = batch.column(1).take(pa.array(some, pa.int64())).to_pylist()
            for k, value, n in zip(some, *without(taken, [cuts[k] for k in some], unit_words)):
                texts[k], removed[k] = value, n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int32())], names=schema.names)

    done = whole.mapInArrow(rebuild, schema)
    left = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col(f"_row.`{text}`"))
    kept = [F.col(f"_row.`{c}`").alias(c) if c != text else left.alias(text) for c in docs.columns if c != "n_removed"]
    return done.select(*kept, "n_removed")
