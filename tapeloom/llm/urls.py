"""URL filter rules in a sorted digest array: 64-bit xxhash keys, vectorised binary search, full strings confirmed.

The index is one binary file: sorted digests, string offsets, verdicts and the strings. Executors get it with
``SparkContext.addFile`` and map it into memory, so the tasks of an executor share its pages.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Most bytes of an index that is sent to every executor; longer lists go by :func:`judge_by_join`.
INDEX_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD = r"(?s)^(?:(?!://).)*+://([^/?#]*+)([^?#]*+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, HEAD, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, HEAD, 2), F.lit(""))


def _hosts(host: str) -> list[str]:
    """The host and the domains it is a subdomain of."""
    parts = host.split(".")
    return [".".join(parts[k:]) for k in range(len(parts))]


def write_index(rules: Iterable[Rule], path: str) -> None:
    """Sorted digest array of ``host + path`` at ``path``. A string that stands twice has its greatest verdict."""
    import numpy as np
    import xxhash

    named: dict[bytes, str] = {}
    lengths = set()
    for h, p, v in rules:
        key = (h + p).encode("utf-8")
        named[key] = max(v, named.get(key, v))
        lengths.add(len(p))
    keys = sorted(named, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    verdicts = sorted(set(named.values()))
    blocks = [
        np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype="<u8"),
        np.cumsum([0, *map(len, keys)], dtype="<u8"),
        np.array([verdicts.index(named[k]) for k in keys], dtype="<u8"),
        np.array(sorted(lengths), dtype="<u8"),
    ]
    names = "\n".join(verdicts).encode()
    head = np.array([len(keys), len(blocks[3]), len(names)], dtype="<u8")
    with open(path, "wb") as file:
        file.write(b"".join([head.tobytes(), *(b.tobytes() for b in blocks), names, *keys]))


class DigestIndex:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        import numpy as np

        whole = np.memmap(path, dtype=np.uint8, mode="r")
        n, n_lengths, n_names = (int(x) for x in whole[:24].view("<u8"))
        at = 24
        blocks = []
        for size in (n, n + 1, n, n_lengths):
            blocks.append(whole[at : at + 8 * size].view("<u8"))
            at += 8 * size
        self.digests, self.offsets, self.verdict_of, lengths = blocks
        self.path_lengths = [int(x) for x in lengths]  # in characters
        self.verdicts = bytes(whole[at : at + n_names]).decode().split("\n")
        self.strings = whole[at + n_names :]

    def find(self, probes: list[bytes]):
        """Position of each string, or -1: binary search of its digest, then comparison with the stored strings."""
        import numpy as np
        import xxhash

        if not len(self.digests) or not probes:
            return np.full(len(probes), -1, dtype=np.int64)
        wanted = np.array([xxhash.xxh64_intdigest(p) for p in probes], dtype="<u8")
        low, high = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        out = np.full(len(probes), -1, dtype=np.int64)
        for k in np.flatnonzero(low < high):  # nearly all are hits; unequal strings of one digest stand side by side
            for at in range(int(low[k]), int(high[k])):
                if bytes(self.strings[int(self.offsets[at]) : int(self.offsets[at + 1])]) == probes[k]:
                    out[k] = at
        return out


def _probes(host: str, path: str, lengths: list[int]) -> list[str]:
    """Strings of all rules that would fit, the longest first; of equal length, the longer host first."""
    if not host and not path:
        return []
    out = [(len(h) + n, len(h), h + path[:n]) for h in _hosts(host) for n in lengths if n <= len(path)]
    return [s for _, _, s in sorted(out, key=lambda x: (-x[0], -x[1]))]


def judge(df: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, ``host``, ``path``, ``rule`` (null: none fits) and ``verdict`` (the rule's, else ``default``).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equal strings the
    greatest verdict (``block`` before ``allow``), of others alike in length that of the longer host. Null urls and those
    without ``://`` have no host, fit no rule and get ``default``. Repeated rows come back as often as given.
    """
    size = sum(len(h) + len(p) for h, p, _ in rules) * 4 + 32 * len(rules)
    if size > INDEX_BYTES:
        spark = df.sparkSession
        return judge_by_join(df, spark.createDataFrame(rules, "host string, path string, verdict string"), page_id, url, default)
    folder = tempfile.mkdtemp(prefix="url-index-")  # the driver's own; Spark hands the file to each executor
    name = f"{os.path.basename(folder)}.bin"
    write_index(rules, os.path.join(folder, name))
    df.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    narrow = df.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = narrow.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            probes, owner = [], []
            for k, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                mine = _probes(host, path, index.path_lengths)
                probes += mine
                owner += [k] * len(mine)
            found = index.find([p.encode("utf-8") for p in probes])
            rule, verdict = [None] * batch.num_rows, [default] * batch.num_rows
            for k in np.flatnonzero(found >= 0):
                if rule[owner[k]] is None:
                    rule[owner[k]], verdict[owner[k]] = probes[k], index.verdicts[int(index.verdict_of[found[k]])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def judge_by_join(df: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The same for rule tables (host, path, verdict) beyond what an executor should map, as shuffled equality joins.

    Every distinct (host, path) meets the rules of its hosts by the digest of ``host``; the host itself is compared too.
    """
    narrow = df.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = narrow.where("host <> '' or path <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.slice(parts, k, F.size(parts))))
    probes = places.select("host", "path", F.explode(suffixes).alias("_own")).withColumn("_d", F.xxhash64("_own"))
    verdict = F.max("verdict").over(Window.partitionBy(F.concat("host", "path")))
    held = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), verdict.alias("_v")).distinct().withColumn("_e", F.xxhash64("_h"))
    fits = probes.join(held, (F.col("_d") == F.col("_e")) & (F.col("_own") == F.col("_h")) & F.col("path").startswith(F.col("_p")))
    string = F.concat("_h", "_p")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(string).alias("n"), F.length("_h").alias("m"), string.alias("rule"), F.col("_v").alias("verdict"))).alias("best"))
    joined = narrow.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
