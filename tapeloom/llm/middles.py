"""Fill-in-the-middle transformation of whole texts: prefix, middle and suffix cut at the ends of units.

A unit is a word with the white space before it, or the white space that ends a text. All texts of an Arrow batch are
viewed as UTF-8 in one array of 64-bit words. The bytes that end a unit are marked by arithmetic on eight bytes at a
time, ``bitwise_count`` and a running sum give the units up to each word, the word of a cut is found by binary search
of that sum, and the byte inside it by clearing marks from below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_bytes

#: What goes before prefix, suffix and middle; a text that holds one of them stays plain.
MARKERS = ("<P>", "<S>", "<M>")

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = ~_HIGH
_BYTE, _TOP = np.uint64(8), np.uint64(56)
_ALL = ~np.uint64(0)


def _spread(value: int) -> np.uint64:
    """``value`` in each byte of a word."""
    return np.uint64(value * int(_ONES))


def _spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D; sums of seven bits never carry into the next byte."""
    seven = words & _LOW
    control = (seven + _spread(0x80 - 0x09)) & ~(seven + _spread(0x80 - 0x0E))
    blank = ~((seven ^ _spread(0x20)) + _LOW)
    return (control | blank) & ~words & _HIGH


def _continuations(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte of the form 10xxxxxx."""
    return words & ~(words << np.uint64(1)) & _HIGH


class Marks:
    """Marked bytes of an array of 64-bit words (one bit a byte), with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ~(_ALL << (byte * _BYTE))
        return self.before[word] + np.where(byte > 0, np.bitwise_count(inside), 0)

    def select(self, count: np.ndarray) -> np.ndarray:
        """Byte position just after the ``count``-th marked byte; ``count`` from 1 on."""
        word = np.searchsorted(self.before[1:], count, side="left")
        left, rest = self.words[word], count - self.before[word] - 1
        for _ in range(7):  # a word holds eight marks
            left = np.where(rest > 0, left & (left - np.uint64(1)), left)
            rest = rest - 1
        below = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1))
        return word * 8 + (below >> 3) + 1


class Units:
    """Units of several texts, given as their concatenated UTF-8 bytes and the offsets between them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        padded = np.full((len(data) // 8 + 1) * 8, 0x20, dtype=np.uint8)  # at least one blank ends the last text
        padded[: len(data)] = data
        words = padded.view("<u8")
        spaces = _spaces(words)
        following = (spaces >> _BYTE) | (np.append(spaces[1:], _HIGH) << _TOP)
        ends = ~spaces & following & _HIGH
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # whatever a text ends with ends a unit
        np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * _BYTE))
        self.ends, self.inner, self.offsets = Marks(ends), Marks(_continuations(words)), offsets
        self.first = self.ends.rank(offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Byte position, counted over all texts, after the first ``units`` units of each text."""
        places, some = self.offsets[:-1].copy(), units > 0
        places[some] = self.ends.select(self.first[:-1][some] + units[some])
        return places

    def characters(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Code points between byte positions."""
        return (high - low) - (self.inner.rank(high) - self.inner.rank(low))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """Per row: doc_id, ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of these put the suffix first. Empty texts and texts that
    hold a marker are plain, with null lengths. A null text is empty; a null doc_id draws as an empty one. Repeated
    rows come back as often as given, and other columns are not read. One pass without a shuffle; a task holds a few
    megabytes of texts, or one text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[x.alias(f"h{k}") for k, x in enumerate(draws(F.col(doc_id), seed), 1)])
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    rows = rows.select("doc_id", "text", "h1", "h2", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"))
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"]
    p, s, m = (x.encode() for x in MARKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
            units = Units(data, offsets - offsets[0])
            n = units.counts()
            one, two = (batch.column(k).to_numpy(zero_copy_only=False) % (n + 1) for k in (2, 3))
            low, high = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
            forms = batch.column(4).to_pylist()
            outputs, body, limits = [], data.tobytes(), offsets - offsets[0]
            for form, a, b, c, d in zip(forms, limits[:-1].tolist(), low.tolist(), high.tolist(), limits[1:].tolist()):
                if form == "plain":
                    outputs.append(body[a:d])
                elif form == "psm":
                    outputs.append(b"".join((p, body[a:b], s, body[c:d], m, body[b:c])))
                else:
                    outputs.append(b"".join((s, body[c:d], p, body[a:b], m, body[b:c])))
            cut = pa.array([x == "plain" for x in forms])
            lengths = [pa.array(x, pa.int64(), mask=cut.to_numpy(zero_copy_only=False)) for x in (units.characters(limits[:-1], low), units.characters(low, high))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(4), *lengths, pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {kind.dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, rebuilt from its output and form."""
    cut = F.split(output, "|".join(MARKERS), -1)
    one, two, three = (F.get(cut, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
