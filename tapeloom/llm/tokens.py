"""Byte-level BPE tokens of whole texts, and token counts of huge texts by overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets. Neighbouring chunks are spliced at a place where both end
a token and which is proven stable (:class:`Seams`). Without such a place in the overlap, the overlap is doubled, at last
over the whole chunk, which is then encoded together with as much again, so that work stays in proportion.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Texts of more characters are encoded in overlapping chunks.
CHUNK, OVERLAP = 32_768, 256


class Encoder:
    """Ids of texts as the tokenizer file ``<vocabulary>.json`` gives them: no added tokens, special strings recognised.

    Texts are encoded by the same vocabulary's ranks (seven times as fast), held by the tests against the .json file.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64
        import json

        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
            special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ordinary = self.plain.encode_ordinary
        self.special = {*special}
        self.seams = Seams(ranks, special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        for token, rank in special.items():
            self.lengths[rank] = len(token.encode())

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit bytes."""
        if any(x in text for x in self.special):
            return array("I", self.plain.encode(text, allowed_special=self.special)).tobytes()
        return array("I", self.ordinary(text)).tobytes()

    def ends(self, ids: bytes):
        """Where each token ends, in UTF-8 bytes."""
        import numpy as np

        return np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")])


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


@cache
def _classes():
    """Per code point: 1 letter, 2 number, 3 white space, 4 other; 0 where versions of the character tables may differ."""
    import unicodedata

    import numpy as np

    out, old = np.zeros(0x110000, dtype=np.uint8), unicodedata.ucd_3_2_0
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == old.category(chr(c))[0] and unicodedata.category(chr(c)) != "Cn":
            out[c] = {"L": 1, "N": 2, "Z": 3}.get(kind, 4)
    out[9:14], out[0x1C:0x20] = 3, 0
    out[[0x85, 0x180E, 0x200B, 0x2028, 0x2029, 0xFEFF]] = 0
    out[0xD800:0xE000] = 0
    return out


class Seams:
    """Places in a text where its tokens surely part, whatever stands further left or right.

    The vocabulary's pattern ends a match before white space that follows another character, and where letters, numbers
    and other characters meet, but for an apostrophe, which may begin a contraction. Between two characters of one class
    a match goes on; yet no token spans them if none holds their two adjoining bytes side by side, and then no merge
    ever joins them. Places inside special strings are none.
    """

    def __init__(self, tokens, special):
        import numpy as np

        self.special = [x for x in special if x]
        self.joined = np.zeros(1 << 16, dtype=bool)
        for token in tokens:
            raw = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            self.joined[raw[:-1] << 8 | raw[1:]] = True

    def before(self, text: str, low: int, high: int) -> list[int]:
        """Seams i in (low, high), ascending: text[:i] and text[i:] have the tokens of the whole."""
        import numpy as np

        first = max(0, low - 2)
        codes = np.frombuffer(text[first : high + 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if len(codes) < 2:
            return []
        kind = _classes()[codes]
        left, right, quote = kind[:-1], kind[1:], codes == 39
        known = (left > 0) & (right > 0)
        after_quote = quote[:-1].copy()
        after_quote[1:] |= quote[:-2]  # a contraction has an apostrophe and at most two letters
        after_quote[2:] |= quote[:-3]
        same = (left == right) & (left != 3) & ~self.joined[_last_byte(codes[:-1]) << 8 | _first_byte(codes[1:])] & ~quote[1:]
        change = (left != 3) & (right != 3) & (left != right)
        sure = known & (((left != 3) & (right == 3)) | ((same | change) & ~after_quote))
        at = np.flatnonzero(sure) + 1 + first
        at = at[(at > low) & (at < high)]
        for string in self.special:
            begin = text.find(string, max(0, low - len(string)), high + len(string))
            while begin >= 0:
                at = at[(at <= begin) | (at >= begin + len(string))]
                begin = text.find(string, begin + 1, high + len(string))
        return at.tolist()


def _first_byte(codes):
    """First UTF-8 byte of each code point."""
    import numpy as np

    return np.select([codes < 0x80, codes < 0x800, codes < 0x10000], [codes, 0xC0 | codes >> 6, 0xE0 | codes >> 12], 0xF0 | codes >> 18)


def _last_byte(codes):
    import numpy as np

    return np.where(codes < 0x80, codes, 0x80 | codes & 0x3F)


def spliced_count(text: str, ids: Callable[[str], bytes], ends: Callable, seams: Seams, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from chunks of ``chunk`` characters whose overlaps agree; equal to encoding it whole.

    Each chunk is encoded once, from a place in the overlap on that need not be a seam; its tokens count from a seam on at
    which a token of both chunks ends. Without a seam the overlap is widened, at last over the whole chunk, which is then
    encoded together with as much again: a text without any seam costs a few times its whole encoding.
    """
    import numpy as np

    total, start, stop, size = 0, 0, min(chunk, len(text)), len(text)
    mine = ends(ids(text[:stop]))  # where tokens end, in bytes from ``start``
    while stop < size:
        low, found = stop, []
        width = overlap
        while not found and low > start:
            high, low = low, max(start, stop - width)
            found = seams.before(text, low, high + (high < stop))
            width *= 2
        begin = max(start, low)
        limit = min(size, stop + (chunk if found else stop - start))
        theirs, head = ends(ids(text[begin:limit])), len(text[start:begin].encode())
        for seam in reversed(found):
            cut = len(text[start:seam].encode())
            k, j = int(np.searchsorted(mine, cut)), int(np.searchsorted(theirs, cut - head))
            if k < len(mine) and mine[k] == cut and j < len(theirs) and theirs[j] == cut - head:
                total, start, mine = total + k + 1, seam, theirs[j + 1 :] - (cut - head)
                break
        else:
            mine = theirs if begin == start else ends(ids(text[start:limit]))
        stop = limit
    return total + len(mine)


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, ``n_bytes``, ``n_tokens``, ``over_limit``. Null and empty texts have no tokens.

    One pass without a shuffle; other columns are not read. Repeated rows come back as often as given.
    """
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = df.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                whole = value.as_py() or ""
                sizes.append(len(whole.encode()))
                counts.append(len(tool.ids(whole)) // 4 if len(whole) <= chunk else spliced_count(whole, tool.ids, tool.ends, tool.seams, chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], names=schema.names)

    return narrow.mapInArrow(run, schema)
