from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from cases import frame, odd_rows
from pyspark.sql import functions as F

from tapeloom.llm import middles
from tapeloom.llm.common import by_bytes

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "bc", " ", "  ", "\t", "\n", "\x08", "\x0e", "\x1f", "!", "\x85", "\xa0", "é", "漢", "🙂", " ", "ठ", "word"]


def by_hand(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in middles.MARKERS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_and_cuts_equal_the_pattern():
    draw = random.Random(3)
    for _ in range(300):
        texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(draw.choice([1, 4, 40])))) for _ in range(draw.randrange(1, 12))]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        units = middles.Units(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        parts = [UNIT.findall(t) for t in texts]
        assert units.counts().tolist() == [len(x) for x in parts]
        for k in range(max(map(len, parts)) + 1):
            at = [min(k, len(x)) for x in parts]
            cuts = units.cut(np.array(at))
            heads = ["".join(x[:n]) for x, n in zip(parts, at)]
            assert (cuts - offsets[:-1]).tolist() == [len(h.encode()) for h in heads]
            assert units.characters(offsets[:-1], cuts).tolist() == [len(h) for h in heads]


def test_every_byte_is_classed():
    every = np.arange(256, dtype=np.uint8)
    words = every.view("<u8")
    spaces = (middles._spaces(words).view(np.uint8) >> 7).astype(bool)
    inner = (middles._continuations(words).view(np.uint8) >> 7).astype(bool)
    assert spaces.tolist() == [b in (9, 10, 11, 12, 13, 32) for b in range(256)]
    assert inner.tolist() == [b & 0xC0 == 0x80 for b in range(256)]


def test_rows_equal_a_plain_version_and_come_back(spark):
    rows = odd_rows() + [(100 + k, f"{'  ' * (k % 3)}eins zwei\tdrei é漢 <{k}>  vier{' ' * (k % 2)}") for k in range(60)] + [(300, "a <P> b"), (301, "<S"), (302, "P><S>"), (303, "x <"), (304, "<P x> <M y")]
    rows.append((305, "lang " * 400_000 + "漢" * 100))
    docs = frame(spark, rows)
    for rate, spm in ((50, 80), (100, 0), (100, 100), (100, 50), (0, 50)):
        cut = middles.transform(docs, rate=rate, spm=spm)
        got = cut.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()
        expected = sorted(repr((r[0], *by_hand(r[0], r[1], rate, spm), r[1] or "")) for r in rows)
        assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == expected
    assert middles.transform(frame(spark, [])).count() == 0


def test_pieces_hold_few_bytes_or_one_row():
    batch = pa.record_batch({"k": list(range(7)), "text": ["aaaa", None, "", "b" * 50, "cc", "dddd", "eeee"]})
    pieces = list(by_bytes(iter([batch]), 1, limit=8))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1, 2], [3], [4, 5], [6]]
