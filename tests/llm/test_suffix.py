from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from cases import frame, invented, odd_rows

from tapeloom.llm import suffix


def plain(texts: list[bytes], length: int):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(b"".join(b"x" if g else b" " for g in gone).split()), hashlib.sha256(left).hexdigest()))
    return out


def texts():
    draw = random.Random(4)
    shared = [invented(k, 160) for k in range(4)]
    out = []
    for k in range(40):
        parts = [invented(500 + k, draw.randrange(5, 80))]
        for _ in range(draw.randrange(3)):
            source = draw.choice(shared)
            low = draw.randrange(len(source) // 2)
            parts += [source[low : low + draw.randrange(380, 700)], invented(900 + k, draw.randrange(1, 40))]
        out.append(" ".join(parts))
    return out + ["ab" * 400, "abc" * 300, "x" * 399, "x" * 400, "y" * 401, shared[0][:650] + "!" + shared[0][:650]]


@pytest.mark.parametrize("in_task", [2000, 3, 1])
def test_against_brute_force(spark, monkeypatch, in_task):
    """All bytes of repeated 400-byte strings and no others go, however the buckets are refined."""
    monkeypatch.setattr(suffix, "IN_TASK", in_task)
    monkeypatch.setattr(suffix, "STEP", 1 << 10)
    rows = odd_rows() + [(100 + k, t) for k, t in enumerate(texts())]
    got = suffix.remove_repeated_bytes(frame(spark, rows)).collect()
    expected = plain([(t or "").encode() for _, t, *_ in rows], 400)
    want = sorted((str(r[0]), *e) for r, e in zip(rows, expected))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_equal_strings_have_one_anchor():
    text = invented(1, 400).encode()
    for cut in (0, 13, 700):
        moved = b"other words first " + text[cut:]
        for s, e, a, g in zip(*suffix.anchors(moved, 400, 100)):
            for p in (s, e):
                original = p - 18 + cut
                if p >= 18:
                    at = [(x, y) for b, c, x, y in zip(*suffix.anchors(text, 400, 100)) if b <= original <= c]
                    assert at == [(a - 18 + cut, g)]


def test_no_rows(spark):
    assert suffix.remove_repeated_bytes(frame(spark, [])).count() == 0
