from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import frame, invented, odd_rows

from tapeloom.llm import queries, squares


def by_hand(words, least_length=24, exponent=3):
    """(start, length, period) of all runs: every period, from the shortest on; a stretch keeps the first one found."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least_length, exponent * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def drawn(draw, n, letters):
    words = [draw.randrange(letters) for _ in range(n)]
    for _ in range(draw.randrange(4)):
        if n > 10:
            a, p = draw.randrange(n), draw.randrange(1, max(2, n // 4))
            for i in range(a + p, min(n, a + draw.randrange(p, 6 * p))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force_however_words_are_appended(seed):
    draw = random.Random(seed)
    for _ in range(600):
        words = drawn(draw, draw.randrange(240), draw.choice([1, 2, 2, 3, 5, 50]))
        least_length, exponent = draw.choice([(24, 3), (1, 2), (6, 2), (3, 3), (10, 4)])
        catchers, i, most = squares.Catchers(least_length, exponent), 0, draw.choice([1, 3, 17, 1000])
        while i < len(words):
            step = draw.randrange(1, most + 1)
            catchers.append(np.array(words[i : i + step], dtype=np.int64))
            i += step
        assert [(s, e - s, p) for s, e, p in catchers.finish()] == by_hand(words, least_length, exponent)


def test_texts_of_one_stream_do_not_meet():
    draw = random.Random(9)
    texts = [[b"%d" % w for w in drawn(draw, draw.randrange(120), draw.choice([1, 2, 4]))] for _ in range(400)]
    assert squares.runs_of(texts, append=97) == [by_hand(words) for words in texts]


def test_hostile_texts():
    """All words alike, two words by turns, Fibonacci words, nested repeats: near-linear work, known runs."""
    one = [b"a"] * 300_000
    assert squares.runs_of([one])[0] == [(0, 300_000, 1)]
    assert squares.runs_of([[b"a", b"b"] * 100_001])[0] == [(0, 200_002, 2)]
    a, b = [0], [0, 1]
    while len(b) < 2_000:
        a, b = b, b + a
    assert squares.runs_of([b])[0] == by_hand(b)
    nested = ([1] * 30 + [2]) * 40 + [3] + ([1] * 29 + [2]) * 40
    assert squares.runs_of([nested * 3])[0] == by_hand(nested * 3)


def test_wrong_names_do_not_make_runs(monkeypatch):
    """All windows named alike: every reported run is still compared word by word."""
    monkeypatch.setattr(squares, "_mix", lambda left, right: np.zeros(len(left), dtype=np.uint64))
    assert squares.runs_of([[b"%d" % i for i in range(500)]]) == [[]]


def whole(text, doc_id):
    """The contract's row, from the text alone."""
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, gone = by_hand(words), set()
    for s, n, p in runs:
        gone.update(range(s + p, s + n))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(5)
    rows = odd_rows() + [(k, " ".join(f"w{w}" for w in drawn(draw, draw.randrange(150), draw.choice([1, 2, 5, 300])))) for k in range(100, 400)]
    rows += [(k, invented(k, 200)) for k in range(400, 500)] + [(-5, "tick tock " * 50), (2**40, "a\x0bb\x0cc\r\n" * 9)]
    for name, some in (("some", rows), ("none", [])):
        (tmp_path / name).mkdir()
        frame(spark, some).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op11_periodic_runs(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(whole(text, doc_id)) for doc_id, text, *_ in some)


def test_operator_returns_texts(spark):
    got = {r.doc_id: r for r in squares.periodic_runs(frame(spark, [(1, "x  y " * 20 + "z"), (2, None)])).collect()}
    assert (got[1].n_words, [tuple(r) for r in got[1].runs], got[1].collapsed) == (41, [(0, 40, 2)], "x y z")
    assert (got[2].n_words, got[2].runs, got[2].collapsed) == (0, [], "")
