from __future__ import annotations

import random
import re
from collections import defaultdict

import xxhash
from cases import frame, invented, odd_rows

from tapeloom.llm import spans


def slow_units(text, width=8):
    """(piece, its words, whether it ends a line) in order, word by word."""
    data = (text or "").encode()
    places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(data[a:b])[:8], "little") for a, b in places]
    picked = {max(range(i, i + width), key=lambda k: (-hashes[k], k)) for i in range(len(places) - width + 1)}
    out, start, held = [], 0, []
    for k, (a, b) in enumerate(places):
        held.append(data[a:b])
        after = places[k + 1][0] if k + 1 < len(places) else len(data)
        line = b"\n" in data[b:after] or k + 1 == len(places)
        if line or data[b - 1 : b] in (b".", b"!", b"?") or k in picked:
            out.append((data[start:after], tuple(held), line))
            start, held = after, []
    return out


def slow_runs(units, run=3, least=24):
    found, size = set(), [len(w) for _, w, _ in units]
    for i in range(len(units)):
        for j in range(i + run, len(units) + 1):
            if sum(size[i:j]) >= least:
                found.add((i, j))
                break
    for j in range(run, len(units) + 1):
        if units[j - 1][2]:
            found.update([(i, j) for i in range(j - run, -1, -1) if sum(size[i:j]) >= least][:1])
    return sorted(found)


def plain(rows):
    """Texts after removal: every run compared by its words."""
    seen = defaultdict(list)
    docs = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t})
    order = {d: k for k, d in enumerate(docs)}
    units = {d: slow_units(d[2]) for d in docs}
    for d in docs:
        for i, j in slow_runs(units[d]):
            seen[tuple(w for _, words, _ in units[d][i:j] for w in words)].append((order[d], i, j, d))
    gone = defaultdict(set)
    for places in seen.values():
        for _, i, j, d in sorted(places)[1:]:
            gone[d] |= set(range(i, j))
    return {d: b"".join(p for k, (p, *_) in enumerate(units[d]) if k not in gone[d]).decode() if gone[d] else d[2] for d in docs}


def test_units_and_runs_equal_a_slow_version():
    texts = [t or "" for _, t, *_ in odd_rows()] + ["", " ", "a", "\n\na b\n c. d", "é漢. x" * 30, invented(3, 500), "", "w " * 100] + [invented(k, k) for k in range(40)]
    units = spans.Units([t.encode() for t in texts], 8)
    low, high = units.runs(3, 24)
    h1, h2 = units.named(low, high)
    named = defaultdict(set)
    for k, text in enumerate(texts):
        slow = slow_units(text)
        first, last = units.first[k], units.first[k + 1]
        edges = [int(units.begin[k]), *units.end[first:last].tolist()]
        assert [units.body[a:b] for a, b in zip(edges, edges[1:])] == [p for p, *_ in slow]
        mine = [(int(a - first), int(b - first)) for a, b in zip(low, high) if first <= a < last]
        assert mine == slow_runs(slow)
        for a, b, *h in zip(low.tolist(), high.tolist(), h1.tolist(), h2.tolist()):
            if first <= a < last:
                named[tuple(h)].add(tuple(w for _, words, _ in slow[a - first : b - first] for w in words))
    assert all(len(x) == 1 for x in named.values()) and len(named) == len({next(iter(x)) for x in named.values()})


def test_units_lose_nothing():
    texts = [(t or "").encode() for _, t, *_ in odd_rows()]
    left, removed = spans.without(texts, [[] for _ in texts], 8)
    assert [a for a, b in zip(left, texts) if b.strip(b" \t\n\x0b\x0c\r")] == [b for b in texts if b.strip(b" \t\n\x0b\x0c\r")] and not any(removed)


def test_against_brute_force(spark):
    passage = invented(77, 70)
    rows = odd_rows() + [(200 + k, invented(300 + k, 40) + ".\n" + passage + ".\n" + invented(400 + k, 30)) for k in range(6)]
    got = spans.remove_repeated_spans(frame(spark, rows))
    assert got.columns == [c for c in frame(spark, rows).columns if c != "n_removed"] + ["n_removed"]
    expected = plain(rows)
    want = sorted((str(i), expected.get((i is None, i or 0, t), t) if t else t or "") for i, t, *_ in rows)
    result = got.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in result) == want
    assert any(r.n_removed for r in result if r.doc_id and r.doc_id > 200) and not any(r.n_removed for r in result if r.doc_id == 200)


def test_planted_passage_stays_once(spark):
    """A passage of more than 50 words that many documents share is left in one of them; clean documents stay whole."""
    passage = invented(5, 55).replace("\n", " ") + "."
    rows = [(k, invented(1000 + k, 80, 100_000) + ".\n" + passage + "\n" + invented(2000 + k, 80, 100_000)) for k in range(8)]
    rows += [(50 + k, invented(3000 + k, 120, 100_000)) for k in range(8)]
    got = {r.doc_id: r.text for r in spans.remove_repeated_spans(frame(spark, rows)).collect()}
    words = passage.split()
    held = [k for k, t in got.items() if " ".join(words[:50]) in " ".join(t.split()) or " ".join(words[5:55]) in " ".join(t.split())]
    assert held == [0]
    assert all(got[i] == t for i, t in rows if i >= 50 or i == 0)


def test_passages_inside_sentences(spark):
    """51 shared words without marks, begun and ended inside unlike sentences, stay in one document; brute force over words."""
    draw, rows, passages = random.Random(4), [], []
    for k in range(300):
        passages.append([f"p{k}x{draw.randrange(10**6)}" for _ in range(51)])
        for copy in (0, 1):
            around = [f"o{k}x{copy}x{draw.randrange(10**6)}" for _ in range(60)]
            at = draw.randrange(10, 50)
            rows.append((2 * k + copy, " ".join(around[:at] + passages[-1] + around[at:])))
    got = {r.doc_id: r.text.split() for r in spans.remove_repeated_spans(frame(spark, rows)).collect()}
    for k, passage in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1].split()
        left = set(got[2 * k + 1])
        assert not left.issuperset(passage) and [w for w in rows[2 * k + 1][1].split() if w[0] == "o"] == [w for w in got[2 * k + 1] if w[0] == "o"]
        assert len(left.intersection(passage)) < 40


def test_units_are_small():
    for _, text, *_ in odd_rows():
        assert max((len(w) for _, w, _ in slow_units(text)), default=0) <= 8


def test_no_rows(spark):
    assert spans.remove_repeated_spans(frame(spark, [])).count() == 0
