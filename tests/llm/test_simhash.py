from __future__ import annotations

import random

import pyarrow as pa
import pytest
import xxhash
from cases import frame, invented, odd_rows
from pyspark.sql import functions as F

from tapeloom.llm import simhash


def plain_print(text: str | None, k: int = 3) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[tuple[int | None, int]]) -> dict[int, int | None]:
    """Smallest id per fingerprint, by comparing all pairs."""
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)] = min(doc_id, least.get(find(p), doc_id))
    return {v: least.get(find(v)) for v in values}


def test_fingerprints_and_components(spark):
    rows = odd_rows() + [(100 + k, invented(50 + k // 3, 90) + " more" * (k % 3)) for k in range(30)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [(i, plain_print(t)) for i, t, *_ in rows]
    named = plain_components(prints)
    expected = sorted((str(i), f"{p:016x}", str(named[p])) for i, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


@pytest.mark.parametrize("at_once", [4096, 4, 0])
def test_links_of_crowded_keys(spark, monkeypatch, at_once):
    """Keys with many pairs are indexed further; no link is lost, none is invented."""
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    values = {centre}
    for _ in range(150):
        x = centre
        for _ in range(draw.randrange(6)):
            x ^= 1 << draw.randrange(64)
        values.add(x)
    values |= {draw.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame(signed, "fingerprint long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a[0], b[0]) for a in signed for b in signed if a[0] < b[0] and ((a[0] ^ b[0]) & mask).bit_count() <= 3}


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (3, "A b  c d"), (3, "A b  c d"), (9, "other words stand here"), (None, None), (7, ""), (None, "lone text without a name")]
    kept = simhash.first_of_groups(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "A b  c d"), ("7", ""), ("9", "other words stand here"), ("None", "lone text without a name")]


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("at_once", [32, 2])
def test_similar_texts_form_groups(spark, monkeypatch, at_once):
    """Copies with some words changed are one group, whatever its size; unlike texts stay."""
    monkeypatch.setattr(simhash, "GROUP_AT_ONCE", at_once)
    draw, rows = random.Random(8), []
    for group in range(6):
        words = invented(600 + group, 400, 100_000).split()
        rows.append((group * 100, " ".join(words)))
        for k in range(1, 9):
            changed = list(words)
            for at in draw.sample(range(400), 1 + k % 4):
                changed[at] = f"changed{group}{k}{at}"
            rows.append((group * 100 + k, " ".join(changed)))
            assert len(shingles(rows[-1][1]) & shingles(" ".join(words))) / len(shingles(rows[-1][1]) | shingles(" ".join(words))) >= 0.85
    rows += [(1000 + k, invented(700 + k, 200, 100_000)) for k in range(20)]
    half = invented(650, 300, 100_000).split()
    rows += [(2000, " ".join(half)), (2001, " ".join(half[:150] + invented(651, 150, 100_000).split()))]
    kept = {r.doc_id for r in simhash.first_of_groups(frame(spark, rows)).collect()}
    assert kept == {0, 100, 200, 300, 400, 500, 2000, 2001} | {1000 + k for k in range(20)}


def plain_groups(rows):
    """The doc_ids that stay: the least of each component of exact Jaccard similarity 0.8 or more, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if (shared := len(one & sets[j])) and shared >= 0.8 * (len(one) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return set(least.values())


def star(seed, n, first, edits):
    """An original of 400 words and ``n`` copies with ``edits`` words changed each, at random places; the original is in the middle of the ids."""
    draw, words = random.Random(seed), invented(seed, 400, 100_000).split()
    rows = []
    for k in range(n):
        changed = list(words)
        for at in draw.sample(range(400), edits):
            changed[at] = f"changed{seed}x{k}x{at}"
        rows.append((first + k + (k >= n // 2), " ".join(changed)))
    return rows + [(first + n // 2, " ".join(words))]


@pytest.mark.parametrize("rounds, side", [(2, 1024), (0, 64)])
def test_star_of_copies_is_one_group(spark, monkeypatch, rounds, side):
    """Copies that are like the original and not like each other are one group, however many share a band value."""
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "SIDE", side)
    rows = star(31, 200, 1000, 6) + star(32, 120, 2000, 6) + [(5000 + k, invented(900 + k, 200, 100_000)) for k in range(10)]
    sets = [shingles(t) for _, t in rows[:40]]
    assert sum(len(a & b) < 0.8 * len(a | b) for a in sets for b in sets) > 1000
    kept = {r.doc_id for r in simhash.first_of_groups(frame(spark, rows)).collect()}
    assert kept == plain_groups(rows) == {1000, 2000} | {5000 + k for k in range(10)}


@pytest.mark.parametrize("at_once, side", [(32, 1024), (2, 8)])
def test_similarity_is_exact(spark, monkeypatch, at_once, side):
    """Pairs on both sides of 0.8 are told apart by their shingles, not by an estimate."""
    monkeypatch.setattr(simhash, "GROUP_AT_ONCE", at_once)
    monkeypatch.setattr(simhash, "SIDE", side)
    rows = []
    for k in range(60):  # 44 words at the end differ: 352 of 440 shingles; 45 differ: 351 of 441
        words, changed = invented(7000 + k, 400, 100_000).split(), 44 + k % 2
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-changed] + [f"other{k}x{i}" for i in range(changed)]))]
    kept = {r.doc_id for r in simhash.first_of_groups(frame(spark, rows)).collect()}
    assert kept == plain_groups(rows) == {10 * k for k in range(60)} | {10 * k + 1 for k in range(1, 60, 2)}


def test_texts_whose_names_collide_stay_apart(spark, monkeypatch):
    """One name for all texts in the first half: the second half tells them apart."""
    key = simhash.text_key
    monkeypatch.setattr(simhash, "text_key", lambda text: [F.lit(7).cast("long").alias("_t1"), key(text)[1]])
    rows = [(k, invented(8000 + k, 120, 100_000)) for k in range(6)] + [(10, invented(8000, 120, 100_000)), (11, invented(8001, 120, 100_000) + " more")]
    kept = simhash.first_of_groups(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))


def test_blocks_return_a_forest(spark):
    """A block of like texts gives fewer links than it has members, whatever the number of its pairs."""
    sets = [sorted(range(k, 400 + k)) for k in range(50)]
    sketch = [[v for v in range(simhash.SAMPLES)] for _ in sets]
    table = pa.table({
        "node": list(range(50)) * 2, "component": list(range(50)) * 2, "main": [0] * 100, "left": [True] * 50 + [False] * 50,
        "sketch": pa.array(sketch * 2, pa.list_(pa.int32())), "shingles": pa.array(sets * 2, pa.list_(pa.int64())),
    })
    found = simhash._forest(table, 200, 0.8)
    assert len(found) == 49 and all(a < b for a, b in found)
    assert all(len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) for a, b in found)


def test_no_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.first_of_groups(frame(spark, [])).count() == 0
