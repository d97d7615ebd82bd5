"""Each stage of the corpus pipeline, and the whole, against plain Python on a small table with odd rows."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_mixing
from cases import SCHEMA, frame, invented, odd_rows
from test_simhash import plain_print, shingles
from test_spans import plain as plain_spans

import corpus_pipeline
from tapeloom.llm import crf, packing, queries, tokens

WHITE = " \t\n\x0b\x0c\r"


def documents():
    """Good and bad texts, copies, near copies of one original, a shared passage, repeated rows, and the odd ones."""
    draw, rows = random.Random(21), list(odd_rows())
    langs, sources = ["en", "en", "de", "fr", None], ["src1", "src2", "src14", "web", None]
    for k in range(60):
        rows.append((100 + k, invented(100 + k, 60 + 7 * k % 90, 100_000), langs[k % 5], sources[k % 4]))
    for k in range(40):
        text = "\n".join(" ".join(w + draw.choice(["%%%", "###", "$$$"]) for w in line.split()) for line in invented(300 + k, 70, 100_000).split("\n"))
        rows.append((300 + k, text, "en", "src1"))
    words = invented(77, 300, 100_000).split()
    for k in range(12):
        changed = list(words)
        for at in draw.sample(range(300), 4):
            changed[at] = f"changed{k}x{at}"
        rows.append((400 + k, " ".join(changed), "en", "src2"))
    rows.append((412, " ".join(words), "en", "src2"))
    passage = invented(78, 60, 100_000).replace("\n", " ")
    rows += [(450 + k, invented(800 + k, 50, 100_000) + "\n" + passage + "\n" + invented(900 + k, 40, 100_000), "de", "src14") for k in range(6)]
    rows += [(500 + k, rows[20][1], "en", "src1") for k in range(5)] + rows[25:28] + [(120, rows[30][1], "en", "src1")]
    return [(*r, "en", "src1")[:4] if len(r) == 2 else r for r in rows]


def label_rows():
    return [(k, 1, 0) for k in range(100, 160)] + [(k, 0, 0) for k in range(300, 340)] + [(None, 1, 0), (9999, 0, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    frame(spark, documents()).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(label_rows(), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def field(spark, folder):
    return crf.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def plain_quality(rows, field):
    return [r for r in rows if crf.text_score(field, (r[1] or "").encode()) >= 0.5]


def plain_near(rows):
    """Rows that stay: of texts joined by three bits or a similarity of 0.8, all pairs looked at, that of the smallest doc_id."""
    texts = sorted({r[1] or "" for r in rows})
    prints, sets = [plain_print(t) for t in texts], [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if (prints[i] ^ prints[j]).bit_count() <= 3 or shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
            root[find(i)] = find(j)
    best = {}
    for r in rows:
        key = find(texts.index(r[1] or ""))
        if key not in best or (r[0] is None, r[0] or 0) < (best[key][0] is None, best[key][0] or 0):
            best[key] = r
    return list(best.values())


def plain_substrings(rows):
    left = plain_spans(rows)
    out = []
    for doc_id, text, *rest in rows:
        kept = left.get((doc_id is None, doc_id or 0, text), text) if text else text
        if kept == text or (kept or "").strip(WHITE):
            out.append((doc_id, kept, *rest))
    return out


def plain_mixture(rows):
    """The rows once per epoch that takes them; doc_ids name rows here."""
    epochs = Counter(r[0] for r in test_mixing.plain(rows, 1.0, 2))
    return [r for r in rows for _ in range(epochs[str(r[0])])]


def plain_pieces(rows):
    tool, out = tokens.encoder(), Counter()
    for doc_id, text, *_ in rows:
        ids = np.append(np.frombuffer(tool.ids(text or ""), dtype="<u4"), np.uint32(2)).astype("<u4")
        head, at = len(ids) % 1024 or 1024, 0
        for piece, stop in enumerate(range(head, len(ids) + 1, 1024)):
            out[(doc_id, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes()))] += 1
            at = stop
    return out


def shown(df):
    return sorted(map(repr, ((r.doc_id, r.text or "", r.lang, r.source, r.n_chars) for r in df.collect())))


def expected(rows):
    return sorted(map(repr, ((i, t or "", lang, source, None if t is None else len(t)) for i, t, lang, source in rows)))


def sequences(rows):
    """Checks places: gapless from 0, at most 1024 tokens; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held)


def test_scores_equal_those_over_all_labellings(field):
    """A document's whole score from every labelling of its lines, for texts of up to nine lines."""
    for seed, text in enumerate(["", "one line", invented(5, 40), "a b c.\n\n###$$$ %%%\nD e f!", "\n" * 4, "x %%% y ###\n" * 9]):
        text = "\n".join(text.split("\n")[:9]).encode()
        features, size = crf.line_features(text)
        node = field.node(features)
        weights, good = 0.0, np.zeros(len(node))
        for labels in itertools.product((0, 1), repeat=len(node)):
            steps = sum(field.stay[0] if a else field.stay[1] for a, b in zip(labels, labels[1:]) if a == b)
            w = np.exp(sum(x for x, g in zip(node, labels) if g) + steps)
            weights, good = weights + w, good + w * np.array(labels)
        mean = float((good / weights * (size + 1)).sum() / (size + 1).sum())
        p = min(max(mean, 1e-6), 1 - 1e-6)
        score = 1 / (1 + np.exp(-(field.slope * np.log(p / (1 - p)) + field.offset)))
        assert crf.text_score(field, text) == pytest.approx(score, abs=1e-9), seed


def test_stages_are_the_contracts():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixture", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, folder, field):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.quality(spark, docs, folder)
    kept = plain_quality(documents(), field)
    assert got.columns == docs.columns and shown(got) == expected(kept)
    assert {r[0] for r in kept} >= set(range(100, 160)) and not {r[0] for r in kept} & set(range(300, 340))


def test_near_duplicates(spark, folder):
    rows = documents()
    docs = frame(spark, rows)
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    kept = plain_near(rows)
    assert got.columns == docs.columns and sorted(r.doc_id or -1 for r in got.collect()) == sorted(r[0] or -1 for r in kept)
    assert sum(400 <= (r[0] or 0) < 413 for r in kept) == 1 and sum(500 <= (r[0] or 0) < 505 for r in kept) == 0


def test_substrings(spark, folder):
    rows = documents()
    docs = frame(spark, rows)
    got = corpus_pipeline.substrings(spark, docs, folder)
    assert got.columns == docs.columns and shown(got) == expected(plain_substrings(rows))


def test_mixture(spark, folder, monkeypatch):
    monkeypatch.setattr(test_mixing, "MIX", queries.MIX)
    rows = list({r[0]: r for r in documents() if r[0] is not None}.values())
    docs = frame(spark, rows)
    got = corpus_pipeline.mixture(spark, docs, folder)
    assert got.columns == docs.columns and shown(got) == expected(plain_mixture(rows))


def test_packing(spark, folder):
    rows = documents()
    got = corpus_pipeline.pack(spark, frame(spark, rows), folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows)
    counts = Counter(r.length for r in got)
    assert sequences(got) <= sum(packing.best_fit(counts, 1024).values())


def test_the_whole_equals_the_plain_stages(spark, folder, field, monkeypatch):
    monkeypatch.setattr(test_mixing, "MIX", queries.MIX)
    rows = plain_mixture(plain_substrings(plain_near(plain_quality(documents(), field))))
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows)
    sequences(got)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
