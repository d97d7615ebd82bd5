from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import frame, invented, odd_rows

from tapeloom.llm import crf, divergence

JUNK = "%%% ### $$$ *** &&&"


def labelled(spark):
    draw = random.Random(6)
    rows, labels = [], []
    for k in range(240):
        text = invented(k, 80)
        good = k % 4 > 0
        if not good:
            text = "\n".join(" ".join(w + draw.choice(JUNK.split()) for w in line.split()) for line in text.split("\n"))
        rows.append((k, text))
        labels.append((k, int(good), 0))
    return rows, spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(1)
    for n in (1, 2, 5):
        node, stay = draw.normal(size=n), (0.7, -0.3)
        weights = {}
        for code in range(2**n):
            good = [code >> t & 1 for t in range(n)]
            steps = [(stay[0] if g else stay[1]) if g == h else 0 for g, h in zip(good, good[1:])]
            weights[tuple(good)] = np.exp(sum(x for x, g in zip(node, good) if g) + sum(steps))
        z = sum(weights.values())
        padded = np.zeros((2, n + 2))
        padded[:, :n] = node
        marginal, goods, bads, log_z = crf.forward_backward(padded, np.array([n, n]), stay)
        for t in range(n):
            assert marginal[0, t] == pytest.approx(sum(w for g, w in weights.items() if g[t]) / z)
            assert crf.chain_marginals(node.tolist(), stay)[t] == pytest.approx(marginal[0, t])
        assert goods[1] == pytest.approx(sum(w * sum(a and b for a, b in zip(g, g[1:])) for g, w in weights.items()) / z)
        assert bads[1] == pytest.approx(sum(w * sum(not a and not b for a, b in zip(g, g[1:])) for g, w in weights.items()) / z)
        assert log_z[0] == pytest.approx(np.log(z))


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows + [(1000 + k, *r[1:]) for k, r in enumerate(odd_rows())] + [(None, "x")])
    field = crf.fit(docs, labels)
    got = {r.doc_id: r for r in crf.score(docs, field).collect()}
    held = [k for k, _ in rows if got[k].held_out]
    assert 50 < len(held) < 110
    assert np.mean([got[k].predicted == int(k % 4 > 0) for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert crf.keep_good(docs, field).columns == docs.columns
    assert crf.keep_good(docs, field).count() == sum(r.predicted for r in crf.score(docs, field).collect())
    assert crf.score(docs.limit(0), field).count() == 0 and crf.keep_good(docs.limit(0), field).count() == 0


def test_held_out_labels_and_no_labels(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    assert crf.fit(docs, labels) == crf.fit(docs, turned)
    assert {r.score for r in crf.score(docs, crf.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_sampled_lines_are_spread_over_the_text():
    assert crf._spread(256, 8, 32, 1).tolist() == list(range(256)) and crf._spread(0, 8, 32, 1).tolist() == []
    for lines in (257, 300, 5000):
        places = crf._spread(lines, 8, 32, lines).tolist()
        assert places == sorted(set(places)) and len(places) == 256 and 0 <= places[0] and places[-1] < lines
        assert [sum(a * lines // 8 - 1 <= p <= (a + 1) * lines // 8 for p in places) >= 32 for a in range(8)] == [True] * 8
    assert crf._spread(5000, 8, 32, 1).tolist() != crf._spread(5000, 8, 32, 2).tolist()


def test_the_driver_gets_one_text_of_a_sampled_document(spark, monkeypatch):
    """However often a doc_id stands in the table, and with whatever texts."""
    rows, labels = labelled(spark)
    seen = []
    fit_field = crf.fit_field
    monkeypatch.setattr(crf, "fit_field", lambda sample: seen.append(len(sample)) or fit_field(sample))
    once = crf.fit(frame(spark, rows), labels)
    assert crf.fit(frame(spark, rows + [rows[0]] * 500 + [rows[3]] * 500), labels) == once
    some = rows[0][0]
    crf.fit(frame(spark, rows + [(some, invented(k, 50)) for k in range(300)]), labels)
    assert len(set(seen)) == 1


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def plain_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    half = [sum(a * np.log2(a / c) for a, c in zip(x, m) if a > 0) for x in (p, q)]
    return max(0, sum(half) / 2) ** 0.5


def test_rules_against_brute_force(spark):
    draw = random.Random(5)
    rows = odd_rows() + [(20, "same line here now\n" * 30), (21, "a b c d e f g h " * 2 + " ".join("z" + str(k) for k in range(90)))]
    rows += [(100 + k, invented(k, 200 + 40 * k), draw.choice(["en", "de", None]), "s") for k in range(25)]
    rows += [(200, " ".join(w + "&&&" for w in invented(90, 300).split()), "en", "s"), (201, invented(91, 300).upper(), "en", "s")]
    got = divergence.judge_quality(frame(spark, rows), least_reference=1000).collect()
    langs = [r[2] if len(r) > 2 else "en" for r in rows]
    words = [re.findall(r"[^\x20\x09-\x0d]+", r[1] or "") for r in rows]
    patterns = ["[a-z]", *divergence.CLASSES]

    def classes(text):
        counts = [len(re.findall(p, text)) for p in patterns]
        return [*counts, len(text) - sum(counts)]

    expected = []
    for row, lang, own in zip(rows, langs, words):
        text = row[1] or ""
        of_lang = [k for k, other in enumerate(langs) if other == lang]
        if sum(len(words[k]) for k in of_lang) < 1000:  # too little text: all texts are the reference
            of_lang = range(len(rows))
        counts = Counter(w for k in of_lang for w in words[k])
        top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: divergence.COMMON]
        base = plain_base(text)
        by_class = by_word = None
        if len(text) >= 300:
            by_class = plain_distance(classes(text), np.sum([classes(rows[k][1] or "") for k in of_lang], axis=0))
        if len(own) >= 100:
            mine = [own.count(w) for w in top]
            ref = [counts[w] for w in top]
            by_word = plain_distance([*mine, len(own) - sum(mine)], [*ref, sum(counts.values()) - sum(ref)])
        kept = not base[-1] and not (by_class or 0) > 0.25 and not (by_word or 0) > 0.3
        expected.append((str(row[0]), *base, *(None if x is None else round(float(x), 6) for x in (by_class, by_word)), kept))
    result = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, *(None if x is None else round(x, 6) for x in (r.class_distance, r.word_distance)), r.kept) for r in got]
    assert sorted(map(str, result)) == sorted(map(str, expected))
    assert not any(r.kept for r in got if r.doc_id in (200, 201))
    assert divergence.judge_quality(frame(spark, [])).count() == 0


def test_a_rare_language_is_judged_as_a_common_one(spark):
    """The same junk goes, and the same good text stays, where its language has little text and where it has much."""
    draw = random.Random(9)
    others = [(k, invented(k, 400), "en", "s") for k in range(40)]
    good, junk = (900, invented(900, 300), "xx", "s"), (901, " ".join(draw.choice(["7/7", "0|0", "#$%", "@@9"]) for _ in range(400)), "xx", "s")
    for more in (0, 3, 40):
        rows = others + [good, junk] + [(500 + k, invented(500 + k, 400), "xx", "s") for k in range(more)]
        kept = {r.doc_id: r.kept for r in divergence.judge_quality(frame(spark, rows)).collect()}
        assert kept[900] and not kept[901], more
