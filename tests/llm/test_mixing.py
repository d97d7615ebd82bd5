from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

from cases import frame, invented, odd_rows

from tapeloom.llm import mixing

MIX = {"lang": {"en": 3, "de": 2}, "source": {"src1": 5}}


def shared(budget, children):
    """Water filling by repeatedly capping: {child: (capacity, weight)} -> {child: tokens}."""
    left, open_ones, out = min(budget, sum(c for c, _ in children.values())), dict(children), {}
    while open_ones:
        weights = sum(w for _, w in open_ones.values())
        full = [k for k, (c, w) in open_ones.items() if Fraction(c, w) <= Fraction(left, weights)]
        if not full:
            return out | {k: left * w // weights for k, (_, w) in open_ones.items()}
        for k in full:
            out[k] = open_ones.pop(k)[0]
            left -= out[k]
    return out


def plain(rows, share, epochs, domains=4):
    docs, leaves = defaultdict(list), Counter()
    for doc_id, text, *rest in rows:
        lang, source = rest or ("en", "src1")
        number = re.search(r"([0-9]{1,9})$", source or "")
        leaf = (f"domain{int(number[1]) % domains}" if number else "other", lang, source)
        n = len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
        docs[leaf].append((doc_id, n))
        leaves[leaf] += n
    budget = int(sum(leaves.values()) * share)
    weight = lambda level, v: MIX.get(level, {}).get(v, 1)

    def down(prefix, t):
        level = mixing.LEVELS[len(prefix)]
        names = {leaf[len(prefix)] for leaf in leaves if leaf[: len(prefix)] == prefix}
        given = shared(t, {v: (epochs * sum(n for leaf, n in leaves.items() if leaf[: len(prefix) + 1] == (*prefix, v)), weight(level, v)) for v in names})
        for v, n in given.items():
            if len(prefix) == 2:
                yield (*prefix, v), n
            else:
                yield from down((*prefix, v), n)

    out = []
    for leaf, t in down((), budget):
        for epoch in range(epochs):
            give = t - epoch * leaves[leaf]
            if give <= 0 or not leaves[leaf]:
                continue
            order = sorted(docs[leaf], key=lambda d: (hashlib.md5(f"mix|{epoch}|{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or 0))
            run = 0
            for doc_id, n in order:
                if run < give or give >= leaves[leaf]:
                    out.append((str(doc_id), *map(str, leaf), n, epoch))
                run += n
    return sorted(out)


def rows_of_test():
    rows = odd_rows()
    for k in range(150):
        lang = ["en", "en", "en", "de", "fr", None][k % 6]
        rows.append((100 + k, invented(k, 5 + 11 * k % 90), lang, ["src1", "src2", "src12", "web", None][k % 5]))
    return [r for r in rows if r[0] is not None]


def test_against_brute_force(spark):
    rows = rows_of_test()
    for share, epochs in ((0.3, 2), (1.0, 2), (0.9, 1), (5.0, 3)):
        got = mixing.mix(frame(spark, rows), MIX, share=share, epochs=epochs).collect()
        mine = sorted((str(r.doc_id), str(r.domain), str(r.lang), str(r.source), r.tokens, r.epoch) for r in got)
        # repeated rows are interchangeable, their order does not change what is taken
        assert mine == plain(rows, share, epochs), (share, epochs)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(1, "w " * 10, "en", "src0"), (2, "w " * 1000, "en", "src4"), (3, "w " * 1000, "en", "src1")]
    got = mixing.mix(frame(spark, rows), {}, share=0.5, epochs=1).collect()
    # each domain gets half of 1005 tokens; src0 lacks most of its share, and its sibling src4 takes it
    assert {r.doc_id for r in got} == {1, 2, 3}
    leaves = spark.createDataFrame([("d0", "en", "a", 10, 1, 1, 1), ("d0", "en", "b", 1000, 1, 1, 1), ("d1", "en", "c", 1000, 1, 1, 1)], "domain string, lang string, source string, tokens long, domain_weight int, lang_weight int, source_weight int")
    budgets = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 1005, 1).collect()}
    assert budgets == {"a": 10, "b": 492, "c": 502}


def test_take_and_no_rows(spark):
    docs = frame(spark, rows_of_test())
    taken = mixing.mix(docs, MIX, share=1.0, epochs=2)
    out = mixing.take(docs, taken)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) >= Counter({r.doc_id: 1 for r in taken.collect()})
    empty = frame(spark, [])
    assert mixing.mix(empty, MIX).count() == 0 and mixing.take(empty, mixing.mix(empty, MIX)).count() == 0
