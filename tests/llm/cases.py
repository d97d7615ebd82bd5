"""Small frames shared by the tests: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

EXTRA = "fingerprint string, score string, n_removed string, node string, piece string, key string, `a.b` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def frame(spark, rows):
    """Documents (doc_id, text[, lang, source]) with extra columns."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *("en", "src1"))[:4] if len(row) == 2 else row
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, *["x"] * 7))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def invented(seed: int, n: int, vocabulary: int = 400) -> str:
    """``n`` words in sentences and lines."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        out.append("w" + format(draw.randrange(vocabulary), "x") + draw.choice(["", "", "", "", "", "", "", ",", ".", ".\n"]))
    return " ".join(out).replace("\n ", "\n")


def odd_rows():
    """One of each case that operators must survive."""
    long = invented(7, 6000)
    return [
        (1, None), (2, ""), (3, " \n "), (4, "one"), (5, long), (6, long), (6, long), (7, invented(8, 60), None, None), (None, invented(9, 60)), (None, None),
        (8, invented(8, 60)), (9, "é漢字🙂 " * 40), (10, "\x00\x1c tab\there"), (11, "x" * 5000), (12, "ab " * 900, "de", "other"),
    ]
