from __future__ import annotations

import os
import random

import pytest
from cases import frame, odd_rows

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tapeloom.llm import tokens  # noqa: E402

PARTS = ["a", "b ", "  ", "\n", " \n", "'s", "<|endoftext|>", "<|endof", "é", "漢", "1", "22", "!", "...", " ", "\t", " ", "\x1c", "word", "don't", " the", "🙂", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(library):
    import numpy as np

    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(60))) for _ in range(3000)]
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(tokens.encoder().ids(text), dtype="<u4").tolist() == encoded.ids, text


def blocks_of_all_characters(size=512):
    """Each code point beside letters, numbers, marks, white space and itself."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), size):
        yield "".join(f"a{c}b {c}7{c} {c}{c}, x'{c}s{c}'ll{c}" for c in map(chr, every[k : k + size]))


def test_every_character_is_encoded_and_spliced_as_the_library_does(library):
    import numpy as np

    tool = tokens.encoder()
    texts = list(blocks_of_all_characters())
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(tool.ids(text), dtype="<u4").tolist() == encoded.ids, text[:9]
        assert tokens.spliced_count(text, tool.ids, tool.ends, tool.seams, chunk=1500, overlap=8) == len(encoded.ids), text[:9]


def test_seams_part_the_tokens_of_every_character():
    """All seams of blocks of all characters, of random texts and of special strings: both sides have the tokens of the whole."""
    tool, draw = tokens.encoder(), random.Random(5)
    texts = [t for k, t in enumerate(blocks_of_all_characters(64)) if k % 17 == 3]
    texts += ["".join(draw.choice(PARTS) for _ in range(draw.randrange(2, 60))) for _ in range(3000)]
    many = 0
    for text in texts:
        whole, at = set(tool.ends(tool.ids(text)).tolist()), tool.seams.before(text, 0, len(text))
        assert all(len(text[:i].encode()) in whole for i in at), text[:20]
        for i in draw.sample(at, min(len(at), 3)):
            assert tool.ids(text[:i]) + tool.ids(text[i:]) == tool.ids(text), (text[:i][-9:], text[i:][:9])
            many += 1
    assert many > 5000


def test_spliced_counts_equal_whole_ones():
    tool, draw = tokens.encoder(), random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(1, 80)))
        assert tokens.spliced_count(text, tool.ids, tool.ends, tool.seams, chunk=draw.choice([4, 9, 30]), overlap=draw.choice([1, 3])) == len(tool.ids(text)) // 4, text
    for text in ("x" * 300, "<|endoftext|>" * 30, "ab " * 200, "漢字 " * 90, "漢字" * 90, "'" * 99, " " * 99, "7" * 99):
        assert tokens.spliced_count(text, tool.ids, tool.ends, tool.seams, chunk=16, overlap=2) == len(tool.ids(text)) // 4


@pytest.mark.parametrize("kind", ["han", "thai", "one letter", "base64", "digits", "mixed"])
def test_work_stays_in_proportion_without_spaces(kind):
    """Texts without white space: the spliced count takes a few times the whole encoding, and calls encode few characters twice."""
    draw = random.Random(6)
    letters = {
        "han": [chr(c) for c in range(0x4E00, 0x9FA5)], "thai": [chr(c) for c in range(0x0E01, 0x0E2E)], "one letter": ["a"], "base64": list("ABCDEFabcdef0123456789+/"), "digits": list("0123456789"),
        "mixed": [*(chr(c) for c in range(0x4E00, 0x5000)), "。", "，", "a", "7"],
    }[kind]
    text = "".join(draw.choices(letters, k=600_000))
    tool, encoded = tokens.encoder(), [0]

    def ids(part):
        encoded[0] += len(part)
        return tool.ids(part)

    assert tokens.spliced_count(text, ids, tool.ends, tool.seams) == len(tool.ids(text)) // 4
    assert encoded[0] < 4 * len(text)


def test_counts(spark, library):
    rows = odd_rows() + [(50, "<|endoftext|> word"), (51, "token " * 1024)]
    got = tokens.count_tokens(frame(spark, rows), chunk=700, overlap=20).collect()
    expected = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((str(doc_id), len((text or "").encode()), n, n > 1024))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(expected)
    assert tokens.count_tokens(frame(spark, [])).count() == 0
