import random
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex

from gridtable.llm import pieces as m
from gridtable.llm.common import utf8


def matches(pattern, texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends = m.splitter(pattern)(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    out = [[] for _ in texts]
    for r, a, b in zip(row, starts, ends, strict=True):
        out[r].append(data[a:b].tobytes().decode())
    return out


def noise(rng, n):
    known = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Co", "Cn")]
    for _ in range(n):
        some = [rng.choice(known) for _ in range(6)]
        yield "".join(rng.choice([*some, " ", "  ", "\n", "\t", "'", "s", "ll", "re", "a", "7", "_", "é", "!", "\xa0", "\x1c"]) for _ in range(rng.randrange(40)))


def test_arrays_split_as_the_pattern():
    whole = regex.compile(m.BYTE_LEVEL).findall
    texts = [*noise(random.Random(1), 4000), "", "", "'s't're'x ''s 's\n's 'summer 'l 'll", "'", "'r", "a'", " ", "a \n", ""]
    assert matches(m.BYTE_LEVEL, texts) == [whole(t) for t in texts]
    ascii_only = [t.encode("ascii", "ignore").decode() for t in texts]
    assert matches(m.BYTE_LEVEL, ascii_only) == [whole(t) for t in ascii_only]


def test_each_character():
    whole = regex.compile(m.BYTE_LEVEL).findall
    texts = [f"a{chr(c)}1 {chr(c)}'s" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 100_000):
        some = texts[i : i + 100_000]
        assert matches(m.BYTE_LEVEL, some) == [whole(t) for t in some]


@pytest.mark.parametrize("pattern", [r"[a-z]+|\d", r"\s*\p{L}+"])
def test_other_patterns(pattern):
    texts = ["ab 12 éa\n日本 x", "", "!", *noise(random.Random(3), 100)]
    assert matches(pattern, texts) == [regex.findall(pattern, t) for t in texts]


@pytest.mark.parametrize("most", [5, 1000])
def test_pieces_are_put_together(most):
    asked = []

    def learn(new):
        asked.extend(new)
        return [list(p) for p in new]

    def encode(texts):
        ids, upto = own.encode(*utf8(pa.array(texts, pa.string())))
        return [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)]

    own = m.Pieces(m.BYTE_LEVEL, learn, most)
    for _ in range(3):
        rng = random.Random(2)
        for _ in range(30):
            texts = ["".join(rng.choice(" abcdeé'1") * rng.choice([1, 1, 1, 30]) for _ in range(20)) for _ in range(3)]
            assert encode(texts) == [list(t.encode()) for t in texts]
    texts = ["a b c a", "", "a b", "x y z w v u", "a\0", "a", "\0", "\0\0", "q" * 23, "q" * 24, None]
    assert encode(texts) == [list((t or "").encode()) for t in texts]
    assert encode([]) == [] and encode(["", ""]) == [[], []]
    if most == 1000:
        short = [p for p in asked if len(p) <= m.LONGEST]
        assert len(short) == len(set(short))  # each is learned once
    else:
        assert own.used < 200  # and what is kept stays bounded


def test_many_pieces():
    """The table grows, keeps all of them and finds each again."""
    own = m.Pieces(m.BYTE_LEVEL, lambda new: [[int(p)] for p in new], 1 << 20)
    text = " ".join(map(str, range(50_000)))
    for _ in range(2):
        ids, _ = own.encode(*utf8(pa.array([text])))
        assert ids.tolist() == list(range(50_000))
    assert own.used == 50_000
