import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from gridtable.llm import byte_bpe
from gridtable.llm.queries import MULTILINGUAL, PATTERN


@pytest.fixture(scope="module")
def own():
    return byte_bpe.Encoder(MULTILINGUAL, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.v.ranks, special_tokens={})


def noise(rng, n):
    return "".join(rng.choice("aeinrst hé日本 0123\n\t#$\"ñ!€😀'sİ  ") for _ in range(n))


def encoded(encoder, texts):
    ids, upto = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)]


def test_as_the_library(own, library):
    rng = random.Random(2)
    texts = [noise(rng, rng.randrange(60)) for _ in range(1500)] + ["", " " * 300, "a" * 500, "the " * 200, "<|endoftext|>"]
    got = encoded(own, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    tokens = byte_bpe.token_bytes(MULTILINGUAL)
    assert all(byte_bpe.decoded(np.array(x, "<u4").tobytes(), tokens) == t.encode() for x, t in zip(got, texts, strict=True))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_other_vocabulary(name):
    other = byte_bpe.Encoder(public_tokenizers.path(name), PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=other.v.ranks, special_tokens={})
    rng = random.Random(5)
    texts = [noise(rng, 40) for _ in range(300)]
    assert encoded(other, texts) == [library.encode_ordinary(t) for t in texts]


def test_appends_and_edits(own, library):
    rng = random.Random(4)
    for _ in range(200):
        text = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randrange(1, 120)))
        table = byte_bpe.Prefixes(own.v)
        for i in range(0, len(text), 7):
            table.append(text[i : i + 7])
        assert table.ids() == library._encode_single_piece(text)
        a = rng.randrange(len(text))
        b = rng.randrange(a, len(text))
        new = bytes(rng.choice(b"ainst") for _ in range(rng.randrange(4)))
        table.replace(a, b, new)
        changed = text[:a] + new + text[b:]
        assert table.text == changed and (not changed or table.ids() == library._encode_single_piece(changed))


def test_edits_are_local(own):
    table = byte_bpe.Prefixes(own.v, b"internationalisation" * 200)
    assert table.replace(10, 11, b"x") < 400


def test_frames(spark, docs, empty, documents, library):
    encoded = byte_bpe.encode(docs, MULTILINGUAL, PATTERN, keep=("lang",))
    rows = byte_bpe.decode(encoded, MULTILINGUAL).collect()
    want = sorted((i, hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), (t or "").encode()) for i, t, *_ in documents)
    assert sorted((r.doc_id, hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded)) for r in rows) == want
    assert byte_bpe.encode(empty, MULTILINGUAL, PATTERN).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a text", b"x", 5, "y")], "doc_id long, text string, ids binary, n_tokens int, decoded string")
    row = byte_bpe.decode(byte_bpe.encode(df, MULTILINGUAL, PATTERN, keep=("ids", "n_tokens", "decoded")), MULTILINGUAL).first()
    assert bytes(row.decoded) == b"a text" and row.n_tokens == len(row.ids) // 4
