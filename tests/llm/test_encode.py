import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import encode


@pytest.fixture(scope="module")
def content():
    with open(encode.vocabulary_path(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(content):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello world, it's 42!",
    "नमस्ते। मुझे 75 मिनट और पानी दीजिए",
    "   \n\n \t x  ",
    "<|endoftext|> 🙏🙏🙏 👩‍💻",
    "a" * 3000,
    "ab" * 2000,
    "".join(chr(0x900 + i % 128) for i in range(2000)),
    "\x00\u0085 é�",
]


def test_equal_to_the_library(content, reference):
    from array import array

    e = encode.Encoder(content)
    rng = random.Random(1)
    more = ["".join(rng.choice("abcde \n'0123कखा्é🙂") for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in TEXTS + more:
        out = array("i")
        e.extend(t, out)
        assert list(out) == reference.encode_ordinary(t)
        assert e.count(t) == len(out)


def test_merges_on_random_bytes(content, reference):
    ranks = encode.parse_ranks(content)
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinst th") for _ in range(rng.randrange(1, 60)))
        want = list(piece[i : i + 1] for i in range(len(piece)))
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            want[best[1] : best[1] + 2] = [want[best[1]] + want[best[1] + 1]]
        assert encode.merge_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else [ranks[w] for w in want])


def test_cache_stays_bounded(content, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_PIECES", 50)
    e = encode.Encoder(content)
    for i in range(500):
        e.count(f"word{i} other{i}")
    assert len(e.known) <= 50


def test_frame(spark, reference):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "", TEXTS[0]])]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit("clash")).withColumn("other", F.lit(1))
    got = {r.doc_id: r for r in encode.encode(df).collect()}
    assert dict(encode.encode(df).dtypes)["ids"] == "array<int>" and len(got) == len(rows)
    for i, t in rows:
        assert got[i].ids == (reference.encode_ordinary(t) if t else []) and got[i].other == 1
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(df).collect()}
    assert counts == {i: len(got[i].ids) for i, _ in rows}
    assert encode.encode(df.limit(0)).count() == 0
