import base64
import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pytest
import tiktoken

from baitline.llm import bpe
from baitline.llm.queries import RANKS, bpe_round_trip

PATH = P.path(RANKS)


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_equals_library(known):
    rng = random.Random(3)
    codec = bpe.Codec.of(open(PATH, "rb").read(), P.PATTERN)
    alphabet = ["a", "b", "e", "n", "th", "er", " ", "  ", "\n", "é", "ß", "漢", "😀", "1", "22", "'s", "#", " "]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 60)))
        ids = codec.encode(text)
        assert ids == known.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["", "a", "ab", "aaa", "x" * 30_000, " " * 5_000, "ab" * 9_000, "<|endoftext|>"])
def test_long_and_plain_pieces(known, text):
    codec = bpe.Codec.of(open(PATH, "rb").read(), P.PATTERN)
    assert codec.encode(text) == known.encode_ordinary(text)


def _expected(known, text):
    ids = known.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_table(docs, corpus, known):
    got = bpe.digests(docs, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == \
        sorted((i, *_expected(known, t)) for i, t in corpus)


def test_columns_and_empty(wide, docs):
    out = bpe.digests(wide, PATH, P.PATTERN)
    assert set(wide.columns) <= set(out.columns) and out.count() == wide.count()
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_ids_and_bytes(docs):
    both = docs.select("text", bpe.encode(docs.text, PATH, P.PATTERN).alias("ids"))
    back = both.select("text", bpe.decode(both.ids, PATH, P.PATTERN).alias("b")).collect()
    assert all(bytes(r.b).decode() == (r.text or "") for r in back)


def test_query(spark, sf, known):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe_round_trip(spark, sf).collect()
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == _expected(known, texts[r.doc_id]) for r in got)


def test_memory_of_kept_pieces_and_long_texts(known):
    """A kept piece takes little, and a long text is not held as all of its pieces."""
    rng = random.Random(7)
    codec = bpe.Codec(bpe.read_ranks(open(PATH, "rb").read()), P.PATTERN)
    text = " ".join("".join(rng.choices("abcdefghij", k=10)) for _ in range(20_000))
    tracemalloc.start()
    try:
        codec.encode(text)
        assert len(codec.known) > 19_000
        assert tracemalloc.get_traced_memory()[0] < 230 * len(codec.known)
        long = text * 12
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        got = codec.digests(long)
        assert tracemalloc.get_traced_memory()[1] - held < 4 * len(long)
    finally:
        tracemalloc.stop()
    assert len(long) > bpe.LONG and got == _expected(known, long)
    assert codec.digests("") == _expected(known, "")
