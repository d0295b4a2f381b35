import base64
import hashlib
import random
import string
import time

import public_tokenizers as P
import pytest
import tiktoken

from mosaiq.llm import bpe
from mosaiq.llm.queries import op1_bpe


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def vocabulary(request):
    path = P.path(request.param)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library(vocabulary, odd_texts):
    path, library = vocabulary
    own = bpe.load(path, P.PATTERN)
    texts = [t or "" for _, t in odd_texts] + ["a  b \n c\t\td ", "  lead", "it's we'll 1234567", "\u00a0\u2003x", "ééé" * 50, "\ud7ff\U0010ffff"]
    out = own.encode_batch(texts)
    for t, (ids, text) in zip(texts, out, strict=True):
        wanted = library.encode_ordinary(t)
        assert ids.tolist() == wanted and text == " ".join(map(str, wanted))
    assert own.decode_batch([ids for ids, _ in out]) == [t.encode() for t in texts]


def test_long_words(vocabulary):
    path, library = vocabulary
    own, rng = bpe.load(path, P.PATTERN), random.Random(2)
    letters = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    han = [chr(c) for c in range(0x4E00, 0x9FA5)]
    texts = ["a" * 5001, "ab" * 2500 + "a", "aab" * 1500, "banana" * 800, "=" * 3000, letters("ab", 4000), letters("etaoin", 4000), letters(string.ascii_lowercase, 4000), letters(string.ascii_letters, 4000), letters(han, 1500)]
    for text, (ids, _) in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
    huge = [letters(string.ascii_lowercase, 200_000), letters(string.ascii_letters + string.digits, 200_000), letters(han, 50_000), "a" * 200_000]
    began = time.time()
    coded = own.encode_batch(huge)
    assert own.decode_batch([ids for ids, _ in coded]) == [t.encode() for t in huge]
    assert time.time() - began < 60


def test_long_words_of_real_letters(vocabulary):
    """Common words without spaces, and other sequences whose encoding reaches far over any cut."""
    path, library = vocabulary
    own, rng = bpe.load(path, P.PATTERN), random.Random(3)
    common = "the house and water under light with people from state nation general information because through different government international development".split()
    run = lambda n, words=common: "".join(rng.choices(words, k=n))
    texts = [run(k) for k in (8, 30, 200, 700)] + [run(900, ["an", "na", "ban", "ana"]), run(800, ["ing", "in", "g", "ting"]), run(1500, ["a", "b", "ab", "aa"]), run(900, ["é", "ée", "e", "née"]), "the" * 3000, "ation" * 2000]
    for text, (ids, _) in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
    began = time.time()
    text = run(32_000)
    assert len(text) > 200_000
    assert own.encode_batch([text])[0][0].tolist() == library.encode_ordinary(text)
    assert time.time() - began < 60


def test_groups_and_forgetting(monkeypatch, odd_texts):
    monkeypatch.setattr(bpe, "WORD_BYTES", 50)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 100)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 20)
    monkeypatch.setattr(bpe, "KNOWN_UNITS", 30)
    own = bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [t or "" for _, t in odd_texts][:30]
    out = [own.encode_batch([t])[0] for t in texts]
    assert own.decode_batch([ids for ids, _ in out]) == [t.encode() for t in texts]
    assert [i.tolist() for i, _ in out] == [i.tolist() for i, _ in bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_batch(texts)]


def test_query(spark, sf, vocabulary):
    path, library = vocabulary
    if "multi" in path:
        return
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(" ".join(map(str, ids)).encode())
        assert r.decoded_sha256 == digest(texts[r.doc_id].encode())


def test_frames(odd, odd_texts, none, clash):
    path = P.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(odd, path, P.PATTERN, ["doc_id", "text"])
    back = bpe.decode(coded, path, P.PATTERN, ["text"]).collect()
    assert len(back) == len(odd_texts) and all(bytes(r.bytes) == (r.text or "").encode() for r in back)
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0
    assert bpe.round_trip(clash, path, P.PATTERN).count() == len(odd_texts)
