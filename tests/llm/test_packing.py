import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from mosaiq.llm import packing

PATH = P.path("byte_bpe_50k.json")


def verify(rows, texts):
    """rows: packed pieces; texts: (doc_id, text), ids distinct."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {d for d, _ in texts}
    for d, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
    total = pad = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else 1024 - at)
    return pad / (pad + total) if total else 0.0


def test_query(spark, sf):
    from mosaiq.llm.queries import op6_packing

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op6_packing(spark, sf).collect()
    assert verify(rows, texts) < 0.02
    balanced(rows)


def balanced(rows):
    """Groups of one context differ by at most one sequence, and by at most one context in tokens."""
    tokens, sequences = defaultdict(Counter), defaultdict(set)
    for r in rows:
        tokens[r.context][r.step_group] += r.length
        sequences[r.context, r.step_group].add(r.sequence_id)
    for context, groups in tokens.items():
        many = [len(sequences[context, g]) for g in groups]
        assert sorted(groups) == list(range(len(groups))) and max(many) - min(many) <= 1
        assert max(groups.values()) - min(groups.values()) <= context
    return tokens


def test_step_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens = balanced(packing.pack(docs, PATH, sequences_per_step=7).collect())
    assert len(tokens[1024]) > 5


def test_odd_rows(spark, odd_texts, none, clash):
    texts = [(i, t) for i, (_, t) in enumerate(odd_texts)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    verify(packing.pack(docs, PATH).collect(), texts)
    assert packing.pack(none, PATH).count() == 0
    out = packing.pack(clash, PATH).collect()  # ids repeat: every row is packed
    assert sum(r.start == 0 for r in out) == len(odd_texts)


def test_plan_places_every_piece_once():
    rng = random.Random(4)
    for _ in range(200):
        histogram = {rng.randrange(1, 1025): rng.randrange(1, 40) for _ in range(rng.randrange(1, 120))}
        windows = packing.plan(histogram)
        placed = Counter()
        for w in windows:
            assert w.count > 0 and sum(w.lengths) <= w.tier and (w.tier == 1024 or sum(w.lengths) == w.tier)
            for n in w.lengths:
                placed[n] += w.count
        assert placed == Counter(histogram)
        ranks = {}
        for n, lo, hi, *_ in packing.places(windows):
            assert lo == ranks.get(n, 0)
            ranks[n] = hi + 1
        assert ranks == histogram


def test_many_documents_of_one_length(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same words for all' AS text")
    rows = packing.pack(docs, PATH).collect()
    assert verify(rows, [(i, "the same words for all") for i in range(3000)]) < 0.05


def test_stretches_are_encoded_many_at_a_time():
    t = packing.Tokens(PATH)
    given, encoded = t.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            encoded.extend(texts)
            return given.encode_batch_fast(texts, **options)

    t.tokenizer = Counting()
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words), "tail Ġx  y z\n", "a　 b c", " lead", "", " ", "x ", "don't\tstop ĠĠ </s> 한글 é", "p.\n\nQ \x1cr s\x1c t\x1c"]
    found = t.ids(texts)
    assert [x.tolist() for x in found] == [given.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(encoded) < 100
