import random

import pytest

WORDS = "the of and to in for with on by over under river stone light water house green small early late walk talk".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randrange(40))]) for _ in range(n)]
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words)) + "."


@pytest.fixture(scope="session")
def odd_texts() -> list:
    """Rows that each operator must handle: (doc_id, text), with nulls, ties, copies, long and strange texts."""
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [(1, base), (2, base), (3, near), (3, near), (4, None), (5, ""), (6, "one"), (7, " \n\t "), (8, "a b c"), (9, "A b C")]
    rows += [(10, "x" * 3000), (11, prose(rng, 6000)), (12, "日本語 テキスト 🙂 مرحبا y  z\n\n <|endoftext|>"), (None, base), (None, None)]
    rows += [(20 + i, prose(rng, rng.randrange(1, 300))) for i in range(40)]
    rows += [(100 + i, " ".join(words[: 100 + i % 5] + [f"tail{i}"])) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(odd_texts, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns, named as columns that operators make."""
    from pyspark.sql import functions as F

    for c in ("kept", "n_words", "shard", "n", "label", "hash", "entities", "hex_spans", "length", "start", "source", "sketch", "batch"):
        odd = odd.withColumn(c, F.lit("x"))
    return odd
