"""Texts with thousands of matches, in time that grows with them."""

import re
import time

from pyspark.sql import functions as F

from mosaiq.llm import pii, secrets, spans


def test_places_of_many_matches(spark):
    pattern = "[0-9]+x"
    for text in ("", "none", "1x", "é1x 22x🙂333x", "ab ".join(f"{i}x" for i in range(9000))):
        row = spark.createDataFrame([(text,)], "t string").select(spans.located(F.col("t"), spans.matches(F.col("t"), pattern), pattern).alias("s")).first()
        assert [tuple(s) for s in row.s] == [(*m.span(), m[0]) for m in re.finditer(pattern, text)]


def test_long_lists(spark):
    many = 3000
    mails = " ".join(f"user{i}@example.com and" for i in range(many))
    began = time.time()
    row = pii.mask(spark.createDataFrame([(1, mails)], "doc_id long, text string"), "k").first()
    assert len(row.entities) == many and row.masked_text.count("@example.invalid and") == many
    keys = " ".join(f"{i:08x}{i * 7919:032x} and" for i in range(many))
    row = secrets.redact(spark.createDataFrame([(1, keys)], "doc_id long, text string")).first()
    assert row.text == " ".join(["[secret] and"] * many)
    assert time.time() - began < 90
