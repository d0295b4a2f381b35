"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import audit, backoff, bpe, chat, fingerprints, fm, ngram_join, packing, periodic, pii, quality, secrets, sharding
from mosaiq.llm.common import table, text_or_empty
from mosaiq.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Of the pseudonyms; a real run takes its own.
PII_KEY = "corpus-2024"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    names = F.array(*map(F.lit, pii.KINDS))
    count = lambda i: F.size(F.filter("entities", lambda e: e["kind"] == i)).cast("long")
    return masked.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.array_join(F.transform("entities", lambda e: F.concat_ws(":", F.get(names, e["kind"]), e["start"], e["end"])), ",").alias("spans"),
        F.col("masked_text").alias("text"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compared(table(spark, sf_dir, "documents"))
    a, b = F.col("sketch"), F.col("edited_sketch")
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_string(a).alias("fingerprint"),
        fingerprints.as_string(b).alias("edited_fingerprint"),
        # without a hash to compare, nothing speaks for likeness
        F.coalesce(fingerprints.likeness(a, b), F.lit(0.0)).alias("near_edited"),
        F.coalesce(fingerprints.likeness(a, F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
        fingerprints.containment(a, b).alias("contained_in_edited"),
    )


def op4_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.train_and_score(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(more)), in_order=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.span_list(("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.span_list().alias("spans"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = sharding.assign(rows, "doc_id", [1.0] * 24, more=[1.0])
    keys = sharding.assign(docs.select("doc_id"), "doc_id", [1.0] * 24)
    out = sharding.number(rows, keys, "doc_id", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(periodic.planted(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2("runs", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fm.size_class(F.col("text")).alias("size_class"))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    trained = fm.train(docs, labels, metadata=["size_class"])
    out = fm.score(docs, trained, metadata=["size_class"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_fingerprints": op3_fingerprints,
    "op4_backoff": op4_backoff,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
