"""The contract queries: each reads its whole table through its operator."""

from __future__ import annotations

import hashlib
import warnings

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decon
from . import chat_format, pii, quality_rules, secret_scan, warc
from .bpe_codec import encode_decode
from .common import new_path, tidy
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .token_counts import token_counts

PII_KEY, PUBLIC_KEY = "spark.treeline.pii.key", "a public example key"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decon.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), decon.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY, limit=512)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def _digest_chats(batches):
    for b in batches:
        rows = []
        for conv, text, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            turns = chat_format.read_back(text)
            loss = "".join(chat_format.unescape(text[m["start"] : m["end"]]) for m in mask)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rows = rows.union(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_trees(chat_format.from_turns(rows)).select("tree", "formatted", "loss_mask")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return out.mapInArrow(tidy(_digest_chats), schema)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=85)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    out = warc.reconstruct(warc.read_archive(spark, path))
    return out.select(F.col("id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base, policy = quality_rules.BASE, quality_rules.DEFAULT
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.failed(base).alias("base_failed"), (~quality_rules.failed(policy)).alias("kept"), "failed_bits",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting ``spark.treeline.pii.key``; where it is unset, a public one that hides nothing from who knows it."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        warnings.warn(f"{PII_KEY} is unset: pseudonyms are made with a public key", stacklevel=2)
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), key=key or PUBLIC_KEY)
    counts = [_count(k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), *counts)


def _count(kind: str):
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_counts, op3_line_dedup, op4_bpe_codec, op5_secret_scan,
        op6_chat_format, op7_minhash_near_dedup, op8_warc, op9_quality_rules, op10_pii,
    )
}
