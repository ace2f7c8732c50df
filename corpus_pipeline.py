"""A corpus pipeline of five stages, each written as Parquet and read again.

Each stage takes what the one before has kept; all but the last return the
columns of ``documents``.  ``ORACLE_SQL`` is None, as SQL cannot encode by merges;
the tests hold ``run`` against a brute-force version.

Rows with a null id pass the stages that compare documents.  Null and empty texts
are rejected by the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontaminate as decon
from treeline.llm import quality_rules as rules
from treeline.llm.bpe_codec import encode_decode
from treeline.llm.common import materialize
from treeline.llm.line_dedup import line_dedup
from treeline.llm.minhash import near_duplicates
from treeline.llm.queries import VOCABULARY, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return rules.ledger(rows, id_col="doc").filter(~rules.failed(rules.DEFAULT)).select("doc.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; ``n_chars`` follows."""
    out = line_dedup(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c in new or c != "text"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, linked at a similarity of 0.8 or more: that with the smallest id.

    Rows that repeat an id and text are one document too; of their other columns the least values stay.
    """
    found = near_duplicates(docs, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = left.join(again, "doc_id").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("rest"))
    once = once.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of the benchmark; items shorter than one count by their share of the words."""
    found = decon.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = (F.col("n_whole") > 0) | decon.contaminated(F.col("n_hit"), F.col("n_words"))
    gone = found.filter(hit).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)"""
    out = encode_decode(docs, VOCABULARY)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
