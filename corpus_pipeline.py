"""A corpus pipeline in stages: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
sources are mixed to their weights, and what is left is encoded. Each stage works on what its predecessor kept.

Edge cases, in every stage: a null or empty text is a document like any other (not toxic unless the fit's intercept says
so; one empty line; a near copy of other blank texts; no tokens to mix; begin and end ids alone). A null id stays null and
comes after every other. Repeated rows are judged alike, and the near-duplicate stage keeps one of them. A null source is a
source of its own. Very long texts are read whole, one by one. Extra columns pass through all stages but the last, whatever
their names. An empty table stays empty; without labels no document is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from gridlark.llm import common, queries
from gridlark.llm.line_dedup import apply_bitmaps, dedup_lines
from gridlark.llm.near_copies import near_copies
from gridlark.llm.sentencepieces import encode_documents
from gridlark.llm.source_mixing import mix_sources
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the category `toxic` is below one half."""
    return queries.scored_toxicity(spark, docs, sf_dir, "__toxicity").where("__toxicity.toxic < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; texts and n_chars follow."""
    kept = apply_bitmaps(dedup_lines(docs, output="__bitmap"), bitmap="__bitmap", output="__kept")
    return kept.withColumns({"text": F.col("__kept.text"), "n_chars": F.length("__kept.text").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near copies (five words, similarity 0.8) link: the one with the smallest id, and of rows
    with that id the one with the smallest hash of its text. Rows without an id come last. Of repeated rows one stays."""
    found = common.durable(near_copies(docs).select("doc_id", "text_key", "kept"))
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    told = lambda keys: keyed["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (keyed["__key"] == keys["text_key"])
    gone = found.where("not kept").select("doc_id", "text_key").distinct()
    again = common.durable(found.where("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rest = keyed.join(gone, told(gone), "left_anti")
    if not again.isEmpty():
        once = keyed.join(again, told(again), "left_semi").dropDuplicates(["doc_id", "__key"])
        rest = rest.join(again, told(again), "left_anti").unionByName(once)
    return rest.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them: each at least once, none over twice."""
    return mix_sources(docs, output="__mix").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens and digests of the ids and of the decoded text."""
    return encode_documents(docs, queries.tokenizer_path("piece_bpe_32k.model"), output="digest")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: Fingerprints, keyed hashes and learnt models are beyond SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage keeps is written to the shared checkpoint folder and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.durable(docs)
    return docs
