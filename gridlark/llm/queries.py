"""The text operators as registered queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import common
from gridlark.llm.exact_dedup import exact_groups
from gridlark.llm.fingerprint import compare_neighbours
from gridlark.llm.line_dedup import apply_bitmaps, dedup_lines
from gridlark.llm.mixing_lm import score_texts
from gridlark.llm.quality import fit_quality, score_quality
from gridlark.llm.sentencepieces import encode_documents
from gridlark.llm.simhash import near_duplicates
from gridlark.llm.source_mixing import mix_sources
from gridlark.llm.toxicity import fit_toxicity, score_toxicity
from gridlark.llm.training_order import materialise


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place: TOKENIZER_DIR if it is set, else the installed package's."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it, with its place in the order. A null source is one; blank texts have no tokens."""
    mixed = mix_sources(common.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "mix.*")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards' manifest. The shards themselves are in a folder of their own beside the checkpoints."""
    folder = f"{common.shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    return materialise(common.read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), folder).withColumn("folder", F.lit(folder))


def toxicity_categories() -> dict:
    """Categories over `labels` in the chain's order: junk text, toxic text, and text unfit for either reason."""
    junk, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"junk": junk, "toxic": toxic, "unfit": junk | toxic}


def scored_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, output: str = "toxicity") -> DataFrame:
    """docs with the struct `output`, by a chain fitted on their labelled rows."""
    return score_toxicity(docs, fit_toxicity(docs, common.read_table(spark, sf_dir, "labels"), toxicity_categories()), output=output)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's probability, and whether the document stays. Blank texts get the intercepts' probabilities."""
    p = F.col("toxicity")
    scored = scored_toxicity(spark, common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    toxic = p["toxic"] >= 0.5
    return scored.select("doc_id", p["junk"].alias("p_junk"), p["toxic"].alias("p_toxic"), p["unfit"].alias("p_unfit"), toxic.alias("toxic"), (~toxic).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each whole text, learnt where the id's remainder isn't 0. Blank texts get the bias."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = common.read_table(spark, sf_dir, "labels").where(common.remainder("doc_id", 5) != 0)
    scored = score_quality(docs, fit_quality(docs, learnt, F.col("quality")))
    return scored.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids, the decoded text and the spans. Null is empty: begin and end ids."""
    return encode_documents(common.read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), output="digest")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's group of equal texts. Null is empty; a null id is below every other."""
    return exact_groups(common.read_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text, of its edited text, and likeness to that and to the next document."""
    return compare_neighbours(common.read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row. Blank texts have fingerprint zero and link."""
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each text, learnt where the id's remainder isn't 2. Null is empty: one end."""
    return score_texts(common.read_table(spark, sf_dir, "documents"), common.remainder("doc_id", 7) == 2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped, digest of what stays. Null and empty texts are one empty line, which stays."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(dedup_lines(docs))
    return kept.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_training_order": op2_training_order,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fingerprint": op7_fingerprint,
    "op8_simhash": op8_simhash,
    "op9_mixing_lm": op9_mixing_lm,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_line_dedup": """
        WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM texts),
        keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (SELECT key, min(doc_id) AS first FROM keys WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
        told AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id <> s.first AS lost FROM keys k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM told GROUP BY doc_id""",
}
