"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

1. Each text is cut where its content says so (after a break sign followed by one of a few letters), within bounds of
   length. A chunk's key is a 64-bit hash and its length; a document's recipe is the ordered list of its chunks' keys.
2. Chunks are deduplicated by key *and text*, combined before the shuffle: each different chunk moves once, however
   often it occurs. Where two texts share a key, each gets a number of its own. Key and number are the chunk's
   verified identifier: equal for equal chunks only.
3. Documents are equal when their ordered identifier lists are; groups are formed on the lists, so long texts don't move
   again.

Edge cases: null counts as empty text, which is a text like any other; rows without an id form groups too (a null id is
below every other); repeated rows count as rows; a very long text is a long recipe, and only its chunks move; an
empty table gives an empty table; extra columns are ignored. Texts
that are not valid UTF-8 are one chunk, their bytes in hex, kept apart from valid ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import durable, join_groups

#: A chunk has at least LEAST and at most MOST characters; it ends after a blank, or at MOST.
LEAST, MOST = 400, 2000
#: Boundary: a line end or a sentence's end before one of some letters; rare enough for chunks of about a kilobyte.
CHUNK = r"(?s).{%d,%d}?(?:[.!?][ \n](?=[A-EÀ-Üa-c])|\n|$)|.{1,%d}" % (LEAST, MOST - 3, MOST)


def chunks(text: Column) -> Column:
    """The text's chunks in order; joined they give the text."""
    return F.when(F.is_valid_utf8(text), F.regexp_extract_all(text, F.lit(CHUNK), 0)).otherwise(F.array(F.hex(text)))


def chunk_key(chunk: Column, bits: int = 64) -> Column:
    """Hash of the chunk, and its length in bytes."""
    h = F.xxhash64(chunk)
    return F.struct((h if bits == 64 else F.pmod(h, F.lit(1 << bits))).alias("h"), F.octet_length(chunk).alias("n"))


def exact_groups(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, keep_id (largest id of the group), group_size, kept, text_sha256; one row per row of df.

    Rows that share the id that stays are all marked kept, as they can't be told apart by id.
    bits: of the chunk hash; fewer only to test that equal keys of different chunks are told apart."""
    docs = df.select(df[doc_id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    distinct = docs.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(chunk_key(F.col("chunk"), bits).alias("key"), "chunk").distinct()
    shared = durable(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key"))
    nothing = F.array().cast("array<struct<at:int,number:int>>")
    if shared.isEmpty():
        docs = docs.withColumn("numbers", nothing)
    else:
        docs = _with_numbers(docs, distinct, shared)
    keys = F.transform(chunks(F.col("text")), lambda c: chunk_key(c, bits))
    listed = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.is_valid_utf8("text").alias("valid"), keys.alias("keys"), F.coalesce("numbers", nothing).alias("numbers"))
    listed = durable(listed.select("doc_id", "text_sha256", "valid", F.col("keys.h").alias("hashes"), F.col("keys.n").alias("lengths"), "numbers"))
    recipe = ["valid", "hashes", "lengths", "numbers"]
    groups = durable(listed.groupBy(*recipe).agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("largest")).where("size > 1"))
    # Only groups of several rows are joined back; a huge one is dealt over tasks.
    each = join_groups(listed, groups, groups.withColumnRenamed("size", "n"), recipe)
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return each.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _with_numbers(docs: DataFrame, distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """docs with `numbers`: at which places a chunk's key is shared by different texts, and which of them it is.

    Keys are shared by chance alone, so a key has few texts, whatever the table's size."""
    numbered = distinct.join(shared, "key", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("chunk")))
    rows = durable(docs.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).join(numbered, "chunk")
    return rows.join(each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("numbers")), "row", "left").drop("row")
