"""Helpers shared by the text operators: words, batches, splits and durable intermediate results."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and that are stripped from lines.
BLANKS = b" \t\n\x0b\x0c\r"
#: A worker takes a batch apart into blocks of about so many bytes of text, so memory doesn't follow the batch.
BLOCK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered. bytes.lower and bytes.split know only ASCII, as is wanted."""
    return (text or "").encode("utf-8", "replace").lower().split()


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset (a local run) is one made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.getConf().get("spark.checkpoint.dir") or sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder: computed once, and safe against lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The same rows over one physical plan: what reads them again takes up at the plan's last shuffle, whose files are kept,
    without a copy of the rows. Files of a lost executor are made again from the source, so the rows must not depend on
    the run."""
    spark, plan = df.sparkSession, df._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), spark)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows into blocks of about `most` bytes of text (a longer text is a block of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        block = np.cumsum(sizes) // most
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def release() -> None:
    """This process's free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last the worker's free memory goes back to the system, as the worker is kept for later tasks."""
    try:
        yield from batches
    finally:
        release()


class Memo(dict):
    """A dict that makes missing values with `make` and starts anew at `most` entries; what is made of a key longer than
    LONG_KEY isn't kept. So its memory is bounded.

    What is made depends on the key alone: forgetting changes the time taken, never a result."""

    LONG_KEY = 400

    def __init__(self, make: Callable, most: int = 600_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(key) > self.LONG_KEY:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: A group of more rows than this, or than this share of all rows, is dealt over parts when its rows are joined to it.
PART_ROWS, PART_SHARE = 50_000, 5_000


def join_groups(rows: DataFrame, groups: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """rows, left joined with their groups. A large group is repeated once a part and its rows are dealt over the parts
    in turn, so it doesn't meet in one task; all other groups are joined as they are.

    rows: a durable table, as its rows are dealt by their places. sizes: the keys and n, the group's number of rows, durable. What is broadcast is a hash and a
    number for each large group, of which there are at most PART_SHARE."""
    most = max(PART_ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // PART_SHARE)
    large = F.broadcast(sizes.where(F.col("n") > most).groupBy(F.xxhash64(*keys).alias("__hash")).agg(F.ceil(F.max("n") / most).cast("int").alias("__parts")))
    told = lambda df: df.withColumn("__hash", F.xxhash64(*keys)).join(large, "__hash", "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop("__hash")
    left = told(rows).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts")).cast("int")).drop("__parts")
    right = told(groups).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], "left").drop("__part")


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[Column], rows: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and the label columns of at most `rows` labelled documents, chosen by a hash of the id.

    `rows` bounds what is broadcast and what a fit may gather. Rows without an id or with a null label are left out: they
    say nothing. Of several labels of a document the largest counts."""
    named = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), *columns)
    names = [c for c in named.columns if c != "doc_id"]
    named = named.dropna(subset=names)
    chosen = named.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(chosen), "doc_id")
