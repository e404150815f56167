"""Shared pieces of the training-data operators: inputs, written intermediate tables, salted joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task may receive before the key is dealt over several tasks: a two-hundredth of all
#: rows, at least LEAST_ROWS and at most BLOCK_ROWS; beyond HEAVY_KEYS such keys the blocks get larger.
LEAST_ROWS, BLOCK_ROWS, HEAVY_KEYS = 10_000, 1_000_000, 100_000

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; only a purely local session may have one made for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ionloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ionloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def heavy_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key, _parts) of the keys with more than a block of rows, HEAVY_KEYS at most.

    `counts` has the key and its row count `n`. None when no key can be that heavy.
    """
    block = max(total // HEAVY_KEYS, min(BLOCK_ROWS, max(LEAST_ROWS, total // 200)))
    if total <= block:
        return None
    return counts.where(F.col("n") > block).select(key, F.ceil(F.col("n") / F.lit(block)).cast("int").alias("_parts"))


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str, heavy: DataFrame | None, salt: Column) -> DataFrame:
    """`rows` joined with `table` on `key`; heavy keys are dealt over `_parts` tasks by the hash `salt`.

    The list of heavy keys is small by construction (see `heavy_keys`) and is broadcast; the table is not, at any size.
    """
    if heavy is None:
        return rows.join(table.hint("shuffle_hash"), key, how)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(salt, parts).cast("int")).drop("_parts")
    copies = table.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies.drop("_parts").hint("shuffle_hash"), [key, "_salt"], how).drop("_salt")


def sealed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that names an operator uses meet none of the input's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("string")).alias("_rest"))


def unsealed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The `columns` that `sealed` put away, in their order."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in columns])


_CACHES: dict[str, Callable[[], None]] = {}


def claim_caches(owner: str, clear: Callable[[], None]) -> None:
    """Says in a task which operator uses this Python worker's caches; those of others are emptied.

    Workers are kept from stage to stage, so without this they would hold what every operator of a pipeline remembers.
    """
    for other, empty in _CACHES.items():
        if other != owner:
            empty()
    _CACHES[owner] = clear


def text_slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(low, high - low)
        low = high
