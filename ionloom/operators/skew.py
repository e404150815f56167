"""Equi-join that keeps hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import cut_lineage

BLOCK_ROWS = 1_000_000
HEAVY_KEYS = 100_000
#: Beyond this number of `rows` Spark does not get to broadcast either side: it takes a compressed file for the size of all that is made of it.
MERGE_ROWS = 100_000


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", total: int | None = None, block: int | None = None
) -> DataFrame:
    """`rows` joined with `table`, which has at most a few rows per key.

    Keys with more than a block of `rows` are split into blocks by a hash of the row, and their rows of
    `table` are repeated once per block. A key can only be that heavy if all rows exceed a block, so
    small inputs cost one count. Blocks grow with the input, so that there are at most `HEAVY_KEYS`
    heavy keys and their list is safe to broadcast. `how`: inner, left, left_semi or left_anti.
    """
    total = rows.count() if total is None else total
    rows = rows.hint("merge") if total > MERGE_ROWS else rows
    block = max(BLOCK_ROWS if block is None else block, total // HEAVY_KEYS)
    if total <= block:
        return rows.join(table, keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    heavy = cut_lineage(counts.select(*keys, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_parts")))
    if heavy.isEmpty():
        return rows.join(table, keys, how)
    some_null = F.lit(False)
    for key in keys:
        some_null = some_null | F.col(key).isNull()
    missing, rows = rows.where(some_null), rows.where(~some_null)  # they match nothing, and would all go to one task
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")
    )
    repeated = table.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    joined = salted.drop("_parts").hint("merge").join(repeated.drop("_parts"), [*keys, "_salt"], how).drop("_salt")
    return joined.unionByName(missing, allowMissingColumns=True) if how in ("left", "left_anti") else joined
