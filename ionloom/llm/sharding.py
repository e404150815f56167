"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into source partitions by a hash. How many rows each partition sends to each shard is drawn exactly:
a partition's row of the matrix is a multivariate hypergeometric draw from what the shards still lack, one
hypergeometric number after the other. Each partition then permutes
its rows and deals them out by its row of the matrix, and every shard permutes what it got. All of it is
DataFrame functions; the draws are folds over arrays, first over groups of partitions and then, for all groups
at once, over the partitions of a group.

Law `rows`: shard sizes differ by one row at most. Random numbers are hashes of the seed, so a lost task gives
the same rows again. A null text has size 8; repeated rows are dealt like any others, and rows that are equal
in every column are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.llm.common import documents, text_or_empty

#: Rows that one task permutes.
PARTITION_ROWS = 200_000
SHARDS = 24


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1), the same for the same parts."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))


def _stirling(k: Column) -> Column:
    """ln k! without its leading terms (k + 1/2) ln k - k + ln sqrt(2 pi), for k of 16 and more."""
    return 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)


def _log_factorial(k: Column) -> Column:
    small = F.log(F.factorial(F.least(k, F.lit(16)).cast("int")).cast("double"))
    x = k.cast("double")
    return F.when(k <= 16, small).otherwise((x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + _stirling(x))


def _log_factorial_ratio(a: Column, b: Column) -> Column:
    """ln a! - ln b!, for large numbers from their difference, so that it keeps its digits."""
    x, y = a.cast("double"), b.cast("double")
    far = (y - x) * (1 - F.log(y)) - (x + 0.5) * F.log1p((y - x) / x) + _stirling(x) - _stirling(y)
    return F.when((a < 16) | (b < 16), _log_factorial(a) - _log_factorial(b)).otherwise(far)


def hypergeometric(total: Column, marked: Column, drawn: Column, *key: Column | int) -> Column:
    """How many marked ones are among `drawn` of `total`; `key` names the draw's random numbers.

    Ratio-of-uniforms rejection (Stadlober 1989): a trial takes about a constant time at any size, and two
    of three trials are accepted. Trials end with the first success; that 200 fail never happens in practice,
    and the mode would stand in. The smaller half of both margins is drawn, the rest follows.
    """
    few, many = F.least(marked, total - marked), F.greatest(marked, total - marked)
    m = F.least(drawn, total - drawn)
    share = few / F.greatest(total, F.lit(1))
    centre = m * share + 0.5
    spread = F.sqrt((total - m) * (m * share * (1 - share)) / F.greatest(total - 1, F.lit(1)) + 0.5)
    width = F.lit(2 * math.sqrt(2 / math.e)) * spread + F.lit(3 - 2 * math.sqrt(3 / math.e))
    mode = F.floor((m + 1).cast("double") * (few + 1) / (total + 2)).cast("long")
    fixed = F.struct(few.alias("few"), many.alias("many"), m.alias("m"), centre.alias("centre"), width.alias("width"), mode.alias("mode"))

    def trial(c: Column, i: Column) -> Column:
        x = 1 - _uniform(*key, i, 0)
        z = F.floor(c["centre"] + c["width"] * (_uniform(*key, i, 1) - 0.5) / x).cast("long")

        def accepted(t: Column) -> Column:
            z = t["z"]
            log_ratio = (
                _log_factorial_ratio(c["mode"], z) + _log_factorial_ratio(c["few"] - c["mode"], c["few"] - z)
                + _log_factorial_ratio(c["m"] - c["mode"], c["m"] - z) + _log_factorial_ratio(c["many"] - c["m"] + c["mode"], c["many"] - c["m"] + z)
            )
            return F.when((z >= 0) & (z <= F.least(c["m"], c["few"])) & (2 * F.log(t["x"]) <= log_ratio), z)

        return F.transform(F.array(F.struct(x.alias("x"), z.alias("z"))), accepted)[0]

    def settle(c: Column) -> Column:
        found = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(None).cast("long"), lambda s, i: F.when(s.isNotNull(), s).otherwise(trial(c, i)))
        return F.when((c["m"] == 0) | (c["few"] == 0), F.lit(0).cast("long")).otherwise(F.coalesce(found, F.raise_error(F.lit("no draw was accepted")).cast("long")))

    z = F.transform(F.array(fixed), settle)[0]
    z = F.when(marked > total - marked, m - z).otherwise(z)  # of the many instead of the few
    return F.when(drawn > total - drawn, marked - z).otherwise(z)


def _row(lacking: Column, rows: Column, seed: int, label: Column) -> Column:
    """How many of `rows` go to each shard, of which `lacking` says how many it still takes."""
    state = F.struct(
        F.array().cast("array<bigint>").alias("out"), rows.cast("long").alias("rows"),
        F.aggregate(lacking, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )

    def draw(s: Column, x: Column) -> Column:
        # The number is made by a map over one struct, so that it is worked out once.
        numbers = F.transform(F.array(s), lambda t: hypergeometric(t["total"], x, t["rows"], seed, label, F.size(t["out"])))
        return F.transform(numbers, lambda n: F.struct(F.concat(s["out"], F.array(n)).alias("out"), (s["rows"] - n).alias("rows"), (s["total"] - x).alias("total")))[0]

    return F.aggregate(lacking, state, draw, lambda s: s["out"])


def _fold(parts: Column, lacking: Column, seed: int) -> Column:
    """Rows of the matrix for `parts`, an array of (id, n), drawn one after the other."""
    state = F.struct(F.array().cast("array<struct<id:bigint,n:bigint,lacking:array<bigint>,sends:array<bigint>>>").alias("out"), lacking.alias("lacking"))

    def draw(s: Column, part: Column) -> Column:
        rows = F.transform(F.array(part), lambda p: _row(s["lacking"], p["n"], seed, p["id"]))

        def add(sends: Column) -> Column:
            own = F.struct(part["id"].alias("id"), part["n"].alias("n"), s["lacking"].alias("lacking"), sends.alias("sends"))
            return F.struct(F.concat(s["out"], F.array(own)).alias("out"), F.zip_with(s["lacking"], sends, lambda a, b: a - b).alias("lacking"))

        return F.transform(rows, add)[0]

    return F.aggregate(parts, state, draw, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(part, sends) for `sizes` (part, n): how many of the n rows of a part go to each shard.

    Shard s takes a share of the total that differs from the others' by one row at most.
    """
    group = F.floor(F.sqrt(F.col("part").cast("double"))).cast("long")  # the parts of a group grow with the number of groups
    groups = sizes.groupBy(group.alias("id")).agg(F.sum("n").cast("long").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("part").cast("long").alias("id"), F.col("n").cast("long").alias("n")))).alias("parts"))
    whole = groups.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("id", "n"))).alias("groups"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards).cast("long") + (s < F.col("total") % shards).cast("long"))
    coarse = whole.where("total > 0").select(F.explode(_fold(F.col("groups"), wanted, seed)).alias("g"))
    # What a group sends to each shard is what its parts still have to fill.
    fine = groups.join(coarse.select(F.col("g.id").alias("id"), F.col("g.sends").alias("sends")), "id")
    drawn = fine.select(F.explode(_fold(F.col("parts"), F.col("sends"), seed + 1)).alias("p"))
    return drawn.select(F.col("p.id").alias("part"), F.col("p.sends").alias("sends"))


def shard(rows: DataFrame, key: list[str], shards: int = SHARDS, seed: int = 0, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """`rows` with shard and slot (gapless from 0 in each shard): a uniform shuffle with exact shard sizes.

    `key`: columns that tell rows apart; rows that agree in them are interchangeable. Columns of the input
    named shard or slot are replaced.
    """
    parts = max(1, math.ceil(rows.count() / partition_rows))
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), F.struct(*key).alias("key"))
    spread = keyed.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(parts)).cast("long"))
    matrix = communication_matrix(spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    ends = F.aggregate("sends", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    matrix = matrix.select("part", ends.alias("ends"))

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 2), "key"), "key")
    dealt = spread.withColumn("_rank", F.row_number().over(local)).join(matrix, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("_rank"))).cast("int"))

    # In a shard: by a random number, first roughly into blocks of bounded size, then exactly within each.
    blocks = max(1, math.ceil(parts / shards))
    dealt = dealt.withColumn("_at", _uniform(seed + 3, F.col("part"), F.col("_rank")))
    dealt = dealt.withColumn("_block", F.floor(F.col("_at") * blocks).cast("int"))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_at", "part", "_rank")) - 1
    dealt = dealt.withColumn("_within", within.cast("long"))
    if blocks == 1:
        return dealt.select("row.*", "shard", F.col("_within").alias("slot"))
    sizes = dealt.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(sizes, ["shard", "_block"]).select("row.*", "shard", (F.col("_before") + F.col("_within")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dealt = shard(rows, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
