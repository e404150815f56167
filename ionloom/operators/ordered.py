"""Order-dependent scans that stay balanced whatever the distribution of the values.

Groups proven small by a count use a plain window. Otherwise rows are range-partitioned on the
sort columns, each partition is scanned on its own, and a table with one row per partition carries
the state across the borders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.session import cut_lineage

GROUP_ROWS = 100_000


def _small_groups(df: DataFrame, keys: list[str], limit: int) -> bool:
    total = df.count()
    if total <= limit or not keys:
        return total <= limit
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= limit


def _range_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the number of their range partition, fixed by a checkpoint."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], group_rows: int | None = None
) -> DataFrame:
    """Adds prev_<column>: the value on the row before, by `order` within `keys` (NULL on the first).

    `order` must make rows unique within a group.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    if _small_groups(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    chunked = _range_chunks(df, [*keys, *order])
    carried = list(dict.fromkeys([*keys, *columns]))
    row = F.struct(*[F.col(c) for c in carried])
    rank = F.struct(*[F.col(c) for c in [*keys, *order]])
    w = Window.partitionBy("_chunk").orderBy(*keys, *order)
    scanned = chunked.withColumn("_prev", F.lag(row).over(w)).withColumn("_rn", F.row_number().over(w))
    last = chunked.groupBy("_chunk").agg(F.max_by(row, rank).alias("_last"))
    across = Window.orderBy("_chunk")
    entry = last.select("_chunk", F.lag("_last").over(across).alias("_entry"))
    filled = scanned.join(F.broadcast(entry), "_chunk", "left").withColumn(
        "_prev", F.when(F.col("_rn") == 1, F.col("_entry")).otherwise(F.col("_prev"))
    )
    same = F.col("_prev").isNotNull()
    for k in keys:
        same = same & F.col(f"_prev.{k}").eqNullSafe(F.col(k))
    return filled.withColumns({f"prev_{c}": F.when(same, F.col(f"_prev.{c}")) for c in columns}).drop(
        "_chunk", "_prev", "_rn", "_entry"
    )


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str, group_rows: int | None = None
) -> DataFrame:
    """Adds `name`: the sum of `amount` up to and including the row, by `order` within `keys`."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    df = df.withColumn("_amount", amount)
    if _small_groups(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum("_amount").over(w)).drop("_amount")
    chunked = _range_chunks(df, [*keys, *order])
    within = (
        Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = chunked.withColumn("_part", F.sum("_amount").over(within))
    # Only the group that is open at the end of a partition can reach into the next one.
    parts = chunked.groupBy("_chunk", *keys).agg(F.sum("_amount").alias("_total"))
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(1)
    edge = parts.groupBy("_chunk").agg(
        F.max_by(F.struct(group.alias("g"), F.col("_total").alias("t")), group).alias("_tail"),
        F.min(group).alias("_head"),
        F.count(F.lit(1)).alias("_groups"),
    )
    # One row per partition: a run of partitions sharing one open group adds up.
    across = Window.orderBy("_chunk")
    edge = edge.withColumn("_fresh", F.coalesce(F.lag("_tail.g").over(across) != F.col("_tail.g"), F.lit(True)) | (F.col("_groups") > 1))
    edge = edge.withColumn("_run", F.sum(F.col("_fresh").cast("int")).over(across))
    edge = edge.withColumn("_open", F.sum("_tail.t").over(Window.partitionBy("_run").orderBy("_chunk")))
    entry = edge.select(
        "_chunk", F.lag("_tail.g").over(across).alias("_entry_group"), F.lag("_open").over(across).alias("_entry_sum")
    )
    joined = scanned.join(F.broadcast(entry), "_chunk", "left")
    carries = F.col("_entry_group").eqNullSafe(group)
    total = F.col("_part") + F.when(carries, F.coalesce(F.col("_entry_sum"), F.lit(0))).otherwise(F.lit(0))
    return joined.withColumn(name, total).drop("_chunk", "_part", "_amount", "_entry_group", "_entry_sum")


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str, group_rows: int | None = None) -> DataFrame:
    """Row numbers from 1 by `order` within `keys`."""
    return with_running_sum(df, keys, order, F.lit(1), name, group_rows)


def neighbours(
    points: DataFrame, probes: DataFrame, keys: list[str], point: str, target: str, strict: bool, group_rows: int | None = None
) -> DataFrame:
    """Probe rows with `below` (largest point <= target) and `above` (smallest point >= target).

    With `strict` only `above` is meaningful: the smallest point > target. Works on the merged order
    of both inputs, so no probe meets more than two points.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    extra = [c for c in probes.columns if c not in keys and c != target]
    payload = F.struct(*[F.col(c) for c in [target, *extra]])
    point_rows = points.select(*keys, F.col(point).alias("_v"), F.lit(0 if strict else 1).alias("_side"),
                               F.col(point).alias("_point")).distinct()
    probe_rows = probes.select(*keys, F.col(target).alias("_v"), F.lit(1 if strict else 0).alias("_side"),
                               payload.alias("_probe"))
    merged = point_rows.unionByName(probe_rows, allowMissingColumns=True)
    # At equal value a probe sorts after the points when strict, before them otherwise.
    if _small_groups(merged, keys, limit):
        chunked, scope = merged, keys
        entry = None
    else:
        chunked = _range_chunks(merged, [*keys, "_v"])
        scope = [*keys, "_chunk"]
        edge = chunked.where("_point IS NOT NULL").groupBy(*keys, "_chunk").agg(
            F.min("_point").alias("_lo"), F.max("_point").alias("_hi")
        )
        # At most (#partitions + #groups) rows, so it is joined, not broadcast, when there are keys.
        edge = chunked.select(*keys, "_chunk").distinct().join(edge, [*keys, "_chunk"], "left")
        up, down = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
        entry = edge.select(
            *keys,
            "_chunk",
            F.last("_hi", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.last("_lo", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
        )
    # Both directions look back over what was passed, as growing frames cost one step per row.
    up = Window.partitionBy(*scope).orderBy("_v", "_side")
    down = Window.partitionBy(*scope).orderBy(F.desc("_v"), F.desc("_side"))
    after = F.last("_point", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    before = F.last("_point", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    scanned = chunked.withColumns({"above": after, "below": before}).where("_probe IS NOT NULL")
    if entry is not None:
        scanned = scanned.join(entry, scope, "left").withColumns(
            {"above": F.coalesce("above", "_after"), "below": F.coalesce("below", "_before")}
        )
    if not strict:
        # Probes sort before equal points, so an equal point shows up as `above`; it is below too.
        scanned = scanned.withColumn("below", F.when(F.col("above") == F.col("_v"), F.col("above")).otherwise(F.col("below")))
    return scanned.select(*keys, "_probe.*", "above", "below")


def anchored_windows(
    df: DataFrame,
    keys: list[str],
    value: str,
    reach: Callable,
    closed: bool = True,
    group_rows: int | None = None,
) -> DataFrame:
    """Greedy windows per group: the lowest unused value is an anchor and takes all up to reach(anchor).

    `closed` says whether a value equal to reach(anchor) is taken; `reach` is plain arithmetic, so it
    takes a Column or an array. Returns the distinct values with their `anchor`.

    Groups proven small are walked in sorted partitions. Otherwise the walk from anchor to anchor is a linked list over the distinct values; its
    members are found by pointer doubling from the values that are anchors for sure (those with a
    gap before them), so the rounds grow with the logarithm of the longest gap-free chain.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    values = cut_lineage(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x")).distinct())
    if _small_groups(values, keys, limit):
        return _walk_small(values, keys, value, reach, closed)
    probes = values.withColumn("_reach", reach(F.col("_x")))
    nxt = neighbours(values, probes, keys, "_x", "_reach", strict=closed, group_rows=group_rows).select(
        *keys, "_x", F.col("above").alias("_next")
    )
    prev = with_previous(nxt, keys, ["_x"], ["_x", "_next"], group_rows)
    # A value starts a chain when the value before it does not reach it: its successor is this one.
    sure = F.col("prev__x").isNull() | (F.col("prev__next") == F.col("_x"))
    jump = cut_lineage(prev.select(*keys, "_x", "_next", sure.alias("_is")))
    anchors = jump.where("_is").select(*keys, "_x")
    hop = jump.where("_next IS NOT NULL").select(*keys, "_x", "_next")
    while True:
        found = anchors.join(hop, [*keys, "_x"]).select(*keys, F.col("_next").alias("_x"))
        fresh = cut_lineage(found.join(anchors, [*keys, "_x"], "left_anti").distinct())
        if fresh.isEmpty():
            break
        anchors = cut_lineage(anchors.unionByName(fresh))
        second = hop.select(*keys, F.col("_x").alias("_next"), F.col("_next").alias("_far"))
        hop = cut_lineage(hop.join(second, [*keys, "_next"]).select(*keys, "_x", F.col("_far").alias("_next")))
    member = neighbours(anchors, values.withColumn("_y", F.col("_x")), keys, "_x", "_y", strict=False, group_rows=group_rows)
    return member.select(*keys, F.col("_y").alias(value), F.col("below").alias("anchor"))


def _walk_small(values: DataFrame, keys: list[str], value: str, reach: Callable, closed: bool) -> DataFrame:
    """One sorted pass per partition; the open window is carried from batch to batch."""
    fields = [f for f in values.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField(value, T.DoubleType()), T.StructField("anchor", T.DoubleType())])
    side = "right" if closed else "left"

    def scan(batches):
        open_key = anchor = None
        for pdf in batches:
            x = pdf["_x"].to_numpy()
            if not len(x):
                continue
            parts = [pdf[k].to_numpy() for k in keys]
            fresh = np.zeros(len(x), dtype=bool)
            for part in parts:
                fresh[1:] |= part[1:] != part[:-1]
            fresh[0] = open_key is None or open_key != tuple(part[0] for part in parts)
            starts = np.union1d([0], np.flatnonzero(fresh))
            limit, anchors = reach(x), np.empty(len(x))
            for start, end in zip(starts, [*starts[1:], len(x)]):
                i = start
                if not fresh[start]:
                    i += np.searchsorted(x[start:end], reach(anchor), side=side)
                    anchors[start:i] = anchor
                while i < end:
                    anchor = x[i]
                    following = i + max(1, np.searchsorted(x[i:end], limit[i], side=side))
                    anchors[i:following] = anchor
                    i = following
            open_key = tuple(part[-1] for part in parts)
            yield pdf.assign(anchor=anchors).rename(columns={"_x": value})[[*keys, value, "anchor"]]

    placed = values.repartition(*keys) if keys else values.coalesce(1)
    return placed.sortWithinPartitions(*keys, "_x").mapInPandas(scan, schema)
