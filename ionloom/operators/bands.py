"""Tolerance joins.

A `Band` says that a column of the build side must lie between two expressions of the probe
side. Both sides get tile numbers on every banded axis, the join is an equi-join on the tiles, and
the exact predicate is checked on the candidates. A build row has exactly one tile, so no pair can
come out twice.

Tiles come from grids of several resolutions. The finest one has cells no wider than the band, so a
probe looks into up to three of them per axis: 27 copies on three axes. Each coarser grid doubles the
edges, until a probe mostly stays inside one tile. A build row is in the coarsest tile with no more than
`FULL_TILE` build rows; fuller ones are split in halves on every axis, where the rows are and nowhere else, and
probes follow the splits (see `Tiling`). So sparse data is copied once or twice and dense data is cut as
finely as its own density asks.

`band_join` returns pairs; build rows of a finest cell that is still crowded are dealt over blocks, which
probes visit in turn. `band_semi` only asks whether a partner exists, and does so without
comparing everything in a crowded cell with everything around it: finest cells holding more than
`HOT_CELL` build rows are first reduced to the rows that can decide the question (see
`_reduce_hot`), in chunks of bounded size.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.operators.skew import spread_join
from ionloom.session import cut_lineage

HOT_CELL = 256
CHUNK_ROWS = 4096
#: Rows of crowded cells that a worker reduces at once, chunks of many cells side by side.
BUCKET_ROWS = 65_536
#: Doublings from the finest grid to the coarsest, and build rows of a tile that is not split.
LEVELS, FULL_TILE = 3, 64
#: Build rows of one finest cell that a task joins with the probes of that cell.
PAIR_ROWS = 4096
#: Rows, as counted and not as guessed by Spark, that are broadcast at most; more split tiles are joined by a shuffle that
#: splits hot keys, more build rows are merged.
SPLITS_SENT = 100_000
_SLACK = 1e-9
_INSIDE, _ABOVE_LO, _BELOW_HI = 0, 1, 2


@dataclass(frozen=True)
class Band:
    """build[point] in [lo, hi]; `width` is the cell width, in log units when `log` is set.

    `width` must not exceed the narrowest hi - lo (on the chosen scale). `tie` names a build
    column that breaks ties of `point`, for predicates on the pair (point, tie).
    """

    point: str
    lo: Column
    hi: Column
    width: float
    log: bool = False
    tie: str | None = None

    def cell(self, c: Column, slack: float = 0.0) -> Column:
        scaled = (F.ln(c) if self.log else c) / F.lit(self.width * 0.99) + F.lit(slack)
        return F.floor(scaled).cast("long")


def ppm_band(point: str, centre: Column, ppm: float) -> Band:
    """Mass within `ppm` of the probe's `centre`."""
    f = ppm * 1e-6
    return Band(point, centre * F.lit(1 - f), centre * F.lit(1 + f), float(np.log1p(f) - np.log1p(-f)), log=True)


def ppm_band_of_build(point: str, value: Column, ppm: float) -> Band:
    """Mass `value` of the probe within `ppm` of the build side's point."""
    f = ppm * 1e-6
    return Band(point, value / F.lit(1 + f), value / F.lit(1 - f), float(np.log1p(f) - np.log1p(-f)), log=True)


def abs_band(point: str, centre: Column, tol: float) -> Band:
    return Band(point, centre - F.lit(tol), centre + F.lit(tol), 2.0 * tol)


def _build_cells(build: DataFrame, bands: list[Band]) -> DataFrame:
    present = [F.col(b.point).isNotNull() for b in bands]
    for p in present:
        build = build.where(p)
    return build.withColumns({f"_k{i}": b.cell(F.col(b.point)) for i, b in enumerate(bands)})


def _shifted(c: Column, by: int) -> Column:
    return F.shiftright(c, by) if by else c


@dataclass(frozen=True)
class Tiling:
    """The tiles that are split, by level 0 (coarsest) to LEVELS (finest), where split means crowded.

    `splits` has _lvl, the `on` columns, the tile numbers _k0, _k1, ... and the number of build rows _n;
    `levels` says how many there are on each level, `total` how many build rows have a tile. A tiling made from more rows than
    are joined stays right.
    """

    on: tuple[str, ...]
    axes: int
    splits: DataFrame
    levels: dict[int, int]
    total: int

    @property
    def keys(self) -> list[str]:
        return [*self.on, "_lvl", *[f"_k{i}" for i in range(self.axes)]]

    @property
    def crowded(self) -> bool:
        return LEVELS in self.levels

    def split(self, rows: DataFrame, level: int) -> DataFrame:
        """`rows` with _split, whether their tile of this level is split."""
        table = self.splits.where(F.col("_lvl") == level).select(*self.keys, F.lit(True).alias("_split"))
        if self.levels[level] <= SPLITS_SENT:
            return rows.join(F.broadcast(table), self.keys, "left")
        return spread_join(rows, table, self.keys, "left")

    def place_build(self, cells: DataFrame) -> DataFrame:
        """Rows of `_build_cells` with their tile: _lvl and _k0, _k1, ... on that level."""
        numbers = [f"_k{i}" for i in range(self.axes)]
        rows = cells.withColumns({f"_f{i}": F.col(k) for i, k in enumerate(numbers)})
        rows = rows.withColumns({"_lvl": F.lit(0), **{k: _shifted(F.col(k), LEVELS) for k in numbers}})
        for level in range(LEVELS):
            if level not in self.levels:
                break
            rows = self.split(rows, level)
            finer = {k: F.when(F.col("_split"), _shifted(F.col(f"_f{i}"), LEVELS - level - 1)).otherwise(F.col(k)) for i, k in enumerate(numbers)}
            rows = rows.withColumns({"_lvl": F.when(F.col("_split"), level + 1).otherwise(F.col("_lvl")), **finer}).drop("_split")
        return rows.drop(*[f"_f{i}" for i in range(self.axes)])

    def place_probe(self, probe: DataFrame, bands: list[Band], with_modes: bool = False) -> DataFrame:
        """Probe rows, one for each tile that their box meets; modes are those of `_reduce_hot`, for finest cells."""
        rows = probe.withColumns({f"_lo{i}": b.cell(b.lo, -_SLACK) for i, b in enumerate(bands)} | {f"_hi{i}": b.cell(b.hi, _SLACK) for i, b in enumerate(bands)})
        for i in range(self.axes):
            rows = rows.withColumn(f"_k{i}", F.explode(F.sequence(_shifted(F.col(f"_lo{i}"), LEVELS), _shifted(F.col(f"_hi{i}"), LEVELS))))
        rows = rows.withColumn("_lvl", F.lit(0))
        for level in range(LEVELS):
            if level not in self.levels:
                break
            rows = self.split(rows, level)
            by = LEVELS - level - 1
            for i in range(self.axes):
                k = F.col(f"_k{i}")
                halves = F.sequence(F.greatest(_shifted(F.col(f"_lo{i}"), by), 2 * k), F.least(_shifted(F.col(f"_hi{i}"), by), 2 * k + 1))
                rows = rows.withColumn(f"_k{i}", F.explode(F.when(F.col("_split"), halves).otherwise(F.array(k))))
            rows = rows.withColumn("_lvl", F.when(F.col("_split"), level + 1).otherwise(F.col("_lvl"))).drop("_split")
        if with_modes:
            for i, b in enumerate(bands):
                k = F.col(f"_k{i}")
                mode = F.when(k <= b.cell(b.lo, _SLACK), _ABOVE_LO).when(k >= b.cell(b.hi, -_SLACK), _BELOW_HI).otherwise(_INSIDE)
                rows = rows.withColumn(f"_m{i}", mode)
        return rows.drop(*[f"_{end}{i}" for i in range(self.axes) for end in ("lo", "hi")])

    def hot(self, more_than: int = 0) -> DataFrame:
        """The crowded finest cells, with _n."""
        return self.splits.where((F.col("_lvl") == LEVELS) & (F.col("_n") > more_than)).select(*self.keys, "_n")


def tiling(build: DataFrame, bands: list[Band], on: tuple[str, ...] = (), hot_cell: int | None = None) -> Tiling:
    """Counts the finest cells of `build` once, and adds them up to the coarser ones."""
    limit = HOT_CELL if hot_cell is None else hot_cell
    numbers = [f"_k{i}" for i in range(len(bands))]
    fine = _build_cells(build, bands).groupBy(*on, *numbers).agg(F.count(F.lit(1)).alias("_n"))
    up = F.explode(F.array(*[F.struct(F.lit(lvl).alias("_lvl"), *[_shifted(F.col(k), LEVELS - lvl).alias(k) for k in numbers]) for lvl in range(LEVELS + 1)]))
    rolled = fine.select(*on, "_n", up.alias("_t")).select(*on, "_t._lvl", *[f"_t.{k}" for k in numbers], "_n")
    seen = Observation()
    finest = F.sum(F.when(F.col("_lvl") == LEVELS, F.col("_n")))
    sums = rolled.groupBy(*on, "_lvl", *numbers).agg(F.sum("_n").alias("_n")).observe(seen, finest.alias("rows"))
    splits = cut_lineage(sums.where(F.col("_n") > F.when(F.col("_lvl") == LEVELS, limit).otherwise(min(FULL_TILE, limit))))
    return Tiling(on, len(bands), splits, {r[0]: r[1] for r in splits.groupBy("_lvl").count().collect()}, seen.get["rows"] or 0)


def band_join(
    probe: DataFrame, build: DataFrame, bands: list[Band], residual: Column, on: tuple[str, ...] = (), pair_rows: int | None = None
) -> DataFrame:
    """All pairs that satisfy `residual`; column names of the two sides must differ (but for `on`)."""
    limit = PAIR_ROWS if pair_rows is None else pair_rows
    tiles = tiling(build, bands, on, limit)
    left, right = tiles.place_probe(probe, bands), tiles.place_build(_build_cells(build, bands))
    if not tiles.crowded:
        return _keyed_join(left, right, tiles.keys, residual, "inner", tiles.total)
    blocks = tiles.hot().select(*tiles.keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_blocks"))
    blocks = F.broadcast(blocks) if tiles.levels[LEVELS] <= SPLITS_SENT else blocks
    count = F.coalesce("_blocks", F.lit(1))
    dealt = F.pmod(F.xxhash64(*build.columns), count).cast("int")
    right = right.join(blocks, tiles.keys, "left").withColumn("_kb", dealt).drop("_blocks")
    left = left.join(blocks, tiles.keys, "left").withColumn("_kb", F.explode(F.sequence(F.lit(0), count - 1))).drop("_blocks")
    return _keyed_join(left, right, [*tiles.keys, "_kb"], residual, "inner", tiles.total)


def _keyed_join(left: DataFrame, right: DataFrame, keys: list[str], residual: Column, how: str, total: int) -> DataFrame:
    """`right` has `total` rows at most; it is broadcast if these are few, and `left` never is, whatever size Spark takes them for."""
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    if total <= SPLITS_SENT:
        renamed = F.broadcast(renamed)
    else:
        left = left.hint("merge")
    condition = residual
    for k in keys:
        condition = (F.col(k) == F.col(f"_r{k}")) & condition
    joined = left.join(renamed, condition, how)
    technical = [c for c in joined.columns if c.startswith(("_k", "_r", "_m", "_lvl")) and c not in keys]
    return joined.drop(*technical, *[k for k in keys if k.startswith(("_k", "_m", "_lvl"))])


def band_semi(
    probe: DataFrame,
    build: DataFrame,
    bands: list[Band],
    residual: Column,
    ids: list[str],
    on: tuple[str, ...] = (),
    prefer: dict[str, str] | None = None,
    hot_cell: int | None = None,
    tiles: Tiling | None = None,
) -> DataFrame:
    """`ids` of the probe rows that have at least one partner (an id may repeat, once per tile).

    `residual` must be the conjunction of the bands and of conditions in which only the build
    columns named by `prefer` ('high' or 'low': which end makes a match likelier) take part.
    `tiles` may be those of more rows than `build`.
    """
    prefer = prefer or {}
    tiles = tiling(build, bands, on, hot_cell) if tiles is None else tiles
    right = tiles.place_build(_build_cells(build, bands))
    left = tiles.place_probe(probe, bands, with_modes=tiles.crowded)
    if not tiles.crowded:
        return _keyed_join(left, right, tiles.keys, residual, "left_semi", tiles.total).select(*ids)
    hot = tiles.hot()
    cold = spread_join(right, hot.drop("_n"), tiles.keys, "left_anti")
    crowd = hot.agg(F.sum("_n")).first()[0]
    kept = _reduce_hot(spread_join(right, hot, tiles.keys), tiles.keys, bands, prefer, crowd)
    from_cold = _keyed_join(left, cold, tiles.keys, residual, "left_semi", tiles.total).select(*ids)
    modes = [f"_m{i}" for i in range(len(bands))]
    from_hot = _keyed_join(left, kept, tiles.keys + modes, residual, "left_semi", crowd * 3 ** len(bands)).select(*ids)
    return from_cold.unionByName(from_hot)


def _reduce_hot(hot_rows: DataFrame, keys: list[str], bands: list[Band], prefer: dict[str, str], total: int | None = None) -> DataFrame:
    """Undominated rows of every crowded cell, once per way a probe can look into it; `total` bounds the number of rows, if known.

    A probe either covers the cell on an axis, reaches in from above its lower bound (so the
    largest point decides) or from below its upper bound (the smallest decides). For each of these
    combinations a row that is beaten on every deciding column by another one can be dropped: if it
    satisfies the predicate, so does the other. Chunks bound the rows that are compared at once, and buckets of chunks, of
    many cells each, what a worker holds; the rounds end when every cell fits one chunk or nothing shrinks any more.
    """
    combos = list(itertools.product((_INSIDE, _ABOVE_LO, _BELOW_HI), repeat=len(bands)))
    mode_cols = [f"_m{i}" for i in range(len(bands))]
    group = keys + mode_cols
    data_cols = [c for c in hot_rows.columns if c != "_n"]
    deciding = [(b.point, b.tie) for b in bands]
    modes = [T.StructField(c, T.IntegerType()) for c in mode_cols]
    schema = T.StructType([*[f for f in hot_rows.schema.fields if f.name != "_n"], *modes, T.StructField("_chunk", T.IntegerType())])

    # Rows go to the workers once, whatever the number of combinations; only what is left of each is made a row.
    undominated = _undominated(keys, mode_cols, combos, deciding, list(prefer.items()))
    rows, within = hot_rows, keys
    total = rows.count() if total is None else total
    previous = None
    while True:
        chunks = F.ceil(F.col("_n") / F.lit(CHUNK_ROWS)).cast("int")
        rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(*data_cols), chunks).cast("int")).drop("_n")
        bucket = F.pmod(F.xxhash64(*within, "_chunk"), F.lit(total // BUCKET_ROWS + 1))
        rows = cut_lineage(rows.groupBy(bucket.alias("_bucket")).applyInPandas(undominated, schema))
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_chunk").alias("_c"))
        split, total = sizes.agg(F.max("_c"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        rows = rows.drop("_chunk")
        if (split or 1) == 1 or (previous is not None and total > 0.8 * previous):
            return rows
        previous, within = total, group
        rows = rows.join(sizes.drop("_c"), group)


def _undominated(keys: list[str], mode_cols: list[str], combos: list[tuple], deciding: list[tuple], prefer: list[tuple]):
    """The group function of `_reduce_hot`: undominated rows of each cell and chunk of a bucket, all of them side by side.

    Rows without modes are taken for each of `combos`, others for their own. Self-contained, so that it travels to the workers by value.
    """
    inside, above_lo = _INSIDE, _ABOVE_LO

    def dense_rank(by: tuple) -> np.ndarray:
        """Rank of rows under lexicographic order of the reversed key tuple (last key first)."""
        arrays = [np.asarray(b) for b in by]
        order = np.lexsort(arrays)
        changed = np.zeros(len(order), dtype=bool)
        for a in arrays:
            s = a[order]
            changed[1:] |= s[1:] != s[:-1]
        rank = np.empty(len(order), dtype=float)
        rank[order] = np.cumsum(changed)
        return rank

    def front(columns: list[np.ndarray], cell: np.ndarray) -> np.ndarray:
        """Positions of the rows not beaten (<= on every column) by another row of their cell; larger is better."""
        order = np.lexsort([-c for c in reversed(columns)] + [cell])
        if len(columns) < 2:
            return order[np.r_[True, np.diff(cell[order]) > 0]]
        if len(columns) == 2:
            # The best of a cell so far, cells told apart by steps no rank can make up for.
            rank = dense_rank((columns[1],))
            stepped = (cell * (rank.max() + 1.0) + rank)[order]
            return order[np.r_[True, stepped[1:] > np.maximum.accumulate(stepped)[:-1]]]
        index, remaining, at = order, np.column_stack(columns)[order], cell[order]
        kept = []
        while len(index):
            first = np.r_[True, np.diff(at) > 0]
            kept.append(index[first])
            alive = (remaining > remaining[first][np.cumsum(first) - 1]).any(axis=1)
            index, remaining, at = index[alive], remaining[alive], at[alive]
        return np.concatenate(kept)

    def undominated(pdf: pd.DataFrame) -> pd.DataFrame:
        several = mode_cols[0] not in pdf
        within = [*keys, "_chunk"] if several else [*keys, *mode_cols, "_chunk"]
        cell = pdf.groupby(within, sort=False, dropna=False).ngroup().to_numpy()
        ranks = [dense_rank((pdf[point],) if tie is None else (pdf[tie], pdf[point])) for point, tie in deciding]
        liked = [np.nan_to_num(pdf[name].to_numpy(dtype=float) * (1 if end == "high" else -1), nan=-np.inf) for name, end in prefer]
        kept, of = [], []
        for combo in combos:
            columns = [rank if mode == above_lo else -rank for rank, mode in zip(ranks, combo) if mode != inside] + liked
            here = np.arange(len(pdf)) if several else np.flatnonzero((pdf[mode_cols].to_numpy() == combo).all(axis=1))
            if len(here):
                kept.append(here[front([c[here] for c in columns], cell[here])])
                of.append(np.full(len(kept[-1]), combos.index(combo)))
        found = pdf.iloc[np.concatenate(kept)]
        if several:
            table = np.array(combos, dtype=np.int32)[np.concatenate(of)]
            found = found.assign(**{c: table[:, i] for i, c in enumerate(mode_cols)})
        return found

    return undominated


def band_exists_1d(
    probe: DataFrame,
    build: DataFrame,
    band: Band,
    lo_of_build: Column,
    hi_of_build: Column,
    value: Column,
    on: tuple[str, ...] = (),
    build_flags: dict[str, Column] | None = None,
    total: int | None = None,
) -> DataFrame:
    """Existence on one axis from per-cell extremes: no pairs, and one summary row per cell.

    The predicate is lo_of_build(point) <= value <= hi_of_build(point), both bounds growing with
    the point. Because a cell is no wider than the band, the first cell of a probe is decided by
    its largest point, the last one by its smallest, and cells between them by being there.
    Returns the probe's rows with one boolean per entry of `build_flags`. `total` bounds the number of
    probe rows times the cells each looks into, if known.
    """
    flags = build_flags or {"hit": F.lit(True)}
    aggs = []
    for name, flag in flags.items():
        aggs.append(F.max(F.when(flag, hi_of_build)).alias(f"_hi_{name}"))
        aggs.append(F.min(F.when(flag, lo_of_build)).alias(f"_lo_{name}"))
    summary = (
        build.where(F.col(band.point).isNotNull())
        .withColumn("_k0", band.cell(F.col(band.point)))
        .groupBy(*on, "_k0")
        .agg(*aggs)
    )
    left = probe.withColumn("_k0", F.explode(F.sequence(band.cell(band.lo, -_SLACK), band.cell(band.hi, _SLACK))))
    below = F.col("_k0") >= band.cell(band.hi, -_SLACK)
    left = left.withColumn("_m0", F.when(F.col("_k0") <= band.cell(band.lo, _SLACK), _ABOVE_LO).when(below, _BELOW_HI).otherwise(_INSIDE))
    joined = spread_join(left, summary, [*on, "_k0"], "left", total)
    hits = {}
    for name in flags:
        first = F.col(f"_hi_{name}") >= value
        last = F.col(f"_lo_{name}") <= value
        test = F.when(F.col("_m0") == _ABOVE_LO, first).when(F.col("_m0") == _BELOW_HI, last)
        hits[name] = F.coalesce(F.bool_or(test.otherwise(F.col(f"_hi_{name}").isNotNull())), F.lit(False))
    return joined.groupBy(*probe.columns).agg(*[h.alias(n) for n, h in hits.items()])
