"""Connected components by repeated contraction of the edge list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.operators import bands as B
from ionloom.operators.skew import spread_join
from ionloom.session import cut_and_count, cut_lineage

#: Points of a cell beyond which only those that decide whether cells are linked are compared.
CELL_ROWS = 32


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each round hooks every node to the neighbour with the smallest hash, shortens the pointers, and
    rewrites the edges in terms of the pointers. Hashed order keeps the pointer chains short even
    when the ids run along a path. Edges inside a tree vanish and parallel ones merge, so the edge
    list shrinks fast and hubs disappear in the first rounds.
    """
    start = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    start = start.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live, left = cut_and_count(start)
    bound = 2 * left
    roots = None
    while left:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = F.least(_rank("u"), F.min(_rank("v")))
        hook = both.groupBy("u").agg(best.alias("best")).select("u", F.col("best.id").alias("p"))
        step = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        # A live edge has two ends, so twice its number bounds every table of this round.
        hook = cut_lineage(spread_join(hook, step, ["p"], total=2 * left).select("u", F.col("pp").alias("p")))
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = hook.select(F.col("u").alias("root"), "p")
            roots = spread_join(roots, moved, ["root"], "left", total=bound)
            roots = cut_lineage(roots.select("node", F.coalesce("p", "root").alias("root")))
        to_u = hook.select("u", F.col("p").alias("pu"))
        to_v = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live, left = cut_and_count(
            spread_join(spread_join(live, to_u, ["u"], total=left), to_v, ["v"], total=left).where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        )
    if roots is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cut_lineage(roots)
    label = roots.groupBy("root").agg(F.min("node").alias("component"))
    return spread_join(roots, label, ["root"], total=bound).select("node", "component")


def _rank(name: str):
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("id"))


def box_components(
    rows: DataFrame,
    key: str,
    axes: list[str],
    passes: list[tuple[list[B.Band], Column]],
    sample: str | None = None,
    hot_cell: int | None = None,
) -> DataFrame:
    """(key, component, size) of points linked when they lie in each other's box.

    The grid cells of the bands must be no larger than the box, so that the points of a cell are
    linked with each other: a cell is one node, and a crowd of near-equal points costs one row
    instead of all its pairs. With `sample`, only points of different samples are linked: then a
    cell is one node if it holds two samples or more, and its points stay apart if it holds one.

    Links between cells are searched with every pass (bands and exact predicate, probe columns named
    as in `axes`, build columns with the prefix q_). The first pass must be complete when each point
    probes all others; a second one, for crowded cells only, must be its mirror image.
    """
    limit = CELL_ROWS if hot_cell is None else hot_cell
    bands = passes[0][0]
    keys = [f"_k{i}" for i in range(len(bands))]
    extra = [sample] if sample else []
    points = rows.select(F.col(key).alias("id"), *[F.col(a).alias(f"q_{a}") for a in axes], *extra)
    cells, total = cut_and_count(B._build_cells(points, bands))
    first = F.min("id").alias("cell_id")
    if sample:
        spread = (F.min(sample) < F.max(sample)).alias("clique")
    else:
        spread = F.lit(True).alias("clique")
    summary = cells.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("_n"), spread)
    node = F.when(F.col("clique"), F.col("cell_id")).otherwise(F.col("id"))
    located, crowd = cut_and_count(spread_join(cells, summary, keys, total=total).withColumn("node", node).drop("cell_id"), f"_n > {limit}")
    tiles = B.tiling(cells.drop(*keys), bands, (), limit)
    any_hot = tiles.crowded
    build = tiles.place_build(located.drop("id"))
    modes = [f"_m{i}" for i in range(len(bands))]
    # Of a crowded cell that is one node, the rows that decide in some direction look for partners as well as being found.
    lone = ~F.coalesce(F.col("clique"), F.lit(False))  # a cell whose samples are all missing is none
    own = [*[f"q_{a}" for a in axes], "node", *extra]
    probes = located.where((F.col("_n") <= limit) | lone).select(*own)
    if any_hot:
        kept = B._reduce_hot(build.where(F.col("_n") > limit), tiles.keys + extra, bands, {}, crowd)
        probes = probes.unionByName(kept.where(~lone).select(*own).distinct())
        kept = kept.drop("clique")
    build = build.where(F.col("_n") <= limit).drop("_n", "clique")
    links = []
    for number, (pass_bands, ok) in enumerate(passes):
        if number:
            if not any_hot:
                break
            # Points of a crowded cell that stay apart, of which the first pass may have found others.
            probes = located.where((F.col("_n") > limit) & lone).select(*own)
        probe = probes.select(
            *[F.col(f"q_{a}").alias(a) for a in axes], F.col("node").alias("own"),
            *[F.col(c).alias("own_sample") for c in extra],
        )
        # Without samples the predicate is symmetric and nodes are whole cells: look at each pair of nodes once.
        test = ok & (F.col("own") < F.col("node") if sample is None else F.col("own") != F.col("node"))
        if sample:
            test = test & (F.col("own_sample") != F.col(sample))
        left = tiles.place_probe(probe, pass_bands, with_modes=any_hot)
        links.append(B._keyed_join(left, build, tiles.keys, test, "inner", total - crowd))
        if any_hot:
            links.append(B._keyed_join(left, kept, tiles.keys + modes, test, "inner", crowd * 3 ** len(bands)))
    edges = reduce(DataFrame.unionByName, [x.select(F.col("own").alias("src"), F.col("node").alias("dst")) for x in links])
    if sample:
        # Points may share a key across cells; the key then holds their nodes together.
        ends = located.groupBy("id").agg(F.min("node").alias("src"), F.max("node").alias("_last")).where("src <> _last").drop("_last")
        ends, several = cut_and_count(ends)
        placed = located.select("id", F.col("node").alias("dst"))
        shared = placed.join(F.broadcast(ends), "id") if several <= B.SPLITS_SENT else spread_join(placed, ends, ["id"], total=total)
        edges = edges.unionByName(shared.where("src <> dst").select("src", "dst"))
    linked = connected_components(edges)
    weights = located.groupBy("node").agg(F.count(F.lit(1)).alias("_w"))
    parts = cut_lineage(
        weights.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    sizes = parts.groupBy("component").agg(F.sum("_w").alias("size"))
    labels = spread_join(parts.select("node", "component"), sizes, ["component"])
    return spread_join(located.select(F.col("id").alias(key), "node"), labels, ["node"], total=total).select(key, "component", "size")
