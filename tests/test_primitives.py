"""Property tests: every primitive against the obvious slow way, in both of its size regimes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import bands as B
from ionloom.operators.components import connected_components
from ionloom.operators.ordered import anchored_windows, neighbours, with_previous, with_rank, with_running_sum


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    rows = [
        (i, float(m), float(c), float(v))
        for i, (m, c, v) in enumerate(zip(rng.uniform(100, 100.02, 300), rng.uniform(200, 210, 300), rng.uniform(1, 100, 300)))
    ]
    p = spark.createDataFrame(rows, "pid long, pm double, pc double, pv double")
    q = p.select(F.col("pid").alias("qid"), F.col("pm").alias("qm"), F.col("pc").alias("qc"), F.col("pv").alias("qv"))
    return p.cache(), q.cache()


def _near():
    return (F.abs(F.col("qm") - F.col("pm")) <= F.col("pm") * 5e-6) & (F.abs(F.col("qc") - F.col("pc")) <= 0.5)


@pytest.mark.parametrize("full,pair_rows,sent", [(64, 4096, 100_000), (3, 4096, 100_000), (3, 5, 100_000), (3, 5, 0), (10**9, 2, 100_000)])
def test_band_join_equals_filtered_product_without_duplicates(cloud, monkeypatch, full, pair_rows, sent):
    """Tiles that are not split, split on some or all levels, and crowded finest cells dealt over blocks."""
    monkeypatch.setattr(B, "FULL_TILE", full)
    monkeypatch.setattr(B, "SPLITS_SENT", sent)
    p, q = cloud
    bands = [B.ppm_band("qm", F.col("pm"), 5.0), B.abs_band("qc", F.col("pc"), 0.5)]
    got = [(r.pid, r.qid) for r in B.band_join(p, q, bands, _near(), pair_rows=pair_rows).collect()]
    want = {(r.pid, r.qid) for r in p.crossJoin(q).where(_near()).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_sparse_rows_are_copied_less_than_by_finest_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(rng.uniform(100, 900, 2000), rng.uniform(100, 300, 2000), rng.uniform(0, 20, 2000))]
    p = spark.createDataFrame(rows, "pm double, pc double, pt double")
    q = p.toDF("qm", "qc", "qt")
    bands = [B.ppm_band("qm", F.col("pm"), 10.0), B.abs_band("qc", F.col("pc"), 1.0), B.abs_band("qt", F.col("pt"), 0.5)]
    wide = B.tiling(q, bands).place_probe(p, bands).count() / 2000
    monkeypatch.setattr(B, "LEVELS", 0)
    fine = B.tiling(q, bands).place_probe(p, bands).count() / 2000
    assert wide < 2 < 6 < fine


def test_a_crowded_mass_is_split_by_the_next_axis(spark):
    """100,000 rows of one mass cell: the tiles of the second axis hold a few thousand at most, and so do blocks of equal rows."""
    build = spark.range(100_000).select((F.lit(300.0) + F.col("id") * 1e-9).alias("qm"), (F.lit(100.0) + F.col("id") % 5000 * 0.04).alias("qc"), F.col("id").alias("qid"))
    probe = spark.createDataFrame([(i, 300.00005, 100.0 + 7 * i) for i in range(25)], "pid int, pm double, pc double")
    bands = [B.ppm_band("qm", F.col("pm"), 5.0), B.abs_band("qc", F.col("pc"), 0.5)]
    tiles = B.tiling(build, bands, (), B.PAIR_ROWS)
    assert tiles.place_build(B._build_cells(build, bands)).groupBy(*tiles.keys).count().agg(F.max("count")).first()[0] <= 4096
    got = B.band_join(probe, build, bands, _near()).groupBy("pid").count().collect()
    want = {i: sum(abs(100.0 + k * 0.04 - (100.0 + 7 * i)) <= 0.5 for k in range(5000)) * 20 for i in range(25)}
    assert {r.pid: r["count"] for r in got} == want
    same = build.withColumn("qc", F.lit(107.0))
    joined = B.band_join(probe.where("pid = 1"), same, bands, _near())
    assert joined.count() == 100_000
    assert [r["_n"] for r in B.tiling(same, bands, (), B.PAIR_ROWS).hot().collect()] == [100_000]  # dealt over 25 blocks


def test_band_join_plans_an_equi_join(cloud):
    p, q = cloud
    plan = B.band_join(p, q, [B.ppm_band("qm", F.col("pm"), 5.0)], _near())._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("hot,chunk,full", [(10**9, 4096, 64), (10**9, 4096, 2), (4, 4096, 64), (4, 8, 64)])
def test_band_semi_is_exact_with_and_without_crowded_cells(cloud, monkeypatch, hot, chunk, full):
    monkeypatch.setattr(B, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(B, "FULL_TILE", full)
    p, q = cloud
    ok = _near() & (F.col("qv") > F.col("pv") * 1.5)
    bands = [B.ppm_band("qm", F.col("pm"), 5.0), B.abs_band("qc", F.col("pc"), 0.5)]
    got = {r.pid for r in B.band_semi(p, q, bands, ok, ["pid"], prefer={"qv": "high"}, hot_cell=hot).collect()}
    assert got == {r.pid for r in p.crossJoin(q).where(ok).select("pid").distinct().collect()}


def test_reduction_shrinks_a_crowded_cell(spark):
    rows = [(float(100 + i * 1e-6), float(i % 97)) for i in range(3000)]
    df = spark.createDataFrame(rows, "qm double, qv double").withColumn("_k0", F.lit(0)).withColumn("_n", F.lit(3000))
    band = B.ppm_band("qm", F.col("pm"), 50.0)
    kept = B._reduce_hot(df, ["_k0"], [band], {"qv": "high"})
    assert kept.count() < 300


def test_exists_1d(spark):
    rng = np.random.default_rng(7)
    a = [float(x) for x in rng.uniform(100, 101, 400)]
    b = [float(x) for x in rng.uniform(100, 101, 60)]
    probe, build = spark.createDataFrame([(x,) for x in a], "x double"), spark.createDataFrame([(x,) for x in b], "t double")
    tol = F.col("t") * 1e-5
    out = B.band_exists_1d(probe, build, B.ppm_band_of_build("t", F.col("x"), 10.0), F.col("t") - tol, F.col("t") + tol, F.col("x"))
    got = {r.x for r in out.where("hit").collect()}
    assert got == {x for x in a if any(t - t * 1e-5 <= x <= t + t * 1e-5 for t in b)}


def test_components_match_union_find_on_paths_stars_and_noise(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _walk(values, reach, closed):
    out, anchor = {}, None
    for v in sorted(set(values)):
        if anchor is None or not (v <= reach(anchor) if closed else v < reach(anchor)):
            anchor = v
        out[v] = anchor
    return out


@pytest.mark.parametrize("group_rows", [None, 0])
@pytest.mark.parametrize("closed", [True, False])
def test_anchored_windows(spark, group_rows, closed):
    rng = np.random.default_rng(11)
    rows = [(int(k), float(v)) for k in range(2) for v in np.round(rng.uniform(100, 110, 40 + 60 * k), 2)]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {(r.g, r.x): r.anchor for r in anchored_windows(df, ["g"], "x", lambda a: a + 0.5, closed, group_rows).collect()}
    want = {(k, v): a for k in range(2) for v, a in _walk([v for g, v in rows if g == k], lambda a: a + 0.5, closed).items()}
    assert got == want


def test_small_walk_carries_its_window_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        values = [100.0 + i * 0.03 for i in range(200)]
        df = spark.createDataFrame([(g, v) for g in (1, 2, 3) for v in values], "g long, x double")
        got = {(r.g, r.x): r.anchor for r in anchored_windows(df, ["g"], "x", lambda a: a + 0.5).collect()}
        assert got == {(g, v): a for g in (1, 2, 3) for v, a in _walk(values, lambda a: a + 0.5, True).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ordered_scans_agree_in_both_regimes(spark):
    rng = np.random.default_rng(13)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 500), np.round(rng.uniform(0, 50, 500), 1)))]
    df = spark.createDataFrame(rows, "g long, x double, id long")
    want = {}
    for g in (1, 2, 3):
        last, total = None, 0
        for n, (_, x, i) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            total += i % 3
            want[i] = (last, total, n)
            last = x
    for limit in (None, 0):
        prev = {r.id: r.prev_x for r in with_previous(df, ["g"], ["x", "id"], ["x"], limit).collect()}
        run = {r.id: r.s for r in with_running_sum(df, ["g"], ["x", "id"], F.col("id") % 3, "s", limit).collect()}
        rank = {r.id: r.n for r in with_rank(df, ["g"], ["x", "id"], "n", limit).collect()}
        assert {i: (prev[i], run[i], rank[i]) for i in prev} == want


@pytest.mark.parametrize("group_rows", [None, 0])
def test_neighbours(spark, group_rows):
    points = [1.0, 2.0, 2.5, 7.0]
    probes = [0.5, 1.0, 2.2, 7.0, 9.0]
    p = spark.createDataFrame([(x,) for x in points], "x double")
    t = spark.createDataFrame([(x,) for x in probes], "t double")
    got = {r.t: (r.below, r.above) for r in neighbours(p, t, [], "x", "t", False, group_rows).collect()}
    assert got == {
        x: (max((v for v in points if v <= x), default=None), min((v for v in points if v >= x), default=None)) for x in probes
    }
    strict = {r.t: r.above for r in neighbours(p, t, [], "x", "t", True, group_rows).collect()}
    assert strict == {x: min((v for v in points if v > x), default=None) for x in probes}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    from ionloom.operators.skew import spread_join

    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(200)], "id long, k long")
    table = spark.createDataFrame([(7, "a"), (7, "b"), (9, "c")], "k long, t string")
    columns = rows.join(table, "k", how).columns
    want = sorted(str(r) for r in rows.join(table, "k", how).select(*columns).collect())
    got = sorted(str(r) for r in spread_join(rows, table, ["k"], how, block=20).select(*columns).collect())
    assert got == want
