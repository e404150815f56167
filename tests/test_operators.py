"""Edges of the operators on hand-made frames: bounds, ties, missing values, empty sides."""

import collections
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom import catalog, session
from ionloom.functions.numeric import half_even, no_nan, ppm_of, shorten
from ionloom.operators import bands, blanks, cleanup, components, filters, isotope, match, ordered, regress, report, runs, series, skew
from ionloom.plans import isotopes

COLS = "feature_id long, mz double, rt double, dt double, ccs double"


def feats(spark, rows, extra=""):
    return spark.createDataFrame(rows, COLS + extra)


def ids(df):
    return sorted(r.feature_id for r in df.collect())


def test_half_even_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(half_even("x")).collect()][:3] == [0.0, 2.0, 2.0]
    assert df.select(no_nan("x").alias("x")).where("x IS NULL").count() == 1
    row = spark.range(1).select(ppm_of(F.lit(100.0), 10.0), ppm_of(F.lit(100.0), 10.0, F.lit(2)), shorten(F.lit("a" * 40), 35)).first()
    assert math.isclose(row[0], 1e-3) and math.isclose(row[1], 5e-4) and row[2] == "a" * 32 + "..."


def test_blank_methods(spark):
    rows = [
        (1, "B1", "blank", 10.0), (1, "B2", "blank", 20.0), (1, "E1", "exp", 100.0), (1, "E2", "exp", 5.0),
        (2, "B1", "blank", 10.0), (2, "E1", "exp", 100.0), (3, "B1", "blank", None), (3, "E1", "exp", 9.0), (1, "E3", "exp", None),
    ]
    df = spark.createDataFrame(rows, "feature_id long, sample string, role string, value double")
    one = {(r.feature_id, r.sample): r.value for r in blanks.subtract_blanks(df, "1").collect()}
    assert one == {(1, "E1"): 80.0, (1, "E2"): 0.0, (1, "E3"): None, (2, "E1"): 90.0, (3, "E1"): None}
    two = {(r.feature_id, r.sample): r.value for r in blanks.subtract_blanks(df, "2", 1.0).collect()}
    assert math.isclose(two[1, "E1"], 100 - 15 - np.std([10, 20], ddof=1)) and two[2, "E1"] == 90.0
    with pytest.raises(ValueError):
        blanks.subtract_blanks(df, "3")


def test_filters_are_inclusive_where_they_should_be(spark):
    f = feats(spark, [(1, 100.0, 1.0, 1.0, 0.0), (2, 200.0, 2.0, 1.0, 200 * 0.19 + 110.28), (3, None, None, 1.0, 1.0)])
    assert ids(filters.rt_range(f, 1.0, 2.0)) == [1, 2]
    assert ids(filters.mz_range(f, 100.0, 200.0)) == [1, 2]
    assert ids(filters.density_line(f)) == [1]
    assert ids(filters.mass_defect_range(f, 0.0, 0.0)) == [1, 2]
    masked = filters.mask_low_intensity(spark.createDataFrame([(99.9,), (100.0,), (None,)], "value double"), 100.0)
    assert [r.value for r in masked.collect()] == [0.0, 100.0, None]


def test_unsaturated_chain_bounds(spark):
    exact = 12.0 * 5 + 18.9984032 * 9
    f = feats(spark, [(1, exact, 1.0, 1.0, 1.0), (2, exact * (1 + 49e-6), 1.0, 1.0, 1.0), (3, exact * (1 + 51e-6), 1.0, 1.0, 1.0),
                      (4, 12.0 * 40 + 18.9984032 * 79, 1.0, 1.0, 1.0), (5, -6.9, 1.0, 1.0, 1.0)])
    assert ids(filters.drop_unsaturated_chains(f)) == [3, 4, 5]


def test_level2_returns_each_library_row_once_and_tolerates_missing_time(spark):
    f = feats(spark, [(1, 300.0, None, 1.0, 150.0), (2, 300.0, 9.0, 1.0, 150.0), (3, 300.0, 5.0, 1.0, 153.0 + 1e-9)])
    lib = spark.createDataFrame([(1, "a", "M-H", 300.0, 150.0, 5.0), (2, "b", "M-H", 300.0, 150.0, None)],
                                "lib_id long, name string, adduct string, mz double, ccs double, rt double")
    got = sorted((r.feature_id, r.match) for r in match.match_level2(f, lib, 10.0, 2.0, 0.5, True).collect())
    assert got == [(1, "a (M-H)"), (1, "b (M-H)"), (2, "b (M-H)")]
    assert match.match_level2(f, lib.where("lib_id > 5"), 10.0, 2.0, 0.5, True).count() == 0


def test_level5_joins_names_and_errors(spark):
    f = feats(spark, [(1, 500.0, 1.0, 1.0, 1.0), (2, 500.0, 2.0, 1.0, 1.0), (3, 700.0, 1.0, 1.0, 1.0)])
    lib = spark.createDataFrame([(1, "y", 500.001), (2, "x", 499.999), (3, "x", 499.999), (4, "z", None)], "lib_id long, name string, mz double")
    got = {r.feature_id: (r.match, r.mass_errors_ppm) for r in match.match_level5(f, lib, 10.0).collect()}
    assert got == {i: ("x or y", [-2.0, 2.0]) for i in (1, 2)}


CLASS = ", class string"


@pytest.fixture(scope="module")
def crowd(spark):
    """Random features packed into a few dense spots, so that hot paths have work to do."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(240):
        base = [300.0, 302.0, 304.0, 601.007825][i % 4]
        rows.append((i, float(base * (1 + rng.uniform(-30, 30) * 1e-6)), float(rng.uniform(4, 5.2)), 1.0, float(rng.uniform(195, 205)),
                     ["likely", "tentative", "unmatched"][int(rng.integers(3))]))
    return rows, feats(spark, rows, CLASS).cache()


@pytest.mark.parametrize("hot", [10**9, 3])
def test_isotopes_standards_and_decay_match_brute_force(spark, crowd, monkeypatch, hot):
    rows, df = crowd
    monkeypatch.setattr("ionloom.operators.bands.HOT_CELL", hot)
    flagged = {
        j[0] for i, j in itertools.permutations(rows, 2) for off in (2.0, 4.0)
        if i[1] + off - i[1] * 15 * 1e-6 <= j[1] <= i[1] + off + i[1] * 15 * 1e-6
        and abs(i[4] - j[4]) <= max(i[4], j[4]) * 0.02 and abs(i[2] - j[2]) <= 0.5
    }
    assert ids(match.remove_halogen_isotopes(df, 15.0, 0.02, 0.5)) == sorted({r[0] for r in rows} - flagged)
    decay = {
        o[0] for l, o in itertools.permutations(rows, 2)
        if l[5] == "likely" and o[5] != "likely" and abs(o[1] - l[1]) <= l[1] * 10 * 1e-6 and abs(o[2] - l[2]) < 1 and o[4] >= l[4] * 1.03
    }
    assert ids(match.remove_source_decay(df)) == sorted({r[0] for r in rows} - decay)
    stds = [(i, r[1] + (1.0 if i % 2 else 0.0), r[4]) for i, r in enumerate(rows[:60])]
    std = spark.createDataFrame(stds + [(99, None, 1.0)], "std_id long, mz double, ccs double")
    gone = {
        r[0] for r in rows if r[5] != "likely" and any(
            abs(r[4] - c) <= c * 1 / 100 and min(abs(r[1] - m), abs(r[1] - (m - 1.0))) <= m * 5 * 1e-6 for _, m, c in stds)
    }
    assert ids(match.remove_standards(df, std, 5.0, 1.0)) == sorted({r[0] for r in rows} - gone)


@pytest.mark.parametrize("hot", [10**9, 3])
def test_duplicate_groups_match_union_find(spark, crowd, hot):
    rows, df = crowd
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        d = abs(a[1] - b[1])
        if d <= max(a[1], b[1]) * 3 * 1e-6 and d <= min(a[1], b[1]) * 2e-5 and abs(a[4] - b[4]) <= max(a[4], b[4]) * 0.5 / 100 and abs(a[2] - b[2]) <= 0.1:
            ra, rb = find(a[0]), find(b[0])
            parent[max(ra, rb)] = min(ra, rb)
    labels = {r[0]: find(r[0]) for r in rows}
    sizes = {c: list(labels.values()).count(c) for c in labels.values()}
    got = {r.feature_id: r.component for r in cleanup.duplicate_groups(df, 3.0, 0.5, 0.1, hot_cell=hot).collect()}
    assert got == {i: c for i, c in labels.items() if sizes[c] > 1}


@pytest.mark.parametrize("hot", [10**9, 6])
def test_smearing_equals_the_sequential_walk(spark, hot):
    rng = np.random.default_rng(19)
    rows = [(i, float(np.round(rng.uniform(300, 303), 1)), float(rng.uniform(4, 4.6)), 1.0, float(rng.uniform(198, 202))) for i in range(60)]
    values = {(r[0], s): float(10 ** rng.uniform(0, 7)) for r in rows for s in ("A", "B")}
    want = dict(values)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for n, i in enumerate(order):
        for s in ("A", "B"):
            if any(j[1] >= i[1] - 2 and abs(j[4] - i[4]) / i[4] * 100 < 1 and abs(j[2] - i[2]) <= 0.2 and want[j[0], s] > 50 * want[i[0], s]
                   for j in order[:n]):
                want[i[0], s] = 0.0
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "feature_id long, sample string, value double")
    got = {(r.feature_id, r.sample): r.value for r in cleanup.smearing(feats(spark, rows), df, 1.0, 0.2, hot_cell=hot).collect()}
    assert got == want and 0.0 in want.values()


def test_adduct_chain_of_three(spark):
    """The second mass is an adduct of the first; the third one of the second only, so it stays."""
    m1 = 200.0
    m2 = 2 * m1 + 1.007825
    m3 = 2 * m2 + 1.007825
    df = feats(spark, [(i, m, 1.0, 1.0, 1.0, "unmatched") for i, m in enumerate((m1, m2, m3), 1)] + [(4, m2, 1.0, 1.0, 1.0, "likely")], CLASS)
    assert ids(cleanup.remove_adducts(df)) == [1, 3, 4]
    pairs = cleanup.adduct_pairs(df).collect()
    assert [(p.mz1, p.mz2, p.label) for p in pairs] == [(m1, m2, "2M+H")]


def test_crowd_needs_three_and_counts_copies(spark):
    df = feats(spark, [(1, 300.0, 1.0, 1.0, 1.0, "unmatched"), (2, 300.0, 1.0, 1.0, 1.0, "tentative"), (3, 300.0001, 1.0, 1.0, 1.0, "likely"),
                       (4, 400.0, 1.0, 1.0, 1.0, "unmatched"), (5, 400.0, 1.0, 1.0, 1.0, "unmatched"), (6, 400.01, 1.0, 1.0, 1.0, "unmatched"),
                       (7, 400.03, 1.0, 1.0, 1.0, "unmatched")], CLASS)
    assert ids(cleanup.crowd_elimination(df)) == [1, 2, 3, 7]


def test_merge_takes_means_and_maxima(spark):
    f = feats(spark, [(1, 300.0, 1.0, 2.0, 100.0), (2, 300.002, 3.0, 4.0, 102.0), (3, 500.0, 1.0, 1.0, 1.0)])
    groups = spark.createDataFrame([(1, 1), (2, 1)], "feature_id long, component long")
    i = spark.createDataFrame([(1, "A", 5.0), (2, "A", 7.0), (2, "B", None), (3, "A", 1.0)], "feature_id long, sample string, value double")
    kept, moved = cleanup.merge_duplicates(f, i, groups)
    rows = {r.feature_id: r for r in kept.collect()}
    assert set(rows) == {2, 3} and rows[2].rt == 2.0 and rows[2].members == 2
    assert {(r.feature_id, r.kept_id) for r in cleanup.duplicate_members(groups).collect()} == {(1, 2), (2, 2)}
    assert {(r.feature_id, r.sample): r.value for r in moved.collect()} == {(2, "A"): 7.0, (2, "B"): None, (3, "A"): 1.0}


@pytest.mark.parametrize("hot", [10**9, 2])
def test_alignment_matches_brute_force(spark, hot):
    rng = np.random.default_rng(23)
    rows = [(f"S{int(rng.integers(3)) if i % 3 else 0}", i, float(300 * (1 + rng.uniform(-60, 60) * 1e-6)), float(rng.uniform(195, 212))) for i in range(70)]
    df = spark.createDataFrame(rows, "sample string, compound long, mz double, ccs double")
    key = lambda r: f"{r[0]}/{r[1]:019d}"
    parent = {key(r): key(r) for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.permutations(rows, 2):
        if a[0] != b[0] and a[2] - a[2] * 1e-5 <= b[2] <= a[2] + a[2] * 1e-5 and abs(a[3] - b[3]) / a[3] * 100 <= 1:
            ra, rb = find(key(a)), find(key(b))
            parent[max(ra, rb)] = min(ra, rb)
    got = {(r.sample, r.compound): r.alignment_id for r in isotope.align(df, 10.0, 1.0, hot_cell=hot).collect()}
    assert got == {(r[0], r[1]): find(key(r)) for r in rows}


def test_halogen_and_carbon_edges(spark):
    rows = [("a.cef", 1, 300.4, 100.0), ("a.cef", 1, 301.4, 11.145), ("a.cef", 1, 302.4, 29.0), ("a.cef", 2, 400.0, 5.0),
            ("a.cef", 3, 500.0, 0.0), ("a.cef", 3, 501.0, 1.0), ("a.cef", 4, 600.5, 10.0), ("a.cef", 4, 601.5, 1.0)]
    peaks = spark.createDataFrame(rows, "source_file string, compound int, peak_mz double, peak_intensity double")
    got = {r.compound: r for r in isotope.halogen_class(isotope.carbon_estimate(peaks)).collect()}
    assert set(got) == {1, 4} and math.isclose(got[1].carbon_estimate, 10.0) and got[1].isotope_status.startswith("Potential")
    assert got[4].isotope_status.startswith("No M+2") and got[4].mass_defect == 0.5


def test_sample_column_resolution(spark):
    names = spark.createDataFrame([("S1",), ("S10",), ("X",)], "sample string")
    got = {r.sample: r.column for r in isotope.resolve_samples(names, ["run S10.d", "run S1.d", "S10"]).collect()}
    assert got == {"S1": "run S10.d", "S10": "S10"}


def _pair_loss(x, y, q):
    return min(
        float(np.maximum(q * (d := y - (s * x + (y[i] - s * x[i]))), (q - 1) * d).sum())
        for i, j in itertools.combinations(range(len(x)), 2) if x[i] != x[j] for s in [(y[j] - y[i]) / (x[j] - x[i])]
    )


@pytest.mark.parametrize("near", [4096, 12])
def test_quantile_lines_equal_pair_enumeration_beside_any_other_group(spark, near):
    """Also with far points summed up, ties, repeated points, and a much larger group next to it."""
    rng = np.random.default_rng(29)
    x = np.round(rng.uniform(1, 5, 70), 1)
    y = 3 * x + np.where(rng.uniform(size=70) < 0.1, 40.0, 1.0) * rng.exponential(1, 70)
    x[60:], y[60:] = x[:10], y[:10]
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)]
    alone = {r.q: r for r in regress.quantile_lines(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", [0.1, 0.5, 0.9], near).collect()}
    for q, r in alone.items():
        assert math.isclose(r.loss, _pair_loss(x, y, q), rel_tol=1e-9)
        assert math.isclose(r.loss, float(np.maximum(q * (d := y - (r.slope * x + r.intercept)), (q - 1) * d).sum()), rel_tol=1e-9)
    others = [("b", float(a), float(a + b)) for a, b in zip(rng.uniform(0, 9, 900), rng.normal(0, 1, 900))] + [("c", 1.0, 2.0)]
    beside = regress.quantile_lines(spark.createDataFrame(rows + others, "g string, x double, y double"), ["g"], "x", "y", [0.1, 0.5, 0.9], near)
    beside = {(r.g, r.q): r for r in beside.collect()}
    assert len(beside) == 9
    assert all((beside["a", q].slope, beside["a", q].intercept) == (r.slope, r.intercept) for q, r in alone.items())


@pytest.mark.parametrize("near", [4096, 15])
def test_quantile_curves_are_optimal(spark, near):
    """No direction lowers the loss, and a cubic fits better than a line."""
    rng = np.random.default_rng(37)
    mz = rng.uniform(100, 1500, 150)
    rows = [(i, float(m), float(40 * np.log(m) ** 2 - 150 + rng.normal(0, 3))) for i, m in enumerate(mz)]
    df = spark.createDataFrame(rows, "id long, mz double, ccs double")
    spline = regress.cross_validate_spline(df, "id", "ccs", 0.1, 0.9, folds=2, near_rows=near).first()
    lines = {r.model: r for r in regress.cross_validate(df, "id", "ccs", 0.1, 0.9, folds=2).collect()}
    assert spline.loss_mid < lines["logarithmic"].loss_mid < lines["linear"].loss_mid
    u = F.ln("mz") - 6.0
    design = df.withColumns({"a": F.lit(1.0), "b": u, "c": u * u})
    fit = regress.quantile_curves(design, [], ["a", "b", "c"], "ccs", [0.3], near).first()
    x, y = np.column_stack([np.ones(150), np.log(mz) - 6, (np.log(mz) - 6) ** 2]), np.array([r[2] for r in rows])

    def loss(beta):
        d = y - x @ beta
        return np.maximum(0.3 * d, -0.7 * d).sum()

    assert math.isclose(fit.loss, loss(np.array(fit.beta)), rel_tol=1e-9)
    assert all(loss(np.array(fit.beta) + 1e-3 * rng.normal(size=3)) >= fit.loss for _ in range(200))


def _trends_one_by_one(rows, limit, least=0, trials=200):
    """What the rule says, line by line: {row_id: trend or None} for rows of (row_id, group_id, mz, ccs)."""
    want, rounds = {r[0]: None for r in rows}, {}
    for g in {r[1] for r in rows}:
        pool, number, rounds[g] = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 0, 0
        while True:
            n, lines = len(pool), set()
            for t in range(trials if n > 1 else 0):
                i = t * n // trials
                j = (i + 1 + math.floor(t * 0.6180339887498949 % 1 * (n - 1))) % n
                a, b = pool[min(i, j)], pool[max(i, j)]
                if a[2] != b[2] and 0.05 <= (s := (b[3] - a[3]) / (b[2] - a[2])) <= 0.25:
                    lines.add((s, a[3] - s * a[2]))
            near = {x: {p[0]: m for p in pool if (m := abs(p[3] - (x[0] * p[2] + x[1]))) <= limit} for x in lines}
            order = {x: (-len(near[x]), sum(round(m * 1e6) for m in near[x].values()), *x) for x in lines if len(near[x]) >= max(2, least)}
            if not order:
                break
            most, taken = -min(order.values())[0], set()
            wins = [x for x in order if 2 * len(near[x]) >= most and not any(order[o] < order[x] and near[o].keys() & near[x].keys() for o in order)]
            for x in sorted(wins, key=order.get):
                want |= dict.fromkeys(near[x], number)
                number += 1
                taken |= near[x].keys()
            pool, rounds[g] = [p for p in pool if p[0] not in taken], rounds[g] + 1
    return want, max(rounds.values())


@pytest.mark.parametrize("group_rows", [10_000, 10, 0])
@pytest.mark.parametrize("sizes,trials,least", [((8, 11, 14), 200, 3), ((60, 2, 1), 50, 0), ((30, 5, 40), 200, 6)])
def test_group_trends_match_a_plain_search(spark, sizes, trials, least, group_rows):
    rng = np.random.default_rng(31)
    rows = []
    for g, n in enumerate(sizes):
        for i in range(n):
            mz = 200.0 + 20 * i + rng.uniform(0, 1)
            rows.append((g * 100 + i, g, float(mz), float(100 + 0.15 * mz + (25 if i % 4 == 3 else 0) + rng.uniform(-1, 1))))
    df = spark.createDataFrame([*rows, (990, 0, None, 5.0), (991, 77, 300.0, None)], "row_id long, group_id long, mz double, ccs double")
    outcome = regress.group_trends(df, 3.0, min_inliers=least, trials=trials, group_rows=group_rows).collect()
    want, _ = _trends_one_by_one(rows, 3.0, least, trials)
    assert {r.row_id: r.trend for r in outcome} == want | {990: None, 991: None}
    assert all(r.is_outlier == (r.trend is None) for r in outcome)
    sizes_of = collections.Counter((r.group_id, r.trend) for r in outcome if r.trend is not None)
    assert min(sizes_of.values()) >= max(2, least)


@pytest.mark.parametrize("group_rows", [10_000, 0])
def test_large_groups_make_no_row_for_each_point_and_line(spark, monkeypatch, group_rows):
    """Blocks and the end in one task settle what the whole group in one task does; a shuffle meets sums by block and line."""
    rng = np.random.default_rng(7)
    rows = [(g * 1000 + i, g, 200.0 + 2 * i, 130.0 + 0.3 * i + float(rng.uniform(-4, 4)) + 20 * (i % 3)) for g in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, mz double, ccs double")
    made = []

    def counted(ranked, blocks, lines, step, schema):
        out = blockwise(ranked, blocks, lines, step, schema)
        made.append((step.__name__, out.count()))
        return out

    blockwise = regress._blockwise
    monkeypatch.setattr(regress, "_blockwise", counted)
    got = regress.group_trends(df, 2.0, group_rows=min(group_rows, 100), block_rows=64).collect()
    want = regress.group_trends(df, 2.0).collect()
    assert sorted((r.row_id, -1 if r.trend is None else r.trend, r.is_outlier) for r in got) == sorted((r.row_id, -1 if r.trend is None else r.trend, r.is_outlier) for r in want)
    assert {name for name, _ in made} == {"_line_sums", "_beaten_lines", "_taken_points"}
    assert all(n <= 2 * 5 * 200 for _, n in made)


@pytest.mark.parametrize("group_rows", [10_000, 0])
def test_a_last_free_point_is_an_outlier(spark, group_rows):
    rows = [(i, 1, 200.0 + 20 * i, c) for i, c in enumerate([130.0, 133.0, 136.0, 139.0, 149.0])]
    df = spark.createDataFrame(rows, "row_id long, group_id long, mz double, ccs double")
    got = {r.row_id: (r.trend, r.is_outlier) for r in regress.group_trends(df, 3.0, group_rows=group_rows).collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (0, False), 3: (0, False), 4: (None, True)}


def test_repeated_rows_and_poor_fits(spark):
    """Rows of one row_id share their fate; a line whose refit is poor takes its points, but is no trend."""
    rows = [(i, 1, 200.0 + 20 * i, 130.0 + 3 * i) for i in range(4)] * 2 + [(10 + i, 2, 200.0 + i, 100.0 + 0.1 * i + (2.9 if i % 2 else -2.9)) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, mz double, ccs double")
    for group_rows in (1000, 0):
        got = regress.group_trends(df, 6.0, min_r2=0.9, group_rows=group_rows).collect()
        assert len(got) == len(rows)
        assert {r.trend for r in got if r.group_id == 1} == {0}
        assert all(r.is_outlier for r in got if r.group_id == 2 and r.trend is None) and any(r.trend is None for r in got if r.group_id == 2)
        assert all(r.r_squared >= 0.9 for r in got if r.trend is not None)


@pytest.mark.parametrize("group_rows", [10_000, 0])
def test_many_parallel_trends_are_drawn_until_none_is_left(spark, group_rows):
    """40 equal trends in one group are more than one draw of 200 pairs can meet; each takes its own points, several a round."""
    rows = [(t * 10 + i, 1, 200.0 + 20 * i + t * 0.1, 100 + 15.0 * t + 0.15 * (200 + 20 * i + t * 0.1)) for t in range(40) for i in range(10)]
    rows += [(900, 2, 300.0, 150.0), (901, 2, 320.0, 140.0), (902, 3, 300.0, 150.0)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, mz double, ccs double")
    got = {r.row_id: r.trend for r in regress.group_trends(df, 3.0, group_rows=group_rows).collect()}
    want, rounds = _trends_one_by_one(rows, 3.0)
    assert got == want and rounds < 30
    assert sum(t is None for t in got.values()) < 10


def test_series_keeps_first_row_of_a_terminal_mass_and_skips_missing_time(spark):
    rows = [(i, "n", "unmatched", 100.0 + 10 * i, None if i == 2 else 1.0 + i, 200.0 + 49.9968 * i) for i in range(4)]
    rows += [(9, "n", "unmatched", 140.0, 5.0, 200.0 + 49.9968 * 3)]
    df = spark.createDataFrame(rows, "row_id long, name string, class string, ccs double, rt double, mz double")
    groups = series.series_groups(df, {"CF2": 49.9968}, 10.0, 3)
    assert sorted(r.row_id for r in groups.collect()) == [0, 1, 2, 3]
    assert series.refine_groups(groups, 3).count() == 4
    fallen = df.withColumn("ccs", F.when(F.col("row_id") == 1, 90.0).otherwise(F.col("ccs")))
    assert sorted(r.row_id for r in series.refine_groups(series.series_groups(fallen, {"CF2": 49.9968}, 10.0, 3), 3).collect()) == [0, 2, 3]


def test_validation_flags_whole_groups(spark):
    rows = [(1, 1, 100.0, "x", False), (2, 1, 120.0, "x", False), (3, 1, 140.0, "x", True), (4, 2, 100.0, "External Standard", False),
            (5, 2, 111.0, "x", False), (6, 2, 122.0, "x", False)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, mz double, class string, is_outlier boolean")
    got = {r.row_id: r.is_outlier for r in series.validate_trends(df, 3, 1).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_report_texts(spark):
    df = spark.createDataFrame([(1, "n" * 40, "likely", 300.12345, 150.0, 2.0, 1.5), (2, "s", None, 301.0, None, None, None)],
                               "feature_id long, match string, class string, mz double, ccs double, rt double, ratio double")
    i = spark.createDataFrame([(1, "B", 1234.6), (1, "A", 2.0), (1, "C", 0.0)], "feature_id long, sample string, value double")
    got = {r.feature_id: r for r in report.detail_text(df, i, "feature_id").collect()}
    assert got[1].short_name == "n" * 27 + "..." and got[1].detail.endswith("A: 2\nB: 1,235")
    assert "m/z: 300.1234" in got[1].detail or "m/z: 300.1235" in got[1].detail
    assert got[2].detail.endswith("Not detected in any sample") and "out of bounds" in got[2].detail
    segs = spark.createDataFrame([(1.0, 1, k, float(k)) for k in range(5)] + [(1.0, 2, 0, 9.0), (1.2, 3, 0, 1.0)], "level double, segment_id int, pos int, x double")
    assert [(r.level, r.x) for r in report.contour_labels(segs).collect()] == [(1.0, 2.0)]
    table = report.display_table(spark.createDataFrame([("x", "likely", 1234567.8)], "match string, class string, S1 double"), ["S1"]).first()
    assert table["Name"] == "x" and table["S1"] == "1,234,568"


def test_missing_intensities_keep_their_compound(spark):
    rows = [("a.cef", 1, 300.4, 100.0), ("a.cef", 1, 301.4, None), ("a.cef", 1, 302.4, 50.0), ("a.cef", 2, 400.0, None), ("a.cef", 2, 401.0, 3.0),
            ("a.cef", 3, 500.0, 5.0), ("a.cef", 3, 501.0, 0.0)]
    peaks = spark.createDataFrame(rows, "source_file string, compound int, peak_mz double, peak_intensity double")
    got = {r.compound: r for r in isotope.halogen_class(isotope.carbon_estimate(peaks)).collect()}
    assert set(got) == {1, 2} and got[1].carbon_estimate is None and got[1].isotope_status == "Potential Cl, Br present"


def test_grid_of_any_size(spark):
    ys, xs = [-0.1, 0.0, 0.1], [float(i) for i in range(5000)]
    grid = spark.createDataFrame([(y, x, 1.0 + x / 100 + y) for y in ys for x in xs], "y double, x double, z double")
    probes = [(1, 0.05, 4321.25), (2, 0.1, 4999.0), (3, -0.1, 0.0), (4, 0.05, 4999.5), (5, None, 3.0), (6, -0.2, 3.0), (7, 0.05, 4321.25)]
    df = spark.createDataFrame(probes, "id int, md_over_c double, m_over_c double")
    got = {r.id: r.ratio for r in isotope.grid_ratio(df, grid).collect()}
    want = {i: half_even_py(1.0 + x / 100 + y) if y is not None and -0.1 <= y and x <= 4999 else None for i, y, x in probes}
    assert got == want


def half_even_py(v):
    return round(v * 10) / 10


def test_smearing_at_the_edge_of_a_decade(spark):
    """124999.99999999981 and 6249999.999999992 fall into one decade of logarithms, though the ratio is above 50."""
    features = spark.createDataFrame([(1, 300.0, 5.0, 200.0), (2, 300.5, 5.0, 200.0)], "feature_id long, mz double, rt double, ccs double")
    values = spark.createDataFrame([(1, "s", 6249999.999999992), (2, "s", 124999.99999999981)], "feature_id long, sample string, value double")
    assert 6249999.999999992 > 50 * 124999.99999999981
    got = {r.feature_id: r.value for r in cleanup.smearing(features, values).collect()}
    assert got == {1: 6249999.999999992, 2: 0.0}


def test_null_keys_pass_a_spread_join(spark):
    from ionloom.operators.skew import spread_join

    rows = spark.createDataFrame([(None, i) for i in range(40)] + [(1, 100 + i) for i in range(40)] + [(2, 200)], "k long, v long")
    table = spark.createDataFrame([(1, "a"), (None, "b")], "k long, t string")
    for how, n in (("inner", 40), ("left", 81), ("left_anti", 41), ("left_semi", 40)):
        assert sorted(map(tuple, spread_join(rows, table, ["k"], how, block=5).collect()), key=repr) == sorted(map(tuple, rows.join(table, ["k"], how).collect()), key=repr)
        assert spread_join(rows, table, ["k"], how, block=5).count() == n


@pytest.mark.parametrize("group_rows", [100_000, 20])
def test_mass_runs_hold_all_partners_in_a_row_per_target(spark, monkeypatch, group_rows):
    monkeypatch.setattr(ordered, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(4)
    masses = sorted({float(m) for m in [*rng.uniform(300, 300.02, 60), *rng.uniform(200, 900, 40), 400.0, 400.0 * (1 + 5e-6)]})
    targets = [(float(i), "x" if i % 2 else "y", float(t)) for i, t in enumerate([*rng.uniform(300, 300.02, 30), *rng.uniform(200, 900, 20), 400.0, 50.0, 950.0])]
    m = spark.createDataFrame([(x,) for x in [*masses, masses[3]]] + [(None,)], "mz double")
    found = runs.mass_runs(spark.createDataFrame(targets, "mz1 double, label string, target double"), m.where("mz IS NOT NULL").distinct(), 5.0)
    got = {r.mz1: (r.label, r.first_rank, r.last_rank) for r in found.collect()}
    want = {}
    for i, label, t in targets:
        tol = t * 5.0 * 1e-6
        near = [k for k, x in enumerate(masses, 1) if t - tol <= x <= t + tol]
        if near:
            want[i] = (label, near[0], near[-1])
    assert got == want and len(want) > 20
    pairs = {(r.mz1, r.mz2) for r in runs.expand_runs(found, runs.ranked_masses(m)).collect()}
    assert pairs == {(i, masses[k - 1]) for i, (_, a, b) in want.items() for k in range(a, b + 1)}


def test_sample_values_are_arrays_until_they_are_widened(spark):
    rows = [("A", "s1", 1, 300.0, 10.0), ("A", "s1", 2, 302.0, 20.0), ("A", "s3", 3, 301.0, None), ("B", "s2", 4, 400.0, 7.0), ("B", "other", 5, 400.0, 9.0)]
    aligned = spark.createDataFrame(rows, "alignment_id string, sample string, compound int, mz double, intensity double")
    names = ["s3", "s1", "s2", *[f"t{i}" for i in range(2000)]]
    summary = isotope.alignment_summary(aligned, names)
    got = {r.alignment_id: r for r in summary.collect()}
    assert len(summary.columns) < 10 and got["A"].sample_values[:4] == [0.0, 15.0, 0.0, 0.0] and len(got["A"].sample_values) == 2003
    assert got["B"].sample_values[:3] == [0.0, 0.0, 7.0] and got["B"].detection_count == 2 and got["A"].detection_count == 1
    wide = isotope.widen_samples(isotope.alignment_summary(aligned, names[:3]), names[:3])
    assert {(r.alignment_id, r.s3, r.s1, r.s2) for r in wide.collect()} == {("A", 0.0, 15.0, 0.0), ("B", 0.0, 0.0, 7.0)}
    assert "sample_values" not in isotope.alignment_summary(aligned).columns


def test_certificates_tell_the_best_curve_from_others(spark):
    rng = np.random.default_rng(9)
    rows = [(g, 1.0, float(x), float(2 * x + rng.normal())) for g in range(2) for x in rng.uniform(0, 10, 60)]
    points = spark.createDataFrame(rows, "g int, one double, x double, y double")
    best = regress.quantile_curves(points, ["g"], ["one", "x"], "y", [0.2, 0.5])
    for r in regress.curve_certificates(points, ["g"], ["one", "x"], "y", best).collect():
        assert r.feasible and abs(r.gap) < 1e-6 and r.below + r.above + r.on_curve == r.n == 60
    off = best.withColumn("beta", F.array(F.get("beta", 0) + 0.3, F.get("beta", 1)))
    assert not any(r.feasible for r in regress.curve_certificates(points, ["g"], ["one", "x"], "y", off).collect())


@pytest.mark.parametrize("near_rows", [1000, 30])
def test_quantile_curves_of_small_and_large_groups_agree(spark, near_rows):
    rng = np.random.default_rng(12)
    rows = [(g, float(x), float(3 * x + rng.normal())) for g, n in enumerate([5, 25, 200]) for x in rng.uniform(0, 10, n)]
    points = spark.createDataFrame(rows, "g int, x double, y double")
    got = {(r.g, r.q): r.loss for r in regress.quantile_lines(points, ["g"], "x", "y", [0.25, 0.9], near_rows).collect()}
    for (g, q), loss in got.items():
        own = [(x, y) for k, x, y in rows if k == g]
        lines = [((b[1] - a[1]) / (b[0] - a[0]), a) for a, b in itertools.combinations(own[:60], 2)] if g == 2 else [((b[1] - a[1]) / (b[0] - a[0]), a) for a, b in itertools.combinations(own, 2)]
        least = min(sum(max(q * r, (q - 1) * r) for r in (y - a[1] - s * (x - a[0]) for x, y in own)) for s, a in lines)
        assert loss <= least + 1e-9 and (g == 2 or abs(loss - least) < 1e-9)
    assert len(got) == 6


def _crowded_library(spark, copies=4):
    """Masses a few ppm apart or equal, few cross-sections, many repeated rows."""
    rows = []
    for i in range(copies * 4000):
        fam, k, size = i // 20 % 40, i % 20, i * 7919 // 13 % 50
        m = 112.9856 + 3.0307 * fam + 49.9968 * k
        rows.append((i, m * (1 + ((size * 7) % 21 - 10) * 1e-6), 90 + 0.185 * m + size % 9 + (60.0 if i % 17 == 0 else 0.0)))
    return spark.createDataFrame(rows, "id long, mz double, ccs double")


def test_curves_through_crowded_masses_are_proven_best(spark):
    """Exact optima where many masses are nearly or fully equal."""
    rows = regress.spline_certificates(_crowded_library(spark), "id", "ccs", 0.1, 0.9, folds=2).collect()
    assert len(rows) == 6 and all(r.feasible and abs(r.gap) < 1e-5 for r in rows)


def test_quantile_rounds_are_few_and_do_not_write_the_rows(spark, monkeypatch):
    written = []
    keep = regress.cut_lineage
    monkeypatch.setattr(regress, "cut_lineage", lambda df: (written.append(1), keep(df))[1])
    points = _crowded_library(spark, 2).select(F.ln("mz").alias("x"), F.col("ccs").alias("y"))
    lines = regress.quantile_lines(points, [], "x", "y", [0.1, 0.9], near_rows=300).collect()
    assert len(lines) == 2 and len(written) <= 3 + 3 * 4


@pytest.mark.parametrize("seed", [0, 7, 8])
def test_vertex_search_never_takes_points_that_fix_no_curve(seed):
    """Rounding made points of one mass look like crossings when far points pull strongly: the matrix was singular."""
    rng = np.random.default_rng(seed)
    u, y = np.repeat(rng.uniform(-1, 1, 6), 5), np.round(rng.uniform(0, 1, 30), 2)
    near = pd.DataFrame({"_x": [[1.0, a, a * a, a**3] for a in u], "_y": y})
    start = pd.DataFrame({"q": [0.5], "beta": [[0.0] * 4], "_far": [rng.normal(0, 200, 4).tolist()]})
    beta = regress._vertex_solver(["q"], 4, ["q", "beta"])(near, start)["beta"].iat[0]
    assert np.isfinite(beta).all()


def test_crowded_cells_are_sent_to_the_workers_once(spark, monkeypatch):
    """Each row was copied 27 times before any of them could be dropped."""
    plans, keep = [], bands.cut_lineage
    monkeypatch.setattr(bands, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().analyzed().toString()), keep(df))[1])
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.uniform(0, 1, 4))) for i in range(400)]
    cell = spark.createDataFrame(rows, "id long, q_a double, q_b double, q_c double, v double").withColumns({"_k0": F.lit(0), "_n": F.lit(400)})
    axes = [bands.abs_band(f"q_{c}", F.col(c), 1.0) for c in "abc"]
    kept = bands._reduce_hot(cell, ["_k0"], axes, {"v": "high"}).collect()
    assert not any("Generate" in p for p in plans)
    for modes in itertools.product(range(3), repeat=3):
        signs = [(1 if m == 1 else -1, i) for i, m in enumerate(modes) if m]
        score = {r[0]: (*[s * r[1 + i] for s, i in signs], r[4]) for r in rows}
        want = {i for i, a in score.items() if not any(b != a and all(x >= y for x, y in zip(b, a)) for b in score.values())}
        assert want == {r.id for r in kept if (r._m0, r._m1, r._m2) == modes}


def test_features_are_not_broadcast(fx):
    """The file of `part` is small, what is made of it is not: the driver got every feature once per use."""
    for rows in (fx.intensity, fx.peak):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_crowded_cells_are_linked_through_a_few_points(spark, monkeypatch):
    """Every point of a crowded cell looked for partners, and each was an edge to its own cell."""
    edges, search = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda e: (edges.append(e.count()), search(e))[1])
    rng = np.random.default_rng(31)
    rows = [(f"S{i % 2}", i, float(300 * (1 + rng.uniform(-20, 20) * 1e-6)), float(rng.uniform(200, 206))) for i in range(800)]
    rows += [("S0", 1000 + i, float(400 * (1 + rng.uniform(0, 4) * 1e-6)), 210.0) for i in range(60)]  # one sample: they stay apart
    rows += [("S1", 2000, 400.0, 207.0), ("S1", 1, rows[1][2], 300.0)]  # a partner of some; a compound at two places
    df = spark.createDataFrame(rows, "sample string, compound long, mz double, ccs double")
    got = {(r.sample, r.compound): r.alignment_id for r in isotope.align(df, 10.0, 1.0).collect()}
    assert len(got) == len(rows) - 1
    parent = {(r[0], r[1]): f"{r[0]}/{r[1]:019d}" for r in rows}
    mz, ccs, sample = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    near = (np.abs(mz[:, None] - mz) <= mz[:, None] * 1e-5) & (np.abs(ccs[:, None] - ccs) / ccs[:, None] * 100 <= 1) & (sample[:, None] != sample)
    near |= near.T
    assert edges[0] < near.sum() / 8
    changed = True
    while changed:
        changed = False
        for i, r in enumerate(rows):
            names = [parent[r[0], r[1]], *(parent[rows[j][0], rows[j][1]] for j in np.flatnonzero(near[i]))]
            if min(names) < names[0]:
                parent[r[0], r[1]], changed = min(names), True
    assert got == parent


def test_reduction_takes_many_cells_at_once(spark, monkeypatch):
    """Each chunk of a cell was a call of its own; a missing value counted as the best one."""
    monkeypatch.setattr(bands, "CHUNK_ROWS", 16)
    monkeypatch.setattr(bands, "BUCKET_ROWS", 100)
    calls, make = spark.sparkContext.accumulator(0), bands._undominated

    def counted(*args):
        reduced = make(*args)

        def call(pdf):
            calls.add(1)
            return reduced(pdf)

        return call

    monkeypatch.setattr(bands, "_undominated", counted)
    rng = np.random.default_rng(12)
    rows = [(i, i % 40, *map(float, rng.uniform(0, 1, 2)), None if i % 7 == 0 else float(rng.uniform(0, 1))) for i in range(800)]
    cells = spark.createDataFrame(rows, "id long, _k0 int, q_a double, q_b double, v double").withColumn("_n", F.lit(20))
    axes = [bands.abs_band(f"q_{c}", F.col(c), 1.0) for c in "ab"]
    kept = bands._reduce_hot(cells, ["_k0"], axes, {"v": "high"}).collect()
    assert calls.value < 40
    for modes in itertools.product(range(3), repeat=2):
        signs = [(1 if m == 1 else -1, i) for i, m in enumerate(modes) if m]
        score = {r[0]: (*[s * r[2 + i] for s, i in signs], -math.inf if r[4] is None else r[4]) for r in rows}
        for cell in range(40):
            of = {i: a for i, a in score.items() if i % 40 == cell}
            want = {i for i, a in of.items() if not any(b != a and all(x >= y for x, y in zip(b, a)) for b in of.values())}
            assert want == {r.id for r in kept if r._k0 == cell and (r._m0, r._m1) == modes}


def test_features_that_differ_only_in_their_id_are_matched_once(spark):
    """Equal features times equal compounds: the pairs grew with the square of the repeats."""
    f = spark.createDataFrame([(i, 300.0, 1.0, 2.0, 200.0, "a" if i % 2 else None) for i in range(6)], COLS + ", match string")
    f = f.withColumn("class", F.lit("likely"))
    values = spark.createDataFrame([(i, "S1", 50.0) for i in range(6)], "feature_id long, sample string, value double")
    peaks = spark.createDataFrame([("S1.cef", i, 1.0, 2.0, 200.0, 300.0 + n, 50.0 - 40 * n) for i in range(6) for n in (0, 1)],
                                  "source_file string, compound long, rt double, dt double, ccs double, peak_mz double, peak_intensity double")
    every, once = isotope.sample_anchors(f, values, peaks), isotope.sample_anchors(f, values, peaks, by_feature=False)
    assert every.count() == 36 and once.count() == 12
    assert sorted(map(str, isotope.distinct_anchors(every).collect())) == sorted(map(str, isotope.distinct_anchors(once).collect()))


def test_peaks_are_made_once_for_the_summary(fx, monkeypatch):
    """The peak table was made anew, from its sources, by each of its readers."""
    plans = []
    for module in (catalog, isotopes):
        monkeypatch.setattr(module, "cut_lineage", lambda df: (plans.append(df.columns), session.cut_lineage(df))[1])
    for name in ("align_components", "isotope_summary"):
        plans.clear()
        catalog.QUERIES[name](fx.spark, fx.folder)
        assert fx.peak.columns in plans


def test_only_tables_counted_as_small_are_broadcast(spark, monkeypatch):
    """Spark guesses sizes from compressed files and sent millions of features, the probes, through the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    probe = spark.createDataFrame([(i, 300.0 + i) for i in range(20)], "i long, mz double")
    library = spark.createDataFrame([(f"a long name, number {i}" * 9, 300.0 + i / 100) for i in range(500)], "name string, l_mz double")
    band, near = [bands.ppm_band("l_mz", F.col("mz"), 10.0)], F.abs(F.col("l_mz") - F.col("mz")) <= F.col("mz") * 1e-5
    joined = bands.band_join(probe, library, band, near)
    assert "BuildRight" in plan(joined) and "BuildLeft" not in plan(joined) and joined.count() == 5
    monkeypatch.setattr(bands, "SPLITS_SENT", 100)
    joined = bands.band_join(probe, library, band, near)
    assert "BuildLeft" not in plan(joined) and "SortMergeJoin" in plan(joined) and joined.count() == 5
    monkeypatch.setattr(skew, "MERGE_ROWS", 10, raising=False)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "BroadcastHashJoin" not in plan(skew.spread_join(probe, probe.select("i"), ["i"], how))
