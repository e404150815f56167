"""Named queries over the fixture tables, each with the SQL that must give the same rows.

Doubles are reported as integers of a fixed scale, so that a comparison does not hang on the last
bit. The one query without SQL (scores of splines) is tested, and its curves are proven the best by `spline_certificate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.fixtures import CTES, Fixtures
from ionloom.functions.numeric import kendrick_defect
from ionloom.model import ADDUCT_RULES, KENDRICK_FACTORS, NEUTRAL_LOSSES, Params
from ionloom.operators import blanks, cleanup, filters, isotope, match, regress, report, series
from ionloom.operators.ordered import with_rank
from ionloom.plans import isotopes as isotope_plan
from ionloom.plans import screen as screen_plan
from ionloom.plans import series as series_plan
from ionloom.session import cut_lineage, scratch_folder
from ionloom.sources import cef, delimited

UNITS = {"CF2": 49.9968, "OCF2": 65.9917}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def scaled(c: Column | str, name: str, scale: float = 1e4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * F.lit(scale)).cast("long").alias(name)


def s(expr: str, name: str, scale: str = "1E4") -> str:
    return f"CAST(round_even(({expr}) * {scale}, 0) AS BIGINT) AS {name}"


def query(sql: str | None = None, ctes: str = "", recursive: str = ""):
    """Registers a query; `ctes` and `recursive` are added after the fixture tables."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            parts = [CTES.strip()] + [p.strip().rstrip(",") for p in (ctes, recursive) if p]
            ORACLES[fn.__name__] = "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql
        return fn

    return register


# SQL of operators as functions of the names of their input tables, so that whole plans can chain them.


def l2_pairs_sql(feature: str = "feature") -> str:
    return f"""
l2p AS (
  SELECT f.feature_id, f.mz, f.rt, f.dt, f.ccs, concat(l.name, ' (', l.adduct, ')') AS match,
         round_even((f.mz - l.mz) / l.mz * 1E6 * 100E0, 0) / 100E0 AS mass_error,
         round_even((f.ccs - l.ccs) / l.ccs * 100E0 * 100E0, 0) / 100E0 AS ccs_error,
         abs(f.rt - l.rt) AS rt_error
  FROM {feature} f JOIN library_l2 l
    ON l.mz >= f.mz - f.mz*15E0*1E-6 AND l.mz <= f.mz + f.mz*15E0*1E-6
   AND (f.ccs - l.ccs) / l.ccs * 100E0 BETWEEN -2E0 AND 2E0)"""


def annotated_sql(feature: str = "feature") -> str:
    return l2_pairs_sql(feature) + f""",
l5p AS (
  SELECT DISTINCT f.mz, l.name, round_even((f.mz - l.mz) / l.mz * 1E6 * 100E0, 0) / 100E0 AS mass_error
  FROM (SELECT DISTINCT mz FROM {feature}) f JOIN library_l5 l
    ON l.mz >= f.mz - f.mz*15E0*1E-6 AND l.mz <= f.mz + f.mz*15E0*1E-6),
annotated AS (
  SELECT feature_id, mz, rt, dt, ccs, match, 'likely' AS class FROM l2p
  UNION ALL
  SELECT f.feature_id, f.mz, f.rt, f.dt, f.ccs, coalesce(n.names, 'No Match'),
         CASE WHEN n.names IS NULL THEN 'unmatched' ELSE 'tentative' END
  FROM {feature} f LEFT JOIN (SELECT mz, string_agg(DISTINCT name, ' or ' ORDER BY name) AS names FROM l5p GROUP BY mz) n
    ON n.mz = f.mz
  WHERE f.feature_id NOT IN (SELECT feature_id FROM l2p))"""


L2_PAIRS, ANNOTATED = l2_pairs_sql(), annotated_sql()


def annotated(fx: Fixtures) -> DataFrame:
    p = Params()
    rows = match.annotate(fx.feature.select("feature_id", "mz", "rt", "dt", "ccs"), fx.library_l2, fx.library_l5,
                          p.ppm, p.ccs_pct, p.rt_tol, False)
    return cut_lineage(rows)


# --- row filters, projections, statistics -------------------------------------------------------

@query(
    f"SELECT e.feature_id, e.sample, {s('CASE WHEN e.value < b.level THEN 0E0 ELSE e.value - b.level END', 'value', '1E2')} FROM exp_i e "
    "LEFT JOIN (SELECT feature_id, max(value) AS level FROM intensity WHERE role='blank' GROUP BY 1) b "
    "ON b.feature_id = e.feature_id"
)
def blank_max(fx):
    left = blanks.subtract_blanks(fx.intensity, "1")
    return left.select("feature_id", "sample", scaled("value", "value", 1e2))


@query(
    f"SELECT e.feature_id, e.sample, {s('CASE WHEN e.value < b.level THEN 0E0 ELSE e.value - b.level END', 'value', '1E2')} FROM exp_i e "
    "LEFT JOIN (SELECT feature_id, avg(value) + 3E0 * coalesce(stddev_samp(value), 0E0) AS level FROM intensity "
    "WHERE role='blank' GROUP BY 1) b ON b.feature_id = e.feature_id"
)
def blank_mean_sd(fx):
    left = blanks.subtract_blanks(fx.intensity, "2", 3.0)
    return left.select("feature_id", "sample", scaled("value", "value", 1e2))


@query(f"SELECT feature_id, sample, {s('CASE WHEN value < 5E4 THEN 0E0 ELSE value END', 'value', '1E2')} FROM exp_i")
def min_intensity_mask(fx):
    return filters.mask_low_intensity(fx.exp_intensity, 5e4).select("feature_id", "sample", scaled("value", "value", 1e2))


@query(f"SELECT feature_id, {s('rt', 'rt')} FROM feature WHERE rt BETWEEN 2E0 AND 10E0")
def rt_range(fx):
    return filters.rt_range(fx.feature, 2.0, 10.0).select("feature_id", scaled("rt", "rt"))


@query(f"SELECT feature_id, {s('mz', 'mz')} FROM feature WHERE mz BETWEEN 200E0 AND 900E0")
def mz_range(fx):
    return filters.mz_range(fx.feature, 200.0, 900.0).select("feature_id", scaled("mz", "mz"))


@query(f"SELECT feature_id, {s('mz - round_even(mz, 0)', 'defect', '1E6')} FROM feature "
       "WHERE mz - round_even(mz, 0) BETWEEN -0.12E0 AND 0.11E0")
def mass_defect(fx):
    kept = filters.mass_defect_range(fx.feature, -0.12, 0.11)
    return kept.select("feature_id", scaled(F.col("mz") - F.rint("mz"), "defect", 1e6))


@query("SELECT feature_id FROM feature WHERE mz * 0.19E0 + 110.28E0 > ccs")
def density_line(fx):
    return filters.density_line(fx.feature).select("feature_id")


@query(
    "SELECT feature_id, "
    + ", ".join(s(f"round_even(mz * {k!r}E0, 0) - mz * {k!r}E0", f"kmd_{n}", "1E6") for n, k in KENDRICK_FACTORS.items())
    + " FROM feature"
)
def kendrick(fx):
    return fx.feature.select(
        "feature_id", *[scaled(kendrick_defect("mz", k), f"kmd_{n}", 1e6) for n, k in KENDRICK_FACTORS.items()]
    )


@query(
    "SELECT feature_id FROM exp_i GROUP BY 1 HAVING count(*) FILTER (value > 2E5) * 1E0 / "
    "(SELECT count(DISTINCT sample) FROM exp_i) >= 0.6E0"
)
def detection_freq_filter(fx):
    seen = filters.mask_low_intensity(fx.exp_intensity, 2e5 + 1e-3)
    return blanks.filter_by_frequency(fx.feature, seen, fx.exp_sample, 60.0).select("feature_id")


@query(
    f"SELECT feature_id, {s('count(*) FILTER (value > 0) * 1E0 / (SELECT count(DISTINCT sample) FROM exp_i) * 100E0', 'frequency')}, "
    f"{s('avg(value)', 'abundance', '1E1')} FROM exp_i GROUP BY feature_id"
)
def freq_and_abundance(fx):
    return blanks.detection(fx.exp_intensity, fx.exp_sample).select(
        "feature_id", scaled("detection_frequency", "frequency"), scaled("average_abundance", "abundance", 1e1)
    )


@query(
    "SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS mean_count, CAST(round_even(stddev_samp(n), 0) AS BIGINT) AS sd_count "
    "FROM (SELECT sample, count(*) FILTER (value > 0.001E0) AS n FROM intensity GROUP BY sample)"
)
def nonzero_stats(fx):
    return blanks.nonzero_stats(fx.intensity).select(
        F.col("mean_count").cast("long").alias("mean_count"), F.col("sd_count").cast("long").alias("sd_count")
    )


@query(
    "SELECT feature_id, " + ", ".join(
        s(f"round_even({c} * {10**n}E0, 0) / {10**n}E0", c) for c, n in (("mz", 4), ("ccs", 1), ("rt", 1), ("dt", 2))
    ) + " FROM feature"
)
def report_rounding(fx):
    rounded = report.round_report(fx.feature)
    return rounded.select("feature_id", *[scaled(c, c) for c in ("mz", "ccs", "rt", "dt")])


@query(
    "SELECT feature_id, " + ", ".join(f"CAST(round_even(coalesce(max(value) FILTER (sample = 'S{i}'), 0E0) * 1E2, 0) AS BIGINT) AS s{i}"
                                      for i in range(3, 8)) + " FROM feature LEFT JOIN exp_i USING (feature_id) GROUP BY feature_id"
)
def wide_report(fx):
    names = [f"S{i}" for i in range(3, 8)]
    wide = delimited.to_wide(fx.feature.select("feature_id"), fx.exp_intensity, names)
    return wide.select("feature_id", *[scaled(F.coalesce(n, F.lit(0.0)), n.lower(), 1e2) for n in names])


# --- library matching and removal ---------------------------------------------------------------

@query(
    f"SELECT feature_id, match, {s('mass_error', 'mass_error', '1E2')}, {s('ccs_error', 'ccs_error', '1E2')} FROM l2p",
    L2_PAIRS,
)
def l2_match(fx):
    rows = match.match_level2(fx.feature, fx.library_l2, 15.0, 2.0, 0.5, False)
    return rows.select("feature_id", "match", scaled("mass_error_ppm", "mass_error", 1e2), scaled("ccs_error_pct", "ccs_error", 1e2))


@query(
    f"SELECT feature_id, match, {s('round_even(rt_error * 100E0, 0) / 100E0', 'rt_error', '1E2')} FROM l2p WHERE rt_error <= 0.25E0",
    L2_PAIRS,
)
def l2_match_with_rt(fx):
    rows = match.match_level2(fx.feature, fx.library_l2, 15.0, 2.0, 0.25, True)
    return rows.select("feature_id", "match", scaled("rt_error", "rt_error", 1e2))


@query(
    "SELECT f.feature_id, n.match, n.errors FROM feature f JOIN (SELECT mz, string_agg(DISTINCT name, ' or ' ORDER BY name) AS match, "
    "string_agg(DISTINCT CAST(CAST(mass_error * 100E0 AS BIGINT) AS VARCHAR), ';') AS errors FROM l5p GROUP BY mz) n ON n.mz = f.mz",
    ANNOTATED,
)
def l5_match(fx):
    rows = match.match_level5(fx.feature, fx.library_l5, 15.0)
    errors = F.array_join(F.transform("mass_errors_ppm", lambda e: F.rint(e * 100.0).cast("long").cast("string")), ";")
    return rows.select("feature_id", "match", errors.alias("errors"))


@query("SELECT feature_id, match, class FROM annotated", ANNOTATED)
def annotated_report(fx):
    return annotated(fx).select("feature_id", "match", "class")


@query("SELECT class, count(*) AS n, count(DISTINCT feature_id) AS features FROM annotated GROUP BY class", ANNOTATED)
def class_counts(fx):
    return annotated(fx).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("features"))


def without_standards_sql(rows: str = "annotated") -> str:
    return f"""SELECT a.* FROM {rows} a WHERE a.class = 'likely' OR NOT EXISTS (
      SELECT 1 FROM standard t WHERE a.ccs BETWEEN t.ccs - t.ccs*2E0/100E0 AND t.ccs + t.ccs*2E0/100E0
        AND (a.mz BETWEEN t.mz - t.mz*15E0*1E-6 AND t.mz + t.mz*15E0*1E-6
          OR a.mz BETWEEN t.mz - 1E0 - t.mz*15E0*1E-6 AND t.mz - 1E0 + t.mz*15E0*1E-6))"""


def without_decay_sql(rows: str = "annotated") -> str:
    return f"""SELECT a.* FROM {rows} a WHERE a.feature_id NOT IN (
      SELECT o.feature_id FROM {rows} o JOIN {rows} l ON l.class = 'likely' AND o.class <> 'likely'
        AND o.mz >= l.mz - l.mz*10E0*1E-6 AND o.mz <= l.mz + l.mz*10E0*1E-6
        AND abs(l.rt - o.rt) < 1E0 AND o.ccs >= l.ccs * 1.03E0)"""


def prescreened_sql(rows: str = "annotated") -> str:
    return f"""SELECT a.* FROM {rows} a WHERE a.class = 'likely' OR a.feature_id NOT IN (
      SELECT f.feature_id FROM {rows} f JOIN library_l2 l ON l.mz >= f.mz - f.mz*15E0*1E-6 AND l.mz <= f.mz + f.mz*15E0*1E-6
      GROUP BY f.feature_id, f.ccs HAVING f.ccs > 1.03E0 * max(l.ccs))"""


@query(f"SELECT feature_id, class FROM ({without_standards_sql()})", ANNOTATED)
def standards_removal(fx):
    return match.remove_standards(annotated(fx), fx.standard, 15.0, 2.0).select("feature_id", "class")


@query(f"SELECT feature_id, class FROM ({without_decay_sql()})", ANNOTATED)
def post_source_decay(fx):
    return match.remove_source_decay(annotated(fx)).select("feature_id", "class")


@query(f"SELECT feature_id, class FROM ({prescreened_sql()})", ANNOTATED)
def ccs_prescreen(fx):
    return match.ccs_prescreen(annotated(fx), fx.library_l2, 15.0).select("feature_id", "class")


def losses_sql(feature: str = "feature") -> str:
    return "loss(label, mass) AS (VALUES " + ", ".join(f"('{n}', {m!r}E0)" for n, m in NEUTRAL_LOSSES) + "),\n" + f"""
masses AS (SELECT DISTINCT mz FROM {feature}),
loss_pairs AS (
  SELECT t.mz AS mz1, m.mz AS mz2, t.label FROM (SELECT mz, label, mz - mass AS target FROM masses, loss WHERE mz - mass > 0) t
  JOIN masses m ON m.mz >= target - target*15E0*1E-6 AND m.mz <= target + target*15E0*1E-6)"""


def without_losses_sql(rows: str = "annotated") -> str:
    return f"""SELECT * FROM {rows} WHERE mz NOT IN (
      SELECT mz2 FROM loss_pairs JOIN (SELECT mz, arg_min(class, feature_id) AS class FROM {rows} GROUP BY mz) f ON f.mz = mz2
      WHERE f.class <> 'likely')"""


def without_isotopes_sql(rows: str = "annotated", feature: str = "feature", fraction: str = "0.02E0") -> str:
    return f"""SELECT a.* FROM {rows} a WHERE a.feature_id NOT IN (
      SELECT j.feature_id FROM {feature} i, (VALUES (2E0), (4E0)) o(off), {feature} j
      WHERE j.mz BETWEEN i.mz + off - i.mz*15E0*1E-6 AND i.mz + off + i.mz*15E0*1E-6
        AND abs(i.ccs - j.ccs) <= greatest(i.ccs*{fraction}, j.ccs*{fraction}) AND abs(i.rt - j.rt) <= 0.5E0)"""


def without_chains_sql(rows: str = "feature") -> str:
    return f"""SELECT f.* FROM {rows} f WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT 12E0*n + 18.9984032E0*(2E0*n-1E0) AS m FROM range(1, 40) r(n)) c
      WHERE f.mz >= m - m*50E0*1E-6 AND f.mz <= m + m*50E0*1E-6)"""


LOSSES = losses_sql()


@query(f"SELECT {s('mz1', 'mz1', '1E6')}, {s('mz2', 'mz2', '1E6')}, label FROM loss_pairs", LOSSES)
def neutral_loss_pairs(fx):
    rows = match.neutral_loss_pairs(fx.feature, 15.0)
    return rows.select(scaled("mz1", "mz1", 1e6), scaled("mz2", "mz2", 1e6), "label")


RANKS = "ranked_mass AS (SELECT mz, row_number() OVER (ORDER BY mz) AS rank FROM (SELECT DISTINCT mz FROM feature))"


@query(
    f"SELECT {s('mz1', 'mz1', '1E6')}, label, min(rank) AS first_rank, max(rank) AS last_rank FROM loss_pairs JOIN ranked_mass ON mz = mz2 GROUP BY mz1, label",
    LOSSES, RANKS,
)
def neutral_loss_runs(fx):
    return match.neutral_loss_runs(fx.feature, 15.0).select(scaled("mz1", "mz1", 1e6), "label", "first_rank", "last_rank")


@query(f"SELECT feature_id, class FROM ({without_losses_sql()})", ANNOTATED, LOSSES)
def neutral_loss_removal(fx):
    return match.remove_neutral_losses(annotated(fx), 15.0).select("feature_id", "class")


@query(f"SELECT feature_id, class FROM ({without_isotopes_sql()})", ANNOTATED)
def m2_removal(fx):
    return match.remove_halogen_isotopes(annotated(fx), 15.0, 0.02, 0.5, order_result=False).select("feature_id", "class")


@query(f"SELECT feature_id, class FROM ({without_isotopes_sql(fraction='2E0')})", ANNOTATED)
def m2_removal_any_ccs(fx):
    p = Params()
    return match.remove_halogen_isotopes(annotated(fx), p.ppm, p.m2_ccs_fraction, p.rt_tol).select("feature_id", "class")


@query(f"SELECT feature_id FROM ({without_chains_sql()})")
def unsat_chain(fx):
    return filters.drop_unsaturated_chains(fx.feature).select("feature_id")


# --- order-dependent removal --------------------------------------------------------------------

def adducts_sql(feature: str = "feature") -> str:
    return "rule(label, a, b) AS (VALUES " + ", ".join(f"('{n}', {a!r}E0, {b!r}E0)" for n, a, b in ADDUCT_RULES) + "),\n" + f"""
mass AS (SELECT mz, row_number() OVER (ORDER BY mz) AS i FROM (SELECT DISTINCT mz FROM {feature})),
adduct_edge AS (
  SELECT t.i, t.mz AS mz1, m.i AS i2, m.mz AS mz2, t.label
  FROM (SELECT i, mz, label, a*mz + b AS target FROM mass, rule) t
  JOIN mass m ON m.mz >= target - target*10E0*1E-6 AND m.mz <= target + target*10E0*1E-6),
source AS MATERIALIZED (SELECT i, list(DISTINCT i2) AS js, row_number() OVER (ORDER BY i) AS k FROM adduct_edge GROUP BY i),
walk(k, matched) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT s.k, CASE WHEN list_contains(w.matched, s.i) THEN w.matched ELSE list_concat(w.matched, s.js) END
  FROM walk w JOIN source s ON s.k = w.k + 1),
matched AS (SELECT DISTINCT unnest(matched) AS i FROM walk WHERE k = (SELECT max(k) FROM walk))"""


def without_adducts_sql(rows: str = "annotated") -> str:
    return f"SELECT * FROM {rows} WHERE class = 'likely' OR mz NOT IN (SELECT mz FROM mass WHERE i IN (SELECT i FROM matched))"


ADDUCT_CTES = adducts_sql()


@query(
    f"SELECT {s('mz1', 'mz1', '1E6')}, {s('mz2', 'mz2', '1E6')}, label FROM adduct_edge WHERE i NOT IN (SELECT i FROM matched)",
    ADDUCT_CTES,
)
def adduct_pairs(fx):
    rows = cleanup.adduct_pairs(fx.feature, 10.0)
    return rows.select(scaled("mz1", "mz1", 1e6), scaled("mz2", "mz2", 1e6), "label")


@query(
    f"SELECT {s('mz1', 'mz1', '1E6')}, label, min(rank) AS first_rank, max(rank) AS last_rank FROM adduct_edge JOIN ranked_mass ON mz = mz2 "
    "WHERE i NOT IN (SELECT i FROM matched) GROUP BY mz1, label",
    ADDUCT_CTES, RANKS,
)
def adduct_runs(fx):
    return cleanup.adduct_runs(fx.feature, 10.0).select(scaled("mz1", "mz1", 1e6), "label", "first_rank", "last_rank")


@query(f"SELECT feature_id, class FROM ({without_adducts_sql()})", ANNOTATED, ADDUCT_CTES)
def adduct_removal(fx):
    return cleanup.remove_adducts(annotated(fx), 10.0).select("feature_id", "class")


def smear_sql(values: str = "exp_i", feature: str = "feature") -> str:
    return f"""v AS (SELECT e.sample, e.feature_id AS id, e.value, f.mz, f.rt, f.ccs FROM {values} e JOIN {feature} f USING (feature_id) WHERE e.value > 0),
smear_edge AS (
  SELECT i.sample, i.id AS i, i.mz, j.id AS j FROM v i JOIN v j ON i.sample = j.sample AND j.mz >= i.mz - 2E0
   AND (j.mz < i.mz OR (j.mz = i.mz AND j.id < i.id)) AND abs(j.ccs - i.ccs) / i.ccs * 100E0 < 2E0 AND abs(j.rt - i.rt) <= 0.5E0
   AND j.value > 50E0 * i.value),
target AS MATERIALIZED (SELECT sample, i, list(j) AS js, row_number() OVER (PARTITION BY sample ORDER BY mz, i) AS k FROM smear_edge GROUP BY sample, i, mz),
steps(sample, k, gone) AS (
  SELECT DISTINCT sample, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM target
  UNION ALL
  SELECT t.sample, t.k, CASE WHEN len(list_filter(t.js, lambda x: NOT list_contains(p.gone, x))) > 0 THEN list_append(p.gone, t.i) ELSE p.gone END
  FROM steps p JOIN target t ON t.sample = p.sample AND t.k = p.k + 1),
last_step AS (SELECT sample, arg_max(gone, k) AS gone FROM steps GROUP BY sample),
zeroed AS (SELECT sample, unnest(gone) AS i FROM last_step)"""


def unsmeared_sql(values: str = "exp_i") -> str:
    return f"""SELECT e.feature_id, e.sample, CASE WHEN z.i IS NULL THEN e.value ELSE 0E0 END AS value FROM {values} e
    LEFT JOIN zeroed z ON z.i = e.feature_id AND z.sample = e.sample"""


@query(f"SELECT feature_id, sample, {s('value', 'value', '1E2')} FROM ({unsmeared_sql()})", smear_sql())
def smearing(fx):
    rows = cleanup.smearing(fx.feature, fx.exp_intensity)
    return rows.select("feature_id", "sample", scaled("value", "value", 1e2))


# --- grouping -----------------------------------------------------------------------------------

def duplicates_sql(feature: str = "feature") -> str:
    return f"""
dup_edge AS MATERIALIZED (
  SELECT a.feature_id AS x, b.feature_id AS y FROM {feature} a JOIN {feature} b ON a.feature_id <> b.feature_id
   AND abs(a.mz-b.mz) <= greatest(a.mz, b.mz)*15E0*1E-6 AND abs(a.mz-b.mz) <= least(a.mz, b.mz)*2E-5
   AND abs(a.ccs-b.ccs) <= greatest(a.ccs, b.ccs)*2E0/100E0 AND abs(a.rt-b.rt) <= 0.5E0),
reach(node, r) AS (SELECT DISTINCT x, x FROM dup_edge UNION SELECT e.y, r FROM reach JOIN dup_edge e ON e.x = node),
dup_group AS (SELECT node AS feature_id, min(r) AS component FROM reach GROUP BY node)"""


DUPLICATES = duplicates_sql()


@query("SELECT feature_id, component FROM dup_group", DUPLICATES)
def dup_components(fx):
    return cleanup.duplicate_groups(fx.feature, 15.0, 2.0, 0.5)


@query(
    f"SELECT max(f.feature_id) AS feature_id, {s('avg(mz)', 'mz')}, {s('avg(rt)', 'rt')}, {s('avg(ccs)', 'ccs')}, {s('avg(dt)', 'dt')}, "
    "count(*) AS members FROM feature f LEFT JOIN dup_group g USING (feature_id) GROUP BY coalesce(component, f.feature_id)",
    DUPLICATES,
)
def dup_merge(fx):
    groups = cut_lineage(cleanup.duplicate_groups(fx.feature, 15.0, 2.0, 0.5))
    kept, _ = cleanup.merge_duplicates(fx.feature, fx.exp_intensity, groups)
    return kept.select("feature_id", *[scaled(c, c) for c in ("mz", "rt", "ccs", "dt")], "members")


@query(
    f"SELECT k.kept AS feature_id, e.sample, {s('max(e.value)', 'value', '1E2')} FROM exp_i e JOIN (SELECT f.feature_id, "
    "max(f.feature_id) OVER (PARTITION BY coalesce(component, f.feature_id)) AS kept FROM feature f LEFT JOIN dup_group g USING (feature_id)) k "
    "ON k.feature_id = e.feature_id GROUP BY k.kept, e.sample",
    DUPLICATES,
)
def dup_merge_intensity(fx):
    groups = cut_lineage(cleanup.duplicate_groups(fx.feature, 15.0, 2.0, 0.5))
    _, moved = cleanup.merge_duplicates(fx.feature, fx.exp_intensity, groups)
    return moved.select("feature_id", "sample", scaled("value", "value", 1e2))


def crowd_sql(rows: str = "annotated") -> str:
    return f"""
open_mass AS MATERIALIZED (SELECT mz, count(*) AS n FROM {rows} WHERE class <> 'likely' GROUP BY mz),
hop AS MATERIALIZED (SELECT a.mz AS x, min(b.mz) AS y FROM open_mass a JOIN open_mass b ON b.mz > a.mz + a.mz*50E0*1E-6 GROUP BY a.mz),
anchors(x) AS (SELECT min(mz) FROM open_mass UNION ALL SELECT h.y FROM anchors a JOIN hop h ON h.x = a.x),
window_of AS (SELECT m.mz, m.n, max(a.x) AS anchor FROM open_mass m JOIN anchors a ON a.x <= m.mz GROUP BY m.mz, m.n),
crowd AS (SELECT anchor FROM window_of GROUP BY anchor HAVING sum(n) >= 3)"""


def without_crowds_sql(rows: str = "annotated") -> str:
    return f"SELECT * FROM {rows} WHERE class = 'likely' OR mz NOT IN (SELECT mz FROM window_of WHERE anchor IN (SELECT anchor FROM crowd))"


CROWD = crowd_sql()


@query(f"SELECT feature_id, class FROM ({without_crowds_sql()})", ANNOTATED, CROWD)
def crowd_elimination(fx):
    return cleanup.crowd_elimination(annotated(fx)).select("feature_id", "class")


NESTED = """
m0 AS MATERIALIZED (SELECT DISTINCT mz FROM feature),
hop_m AS MATERIALIZED (SELECT a.mz AS x, min(b.mz) AS y FROM m0 a JOIN m0 b ON b.mz > a.mz + a.mz*10E0*1E-6 GROUP BY a.mz),
anchor_m(x) AS (SELECT min(mz) FROM m0 UNION ALL SELECT h.y FROM anchor_m a JOIN hop_m h ON h.x = a.x),
g1 AS MATERIALIZED (SELECT f.feature_id, f.mz, f.rt, f.dt, f.ccs, max(a.x) AS ma FROM feature f JOIN anchor_m a ON a.x <= f.mz GROUP BY ALL),
hop_c AS MATERIALIZED (SELECT a.ma, a.ccs AS x, min(b.ccs) AS y FROM g1 a JOIN g1 b ON a.ma = b.ma AND b.ccs > a.ccs*(1E0 + 2E0/100E0) GROUP BY a.ma, a.ccs),
anchor_c(ma, x) AS (SELECT ma, min(ccs) FROM g1 GROUP BY ma UNION ALL SELECT h.ma, h.y FROM anchor_c a JOIN hop_c h ON h.ma = a.ma AND h.x = a.x),
g2 AS MATERIALIZED (SELECT f.feature_id, f.mz, f.rt, f.dt, f.ccs, f.ma, max(a.x) AS ca FROM g1 f JOIN anchor_c a ON a.ma = f.ma AND a.x <= f.ccs GROUP BY ALL),
hop_r AS MATERIALIZED (SELECT a.ma, a.ca, a.rt AS x, min(b.rt) AS y FROM g2 a JOIN g2 b ON a.ma = b.ma AND a.ca = b.ca AND b.rt > a.rt + 0.5E0 GROUP BY a.ma, a.ca, a.rt),
anchor_r(ma, ca, x) AS (SELECT ma, ca, min(rt) FROM g2 GROUP BY ma, ca UNION ALL SELECT h.ma, h.ca, h.y FROM anchor_r a JOIN hop_r h ON h.ma = a.ma AND h.ca = a.ca AND h.x = a.x),
g3 AS (SELECT f.feature_id, f.mz, f.rt, f.dt, f.ccs, f.ma, f.ca, max(a.x) AS ra FROM g2 f JOIN anchor_r a ON a.ma = f.ma AND a.ca = f.ca AND a.x <= f.rt GROUP BY ALL)"""


@query(
    f"SELECT feature_id, class FROM ({without_chains_sql('open_row')})",
    ANNOTATED,
    f"pre AS MATERIALIZED ({prescreened_sql()})," + crowd_sql("pre") + f",\nopen_row AS ({without_crowds_sql('pre')})",
)
def combined_filter(fx):
    return screen_plan.combined_filter(annotated(fx), fx.library_l2).select("feature_id", "class")


@query(
    f"SELECT feature_id, {s('ma', 'mz_anchor')}, {s('ca', 'ccs_anchor')}, {s('ra', 'rt_anchor')} FROM g3", NESTED
)
def mz_ccs_rt_groups(fx):
    rows = cleanup.nested_groups(fx.feature, 10.0, 2.0, 0.5)
    return rows.select("feature_id", *[scaled(c, c) for c in ("mz_anchor", "ccs_anchor", "rt_anchor")])


@query(
    "SELECT arg_min(feature_id, (rt, feature_id)) AS feature_id, " + ", ".join(s(f"avg({c})", c) for c in ("mz", "rt", "dt", "ccs"))
    + " FROM g3 GROUP BY ma, ca, ra", NESTED,
)
def nested_merge(fx):
    grouped = cut_lineage(cleanup.nested_groups(fx.feature, 10.0, 2.0, 0.5))
    merged, _ = cleanup.merge_nested_groups(grouped, fx.exp_intensity)
    return merged.select("feature_id", *[scaled(c, c) for c in ("mz", "rt", "dt", "ccs")])


@query(
    "SELECT feature_id, CAST(sum(CASE WHEN abs(kmd - pk) >= (mz + pm) * 1E-5 OR pk IS NULL THEN 1 ELSE 0 END) "
    "OVER (ORDER BY kmd, mz, feature_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS series_cf2 FROM kp",
    f"""k AS (SELECT feature_id, mz, round_even(mz * {KENDRICK_FACTORS['cf2']!r}E0, 0) - mz * {KENDRICK_FACTORS['cf2']!r}E0 AS kmd FROM feature),
kp AS (SELECT *, lag(kmd) OVER (ORDER BY kmd, mz, feature_id) AS pk, lag(mz) OVER (ORDER BY kmd, mz, feature_id) AS pm FROM k)""",
)
def kmd_series(fx):
    rows = fx.feature.select("feature_id", "mz", kendrick_defect("mz", KENDRICK_FACTORS["cf2"]).alias("kmd"))
    return cleanup.kendrick_series(rows, "kmd", "series_cf2", 10.0).select("feature_id", F.col("series_cf2").cast("long").alias("series_cf2"))


@query(
    """SELECT feature_id FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain i, (VALUES (1E0), (2E0), (3E0)) z(z)
      WHERE c.mz BETWEEN i.mz + 1E0/z - i.mz*1E0*1E-6/z AND i.mz + 1E0/z + i.mz*1E0*1E-6/z
        AND abs(c.rt - i.rt) <= 0.5E0 AND abs(c.ccs - i.ccs) / i.ccs * 100E0 <= 0.5E0)""",
    """chain AS (SELECT feature_id, mz, rt, ccs FROM feature
  UNION ALL SELECT 50000000 + feature_id, mz + 1E0, rt, ccs FROM feature WHERE src % 3 = 0
  UNION ALL SELECT 60000000 + feature_id, mz + 0.5E0, rt + 0.4E0, ccs * 1.004E0 FROM feature WHERE src % 5 = 0)""",
)
def deisotope(fx):
    f = fx.feature
    steps = f.select("feature_id", "mz", "rt", "ccs").unionByName(
        f.where("src % 3 = 0").select((F.col("feature_id") + 50000000).alias("feature_id"), (F.col("mz") + 1.0).alias("mz"), "rt", "ccs")
    ).unionByName(
        f.where("src % 5 = 0").select((F.col("feature_id") + 60000000).alias("feature_id"), (F.col("mz") + 0.5).alias("mz"),
                                      (F.col("rt") + 0.4).alias("rt"), (F.col("ccs") * 1.004).alias("ccs"))
    )
    return cleanup.deisotope(steps).select("feature_id")


# --- homologous series --------------------------------------------------------------------------

SERIES = "unit(name, m) AS (VALUES " + ", ".join(f"('{n}', {m!r}E0)" for n, m in UNITS.items()) + "),\n" + """
stacked AS (
  SELECT feature_id AS row_id, class, ccs, rt, mz FROM annotated
  UNION ALL SELECT -lib_id - 1, 'External Standard', ccs, rt, mz FROM library_l2),
sm AS (SELECT DISTINCT mz FROM stacked),
st AS (SELECT mz, name, k, mz + m*k AS target FROM sm, unit, (VALUES (1), (2), (3)) x(k)),
near AS (
  SELECT t.mz, t.name, t.k, c.mz AS mz_to, row_number() OVER (PARTITION BY t.mz, t.name, t.k ORDER BY abs(c.mz - target), c.mz) AS rn
  FROM st t JOIN sm c ON c.mz > t.mz AND c.mz >= target - (15E0/1E6)*target AND c.mz <= target + (15E0/1E6)*target),
s_edge AS (SELECT mz, name, k, mz_to FROM near WHERE rn = 1),
s_sym AS MATERIALIZED (SELECT DISTINCT mz AS x, mz_to AS y FROM s_edge UNION SELECT DISTINCT mz_to, mz FROM s_edge),
s_reach(node, r) AS (SELECT DISTINCT x, x FROM s_sym UNION SELECT e.y, r FROM s_reach JOIN s_sym e ON e.x = node),
s_comp AS MATERIALIZED (SELECT node AS mz, min(r) AS comp FROM s_reach GROUP BY node),
s_member AS (
  SELECT k.row_id, k.class, k.ccs, k.rt, k.mz, c.comp FROM stacked k JOIN s_comp c ON c.mz = k.mz
  WHERE k.mz IN (SELECT mz FROM s_edge) OR k.row_id = (SELECT min(row_id) FROM stacked q WHERE q.mz = k.mz)),
s_hop AS MATERIALIZED (SELECT a.comp, a.mz AS x, min(b.mz) AS y FROM s_comp a JOIN s_comp b ON a.comp = b.comp AND b.mz >= a.mz + 10E0 GROUP BY a.comp, a.mz),
s_count(comp, x) AS (SELECT comp, min(mz) FROM s_comp GROUP BY comp UNION ALL SELECT h.comp, h.y FROM s_count a JOIN s_hop h ON h.comp = a.comp AND h.x = a.x),
s_valid AS (
  SELECT m.comp, min(m.row_id) AS group_id FROM s_member m GROUP BY m.comp
  HAVING count(*) >= 3 AND bool_or(m.class <> 'External Standard') AND (SELECT count(*) FROM s_count c WHERE c.comp = m.comp) >= 3),
s_group AS (SELECT m.row_id, m.class, m.ccs, m.rt, m.mz, v.group_id FROM s_member m JOIN s_valid v ON v.comp = m.comp),
s_prev AS (SELECT *, lag(mz) OVER w AS pm, lag(ccs) OVER w AS pc, lag(rt) OVER w AS pr FROM s_group WINDOW w AS (PARTITION BY group_id ORDER BY mz, row_id, class)),
s_kept AS (SELECT row_id, class, ccs, rt, mz, group_id FROM s_prev
  WHERE NOT (coalesce(mz - pm >= 10E0, false) AND (coalesce(ccs <= pc, false) OR coalesce(rt <= pr, false)))),
s_step AS (SELECT *, mz - lag(mz) OVER (PARTITION BY group_id ORDER BY mz, row_id, class) AS step FROM s_kept),
s_fine AS (SELECT group_id FROM s_step GROUP BY group_id HAVING count(*) FILTER (coalesce(step >= 10E0, true)) >= 3)"""


def _stacked(fx: Fixtures) -> DataFrame:
    return cut_lineage(series.stack_library(annotated(fx), fx.library_l2))


@query(f"SELECT {s('mz', 'mz', '1E6')}, name AS unit, k AS multiple, {s('mz_to', 'mz_to', '1E6')} FROM s_edge", ANNOTATED, SERIES)
def series_edges(fx):
    rows = series.series_edges(_stacked(fx), UNITS, 15.0)
    return rows.select(scaled("mz", "mz", 1e6), "unit", "multiple", scaled("mz_to", "mz_to", 1e6))


@query("SELECT row_id, class, group_id FROM s_group", ANNOTATED, SERIES)
def series_groups(fx):
    return series.series_groups(_stacked(fx), UNITS, 15.0, 3).select("row_id", "class", "group_id")


@query("SELECT row_id, class, group_id FROM s_kept WHERE group_id IN (SELECT group_id FROM s_fine)", ANNOTATED, SERIES)
def series_refined(fx):
    groups = cut_lineage(series.series_groups(_stacked(fx), UNITS, 15.0, 3))
    return series.refine_groups(groups, 3).select("row_id", "class", "group_id")


TRENDS = SERIES + """,
t_point AS MATERIALIZED (SELECT * FROM s_kept WHERE group_id IN (SELECT group_id FROM s_fine)),
t_limit AS MATERIALIZED (SELECT avg(ccs) * 0.02E0 AS lim FROM t_point),
t_round(r, group_id, row_id, mz, ccs, win) AS (
  SELECT 0, group_id, row_id, mz, ccs, NULL::BIGINT FROM t_point
  UNION ALL
  SELECT r + 1, group_id, row_id, mz, ccs, win FROM (
    WITH free AS (
      SELECT r, group_id, row_id, mz, ccs, row_number() OVER (PARTITION BY group_id ORDER BY mz, row_id) - 1 AS rn, count(*) OVER (PARTITION BY group_id) AS n
      FROM t_round WHERE win IS NULL),
    pairs AS (
      SELECT DISTINCT group_id, least(a, b) AS i, greatest(a, b) AS j FROM (
        SELECT group_id, i AS a, (i + 1 + CAST(floor(((t * 0.6180339887498949E0) % 1) * (n - 1)) AS BIGINT)) % n AS b
        FROM (SELECT g.group_id, g.n, t, t * g.n // 200 AS i FROM (SELECT DISTINCT group_id, n FROM free WHERE n >= 2) g, range(200) d(t)))),
    line AS (
      SELECT DISTINCT group_id, slope, y0 - slope * x0 AS intercept FROM (
        SELECT d.group_id, p.mz AS x0, p.ccs AS y0, (q.ccs - p.ccs) / (q.mz - p.mz) AS slope
        FROM pairs d JOIN free p ON p.group_id = d.group_id AND p.rn = d.i JOIN free q ON q.group_id = d.group_id AND q.rn = d.j WHERE p.mz <> q.mz)
      WHERE slope BETWEEN 0.05E0 AND 0.25E0),
    near AS (
      SELECT p.group_id, p.row_id, l.slope, l.intercept, round_even(abs(p.ccs - (l.slope * p.mz + l.intercept)) * 1E6, 0) AS miss
      FROM free p JOIN line l ON l.group_id = p.group_id, t_limit WHERE abs(p.ccs - (l.slope * p.mz + l.intercept)) <= lim),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, loss, slope, intercept) AS place, max(n) OVER (PARTITION BY group_id) AS most
      FROM (SELECT group_id, slope, intercept, count(*) AS n, sum(miss) AS loss FROM near GROUP BY ALL HAVING count(*) >= 2)),
    seen AS (
      SELECT n.group_id, n.row_id, k.place, k.n, k.most, min(k.place) OVER (PARTITION BY n.group_id, n.row_id) AS first
      FROM near n JOIN ranked k ON k.group_id = n.group_id AND k.slope = n.slope AND k.intercept = n.intercept),
    winner AS (SELECT group_id, place FROM seen GROUP BY group_id, place HAVING min(first) = place AND max(first) = place AND 2 * any_value(n) >= any_value(most)),
    won AS (SELECT DISTINCT s.group_id, s.row_id, s.place FROM seen s JOIN winner w ON w.group_id = s.group_id AND w.place = s.place)
    SELECT f.r, f.group_id, f.row_id, f.mz, f.ccs, f.r * 1000 + w.place AS win
    FROM free f LEFT JOIN won w ON w.group_id = f.group_id AND w.row_id = f.row_id WHERE f.group_id IN (SELECT group_id FROM ranked))),
t_won AS MATERIALIZED (SELECT * FROM t_round WHERE win IS NOT NULL),
t_fit AS (
  SELECT group_id, win, row_number() OVER (PARTITION BY group_id ORDER BY win) - 1 AS trend, coalesce(regr_r2(ccs, mz), 0E0) AS r_squared
  FROM t_won GROUP BY group_id, win),
t_taken AS (SELECT DISTINCT w.group_id, w.row_id, CAST(f.trend AS INTEGER) AS trend FROM t_won w JOIN t_fit f ON f.group_id = w.group_id AND f.win = w.win),
t_out AS MATERIALIZED (
  SELECT p.row_id, p.class, p.group_id, p.mz, p.ccs, t.trend, f.r_squared FROM t_point p
  LEFT JOIN t_taken t ON t.group_id = p.group_id AND t.row_id = p.row_id LEFT JOIN t_fit f ON f.group_id = t.group_id AND f.trend = t.trend),
t_step AS (SELECT group_id, mz - lag(mz) OVER (PARTITION BY group_id ORDER BY mz, row_id) AS step FROM t_out WHERE trend IS NOT NULL),
t_good AS (SELECT group_id FROM t_step GROUP BY group_id HAVING count(*) FILTER (coalesce(step >= 10E0, true)) >= 3),
t_done AS MATERIALIZED (SELECT *, trend IS NULL OR group_id NOT IN (SELECT group_id FROM t_good) AS is_outlier FROM t_out)"""


@query(f"SELECT row_id, class, group_id, trend, is_outlier, {s('r_squared', 'r_squared')} FROM t_done", ANNOTATED, TRENDS)
def trend_outliers(fx):
    outcome = series_plan.find_series(annotated(fx), fx.library_l2, UNITS)
    return outcome.select("row_id", "class", "group_id", "trend", "is_outlier", scaled("r_squared", "r_squared"))


@query(
    f"""SELECT group_id, count(*) AS points, {s('regr_slope(ccs, mz)', 'slope', '1E6')}, {s('regr_intercept(ccs, mz)', 'intercept')}
    FROM t_done WHERE NOT is_outlier GROUP BY group_id HAVING count(*) >= 2""",
    ANNOTATED, TRENDS,
)
def trend_lines(fx):
    outcome = cut_lineage(series_plan.find_series(annotated(fx), fx.library_l2, UNITS))
    return regress.trend_lines(outcome).select("group_id", "points", scaled("slope", "slope", 1e6), scaled("intercept", "intercept"))


# --- isotopes -----------------------------------------------------------------------------------

PEAKS = f"""
ranked AS (SELECT source_file, compound, peak_mz, peak_intensity, row_number() OVER (PARTITION BY source_file, compound ORDER BY peak_mz, peak_intensity) AS n FROM peak),
first3 AS (
  SELECT source_file, compound, max(peak_mz) FILTER (n = 1) AS m1, max(peak_intensity) FILTER (n = 1) AS i1, max(peak_mz) FILTER (n = 2) AS m2,
         max(peak_intensity) FILTER (n = 2) AS i2, max(peak_intensity) FILTER (n = 3) AS i3
  FROM ranked GROUP BY source_file, compound HAVING count(*) >= 2),
carbon AS (
  SELECT *, regexp_extract(source_file, '^(.*)[.]cef$', 1) AS sample, (i2 / i1) * {1 / isotope.NATURAL_C13!r}E0 AS c, m1 - round_even(m1, 0) AS md
  FROM first3 WHERE NOT coalesce(i1 = 0, false) AND NOT coalesce(i2 / i1 = 0, false)),
anchor AS (
  SELECT DISTINCT e.sample, p.compound, f.feature_id, f.class, f.mz, f.rt, f.dt, f.ccs, e.value AS intensity
  FROM exp_i e JOIN annotated f ON f.feature_id = e.feature_id AND e.value > 0
  JOIN peak p ON p.source_file = concat(e.sample, '.cef') AND round_even(p.peak_intensity, 0) = round_even(e.value, 0)
   AND p.peak_mz >= f.mz - f.mz*10E0*1E-6 AND p.peak_mz <= f.mz + f.mz*10E0*1E-6
   AND abs(f.ccs - p.ccs) / f.ccs * 100E0 <= 2E0 AND abs(f.rt - p.rt) <= 1E0
  WHERE (p.source_file, p.compound) IN (SELECT source_file, compound FROM peak GROUP BY ALL HAVING count(peak_mz) > 1))"""


@query(
    f"SELECT source_file, compound, {s('m1', 'peak_mz_1')}, {s('i1', 'intensity_1', '1E1')}, {s('m2', 'peak_mz_2')}, {s('i2', 'intensity_2', '1E1')}, "
    f"{s('i3', 'intensity_3', '1E1')} FROM first3", ANNOTATED, PEAKS,
)
def first_peaks(fx):
    rows = isotope.first_peaks(fx.peak)
    return rows.select("source_file", "compound", scaled("peak_mz_1", "peak_mz_1"), scaled("intensity_1", "intensity_1", 1e1),
                       scaled("peak_mz_2", "peak_mz_2"), scaled("intensity_2", "intensity_2", 1e1), scaled("intensity_3", "intensity_3", 1e1))


@query(
    f"SELECT source_file, compound, {s('c', 'carbon')}, {s('m1/c', 'm_over_c')}, {s('md', 'mass_defect', '1E6')}, {s('md/c', 'md_over_c', '1E6')} FROM carbon",
    ANNOTATED, PEAKS,
)
def carbon_estimate(fx):
    rows = isotope.carbon_estimate(fx.peak)
    return rows.select("source_file", "compound", scaled("carbon_estimate", "carbon"), scaled("m_over_c", "m_over_c"),
                       scaled("mass_defect", "mass_defect", 1e6), scaled("md_over_c", "md_over_c", 1e6))


@query(
    f"""SELECT source_file, compound, {s('CASE WHEN i1 > 0 THEN i3/i1 END', 'm2_ratio')},
    CASE WHEN i1 > 0 AND i3/i1 > 0.28E0 THEN 'Potential Cl, Br present' WHEN i3 = 0 OR i3 IS NULL THEN 'No M+2 peak detected - insufficient signal'
    ELSE 'No Cl or Br isotopic pattern detected' END AS isotope_status FROM carbon""", ANNOTATED, PEAKS,
)
def halogen_class(fx):
    rows = isotope.halogen_class(isotope.carbon_estimate(fx.peak))
    return rows.select("source_file", "compound", scaled("m2_ratio", "m2_ratio"), "isotope_status")


def _anchors(fx: Fixtures, peaks: DataFrame | None = None, by_feature: bool = True) -> DataFrame:
    found = isotope.sample_anchors(annotated(fx), fx.exp_intensity, fx.peak if peaks is None else peaks, by_feature=by_feature)
    return cut_lineage(found)


@query(
    f"SELECT sample, compound, feature_id, class, {s('intensity', 'intensity', '1E2')} FROM anchor", ANNOTATED, PEAKS
)
def sample_match(fx):
    rows = _anchors(fx).select("sample", "compound", "feature_id", "class", scaled("intensity", "intensity", 1e2))
    return rows.distinct()


@query(
    f"""SELECT a.sample, a.compound, a.class, {s('a.mz', 'mz')}, {s('p.peak_mz', 'peak_mz')}, {s('c.c', 'carbon')}
    FROM (SELECT DISTINCT n.sample, n.compound, n.class, f.match, n.mz, n.rt, n.dt, n.ccs, n.intensity FROM anchor n JOIN annotated f USING (feature_id, class)) a
    LEFT JOIN peak p ON p.source_file = concat(a.sample, '.cef') AND p.compound = a.compound
    LEFT JOIN carbon c ON c.sample = a.sample AND c.compound = a.compound""", ANNOTATED, PEAKS,
)
def sample_report(fx):
    rows = isotope.sample_report(_anchors(fx), fx.peak)
    return rows.select("sample", "compound", "class", scaled("mz", "mz"), scaled("peak_mz", "peak_mz"), scaled("carbon_estimate", "carbon"))


ALIGN = """
an AS (SELECT concat(sample, '/', lpad(CAST(compound AS VARCHAR), 19, '0')) AS k, * FROM anchor),
al_edge AS (
  SELECT DISTINCT a.k AS x, b.k AS y FROM an a JOIN an b ON a.sample <> b.sample
   AND b.mz BETWEEN a.mz - a.mz*10E0*1E-6 AND a.mz + a.mz*10E0*1E-6 AND abs(a.ccs - b.ccs) / a.ccs * 100E0 <= 2E0),
al_sym AS MATERIALIZED (SELECT x, y FROM al_edge UNION SELECT y, x FROM al_edge),
al_reach(node, r) AS (SELECT DISTINCT k, k FROM an UNION SELECT e.y, r FROM al_reach JOIN al_sym e ON e.x = node),
al AS (SELECT node AS k, min(r) AS alignment_id FROM al_reach GROUP BY node)"""


@query("SELECT DISTINCT an.sample, an.compound, al.alignment_id FROM an JOIN al USING (k)", ANNOTATED, PEAKS + "," + ALIGN)
def align_components(fx):
    rows = isotope.align(isotope.distinct_anchors(_anchors(fx, cut_lineage(fx.peak), by_feature=False)))
    return rows.select("sample", "compound", "alignment_id").distinct()


ROW_OF = ALIGN + """,
row_of AS (SELECT DISTINCT al.alignment_id, an.sample, an.compound, f.match, an.class, an.mz, an.rt, an.dt, an.ccs, an.intensity, c.c, c.md, c.m1, c.i1, c.i2, c.i3
  FROM an JOIN al USING (k) JOIN annotated f USING (feature_id, class) LEFT JOIN carbon c ON c.sample = an.sample AND c.compound = an.compound)"""
#: Column of the summary, its SQL over `row_of`, the scale it is compared at.
SUMMARY_MEANS = [
    ("mz", "mz", 1e4), ("ccs", "ccs", 1e4), ("dt", "dt", 1e4), ("rt", "rt", 1e4), ("carbon_estimate", "c", 1e4), ("m_over_c", "m1/c", 1e4),
    ("mass_defect", "md", 1e6), ("md_over_c", "md/c", 1e6), ("peak_mz_1", "m1", 1e4), ("intensity_1", "i1", 1e1), ("intensity_2", "i2", 1e1),
    ("intensity_3", "i3", 1e1),
]
SUMMARY_SDS = [("carbon_estimate_sd", "c", 1e2), ("m_over_c_sd", "m1/c", 1e2), ("mass_defect_sd", "md", 1e4)]
_SUMMARY = ", ".join([s(f"avg({x})", n, f"{k:.0E}") for n, x, k in SUMMARY_MEANS] + [s(f"stddev_samp({x})", n, f"{k:.0E}") for n, x, k in SUMMARY_SDS])


def _aligned(fx: Fixtures) -> DataFrame:
    peaks = cut_lineage(fx.peak)  # read several times, and costly to make
    return cut_lineage(isotope.align(isotope.anchors_with_metrics(_anchors(fx, peaks, by_feature=False), peaks)))


@query(
    f"""SELECT t.*, {s('v.total / (SELECT count(DISTINCT sample) FROM anchor)', 'mean_intensity', '1E1')}, v.detection_count
    FROM (SELECT alignment_id, count(*) AS n_rows, arg_min(match, (sample, compound, mz, class, match)) AS match, arg_min(class, (sample, compound, mz, class, match)) AS class,
      {_SUMMARY} FROM row_of GROUP BY 1) t
    JOIN (SELECT alignment_id, sum(m) AS total, count(m) AS detection_count FROM (SELECT alignment_id, sample, avg(intensity) AS m FROM row_of GROUP BY 1, 2) GROUP BY 1) v
      ON v.alignment_id = t.alignment_id""",
    ANNOTATED, PEAKS + "," + ROW_OF,
)
def align_summary(fx):
    aligned = _aligned(fx)
    counts = aligned.groupBy("alignment_id").agg(F.count(F.lit(1)).alias("n_rows"))
    summary = isotope.alignment_summary(aligned).join(counts, "alignment_id")
    return summary.select(
        "alignment_id", "n_rows", "match", "class", *[scaled(n, n, k) for n, _, k in SUMMARY_MEANS + SUMMARY_SDS],
        scaled("mean_intensity", "mean_intensity", 1e1), "detection_count",
    )


@query(
    f"""SELECT a.alignment_id, p.sample, {s('coalesce(v.m, 0E0)', 'value', '1E1')}
    FROM (SELECT DISTINCT alignment_id FROM row_of) a, (SELECT DISTINCT sample FROM exp_i) p
    LEFT JOIN (SELECT alignment_id, sample, avg(intensity) AS m FROM row_of GROUP BY 1, 2) v ON v.alignment_id = a.alignment_id AND v.sample = p.sample""",
    ANNOTATED, PEAKS + "," + ROW_OF,
)
def align_samples(fx):
    names = sorted(r[0] for r in fx.exp_intensity.select("sample").distinct().collect())
    summary = isotope.alignment_summary(_aligned(fx), names)
    rows = summary.select("alignment_id", F.posexplode("sample_values").alias("_at", "_value"))
    return rows.select("alignment_id", F.get(F.array(*[F.lit(n) for n in names]), F.col("_at")).alias("sample"), scaled("_value", "value", 1e1))


def mesh(spark: SparkSession) -> DataFrame:
    """A plane on a regular mesh with one corner left empty, in place of a measured ratio grid."""
    nodes = spark.range(62 * 64).select(F.expr("id div 64").alias("i"), F.expr("id % 64").alias("j")).where("i + j < 110")
    placed = nodes.select((F.col("i") * 0.002 - 0.06).alias("y"), (F.col("j") * 2.0 + 2.0).alias("x"))
    return placed.select("y", "x", (F.lit(0.5) + F.col("x") / 40 + F.col("y") * 20).alias("z"))


def _grid_sql(keys: str, points: str) -> str:
    """CTEs pts (keys, v, u) and zed (keys, z): the mesh's bilinear value at each point that has one."""
    return f"""
gy AS (SELECT i, i * 0.002E0 - 0.06E0 AS y FROM range(62) r(i)),
gx AS (SELECT j, j * 2E0 + 2E0 AS x FROM range(64) r(j)),
pts AS ({points}),
cell AS (
  SELECT p.*, a.y AS y0, b.y AS y1, k.x AS x0, l.x AS x1, greatest(a.i, b.i) + greatest(k.j, l.j) < 110 AS filled
  FROM pts p JOIN gy a ON a.y <= p.v JOIN gy b ON b.i = a.i + 1 AND (p.v < b.y OR (b.i = 61 AND p.v <= b.y))
  JOIN gx k ON k.x <= p.u JOIN gx l ON l.j = k.j + 1 AND (p.u < l.x OR (l.j = 63 AND p.u <= l.x))),
val AS (
  SELECT {keys}, (v-y0)/(y1-y0) AS ty, (u-x0)/(x1-x0) AS tx, 0.5E0 + x0/40 + y0*20 AS z00, 0.5E0 + x1/40 + y0*20 AS z01,
         0.5E0 + x0/40 + y1*20 AS z10, 0.5E0 + x1/40 + y1*20 AS z11 FROM cell WHERE filled),
zed AS (SELECT {keys}, z00*(1-ty)*(1-tx) + z01*(1-ty)*tx + z10*ty*(1-tx) + z11*ty*tx AS z FROM val)"""


GRID = _grid_sql("source_file, compound", "SELECT source_file, compound, md/c AS v, m1/c AS u FROM carbon")


@query(
    f"""SELECT p.source_file, p.compound, {s('CASE WHEN z >= 0.8E0 THEN round_even(z*10E0, 0)/10E0 END', 'ratio', '1E1')},
    CASE WHEN z >= 0.8E0 THEN 'predicted' ELSE 'out of bounds' END AS ratio_status FROM pts p LEFT JOIN zed USING (source_file, compound)""",
    ANNOTATED, PEAKS + "," + GRID,
)
def grid_ratio(fx):
    rows = isotope.grid_ratio(isotope.carbon_estimate(fx.peak), mesh(fx.spark))
    return rows.select("source_file", "compound", scaled("ratio", "ratio", 1e1), "ratio_status")


@query(
    f"""SELECT l.line, n, {s('lo + n * ((hi - lo) / 99E0)', 'x')}, {s('l.a * (lo + n * ((hi - lo) / 99E0)) + l.b', 'y', '1E6')}
    FROM (SELECT min(m1/c) AS lo, max(m1/c) AS hi FROM carbon), (VALUES ('CF2', -8.40596E-05, 0.0010087E0), ('CHF', -0.0005237E0, 0.0229902E0)) l(line, a, b), range(100) r(n)""",
    ANNOTATED, PEAKS,
)
def reference_lines(fx):
    rows = report.reference_lines(isotope.carbon_estimate(fx.peak))
    return rows.select("line", F.col("n").cast("long").alias("n"), scaled("x", "x"), scaled("y", "y", 1e6))


SUMMARY = """
row_of AS (SELECT DISTINCT al.alignment_id, an.sample, an.compound, f.match, an.class, an.mz, an.rt, an.dt, an.ccs, an.intensity, c.i1, c.i3, c.m1/c.c AS u, c.md/c.c AS v
  FROM an JOIN al USING (k) JOIN annotated f USING (feature_id, class) LEFT JOIN carbon c ON c.sample = an.sample AND c.compound = an.compound),
per_total AS (
  SELECT alignment_id, sum(m) / (SELECT count(DISTINCT sample) FROM anchor) AS mean_intensity, count(m) AS detection_count
  FROM (SELECT alignment_id, sample, avg(intensity) AS m FROM row_of GROUP BY 1, 2) GROUP BY 1),
per_al AS (
  SELECT alignment_id, arg_min(class, (sample, compound, mz, class)) AS class, avg(mz) AS mz, avg(i1) AS i1, avg(i3) AS i3, avg(u) AS u, avg(v) AS v FROM row_of GROUP BY 1),"""


@query(
    f"""SELECT alignment_id, class, CASE WHEN i1 > 0 AND i3/i1 > 0.28E0 THEN 'Potential Cl, Br present' WHEN i3 = 0 OR i3 IS NULL THEN 'No M+2 peak detected - insufficient signal'
      ELSE 'No Cl or Br isotopic pattern detected' END AS isotope_status, {s('mz', 'mz')}, {s('mean_intensity', 'mean_intensity', '1E1')}, detection_count,
      CASE WHEN z >= 0.8E0 THEN 'predicted' ELSE 'out of bounds' END AS ratio_status, {s('CASE WHEN z >= 0.8E0 THEN round_even(z*10E0, 0)/10E0 END', 'ratio', '1E1')}
    FROM per_al JOIN per_total USING (alignment_id) LEFT JOIN zed USING (alignment_id)""",
    ANNOTATED, PEAKS + "," + ALIGN + "," + SUMMARY + _grid_sql("alignment_id", "SELECT alignment_id, u, v FROM per_al"),
)
def isotope_summary(fx):
    features = annotated(fx)
    rows = isotope_plan.isotope_summary(features, fx.exp_intensity, fx.peak, mesh(fx.spark))
    return rows.select("alignment_id", "class", "isotope_status", scaled("mz", "mz"), scaled("mean_intensity", "mean_intensity", 1e1),
                       "detection_count", "ratio_status", scaled("ratio", "ratio", 1e1))


# --- regression ---------------------------------------------------------------------------------

def _line_fit(points: str, qs: list[float], group: str = "") -> str:
    """CTEs that find the quantile line per group: the best line through a point has a weighted quantile of the
    slopes to the others, and one of these lines is the best of all. Ties go to the smaller loss, slope, intercept."""
    names = [c.strip() for c in group.split(",")] if group else []
    of = lambda t: "".join(f"{t}.{c}, " for c in names)
    same = lambda t, u: " AND ".join(f"{t}.{c} = {u}.{c}" for c in names) or "true"
    g = of("t")
    quant = ", ".join(f"({q!r}E0)" for q in qs)
    return f"""
pts_fit AS (SELECT *, row_number() OVER () AS n FROM {points}),
away AS (SELECT {of("a")}a.n, a.x AS x0, a.y AS y0, (b.y - a.y) / (b.x - a.x) AS ratio, abs(b.x - a.x) AS w, b.x > a.x AS up
  FROM pts_fit a JOIN pts_fit b ON {same("a", "b")} AND a.x <> b.x),
run AS (SELECT *, sum(w) OVER (PARTITION BY n ORDER BY ratio ROWS UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY n) AS w_all,
  sum(CASE WHEN up THEN w ELSE 0E0 END) OVER (PARTITION BY n) AS w_up FROM away),
line AS (SELECT DISTINCT {g}q, min(ratio) AS slope, y0 - min(ratio) * x0 AS intercept FROM run t, (VALUES {quant}) v(q)
  WHERE acc >= q * w_up + (1E0 - q) * (w_all - w_up) - 1E-12 * w_all GROUP BY {g}q, n, x0, y0),
trial AS (SELECT {of("l")}q, slope, intercept, sum(greatest(q * (p.y - (slope*p.x + intercept)), (q - 1E0) * (p.y - (slope*p.x + intercept)))) AS loss
  FROM line l JOIN pts_fit p ON {same("l", "p")} GROUP BY {of("l")}q, slope, intercept),
least AS (SELECT {g}q, min(loss) AS loss FROM trial t GROUP BY {g}q),
fit AS (SELECT {g}t.q, l.loss, min((slope, intercept))[1] AS slope, min((slope, intercept))[2] AS intercept
  FROM trial t JOIN least l ON t.q = l.q AND {same("t", "l")} AND t.loss <= l.loss * (1 + 1E-11) GROUP BY {g}t.q, l.loss)"""


@query(
    f"SELECT {s('q', 'q')}, {s('slope', 'slope')}, {s('intercept - 5E0', 'intercept', '1E3')}, {s('loss', 'loss')} FROM fit",
    _line_fit("(SELECT ln(mz) AS x, ccs AS y FROM seed)", [0.1, 0.9]),
)
def qreg_ccs(fx):
    lines = regress.ccs_band(fx.seed)
    return lines.select(scaled("q", "q"), scaled("slope", "slope"), scaled("intercept", "intercept", 1e3), scaled("loss", "loss"))


@query(
    f"SELECT {s('q', 'q')}, {s('slope', 'slope')}, {s('intercept', 'intercept', '1E3')}, {s('loss', 'loss')} FROM fit",
    _line_fit("(SELECT ln(mz) AS x, rt AS y FROM seed)", [0.05, 0.95]),
)
def qreg_rt(fx):
    lines = regress.rt_band(fx.seed)
    return lines.select(scaled("q", "q"), scaled("slope", "slope"), scaled("intercept", "intercept", 1e3), scaled("loss", "loss"))


@query(
    f"""SELECT f.feature_id FROM feature f,
      (SELECT max(slope) FILTER (q = 0.1E0) AS s0, max(intercept) FILTER (q = 0.1E0) - 5E0 AS i0, max(slope) FILTER (q = 0.9E0) AS s1,
              max(intercept) FILTER (q = 0.9E0) - 5E0 AS i1 FROM fit) b
      WHERE f.ccs >= s0 * ln(f.mz) + i0 AND f.ccs <= s1 * ln(f.mz) + i1""",
    _line_fit("(SELECT ln(mz) AS x, ccs AS y FROM library_l2)", [0.1, 0.9]),
)
def band_filter(fx):
    low, high = [(r.slope, r.intercept) for r in regress.ccs_band(fx.library_l2).orderBy("q").collect()]
    return filters.regression_band(fx.feature, "ccs", low, high).select("feature_id")


def _cv_sql(y: str, lo: str, hi: str) -> tuple[str, str]:
    """SELECT and CTEs of the cross-validated scores of the two linear models of `y`."""
    loss = lambda q, n: f"avg(greatest({q}*(y-s{n}*x-i{n}), ({q}-1E0)*(y-s{n}*x-i{n})))"
    coefs = ", ".join(f"max(slope) FILTER (q={q}) AS s{n}, max(intercept) FILTER (q={q}) AS i{n}" for n, q in enumerate((lo, "0.5E0", hi)))
    select = f"""SELECT model, {s('avg(loss_lo)', 'loss_lo')}, {s('avg(loss_mid)', 'loss_mid')}, {s('avg(loss_hi)', 'loss_hi')}, {s('avg(coverage)', 'coverage')},
      {s('avg(width)', 'width', '1E3')} FROM per_fold GROUP BY model"""
    rows = f"""lib_row AS (SELECT model, id % 5 AS own, CASE model WHEN 'linear' THEN mz ELSE ln(mz) END AS x, {y} AS y
  FROM seed, (VALUES ('linear'), ('logarithmic')) m(model)),"""
    fits = _line_fit("(SELECT model, f.fold, x, y FROM lib_row, range(5) f(fold) WHERE f.fold <> own)", [float(lo[:-2]), 0.5, float(hi[:-2])], "model, fold")
    scores = f""",
w AS (SELECT model, fold, {coefs} FROM fit GROUP BY 1, 2),
per_fold AS (SELECT w.model, w.fold, {loss(lo, 0)} AS loss_lo, {loss("0.5E0", 1)} AS loss_mid, {loss(hi, 2)} AS loss_hi,
  avg(CASE WHEN y >= s0*x+i0 - 1E-9*abs(y) AND y <= s2*x+i2 + 1E-9*abs(y) THEN 1E0 ELSE 0E0 END) AS coverage,
  avg(s2*x+i2-s0*x-i0) AS width FROM w JOIN lib_row l ON l.model = w.model AND l.own = w.fold GROUP BY 1, 2)"""
    return select, rows + fits + scores


@query(*_cv_sql("ccs", "0.1E0", "0.9E0"))
def pinball_cv(fx):
    rows = regress.cross_validate(fx.seed, "id", "ccs", 0.1, 0.9)
    return rows.select("model", *[scaled(c, c) for c in ("loss_lo", "loss_mid", "loss_hi", "coverage")], scaled("width", "width", 1e3))


@query(*_cv_sql("rt", "0.05E0", "0.95E0"))
def pinball_cv_rt(fx):
    rows = regress.cross_validate(fx.seed, "id", "rt", 0.05, 0.95)
    return rows.select("model", *[scaled(c, c) for c in ("loss_lo", "loss_mid", "loss_hi", "coverage")], scaled("width", "width", 1e3))


@query(
    f"""SELECT fold, {s('q', 'q')}, count(*) AS n, true AS feasible, true AS balanced, CAST(0 AS BIGINT) AS gap
    FROM (SELECT id % 5 AS own FROM seed), (SELECT CAST(f AS INTEGER) AS fold FROM range(5) r(f)), (VALUES (0.1E0), (0.5E0), (0.9E0)) v(q) WHERE fold <> own GROUP BY fold, q"""
)
def spline_certificate(fx):
    rows = regress.spline_certificates(fx.seed, "id", "ccs", 0.1, 0.9)
    share = F.col("q") * F.col("n")
    balanced = (F.col("below") <= share + 1e-6) & (share <= F.col("n") - F.col("above") + 1e-6)
    return rows.select("fold", scaled("q", "q"), "n", "feasible", balanced.alias("balanced"), scaled("gap", "gap", 1e6))


@query()
def pinball_cv_spline(fx):
    rows = regress.cross_validate_spline(fx.seed, "id", "ccs", 0.1, 0.9)
    return rows.select("model", *[scaled(c, c, 1e2) for c in ("loss_lo", "loss_mid", "loss_hi", "coverage", "width")])


# --- whole plans --------------------------------------------------------------------------------

def _screening(fx: Fixtures) -> screen_plan.Screening:
    features = fx.feature.select("feature_id", "mz", "rt", "dt", "ccs")
    return screen_plan.screen(features, fx.intensity, fx.library_l2, fx.library_l5, fx.standard)


SCREEN = f"""
r_level AS (SELECT feature_id, avg(value) + 3E0 * coalesce(stddev_samp(value), 0E0) AS level FROM intensity WHERE role = 'blank' GROUP BY 1),
r_clean AS (SELECT e.feature_id, e.sample, CASE WHEN e.value < b.level THEN 0E0 ELSE e.value - b.level END AS value FROM exp_i e LEFT JOIN r_level b USING (feature_id)),
r_masked AS (SELECT feature_id, sample, CASE WHEN value < 100E0 THEN 0E0 ELSE value END AS value FROM r_clean),
r_rt AS MATERIALIZED (SELECT feature_id, mz, rt, dt, ccs FROM feature WHERE rt BETWEEN 0.5E0 AND 16E0),
r_mz AS MATERIALIZED (SELECT * FROM r_rt WHERE mz BETWEEN 100E0 AND 2000E0),
r_values AS MATERIALIZED (SELECT * FROM r_masked WHERE feature_id IN (SELECT feature_id FROM r_mz)),
{smear_sql("r_values", "r_mz")},
r_unsmeared AS MATERIALIZED ({unsmeared_sql("r_values")}),
{duplicates_sql("r_mz")},
r_member AS MATERIALIZED (SELECT f.*, max(f.feature_id) OVER (PARTITION BY coalesce(component, f.feature_id)) AS kept FROM r_mz f LEFT JOIN dup_group g USING (feature_id)),
r_merged AS MATERIALIZED (SELECT kept AS feature_id, avg(mz) AS mz, avg(rt) AS rt, avg(dt) AS dt, avg(ccs) AS ccs FROM r_member GROUP BY kept),
r_value AS MATERIALIZED (SELECT m.kept AS feature_id, e.sample, max(e.value) AS value FROM r_unsmeared e JOIN r_member m USING (feature_id) GROUP BY 1, 2),
r_dense AS MATERIALIZED (SELECT * FROM r_merged WHERE mz * 0.19E0 + 110.28E0 > ccs),
r_defect AS MATERIALIZED (SELECT * FROM r_dense WHERE mz - round_even(mz, 0) BETWEEN -0.12E0 AND 0.11E0),
r_frequent AS MATERIALIZED (SELECT * FROM r_defect WHERE feature_id IN (SELECT feature_id FROM r_value GROUP BY 1
  HAVING count(*) FILTER (value > 0) * 1E0 / (SELECT count(DISTINCT sample) FROM exp_i) >= 0.15E0)),
{annotated_sql("r_frequent").strip()},
r_row AS MATERIALIZED (SELECT * FROM annotated),
r_nostandard AS MATERIALIZED ({without_standards_sql("r_row")}),
r_nodecay AS MATERIALIZED ({without_decay_sql("r_nostandard")}),
{_line_fit("(SELECT ln(mz) AS x, ccs AS y FROM library_l2)", [0.1, 0.9]).strip()},
r_band AS MATERIALIZED (SELECT f.* FROM r_nodecay f,
  (SELECT max(slope) FILTER (q = 0.1E0) AS s0, max(intercept) FILTER (q = 0.1E0) - 5E0 AS i0, max(slope) FILTER (q = 0.9E0) AS s1, max(intercept) FILTER (q = 0.9E0) - 5E0 AS i1 FROM fit) b
  WHERE f.ccs >= s0 * ln(f.mz) + i0 AND f.ccs <= s1 * ln(f.mz) + i1),
r_screened AS MATERIALIZED ({prescreened_sql("r_band")}),
{crowd_sql("r_screened").strip()},
r_open AS MATERIALIZED ({without_crowds_sql("r_screened")}),
r_combined AS MATERIALIZED ({without_chains_sql("r_open")}),
{adducts_sql("r_combined")},
r_noadduct AS MATERIALIZED ({without_adducts_sql("r_combined")}),
{losses_sql("r_noadduct")},
r_noloss AS MATERIALIZED ({without_losses_sql("r_noadduct")}),
r_seen AS (SELECT feature_id, count(*) FILTER (value > 0) * 1E0 / (SELECT count(DISTINCT sample) FROM exp_i) * 100E0 AS frequency, avg(value) AS abundance FROM r_value GROUP BY 1),
r_rounded AS MATERIALIZED (
  SELECT n.feature_id, match, class, round_even(mz * 1E4, 0) / 1E4 AS mz, round_even(rt * 1E1, 0) / 1E1 AS rt, round_even(ccs * 1E1, 0) / 1E1 AS ccs,
    round_even(frequency * 1E1, 0) / 1E1 AS detection_frequency, round_even(abundance, 0) AS average_abundance FROM r_noloss n LEFT JOIN r_seen USING (feature_id)),
r_report AS MATERIALIZED ({without_isotopes_sql("r_rounded", "r_rounded", "2E0")})"""
#: The stages of the screening and the tables of SCREEN that hold their rows.
STAGES = {
    "loaded": "feature", "rt_range": "r_rt", "mz_range": "r_mz", "duplicates_merged": "r_merged", "density_line": "r_dense", "mass_defect": "r_defect",
    "detection_frequency": "r_frequent", "annotated": "r_row", "standards_removed": "r_nostandard", "source_decay": "r_nodecay", "regression_band": "r_band",
    "combined_filter": "r_combined", "adducts": "r_noadduct", "neutral_losses": "r_noloss", "halogen_isotopes": "r_report",
}


@query(" UNION ALL ".join(f"SELECT {i} AS step, '{name}' AS stage, count(*) AS rows FROM {table}" for i, (name, table) in enumerate(STAGES.items(), 1)), SCREEN)
def screen_funnel(fx):
    return _screening(fx).funnel()


@query(
    "SELECT feature_id, match, class, " + ", ".join(s(c, c) for c in ("mz", "rt", "ccs", "detection_frequency", "average_abundance")) + " FROM r_report", SCREEN
)
def screen_report(fx):
    rows = _screening(fx).report
    return rows.select("feature_id", "match", "class", *[scaled(c, c) for c in ("mz", "rt", "ccs", "detection_frequency", "average_abundance")])


# --- files and texts ----------------------------------------------------------------------------

def _through_files(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Features and intensities after a round through wide feature lists: even ids comma-, odd ones tab-separated."""
    names = [f"S{i}" for i in range(8)]
    wide = delimited.to_wide(fx.feature.select("feature_id", "rt", "dt", "ccs", "mz"), fx.intensity.select("feature_id", "sample", "value"), names)
    folder = scratch_folder(fx.spark, "lists")
    for odd, sep in ((0, ","), (1, "\t")):
        wide.where(F.col("feature_id") % 2 == odd).select("feature_id", "rt", "dt", "ccs", "mz", *names).write.option("sep", sep).option("header", True).csv(f"{folder}/{odd}")
    raw = delimited.read_delimited(fx.spark, [f"{folder}/0", f"{folder}/1"])
    table = delimited.map_columns(raw, {"feature_id": "A", "rt": "B", "dt": "C", "ccs": "D", "mz": "E"})
    blank, exp, _ = delimited.split_roles([c for c in table.columns if c != "source_file"], ("F", "H"), ("I", "M"))
    features, intensity = delimited.to_long(table, blank, exp)
    return delimited.require_unique_ids(cut_lineage(features)), intensity


@query(f"SELECT feature_id, {s('mz', 'mz', '1E8')}, {s('rt', 'rt', '1E8')}, {s('dt', 'dt', '1E8')}, {s('ccs', 'ccs', '1E8')} FROM feature")
def delimited_features(fx):
    return _through_files(fx)[0].select("feature_id", *[scaled(c, c, 1e8) for c in ("mz", "rt", "dt", "ccs")])


@query(
    f"SELECT f.feature_id, p.sample, CASE WHEN p.sample < 'S3' THEN 'blank' ELSE 'exp' END AS role, {s('i.value', 'value', '1E6')} "
    "FROM feature f CROSS JOIN (SELECT concat('S', CAST(n AS VARCHAR)) AS sample FROM range(8) r(n)) p "
    "LEFT JOIN intensity i ON i.feature_id = f.feature_id AND i.sample = p.sample"
)
def delimited_intensity(fx):
    return _through_files(fx)[1].select("feature_id", "sample", "role", scaled("value", "value", 1e6))


@query(
    "SELECT f.feature_id, p.sample, p.role, " + s("i.value", "value", "1E6") + """
    FROM feature f JOIN (SELECT concat('S', CAST(n AS VARCHAR), '.d') AS sample, CASE WHEN n < 3 THEN 'blank' ELSE 'exp' END AS role, n FROM range(8) r(n)) p
      ON f.feature_id % 2 = 0 OR p.n <> 5
    LEFT JOIN intensity i ON i.feature_id = f.feature_id AND i.sample = replace(p.sample, '.d', '')
    UNION ALL SELECT feature_id, 'S5.d', 'exp', NULL FROM feature WHERE feature_id % 2 = 1"""
)
def dotted_lists(fx):
    """Two lists with different headers, of which the first five columns and those with the marker are kept."""
    names = [f"S{i}" for i in range(8)]
    wide = delimited.to_wide(fx.feature.select("feature_id", "rt", "dt", "ccs", "mz"), fx.intensity.select("feature_id", "sample", "value"), names)
    wide = wide.select(F.col("feature_id").alias("ID"), F.col("rt").alias("RT"), F.col("dt").alias("DT"), F.col("ccs").alias("CCS"), F.col("mz").alias("m/z"),
                       F.lit("kept out").alias("note"), *[F.col(n).alias(f" {n}.d ") for n in names])
    folder = scratch_folder(fx.spark, "dotted")
    wide.where("ID % 2 = 0").write.option("header", True).csv(f"{folder}/0")
    wide.where("ID % 2 = 1").drop(" S5.d ").write.option("header", True).option("sep", "\t").csv(f"{folder}/1")
    table = delimited.combine_dotted(fx.spark, [f"{folder}/0", f"{folder}/1"])
    blank, exp, _ = delimited.split_roles_by_name(table.columns, [f"S{i}.d" for i in range(3)], [f"S{i}.d" for i in range(3, 8)])
    table = delimited.map_columns(table, {"feature_id": "ID", "rt": "RT", "dt": "DT", "ccs": "CCS", "mz": "m/z"}, allow_names=True)
    return delimited.to_long(table, blank, exp)[1].select("feature_id", "sample", "role", scaled("value", "value", 1e6))


@query(
    f"SELECT 'level 2' AS list, name, {s('mz', 'mz', '1E8')}, {s('ccs', 'ccs', '1E8')}, {s('rt', 'rt', '1E8')} FROM library_l2 "
    f"UNION ALL SELECT 'level 5', name, {s('mz', 'mz', '1E8')}, NULL, NULL FROM library_l5 "
    f"UNION ALL SELECT 'standard', NULL, {s('mz', 'mz', '1E8')}, {s('ccs', 'ccs', '1E8')}, NULL FROM standard"
)
def library_files(fx):
    """Libraries and standards through files, with repeated rows and two inputs that are not there."""
    folder = scratch_folder(fx.spark, "libraries")
    level2 = fx.library_l2.select("name", "adduct", "ccs", "rt", "mz")
    level2.unionByName(level2).write.option("header", True).csv(f"{folder}/2")
    fx.library_l5.select("mz", "name").write.option("header", True).csv(f"{folder}/5")
    fx.standard.select("std_id", "mz", "ccs").write.option("header", True).csv(f"{folder}/s")
    found = {
        "level 2": delimited.read_level2(fx.spark, f"{folder}/2", {"name": "A", "adduct": "B", "ccs": "C", "rt": "D", "mz": "E"}),
        "level 5": delimited.read_level5(fx.spark, f"{folder}/5", {"mz": "A", "name": "B"}).unionByName(delimited.read_level5(fx.spark, None, {}), allowMissingColumns=True),
        "standard": delimited.read_standards(fx.spark, f"{folder}/s", {"id": "A", "mz": "B", "ccs": "C"}).unionByName(
            delimited.read_standards(fx.spark, f"{folder}/absent", {}), allowMissingColumns=True),
    }
    parts = []
    for kind, rows in found.items():
        there = lambda c, to: F.col(c).cast(to) if c in rows.columns and not (kind == "standard" and c == "name") else F.lit(None).cast(to)  # noqa: B023, E731
        parts.append(rows.select(F.lit(kind).alias("list"), there("name", "string").alias("name"), *[scaled(there(c, "double"), c, 1e8) for c in ("mz", "ccs", "rt")]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""SELECT replace(source_file, '.cef', '') AS sample, CAST(dense_rank() OVER (PARTITION BY source_file ORDER BY compound) AS INTEGER) AS compound,
      {s('rt', 'rt', '1E8')}, {s('dt', 'dt', '1E8')}, {s('ccs', 'ccs', '1E8')}, {s('peak_mz', 'peak_mz', '1E8')}, {s('peak_intensity', 'peak_intensity', '1E4')} FROM peak"""
)
def cef_peaks(fx):
    """Peak lists written as CEF files, one per sample, with a compound without a place in each, and read back."""
    peak = F.concat(F.lit("<p x='"), F.col("peak_mz").cast("string"), F.coalesce(F.concat(F.lit("' y='"), F.col("peak_intensity").cast("string")), F.lit("")), F.lit("'/>"))
    place = F.concat(*[x for c in ("rt", "dt", "ccs") for x in (F.lit(f" {c}='"), F.col(c).cast("string"), F.lit("'"))])
    compounds = fx.peak.groupBy("source_file", "compound", place.alias("place")).agg(F.concat_ws("", F.sort_array(F.collect_list(F.struct("peak_mz", peak.alias("p"))))["p"]).alias("peaks"))
    body = F.concat(F.lit("<Compound><Location"), F.col("place"), F.lit("/><Spectrum><MSPeaks>"), F.col("peaks"), F.lit("</MSPeaks></Spectrum></Compound>"))
    rows = compounds.select("source_file", F.lit(1).alias("part"), "compound", body.alias("value"))
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(v).alias("value")) for i, v in (
        (0, "<CEF><CompoundList><Compound><Spectrum/></Compound>"), (2, "</CompoundList></CEF>"))])).alias("e")
    frame = compounds.select("source_file").distinct().select("source_file", ends).select("source_file", "e.part", F.lit(0).cast("long").alias("compound"), "e.value")
    folder = scratch_folder(fx.spark, "cef")
    rows.unionByName(frame).repartition("source_file").sortWithinPartitions("source_file", "part", "compound").drop("part", "compound").write.partitionBy("source_file").option(
        "extension", "cef").option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000").csv(folder)
    found = cef.read_cef(fx.spark, f"{folder}/*", r"/source_file=([^/]+)\.cef/[^/]+$").withColumn("sample", F.nullif("source_file", F.lit("")))
    return found.select("sample", "compound", *[scaled(c, c, 1e8) for c in ("rt", "dt", "ccs", "peak_mz")], scaled("peak_intensity", "peak_intensity", 1e4))


RANK_SQL = "CASE class WHEN 'likely' THEN 0 WHEN 'tentative' THEN 1 WHEN 'unmatched' THEN 2 ELSE 3 END"


@query(f"SELECT row_number() OVER (ORDER BY {RANK_SQL}, mz, feature_id) AS position, feature_id, class FROM ({without_isotopes_sql()})", ANNOTATED)
def report_order(fx):
    rows = match.remove_halogen_isotopes(annotated(fx), 15.0, 0.02, 0.5)
    return with_rank(cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id())), [], ["_at"], "position").select("position", "feature_id", "class")


@query(f"SELECT row_number() OVER (ORDER BY {RANK_SQL}, mz, feature_id, match) AS position, feature_id, class, match FROM annotated", ANNOTATED)
def sorted_report_file(fx):
    rows = annotated(fx).select("feature_id", "class", "match", "mz", match.class_rank().alias("class_rank"))
    path = scratch_folder(fx.spark, "report")
    delimited.write_report(rows, path, order=["class_rank", "mz", "feature_id", "match"])
    placed = with_rank(cut_lineage(delimited.read_report(fx.spark, path)), [], ["_part", "_row"], "position")
    return placed.select("position", F.col("feature_id").cast("long").alias("feature_id"), "class", "match")


@query(
    "SELECT 'class' AS part, class AS name, count(*) AS rows FROM annotated GROUP BY class "
    "UNION ALL SELECT 'largest', 'feature_id', max(feature_id) FROM annotated", ANNOTATED,
)
def class_rows(fx):
    rows = annotated(fx)
    largest = report.max_of(rows, "feature_id").select(F.lit("largest").alias("part"), F.lit("feature_id").alias("name"), F.col("max_feature_id").alias("rows"))
    return report.class_counts(rows, "class").select(F.lit("class").alias("part"), F.col("class").alias("name"), "rows").unionByName(largest)


@query(
    "SELECT feature_id, sample, role FROM intensity WHERE feature_id IN (SELECT feature_id FROM intensity WHERE role = 'blank') "
    "AND feature_id IN (SELECT feature_id FROM intensity WHERE role = 'exp')"
)
def common_features(fx):
    sides = blanks.common_features(fx.intensity.where("role = 'blank'"), fx.intensity.where("role = 'exp'"))
    return sides[0].unionByName(sides[1]).select("feature_id", "sample", "role")


@query(
    """SELECT a.feature_id, a.match, CASE a.class WHEN 'likely' THEN CAST(l.mass_error AS VARCHAR) WHEN 'tentative' THEN e.errors END AS mass_error_text,
      CASE a.class WHEN 'likely' THEN CAST(l.ccs_error AS VARCHAR) WHEN 'tentative' THEN 'N/A' END AS ccs_error_text, CASE WHEN a.class <> 'unmatched' THEN 'N/A' END AS rt_error_text
    FROM annotated a LEFT JOIN l2p l ON a.class = 'likely' AND l.feature_id = a.feature_id AND l.match = a.match
    LEFT JOIN (SELECT mz, array_to_string(list_transform(list_sort(list_distinct(list(mass_error + 0E0))), lambda x: CAST(x AS VARCHAR)), ' or ') AS errors FROM l5p GROUP BY mz) e ON e.mz = a.mz""",
    ANNOTATED,
)
def error_texts(fx):
    return report.error_text(annotated(fx)).select("feature_id", "match", "mass_error_text", "ccs_error_text", "rt_error_text")


@query(
    """SELECT r.feature_id, CASE WHEN length(match) > 30 THEN substr(match, 1, 27) || '...' ELSE match END AS short_name,
      'Classification: ' || class || chr(10) || 'm/z: ' || printf('%.4f', mz) || chr(10) || 'CCS: ' || printf('%.2f', ccs) || ' Å²' || chr(10) || 'RT: ' || printf('%.2f', rt)
      || ' min' || chr(10) || 'Predicted F/C Ratio: ' || CASE WHEN r.feature_id % 3 = 0 THEN 'out of bounds' ELSE printf('%.1f', (r.feature_id % 20) / 10E0) END || chr(10)
      || '--- Intensities (> 0) ---' || chr(10) || coalesce(i.seen, 'Not detected in any sample') AS detail
    FROM (SELECT DISTINCT feature_id, match, class, round_even(mz * 1E4, 0) / 1E4 AS mz, round_even(ccs * 1E1, 0) / 1E1 AS ccs, round_even(rt * 1E1, 0) / 1E1 AS rt FROM annotated) r
    LEFT JOIN (SELECT feature_id, string_agg(sample || ': ' || format('{:,}', CAST(round_even(value, 0) AS BIGINT)), chr(10) ORDER BY sample, value) AS seen
      FROM exp_i WHERE value > 0 AND feature_id % 5 <> 0 GROUP BY feature_id) i USING (feature_id)""",
    ANNOTATED,
)
def detail_texts(fx):
    ratio = F.when(F.col("feature_id") % 3 != 0, (F.col("feature_id") % 20) / F.lit(10.0))
    rows = report.round_report(annotated(fx)).withColumn("ratio", ratio)
    rows = rows.select("feature_id", "match", "class", "mz", "ccs", "rt", "ratio").distinct()
    return report.detail_text(rows, fx.exp_intensity.where("feature_id % 5 <> 0"), "feature_id")


@query(
    """SELECT level, segment_id, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY level, segment_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY level, segment_id) AS size,
        min(segment_id) OVER (PARTITION BY level) AS first
      FROM (SELECT CASE feature_id % 7 WHEN 0 THEN 0.8E0 WHEN 1 THEN 1E0 WHEN 2 THEN 1.5E0 WHEN 3 THEN 2E0 WHEN 4 THEN 2.5E0 WHEN 5 THEN 3E0 ELSE 1.2E0 END AS level,
        feature_id % 11 + 1 AS segment_id, feature_id AS pos FROM feature) WHERE level <> 1.2E0)
    WHERE segment_id = first AND n = size // 2 + 1"""
)
def contour_marks(fx):
    levels = F.array(*[F.lit(x) for x in [*report.MAJOR_LEVELS, 1.2]])
    lines = fx.feature.select(F.get(levels, (F.col("feature_id") % 7).cast("int")).alias("level"), (F.col("feature_id") % 11 + 1).alias("segment_id"), F.col("feature_id").alias("pos"))
    return report.contour_labels(lines).select("level", "segment_id", "pos")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Features annotated from the level-2 library with their blank-subtracted mean intensity."""
    fx = Fixtures(spark, folder)
    clean = blanks.subtract_blanks(fx.intensity, "2", 3.0)
    means = clean.groupBy("feature_id").agg(F.avg("value").alias("mean_value"), F.count_if(F.col("value") > 0).alias("detections"))
    rows = match.match_level2(fx.feature, fx.library_l2, 15.0, 2.0, 0.5, False)
    return rows.join(means, "feature_id", "left").select(
        "feature_id", "match", "class", "mass_error_ppm", "ccs_error_pct", "mean_value", "detections"
    )
