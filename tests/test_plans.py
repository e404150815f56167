"""Whole plans and the catalogue on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from ionloom import catalog
from ionloom.model import Params
from ionloom.plans.screen import screen
from ionloom.plans.series import find_series, group_ids, group_rows
from ionloom.sources import delimited
from ionloom.streaming import prefilter
from tests.conftest import SF

CORE = sorted(set(catalog.ORACLES) - {"trend_lines", "dup_components"})  # what these two do is part of others


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_catalogue_is_consistent():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(str(r) for r in result.fetchall())
    got = sorted(str(tuple(r)) for r in entry_points.queries()[name](spark, SF).select(*columns).collect())
    assert got == want


def test_screening_funnel_shrinks_and_series_run(spark, fx):
    features = fx.feature.select("feature_id", "mz", "rt", "dt", "ccs")
    result = screen(features, fx.intensity, fx.library_l2, fx.library_l5, fx.standard, Params(rt_band=True))
    steps = [r["rows"] for r in result.funnel().orderBy("step").collect()]
    annotated = list(result.stages).index("annotated")
    before, after = steps[:annotated], steps[annotated:]
    assert before == sorted(before, reverse=True) and after == sorted(after, reverse=True) and after[-1] > 0
    outcome = find_series(result.report, fx.library_l2, {"CF2": 49.9968}).cache()
    first = group_ids(outcome).first()
    if first:
        assert group_rows(outcome, first[0]).count() >= 3


def test_stream_takes_the_stateless_filters(spark, fx, tmp_path):
    fx.feature.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fx.feature.schema).parquet(str(tmp_path / "in"))
    run = prefilter(stream).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("kept").count() == prefilter(fx.feature).count()


def test_files_to_report_and_isotopes(spark, tmp_path):

    from ionloom.plans.files import run_isotopes, run_screening
    from ionloom.operators import cleanup

    head = "ID,m/z,RT,DT,CCS,Note,Score,B1,run S1.d\n"
    (tmp_path / "a.csv").write_text(head + "1,412.9664,5.0,20,150.0,first,3,10,5000\n2,412.9665,5.01,20,150.1,second,7,10,6000\n")
    (tmp_path / "b.csv").write_text(head + "3,512.9600,7.0,21,168.0,other,1,10,7000\n")
    level2 = spark.createDataFrame([(1, "acid", "M-H", 412.9664, 150.0, 5.0)], "lib_id long, name string, adduct string, mz double, ccs double, rt double")
    columns = {"feature_id": "A", "mz": "B", "rt": "C", "dt": "D", "ccs": "E"}
    params = Params(ccs_band=False, mass_defect_lo=-10.0, mass_defect_hi=10.0)
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    out = run_screening(spark, paths, columns, ("H", "H"), ("I", "I"), level2, report_path=str(tmp_path / "out"), params=params, table_path=str(tmp_path / "table"))
    rows = {r.feature_id: r for r in out.report.collect()}
    assert rows[2]["class"] == "likely" and rows[2].meta == {"Note": "first", "Score": "7"} and rows[2]["run S1.d"] == 5990.0
    assert rows[2].mass_error_text == str(rows[2].mass_error_ppm)
    table = spark.read.parquet(str(tmp_path / "table")).collect()
    assert {(r.feature_id, r["class"]) for r in table} == {(i, r["class"]) for i, r in rows.items()} and len(table) == len(rows)
    ranked = delimited.read_report(spark, str(tmp_path / "out")).orderBy("_part", "_row").collect()
    assert [r["class"] for r in ranked] == sorted((r["class"] for r in ranked), key=["likely", "tentative", "unmatched"].index)
    written = spark.read.csv(str(tmp_path / "out"), header=True)
    assert written.count() == len(rows) and "run S1.d" in written.columns
    (tmp_path / "cef").mkdir()
    peaks = "".join(f'<p x="{m}" y="{y}"/>' for m, y in ((412.96645, 5990.0), (413.9698, 500.0)))
    (tmp_path / "cef" / "S1.cef").write_text(
        f'<CEF><CompoundList><Compound><Location rt="5.0" ccs="150.05" dt="20"/><Spectrum><MSPeaks>{peaks}</MSPeaks></Spectrum></Compound></CompoundList></CEF>'
    )
    summary = run_isotopes(spark, out, str(tmp_path / "cef")).collect()
    assert len(summary) == 1 and summary[0]["class"] == "likely" and summary[0].detection_count == 1
    with pytest.raises(ValueError):
        run_screening(spark, [paths[0], paths[0]], columns, ("H", "H"), ("I", "I"), level2, params=params)
    features = spark.createDataFrame([(1, 1.0, {"a": "2", "b": "x"}), (2, 0.5, {"a": "10", "b": "y"}), (3, 1.0, {"a": None})], "feature_id long, mz double, meta map<string,string>")
    members = spark.createDataFrame([(1, 2), (2, 2)], "feature_id long, kept_id long")
    got = {r.feature_id: r.meta for r in cleanup.merge_metadata(features, members).collect()}
    assert got == {2: {"a": "10", "b": "y"}, 3: {"a": None}}
