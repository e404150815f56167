"""Reading and writing files."""

import json

import pytest
from pyspark.sql import functions as F

from ionloom.operators import ordered
from ionloom.sources import cef, delimited


def test_comma_and_tab_files_are_stacked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,RT,DT,CCS,m/z,B1.d,E1.d\n1,1.0,2.0,150.5,300.1,5,nan\n")
    (tmp_path / "b.tsv").write_text("ID\tRT\tDT\tCCS\tm/z\tB1.d\tE1.d\n2\t1.5\t2.5\tx\t301.1\t\t7\n")
    raw = delimited.read_delimited(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.tsv")])
    named = delimited.map_columns(raw, {"feature_id": "A", "rt": "B", "dt": "C", "ccs": "D", "mz": "E", "gone": "Z"})
    blank, exp, meta = delimited.split_roles([c for c in named.columns if c != "source_file"], ("F", "F"), ("G", "G"))
    assert (blank, exp) == (["B1.d"], ["E1.d"]) and meta[0] == "feature_id"
    features, values = delimited.to_long(named, blank, exp)
    f = {r.feature_id: r for r in features.collect()}
    assert f[1].mz == 300.1 and f[2].ccs is None
    assert {(r.feature_id, r.sample, r.role): r.value for r in values.collect()} == {
        (1, "B1.d", "blank"): 5.0, (1, "E1.d", "exp"): None, (2, "B1.d", "blank"): None, (2, "E1.d", "exp"): 7.0}
    assert delimited.select_dotted(raw).columns[-1] == "E1.d"
    wide = delimited.to_wide(features.select("feature_id"), values, ["B1.d", "E1.d"])
    assert wide.count() == 2
    delimited.write_report(wide, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_column_letters():
    assert [delimited.column_index(x) for x in ("A", "z", "AA")] == [0, 25, 26]
    for bad in ("", None, "1"):
        with pytest.raises(ValueError):
            delimited.column_index(bad)
    with pytest.raises(ValueError):
        delimited.split_roles(["a", "b"], ("A", "A"), ("B", "C"))
    with pytest.raises(ValueError):
        delimited.split_roles_by_name(["a"], ["x"], [])


def test_library_with_repeated_header_and_optional_inputs(spark, tmp_path):
    (tmp_path / "lib.csv").write_text("Group,Name,Formula,Adduct,CCS,RT,m/z,Name\ng,a,f,M-H,150,5,300,n\ng,a,f,M-H,150,5,300,n\ng,b,f,M-H,151,,301,n\n")
    mapping = {"name": "B", "adduct": "D", "ccs": "E", "rt": "F", "mz": "G"}
    lib = delimited.read_level2(spark, str(tmp_path / "lib.csv"), mapping)
    assert sorted((r.name, r.mz, r.rt) for r in lib.collect()) == [("a", 300.0, 5.0), ("b", 301.0, None)]
    with pytest.raises(ValueError):
        delimited.read_level2(spark, "", mapping)
    assert delimited.read_level5(spark, None, mapping).count() == 0
    assert delimited.read_standards(spark, str(tmp_path / "absent.csv"), mapping).count() == 0
    with pytest.raises(ValueError):
        delimited.map_columns(lib, {"x": "Z"}, strict=True)
    assert "title" in delimited.map_columns(lib, {"title": "name", "other": ""}, allow_names=True).columns
    with pytest.raises(ValueError):
        delimited.harmonise(lib, library=False)
    assert "id" in delimited.harmonise(lib, library=True).columns


def test_repeat_units(spark, tmp_path):
    path = tmp_path / "units.json"
    path.write_text(json.dumps({"repeating_units": {"CH2": 14.0156}}))
    assert delimited.read_repeat_units(spark, str(path)) == {"CH2": 14.0156}
    assert delimited.read_repeat_units(spark, str(tmp_path / "none.json")) == {"CF2": 49.9968}


CEF = """<?xml version="1.0"?><CEF><CompoundList>
<Compound><Location rt="1.5" ccs="150.0" dt="20.0"/><Spectrum type="A"><MSPeaks><p x="300.1" y="100"/><p x="301.1"/></MSPeaks></Spectrum></Compound>
<Compound mppid="x"><Spectrum><MSPeaks><p x="1" y="1"/></MSPeaks></Spectrum></Compound>
<Compound mppid="y"><Location rt="2.5"/><Spectrum><MSPeaks><p x="400.1" y="7"/></MSPeaks></Spectrum><Spectrum><MSPeaks><p x="401.1" y="8"/></MSPeaks></Spectrum></Compound>
</CompoundList></CEF>
"""


@pytest.mark.parametrize("limit", [None, 0])
def test_cef(spark, tmp_path, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(ordered, "GROUP_ROWS", limit)
    (tmp_path / "S1.cef").write_text(CEF)
    (tmp_path / "S2.cef").write_text(CEF[: CEF.index("</CompoundList>")])
    (tmp_path / "notes.txt").write_text("no")
    peaks = cef.read_cef(spark, str(tmp_path))
    got = sorted((r.source_file, r.compound, r.rt, r.ccs, r.peak_mz, r.peak_intensity) for r in peaks.na.fill(-1.0).collect())
    assert got == [
        ("S1.cef", 1, 1.5, 150.0, 300.1, 100.0), ("S1.cef", 1, 1.5, 150.0, 301.1, -1.0),
        ("S1.cef", 2, 2.5, -1.0, 400.1, 7.0), ("S1.cef", 2, 2.5, -1.0, 401.1, 8.0)]
    assert [r.sample for r in cef.cef_samples(peaks).collect()] == ["S1"]


def test_cef_folders_are_read_in_one_pass(spark, tmp_path):
    """Files of one name in several folders are files of their own; a pass a folder made the jobs grow with the samples."""
    one = "<CEF><CompoundList><Compound><Location rt='{0}'/><Spectrum><MSPeaks><p x='{0}' y='2'/></MSPeaks></Spectrum></Compound>"
    for sample, n in (("A", 3), ("B", 2), ("C", 1)):
        folder = tmp_path / f"source_file={sample}.cef"
        folder.mkdir()
        end = "</CompoundList></CEF>" if sample != "C" else "<Compound>"
        (folder / "part-0.cef").write_text("".join(one.format(100 + i) for i in range(n)) + end)
    peaks = cef.read_cef(spark, f"{tmp_path}/*", r"/source_file=([^/]+)\.cef/[^/]+$")
    assert sorted((r.source_file, r.compound, r.peak_mz) for r in peaks.collect()) == [("A", 1, 100.0), ("A", 2, 101.0), ("A", 3, 102.0), ("B", 1, 100.0), ("B", 2, 101.0)]



def test_big_cef_is_numbered_in_document_order(spark, tmp_path):
    body = "".join(f'<Compound><Location rt="{i}"/><Spectrum><MSPeaks><p x="{i}" y="1"/></MSPeaks></Spectrum></Compound>\n' for i in range(2000))
    (tmp_path / "big.cef").write_text(f"<CEF><CompoundList>{body}</CompoundList></CEF>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        peaks = cef.read_cef(spark, str(tmp_path))
        assert peaks.where(F.col("compound") != F.col("rt") + 1).count() == 0 and peaks.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_beyond_double_precision(spark):
    df = spark.createDataFrame([("9007199254740993", "1.0"), ("9007199254740992", "2.0"), ("7.0", "3.0")], "feature_id string, mz string")
    features, _ = delimited.to_long(df.withColumn("S", F.lit("1")), [], ["S"])
    assert sorted(r.feature_id for r in features.collect()) == [7, 9007199254740992, 9007199254740993]
    assert delimited.require_unique_ids(features).count() == 3
    with pytest.raises(ValueError):
        delimited.require_unique_ids(features.unionByName(features))


def test_optional_files_forgive_absence_only(spark, tmp_path):
    assert delimited.read_repeat_units(spark, str(tmp_path / "none.json")) == delimited.read_repeat_units(spark, None)
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(ValueError):
        delimited.read_repeat_units(spark, str(tmp_path / "bad.json"))
    mapping = {"name": "A", "mz": "B", "ccs": "C"}
    assert delimited.read_standards(spark, str(tmp_path / "none.csv"), mapping).count() == 0
    (tmp_path / "std.csv").write_text("n,m,c\nx,1.5,2.5\n")
    assert delimited.read_standards(spark, str(tmp_path / "std.csv"), mapping).count() == 1
    with pytest.raises(ValueError):
        delimited.read_standards(spark, str(tmp_path / "std.csv"), {"name": "A", "mz": "1", "ccs": "C"})


def test_many_small_files_cost_a_job_for_all_headers_and_one_to_read(spark, tmp_path):
    for i in range(120):
        sep = "\t" if i % 3 == 0 else ","
        (tmp_path / f"f {i:03d} [x].csv").write_text(sep.join(["ID", "m/z", "S.d"]) + "\n" + sep.join([str(i), f"{300 + i}.5", "1"]) + "\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        raw = delimited.read_delimited(spark, [str(tmp_path)])
        rows = raw.collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert sorted(int(r.ID) for r in rows) == list(range(120)) and {r["m/z"] for r in rows} == {f"{300 + i}.5" for i in range(120)}
    assert len(jobs) <= 4  # headers, reading, and one of Spark's own to list the files of each of the two layouts
    assert delimited.combine_dotted(spark, [str(tmp_path)]).count() == 120


def test_layouts_keep_the_order_of_the_paths(spark, tmp_path):
    (tmp_path / "z.csv").write_text("\ufeffID,a.d\n1,5\n")
    (tmp_path / "a.csv").write_text("ID,b.d,b.d, ,\n2,6,7,8,9\n")
    (tmp_path / "empty.csv").write_text("")
    raw = delimited.read_delimited(spark, [str(tmp_path / "z.csv"), str(tmp_path / "a.csv"), str(tmp_path / "empty.csv")])
    assert [c for c in raw.columns if c != "source_file"] == ["ID", "a.d", "b.d1", "b.d2", "_c3", "_c4"]
    assert sorted(r.ID for r in raw.collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, [str(tmp_path / "empty.csv")])


def test_sorted_report_in_parts(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("mz"), F.concat(F.lit("line\n"), F.col("id").cast("string")).alias("text")).repartition(7)
    path = str(tmp_path / "report")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would become one
    try:
        delimited.write_report(rows.drop("text"), path, order=["mz"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 1  # no single task writes it all
    manifest = [json.loads(line) for p in (tmp_path / "report.manifest").iterdir() if p.name.startswith("part-") for line in p.read_text().splitlines()]
    assert sum(m["rows"] for m in manifest) == 5000
    text = [line for m in manifest for line in (tmp_path / "report" / m["file"]).read_text().splitlines()[1:]]
    assert [int(x) for x in text] == list(range(5000))
    back = delimited.read_report(spark, path).orderBy("_part", "_row").collect()
    assert [int(r.mz) for r in back] == list(range(5000))
