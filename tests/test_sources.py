"""Readers on files written here."""

import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from plinth.sources import artifacts, indoorgml, step

IFC = """ISO-10303-21;
DATA;
#1=IFCBUILDINGSTOREY('s1',$,'Level 1',$,$,#9,$,$,.ELEMENT.,0.);
#2=IFCSPACE('r1',$,'Room; one',$,'',#9,$,$,.ELEMENT.,.INTERNAL.,$);
#3=IFCSPACE('r2',$,$,$,'Store ''A''',#9,$,$,.ELEMENT.,.INTERNAL.,$);
#4=IFCDOOR('d1',$,'Door',$,$,#9,$,$,2.1,0.9);
#5=IFCRELSPACEBOUNDARY('b1',$,$,$,#2,#4,$,.PHYSICAL.,.INTERNAL.);
#6=IFCRELSPACEBOUNDARY('b2',$,$,$,#3,#4,$,.PHYSICAL.,.INTERNAL.);
#7=IFCRELCONTAINEDINSPATIALSTRUCTURE('c1',$,$,$,(#4),#1);
#8=IFCRELAGGREGATES('a1',$,$,$,#1,(#2,#3));
ENDSEC;
"""

GML = """<g:IndoorFeatures xmlns:g="urn:a" xmlns:m="urn:m" xmlns:l="urn:l">
<g:CellSpace m:id="c1"><m:name>A</m:name><m:posList>0 0 0 4 0 0 4 4 0 0 4 0</m:posList><g:duality l:href="#n1"/></g:CellSpace>
<g:CellSpace m:id="c2"><m:posList>4 0 0 8 0 0 8 4 0 4 4 0</m:posList><g:duality l:href="#n2"/></g:CellSpace>
<g:CellSpaceBoundary m:id="w1"><m:pos>4 1 0</m:pos><m:pos>4 2 0</m:pos></g:CellSpaceBoundary>
<g:State m:id="n1"><g:duality l:href="#c1"/><m:pos>2 2 0</m:pos></g:State><g:State m:id="n2"><g:duality l:href="#c2"/></g:State>
<g:Transition m:id="t1"><g:connects l:href="#n1"/><g:connects l:href="#n2"/><g:duality l:href="#w1"/></g:Transition>
<g:Transition m:id="t2"><g:connects l:href="#n1"/><g:connects l:href="#n2"/></g:Transition></g:IndoorFeatures>"""


def test_step(spark, tmp_path):
    (tmp_path / "a.ifc").write_text(IFC)
    rows = step.read_step(spark, str(tmp_path)).cache()
    e = {r.id: r for r in step.entities(rows).collect()}
    assert (e[2].name, e[3].name, e[4].kind, e[1].global_id) == ("Room; one", "Store 'A'", "door", "s1")
    assert {(r.element, r.storey) for r in step.element_storeys(rows).collect()} == {(2, 1), (3, 1), (4, 1)}
    assert {(r.edge, r.space, r.element) for r in step.space_boundaries(rows).collect()} == {("b1", 2, 4), ("b2", 3, 4)}


def test_subtypes_parts_and_openings(spark, tmp_path):
    text = """#1=IFCBUILDINGSTOREY('s1',$,'One',$,$);#2=IFCBUILDINGSTOREY('s2',$,'Two',$,$);
#10=IFCWALLELEMENTEDCASE('w1',$,'W',$,$);#11=IFCSLAB('p1',$,'Slab',$,$);#12=IFCSTAIR('st',$,$,$,$);#13=IFCSTAIRFLIGHT('f1',$,$,$,$);#14=IFCSTAIRFLIGHT('f2',$,$,$,$);
#20=IFCOPENINGELEMENT('o1',$,$,$,'Void');#21=IFCOPENINGSTANDARDCASE('o2',$,$,$,$);#22=IFCOPENINGELEMENT('o3',$,$,$,$);
#30=IFCDOORSTANDARDCASE('d1',$,$,$,$);#31=IFCDOOR('d2',$,$,$,$);#32=IFCWINDOW('v1',$,$,$,$);#33=IFCDOOR('',$,$,$,$);#34=IFCSYSTEMFURNITUREELEMENT('q',$,$,$,$);
#40=IFCRELVOIDSELEMENT('a',$,$,$,#10,#20);#41=IFCRELVOIDSELEMENT('b',$,$,$,#11,#20);#42=IFCRELVOIDSELEMENT('c',$,$,$,#11,#21);#43=IFCRELVOIDSELEMENT('c',$,$,$,#99,#22);
#50=IFCRELFILLSELEMENT('e',$,$,$,#20,#30);#51=IFCRELFILLSELEMENT('f',$,$,$,#20,#32);#52=IFCRELFILLSELEMENT('g',$,$,$,#20,#31);#53=IFCRELFILLSELEMENT('h',$,$,$,#20,#33);#54=IFCRELFILLSELEMENT('i',$,$,$,#21,#11);
#60=IFCRELCONTAINEDINSPATIALSTRUCTURE('j',$,$,$,(#10,#21),#1);#61=IFCRELCONTAINEDINSPATIALSTRUCTURE('k',$,$,$,(#11),#2);
#70=IFCRELAGGREGATES('l',$,$,$,#12,(#13,#14));#71=IFCRELAGGREGATES('m',$,$,$,#12,(#13));#72=IFCRELAGGREGATES('n',$,$,$,#98,(#14));
"""
    (tmp_path / "a.ifc").write_text(text)
    rows = step.read_step(spark, str(tmp_path)).cache()
    kinds = {r.id: r.kind for r in step.entities(rows).collect()}
    assert kinds == {1: "storey", 2: "storey", 10: "wall", 12: "stair", 20: "opening", 21: "opening", 22: "opening", 30: "door", 31: "door", 32: "window", 33: "door", 34: "furniture"}
    assert sorted((r.element, r.part) for r in step.aggregated_parts(rows).collect()) == [(12, 13), (12, 14)]
    found = {r.global_id: (r.storey, r.host, r.host_is_wall, r.door, r.window) for r in step.openings(rows).collect()}
    assert found == {"o1": (1, 10, True, "d2", "v1"), "o2": (1, 11, False, None, None), "o3": (None, None, False, None, None)}
    assert step.openings(rows.limit(0)).count() == 0 == step.aggregated_parts(rows.limit(0)).count()


def test_step_strings_comments_and_archives(spark, tmp_path):
    odd = """ISO-10303-21; /* it's; #7=IFCSPACE('no',$,$); */ HEADER; FILE_NAME('a;b''(');
#1=IFCBUILDINGSTOREY('s1',$,'Level; 1',$,$);#2 = ifcspace ( 'r1' , $ ,'Room /* x */, ''y'' (',\n$,/* gone; */'');
#3=IFCDOOR('d1',$,'/',(1,(2,3)),$);
"""
    (tmp_path / "a.ifc").write_text(odd)
    with zipfile.ZipFile(tmp_path / "b.ifczip", "w") as z:
        z.writestr("note.txt", "#9=IFCSPACE('no');")
        z.writestr("inner/m.IFC", "#5=IFCSPACE('z1',$,'Zip',$,'');" + "#6=IFCLIST((" + ",".join(map(str, range(60_000))) + "));")
    (tmp_path / "c.ifc").write_text("")
    got = {r.id: (r.type, r.args) for r in step.read_step(spark, str(tmp_path)).collect()}
    assert got[1] == ("IFCBUILDINGSTOREY", ["'s1'", "$", "'Level; 1'", "$", "$"])
    assert got[2] == ("IFCSPACE", ["'r1'", "$", "'Room /* x */, ''y'' ('", "$", "''"])
    assert got[3] == ("IFCDOOR", ["'d1'", "$", "'/'", "(1,(2,3))", "$"])
    assert got[5][1][2] == "'Zip'" and len(got[6][1]) == 1 and set(got) == {1, 2, 3, 5, 6}


def test_indoorgml(spark, tmp_path):
    (tmp_path / "a.gml").write_text(GML)
    rows = indoorgml.read_indoorgml(spark, str(tmp_path)).cache()
    assert rows.filter("kind = 'CellSpace'").count() == 2
    got = {r.transition: (r.door, r.a, r.b, r.x, r.y) for r in indoorgml.connections(rows).collect()}
    assert got == {"t1": ("w1", "c1", "c2", 4.0, 1.5), "t2": ("transition_t2", "c1", "c2", 4.0, 2.0)}


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "graphs")
    made = artifacts.ensured(spark, path, "m1", "ifc", lambda: spark.range(3).toDF("n"))
    assert made.count() == 3
    assert artifacts.ensured(spark, path, "m1", "ifc", lambda: spark.range(9).toDF("n")).count() == 3
    assert artifacts.ensured(spark, path, "m2", "ifc", lambda: spark.range(4).toDF("n")).count() == 4  # beside another model's
    assert not artifacts.has_files(spark, str(tmp_path / "nowhere"))
    with pytest.raises(KeyError):  # what goes wrong in building isn't taken for a missing artifact
        artifacts.ensured(spark, path, "m3", "ifc", lambda: {}["m3"])
    shares = spark.createDataFrame([("0" * 32, "2024-01-09"), ("0" * 32, "2024-01-01"), ("bad", "2024-01-09")], "share_id string, modified string").withColumn("modified", F.to_timestamp("modified"))
    assert artifacts.live_shares(shares, F.to_timestamp(F.lit("2024-01-10"))).count() == 1
    agents = spark.createDataFrame([("Mozilla iPhone", True, True), ("x", True, True), ("x", True, False), ("x", False, False)], "ua string, u boolean, g boolean")
    assert [r[0] for r in agents.select(artifacts.landing_format(F.col("ua"), F.col("u"), F.col("g"))).collect()] == ["usdz", "glb", "usdz", None]


def test_status_rows(spark, tmp_path):
    path = str(tmp_path / "status")
    at = lambda *rows: spark.createDataFrame(rows, "model_id string, status string, at string").withColumn("at", F.to_timestamp("at"))
    artifacts.record_status(at(("m1", "none", "2024-01-01"), ("m2", "none", "2024-01-01")), path)
    artifacts.record_status(at(("m1", "ready", "2024-01-02")), path)
    artifacts.record_status(at(("m2", "failed", "2024-01-01")), path)
    assert sorted((r.model_id, r.status) for r in artifacts.current_status(spark, path).collect()) == [("m1", "ready"), ("m2", "none")]


def test_sweep_removes_whole_days(spark, tmp_path):
    path = str(tmp_path / "shares")
    assert artifacts.sweep_shares(spark, path, date(2024, 1, 10)) == []
    rows = [(f"{k:032x}", f"2024-01-{day:02} 12:00:00") for k, day in enumerate((1, 2, 3, 9))]
    artifacts.write_shares(spark.createDataFrame(rows, "share_id string, modified string").withColumn("modified", F.to_timestamp("modified")), path)
    assert artifacts.sweep_shares(spark, path, date(2024, 1, 10)) == ["2024-01-01", "2024-01-02"]
    assert spark.read.parquet(path).count() == 2 and artifacts.sweep_shares(spark, path, date(2024, 1, 10)) == []


def test_archives_without_a_model(tmp_path):
    def packed(*names):
        with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
            for n in names:
                z.writestr(n, f"in {n}")
        return (tmp_path / "x.zip").read_bytes()

    assert step.member_text(packed("a.txt", "b.ifcXML", "c.ifc")) == "in b.ifcXML"
    with pytest.raises(ValueError, match="no .ifc"):
        step.member_text(packed("a.txt"))


def test_footprint_walks(spark):
    from plinth.operators import footprints as f

    assert f.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert f.hull([(1, 1)]) == [(1, 1)]
    assert f.simplified([(0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    square = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0)), ((5, 5), (6, 6))]
    assert [sorted(r) for r in f.stitched(square)] == [[(0, 0), (0, 1), (1, 0), (1, 1)]]
