"""Catalog, templates, console, streaming, settings, sections."""

import pytest

from quern.access import Directory, Role, decisions, expand, hidden_fields
from quern.cli import console
from quern.lang.diag import QueryError
from quern.sample_model import engine
from quern.sources.catalog import Catalog
from quern.streaming.turnovers import stream_turnovers


def test_information_schema(spark, sf):
    c = Catalog(engine(spark, sf))
    got = c.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'Catalog.Nations' ORDER BY ordinal_position").collect()
    assert [r[0] for r in got] == ["Ref", "Description", "Region"]
    got = c.sql("SELECT c.relname FROM pg_catalog.pg_class c LEFT JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r') AND n.nspname !~ '^pg_toast' AND c.relname OPERATOR(pg_catalog.~) '^(Catalog.Parts)$' AND pg_catalog.pg_table_is_visible(c.oid) ORDER BY 1").collect()
    assert [r[0] for r in got] == ["Catalog.Parts"]
    assert c.sql("SELECT count(*) FROM information_schema.table_constraints WHERE constraint_type = 'FOREIGN KEY' AND table_name = 'Document.Orders'").first()[0] == 1
    with pytest.raises(ValueError):
        c.sql("DROP TABLE x")


def test_templates():
    t = {"Own": "ТекущаяТаблица.#Параметр(1) = &User", "Both": '#Own("A") И #Own("B")'}
    assert expand("#Если &Admin #Тогда ИСТИНА #Иначе #Own(Author) #КонецЕсли", t, {"Admin": False}).split() == "ТекущаяТаблица.Author = &User".split()
    assert expand('#If &Role = "x" And Not &Admin #Then A #ElsIf &Admin #Then B #Else C #EndIf', t, {"Role": "x", "Admin": True}).split() == ["B"]
    assert expand("#Both", t) == "ТекущаяТаблица.A = &User И ТекущаяТаблица.B = &User"
    for bad in ("#Nope", "#If &X #Then A #EndIf", "#If TRUE #Then A"):
        with pytest.raises(QueryError):
            expand(bad, t)
    with pytest.raises(QueryError):
        expand("#Loop", {"Loop": "#Loop"})


def test_console(spark, sf):
    out = []
    console(engine(spark, sf), ["\\set R 2\n", "SELECT N.Ref AS R FROM Catalog.Regions AS N\n", "WHERE N.Ref = &R\n", "\n", "SELECT Nope\n", "\n", "\\d Catalog.Regions\n", "\\q\n", "\\dt\n"], out.append)
    assert out[:2] == ["R", "2"] and out[2].startswith("error: unknown_field") and out[3].startswith("Ref\tref") and len(out) == 4


def test_streaming(spark, sf, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "x", 0, 5), ("2024-01-01 02:00:00", "x", 1, 2), ("2024-01-03 00:00:00", "y", 0, 1)], "Period string, Item string, Kind int, Qty int").selectExpr("CAST(Period AS timestamp) Period", "Item", "Kind", "Qty")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_turnovers(source, ["Item"], ["Qty"], record_type="Kind").writeStream.outputMode("complete").format("memory").queryName("turns").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.Item, r.QtyTurnover, r.QtyReceipt, r.QtyExpense) for r in spark.table("turns").collect()) == [("x", 3, 5, 2), ("y", 1, 1, 0)]


def test_settings(spark):
    df = spark.createDataFrame([("u", "o", "k", "v"), ("U", "o", "k", "w")], "userid string, objectkey string, settingskey string, settingsdata string")
    e = engine(spark, "")
    e.tables = lambda name: df
    assert [r[0] for r in e.setting("settings", "u", "o", "k").collect()] == ["v"]


def test_projected_section(spark, sf):
    r = engine(spark, sf).query("SELECT D.Ref AS Ref, D.Lines.(Part, Quantity) FROM Document.Orders AS D WHERE D.Ref = 1").first()
    assert [f for f in r.Lines[0].asDict()] == ["LineNumber", "Part", "Quantity"] and [x.LineNumber for x in r.Lines] == sorted(x.LineNumber for x in r.Lines)


def test_field_usage(spark, sf):
    use = engine(spark, sf).field_usage("SELECT A.X FROM Catalog.Parts AS A LEFT JOIN Catalog.Parts AS B ON A.K = B.K WHERE A.X > 1 ORDER BY A.Z")
    assert use["A.X"] == {"projection", "condition"} and use["A.K"] == {"join"} and use["A.Z"] == {"ordering"}


def test_roles_add_up(spark, sf):
    reader = Role("reader", {"Catalog.Customers": "#Mine", "Catalog.Nations": True}, {"Mine": "Nation.Region = &R"}, {"Catalog.Customers": {"Ref", "Description"}})
    other = Role("other", {"Catalog.Customers": "Ref < 3"})
    found = decisions([reader, other], ["Catalog.Customers", "Catalog.Nations", "Catalog.Parts"])
    assert found == {"Catalog.Customers": "(Nation.Region = &R) OR (Ref < 3)", "Catalog.Nations": None, "Catalog.Parts": False}
    e = engine(spark, sf, restrictions=found | {"Catalog.Regions": None}, restricted=True, session={"R": 99})
    assert e.query("SELECT C.Ref FROM Catalog.Customers AS C").count() == 3
    assert e.query("SELECT P.Ref FROM Catalog.Parts AS P").count() == 0
    assert hidden_fields([reader], "Catalog.Customers", ["Ref", "Description", "Balance"]) == {"Balance"}


def test_describe(spark, sf):
    found = engine(spark, sf).describe('SELECT C.Nation AS N, CASE WHEN C.Ref = 1 THEN "a" ELSE 2 END AS V FROM Catalog.Customers AS C')
    assert found[0] == {"label": "N", "kind": "ref", "targets": ["Catalog.Nations"], "columns": ["N"]} and found[1]["columns"][0] == "V_TYPE"


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "tables", "jdbc"])
def test_readers(spark, tmp_path, kind):
    """The same query over every kind of source, with filters in the scan."""
    from quern.engine import Engine
    from quern.model import Field, Model, Object
    from quern.sources import readers

    df = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(20)], "ID int, NAME string, X double")
    if kind == "tables":
        df.write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("quern_reader")
        read = readers.tables(spark)
    elif kind == "jdbc":
        url = f"jdbc:derby:{tmp_path}/db;create=true"
        df.write.option("createTableColumnTypes", "NAME VARCHAR(20)").jdbc(url, "QUERN_READER", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
        read = readers.jdbc(spark, url, {"quern_reader": ("ID", 0, 20, 3)}, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    else:
        writer = df.write.option("header", True) if kind == "csv" else df.write
        getattr(writer, kind)(str(tmp_path / f"quern_reader.{kind}"))
        read = readers.csv(spark, str(tmp_path), {"quern_reader": "ID int, NAME string, X double"}) if kind == "csv" else getattr(readers, kind)(spark, str(tmp_path))
    model = Model([Object("Catalog", "Things", [Field("Ref", "ID", "number"), Field("Description", "NAME", "string"), Field("X", "X", "number")], "quern_reader")])
    found = Engine(spark, model, read).query('SELECT T.Ref AS R FROM Catalog.Things AS T WHERE T.X > 20 AND T.Description <> "n17"')
    assert sorted(r.R for r in found.collect()) == [14, 15, 16, 18, 19]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(X,20.0)" in plan
    if kind == "jdbc":
        assert found.rdd.getNumPartitions() == 3
    if kind == "tables":
        spark.sql("DROP TABLE quern_reader")


def test_console_of_users_and_roles(spark, sf):
    roles = [Role("reader", {"Catalog.Regions": "#Few", "Catalog.Nations": True}, {"Few": "Ref < &Most"}), Role("other", {"Catalog.Parts": True})]
    out = []
    lines = ["\\users", "\\user ann", "\\roles read", "\\role reader", "\\role reader Catalog.Regions", "\\template reader Few", "\\as", "\\as ann", "\\rls", "\\rls Catalog.Regions", "SELECT R.Ref AS R FROM Catalog.Regions AS R", "", "SELECT P.Ref FROM Catalog.Parts AS P", "", "\\as nobody", "\\role x", "\\as clear", "SELECT COUNT(*) AS N FROM Catalog.Regions AS R", ""]
    console(engine(spark, sf, session={"Most": 2}), lines, out.append, Directory({"ann": ["reader"], "bob": ["reader", "other"]}, roles))
    assert out[:3] == ["ann\treader\nbob\treader, other", "ann: reader", "reader"]
    assert out[3] == "Catalog.Nations\tall rows\nCatalog.Regions\t#Few" and out[4] == "Catalog.Regions\t#Few" and out[5] == "Ref < &Most" and out[6] == "no current user" and out[7] == "current user: ann (reader)"
    assert "Catalog.Regions\t(Ref < &Most)" in out[8] and out[9] == "(Ref < &Most)"
    assert out[10:13] == ["R", "0", "1"] and out[13] == "Ref" and out[14] == "no user nobody" and out[15] == "no role x" and out[16] == "current user cleared" and out[17:] == ["N", "5"]


def test_rights_of_attributes(spark, sf):
    from quern.access import granted, granted_by_any

    m = engine(spark, sf).model
    grant = lambda *a, **k: granted(m, *a, **k)
    loose = Role("loose", {}, listed={("Document.Orders", "Status", "View"): True}, independent=True)
    assert not grant(loose, "Document.Orders", "View", "Status") and grant(loose, "Document.Orders", "View", "Status", verification=True)
    assert not grant(loose, "Document.Orders", "View", "Total", verification=True)
    default = Role("default", {}, attributes=True, independent=True)
    assert grant(default, "Document.Orders", "View", "Total", verification=True)
    assert granted_by_any(m, [Role("none", {}), Role("all", {}, new_objects=True)], "Catalog.Parts", "Чтение")
    for role, args, kind in (
        (default, ("Catalog.Parts", "View", "Description", True), "unsupported"), (default, ("Catalog.Parts", "Read", "Code"), "restriction"), (default, ("Catalog.Parts", "Fly"), "restriction"), (default, ("Catalog.Parts", "Insert"), "unsupported"),
        (default, ("AccumulationRegister.Stock", "Read"), "unsupported"), (default, ("Catalog.Nope", "Read"), "unknown_object"), (default, ("Catalog.Parts", "View", "Brand"), "unknown_field"), (default, ("Document.Orders", "View", "Nope"), "unknown_field"),
    ):
        with pytest.raises(QueryError) as found:
            granted(m, role, *args)
        assert found.value.kind == kind
