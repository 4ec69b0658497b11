"""The language over small tables made here: edge rows and diagnostics."""

import datetime

import pytest

from quern.catalog_queries import oracle_sql, queries
from quern.engine import DENIED, Engine, ValueTable, unique_labels
from quern.lang import ast
from quern.lang.diag import QueryError
from quern.lang.lexer import tokenize
from quern.lang.parser import parse
from quern.model import Field, Model, Object
from quern.plans.virtual import Boundary, PointInTime
from quern.sample_model import engine
from tests.oracle import check

D = datetime.datetime


def small(spark, **how):
    ref = lambda name, sql, *targets, **more: Field(name, sql, "ref", (), targets, **more)
    model = Model([
        Object("Catalog", "Goods", [ref("Ref", "id", "Catalog.Goods"), Field("Description", "name", "string"), ref("Parent", "parent", "Catalog.Goods")], "goods", ("Товары",), 1, empty_ref="", predefined={"Box": "b"}),
        Object("Catalog", "Firms", [ref("Ref", "id", "Catalog.Firms"), Field("Description", "name", "string")], "firms", (), 2),
        Object("AccumulationRegister", "Stock", [Field("Period", "p", "date"), Field("Recorder", "rec", "number"), Field("Active", "act", "boolean"), Field("RecordType", "k", "number"), Field("Item", "item", "string", ("Товар",), purpose="dimension"), Field("Place", "place", "string", ("Место",), purpose="dimension"), Field("Qty", "q", "number", ("Кол",), purpose="resource")], "moves"),
        Object("InformationRegister", "Prices", [Field("Period", "p", "date"), Field("Item", "item", "string", purpose="dimension"), Field("Price", "price", "number", purpose="resource")], "prices"),
        Object("Document", "Notes", [ref("Ref", "id", "Document.Notes"), ref("Owner", "CASE WHEN kind = 1 THEN named_struct('type', 1, 'ref', owner) WHEN kind = 2 THEN named_struct('type', 2, 'ref', owner) END", "Catalog.Goods", "Catalog.Firms"), Field("Text", "text", "string")], "notes", (), 3),
    ])
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = lambda day, h=0: D(2024, 1, day, h)
    tables = {
        "goods": t([("a", "Root", None), ("b", "Box", "a"), ("c", "Small", "b"), ("z", "Lone", None), ("e", "Empty", "a")], "id string, name string, parent string"),
        "firms": t([("a", "Firm A"), ("f", "Firm F")], "id string, name string"),
        "moves": t([(d(1), 1, True, 0, "x", "m", 10), (d(2), 2, True, 1, "x", "m", 10), (d(2), 3, True, 0, "y", None, 5), (d(3), 4, False, 0, "y", None, 100), (d(5), 5, True, 1, "y", None, 2), (d(5), 6, True, 0, "x", "n", None)], "p timestamp_ntz, rec int, act boolean, k int, item string, place string, q int"),
        "prices": t([(d(1), "x", 1), (d(3), "x", 2), (d(3), "x", 3), (d(9), "x", 4), (d(2), None, 7)], "p timestamp_ntz, item string, price int"),
        "notes": t([(1, 1, "a", "one "), (2, 2, "a", "one"), (3, None, None, "One"), (4, 2, "gone", None)], "id int, kind int, owner string, text string"),
    }
    return Engine(spark, model, tables.__getitem__, **how)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def kind(spark, text, params=None, **how):
    with pytest.raises(QueryError) as e:
        small(spark, **how).query(text, params)
    return e.value.kind


def test_tokens():
    assert [t.kind for t in tokenize('ВЫБРАТЬ &П, "a""b" // c\n 0xFF <> 1.5')] == ["word", "param", "op", "string", "hex", "op", "number", "end"]
    with pytest.raises(QueryError):
        tokenize("SELECT ?")


def test_both_spellings_parse_alike():
    a = parse("SELECT DISTINCT TOP 3 T.A FROM Catalog.X AS T WHERE NOT T.A = 1 AND T.B IS NULL")
    b = parse("ВЫБРАТЬ РАЗЛИЧНЫЕ ПЕРВЫЕ 3 T.A ИЗ Catalog.X КАК T ГДЕ НЕ T.A = 1 И T.B ЕСТЬ NULL")
    strip = lambda x: [n.parts if isinstance(n, ast.Path) else type(n) for n in ast.walk(x[0])]
    assert strip(a) == strip(b)


def test_labels():
    assert unique_labels(["A", "a", "B", "A"]) == ["A", "a_2", "B", "A_3"]


def test_balance_drops_zero_and_ignores_inactive(spark):
    e = small(spark)
    assert rows(e.query("SELECT T.Item, T.Place, T.QtyBalance FROM AccumulationRegister.Stock.Balance() AS T")) == [("y", None, 3)]
    # A pruned dimension is summed after zero rows are gone.
    assert rows(e.query("ВЫБРАТЬ Т.Товар, Т.КолОстаток ИЗ РегистрНакопления.Stock.Остатки(&П) КАК Т", {"П": D(2024, 1, 2)})) == [("x", 10)]


def test_balance_at_point_and_boundary(spark):
    e, text = small(spark), "SELECT T.Item, T.QtyBalance FROM AccumulationRegister.Stock.Balance(&P) AS T"
    assert rows(e.query(text, {"P": PointInTime(D(2024, 1, 2), 3)})) == []
    assert rows(e.query(text, {"P": Boundary(PointInTime(D(2024, 1, 2), 3), True)})) == [("y", 5)]
    assert rows(e.query(text, {"P": Boundary(D(2024, 1, 1), True)})) == [("x", 10)]


def test_turnovers_are_half_open(spark):
    e = small(spark)
    got = rows(e.query("SELECT T.Item, T.QtyReceipt, T.QtyExpense FROM AccumulationRegister.Stock.Turnovers(DATETIME(2024,1,1), DATETIME(2024,1,5)) AS T"))
    assert got == [("x", 10, 10), ("y", 5, 0)]


def test_running_balances(spark):
    got = rows(small(spark).query("SELECT T.Item, T.Place, T.Period, T.QtyOpeningBalance, T.QtyClosingBalance FROM AccumulationRegister.Stock.BalanceAndTurnovers(DATETIME(2024,1,2), , DAY) AS T WHERE T.Item = \"y\""))
    assert got == [("y", None, D(2024, 1, 2), 0, 5), ("y", None, D(2024, 1, 5), 5, 3)]


def test_slice_keeps_ties_and_null_dimensions(spark):
    got = rows(small(spark).query("SELECT T.Item, T.Price FROM InformationRegister.Prices.SliceLast(DATETIME(2024,1,3)) AS T"))
    assert got == [("x", 2), ("x", 3), (None, 7)]
    # The outer condition filters after ranking, the table's own before.
    assert rows(small(spark).query("SELECT T.Price FROM InformationRegister.Prices.SliceLast() AS T WHERE T.Price < 4")) == []
    assert rows(small(spark).query("SELECT T.Price FROM InformationRegister.Prices.SliceLast(, Price < 4) AS T WHERE T.Item = \"x\"")) == [(2,), (3,)]


def test_hierarchy(spark):
    e = small(spark)
    assert rows(e.query('SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref IN HIERARCHY (VALUE(Catalog.Goods.Box))')) == [("b",), ("c",)]
    assert rows(e.query('SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref NOT IN HIERARCHY ("a")')) == [("z",)]
    got = [tuple(r) for r in e.query("SELECT G.Ref AS R, 1 AS N FROM Catalog.Goods AS G ORDER BY R TOTALS SUM(N) BY R HIERARCHY", totals_level=True).collect()]
    assert got[0] == ("a", 4, 1) and ("b", 2, 2) in got and ("c", 1, 3) in got
    assert got.index(("b", 2, 2)) < got.index(("c", 1, 3))


def test_totals_order(spark):
    got = [tuple(r) for r in small(spark).query("SELECT M.Item AS I, M.Qty AS Q FROM AccumulationRegister.Stock AS M ORDER BY I DESC, Q TOTALS SUM(Q) BY OVERALL, I").collect()]
    assert got == [(None, 127), ("y", 107), ("y", 2), ("y", 5), ("y", 100), ("x", 20), ("x", 10), ("x", 10), ("x", None)]
    assert small(spark).query("SELECT M.Qty AS Q FROM AccumulationRegister.Stock AS M WHERE FALSE TOTALS SUM(Q) BY OVERALL").count() == 0


def test_references_of_several_types(spark):
    e = small(spark)
    assert rows(e.query("SELECT N.Ref, N.Owner.Description FROM Document.Notes AS N")) == [(1, "Root"), (2, "Firm A"), (3, None), (4, None)]
    assert rows(e.query("SELECT N.Ref FROM Document.Notes AS N WHERE N.Owner REFS Catalog.Firms")) == [(2,), (4,)]
    assert rows(e.query("SELECT N.Ref, CAST(N.Owner AS Catalog.Goods).Description FROM Document.Notes AS N")) == [(1, "Root"), (2, None), (3, None), (4, None)]
    assert rows(e.query("SELECT N.Ref FROM Document.Notes AS N WHERE N.Owner IN (SELECT G.Ref FROM Catalog.Goods AS G)")) == [(1,)]
    assert rows(e.query("SELECT N.Ref, PRESENTATION(N.Owner) FROM Document.Notes AS N")) == [(1, "Root"), (2, "Firm A"), (3, None), (4, "")]


def test_string_equality_ignores_trailing_spaces(spark):
    e = small(spark)
    assert rows(e.query('SELECT N.Ref FROM Document.Notes AS N WHERE N.Text = "one"')) == [(1,), (2,)]
    assert rows(e.query('SELECT N.Ref FROM Document.Notes AS N WHERE N.Text = 1')) == []


def test_nulls_sort_last(spark):
    assert [r[0] for r in small(spark).query("SELECT N.Text AS T FROM Document.Notes AS N ORDER BY T").collect()] == ["One", "one", "one ", None]


def test_temporary_tables_and_values(spark):
    e = small(spark)
    assert e.query("SELECT G.Ref AS R INTO T FROM Catalog.Goods AS G").collect()[0][0] == 5
    assert e.query("SELECT F.Ref AS R ADD T FROM Catalog.Firms AS F".replace("Firms", "Goods")).collect()[0][0] == 5
    assert e.query("SELECT T.R FROM T AS T").count() == 10
    e.query("DROP T")
    with pytest.raises(QueryError):
        e.query("SELECT T.R FROM T AS T")
    table = ValueTable([("b", 1), ("q", 2)], "k string, n int")
    assert rows(e.query("SELECT V.n FROM &V AS V WHERE V.k IN (SELECT G.Ref FROM Catalog.Goods AS G)", {"V": table})) == [(1,)]


def test_failed_batch_changes_nothing(spark):
    e = small(spark)
    with pytest.raises(QueryError):
        e.batch("SELECT G.Ref AS R INTO T FROM Catalog.Goods AS G; SELECT Nothing FROM T")
    assert not e.temp


def test_restrictions(spark):
    text = "SELECT ALLOWED G.Ref FROM Catalog.Goods AS G"
    assert rows(small(spark, restrictions={"Catalog.Goods": 'Parent = "a"'}).query(text)) == [("b",), ("e",)]
    assert rows(small(spark, restrictions={"Catalog.Goods": DENIED}).query(text)) == []
    assert kind(spark, text, restricted=True) == "restriction"
    assert small(spark, restricted=True, restrictions={"Catalog.Goods": None}).query(text).count() == 5


def test_separators(spark, sf):
    with pytest.raises(QueryError):
        engine(spark, sf).query("SELECT T.Ref FROM Catalog.TenantCustomers AS T")


@pytest.mark.parametrize("text, want", [
    ("SELECT", "syntax"), ("SELECT X.A FROM Catalog.Nope AS X", "unknown_object"), ("SELECT G.Nope FROM Catalog.Goods AS G", "unknown_field"),
    ("SELECT Ref FROM Catalog.Goods AS A, Catalog.Firms AS B", "ambiguous_field"), ("SELECT G.Ref + 1 FROM Catalog.Goods AS G", "type"), ("SELECT &P AS A", "parameter"),
    ("SELECT G.Ref, COUNT(*) FROM Catalog.Goods AS G GROUP BY G.Parent", "type"), ("SELECT TOP 1 TOP 2 G.Ref FROM Catalog.Goods AS G", "syntax"),
    ("SELECT G.Ref FROM Catalog.Goods AS G ORDER BY G.Ref HIERARCHY", "unsupported"), ("SELECT G.Ref FROM Catalog.Goods AS G UNION SELECT F.Ref, 1 FROM Catalog.Firms AS F", "type"),
    ("SELECT G.Ref FROM Catalog.Goods AS G FULL JOIN Catalog.Firms AS F ON G.Ref > F.Ref", "unsupported"), ("SELECT SUM(DISTINCT 1)", "unsupported"),
])
def test_diagnostics(spark, text, want):
    assert kind(spark, text) == want


def test_unused_parameter(spark):
    assert kind(spark, "SELECT 1 AS A", {"P": 1}) == "parameter"


def test_discovery(spark):
    found = small(spark).prepare("SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Parent = &P; SELECT T.A FROM T AS T")
    assert found["parameters"] == ["P"] and found["objects"] == ["Catalog.Goods"] and found["temporary_tables"] == ["T"]


def test_scan_reads_only_used_columns(spark, sf):
    plan = engine(spark, sf).query('SELECT C.Ref FROM Catalog.Customers AS C WHERE C.Segment = "BUILDING"')._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_extension_rows_and_service_tables(spark):
    base = spark.createDataFrame([(1, "a")], "id int, name string")
    more = spark.createDataFrame([(2, "b", 7)], "id int, name string, extra int")
    changes = Object("Catalog", "Goods.Changes", [Field("Ref", "id", "ref", (), ("Catalog.Goods",)), Field("Node", "node", "string", ("Узел",))], "changes", ("Изменения",))
    model = Model([Object("Catalog", "Goods", [Field("Ref", "id", "ref", (), ("Catalog.Goods",)), Field("Description", "name", "string")], "goods", sections={"Changes": changes}, extensions=("goods_x",))])
    tables = {"goods": base, "goods_x": more, "changes": spark.createDataFrame([(2, "n1"), (9, "n2")], "id int, node string")}
    e = Engine(spark, model, tables.__getitem__)
    assert rows(e.query("ВЫБРАТЬ Т.Ссылка, Т.Наименование ИЗ Справочник.Goods КАК Т")) == [(1, "a"), (2, "b")]
    assert rows(e.query("SELECT C.Узел, C.Ref.Description FROM Catalog.Goods.Изменения AS C")) == [("n1", "b"), ("n2", None)]


def test_both_spellings_give_equal_plans(spark, sf):
    import re

    e = engine(spark, sf)
    pair = (
        "SELECT T.Part AS A, T.QuantityBalance AS B FROM AccumulationRegister.Stock.Balance(DATETIME(1998,1,1)) AS T WHERE T.QuantityBalance > 3",
        "ВЫБРАТЬ Т.Номенклатура КАК A, Т.КоличествоОстаток КАК B ИЗ РегистрНакопления.Запасы.Остатки(ДАТАВРЕМЯ(1998,1,1)) КАК Т ГДЕ Т.КоличествоОстаток > 3",
    )
    plan = lambda t: re.sub(r"#\d+L?|s\d+_|plan_id=\d+", "", e.query(t)._jdf.queryExecution().optimizedPlan().toString())
    assert plan(pair[0]) == plan(pair[1])


def test_materialized_batches(spark):
    seen = []
    e = small(spark, materialize=lambda df: seen.append(1) or df)
    assert e.query("SELECT G.Ref AS R INTO T FROM Catalog.Goods AS G; SELECT T.R FROM T AS T").count() == 5 and seen == [1]


def test_full_name_as_qualifier(spark):
    assert rows(small(spark).query('SELECT Catalog.Firms.Description FROM Catalog.Firms WHERE Catalog.Firms.Ref = "f"')) == [("Firm F",)]


RESTRICTED = {"Catalog.Goods": 'NOT Ref = "a"', "Document.Notes": None, "Catalog.Firms": DENIED, "AccumulationRegister.Stock": 'Item = "y"'}


@pytest.mark.parametrize("text", [
    'SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref IN HIERARCHY ("a")', 'SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref NOT IN HIERARCHY (SELECT X.Ref FROM Catalog.Goods AS X)',
    "SELECT G.Ref AS R, 1 AS N FROM Catalog.Goods AS G TOTALS SUM(N) BY R HIERARCHY", "SELECT Rate FROM Constants",
])
def test_what_cannot_be_filtered_is_refused(spark, text):
    assert kind(spark, text, restricted=True, restrictions=RESTRICTED) == "unsupported"


def test_every_read_is_filtered(spark):
    e = small(spark, restricted=True, restrictions=RESTRICTED)
    assert rows(e.query("SELECT G.Ref FROM Catalog.Goods AS G")) == [("b",), ("c",), ("e",), ("z",)]
    assert rows(e.query("SELECT G.Ref, G.Parent.Description FROM Catalog.Goods AS G")) == [("b", None), ("c", "Box"), ("e", None), ("z", None)]
    assert rows(e.query("SELECT N.Ref, N.Owner.Description, PRESENTATION(N.Owner) FROM Document.Notes AS N")) == [(1, None, ""), (2, None, ""), (3, None, None), (4, None, "")]
    # A table's own condition does not take the rule's place.
    assert rows(e.query('SELECT T.Item, T.QtyBalance FROM AccumulationRegister.Stock.Balance(, Qty > 0) AS T')) == [("y", 3)]
    assert rows(e.query("SELECT N.Ref FROM Document.Notes AS N WHERE N.Owner IN (SELECT G.Ref FROM Catalog.Goods AS G UNION ALL SELECT F.Ref FROM Catalog.Firms AS F)")) == []
    e.query("SELECT G.Ref AS R INTO Kept FROM Catalog.Goods AS G")
    assert e.query("SELECT K.R FROM Kept AS K").count() == 4


def test_allowed_alone_leaves_dereferences(spark):
    e = small(spark, restrictions={"Catalog.Goods": 'Ref = "c"'})
    assert rows(e.query("SELECT ALLOWED G.Ref, G.Parent.Description FROM Catalog.Goods AS G")) == [("c", "Box")]


def test_temporary_tables_from_before_are_refused(spark):
    e = small(spark)
    e.query("SELECT G.Ref AS R INTO All FROM Catalog.Goods AS G".replace("All", "Whole"))
    e.restricted, e.restrictions = True, RESTRICTED
    with pytest.raises(QueryError) as found:
        e.query("SELECT W.R FROM Whole AS W")
    assert found.value.kind == "unsupported"


def test_rules_with_joins(spark):
    text = "SELECT G.Ref FROM Catalog.Goods AS G"
    rule = lambda t, **how: rows(small(spark, restricted=True, restrictions={"Catalog.Goods": t}, **how).query(text))
    assert rule('ТекущаяТаблица КАК T ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Goods КАК P ПО T.Parent = P.Ref ГДЕ P.Description = "Root"') == [("b",), ("e",)]
    # Several joined rows do not multiply a row.
    assert rule("INNER JOIN Document.Notes AS N ON N.Text = N.Text WHERE TRUE") == [("a",), ("b",), ("c",), ("e",), ("z",)]
    assert rule("LEFT JOIN Catalog.Goods AS F ON F.Parent = ТекущаяТаблица.Ref WHERE F.Ref IS NULL") == [("c",), ("e",), ("z",)]
    assert rule("LEFT JOIN Catalog.Goods AS C ON C.Parent = Goods.Ref LEFT JOIN Catalog.Goods AS D ON D.Parent = C.Ref WHERE NOT D.Ref IS NULL") == [("a",)]
    assert rule('INNER JOIN Catalog.Goods AS F ON F.Ref = Goods.Parent WHERE Goods.Parent.Description = &D AND F.Parent.Description = "Root"', session={"D": "Box"}) == [("c",)]
    assert rule('ТекущаяТаблица КАК T ИЗ Справочник.Товары КАК X ГДЕ X.Parent = "a" И T.Ref <> "e"') == [("b",)]
    assert rule("ГДЕ ИСТИНА = &Open", session={"Open": True}) == [("a",), ("b",), ("c",), ("e",), ("z",)]
    assert rule("&Open = TRUE", session={"Open": False}) == []


def test_rules_see_session_parameters_only(spark):
    e = small(spark, restrictions={"Catalog.Goods": "&Open = TRUE"})
    with pytest.raises(QueryError) as found:
        e.query("SELECT ALLOWED G.Ref FROM Catalog.Goods AS G WHERE &Open = TRUE", {"Open": True})
    assert found.value.kind == "parameter" and "session" in found.value.message


@pytest.mark.parametrize("rule", ["RIGHT JOIN Catalog.Firms AS F ON F.Ref = Ref WHERE TRUE", "INNER JOIN (SELECT F.Ref FROM Catalog.Firms AS F) AS X ON TRUE WHERE TRUE", "INNER JOIN AccumulationRegister.Stock.Balance() AS B ON TRUE WHERE TRUE", "WHERE", "Ref = 1 Ref", "ТекущаяТаблица FROM Catalog.Firms AS F WHERE TRUE", "INNER JOIN Catalog.Firms AS F WHERE TRUE"])
def test_rules_that_are_refused(spark, rule):
    assert kind(spark, "SELECT G.Ref FROM Catalog.Goods AS G", restricted=True, restrictions={"Catalog.Goods": rule}) in ("restriction", "syntax")


def test_checked_balances(spark):
    text = "SELECT T.QtyBalance AS Q FROM AccumulationRegister.Stock.Balance() AS T"
    checked = lambda rule, t=text, p=None: rows(small(spark, restricted=True, restrictions={"AccumulationRegister.Stock": rule}).checked_balance(t, p))
    assert checked('Item = "y"') == [(3, False)]  # the balance of x is zero, so nothing is hidden
    assert checked('Item = "x"') == [(None, True)]
    assert checked(DENIED) == [(None, True)]
    assert checked(None) == [(3, False)]
    assert checked('Item = "y"', "SELECT T.Item AS I, T.QtyBalance AS Q FROM AccumulationRegister.Stock.Balance(, Item = &I) AS T", {"I": "x"}) == []
    for bad in ("SELECT ALLOWED T.QtyBalance FROM AccumulationRegister.Stock.Balance() AS T", "SELECT T.QtyBalance FROM AccumulationRegister.Stock.Balance(DATETIME(2024,1,1)) AS T", "SELECT T.QtyBalance FROM AccumulationRegister.Stock.Balance(, Qty > 1) AS T", "SELECT SUM(T.QtyBalance) FROM AccumulationRegister.Stock.Balance() AS T"):
        with pytest.raises(QueryError):
            checked('Item = "y"', bad)
    with pytest.raises(QueryError):
        checked("Qty > 1")


def test_a_cycle_ends_a_walk(spark):
    goods = spark.createDataFrame([("a", "A", "c"), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "c"), ("s", "S", "s")], "id string, name string, parent string")
    e = small(spark)
    e.tables = lambda name: goods
    assert rows(e.query('SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref IN HIERARCHY ("b")')) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(e.query('SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref IN HIERARCHY ("d", "s", "d")')) == [("d",), ("s",)]
    got = [tuple(r) for r in e.query("SELECT G.Ref AS R, 1 AS N FROM Catalog.Goods AS G TOTALS SUM(N) BY R HIERARCHY").collect()]
    assert {r for r in got if r[1] > 1} == {("a", 4), ("b", 4), ("c", 4)} and got.count(("d", 1)) == 2 and len(got) == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_equality_reaches_the_scan(spark, sf):
    e = engine(spark, sf)
    one = plan(e.query('SELECT C.Ref FROM Catalog.Customers AS C WHERE C.Segment = "BUILDING "'))
    assert "StringStartsWith(c_mktsegment,BUILDING)" in one
    several = plan(e.query("SELECT C.Ref FROM Catalog.Customers AS C WHERE C.Segment IN (&S)", {"S": ["BUILDING", "MACHINERY"]}))
    assert "Or(StringStartsWith(c_mktsegment,BUILDING),StringStartsWith(c_mktsegment,MACHINERY))" in several


def test_not_in_does_not_force_a_broadcast(spark, sf):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(engine(spark, sf).query("SELECT C.Ref FROM Catalog.Customers AS C WHERE C.Nation NOT IN (SELECT S.Nation FROM Catalog.Suppliers AS S)"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "LeftAnti" in found and "BroadcastHashJoin" not in found and "BroadcastNestedLoopJoin" not in found


def test_unknowns_in_not_in(spark):
    e = small(spark)
    assert rows(e.query("SELECT N.Ref FROM Document.Notes AS N WHERE N.Text NOT IN (SELECT G.Description FROM Catalog.Goods AS G)")) == [(1,), (2,), (3,)]
    assert rows(e.query("SELECT N.Ref FROM Document.Notes AS N WHERE N.Text NOT IN (SELECT G.Description FROM Catalog.Goods AS G WHERE FALSE)")) == [(1,), (2,), (3,), (4,)]
    assert rows(e.query("SELECT G.Ref FROM Catalog.Goods AS G WHERE G.Ref NOT IN (SELECT X.Parent FROM Catalog.Goods AS X)")) == []
    assert rows(e.query("SELECT G.Ref FROM Catalog.Goods AS G WHERE NOT G.Ref IN (SELECT X.Parent FROM Catalog.Goods AS X WHERE X.Parent IS NOT NULL)")) == [("c",), ("e",), ("z",)]


def test_totals_may_be_materialized(spark):
    seen = []
    e = small(spark, materialize=lambda df: seen.append(1) or df.cache())
    got = [tuple(r) for r in e.query("SELECT M.Item AS I, M.Qty AS Q FROM AccumulationRegister.Stock AS M ORDER BY I TOTALS SUM(Q) BY I").collect()]
    assert got[0] == ("x", 20) and got[4][0] == "y" and seen == [1]


def test_service_tables_by_either_name(spark):
    kinds = Object("ChartOfCalculationTypes", "Pay.Base", [Field("Ref", "id", "number"), Field("Type", "t", "string")], "base")
    model = Model([Object("ChartOfCalculationTypes", "Pay", [Field("Ref", "id", "number")], "pay", sections={"BaseCalculationKinds": kinds})])
    e = Engine(spark, model, lambda name: spark.createDataFrame([(1, "x")], "id int, t string"))
    for name in ("БазовыеВидыРасчета", "BaseCalculationTypes", "BaseCalculationKinds"):
        assert rows(e.query(f"SELECT B.Type FROM ChartOfCalculationTypes.Pay.{name} AS B")) == [("x",)]


def test_record_numbers_have_no_gaps(spark, sf):
    e = small(spark)
    # Four partitions, of which the first two and the last keep no row.
    sparse = spark.range(0, 40, 1, 4).where("id >= 20 AND id < 30")
    numbered = "SELECT T.id AS R, RECORDAUTONUMBER() AS N FROM &T AS T"
    assert rows(e.query(numbered, {"T": sparse})) == [(20 + i, 1 + i) for i in range(10)]
    assert rows(e.query(f"{numbered} WHERE T.id > 24", {"T": spark.range(0, 40, 1, 4).where("id < 30")})) == [(25 + i, 1 + i) for i in range(5)]
    assert rows(e.query("SELECT RECORDAUTONUMBER() AS N")) == [(1,)]
    every = lambda text, n, **params: sorted(r[0] for r in e.query(text, params).collect()) == list(range(1, n + 1))
    same = spark.range(0, 30, 1, 7).selectExpr("id % 3 AS k", "1 AS v")
    assert every("SELECT RECORDAUTONUMBER() AS N FROM &T AS T", 30, T=same)
    assert every("SELECT RECORDAUTONUMBER() AS N, COUNT(*) AS C FROM &T AS T GROUP BY T.k HAVING COUNT(*) > 1", 3, T=same)
    assert every("SELECT RECORDAUTONUMBER() AS N FROM &T AS T LEFT JOIN &T AS S ON T.k = S.k", 300, T=same)
    assert every("SELECT DISTINCT RECORDAUTONUMBER() AS N FROM (SELECT T.k AS K FROM &T AS T) AS T", 30, T=same)
    assert every("SELECT RECORDAUTONUMBER() AS N FROM &T AS T WHERE T.k > 5", 0, T=same)
    assert [tuple(r) for r in e.query(f"{numbered} ORDER BY N DESC", {"T": sparse}).collect()] == [(29 - i, 10 - i) for i in range(10)]
    assert rows(e.query("SELECT T.id AS R, RECORDAUTONUMBER() AS N INTO A FROM &T AS T; SELECT COUNT(*) AS C, SUM(X.N) AS S, MAX(Y.N) AS M FROM A AS X INNER JOIN A AS Y ON X.N = Y.N + 1", {"T": sparse})) == [(9, 54, 9)]
    # A row group in the middle of its splits: the first ones have no rows.
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        check(queries()["record_numbers"](spark, sf), oracle_sql()["record_numbers"], sf)
        found = plan(e.query("SELECT COUNT(*) AS C, MAX(T.N) AS M FROM (SELECT RECORDAUTONUMBER() AS N FROM &T AS T) AS T", {"T": same}))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert "Window" not in found and found.count("SinglePartition") == 1 and found.index("SinglePartition") < found.index("AttachDistributedSequence")


def test_record_numbers_of_other_rows_are_refused(spark):
    for text in (
        "SELECT G.Ref FROM Catalog.Goods AS G INNER JOIN Catalog.Firms AS F ON F.Ref = G.Ref AND RECORDAUTONUMBER() < 3",
        "SELECT CASE WHEN RECORDAUTONUMBER() NOT IN (SELECT M.Qty FROM AccumulationRegister.Stock AS M) THEN 1 END FROM Catalog.Goods AS G",
        "SELECT G.Ref FROM Catalog.Goods AS G WHERE (G.Ref, RECORDAUTONUMBER()) IN (SELECT M.Item, M.Qty FROM AccumulationRegister.Stock AS M)",
        "SELECT PRESENTATION(CASE WHEN RECORDAUTONUMBER() = 1 THEN G.Parent END) FROM Catalog.Goods AS G",
    ):
        assert kind(spark, text) == "unsupported"
    rule = {"Catalog.Goods": "ТекущаяТаблица AS T INNER JOIN Catalog.Firms AS F ON F.Ref = T.Ref WHERE RECORDAUTONUMBER() < 2"}
    assert kind(spark, "SELECT G.Ref FROM Catalog.Goods AS G", restricted=True, restrictions=rule | {"Catalog.Firms": None}) == "unsupported"
    assert rows(small(spark).query("SELECT PRESENTATION(RECORDAUTONUMBER()) FROM Catalog.Firms AS F")) == [("1",), ("2",)]
