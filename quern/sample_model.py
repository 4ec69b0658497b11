"""A logical model over the star-schema tables: catalogs, an order document, registers, accounts and a geography tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.model import Field, Model, Object

MONEY = "decimal(18,2)"
RECEIPT = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def _geo(tables) -> DataFrame:
    """Regions, nations and customers as one tree."""
    r = tables("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = tables("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = tables("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return r.unionAll(n).unionAll(c)


def _sales(tables) -> DataFrame:
    return tables("lineitem").join(tables("orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def _ref(name: str, sql: str, target: str, aliases: tuple = (), **more) -> Field:
    return Field(name, sql, "ref", aliases, (target,), **more)


def model() -> Model:
    lines = Object("Document", "Orders.Lines", [_ref("Ref", "l_orderkey", "Document.Orders"), Field("LineNumber", "l_linenumber", "number"), _ref("Part", "l_partkey", "Catalog.Parts", ("Номенклатура",)), _ref("Supplier", "l_suppkey", "Catalog.Suppliers", ("Поставщик",)), Field("Quantity", f"CAST(l_quantity AS {MONEY})", "number", ("Количество",)), Field("Amount", f"CAST(l_extendedprice AS {MONEY})", "number", ("Сумма",))], "lineitem", ("Товары",))
    moves = [Field("Period", "CAST(l_shipdate AS timestamp_ntz)", "date"), _ref("Recorder", "l_orderkey", "Document.Orders"), Field("LineNumber", "l_linenumber", "number"), Field("Active", "true", "boolean")]
    part = _ref("Part", "l_partkey", "Catalog.Parts", ("Номенклатура",), purpose="dimension")
    supplier = _ref("Supplier", "l_suppkey", "Catalog.Suppliers", ("Поставщик",), purpose="dimension")
    quantity = Field("Quantity", f"CAST(l_quantity AS {MONEY})", "number", ("Количество",), purpose="resource")
    amount = Field("Amount", f"CAST(l_extendedprice AS {MONEY})", "number", ("Сумма",), purpose="resource")
    return Model([
        Object("Catalog", "Regions", [_ref("Ref", "r_regionkey", "Catalog.Regions"), Field("Description", "r_name", "string")], "region", ("Регионы",), 1, predefined={"Europe": 3, "Asia": 2}),
        Object("Catalog", "Nations", [_ref("Ref", "n_nationkey", "Catalog.Nations"), Field("Description", "n_name", "string"), _ref("Region", "n_regionkey", "Catalog.Regions", ("Регион",))], "nation", ("Страны",), 2),
        Object("Catalog", "Customers", [_ref("Ref", "c_custkey", "Catalog.Customers"), Field("Description", "c_name", "string"), _ref("Nation", "c_nationkey", "Catalog.Nations", ("Страна",)), Field("Balance", f"CAST(c_acctbal AS {MONEY})", "number", ("Остаток",)), Field("Segment", "c_mktsegment", "string", ("Сегмент",))], "customer", ("Клиенты",), 3, presentation=("Description", "' / '", "Segment")),
        Object("Catalog", "Suppliers", [_ref("Ref", "s_suppkey", "Catalog.Suppliers"), Field("Description", "s_name", "string"), _ref("Nation", "s_nationkey", "Catalog.Nations", ("Страна",))], "supplier", ("Поставщики",), 4),
        Object("Catalog", "Parts", [_ref("Ref", "p_partkey", "Catalog.Parts"), Field("Description", "p_name", "string"), Field("Brand", "p_brand", "string", ("Марка",)), Field("Size", "p_size", "number", ("Размер",)), Field("Price", f"CAST(p_retailprice AS {MONEY})", "number", ("Цена",))], "part", ("Номенклатура",), 5),
        Object("Document", "Orders", [_ref("Ref", "o_orderkey", "Document.Orders"), Field("Date", "CAST(o_orderdate AS timestamp_ntz)", "date"), _ref("Customer", "o_custkey", "Catalog.Customers", ("Клиент",)), Field("Status", "o_orderstatus", "string", ("Статус",)), Field("Total", f"CAST(o_totalprice AS {MONEY})", "number", ("Итог",)), Field("Priority", "o_orderpriority", "string", ("Приоритет",)), Field("PointInTime", "named_struct('date', CAST(o_orderdate AS timestamp_ntz), 'ref', o_orderkey)", "point")], "orders", ("Заказы",), 10, sections={"Lines": lines}, presentation=("'Order '", "Ref")),
        Object("Catalog", "Geo", [_ref("Ref", "id", "Catalog.Geo"), Field("Description", "name", "string"), _ref("Parent", "parent", "Catalog.Geo")], _geo, ("География",), 6),
        Object("Catalog", "TenantCustomers", [_ref("Ref", "c_custkey", "Catalog.TenantCustomers"), Field("Description", "c_name", "string"), Field("Tenant", "c_nationkey", "number")], "customer", (), 7, separators={"Tenant": "Tenant"}),
        Object("AccumulationRegister", "Stock", [*moves, Field("RecordType", RECEIPT, "number"), part, supplier, quantity, amount], "lineitem", ("Запасы",)),
        Object("AccumulationRegister", "Sales", [Field("Period", "CAST(l_shipdate AS timestamp_ntz)", "date"), _ref("Recorder", "l_orderkey", "Document.Orders"), Field("LineNumber", "l_linenumber", "number"), _ref("Customer", "o_custkey", "Catalog.Customers", ("Клиент",), purpose="dimension"), part, quantity, amount], _sales, ("Продажи",), register="turnovers"),
        Object("InformationRegister", "EventState", [Field("Period", "CAST(ts AS timestamp_ntz)", "date"), Field("User", "user_id", "number", ("Пользователь",), purpose="dimension"), Field("Type", "event_type", "string", ("Вид",), purpose="dimension"), Field("Value", f"CAST(value AS {MONEY})", "number", purpose="resource"), Field("Event", "event_id", "number", ("Событие",))], "events", ("СостояниеСобытий",)),
        Object("AccountingRegister", "Ledger", [*moves, Field("AccountDr", "CAST(l_suppkey % 5 AS bigint)", "number"), Field("AccountCr", "CAST(l_partkey % 7 AS bigint)", "number"), Field("ExtDimension1Dr", "l_suppkey", "number", ("СубконтоДт1",)), Field("ExtDimension1Cr", "l_partkey", "number", ("СубконтоКт1",)), Field("Flag", "l_returnflag", "string", ("Признак",), purpose="dimension"), Field("Amount", f"CAST(l_extendedprice AS {MONEY})", "number", ("Сумма",), purpose="resource")], "lineitem", ("Хозрасчетный",), ext_dimensions=1),
        Object("DocumentJournal", "AllOrders", [Field("Ref", "named_struct('type', 10, 'ref', CAST(o_orderkey AS string))", "ref", (), ("Document.Orders", "Document.Returns")), Field("Date", "CAST(o_orderdate AS timestamp_ntz)", "date"), Field("Type", "'Orders'", "string", ("Тип",))], "orders", ("ВсеЗаказы",)),
        Object("Document", "Returns", [_ref("Ref", "o_orderkey", "Document.Returns"), Field("Date", "CAST(o_orderdate AS timestamp_ntz)", "date"), Field("Reason", "CAST(NULL AS string)", "string")], lambda t: t("orders").where("false"), ("Возвраты",), 11),
        Object("Constant", "MainRegion", [_ref("Value", "CASE WHEN r_name = 'EUROPE' OR r_regionkey = 3 THEN r_regionkey END", "Catalog.Regions")], "region", ("ОсновнойРегион",)),
        Object("Constant", "Rate", [Field("Value", "CAST(NULL AS decimal(18,2))", "number")], "region", ("Курс",)),
        Object("FilterCriterion", "ByNation", [], "", ("ПоСтране",), content=(("Catalog.Customers", "Nation"), ("Catalog.Suppliers", "Nation"))),
    ])


def engine(spark: SparkSession, sf_dir: str, **how) -> Engine:
    return Engine(spark, model(), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), **how)
