"""Registered queries of the language over the sample model, each with its DuckDB SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.access import Role, decisions, granted
from quern.engine import DENIED, Engine, ValueTable
from quern.model import Field, Model, Object
from quern.plans.virtual import Boundary, PointInTime
from quern.sample_model import engine
from quern.sources.catalog import Catalog

D = datetime.datetime
_Q = "CAST(l_quantity AS DECIMAL(18,2))"
_A = "CAST(l_extendedprice AS DECIMAL(18,2))"
_SGN = "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END"
_T = "CAST(o_totalprice AS DECIMAL(18,2))"
_GEO = "geo AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"

#: name -> (query text, parameters, session options, DuckDB SQL)
QUERIES: dict[str, tuple[str, dict, dict, str]] = {}


def _add(name: str, text: str, sql: str, params: dict | None = None, **how) -> None:
    QUERIES[name] = (text, params or {}, how, sql)


# -- selection, grouping, ordering -------------------------------------------------------------
_add("select_top_orders", "SELECT TOP 20 D.Customer AS Customer, SUM(D.Total) AS Total, COUNT(*) AS Orders FROM Document.Orders AS D WHERE D.Date >= DATETIME(1996,1,1) GROUP BY D.Customer ORDER BY Total DESC, Customer",
     f"SELECT o_custkey AS Customer, sum({_T}) AS Total, count(*) AS Orders FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_add("select_russian", "ВЫБРАТЬ Д.Статус КАК Status, КОЛИЧЕСТВО(РАЗЛИЧНЫЕ Д.Клиент) КАК Customers, МАКСИМУМ(Д.Итог) КАК Top ИЗ Документ.Заказы КАК Д ГДЕ Д.Итог МЕЖДУ 1000 И 200000 СГРУППИРОВАТЬ ПО Д.Статус ИМЕЮЩИЕ КОЛИЧЕСТВО(*) > 10",
     f"SELECT o_orderstatus AS Status, count(DISTINCT o_custkey) AS Customers, max({_T}) AS Top FROM orders WHERE {_T} BETWEEN 1000 AND 200000 GROUP BY 1 HAVING count(*) > 10")
_add("select_distinct", "SELECT DISTINCT D.Status AS Status, D.Priority AS Priority FROM Document.Orders AS D ORDER BY D.Status", "SELECT DISTINCT o_orderstatus AS Status, o_orderpriority AS Priority FROM orders")
_add("select_star", "SELECT * FROM Catalog.Nations", "SELECT n_nationkey AS \"Ref\", n_name AS \"Description\", n_regionkey AS \"Region\" FROM nation")
_add("select_without_source", "SELECT 1 AS A, \"x\" AS B, TRUE AS C", "SELECT 1 AS A, 'x' AS B, TRUE AS C")
_add("predicates", "SELECT C.Ref AS Ref FROM Catalog.Customers AS C WHERE C.Segment IN (\"BUILDING\", \"MACHINERY\") AND NOT C.Balance < 0 AND C.Description LIKE \"%[1-3]_\" AND C.Nation IS NOT NULL",
     f"SELECT c_custkey AS Ref FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT CAST(c_acctbal AS DECIMAL(18,2)) < 0 AND regexp_matches(c_name, '[1-3].$') AND c_nationkey IS NOT NULL")
_add("case_and_isnull", "SELECT D.Ref AS Ref, CASE D.Status WHEN \"F\" THEN 1 WHEN \"O\" THEN 2 ELSE 0 END AS N, CASE WHEN D.Total > 100000 THEN \"big\" END AS Size, ISNULL(CASE WHEN D.Total > 100000 THEN D.Customer END, VALUE(Catalog.Customers.EmptyRef)) AS C FROM Document.Orders AS D",
     f"SELECT o_orderkey AS Ref, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS N, CASE WHEN {_T} > 100000 THEN 'big' END AS Size, CASE WHEN {_T} > 100000 THEN o_custkey END AS C FROM orders")
_add("parameters", "SELECT COUNT(*) AS N FROM Document.Orders AS D WHERE D.Date >= &From AND D.Status IN (&Statuses) AND D.Customer <> &Nobody", "SELECT count(*) AS N FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderstatus IN ('F', 'P') AND o_custkey <> -1", {"From": D(1997, 3, 1), "Statuses": ["F", "P"], "Nobody": -1})
# -- functions ---------------------------------------------------------------------------------
_add("string_functions", "SELECT C.Ref AS Ref, SUBSTRING(C.Description, 3, 4) AS A, SUBSTRING(C.Description, -1, 4) AS A2, STRINGLENGTH(C.Description) AS L, UPPER(C.Segment) AS U, LOWER(C.Segment) AS W, LEFT(C.Segment, 2) AS F, RIGHT(C.Segment, 3) AS G, STRFIND(C.Description, \"#\") AS P, STRREPLACE(C.Description, \"0\", \"-\") AS R, TRIMALL(\"  x \") + \"|\" AS T FROM Catalog.Customers AS C",
     "SELECT c_custkey AS Ref, substr(c_name, 3, 4) AS A, substr(c_name, 1, 2) AS A2, length(c_name) AS L, upper(c_mktsegment) AS U, lower(c_mktsegment) AS W, left(c_mktsegment, 2) AS F, right(c_mktsegment, 3) AS G, instr(c_name, '#') AS P, replace(c_name, '0', '-') AS R, 'x|' AS T FROM customer")
_B = "CAST(c_acctbal AS DECIMAL(18,2))"
_add("number_functions", "SELECT C.Ref AS Ref, ROUND(C.Balance, 1) AS R, INT(C.Balance) AS I, ROUND(SQRT(C.Balance + 1000), 6) AS Q, ROUND(EXP(C.Balance / 10000), 6) AS E, ROUND(LOG(C.Balance + 1001), 6) AS L, ROUND(LOG10(C.Balance + 1001), 6) AS G, ROUND(POW(C.Balance / 1000, 3), 4) AS P, ROUND(COS(C.Balance / 1000), 6) AS CO, ROUND(SIN(C.Balance / 1000), 6) AS SI, ROUND(TAN(C.Balance / 10000), 6) AS T, ROUND(ACOS(C.Balance / 10000), 6) AS AC, ROUND(ASIN(C.Balance / 10000), 6) AS AI, ROUND(ATAN(C.Balance / 1000), 6) AS A FROM Catalog.Customers AS C",
     f"SELECT c_custkey AS Ref, CAST(round({_B}, 1) AS DECIMAL(18,1)) AS R, CAST(trunc({_B}) AS BIGINT) AS I, round(sqrt(b + 1000), 6) AS Q, round(exp(b / 10000), 6) AS E, round(ln(b + 1001), 6) AS L, round(log10(b + 1001), 6) AS G, round(pow(b / 1000, 3), 4) AS P, round(cos(b / 1000), 6) AS CO, round(sin(b / 1000), 6) AS SI, round(tan(b / 10000), 6) AS T, round(acos(b / 10000), 6) AS AC, round(asin(b / 10000), 6) AS AI, round(atan(b / 1000), 6) AS A FROM (SELECT *, CAST({_B} AS DOUBLE) AS b FROM customer)")
_add("date_functions", "SELECT D.Ref AS Ref, BEGINOFPERIOD(D.Date, MONTH) AS M, BEGINOFPERIOD(D.Date, TENDAYS) AS T, BEGINOFPERIOD(D.Date, HALFYEAR) AS H, BEGINOFPERIOD(D.Date, WEEK) AS W, ENDOFPERIOD(D.Date, QUARTER) AS Q, DATEADD(D.Date, MONTH, 1) AS A, DATEADD(D.Date, TENDAYS, 2) AS B, YEAR(D.Date) AS Y, QUARTER(D.Date) AS QN, DAYOFYEAR(D.Date) AS DY, WEEKDAY(D.Date) AS WD, WEEK(D.Date) AS WN, DATEDIFF(D.Date, DATETIME(2000,1,1), MONTH) AS DM, DATEDIFF(D.Date, DATETIME(2000,1,1), DAY) AS DD FROM Document.Orders AS D",
     """SELECT o_orderkey AS Ref, date_trunc('month', d) AS M, date_trunc('month', d) + to_days(CAST(10 * least((day(d) - 1) // 10, 2) AS INTEGER)) AS T, date_trunc('year', d) + CASE WHEN month(d) > 6 THEN INTERVAL 6 MONTH ELSE INTERVAL 0 MONTH END AS H, CAST(date_trunc('week', d) AS TIMESTAMP) AS W,
     date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 SECOND AS Q, d + INTERVAL 1 MONTH AS A, d + INTERVAL 20 DAY AS B, year(d) AS Y, quarter(d) AS QN, dayofyear(d) AS DY, isodow(d) AS WD, (dayofyear(d) + isodow(date_trunc('year', d)) - 2) // 7 + 1 AS WN, (2000 - year(d)) * 12 + 1 - month(d) AS DM, date_diff('day', d, TIMESTAMP '2000-01-01') AS DD FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders)""")
_add("casts", "SELECT C.Ref AS Ref, CAST(C.Balance AS NUMBER(12,1)) AS N, CAST(C.Description AS STRING(8)) AS S, CAST(C.Nation AS Catalog.Nations).Region AS R, C.Nation REFS Catalog.Nations AS T FROM Catalog.Customers AS C",
     "SELECT c_custkey AS Ref, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(12,1)) AS N, substr(c_name, 1, 8) AS S, n_regionkey AS R, TRUE AS T FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
_add("value_types", "SELECT VALUETYPE(C.Nation) = TYPE(Catalog.Nations) AS A, VALUETYPE(C.Balance) = TYPE(NUMBER) AS B, COUNT(*) AS N FROM Catalog.Customers AS C GROUP BY VALUETYPE(C.Nation) = TYPE(Catalog.Nations), VALUETYPE(C.Balance) = TYPE(NUMBER)", "SELECT TRUE AS A, TRUE AS B, count(*) AS N FROM customer")
_add("composite_case", "SELECT C.Ref AS Ref, CASE WHEN C.Segment = \"BUILDING\" THEN C.Nation WHEN C.Segment = \"MACHINERY\" THEN C.Description ELSE TRUE END AS V FROM Catalog.Customers AS C",
     "SELECT c_custkey AS Ref, CASE WHEN c_mktsegment = 'BUILDING' THEN 8 WHEN c_mktsegment = 'MACHINERY' THEN 5 ELSE 2 END::TINYINT AS V_TYPE, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END AS V_S, CAST(NULL AS DECIMAL(38,10)) AS V_N, CAST(NULL AS TIMESTAMP) AS V_T, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN TRUE END AS V_L, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 END AS V_RTRef, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END AS V_RRRef FROM customer")
_add("presentations", "SELECT D.Ref AS Ref, PRESENTATION(D.Customer) AS P, D.Ref.Presentation AS O FROM Document.Orders AS D", "SELECT o_orderkey AS Ref, c_name || ' / ' || c_mktsegment AS P, 'Order ' || o_orderkey AS O FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
# -- joins, dereference, subqueries ------------------------------------------------------------
_add("dereference_deep", "SELECT D.Customer.Nation.Region.Description AS Region, SUM(D.Total) AS Total FROM Document.Orders AS D GROUP BY D.Customer.Nation.Region.Description",
     f"SELECT r_name AS Region, sum({_T}) AS Total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("joins", "SELECT N.Description AS Nation, COUNT(C.Ref) AS Customers, COUNT(S.Ref) AS Suppliers FROM Catalog.Nations AS N LEFT JOIN Catalog.Customers AS C ON C.Nation = N.Ref AND C.Balance > 5000 FULL JOIN Catalog.Suppliers AS S ON S.Nation = N.Ref GROUP BY N.Description",
     "SELECT n_name AS Nation, count(c_custkey) AS Customers, count(s_suppkey) AS Suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND CAST(c_acctbal AS DECIMAL(18,2)) > 5000 FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
_add("comma_sources", "SELECT A.Description AS A, B.Description AS B FROM Catalog.Regions AS A, Catalog.Nations AS B RIGHT JOIN Catalog.Regions AS C ON B.Region = C.Ref WHERE A.Ref < 2", "SELECT a.r_name AS A, b.n_name AS B FROM region a CROSS JOIN (SELECT n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey) b WHERE a.r_regionkey < 2")
_add("derived_table", "SELECT T.S AS S, COUNT(*) AS N FROM (SELECT D.Status AS S, D.Customer AS C, SUM(D.Total) AS X FROM Document.Orders AS D GROUP BY D.Status, D.Customer) AS T WHERE T.X > 300000 GROUP BY T.S",
     f"SELECT s AS S, count(*) AS N FROM (SELECT o_orderstatus AS s, o_custkey, sum({_T}) AS x FROM orders GROUP BY 1, 2) WHERE x > 300000 GROUP BY 1")
_add("in_query_correlated", "SELECT C.Ref AS Ref FROM Catalog.Customers AS C WHERE C.Ref IN (SELECT D.Customer FROM Document.Orders AS D WHERE D.Total > C.Balance * 40 AND D.Customer = C.Ref)",
     f"SELECT c_custkey AS Ref FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_T} > CAST(c_acctbal AS DECIMAL(18,2)) * 40 AND o_custkey = c_custkey)")
_add("tuple_not_in", "SELECT C.Ref AS Ref FROM Catalog.Customers AS C WHERE NOT (C.Nation, C.Segment) IN (SELECT B.Nation, B.Segment FROM Catalog.Customers AS B WHERE B.Balance > 7000)", "SELECT c_custkey AS Ref FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_nationkey = c.c_nationkey AND b.c_mktsegment = c.c_mktsegment AND CAST(b.c_acctbal AS DECIMAL(18,2)) > 7000)")
_add("union_mixed", "SELECT C.Nation AS N FROM Catalog.Customers AS C UNION SELECT S.Nation FROM Catalog.Suppliers AS S UNION ALL SELECT R.Ref FROM Catalog.Nations AS R", "SELECT c_nationkey AS N FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
_add("union_composite", "SELECT R.Description AS V FROM Catalog.Regions AS R UNION ALL SELECT N.Ref FROM Catalog.Nations AS N",
     "SELECT 5::TINYINT AS V_TYPE, r_name AS V_S, CAST(NULL AS DECIMAL(38,10)) AS V_N, CAST(NULL AS TIMESTAMP) AS V_T, CAST(NULL AS BOOLEAN) AS V_L, CAST(NULL AS INTEGER) AS V_RTRef, CAST(NULL AS VARCHAR) AS V_RRRef FROM region UNION ALL SELECT 8, NULL, NULL, NULL, NULL, 2, CAST(n_nationkey AS VARCHAR) FROM nation")
_add("tabular_section", "SELECT L.Ref.Status AS Status, SUM(L.Quantity) AS Q, COUNT(DISTINCT L.Part) AS Parts FROM Document.Orders.Lines AS L GROUP BY L.Ref.Status", f"SELECT o_orderstatus AS Status, sum({_Q}) AS Q, count(DISTINCT l_partkey) AS Parts FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
_add("in_hierarchy", "SELECT G.Ref AS Ref FROM Catalog.Geo AS G WHERE G.Ref IN HIERARCHY (&Top, \"n3\")", f"WITH RECURSIVE {_GEO}, h AS (SELECT id FROM geo WHERE id IN ('r1', 'n3') UNION SELECT g.id FROM geo g JOIN h ON g.parent = h.id) SELECT id AS Ref FROM h", {"Top": "r1"})
_add("not_in_hierarchy", "SELECT G.Ref AS Ref FROM Catalog.Geo AS G WHERE G.Ref NOT IN HIERARCHY (\"r0\", \"r1\", \"r2\")", f"WITH RECURSIVE {_GEO}, h AS (SELECT id FROM geo WHERE id IN ('r0', 'r1', 'r2') UNION SELECT g.id FROM geo g JOIN h ON g.parent = h.id) SELECT id AS Ref FROM geo WHERE id NOT IN (SELECT id FROM h)")
# -- registers ---------------------------------------------------------------------------------
_add("slice_last", "SELECT T.User AS U, T.Type AS T, T.Value AS V, T.Period AS P FROM InformationRegister.EventState.SliceLast(DATETIME(2024,1,15), Type <> \"error\") AS T",
     "SELECT user_id AS U, event_type AS T, CAST(value AS DECIMAL(18,2)) AS V, ts AS P FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND event_type <> 'error') WHERE k = 1")
_add("slice_first", "ВЫБРАТЬ Т.Пользователь КАК U, Т.Вид КАК K, Т.Событие КАК E ИЗ РегистрСведений.СостояниеСобытий.СрезПервых(ДАТАВРЕМЯ(2024,1,10)) КАК Т", "SELECT user_id AS U, event_type AS K, event_id AS E FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE k = 1")
_add("balance_at", "SELECT T.Part AS Part, T.Supplier AS Supplier, T.QuantityBalance AS Q, T.AmountBalance AS A FROM AccumulationRegister.Stock.Balance(DATETIME(1998,1,1), Part.Size > 20) AS T",
     f"SELECT * FROM (SELECT l_partkey AS Part, l_suppkey AS Supplier, sum({_SGN} * {_Q}) AS Q, sum({_SGN} * {_A}) AS A FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1998-01-01' AND p_size > 20 GROUP BY 1, 2) WHERE Q <> 0 OR A <> 0")
_add("balance_pruned", "SELECT T.Supplier AS Supplier, T.QuantityBalance AS Q FROM AccumulationRegister.Stock.Balance() AS T", f"SELECT Supplier, sum(q) AS Q FROM (SELECT l_partkey, l_suppkey AS Supplier, sum({_SGN} * {_Q}) AS q, sum({_SGN} * {_A}) AS a FROM lineitem GROUP BY 1, 2) WHERE q <> 0 OR a <> 0 GROUP BY 1")
_add("turnovers_month", "SELECT T.Period AS P, T.Supplier AS Supplier, T.QuantityReceipt AS R, T.QuantityExpense AS E, T.QuantityTurnover AS T FROM AccumulationRegister.Stock.Turnovers(DATETIME(1996,1,1), DATETIME(1997,1,1), MONTH) AS T",
     f"SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS P, l_suppkey AS Supplier, sum(CASE WHEN l_returnflag <> 'R' THEN {_Q} ELSE 0 END) AS R, sum(CASE WHEN l_returnflag = 'R' THEN {_Q} ELSE 0 END) AS E, sum({_SGN} * {_Q}) AS T FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2")
_add("turnovers_auto", "SELECT T.PeriodYear AS Y, T.PeriodQuarter AS Q, T.AmountTurnover AS A FROM AccumulationRegister.Sales.Turnovers(, , AUTO) AS T", f"SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS Y, date_trunc('quarter', l_shipdate)::TIMESTAMP AS Q, sum({_A}) AS A FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
_add("turnovers_recorder", "SELECT T.Recorder AS R, T.Period AS P, T.QuantityTurnover AS Q FROM AccumulationRegister.Sales.Turnovers(DATETIME(1997,1,1), DATETIME(1997,4,1), RECORDER) AS T", f"SELECT l_orderkey AS R, l_shipdate AS P, sum({_Q}) AS Q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1, 2")
_add("balance_and_turnovers", "SELECT T.Supplier AS Supplier, T.QuantityOpeningBalance AS O, T.QuantityReceipt AS R, T.QuantityExpense AS E, T.QuantityClosingBalance AS C FROM AccumulationRegister.Stock.BalanceAndTurnovers(DATETIME(1996,1,1), DATETIME(1997,1,1)) AS T",
     f"SELECT l_suppkey AS Supplier, sum(CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN {_SGN} * {_Q} ELSE 0 END) AS O, sum(CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag <> 'R' THEN {_Q} ELSE 0 END) AS R, sum(CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag = 'R' THEN {_Q} ELSE 0 END) AS E, sum({_SGN} * {_Q}) AS C FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1")
_add("balance_and_turnovers_day", "SELECT T.Part AS Part, T.Supplier AS Supplier, T.Period AS P, T.QuantityOpeningBalance AS O, T.QuantityTurnover AS T, T.QuantityClosingBalance AS C FROM AccumulationRegister.Stock.BalanceAndTurnovers(DATETIME(1997,1,1), DATETIME(1998,1,1), DAY) AS T",
     f"""WITH b AS (SELECT l_partkey, l_suppkey, l_shipdate >= TIMESTAMP '1997-01-01' AS i, CASE WHEN l_shipdate >= TIMESTAMP '1997-01-01' THEN date_trunc('day', l_shipdate)::TIMESTAMP END AS p, sum({_SGN} * {_Q}) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2, 3, 4),
     w AS (SELECT *, sum(s) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY i, p NULLS FIRST ROWS UNBOUNDED PRECEDING) AS c FROM b) SELECT l_partkey AS Part, l_suppkey AS Supplier, p AS P, c - s AS O, s AS T, c AS C FROM w WHERE i""")
_add("accounting_balance", "SELECT T.Account AS Account, T.AmountBalance AS B, T.AmountBalanceDr AS D, T.AmountBalanceCr AS C, T.AmountSplittedBalanceDr AS SD FROM AccountingRegister.Ledger.Balance(DATETIME(1999,1,1)) AS T",
     f"""WITH e AS (SELECT l_suppkey % 5 AS acc, l_suppkey AS x, l_returnflag AS f, {_A} AS a FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' UNION ALL SELECT l_partkey % 7, l_partkey, l_returnflag, -{_A} FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
     g AS (SELECT acc, x, f, sum(a) AS s FROM e GROUP BY ALL HAVING sum(a) <> 0) SELECT acc AS Account, sum(s) AS B, greatest(sum(s), 0) AS D, greatest(-sum(s), 0) AS C, sum(greatest(s, 0)) AS SD FROM g GROUP BY 1""")
_add("accounting_turnovers", "SELECT T.Account AS Account, T.BalancedAccount AS Cor, T.Period AS P, T.AmountTurnoverDr AS D, T.AmountTurnoverCr AS C FROM AccountingRegister.Ledger.Turnovers(, , YEAR, Account < 3) AS T",
     f"SELECT acc AS Account, cor AS Cor, p AS P, sum(d) AS D, sum(c) AS C FROM (SELECT l_suppkey % 5 AS acc, l_partkey % 7 AS cor, date_trunc('year', l_shipdate)::TIMESTAMP AS p, {_A} AS d, 0 AS c FROM lineitem UNION ALL SELECT l_partkey % 7, l_suppkey % 5, date_trunc('year', l_shipdate)::TIMESTAMP, 0, {_A} FROM lineitem) WHERE acc < 3 GROUP BY 1, 2, 3")
_add("accounting_balance_and_turnovers", "SELECT T.Account AS Account, T.Flag AS F, T.AmountOpeningBalance AS O, T.AmountTurnoverDr AS D, T.AmountTurnoverCr AS C, T.AmountClosingBalance AS E FROM AccountingRegister.Ledger.BalanceAndTurnovers(DATETIME(1996,1,1), DATETIME(1998,1,1)) AS T",
     f"""WITH e AS (SELECT l_suppkey % 5 AS acc, l_returnflag AS f, l_shipdate AS p, {_A} AS d, 0 AS c FROM lineitem UNION ALL SELECT l_partkey % 7, l_returnflag, l_shipdate, 0, {_A} FROM lineitem)
     SELECT acc AS Account, f AS F, sum(CASE WHEN p < TIMESTAMP '1996-01-01' THEN d - c ELSE 0 END) AS O, sum(CASE WHEN p >= TIMESTAMP '1996-01-01' THEN d ELSE 0 END) AS D, sum(CASE WHEN p >= TIMESTAMP '1996-01-01' THEN c ELSE 0 END) AS C, sum(d - c) AS E FROM e WHERE p < TIMESTAMP '1998-01-01' GROUP BY 1, 2""")
_add("drcr_turnovers", "SELECT T.AccountDr AS D, T.AccountCr AS C, T.AmountTurnover AS A FROM AccountingRegister.Ledger.DrCrTurnovers(DATETIME(1996,1,1), , , Account > 0) AS T", f"SELECT l_suppkey % 5 AS D, l_partkey % 7 AS C, sum({_A}) AS A FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_suppkey % 5 > 0 GROUP BY 1, 2")
_add("records_with_ext_dimensions", "SELECT T.Recorder AS R, T.LineNumber AS L, T.ExtDimension1Dr AS X, T.Amount AS A FROM AccountingRegister.Ledger.RecordsWithExtDimensions(DATETIME(1996,1,1), DATETIME(1996,3,1), AccountDr = 2) AS T", f"SELECT l_orderkey AS R, l_linenumber AS L, l_suppkey AS X, {_A} AS A FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-03-01' AND l_suppkey % 5 = 2")
_add("section_in_condition", "SELECT D.Ref AS Ref FROM Document.Orders AS D WHERE D.Lines.Quantity > 49 AND NOT D.Lines.Part.Size < 3", f"SELECT o_orderkey AS Ref FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_Q} > 49) AND NOT EXISTS (SELECT 1 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size < 3)")
_add("document_journal", "SELECT YEAR(J.Date) AS Y, COUNT(J.Ref.Date) AS N FROM DocumentJournal.AllOrders AS J WHERE J.Ref REFS Document.Orders GROUP BY YEAR(J.Date)", "SELECT year(o_orderdate) AS Y, count(*) AS N FROM orders GROUP BY 1")
_add("accounting_running_balances", "SELECT T.Account AS Account, T.Period AS P, T.AmountOpeningBalance AS O, T.AmountTurnoverDr AS D, T.AmountClosingBalance AS C FROM AccountingRegister.Ledger.BalanceAndTurnovers(DATETIME(1996,1,1), DATETIME(1997,1,1), QUARTER) AS T",
     f"""WITH e AS (SELECT l_suppkey % 5 AS acc, l_suppkey AS x, l_returnflag AS f, l_shipdate AS p, {_A} AS a, {_A} AS d FROM lineitem UNION ALL SELECT l_partkey % 7, l_partkey, l_returnflag, l_shipdate, -{_A}, 0 FROM lineitem),
     b AS (SELECT acc, x, f, p >= TIMESTAMP '1996-01-01' AS i, CASE WHEN p >= TIMESTAMP '1996-01-01' THEN date_trunc('quarter', p)::TIMESTAMP END AS k, sum(a) AS s, sum(d) AS d FROM e WHERE p < TIMESTAMP '1997-01-01' GROUP BY ALL),
     w AS (SELECT *, sum(s) OVER (PARTITION BY acc, x, f ORDER BY i, k NULLS FIRST ROWS UNBOUNDED PRECEDING) AS c FROM b) SELECT acc AS Account, k AS P, sum(c - s) AS O, sum(d) AS D, sum(c) AS C FROM w WHERE i GROUP BY 1, 2""")
_add("balance_and_turnovers_auto", "SELECT T.Supplier AS S, T.PeriodMonth AS M, T.QuantityReceipt AS R, T.QuantityExpense AS E FROM AccumulationRegister.Stock.BalanceAndTurnovers(DATETIME(1997,1,1), DATETIME(1997,7,1), AUTO) AS T",
     f"SELECT l_suppkey AS S, date_trunc('month', l_shipdate)::TIMESTAMP AS M, sum(CASE WHEN l_returnflag <> 'R' THEN {_Q} ELSE 0 END) AS R, sum(CASE WHEN l_returnflag = 'R' THEN {_Q} ELSE 0 END) AS E FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' GROUP BY 1, 2")
_add("turnovers_record", "SELECT T.Recorder AS R, T.LineNumber AS L, T.Period AS P, T.AmountTurnover AS A FROM AccumulationRegister.Sales.Turnovers(DATETIME(1997,1,1), DATETIME(1997,2,1), RECORD) AS T", f"SELECT l_orderkey AS R, l_linenumber AS L, l_shipdate AS P, sum({_A}) AS A FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01' GROUP BY 1, 2, 3")
_add("turnovers_tendays", "SELECT T.Period AS P, T.AmountTurnover AS A FROM AccumulationRegister.Sales.Turnovers(, , TENDAYS) AS T", f"SELECT date_trunc('month', l_shipdate)::TIMESTAMP + to_days(CAST(10 * least((day(l_shipdate) - 1) // 10, 2) AS INTEGER)) AS P, sum({_A}) AS A FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
_add("point_in_time", "SELECT D.Ref AS Ref FROM Document.Orders AS D WHERE D.PointInTime <= &Moment", "SELECT o_orderkey AS Ref FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' OR o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey <= 5000", {"Moment": PointInTime(D(1996, 6, 1), 5000)})
_add("value_table", "SELECT V.flag AS F, COUNT(*) AS N FROM &Flags AS V INNER JOIN Document.Orders AS D ON D.Status = V.status GROUP BY V.flag", "SELECT f AS F, count(*) AS N FROM (VALUES ('F', 1), ('O', 2), ('X', 3)) v(s, f) JOIN orders ON o_orderstatus = s GROUP BY 1", {"Flags": ValueTable([("F", 1), ("O", 2), ("X", 3)], "status string, flag int")})
_add("constant_table", "SELECT C.Value AS V FROM Constant.MainRegion AS C WHERE C.Value IS NOT NULL", "SELECT r_regionkey AS V FROM region WHERE r_name = 'EUROPE' OR r_regionkey = 3")
_add("composite_comparison", "SELECT T.V AS V FROM (SELECT R.Description AS V FROM Catalog.Regions AS R UNION ALL SELECT N.Ref FROM Catalog.Nations AS N) AS T WHERE T.V = \"ASIA\" OR T.V REFS Catalog.Nations",
     "SELECT 5::TINYINT AS V_TYPE, r_name AS V_S, CAST(NULL AS DECIMAL(38,10)) AS V_N, CAST(NULL AS TIMESTAMP) AS V_T, CAST(NULL AS BOOLEAN) AS V_L, CAST(NULL AS INTEGER) AS V_RTRef, CAST(NULL AS VARCHAR) AS V_RRRef FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 8, NULL, NULL, NULL, NULL, 2, CAST(n_nationkey AS VARCHAR) FROM nation")
_add("like_escape", "SELECT C.Ref AS Ref FROM Catalog.Customers AS C WHERE C.Description LIKE \"Customer~#%[^0-4]\" ESCAPE \"~\" AND NOT C.Segment LIKE \"_U%\"", "SELECT c_custkey AS Ref FROM customer WHERE regexp_matches(c_name, '^Customer#.*[^0-4]$') AND NOT c_mktsegment LIKE '_U%'")
# -- totals, batches, service ------------------------------------------------------------------
_add("totals", "SELECT D.Status AS Status, D.Priority AS Priority, SUM(D.Total) AS Total FROM Document.Orders AS D GROUP BY D.Status, D.Priority ORDER BY Status, Priority TOTALS SUM(Total) BY OVERALL, Status",
     f"WITH g AS (SELECT o_orderstatus AS s, o_orderpriority AS p, sum({_T}) AS t FROM orders GROUP BY 1, 2) SELECT s AS Status, p AS Priority, t AS Total FROM g UNION ALL SELECT s, NULL, sum(t) FROM g GROUP BY 1 UNION ALL SELECT NULL, NULL, sum(t) FROM g")
_add("totals_hierarchy", "SELECT G.Ref AS Ref, 1 AS N FROM Catalog.Geo AS G WHERE G.Parent IS NOT NULL TOTALS SUM(N) BY Ref HIERARCHY",
     f"WITH RECURSIVE {_GEO}, h AS (SELECT id AS leaf, id AS node FROM geo UNION ALL SELECT h.leaf, g.parent FROM h JOIN geo g ON g.id = h.node WHERE g.parent IS NOT NULL) SELECT id AS Ref, 1 AS N FROM geo WHERE parent IS NOT NULL UNION ALL SELECT node, count(*) FROM h JOIN geo ON geo.id = h.leaf WHERE geo.parent IS NOT NULL GROUP BY 1")
_add("batch_temp_tables", "SELECT D.Customer AS C, SUM(D.Total) AS T INTO Big FROM Document.Orders AS D GROUP BY D.Customer HAVING SUM(D.Total) > 1000000 INDEX BY C; SELECT R.Ref AS R INTO Other FROM Catalog.Regions AS R; DROP Other; SELECT B.C.Segment AS S, COUNT(*) AS N FROM Big AS B GROUP BY B.C.Segment",
     f"SELECT c_mktsegment AS S, count(*) AS N FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum({_T}) > 1000000) JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_add("temp_table_count", "SELECT D.Ref AS R INTO T FROM Document.Orders AS D WHERE D.Status = \"F\"", "SELECT count(*) AS \"Количество\" FROM orders WHERE o_orderstatus = 'F'")
_add("constants", "SELECT MainRegion AS R, Rate AS X FROM Constants", "SELECT 3 AS R, CAST(NULL AS DECIMAL(18,2)) AS X")
_add("filter_criterion", "SELECT COUNT(*) AS N FROM FilterCriterion.ByNation(3) AS F", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) + (SELECT count(*) FROM supplier WHERE s_nationkey = 3) AS N")
_add("separator_scan", "SELECT T.Ref AS Ref, T.Description AS D FROM Catalog.TenantCustomers AS T", "SELECT c_custkey AS Ref, c_name AS D FROM customer WHERE c_nationkey = 7", separators={"Tenant": 7})
_add("allowed_rows", "SELECT ALLOWED C.Ref AS Ref FROM Catalog.Customers AS C", "SELECT c_custkey AS Ref FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", restrictions={"Catalog.Customers": "Nation.Region = VALUE(Catalog.Regions.Asia)"})


# -- what else the language has ------------------------------------------------------------------
_add("add_to_temp_table", "SELECT D.Customer AS C INTO Seen FROM Document.Orders AS D WHERE D.Status = \"F\"; SELECT D.Customer AS C ADD Seen FROM Document.Orders AS D WHERE D.Status = \"P\"; SELECT S.C AS C, COUNT(*) AS N FROM Seen AS S GROUP BY S.C",
     "SELECT o_custkey AS C, count(*) AS N FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
_add("min_and_average", "SELECT D.Priority AS P, MIN(D.Total) AS Low, MIN(D.Date) AS First, MAX(D.Customer) AS Last, ROUND(AVG(D.Total), 2) AS Mean FROM Document.Orders AS D GROUP BY D.Priority", f"SELECT o_orderpriority AS P, min({_T}) AS Low, min(o_orderdate)::TIMESTAMP AS First, max(o_custkey) AS Last, CAST(round(sum({_T}) / count(*), 2) AS DECIMAL(18,2)) AS Mean FROM orders GROUP BY 1")
_add("undefined_values", "SELECT COUNT(*) AS N FROM (SELECT CASE WHEN C.Segment = \"BUILDING\" THEN UNDEFINED WHEN C.Segment = \"MACHINERY\" THEN C.Nation ELSE C.Description END AS V, C.Segment AS S FROM Catalog.Customers AS C) AS T WHERE T.V = UNDEFINED AND NOT T.S = UNDEFINED", "SELECT count(*) AS N FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("system_enumerations", "SELECT M.RecordType = VALUE(AccumulationRecordType.Expense) AS E, COUNT(*) AS N FROM AccumulationRegister.Stock AS M WHERE M.RecordType IN (VALUE(ВидДвиженияНакопления.Приход), VALUE(ВидДвиженияНакопления.Расход)) AND VALUE(AccountingRecordType.Credit) = 1 AND VALUE(AccountType.ActivePassive) = 2 GROUP BY M.RecordType = VALUE(AccumulationRecordType.Expense)",
     "SELECT l_returnflag = 'R' AS E, count(*) AS N FROM lineitem GROUP BY 1")
_add("ext_dimensions_by_kinds", "SELECT T.Account AS Account, T.ExtDimension1 AS X, T.AmountBalance AS B FROM AccountingRegister.Ledger.Balance(DATETIME(1997,1,1), Account < 2, &Kinds) AS T",
     f"SELECT acc AS Account, x AS X, sum(a) AS B FROM (SELECT l_suppkey % 5 AS acc, l_suppkey AS x, l_returnflag AS f, {_A} AS a FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' UNION ALL SELECT l_partkey % 7, l_partkey, l_returnflag, -{_A} FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01') WHERE acc < 2 GROUP BY 1, 2 HAVING sum(a) <> 0", {"Kinds": ["party"]}, ext_kinds={"AccountingRegister.Ledger": ["party"]})
_add("ext_dimension_values", "SELECT V.Correspond AS Side, V.Kind AS K, COUNT(*) AS N, SUM(V.Value) AS S FROM AccountingRegister.Ledger.Субконто AS V WHERE V.Period < DATETIME(1997,1,1) GROUP BY V.Correspond, V.Kind", "SELECT 0 AS Side, 'party' AS K, count(*) AS N, sum(l_suppkey) AS S FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' UNION ALL SELECT 1, 'party', count(*), sum(l_partkey) FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'", ext_kinds={"AccountingRegister.Ledger": ["party"]})
_add("totals_periods", "SELECT BEGINOFPERIOD(D.Date, YEAR) AS Y, SUM(D.Total) AS Total FROM Document.Orders AS D GROUP BY BEGINOFPERIOD(D.Date, YEAR) ORDER BY Y TOTALS SUM(Total), MIN(Total) AS Least, AVG(Total) AS Mean BY OVERALL, Y PERIODS(YEAR)",
     f"WITH g AS (SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS y, sum({_T}) AS t FROM orders GROUP BY 1) SELECT y AS Y, t AS Total, CAST(NULL AS DECIMAL(38,2)) AS Least, NULL AS Mean FROM g UNION ALL SELECT y, t, t, t FROM g UNION ALL SELECT NULL, sum(t), min(t), round(sum(t) / count(*), 6) FROM g")
for _name, _moment, _sql in (
    ("balance_at_boundary", Boundary(D(1997, 6, 2), True), "l_shipdate <= TIMESTAMP '1997-06-02'"), ("balance_before_boundary", Boundary(D(1997, 6, 2), False), "l_shipdate < TIMESTAMP '1997-06-02'"),
    ("balance_at_point", PointInTime(D(1997, 6, 2), 3000), "(l_shipdate < TIMESTAMP '1997-06-02' OR l_shipdate = TIMESTAMP '1997-06-02' AND l_orderkey < 3000)"), ("balance_through_point", Boundary(PointInTime(D(1997, 6, 2), 3000), True), "(l_shipdate < TIMESTAMP '1997-06-02' OR l_shipdate = TIMESTAMP '1997-06-02' AND l_orderkey <= 3000)"),
):
    _add(_name, "SELECT T.Supplier AS S, T.QuantityBalance AS Q FROM AccumulationRegister.Stock.Balance(&Moment, Supplier <= 5) AS T", f"SELECT S, sum(q) AS Q FROM (SELECT l_partkey, l_suppkey AS S, sum({_SGN} * {_Q}) AS q, sum({_SGN} * {_A}) AS a FROM lineitem WHERE {_sql} AND l_suppkey <= 5 GROUP BY 1, 2) WHERE q <> 0 OR a <> 0 GROUP BY 1", {"Moment": _moment})
_add("unique_labels", "SELECT N.Ref AS A, N.Region AS a, N.Region.Description, N.Region.Description FROM Catalog.Nations AS N", "SELECT n_nationkey AS \"A\", n_regionkey AS \"a_2\", r_name AS \"RegionDescription\", r_name AS \"RegionDescription_2\" FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
_add("in_query_of_mixed_values", "SELECT T.S AS S, COUNT(*) AS N FROM (SELECT CASE WHEN C.Segment = \"BUILDING\" THEN C.Nation ELSE C.Segment END AS V, C.Segment AS S FROM Catalog.Customers AS C) AS T WHERE T.V IN (SELECT CASE WHEN X.Region = 1 THEN X.Ref ELSE \"MACHINERY\" END FROM Catalog.Nations AS X) GROUP BY T.S",
     "SELECT c_mktsegment AS S, count(*) AS N FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND n_regionkey = 1 GROUP BY 1")
_add("in_list_of_mixed_values", "SELECT COUNT(*) AS N FROM (SELECT CASE WHEN C.Segment = \"BUILDING\" THEN C.Nation ELSE C.Segment END AS V FROM Catalog.Customers AS C) AS T WHERE T.V IN (\"MACHINERY\", \"BUILDING\", 3)", "SELECT count(*) AS N FROM customer WHERE c_mktsegment = 'MACHINERY'")
_add("nested_join_group", "SELECT R.Description AS R, COUNT(C.Ref) AS N FROM Catalog.Regions AS R LEFT JOIN (Catalog.Nations AS N INNER JOIN Catalog.Customers AS C ON C.Nation = N.Ref AND C.Balance > 9000) ON N.Region = R.Ref GROUP BY R.Description", f"SELECT r_name AS R, count(c_custkey) AS N FROM region LEFT JOIN (nation JOIN customer ON c_nationkey = n_nationkey AND {_B} > 9000) ON n_regionkey = r_regionkey GROUP BY 1")
_add("separator_join", "SELECT N.Ref AS N, COUNT(T.Ref) AS C FROM Catalog.Nations AS N LEFT JOIN Catalog.TenantCustomers AS T ON T.Tenant = N.Ref GROUP BY N.Ref", "SELECT n_nationkey AS N, count(c_custkey) AS C FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 7) ON c_nationkey = n_nationkey GROUP BY 1", separators={"Tenant": 7})
_add("order_in_nested_query", "SELECT T.R AS R FROM (SELECT TOP 7 D.Ref AS R FROM Document.Orders AS D ORDER BY D.Total DESC, D.Ref) AS T ORDER BY R AUTOORDER", f"SELECT o_orderkey AS R FROM orders ORDER BY {_T} DESC, o_orderkey LIMIT 7")
_add("not_in_query", "SELECT C.Ref AS Ref FROM Catalog.Customers AS C WHERE C.Nation NOT IN (SELECT S.Nation FROM Catalog.Suppliers AS S WHERE S.Ref < 9)", "SELECT c_custkey AS Ref FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 9)")
_add("not_in_query_with_nulls", "SELECT N.Region AS R, COUNT(*) AS N FROM Catalog.Nations AS N WHERE NOT N.Ref IN (SELECT CASE WHEN X.Region = 1 THEN X.Ref END FROM Catalog.Nations AS X WHERE X.Region > &From) OR N.Region = 4 GROUP BY N.Region", "SELECT n_regionkey AS R, count(*) AS N FROM nation WHERE n_regionkey = 4 GROUP BY 1", {"From": 0})
_add("not_in_empty_query", "SELECT COUNT(*) AS N FROM (SELECT CASE WHEN C.Balance > 0 THEN C.Nation END AS V FROM Catalog.Customers AS C) AS T WHERE T.V NOT IN (SELECT X.Ref FROM Catalog.Nations AS X WHERE X.Ref < 0)", "SELECT count(*) AS N FROM customer")
_add("text_equality", "SELECT C.Segment AS S, COUNT(*) AS N FROM Catalog.Customers AS C WHERE C.Segment + \"  \" = \"BUILDING \" OR C.Segment IN (\"MACHINERY   \", &Other) GROUP BY C.Segment", "SELECT c_mktsegment AS S, count(*) AS N FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1", {"Other": "FURNITURE "})
_add("composite_dereference", "SELECT J.Ref.Status AS S, J.Ref.Reason AS R, COUNT(*) AS N FROM DocumentJournal.AllOrders AS J GROUP BY J.Ref.Status, J.Ref.Reason", "SELECT o_orderstatus AS S, CAST(NULL AS VARCHAR) AS R, count(*) AS N FROM orders GROUP BY 1")
_add("full_name_as_qualifier", "SELECT Catalog.Nations.Description AS D FROM Catalog.Nations WHERE Catalog.Nations.Region = 1", "SELECT n_name AS D FROM nation WHERE n_regionkey = 1")
_add("record_numbers", "SELECT COUNT(DISTINCT T.N) AS N, MIN(T.N) AS First FROM (SELECT RECORDAUTONUMBER() AS N, C.Ref AS R FROM Catalog.Customers AS C) AS T", "SELECT count(*) AS N, 1 AS First FROM customer")
_add("rule_with_inner_join", "SELECT C.Ref AS Ref FROM Catalog.Customers AS C", "SELECT c_custkey AS Ref FROM customer WHERE EXISTS (SELECT 1 FROM supplier JOIN nation ON n_regionkey = 2 WHERE s_nationkey = c_nationkey AND n_nationkey = s_nationkey AND s_suppkey < 60)",
     restrictions={"Catalog.Customers": "ТекущаяТаблица КАК T ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Поставщики КАК S ПО S.Nation = T.Nation ВНУТРЕННЕЕ СОЕДИНЕНИЕ Catalog.Nations КАК N ПО N.Ref = S.Nation ГДЕ N.Region = &Home И S.Ref < 60"}, restricted=True, session={"Home": 2})
_add("rule_with_outer_join", "SELECT C.Nation.Description AS D, COUNT(*) AS N FROM Catalog.Customers AS C GROUP BY C.Nation.Description", "SELECT n_name AS D, count(*) AS N FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 0 WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey < 20) GROUP BY 1",
     restrictions={"Catalog.Customers": "LEFT JOIN Catalog.Suppliers AS S ON S.Nation = ТекущаяТаблица.Nation AND S.Ref < 20 WHERE S.Ref IS NULL", "Catalog.Nations": "Region.Ref > 0"}, restricted=True)
_add("rule_with_join_of_movements", "SELECT M.Supplier AS S, COUNT(*) AS N FROM AccumulationRegister.Stock AS M GROUP BY M.Supplier", "SELECT l_suppkey AS S, count(*) AS N FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 WHERE p_partkey IS NULL OR p_brand = 'Brand#13' GROUP BY 1",
     restrictions={"AccumulationRegister.Stock": "LEFT JOIN Catalog.Parts AS P ON P.Ref = Part AND P.Size > 25 WHERE P.Ref IS NULL OR P.Brand = \"Brand#13\""}, restricted=True)
_add("rule_over_a_virtual_table", "SELECT T.Part AS P, T.QuantityBalance AS Q FROM AccumulationRegister.Stock.Balance(, Supplier > 3) AS T", f"SELECT l_partkey AS P, sum(q) AS Q FROM (SELECT l_partkey, l_suppkey, sum({_SGN} * {_Q}) AS q, sum({_SGN} * {_A}) AS a FROM lineitem WHERE l_suppkey > 3 AND l_suppkey <= 6 GROUP BY 1, 2) WHERE q <> 0 OR a <> 0 GROUP BY 1",
     restrictions={"AccumulationRegister.Stock": "Supplier <= &Most"}, restricted=True, session={"Most": 6})
_add("rule_in_russian_parts", "ВЫБРАТЬ РАЗРЕШЕННЫЕ МАКСИМУМ(К.Остаток) КАК M, МИНИМУМ(К.Остаток) КАК L, СУММА(К.Остаток) КАК S, КОЛИЧЕСТВО(*) КАК N ИЗ Справочник.Клиенты КАК К ГДЕ ЛЕВ(К.Наименование, 8) = \"Customer\" И К.Остаток МЕЖДУ -500 И 5000 И К.Страна ЕСТЬ НЕ NULL И ГОД(ДАТАВРЕМЯ(2020, 2, 29)) = 2020 И ПОДСТРОКА(\"абв\", 2, 1) = \"б\"",
     f"SELECT max({_B}) AS M, min({_B}) AS L, sum({_B}) AS S, count(*) AS N FROM customer WHERE {_B} BETWEEN -500 AND 5000 AND c_nationkey < 12", restrictions={"Catalog.Customers": "Страна В (ВЫБРАТЬ С.Ссылка ИЗ Справочник.Страны КАК С ГДЕ С.Ссылка < 12)"})


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object whose rows come from its own table and from an extension's with one more column."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tables = {"nation": nation.where("n_nationkey < 20"), "more": nation.where("n_nationkey >= 15").withColumn("extra", F.lit(1))}
    places = Object("Catalog", "Places", [Field("Ref", "n_nationkey", "ref", (), ("Catalog.Places",)), Field("Region", "n_regionkey", "number")], "nation", extensions=("more",))
    return Engine(spark, Model([places]), tables.__getitem__).query("SELECT P.Region AS R, COUNT(*) AS N, COUNT(DISTINCT P.Ref) AS D FROM Catalog.Places AS P GROUP BY P.Region")


def _uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of sixteen bytes, as unique identifiers; one is of several types."""
    ref = lambda name, sql, *targets: Field(name, sql, "ref", (), targets)
    regions = Object("Catalog", "Regions", [ref("Ref", "unhex(md5(r_name))", "Catalog.Regions")], "region", (), 1)
    nations = Object("Catalog", "Nations", [ref("Ref", "unhex(md5(n_name))", "Catalog.Nations"), Field("Name", "n_name", "string"), ref("Any", "named_struct('type', 1, 'ref', upper(md5(cast(n_regionkey as string))))", "Catalog.Regions", "Catalog.Nations")], "nation", (), 2)
    e = Engine(spark, Model([regions, nations]), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return e.query("SELECT N.Name AS N, UUID(N.Ref) AS U, UUID(N.Any) AS A FROM Catalog.Nations AS N")


_H = "substr(h, 25, 8) || '-' || substr(h, 21, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 1, 4) || '-' || substr(h, 5, 12)"


def _checked(rule: str | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Balances by segment: one part of the rows may not be seen."""
        pens = Object("AccumulationRegister", "Money", [Field("Period", "CAST(NULL AS timestamp_ntz)", "date"), Field("Active", "true", "boolean"), Field("RecordType", "0", "number"), Field("Segment", "c_mktsegment", "string", purpose="dimension"), Field("Sum", "CAST(c_acctbal AS decimal(18,2))", "number", purpose="resource")], "customer")
        e = Engine(spark, Model([pens]), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), restricted=True, restrictions={"AccumulationRegister.Money": rule}, session={"Mine": "BUILDING"})
        return e.checked_balance("SELECT T.Segment AS Segment, T.SumBalance AS B FROM AccumulationRegister.Money.Balance(, Segment = &S) AS T", {"S": "BUILDING"}).withColumnRenamed("__forbidden_row", "Forbidden")

    return run


def _catalog(text: str, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Catalog(engine(spark, sf_dir, **how)).sql(text)

    return run


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored setting; all keys compare exactly."""
    e = engine(spark, sf_dir)
    e.tables = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col("c_mktsegment").alias("userid"), F.col("c_nationkey").cast("string").alias("objectkey"), F.col("c_name").alias("settingskey"), F.col("c_custkey").alias("settingsdata"))
    return e.setting("customer", "BUILDING", "7", "Customer#000000001").unionAll(e.setting("customer", "building", "7", "x")).agg(F.count("*").alias("n"))


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of registered changes, by its Russian name."""
    changes = Object("Catalog", "Nations.Changes", [Field("Ref", "n_nationkey", "ref", (), ("Catalog.Nations",)), Field("Node", "n_regionkey", "number", ("Узел",))], "nation")
    nations = Object("Catalog", "Nations", [Field("Ref", "n_nationkey", "ref", (), ("Catalog.Nations",)), Field("Description", "n_name", "string")], "nation", sections={"Changes": changes})
    e = Engine(spark, Model([nations]), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return e.query("SELECT C.Узел AS N, MIN(C.Ref.Description) AS D, COUNT(*) AS C FROM Catalog.Nations.Изменения AS C GROUP BY C.Узел")


def _materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary tables that are computed once, when they are made."""
    return engine(spark, sf_dir, materialize=lambda df: df.persist()).query("SELECT D.Customer AS C, COUNT(*) AS N INTO Counts FROM Document.Orders AS D GROUP BY D.Customer; SELECT A.N AS N, COUNT(*) AS K FROM Counts AS A INNER JOIN Counts AS B ON A.C = B.C GROUP BY A.N")


def _values(spark: SparkSession, rows: list, names: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"{n} string" for n in names.split()))


_MIXED = "SELECT D.Ref AS R, CASE WHEN D.Ref = &P THEN D.Customer ELSE \"x\" END AS V FROM Document.Orders AS D WHERE D.Customer.Nation = &N ORDER BY D.Date; SELECT T.A FROM T AS T"


def _discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text mentions, without lowering it."""
    found = engine(spark, sf_dir).prepare(_MIXED)
    return _values(spark, [(what, name) for what, names in found.items() for name in names], "what name")


def _field_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clauses read a field."""
    found = engine(spark, sf_dir).field_usage(_MIXED)
    return _values(spark, [(f, role) for f, roles in found.items() for role in roles], "field role")


def _recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns make up each logical value."""
    found = engine(spark, sf_dir).describe(_MIXED.split(";")[0], {"P": 1, "N": 2})
    return _values(spark, [(x["label"], x["kind"], ",".join(x["targets"]), ",".join(x["columns"])) for x in found], "label kind targets columns")


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction templates expanded, and the rules of several roles added up; then the rows that they leave."""
    own = Role("own", {"Catalog.Customers": "#Если &Всё = ИСТИНА #Тогда ИСТИНА #Иначе #Свои(Nation, \"&Моя\") #КонецЕсли", "Catalog.Nations": True}, {"Свои": "#Параметр(1) = #Параметр(2)"})
    rich = Role("rich", {"Catalog.Customers": "Balance > 9000"})
    session = {"Всё": False, "Моя": 3}
    rules = decisions([own, rich], ["Catalog.Customers", "Catalog.Nations", "Catalog.Parts"], session)
    e = engine(spark, sf_dir, restricted=True, restrictions=rules, session=session)
    return e.query("SELECT C.Ref AS Ref FROM Catalog.Customers AS C WHERE NOT C.Ref IN (SELECT P.Ref FROM Catalog.Parts AS P)")


def _rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights over metadata, by roles."""
    m = engine(spark, sf_dir).model
    clerk = Role("clerk", {}, listed={("Document.Orders", "View"): True, ("Document.Orders", "Status", "View"): False, ("Catalog.Parts", "Read"): True}, attributes=True)
    admin = Role("admin", {}, listed={("Catalog.Parts", "View"): False}, new_objects=True)
    asked = [(r, o, w, a) for r in (clerk, admin) for o, w, a in (("Document.Orders", "View", None), ("Документ.Заказы", "Просмотр", "Status"), ("Document.Orders", "View", "Дата"), ("Catalog.Parts", "Read", None), ("Catalog.Parts", "View", "Description"))]
    return _values(spark, [(r.name, o, w, a, granted(m, r, o, w, a)) for r, o, w, a in asked], "role object permission attribute granted")


_SEEN = f"SELECT c_mktsegment AS Segment, sum({_B}) AS B, FALSE AS Forbidden FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1"
#: name -> (function, DuckDB SQL): what is more than one text over the sample model.
MORE: dict[str, tuple] = {
    "extension_rows": (_extended, "SELECT n_regionkey AS R, count(*) AS N, count(DISTINCT n_nationkey) AS D FROM (SELECT * FROM nation WHERE n_nationkey < 20 UNION ALL SELECT * FROM nation WHERE n_nationkey >= 15) GROUP BY 1"),
    "uuid_byte_order": (_uuids, f"SELECT n_name AS N, (SELECT {_H} FROM (SELECT md5(n_name) AS h)) AS U, (SELECT {_H} FROM (SELECT md5(CAST(n_regionkey AS VARCHAR)) AS h)) AS A FROM nation"),
    "checked_balance_allowed": (_checked("Segment = &Mine"), _SEEN),
    "checked_balance_forbidden": (_checked('Segment = "MACHINERY"'), "SELECT CAST(NULL AS VARCHAR) AS Segment, CAST(NULL AS DECIMAL(38,2)) AS B, TRUE AS Forbidden"),
    "stored_setting": (_settings, "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 AND c_name = 'Customer#000000001'"),
    "service_table": (_service, "SELECT n_regionkey AS N, min(n_name) AS D, count(*) AS C FROM nation GROUP BY 1"),
    "materialized_batch": (_materialized, "SELECT n AS N, count(*) AS K FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1"),
    "discovery": (_discovery, "SELECT * FROM (VALUES ('parameters', 'N'), ('parameters', 'P'), ('objects', 'Document.Orders'), ('temporary_tables', 'T'), ('fields', 'D.Customer'), ('fields', 'D.Customer.Nation'), ('fields', 'D.Date'), ('fields', 'D.Ref'), ('fields', 'T.A')) t(what, name)"),
    "field_usage": (_field_usage, "SELECT * FROM (VALUES ('D.Ref', 'projection'), ('D.Customer', 'projection'), ('D.Customer.Nation', 'condition'), ('D.Date', 'ordering'), ('T.A', 'projection')) t(field, role)"),
    "projection_recipe": (_recipe, "SELECT * FROM (VALUES ('R', 'ref', 'Document.Orders', 'R'), ('V', 'composite', '', 'V_TYPE,V_S,V_N,V_T,V_L,V_RTRef,V_RRRef')) t(label, kind, targets, columns)"),
    "rules_of_roles": (_templates, f"SELECT c_custkey AS Ref FROM customer WHERE c_nationkey = 3 OR {_B} > 9000"),
    "metadata_rights": (
        _rights,
        "SELECT * FROM (VALUES ('clerk', 'Document.Orders', 'View', 'None', 'True'), ('clerk', 'Документ.Заказы', 'Просмотр', 'Status', 'False'), ('clerk', 'Document.Orders', 'View', 'Дата', 'True'), ('clerk', 'Catalog.Parts', 'Read', 'None', 'True'), ('clerk', 'Catalog.Parts', 'View', 'Description', 'False'), "
        "('admin', 'Document.Orders', 'View', 'None', 'True'), ('admin', 'Документ.Заказы', 'Просмотр', 'Status', 'False'), ('admin', 'Document.Orders', 'View', 'Дата', 'False'), ('admin', 'Catalog.Parts', 'Read', 'None', 'True'), ('admin', 'Catalog.Parts', 'View', 'Description', 'False')) t(role, object, permission, attribute, granted)",
    ),
    "catalog_columns": (_catalog("SELECT c.column_name, c.ordinal_position AS at, c.data_type FROM information_schema.columns c WHERE c.table_name = 'Catalog.Nations' AND c.data_type = ANY (ARRAY['bytea', 'text']) ORDER BY 2 LIMIT 10"), "SELECT * FROM (VALUES ('Ref', 1, 'bytea'), ('Description', 2, 'text'), ('Region', 3, 'bytea')) t(column_name, \"at\", data_type)"),
    "catalog_joins_and_aggregates": (
        _catalog("WITH named AS (SELECT c.oid, c.relname, n.nspname FROM pg_catalog.pg_class c LEFT JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'v') AND n.nspname !~ '^pg_' AND pg_catalog.pg_table_is_visible(c.oid)) SELECT named.relname, count(*) AS n, max(a.attnum) AS last, string_agg(a.attname, ',') WITHIN GROUP (ORDER BY a.attnum) AS names FROM named JOIN pg_attribute a ON a.attrelid = named.oid WHERE named.relname OPERATOR(pg_catalog.~) '^Catalog[.](Nations|Regions)$' AND NOT a.attisdropped GROUP BY named.relname HAVING count(*) > 1"),
        "SELECT * FROM (VALUES ('Catalog.Nations', 3, 3, 'Ref,Description,Region'), ('Catalog.Regions', 2, 2, 'Ref,Description')) t(relname, n, last, names)",
    ),
    "catalog_functions": (
        _catalog("SELECT x.k::text AS k, 'a::text' AS same, 'unnest(b)' AS too, format_type(25, NULL) AS f, quote_ident('a B') AS q, array_to_string(ARRAY['x', 'y'], '-') AS j, array_upper(ARRAY[5, 6], 1) AS u, coalesce(nullif(lower('A'), 'b'), 'c') AS c, greatest(1, 2) AS g, CASE WHEN 'Abc' ~* 'B' AND 'Abc' ILIKE 'a%' AND NULL IS NOT DISTINCT FROM NULL THEN 'yes' ELSE 'no' END AS r, current_schema() AS s, has_table_privilege('Catalog.Nations', 'SELECT') AS may, has_table_privilege('Catalog.Secret', 'SELECT') AS no FROM generate_series(1, 3) AS x(k) UNION ALL VALUES ('v', 'w', 'x', 'y', 'z', 'j', 0, 'c', 0, 'r', 's', true, false)"),
        "SELECT k::VARCHAR AS k, 'a::text' AS same, 'unnest(b)' AS too, 'text' AS f, '\"a B\"' AS q, 'x-y' AS j, 2 AS u, 'a' AS c, 2 AS g, 'yes' AS r, 'public' AS s, TRUE AS may, FALSE AS no FROM range(1, 4) t(k) UNION ALL VALUES ('v', 'w', 'x', 'y', 'z', 'j', 0, 'c', 0, 'r', 's', true, false)",
    ),
    "catalog_of_a_restricted_user": (_catalog("SELECT table_name, has_table_privilege(table_schema || '.' || table_name, 'SELECT') AS odd, has_table_privilege(table_name, 'SELECT') AS may FROM information_schema.tables UNION SELECT 'Catalog.Parts', false, has_table_privilege('Catalog.Parts', 'SELECT')", restricted=True, restrictions={"Catalog.Nations": None, "Catalog.Regions": "Ref > 1", "Catalog.Parts": DENIED}), "SELECT * FROM (VALUES ('Catalog.Nations', FALSE, TRUE), ('Catalog.Regions', FALSE, TRUE), ('Catalog.Parts', FALSE, FALSE)) t(table_name, odd, may)"),
    "catalog_keys": (_catalog("SELECT k.column_name AS c, t.constraint_type AS t, EXISTS (SELECT 1 FROM information_schema.columns x WHERE x.table_name = k.table_name AND x.column_name = k.column_name) AS e FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k USING (constraint_name) WHERE t.table_name = 'Document.Orders' ORDER BY t DESC NULLS LAST OFFSET 0"), "SELECT * FROM (VALUES ('Ref', 'PRIMARY KEY', TRUE), ('Customer', 'FOREIGN KEY', TRUE)) t(c, t, e)"),
}


def _runner(name: str):
    text, params, how, _ = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, **how).query(text, params)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _runner(name) for name in QUERIES} | {name: run for name, (run, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[3] for name, q in QUERIES.items()} | {name: sql for name, (_, sql) in MORE.items()}
