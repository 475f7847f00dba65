"""Registered queries of the relational engine, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.api import Database
from granary.errors import Code, GranaryError
from granary.functions import search
from granary.sources.store import Store
from granary.sources.tables import table

#: name -> (tables, SQL of the dialect, DuckDB SQL or None where the same text serves both).
SQL: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    # ---- scans and projection
    "scan_all": (("region",), "SELECT * FROM region", None),
    "project_columns": (("orders",), "SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice price FROM orders", None),
    "project_qualified": (("orders",), "SELECT o.o_orderkey AS k, o.o_orderstatus AS s FROM orders o", None),
    "project_table_star": (("nation", "region"), "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", None),
    "project_expr": (
        ("lineitem",),
        "SELECT l_orderkey AS k, ROUND(l_extendedprice * (1 - l_discount), 6) AS net, -l_tax AS minus_tax, l_quantity + 1 - 2 * 3 AS q FROM lineitem",
        None,
    ),
    "select_no_table": ((), "SELECT CAST(1 + 1 AS BIGINT) AS two, 'x' AS s, 2.5 AS d, NULL IS NULL AS yes", "SELECT CAST(1 + 1 AS BIGINT) AS two, 'x' AS s, CAST(2.5 AS DOUBLE) AS d, CAST(1 AS BIGINT) AS yes"),
    # ---- filters and predicates
    "filter_eq": (("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_ne": (("orders",), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_ne_c": (("orders",), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus != 'O'", None),
    "filter_lt": (("part",), "SELECT p_partkey, p_size FROM part WHERE p_size < 10", None),
    "filter_le": (("part",), "SELECT p_partkey, p_size FROM part WHERE p_size <= 10", None),
    "filter_gt": (("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000.5", None),
    "filter_ge": (("part",), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 990.5", None),
    "filter_and_or_not": (
        ("lineitem",),
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE (l_quantity < 5 OR l_discount > 0.08) AND NOT l_returnflag = 'R' AND NOT (l_tax > 0.05 AND l_linestatus = 'O')",
        None,
    ),
    "filter_is_null": (
        ("nation", "region"),
        "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey + 3 WHERE r_name IS NULL",
        None,
    ),
    "filter_is_not_null": (
        ("nation", "region"),
        "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey + 3 WHERE r_name IS NOT NULL",
        None,
    ),
    "filter_like": (("part",), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_type LIKE '_ROMO%'", None),
    "filter_not_like": (("part",), "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%'", None),
    "filter_in": (("part",), "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3, 5) AND p_brand NOT IN ('Brand#11', 'Brand#12')", None),
    "filter_between": (("lineitem",), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", None),
    "filter_three_valued": (
        ("nation", "region"),
        "SELECT n_nationkey FROM nation LEFT JOIN region ON n_nationkey = r_regionkey + 3 WHERE r_regionkey > 1 OR n_nationkey > 20",
        None,
    ),
    "predicate_as_int": (
        ("orders",),
        "SELECT o_orderkey, o_totalprice > 100000 AS large, o_orderstatus = 'F' AND o_custkey < 700 AS both FROM orders",
        "SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS large, CAST(o_orderstatus = 'F' AND o_custkey < 700 AS BIGINT) AS both FROM orders",
    ),
    "arith_div_null_on_zero": (
        ("orders",),
        "SELECT o_orderkey, ROUND(o_totalprice / o_orderkey, 6) AS ratio, o_custkey / 4 AS quarter FROM orders",
        "SELECT o_orderkey, ROUND(o_totalprice / NULLIF(o_orderkey, 0), 6) AS ratio, o_custkey / 4 AS quarter FROM orders",
    ),
    "arith_mod": (("orders",), "SELECT o_orderkey, o_custkey % o_orderkey AS rest FROM orders", "SELECT o_orderkey, o_custkey % NULLIF(o_orderkey, 0) AS rest FROM orders"),
    "point_lookup": (("customer",), "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77", None),
    "range_scan": (("lineitem",), "SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 5000", None),
    # ---- joins
    "join_inner": (("customer", "orders"), "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", None),
    "join_left": (
        ("orders", "lineitem"),
        "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT OUTER JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 30",
        None,
    ),
    "join_right": (("orders", "lineitem"), "SELECT l_linenumber, l_suppkey, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey", None),
    "join_cross": (("nation", "region"), "SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "join_comma": (("nation", "region"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_no_on": (("nation", "region"), "SELECT n_nationkey, r_regionkey FROM nation JOIN region", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region"),
    "join_theta": (("nation", "region"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey", None),
    "join_multi": (
        ("region", "nation", "customer", "orders"),
        """SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey
           JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000""",
        None,
    ),
    "join_self": (("nation",), "SELECT x.n_name AS a, y.n_name AS b FROM nation AS x JOIN nation AS y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey", None),
    # ---- aggregation
    "agg_count_star": (("orders", "lineitem"), "SELECT COUNT(*) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", None),
    "agg_count_col": (("orders", "lineitem"), "SELECT COUNT(l_orderkey) AS n, COUNT(*) AS every FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", None),
    "agg_sum_int": (("lineitem",), "SELECT SUM(l_linenumber) AS s FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem"),
    "agg_sum_double": (("lineitem",), "SELECT ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem", None),
    "agg_avg": (("lineitem",), "SELECT ROUND(AVG(l_quantity), 6) AS q, ROUND(AVG(l_discount), 6) AS d FROM lineitem", None),
    "agg_min_max_text": (("orders",), "SELECT MIN(o_orderpriority) AS a, MAX(o_orderpriority) AS b, MIN(o_orderdate) AS c, MAX(o_orderdate) AS d, MIN(o_totalprice) AS e, MAX(o_custkey) AS f FROM orders", None),
    "agg_global_where": (("lineitem",), "SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice * l_discount), 2) AS s FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "agg_empty_input": (
        ("lineitem",),
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS m, SUM(l_tax) AS s, AVG(l_tax) AS a, MIN(l_returnflag) AS lo, MAX(l_linenumber) AS hi FROM lineitem WHERE 1 = 0",
        None,
    ),
    "group_by_one": (("orders",), "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus", None),
    "group_by_multi": (
        ("lineitem",),
        """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
                  ROUND(AVG(l_extendedprice), 4) AS avg_price, COUNT(*) AS n
           FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP_NTZ) GROUP BY l_returnflag, l_linestatus""",
        """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
                  ROUND(AVG(l_extendedprice), 4) AS avg_price, COUNT(*) AS n
           FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus""",
    ),
    "group_by_expr": (("orders",), "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY year(o_orderdate)", None),
    "having": (("orders",), "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "agg_expr_over_aggs": (
        ("lineitem",),
        "SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_quantity) / SUM(l_quantity), 4) AS weighted, MAX(l_tax) - MIN(l_tax) AS spread FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "agg_over_join": (
        ("customer", "orders", "lineitem"),
        """SELECT c_mktsegment, COUNT(*) AS n_orders, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
           FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
           WHERE o_orderstatus = 'F' GROUP BY c_mktsegment HAVING COUNT(*) > 0 ORDER BY revenue DESC, c_mktsegment LIMIT 5""",
        None,
    ),
    # ---- order and limit
    "order_by_multi": (("orders",), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey", None),
    "order_by_expr_alias": (("part",), "SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, -p_partkey LIMIT 40", None),
    "order_by_ordinal": (("nation",), "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 7", None),
    "order_nulls_lowest": (
        ("nation", "region"),
        "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey ORDER BY r_name, n_nationkey LIMIT 22",
        "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey ORDER BY r_name NULLS FIRST, n_nationkey LIMIT 22",
    ),
    "limit": (("orders",), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10", None),
    "limit_offset": (("orders",), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5", None),
    "top_k": (("lineitem",), "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 25", None),
    "limit_zero": (("orders",), "SELECT o_orderkey, o_orderstatus FROM orders LIMIT 0", None),
    # ---- functions
    "functions_builtin": (
        ("customer",),
        "SELECT c_custkey, UPPER(c_name) AS u, LENGTH(c_mktsegment) AS n, ABS(c_acctbal) AS a, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer",
        "SELECT c_custkey, UPPER(c_name) AS u, CAST(LENGTH(c_mktsegment) AS INTEGER) AS n, ABS(c_acctbal) AS a, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer",
    ),
    "json_extract": (
        ("events",),
        "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.none') AS missing FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events",
    ),
}


def _database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """A memory database over the given tables, as they are."""
    db = Database(spark)
    for name in names:
        db.attach(name, f"{sf_dir.rstrip('/')}/{name}.parquet")
    return db


def _runner(tables: tuple[str, ...], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _database(spark, sf_dir, *tables).query(sql)


def _script(name: str, *steps: str, reads: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Statements on a copy of one table, then the table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _database(spark, sf_dir, name)
        for step in steps:
            db.execute(step)
        return db.query(reads) if reads else db.table(name)

    return run


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ? AND o_orderstatus = ? AND o_custkey <> ?"
    return _database(spark, sf_dir, "orders").query(sql, 250000.0, "O", 5)


def _index_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "customer")
    db.execute("CREATE UNIQUE INDEX by_key ON customer (c_custkey)")
    return db.query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")


def _index_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "customer")
    db.execute("CREATE INDEX by_nation ON customer (c_nationkey, c_custkey)")
    return db.query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")


def _create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.exec(
        """CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE, age INTEGER DEFAULT 18);
           INSERT INTO users (id, name, email, age) VALUES (1, 'Alice', 'alice@example.com', 25), (2, 'Bob', 'bob@example.com', 30), (3, 'Carol', NULL, NULL);
           INSERT INTO users (name, id) VALUES ('Dave', -4)"""
    )
    return db.table("users")


def _encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column sealed and opened again: what comes back is the table."""
    db = _database(spark, sf_dir, "supplier")
    db.key("a pass phrase")
    return db.table("supplier")


#: Rows of the bulk insert.
BULK = 100_000


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement with 100,000 rows of literals."""
    db = Database(spark)
    db.execute("CREATE TABLE t (id INTEGER, half REAL, name TEXT)")
    db.execute("INSERT INTO t VALUES " + ", ".join(f"({k}, {k / 2}, 'row ''{k % 97}')" if k % 10 else f"({k}, NULL, 'ten')" for k in range(BULK)))
    return db.query("SELECT name, COUNT(*) AS n, SUM(id) AS ids, SUM(half) AS halves FROM t GROUP BY name")


def _told(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    """What an API told, as rows of step and answer."""
    return spark.createDataFrame(rows, "step string, answer string")


def _change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changes, total_changes and last_insert_rowid after each statement."""
    db, out = _database(spark, sf_dir, "region"), []
    for name, sql in (
        ("insert", "INSERT INTO region VALUES (7, 'seven'), (8, 'eight')"),
        ("update", "UPDATE region SET r_name = 'x' WHERE r_regionkey < 3"),
        ("none", "DELETE FROM region WHERE r_regionkey = 99"),
        ("delete", "DELETE FROM region"),
    ):
        db.execute(sql)
        out.append((name, f"{db.changes()} {db.total_changes()} {db.last_insert_rowid()}"))
    return _told(spark, out)


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each refused statement; the table stays as it was."""
    db, out = Database(spark), []
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, mail TEXT UNIQUE); INSERT INTO t VALUES (1, 'a', 'm'), (2, 'b', NULL)")
    for name, sql in (
        ("primary key", "INSERT INTO t VALUES (1, 'c', 'n')"),
        ("not null", "INSERT INTO t VALUES (3, NULL, 'n')"),
        ("unique", "INSERT INTO t VALUES (3, 'c', 'm')"),
        ("twice in one", "INSERT INTO t VALUES (3, 'c', 'n'), (3, 'd', 'o')"),
        ("update", "UPDATE t SET id = 1"),
        ("null mail", "INSERT INTO t VALUES (3, 'c', NULL)"),
    ):
        try:
            db.execute(sql)
            out.append((name, "fine"))
        except GranaryError as error:
            out.append((name, error.code.name))
    return _told(spark, [*out, ("rows", str(db.query_single("SELECT COUNT(*) FROM t")[0]))])


def _statement_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind, step, columns by place, reset."""
    db, out = _database(spark, sf_dir, "nation"), []
    with db.prepare("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ? AND n_name >= ? ORDER BY n_nationkey; SELECT 1") as found:
        for region in (1, 4):
            found.reset()
            found.bind_int(1, region).bind_text(2, "A")
            while found.step() == Code.ROW:
                out.append((f"region {region}", f"{found.column_int(0)} {found.column_text(1)} {found.column_count()}"))
        out.append(("tail", found.tail))
    return _told(spark, out)


def _exec_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, out = _database(spark, sf_dir, "region"), []

    def row(n: int, texts: list[str | None], names: list[str]) -> None:
        out.append((" ".join(names), "|".join(str(t) for t in texts)))

    db.exec("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey; SELECT NULL AS nothing", row)
    return _told(spark, out)


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database in files, written, closed and opened again; what was not committed is gone."""
    path = f"{Store(spark, None).root}/files"
    with Database(spark, path) as db:
        db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'); UPDATE t SET name = 'c' WHERE id = 2")
        db.exec("BEGIN; DELETE FROM t")
    return Database(spark, path).table("t")


def _rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under one key, then another cipher and key, then in clear."""
    db = _database(spark, sf_dir, "region")
    db.key("first")
    db.rekey("second", "aes-256-cbc")
    db.execute("UPDATE region SET r_name = 'sealed' WHERE r_regionkey = 0")
    db.decrypt()
    return db.table("region")


def _vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "embeddings")
    first = db.query_single("SELECT embedding FROM embeddings WHERE vec_id = 0")
    found = db.vector_search("embeddings", "embedding", first[0], 10, "vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


#: Fixed value: the query of the text search entries.
TEXT_QUERY = "the was"


def _fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fts_match(table(spark, sf_dir, "documents"), "text", TEXT_QUERY).select("doc_id", "lang")


def _fts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.fts_search(table(spark, sf_dir, "documents"), "text", TEXT_QUERY, "doc_id")
    return found.select("doc_id", F.round("score", 4).alias("score"))


_TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"

#: name -> (query, DuckDB SQL).
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "param_query": (_params, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O' AND o_custkey <> 5"),
    "index_equality": (_index_equality, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77"),
    "index_secondary": (_index_secondary, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7"),
    "create_table_insert": (
        _create_insert,
        """SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Alice', 'alice@example.com', CAST(25 AS BIGINT)), (2, 'Bob', 'bob@example.com', 30),
                                 (3, 'Carol', NULL, NULL), (-4, 'Dave', NULL, 18)) AS t(id, name, email, age)""",
    ),
    "insert_values": (
        _script("nation", "INSERT INTO nation VALUES (100, 'Atlantis', 1), (101, 'Utopia', 1 + 1)"),
        "SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (100, 'Atlantis', 1), (101, 'Utopia', 2))",
    ),
    "insert_bulk": (
        _bulk,
        f"""SELECT name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, sum(half) AS halves FROM (
              SELECT i AS id, CASE WHEN i % 10 > 0 THEN i / 2 END AS half, CASE WHEN i % 10 > 0 THEN 'row ''' || (i % 97) ELSE 'ten' END AS name
              FROM range({BULK}) AS t(i)) GROUP BY name""",
    ),
    "api_change_counts": (_change_counts, "SELECT * FROM (VALUES ('insert', '2 2 2'), ('update', '3 5 2'), ('none', '0 5 2'), ('delete', '7 12 2')) AS t(step, answer)"),
    "api_constraints": (
        _constraints,
        """SELECT * FROM (VALUES ('primary key', 'CONSTRAINT'), ('not null', 'CONSTRAINT'), ('unique', 'CONSTRAINT'), ('twice in one', 'CONSTRAINT'),
                                 ('update', 'CONSTRAINT'), ('null mail', 'fine'), ('rows', '3')) AS t(step, answer)""",
    ),
    "api_statement": (
        _statement_api,
        """SELECT 'region ' || n_regionkey AS step, n_nationkey || ' ' || n_name || ' 2' AS answer FROM nation WHERE n_regionkey IN (1, 4) AND n_name >= 'A'
           UNION ALL SELECT 'tail', 'SELECT 1'""",
    ),
    "api_exec_callback": (
        _exec_callback,
        "SELECT 'r_regionkey r_name' AS step, r_regionkey || '|' || r_name AS answer FROM region UNION ALL SELECT 'nothing', 'None'",
    ),
    "api_reopen": (_reopened, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'c')) AS t(id, name)"),
    "rekey_decrypt": (_rekeyed, "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'sealed' ELSE r_name END AS r_name FROM region"),
    "divide_by_subscript": (
        _runner(("orders",), "SELECT o_orderkey, o_totalprice / array(0, 4)[o_orderkey % 2] AS q FROM orders"),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice / 4 END AS q FROM orders",
    ),
    "insert_column_list": (
        _script("nation", "INSERT INTO nation (n_name, n_nationkey) VALUES ('Atlantis', -100)"),
        "SELECT * FROM nation UNION ALL SELECT -100, 'Atlantis', NULL",
    ),
    "insert_select": (
        _script("nation", "INSERT INTO nation SELECT n_nationkey + 1000, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
        "SELECT * FROM nation UNION ALL SELECT n_nationkey + 1000, n_name, n_regionkey FROM nation WHERE n_regionkey = 2",
    ),
    "update_where": (
        _script("supplier", "UPDATE supplier SET s_acctbal = s_acctbal * 1.05, s_name = 'big' WHERE s_acctbal > 5000"),
        """SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'big' ELSE s_name END AS s_name, s_nationkey,
                  CASE WHEN s_acctbal > 5000 THEN s_acctbal * CAST(1.05 AS DOUBLE) ELSE s_acctbal END AS s_acctbal FROM supplier""",
    ),
    "update_all": (
        _script("supplier", "UPDATE supplier SET s_nationkey = s_nationkey + 1"),
        "SELECT s_suppkey, s_name, s_nationkey + 1 AS s_nationkey, s_acctbal FROM supplier",
    ),
    "update_swap": (
        _script("nation", "UPDATE nation SET n_nationkey = n_regionkey, n_regionkey = n_nationkey WHERE n_regionkey < 3"),
        """SELECT CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE n_nationkey END AS n_nationkey, n_name,
                  CASE WHEN n_regionkey < 3 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation""",
    ),
    "delete_where": (_script("orders", "DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 1000"), "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000)"),
    "delete_all": (_script("region", "DELETE FROM region"), "SELECT * FROM region WHERE false"),
    "drop_table": (
        _script("region", "CREATE TABLE kept AS SELECT r_name FROM region", "DROP TABLE region", "CREATE TABLE region (r_name TEXT)", "INSERT INTO region SELECT r_name FROM kept WHERE r_name > 'B'"),
        "SELECT r_name FROM region WHERE r_name > 'B'",
    ),
    "txn_commit": (
        _script("region", "BEGIN TRANSACTION", "UPDATE region SET r_name = 'one' WHERE r_regionkey = 1", "DELETE FROM region WHERE r_regionkey = 4", "COMMIT"),
        "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4",
    ),
    "txn_rollback": (_script("region", "BEGIN", "DELETE FROM region WHERE r_regionkey > 1", "INSERT INTO region VALUES (9, 'nine')", "ROLLBACK"), "SELECT * FROM region"),
    "savepoint_rollback_to": (
        _script(
            "region",
            "BEGIN",
            "INSERT INTO region VALUES (9, 'nine')",
            "SAVEPOINT a",
            "DELETE FROM region WHERE r_regionkey < 3",
            "SAVEPOINT b",
            "DELETE FROM region",
            "ROLLBACK TO SAVEPOINT b",
            "ROLLBACK TO a",
            "UPDATE region SET r_name = 'NINE' WHERE r_regionkey = 9",
            "RELEASE SAVEPOINT a",
            "COMMIT",
        ),
        "SELECT * FROM region UNION ALL SELECT 9, 'NINE'",
    ),
    "encrypted_round_trip": (_encrypted, "SELECT * FROM supplier"),
    "vector_topk": (
        _vector_topk,
        """SELECT vec_id, ROUND(similarity, 6) AS similarity FROM (
             SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
             FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 10)""",
    ),
    "fts_match": (
        _fts_match,
        f"SELECT doc_id, lang FROM documents WHERE list_contains({_TERMS}, 'the') AND list_contains({_TERMS}, 'was')",
    ),
    "fts_rank": (
        _fts_rank,
        f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
             s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(greatest(1, count(*) FILTER (list_contains(terms, 'the'))) AS DOUBLE) AS d1,
                          CAST(greatest(1, count(*) FILTER (list_contains(terms, 'was'))) AS DOUBLE) AS d2 FROM t)
             SELECT doc_id, ROUND(len(list_filter(terms, lambda x: x = 'the')) * ln(n / d1) + len(list_filter(terms, lambda x: x = 'was')) * ln(n / d2), 4) AS score
             FROM t, s WHERE list_contains(terms, 'the') AND list_contains(terms, 'was')""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _runner(tables, sql) for name, (tables, sql, _) in SQL.items()}
    return found | {name: query for name, (query, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: other or sql for name, (_, sql, other) in SQL.items()}
    return found | {name: sql for name, (_, sql) in OTHERS.items()}

