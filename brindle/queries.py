"""Registered queries of the SQL engine over the driver's tables, each with the SQL that DuckDB checks it by.

Doubles are registered as decimal(15,2); results are cast to plain types where
the two engines name them differently.
"""

from __future__ import annotations

from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .deploy import ship
from .functions.decay import decayed, decayed_steps
from .plans.fingerprint import fingerprint
from .session import Engine, Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session of an engine of its own, for statements that declare or change something."""
    engine = Engine(spark)
    engine.catalog.parquet(sf_dir, *TABLES, unique={"lineitem": False})
    return engine.session()


def reader(spark: SparkSession, sf_dir: str) -> Session:
    """A session of the engine that stays open over the folder: a file's schema is read when a statement first names it."""
    engines = spark.__dict__.setdefault("_brindle_engines", {})
    if sf_dir not in engines:
        engines[sf_dir] = session(spark, sf_dir).engine
    return engines[sf_dir].session()


def query(oracle: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return run

    return register


def plain(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the given column names; decimals as doubles, which both engines print alike."""
    df = df.toDF(*names) if names else df
    return df.select(*(F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields))


def statement(name: str, text: str, names: str, oracle: str) -> None:
    """Register a SELECT of the dialect: its text, the names of its columns, and the SQL to check it by."""

    def run(spark, sf_dir):
        return plain(reader(spark, sf_dir).sql(text), *names.split())

    run.__name__ = name
    query(oracle)(run)


D = "::decimal(15,2)"
statement("scan_star", "SELECT * FROM nation", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
statement("project_repeat", "SELECT n_name, n_nationkey, n_name FROM nation", "a b c", "SELECT n_name AS a, n_nationkey AS b, n_name AS c FROM nation")
statement("filter_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "c_custkey c_name", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
statement("filter_ne", "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'", "c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
statement("filter_lt_gt", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.50 AND o_totalprice < 20000 AND o_custkey >= 10 AND o_custkey <= 900", "o_orderkey", f"SELECT o_orderkey FROM orders WHERE o_totalprice{D} > 1000.50 AND o_totalprice{D} < 20000 AND o_custkey BETWEEN 10 AND 900")
statement("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN '1000.00' AND '5000.00'", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000")
statement("filter_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01 00:00:00'", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
statement("filter_col_col", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey", "l_orderkey l_partkey l_suppkey l_linenumber", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
statement("filter_null_eq_empty", "SELECT c_custkey FROM customer WHERE c_name != NULL", "c_custkey", "SELECT c_custkey FROM customer WHERE c_name <> NULL")
statement("filter_mismatch_false", "SELECT c_custkey FROM customer WHERE c_name = 7", "c_custkey", "SELECT c_custkey FROM customer WHERE false")
statement("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 7", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "SELECT * FROM orders WHERE o_orderkey = 7")
statement("pk_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400", "o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
statement("join_pk", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey", "o_orderkey c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
statement("join_non_pk", "SELECT s.s_suppkey, c.c_custkey FROM supplier AS s JOIN customer AS c ON s.s_nationkey = c.c_nationkey", "s_suppkey c_custkey", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
statement("join_three", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "o_orderkey c_name n_name", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
statement("join_self_lt", "SELECT a.s_suppkey, b.s_suppkey FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey", "a b", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
statement("exists_corr", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT orders.o_orderkey FROM orders WHERE orders.o_custkey = customer.c_custkey AND orders.o_totalprice > 450000)", "c_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
statement("exists_uncorr", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_orderkey = 1)", "r_regionkey", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 1)")
statement("not_exists_uncorr", "SELECT r_regionkey FROM region WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_orderkey = 0)", "r_regionkey", "SELECT r_regionkey FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 0)")
statement("not_exists_corr", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT orders.o_orderkey FROM orders WHERE orders.o_custkey = customer.c_custkey AND orders.o_totalprice > 450000)", "c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
statement("exists_theta", "SELECT a.s_suppkey FROM supplier AS a WHERE EXISTS (SELECT b.s_suppkey FROM supplier AS b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal)", "s_suppkey", "SELECT s_suppkey FROM supplier a WHERE EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal)")
statement("in_sub", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)", "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
statement("not_in_sub", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)", "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
statement("not_in_empty", "SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 999)", "r_regionkey", "SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 999)")
statement("not_in_corr", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT customer.c_nationkey FROM customer WHERE customer.c_nationkey = nation.n_regionkey)", "n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey = n_regionkey)")
statement("scalar_eq", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", "n_name", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
statement("scalar_zero_rows", "SELECT n_name FROM nation WHERE n_regionkey != (SELECT r_regionkey FROM region WHERE r_name = 'NOWHERE')", "n_name", "SELECT n_name FROM nation WHERE n_regionkey <> (SELECT r_regionkey FROM region WHERE r_name = 'NOWHERE')")
statement("scalar_corr", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT region.r_regionkey FROM region WHERE region.r_regionkey = nation.n_nationkey)", "n_name", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_regionkey = n_nationkey)")
statement("nested_two_level", "SELECT n.n_nationkey FROM nation AS n WHERE EXISTS (SELECT c.c_custkey FROM customer AS c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT s.s_suppkey FROM supplier AS s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > c.c_acctbal))", "n_nationkey", "SELECT DISTINCT n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > c_acctbal")
statement("nested_not_in_two_level", "SELECT n.n_nationkey FROM nation AS n WHERE NOT EXISTS (SELECT c.c_custkey FROM customer AS c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey NOT IN (SELECT o.o_custkey FROM orders AS o WHERE o.o_custkey > n.n_nationkey))", "n_nationkey", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey > n_nationkey))")
statement("count_star", "SELECT COUNT(*) FROM lineitem", "n", "SELECT count(*) AS n FROM lineitem")
statement("count_col", "SELECT COUNT(o_orderstatus), COUNT(o_orderkey) FROM orders", "a b", "SELECT count(o_orderstatus) AS a, count(o_orderkey) AS b FROM orders")
statement("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) FROM lineitem GROUP BY l_returnflag", "l_returnflag n", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
statement("sum_int", "SELECT l_returnflag, l_linestatus, SUM(l_orderkey), COUNT(*) FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag l_linestatus s n", "SELECT l_returnflag, l_linestatus, sum(l_orderkey)::bigint AS s, count(*) AS n FROM lineitem GROUP BY 1, 2")
statement("sum_decimal", "SELECT l_returnflag, SUM(l_extendedprice), SUM(l_discount) FROM lineitem GROUP BY l_returnflag", "l_returnflag p d", f"SELECT l_returnflag, sum(l_extendedprice{D})::double AS p, sum(l_discount{D})::double AS d FROM lineitem GROUP BY 1")
statement("sum_distinct", "SELECT SUM(DISTINCT l_quantity), SUM(DISTINCT l_suppkey) FROM lineitem", "q s", f"SELECT sum(DISTINCT l_quantity{D})::double AS q, sum(DISTINCT l_suppkey)::bigint AS s FROM lineitem")
statement("min_max_types", "SELECT MIN(o_totalprice), MAX(o_totalprice), MIN(o_orderdate), MAX(o_orderpriority), MIN(o_custkey) FROM orders", "a b c d e", "SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_orderdate) AS c, max(o_orderpriority) AS d, min(o_custkey) AS e FROM orders")
HALF_EVEN = "((u // c) + CASE WHEN 2 * (u % c) > c OR (2 * (u % c) = c AND (u // c) % 2 = 1) THEN 1 ELSE 0 END)"
statement("avg_half_even", "SELECT l_suppkey, AVG(l_quantity), AVG(l_extendedprice) FROM lineitem GROUP BY l_suppkey", "l_suppkey q p", "WITH s AS (SELECT l_suppkey, sum((l_quantity::decimal(15,2) * 100)::bigint)::bigint AS u1, sum((l_extendedprice::decimal(15,2) * 100)::bigint)::bigint AS u2, count(*) AS c FROM lineitem GROUP BY 1) SELECT l_suppkey, (" + HALF_EVEN.replace("u ", "u1 ") + " / 100.0)::double AS q, (" + HALF_EVEN.replace("u ", "u2 ") + " / 100.0)::double AS p FROM s")
statement("avg_distinct", "SELECT AVG(DISTINCT l_discount) FROM lineitem", "d", "WITH s AS (SELECT sum(DISTINCT (l_discount::decimal(15,2) * 100)::bigint)::bigint AS u, count(DISTINCT l_discount) AS c FROM lineitem) SELECT (" + HALF_EVEN + " / 100.0)::double AS d FROM s")
statement("group_no_agg", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
statement("group_join", "SELECT n.n_name, COUNT(*), SUM(o.o_custkey) FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "n_name n s", "SELECT n_name, count(*) AS n, sum(o_custkey)::bigint AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
statement("group_after_exists", "SELECT c.c_mktsegment, COUNT(*), SUM(c.c_acctbal) FROM customer AS c WHERE EXISTS (SELECT o.o_orderkey FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) GROUP BY c.c_mktsegment", "c_mktsegment n s", f"SELECT c_mktsegment, count(*) AS n, sum(c_acctbal{D})::double AS s FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY 1")
statement("global_empty", "SELECT COUNT(*), SUM(o_custkey), MIN(o_orderkey) FROM orders WHERE o_orderkey = 0", "n s m", "SELECT count(*) AS n, sum(o_custkey)::bigint AS s, min(o_orderkey) AS m FROM orders WHERE o_orderkey = 0")
statement("grouped_empty", "SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_orderkey = 0 GROUP BY o_orderstatus", "o_orderstatus n", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey = 0 GROUP BY 1")
statement("order_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
statement("order_multi_stable", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_nationkey LIMIT 40 OFFSET 5", "c_custkey c_mktsegment", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey LIMIT 40 OFFSET 5")
statement("order_join_unprojected", "SELECT o.o_orderkey FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey ORDER BY c.c_acctbal DESC LIMIT 30", "o_orderkey", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_acctbal DESC, o_orderkey LIMIT 30")
statement("limit_offset", "SELECT o_orderkey FROM orders LIMIT 10 OFFSET 20", "o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
statement("page_without_key", "SELECT l_orderkey, l_partkey FROM lineitem LIMIT 50", "l_orderkey l_partkey", "SELECT l_orderkey, l_partkey FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 50)")


# ---- changes, checked by what the rows become
def copied(s: Session, name: str, columns: str, source: str, storage: str = "BTREE") -> None:
    """An EXPLICIT relation ``name`` filled from rows of a registered one, by the bulk path."""
    s.execute(f"CREATE TABLE {name} ({columns}) {storage} EXPLICIT")
    rel = s.catalog.find(name)
    df = s.sql(source).toDF(*(c.name for c in rel.columns))
    df = df.select(*(F.col(c.name).cast(c.kind.spark).alias(c.name) for c in rel.columns))
    s.change(rel, lambda own: s.insert_frame(rel, df, own))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 'big' ELSE c_mktsegment END AS seg FROM customer")
def dml_update(spark, sf_dir):
    s = session(spark, sf_dir)
    copied(s, "cust", "id int64, seg varchar", "SELECT c_custkey, c_mktsegment FROM customer")
    s.execute("UPDATE cust SET seg = 'big' WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
    return s.sql("SELECT id, seg FROM cust")


@query("SELECT c_custkey AS id, c_mktsegment AS seg FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def dml_delete(spark, sf_dir):
    s = session(spark, sf_dir)
    copied(s, "cust", "id int64, seg varchar", "SELECT c_custkey, c_mktsegment FROM customer")
    s.execute("DELETE FROM cust WHERE NOT EXISTS (SELECT orders.o_orderkey FROM orders WHERE orders.o_custkey = cust.id AND orders.o_totalprice > 450000)")
    return s.sql("SELECT id, seg FROM cust")


@query("SELECT * FROM (VALUES (1, 'a', 1.50::double), (2, 'b', NULL), (4, 'd', 0.25::double)) t(id, name, amount)")
def dml_insert_assigned(spark, sf_dir):
    s = Engine(spark).session()
    s.execute("CREATE TABLE t (id int64, name varchar, amount decimal(10,2) NULL)")
    s.execute("INSERT INTO t VALUES ('a', 1.50), ('b', NULL), ('c', '7')")
    s.execute("DELETE FROM t WHERE name = 'c'")
    s.execute("INSERT INTO t VALUES ('d', 0.25)")
    return plain(s.sql("SELECT * FROM t").withColumn("id", F.col("id").cast("int")))


def rated(s: Session) -> None:
    """Relation rated: the customers, with a NULL rating where the balance is under 1000."""
    s.execute("CREATE TABLE rated (id int64, rating int64 NULL, segment varchar) BTREE EXPLICIT")
    rel = s.catalog.find("rated")
    df = s.sql("SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer")
    df = df.select(F.col("c_custkey").cast("long").alias("id"), F.when(F.col("c_acctbal") >= 1000, F.col("c_nationkey").cast("long")).alias("rating"), F.col("c_mktsegment").alias("segment"))
    s.change(rel, lambda own: s.insert_frame(rel, df, own))


RATED = "(SELECT c_custkey AS id, CASE WHEN c_acctbal >= 1000 THEN c_nationkey END AS rating, c_mktsegment AS segment FROM customer)"


@query(f"SELECT id FROM {RATED} WHERE rating IS NULL AND segment IS NOT NULL")
def filter_is_null(spark, sf_dir):
    s = session(spark, sf_dir)
    rated(s)
    return s.sql("SELECT id FROM rated WHERE rating IS NULL AND segment IS NOT NULL")


@query(f"SELECT rating, count(*) AS n, count(rating) AS m FROM {RATED} GROUP BY 1")
def group_null(spark, sf_dir):
    """NULLs are one group; COUNT of a column leaves them out."""
    s = session(spark, sf_dir)
    rated(s)
    return s.sql("SELECT rating, COUNT(*), COUNT(rating) FROM rated GROUP BY rating").toDF("rating", "n", "m")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT rating FROM {RATED} WHERE segment = 'BUILDING')")
def not_in_nulls(spark, sf_dir):
    s = session(spark, sf_dir)
    rated(s)
    return s.sql("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT rating FROM rated WHERE segment = 'BUILDING')")


@query("SELECT sum(c_acctbal::decimal(38,2))::double AS s, (sum((c_acctbal * 100)::decimal(18,0)::bigint) // count(*))::bigint AS low FROM customer")
def wide_fold(spark, sf_dir):
    """SUM and AVG of decimals of 38 digits; the average is shown cut to whole cents."""
    s = session(spark, sf_dir)
    copied(s, "wide", "id int64, v decimal(38,2)", "SELECT c_custkey, c_acctbal FROM customer")
    out = s.sql("SELECT SUM(v), AVG(v) FROM wide").toDF("s", "a")
    exact = s.sql("SELECT SUM(v), COUNT(*) FROM wide").toDF("t", "n")
    low = F.floor(F.col("t") * 100 / F.col("n")).cast("long")
    near = (F.abs(F.col("a") * 100 - F.col("t") * 100 / F.col("n")) <= 0.5)
    return plain(out.crossJoin(exact).where(near).select("s", low.alias("low")))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END AS seg FROM customer WHERE c_nationkey <> 5")
def txn_commit(spark, sf_dir):
    """A transaction's update and delete are seen by others once it commits; one that rolls back leaves nothing."""
    s = session(spark, sf_dir)
    copied(s, "cust", "id int64, nation int64, seg varchar", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
    other = s.engine.session()
    for statement_, end in (("UPDATE cust SET seg = 'moved' WHERE nation = 3", "COMMIT"), ("DELETE FROM cust WHERE nation = 5", "COMMIT"), ("DELETE FROM cust WHERE nation = 7", "ROLLBACK")):
        for x in ("BEGIN", statement_, end):
            s.execute(x)
    return other.sql("SELECT id, seg FROM cust")


@query("SELECT c_custkey AS id, c_nationkey AS place FROM customer")
def txn_snapshot(spark, sf_dir):
    """A REPEATABLE READ transaction keeps its rows while others delete some and rename a column."""
    s = session(spark, sf_dir)
    copied(s, "cust", "id int64, nation int64", "SELECT c_custkey, c_nationkey FROM customer")
    other = s.engine.session()
    other.execute("SET ISOLATION LEVEL REPEATABLE READ")
    other.execute("BEGIN")
    other.sql("SELECT COUNT(*) FROM cust").collect()
    s.execute("DELETE FROM cust WHERE nation < 20")
    s.execute("ALTER TABLE cust RENAME COLUMN nation TO place")
    return other.sql("SELECT id, place FROM cust")


@query("SELECT c_custkey AS id, c_nationkey AS place FROM customer WHERE c_nationkey >= 20")
def rename_column(spark, sf_dir):
    s = session(spark, sf_dir)
    copied(s, "cust", "id int64, nation int64", "SELECT c_custkey, c_nationkey FROM customer")
    s.execute("ALTER TABLE cust RENAME COLUMN nation TO place")
    s.execute("ALTER TABLE cust RENAME TO client")
    s.execute("DELETE FROM client WHERE place < 20")
    return s.sql("SELECT id, place FROM client")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.5 AND o_orderpriority <> '$x'")
def pattern_bound(spark, sf_dir):
    """Parameters are bound by name as whole tokens: $x isn't the begin of $x2, and text in quotes is none."""
    s = session(spark, sf_dir)
    s.execute("CREATE PATTERN by_customer ($x int64, $x2 decimal(15,2)) OF SELECT o_orderkey FROM orders WHERE o_custkey = $x AND o_totalprice > $x2 AND o_orderpriority != '$x'")
    return s.pattern("by_customer", x2="1000.50", x=7)


@query("SELECT o_orderkey AS id, o_custkey AS parent FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def foreign_key(spark, sf_dir):
    """Rows whose parent exists go in, in one statement; a statement with an orphan adds none."""
    from .errors import FkViolation

    s = session(spark, sf_dir)
    copied(s, "parent", "id int64, nation int64", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 12")
    s.execute("CREATE TABLE child (id int64, parent int64 REFERENCES parent) BTREE EXPLICIT")
    rel, orders = s.catalog.find("child"), s.sql("SELECT o_orderkey, o_custkey FROM orders").toDF("id", "parent")
    for rows in (orders, orders.join(s.sql("SELECT id FROM parent").toDF("parent"), "parent", "left_semi").select("id", "parent")):
        try:
            s.change(rel, lambda own, rows=rows: s.insert_frame(rel, rows, own))
        except FkViolation:
            pass
    return s.sql("SELECT id, parent FROM child")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_lookup(spark, sf_dir):
    """An index changes what ANALYZE says, never the rows."""
    s = session(spark, sf_dir)
    copied(s, "cust", "id int64, seg varchar", "SELECT c_custkey, c_mktsegment FROM customer")
    s.execute("CREATE INDEX by_seg ON cust(seg)")
    if "IndexProbe cust by_seg" not in s.reply("ANALYZE SELECT id FROM cust WHERE seg = 'BUILDING'"):
        raise AssertionError("the index isn't looked at")
    return s.sql("SELECT id FROM cust WHERE seg = 'BUILDING'")


@query("SELECT count(*) AS rows FROM orders WHERE o_custkey < 100")
def analyze_rows(spark, sf_dir):
    """The row count that ANALYZE reports."""
    report = reader(spark, sf_dir).reply("ANALYZE SELECT o_orderkey FROM orders WHERE o_custkey < 100")
    return spark.createDataFrame([(int(report.split("rows=")[1].split()[0]),)], "rows long")


@query("SELECT o_orderkey AS id, o_custkey AS v FROM orders WHERE o_orderkey BETWEEN 1 AND 60")
def load_chunks(spark, sf_dir):
    """A sequenced load; a chunk sent again counts once."""
    from .streaming.load import Load

    s = session(spark, sf_dir)
    rows = [list(r) for r in s.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1 AND 60").collect()]
    s.execute("CREATE TABLE t (id int64, v int64) BTREE EXPLICIT")
    load = Load(s, "t")
    for n in (1, 1, 2, 3):
        load.chunk(n, rows[n - 1 :: 3])
    load.end()
    return s.sql("SELECT id, v FROM t")


@query("SELECT o_orderkey AS id, o_custkey AS parent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def fk_orphans(spark, sf_dir):
    return session(spark, sf_dir).sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)").toDF("id", "parent")


@query("SELECT o_custkey AS grp, count(*) AS value FROM orders GROUP BY 1 HAVING count(*) > 15")
def assertion_violations(spark, sf_dir):
    from .sources.catalog import Assertion

    s = session(spark, sf_dir)
    return s.violations(Assertion("most", "orders", ["o_custkey"], None, 15), s.seen("orders")).toDF("grp", "value")


@query("SELECT table_name AS name, n AS columns FROM (VALUES ('region', 2), ('nation', 3), ('customer', 5), ('supplier', 4), ('part', 6), ('orders', 6), ('lineitem', 11), ('events', 6)) t(table_name, n)")
def catalog_tables(spark, sf_dir):
    return session(spark, sf_dir).sql("SELECT name, columns FROM sys.tables")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(power(2, -(epoch(TIMESTAMP '2030-01-01') - epoch(ts)) / 31536000.0)), 6) AS score FROM events GROUP BY 1, 2")
def decay_score(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    age = F.lit(1893456000.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(decayed(F.lit(1.0), age, 31536000.0)), 6).alias("score"))


@query("SELECT event_id, CASE WHEN age // 1000 >= 32 THEN 0 ELSE ((1000000 // (2 ** (age // 1000))::bigint) * [256,245,235,225,215,206,197,189,181,173,166,159,152,146,140,134][((age % 1000) * 16 // 1000 + 1)::bigint]) // 256 END AS score FROM (SELECT event_id, event_id % 40000 AS age FROM events)")
def decay_steps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", decayed_steps(F.lit(1_000_000).cast("bigint"), F.col("event_id") % 40000, 1000).alias("score"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def fingerprint_log(spark, sf_dir):
    """A log of statements grouped by pattern: one for each event type, whatever the literals."""
    @F.pandas_udf("string")
    def pattern(text: pd.Series) -> pd.Series:
        return text.map(lambda t: f"{fingerprint(t).pattern_id:016x}")

    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.format_string("select user_id from %s where event_id = %d and value < '%s'", F.col("event_type"), "event_id", F.col("value").cast("string")).alias("sql"))
    return log.groupBy(pattern("sql").alias("pattern"), "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern").agg(F.first("event_type").alias("event_type"), F.sum("n").alias("n")).select("event_type", "n")
