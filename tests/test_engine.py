"""The dialect over small fixtures: rows, refusals with positions, constraints, transactions."""

import datetime as dt
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle import errors as E
from brindle.functions.decay import SCALE, Score
from brindle.functions.types import Kind, coerce
from brindle.plans import observe as O
from brindle.plans.fingerprint import fingerprint
from brindle.plans.parser import parse
from brindle.session import Engine, Options
from brindle.sources.store import Pending


@pytest.fixture(scope="module")
def s(spark):
    """Ferries, their crossings (one ferry has none), and numbers with a NULL."""
    out = Engine(spark).session()
    out.execute("CREATE TABLE ferry (id int64, label varchar, hull varchar, harbour varchar) BTREE")
    out.execute("CREATE TABLE crossing (id int64, ferry_id int64, load varchar, harbour varchar)")
    out.execute("INSERT INTO ferry VALUES ('heron','steel','north'), ('teal','wood','south'), ('swift','steel','south'), ('gull','steel','north'), ('wren','wood','east')")
    out.execute("INSERT INTO crossing VALUES (1,'cars','north'), (1,'mail','north'), (1,'grain','south'), (2,'cars','south'), (3,'timber','south'), (4,'mail','east')")
    out.execute("CREATE TABLE n (id int64, v int64 NULL)")
    out.execute("INSERT INTO n VALUES (1), (NULL), (3)")
    return out


def rows(s, q):
    return sorted(tuple(r) for r in s.execute(q).df.collect())


OF = "SELECT k.id FROM crossing AS k WHERE k.ferry_id = ferry.id"


@pytest.mark.parametrize(
    "q, want",
    [
        # joins: either way round, over a column that is no key, chained, with itself
        ("SELECT f.label, k.load FROM ferry AS f JOIN crossing AS k ON f.id = k.ferry_id WHERE k.load = 'mail'", [("gull", "mail"), ("heron", "mail")]),
        ("SELECT k.load FROM crossing AS k JOIN ferry AS f ON k.ferry_id = f.id WHERE f.hull = 'wood'", [("cars",)]),
        ("SELECT f.id, k.id FROM ferry AS f JOIN crossing AS k ON k.harbour = f.harbour WHERE f.hull = 'wood'", [(2, 3), (2, 4), (2, 5), (5, 6)]),
        ("SELECT g.label FROM crossing AS k JOIN ferry AS f ON f.id = k.ferry_id JOIN ferry AS g ON g.harbour = k.harbour WHERE f.label = 'gull'", [("wren",)]),
        ("SELECT f.label, g.label FROM ferry AS f JOIN ferry AS g ON f.hull = g.hull WHERE f.id < g.id AND f.harbour != g.harbour", [("heron", "swift"), ("swift", "gull"), ("teal", "wren")]),
        # EXISTS with and without a link, over an empty set
        (f"SELECT label FROM ferry WHERE EXISTS ({OF} AND k.load = 'cars')", [("heron",), ("teal",)]),
        (f"SELECT label FROM ferry WHERE NOT EXISTS ({OF})", [("wren",)]),
        ("SELECT id FROM n WHERE EXISTS (SELECT id FROM crossing WHERE load = 'coal')", []),
        ("SELECT id FROM n WHERE NOT EXISTS (SELECT id FROM crossing WHERE load = 'coal')", [(1,), (2,), (3,)]),
        # IN and NOT IN: NULL on either side, an empty set
        ("SELECT label FROM ferry WHERE id IN (SELECT v FROM n)", [("heron",), ("swift",)]),
        ("SELECT label FROM ferry WHERE id NOT IN (SELECT v FROM n WHERE v IS NOT NULL)", [("gull",), ("teal",), ("wren",)]),
        ("SELECT label FROM ferry WHERE id NOT IN (SELECT v FROM n)", []),
        ("SELECT id FROM n WHERE v NOT IN (SELECT ferry_id FROM crossing WHERE load = 'timber')", [(1,)]),
        ("SELECT id FROM n WHERE v NOT IN (SELECT ferry_id FROM crossing WHERE load = 'coal')", [(1,), (2,), (3,)]),
        # one value, or none, which no comparison holds for
        ("SELECT load FROM crossing WHERE ferry_id = (SELECT id FROM ferry WHERE label = 'heron')", [("cars",), ("grain",), ("mail",)]),
        ("SELECT load FROM crossing WHERE ferry_id != (SELECT id FROM ferry WHERE label = 'crane')", []),
        ("SELECT f.label FROM ferry AS f WHERE f.harbour = (SELECT k.harbour FROM crossing AS k WHERE k.ferry_id = f.id AND k.load = 'timber')", [("swift",)]),
        # NULL is no value, and kinds that can't be compared are unequal
        ("SELECT id FROM n WHERE v = NULL", []),
        ("SELECT id FROM n WHERE v != NULL", []),
        ("SELECT label FROM ferry WHERE hull = 3", []),
        ("SELECT id FROM n WHERE v IS NULL", [(2,)]),
        ("SELECT v FROM n WHERE v IS NOT NULL AND v BETWEEN 2 AND 9", [(3,)]),
        # two levels: linked with the outermost relation, and not at all
        ("SELECT f.label FROM ferry AS f WHERE EXISTS (SELECT k.id FROM crossing AS k WHERE k.ferry_id = f.id AND EXISTS (SELECT o.id FROM crossing AS o WHERE o.harbour = f.harbour AND o.ferry_id != k.ferry_id))", [("gull",), ("swift",), ("teal",)]),
        ("SELECT label FROM ferry WHERE id IN (SELECT ferry_id FROM crossing WHERE EXISTS (SELECT id FROM n WHERE v = 3))", [("gull",), ("heron",), ("swift",), ("teal",)]),
        # pages
        ("SELECT id FROM crossing LIMIT 2 OFFSET 4", [(5,), (6,)]),
        ("SELECT id FROM crossing LIMIT 0", []),
        ("SELECT id FROM crossing LIMIT 3000000000 OFFSET 4", [(5,), (6,)]),
        ("SELECT id FROM crossing OFFSET 18446744073709551615", []),
        ("SELECT id FROM crossing ORDER BY id DESC LIMIT 18446744073709551615", [(1,), (2,), (3,), (4,), (5,), (6,)]),
    ],
)
def test_rows(s, q, want):
    assert rows(s, q) == want


def test_large_pages_keep_the_order(s):
    assert [r[0] for r in s.execute("SELECT id FROM crossing ORDER BY load, id DESC LIMIT 4000000000 OFFSET 1").df.collect()] == [1, 3, 6, 2, 5]


@pytest.mark.parametrize(
    "q, error, text",
    [
        ("SELECT harbour FROM ferry JOIN crossing ON ferry.id = crossing.ferry_id", E.InvalidArgument, "ambiguous"),
        ("SELECT k.id FROM crossing AS k RIGHT JOIN ferry AS f ON f.id = k.ferry_id", E.Unsupported, "outer joins are not supported (byte 31)"),
        ("SELECT n.id FROM n JOIN n ON n.id = n.v", E.InvalidArgument, "named twice"),
        ("SELECT * FROM crossing AS k JOIN ferry AS f ON f.id = k.ferry_id", E.Unsupported, "ambiguous across 2 relations"),
        ("SELECT v FROM (SELECT v FROM n)", E.Unsupported, "cannot appear in FROM"),
        ("SELECT id FROM n WHERE v IN (SELECT id, v FROM n)", E.Unsupported, "exactly one column"),
        ("SELECT id FROM n WHERE v IN (3)", E.Unsupported, "expected a subquery"),
        ("WITH w AS (SELECT v FROM n) SELECT v FROM w", E.Unsupported, "common table expressions"),
        ("SELECT id FROM n WHERE NOT v = 3", E.Unsupported, "NOT is supported only"),
        ("SELECT id FROM n WHERE v = 3 OR v IS NULL", E.Unsupported, "OR is not supported"),
        ("SELECT id FROM n WHERE v = (SELECT MAX(v) FROM n)", E.Unsupported, "aggregate in a subquery"),
        ("SELECT id FROM n WHERE v < (SELECT ferry_id FROM crossing)", None, "more than one row"),
        ("SELECT f.id FROM ferry AS f WHERE f.id = (SELECT k.ferry_id FROM crossing AS k WHERE k.harbour = f.harbour)", None, "more than one row"),
        ("SELECT AVG(v) FROM n", E.Unsupported, "AVG takes decimals"),
        ("SELECT hull, MIN(label) FROM ferry", E.InvalidArgument, "must appear in GROUP BY"),
        ("SELECT hull, COUNT(*) FROM ferry GROUP BY hull ORDER BY hull", E.Unsupported, "over aggregated output"),
        ("SELECT load FROM crossing GROUP BY load HAVING load = 'mail'", E.Unsupported, "HAVING"),
        ("SELECT COUNT(DISTINCT *) FROM n", E.Unsupported, "COUNT(DISTINCT *)"),
        ("SELECT v FROM n OFFSET 1 LIMIT 1", E.InvalidArgument, "unexpected token 'LIMIT' after end of statement"),
        ("SELECT v FROM barge", E.NotFound, "barge"),
        ("SELECT keel FROM ferry", E.InvalidArgument, "unknown column 'keel' (byte 7)"),
        ("SELECT v FROM n WHERE id > ?", E.Unsupported, "bind parameters"),
        ("SELECT v FROM n WHERE id <> 2", E.InvalidArgument, "literal"),
        ("FETCH v", E.InvalidArgument, "unknown SQL keyword 'FETCH'"),
        ("SHOW PAGE 7", E.Unsupported, "no pages"),
    ],
)
def test_refused(s, q, error, text):
    if error is None:
        with pytest.raises(E.CardinalityViolation, match="more than one row"):
            from brindle.session import translated

            with translated():
                s.execute(q).df.collect()
        return
    with pytest.raises(error) as e:
        s.execute(q)
    assert text in str(e.value)


def test_nesting_cap(s):
    q = "SELECT v FROM n"
    for _ in range(5):
        q = f"SELECT v FROM n WHERE id IN ({q})"
    with pytest.raises(E.Unsupported, match="nesting deeper than 4"):
        s.execute(q)


def test_reply_and_order(s):
    assert s.reply("SELECT v, id FROM n ORDER BY v") == "v,id\n1,1\n3,3\nNULL,2"
    assert s.reply("SELECT v, id FROM n ORDER BY v DESC").split("\n")[1] == "NULL,2"
    assert s.reply("SELECT COUNT(*), COUNT(v), SUM(v), MIN(v) FROM n") == "count(*),count(v),sum(v),min(v)\n3,2,4,1"
    assert s.reply("PING") == "PONG"
    assert s.reply("SELECT id FROM nope").startswith("ERR unknown relation 'nope'")


def test_sum_overflow(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE big (id int64, v int64)")
    s.execute(f"INSERT INTO big VALUES ({2**63 - 1}), (1)")
    assert "out of range" in s.reply("SELECT SUM(v) FROM big")


def test_averages(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE d (id int64, v decimal(10,2) NULL, w decimal(30,2) NULL)")
    s.execute("INSERT INTO d VALUES (0.01, 0.01), (0.02, 0.02), (NULL, NULL)")  # 0.015 -> 0.02
    s.execute("INSERT INTO d VALUES (0.05, 0.05), (0.02, 0.02)")  # 0.10 / 4 = 0.025 -> 0.02
    assert s.execute("SELECT AVG(v), AVG(w) FROM d").df.first()[:] == (Decimal("0.02"), Decimal("0.02"))
    assert s.execute("SELECT AVG(v) FROM d WHERE id < 3").df.first()[0] == Decimal("0.02")
    s.execute("CREATE TABLE m (id int64, v decimal(10,2))")
    s.execute("INSERT INTO m VALUES (-0.01), (-0.04)")
    assert s.execute("SELECT AVG(v), AVG(DISTINCT v) FROM m").df.first()[:] == (Decimal("-0.02"), Decimal("-0.02"))
    assert s.execute("SELECT AVG(v), COUNT(*) FROM d WHERE id = 99").df.first()[:] == (None, 0)


def test_group_cap(spark):
    s = Engine(spark, options=Options(max_groups=2)).session()
    s.execute("CREATE TABLE g (id int64, v int64)")
    s.execute("INSERT INTO g VALUES (1), (2), (3)")
    with pytest.raises(E.ResourceExhausted):
        s.execute("SELECT v, COUNT(*) FROM g GROUP BY v")


def test_limits_refuse(spark):
    s = Engine(spark, options=Options(sort_max_rows=3, max_distinct=2, max_touched=9)).session()
    s.execute("CREATE TABLE g (id int64, v int64)")
    s.execute("INSERT INTO g VALUES (1), (2), (3), (3)")
    with pytest.raises(E.ResourceExhausted, match="sort 4 rows"):
        s.execute("SELECT v FROM g ORDER BY v")
    assert rows(s, "SELECT v FROM g WHERE v < 3 ORDER BY v") == [(1,), (2,)]
    with pytest.raises(E.ResourceExhausted, match="3 entries"):
        s.execute("SELECT COUNT(DISTINCT v) FROM g")
    assert rows(s, "SELECT COUNT(DISTINCT v) FROM g WHERE v > 1") == [(2,)]
    with pytest.raises(E.ResourceExhausted, match="looks at 12 rows"):
        s.execute("SELECT v FROM g WHERE v IN (SELECT v FROM g WHERE EXISTS (SELECT id FROM g))")
    # a lookup by key looks at one row
    assert rows(s, "SELECT v FROM g WHERE v IN (SELECT v FROM g WHERE EXISTS (SELECT id FROM g WHERE id = 1))") == [(1,), (2,), (3,), (3,)]


def test_reports_count_what_is_there(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE g (id int64, v int64)")
    for n in range(3):
        s.execute(f"INSERT INTO g VALUES ({n}), (9)")
    assert s.execute("SHOW RELAYOUT").df.first()["blocked"] == "never walked"
    report = s.reply("ANALYZE SELECT id FROM g WHERE v = 9")
    assert report.startswith("rows=3 ") and "examined=6" in report
    assert "examined=1" in s.reply("ANALYZE SELECT v FROM g WHERE id = 2")
    s.execute("SELECT id FROM g WHERE v = 9")
    r = s.execute("SHOW RELAYOUT").df.first()
    assert r["files"] == len(s.store.sizes(p.path for p in s.catalog.find("g").versions[-1])) > r["files_after"] == 1 and r["benefit"] > 0 and r["blocked"] is None


def test_bounds_on_doubles_reach_the_files(spark, tmp_path):
    spark.createDataFrame([(i, i / 100) for i in range(1000)], "id long, v double").write.parquet(str(tmp_path / "d.parquet"))
    engine = Engine(spark)
    engine.catalog.parquet(str(tmp_path), "d")
    s = engine.session()
    df = s.execute("SELECT id FROM d WHERE v > 1.23 AND v <= 1.26").df
    assert sorted(r[0] for r in df.collect()) == [124, 125, 126]
    pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(v" in pushed and "LessThanOrEqual(v" in pushed


def test_literals():
    d = Kind("decimal", 6, 2)
    assert coerce("12.34", True, d) == Decimal("12.34")
    for bad, error in (("12.345", E.InvalidArgument), ("123456.00", E.OutOfRange), ("x", E.InvalidArgument)):
        with pytest.raises(error):
            coerce(bad, True, d)
    assert coerce("2024-02-29", True, Kind("date")) == dt.date(2024, 2, 29)
    with pytest.raises(E.InvalidArgument):
        coerce("2023-02-29", True, Kind("date"))
    with pytest.raises(E.OutOfRange):
        coerce("1899-12-31", True, Kind("date"))
    assert coerce("2024-01-02 03:04:05.6", True, Kind("timestamp")) == dt.datetime(2024, 1, 2, 3, 4, 5, 600000)
    with pytest.raises(E.OutOfRange):
        coerce(1 << 63, False, Kind("int64"))
    assert coerce((1 << 64) - 1, False, Kind("uint64")) == Decimal((1 << 64) - 1)


def test_decimal_scales_differ(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE p (id int64, a decimal(10,2), b decimal(10,3))")
    with pytest.raises(E.Unsupported, match="differ in scale"):
        s.execute("SELECT id FROM p WHERE a = b")


def test_definitions(spark):
    s = Engine(spark).session()
    assert s.reply("CREATE TABLE t (id int64, v varchar CABIN, w varchar NO CABIN) BTREE").startswith("CREATED")
    assert s.reply("CREATE TABLE t (id int64)").startswith("EXISTS oid=")
    for bad in ("CREATE TABLE x (id varchar)", "CREATE TABLE x (id int64 NULL)", "CREATE TABLE x (id int64) EXPLICIT", "CREATE TABLE x (id int64, d decimal)", "CREATE TABLE x (id int64, f float)", "CREATE TABLE x (id int64) HEAP BTREE", "CREATE CABIN ON t(w)", "CREATE CABIN ON t(id)", "CREATE INDEX i ON t(id)", "CREATE UNIQUE INDEX i ON t(v)", "CREATE TABLE x (id int64, r int64 REFERENCES nope)"):
        assert s.reply(bad).startswith("ERR"), bad
    assert s.reply("CREATE INDEX i ON t(v) COVERING (w)") == "CREATED INDEX i"
    assert "IndexProbe t i" in s.reply("ANALYZE SELECT id FROM t WHERE v = 'a'")
    assert "Lookup t id" in s.reply("ANALYZE SELECT id FROM t WHERE id = 1")
    assert s.reply("ALTER TABLE t RENAME COLUMN v TO vv") == "RENAMED vv"
    assert s.reply("ALTER TABLE t RENAME TO u") == "RENAMED u"
    assert "vv,varchar" in s.reply("DESCRIBE u")
    assert s.reply("DROP TABLE u") == "DROPPED u"
    assert s.reply("SHOW TABLES").count("\n") == 0
    assert s.reply("SELECT name FROM sys.types WHERE name = 'bool'") == "name\nbool"


def test_keys_and_references(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE p (id int64, v int64) BTREE EXPLICIT")
    s.execute("CREATE TABLE c (id int64, pid int64 NULL REFERENCES p)")
    s.execute("INSERT INTO p VALUES (5, 1), (3, 2)")
    assert "duplicate primary key 5" in s.reply("INSERT INTO p VALUES (5, 1)")
    assert "duplicate" in s.reply("INSERT INTO p VALUES (7, 1), (7, 1)")
    assert "reserved" in s.reply("INSERT INTO p VALUES (0, 1)")
    assert s.reply("INSERT INTO c VALUES (9)").startswith("ERR FK_VIOLATION retryable=0")
    assert s.reply("INSERT INTO c VALUES (5), (NULL)") == "INSERTED 2"
    assert s.reply("DELETE FROM p WHERE id = 5").startswith("ERR FK_VIOLATION")
    assert s.reply("DELETE FROM p WHERE id = 3") == "DELETED 1"
    assert "duplicate" in s.reply("INSERT INTO p VALUES (3, 9)")  # a deleted key stays used
    assert "the engine assigns" in s.reply("INSERT INTO c VALUES (1, 5)")
    assert "come with the row" in s.reply("INSERT INTO p VALUES (5)")
    assert "cannot be updated" in s.reply("UPDATE p SET id = 4")
    assert s.reply("DROP TABLE p").startswith("ERR")
    assert s.reply("UPDATE c SET pid = 8 WHERE pid = 5").startswith("ERR FK_VIOLATION")
    assert rows(s, "SELECT pid FROM c WHERE pid = 5") == [(5,)]


def test_assertions(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE b (id int64, who int64, amount int64)")
    s.execute("INSERT INTO b VALUES (1, 600), (1, 300), (2, 10)")
    assert s.reply("CREATE ASSERTION low ON b GROUP BY (who) CHECK SUM(amount) < 900").startswith("ERR ASSERTION_VIOLATION")
    s.execute("CREATE ASSERTION spend ON b GROUP BY (who) CHECK SUM(amount) <= 1000")
    s.execute("CREATE ASSERTION few ON b GROUP BY (who) CHECK COUNT(*) < 4")
    assert "bound 1000" in s.reply("INSERT INTO b VALUES (1, 101)")
    assert s.reply("INSERT INTO b VALUES (1, 100)") == "INSERTED 1"
    assert "bound 3" in s.reply("INSERT INTO b VALUES (1, 0)")
    assert s.reply("UPDATE b SET amount = 500 WHERE id = 1") == "UPDATED 1"
    assert s.reply("UPDATE b SET who = 1 WHERE id = 3").startswith("ERR ASSERTION_VIOLATION")
    assert s.reply("DELETE FROM b WHERE who = 1").startswith("DELETED 3")
    assert s.reply("DROP TABLE b").startswith("ERR")


def test_transactions(spark):
    engine = Engine(spark)
    a, b = engine.session(), engine.session()
    a.execute("CREATE TABLE t (id int64, v int64)")
    a.execute("INSERT INTO t VALUES (1), (2)")
    b.execute("SET ISOLATION LEVEL REPEATABLE READ")
    b.execute("BEGIN")
    a.execute("BEGIN")
    a.execute("UPDATE t SET v = 10 WHERE id = 1")
    assert rows(a, "SELECT v FROM t") == [(2,), (10,)] and rows(b, "SELECT v FROM t") == [(1,), (2,)]
    assert b.reply("UPDATE t SET v = 11 WHERE id = 1").startswith("ERR TXN_CONFLICT retryable=1")
    assert "only ROLLBACK" in b.reply("SELECT v FROM t")
    assert b.reply("ROLLBACK") == "ROLLBACK"
    b.execute("BEGIN")
    a.execute("COMMIT")
    assert rows(b, "SELECT v FROM t") == [(1,), (2,)]
    assert b.reply("UPDATE t SET v = 11 WHERE id = 1").startswith("ERR TXN_CONFLICT")
    b.execute("ROLLBACK")
    assert rows(b, "SELECT v FROM t") == [(2,), (10,)]
    b.execute("BEGIN")
    b.execute("INSERT INTO t VALUES (5)")
    b.execute("DELETE FROM t WHERE v = 5")
    b.execute("DELETE FROM t WHERE v = 2")
    b.execute("ROLLBACK")
    assert rows(a, "SELECT v FROM t") == [(2,), (10,)]
    assert "no transaction is open" in a.reply("COMMIT")


def test_key_of_two_transactions(spark):
    """A key that an open transaction adds can't be added by another; when it is gone again, it can."""
    engine = Engine(spark)
    a, b = engine.session(), engine.session()
    a.execute("CREATE TABLE t (id int64, v int64) BTREE EXPLICIT")
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (5, 1)")
    assert b.reply("INSERT INTO t VALUES (5, 2)").startswith("ERR TXN_CONFLICT retryable=1")
    b.execute("ROLLBACK")
    a.execute("ROLLBACK")
    assert b.reply("INSERT INTO t VALUES (5, 2)") == "INSERTED 1" and rows(a, "SELECT id, v FROM t") == [(5, 2)]
    # a commit looks again
    own = {"t": Pending(0, added=[a.store.write(spark.createDataFrame([(5, 3)], a.catalog.find("t").schema), a.catalog.find("t"))])}
    with pytest.raises(E.TxnConflict):
        a.store.commit({"t": a.catalog.find("t")}, own)


def test_rename_under_a_snapshot(spark):
    engine = Engine(spark)
    a, b = engine.session(), engine.session()
    a.execute("CREATE TABLE t (id int64, v int64)")
    a.execute("INSERT INTO t VALUES (10), (20)")
    b.execute("SET ISOLATION LEVEL REPEATABLE READ")
    b.execute("BEGIN")
    assert rows(b, "SELECT v FROM t") == [(10,), (20,)]
    a.execute("DELETE FROM t WHERE v = 20")
    a.execute("ALTER TABLE t RENAME COLUMN v TO w")
    a.execute("ALTER TABLE t RENAME COLUMN id TO v")  # a name that the files use for another column
    a.execute("INSERT INTO t VALUES (30)")
    assert rows(b, "SELECT v, w FROM t") == [(1, 10), (2, 20)]
    b.execute("ROLLBACK")
    assert rows(b, "SELECT v, w FROM t") == [(1, 10), (3, 30)]
    a.execute("UPDATE t SET w = 31 WHERE v = 3")
    assert rows(a, "SELECT w FROM t") == [(10,), (31,)]


def test_registered_values_are_exact(spark):
    engine = Engine(spark)
    df = spark.createDataFrame([(1, 1.25), (2, None), (3, 1.239)], "id long, v double")
    engine.catalog.register("two", df)
    engine.catalog.register("three", df, scale=3)
    s = engine.session()
    assert rows(s, "SELECT id FROM two") == [(1,), (2,), (3,)]
    with pytest.raises(Exception, match="more than 2 digits"):
        s.execute("SELECT SUM(v) FROM two").df.collect()
    assert rows(s, "SELECT SUM(v) FROM three") == [(Decimal("2.489"),)]
    with pytest.raises(E.Unsupported):
        engine.catalog.register("other", df.selectExpr("id", "array(v) AS a"))


def test_wide_averages_of_any_size(spark):
    s = Engine(spark).session()
    s.execute("CREATE TABLE w (id int64, a decimal(38,2), b decimal(38,30))")
    s.execute(f"INSERT INTO w VALUES ({'9' * 30}.01, 0.{'0' * 29}1), ({'9' * 30}.02, 0.{'0' * 29}2), ({'9' * 30}.02, 0.{'0' * 29}2)")
    assert s.execute("SELECT AVG(a), AVG(b) FROM w").df.first()[:] == (Decimal("9" * 30 + ".02"), Decimal("2e-30"))


def test_patterns(s):
    assert "CREATED PATTERN" in s.reply("CREATE PATTERN by_id ($x int64) WITH (pinned = on) OF SELECT label FROM ferry WHERE id = $x")
    assert [r[0] for r in s.pattern("by_id", x=2).collect()] == ["teal"]
    assert fingerprint("select LABEL from FERRY where ID = 42 ;").pattern_id == s.catalog.patterns["by_id"]["id"]
    assert s.reply("CREATE PATTERN p2 ($x int64) OF SELECT label FROM ferry WHERE id = 1").startswith("ERR")
    assert s.reply("CREATE PATTERN p2 ($x varchar) OF SELECT label FROM ferry WHERE id = $x").startswith("ERR")
    assert s.reply("CREATE PATTERN p2 ($y int64) OF SELECT label FROM ferry WHERE id = $x").startswith("ERR")
    s.execute("CREATE PATTERN both ($x int64, $x2 varchar) OF SELECT label FROM ferry WHERE id < $x AND hull = $x2 AND label != '$x'")
    assert sorted(r[0] for r in s.pattern("both", x2="steel", x=4).collect()) == ["heron", "swift"]
    for bad in ({"x": "4", "x2": "steel"}, {"x": 4}, {"x": 4, "x2": "steel", "z": 1}):
        with pytest.raises(E.InvalidArgument):
            s.pattern("both", **bad)
    assert s.reply("DROP PATTERN by_id") == "DROPPED PATTERN by_id"


def test_fingerprints():
    f = lambda q: fingerprint(q).pattern_id
    assert f("SELECT a FROM t WHERE id = 1") == f("select A from T where ID = ?;") == f("SELECT a FROM t WHERE id = '1'")
    assert f("SELECT a FROM t WHERE id = 1") != f("SELECT a FROM u WHERE id = 1")
    assert f("SELECT a FROM t WHERE id = NULL") != f("SELECT a FROM t WHERE id = 1")
    assert f("INSERT INTO t VALUES (1, 2)") == f("INSERT INTO t VALUES (1, 2), (3, 4), (5, 6)")
    one, two = fingerprint("SELECT a FROM t WHERE id = 1"), fingerprint("SELECT a FROM t WHERE id = '1'")
    assert one.arg_hash != two.arg_hash and fingerprint("SELECT a FROM t WHERE id = ?").param_count == 1
    assert fingerprint("CREATE TABLE t (id int64)") is None


def test_decay():
    x = Score()
    x.touch(0, 100)
    assert x.read(100, 100) == SCALE // 2 and x.read(3200, 100) == 0 and x.read(-5, 100) == SCALE
    x.touch(100, 100)
    assert x.scaled == SCALE + SCALE // 2
    for _ in range(3):
        x.touch(100, 0, 1 << 24)
    assert x.scaled == (1 << 32) - 1


def test_optimizer_life():
    p = O.Policy(amortised=O.ONE, cooldown=2, half_life=10)
    o = O.StructureOptimizer(p)
    hot = [O.Shape(1, 1, 256 * 10, 256 * 10 * 40)]
    assert [o.decide(hot, [], t) for t in (0, 1)] == [[], []]
    (made,) = o.decide(hot, [], 2)
    assert (made.what, made.reason) == ("CREATE", "sustained-benefit") and o.decide(hot, [], 3) == []
    o.built(1, 1, 100, 5)
    served = [O.Shape(1, 1, 256 * 10, 256 * 20, cabin=100)]
    assert o.decide(served, [], 4) == []
    bad = [O.Quality(100, 256 * 10, 256 * 5)]
    assert [a.reason for a in o.decide(served, bad, 5) + o.decide(served, bad, 6)] == ["quality-heal", "quality-collapse"]
    assert o.decide([], [], 7) == [] and o.decide([], [], 20) == []
    assert [a.reason for a in o.decide([], [], 27)] == ["sustained-decay"]
    o.dropped(1, 1)
    assert o.decide([O.Shape(1, 1, 2560, 102400, cabin=9)] * 4, [], 30) == []  # served by another's


def test_optimizer_budget():
    o = O.StructureOptimizer(O.Policy(amortised=O.ONE, confirm=1, budget=5))
    assert [a.what for a in o.decide([O.Shape(1, 1, 256 * 10, 256 * 10 * 40)], [], 0)] == ["CREATE"]
    o.built(1, 1, 7, 5)
    both = [O.Shape(1, 1, 256 * 10, 256 * 20, cabin=7), O.Shape(2, 1, 256 * 100, 256 * 100 * 40)]
    assert [(a.what, a.reason) for a in o.decide(both, [], 1)] == [("DROP", "budget-swap"), ("CREATE", "sustained-benefit")]


def test_observed_values_and_trails():
    v = O.ObservedValues()
    assert v.observe("a", {1}) and v.add("a", 2) and v.rows("a") == {1, 2} and not v.add("b", 1)
    assert not v.observe("c", set(range(O.OBSERVED_ENTRIES + 1)))
    t = O.TrailRecorder()
    assert not t.offer((1, 2), [5]) and t.offer((1, 2), [5]) and t.offer((3, 4), [6], declared=True)
    assert not t.offer((1, 2), list(range(300)))
    assert O.relayout([1, 2, 3])[0]["benefit"] == 2 and O.relayout([1])[0]["blocked"] and O.id_budget(1)["warn"] is False


def test_loads(spark, tmp_path):
    from brindle.streaming.load import Load, from_stream

    s = Engine(spark).session()
    s.execute("CREATE TABLE t (id int64, v int64) BTREE EXPLICIT")
    load = Load(s, "t")
    assert load.chunk(1, [[1, 10], [2, 20]]) == 2 and load.chunk(1, [[1, 10]]) == 2 and load.chunk(2, [[3, 30]]) == 3
    assert load.end() == 3
    load = Load(s, "t")
    with pytest.raises(E.InvalidArgument):
        load.chunk(2, [[9, 9]])
    assert len(rows(s, "SELECT id FROM t")) == 3
    spark.range(100, 104).select("id", F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    q = from_stream(stream, s, "t", str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert len(rows(s, "SELECT id FROM t")) == 7
    # the same batch from a query that was started again; a batch with a key that no row may have
    rel = s.catalog.find("t")
    assert list(rel.batches.values()) == [0]
    spark.createDataFrame([(0, 1)], "id long, v long").write.mode("append").parquet(str(tmp_path / "in"))
    q = from_stream(stream, s, "t", str(tmp_path / "check"))
    with pytest.raises(Exception, match="doesn't fit"):
        q.processAllAvailable()
    assert len(rows(s, "SELECT id FROM t")) == 7
    shutil.rmtree(tmp_path / "check" / "commits")  # batch 0 is replayed
    q = from_stream(spark.readStream.schema("id long, v long").option("pathGlobFilter", "none").parquet(str(tmp_path / "in")), s, "t", str(tmp_path / "check"))
    q.stop()
    assert len(rows(s, "SELECT id FROM t")) == 7


def test_observed_values_and_trails_serve(spark):
    """Cabins and trails read fewer rows, at the version they were recorded at, and change none."""
    engine = Engine(spark)
    s = engine.session()
    s.execute("CREATE TABLE t (id int64, v int64, w varchar CABIN) BTREE")
    s.execute("INSERT INTO t VALUES (1,'a'), (2,'b'), (3,'a'), (4,'c')")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    q = "SELECT v FROM t WHERE w = 'a'"
    s.execute("SET CABIN_OPTIMIZER off")
    assert rows(s, q) == [(1,), (3,)] and not engine.values.values
    s.execute("SET CABIN_OPTIMIZER on")
    assert rows(s, q) == [(1,), (3,)] and list(engine.values.values.values()) == [{1, 3}]
    assert "id#" in plan(s.execute(q).df) and " IN (1,3)" in plan(s.execute(q).df)
    assert rows(s, "SELECT v FROM t WHERE w = 'z'") == [] and rows(s, "SELECT v FROM t WHERE w = 'z'") == []
    s.execute("INSERT INTO t VALUES (5,'a')")
    assert rows(s, q) == [(1,), (3,), (5,)]
    s.execute("BEGIN")
    s.execute("UPDATE t SET w = 'a' WHERE v = 2")
    assert rows(s, q) == [(1,), (2,), (3,), (5,)]
    s.execute("ROLLBACK")
    assert rows(s, q) == [(1,), (3,), (5,)]
    # a trail: from the second sighting
    q = "SELECT w FROM t WHERE v > 3"
    for served in (False, True, True):
        df = s.execute(q).df
        assert sorted(r[0] for r in df.collect()) == ["a", "c"] and (" IN (4,5)" in plan(df)) == served
    assert rows(s, "SELECT w FROM t WHERE v > 4") == [("a",)]
    s.execute("DELETE FROM t WHERE v = 4")
    assert rows(s, q) == [("a",)] and rows(s, q) == [("a",)]


def test_optimizer_makes_and_drops_cabins(spark, monkeypatch):
    """Scans of one column that last make a cabin; when they have stopped for long, it goes."""
    engine = Engine(spark)
    engine.optimizer.policy = O.Policy(amortised=O.ONE, confirm=2, cooldown=2, half_life=10)
    s = engine.session()
    s.execute("CREATE TABLE t (id int64, v int64, w varchar) BTREE")
    s.execute("INSERT INTO t VALUES (1,'a'), (2,'b')")
    monkeypatch.setattr(engine.store, "sizes", lambda paths: [40 * 8192])
    q = "SELECT v FROM t WHERE w = 'a'"
    for _ in range(10):
        assert rows(s, q) == [(1,)]
    now = max(engine.access.last.values())
    assert s.tune(now) == [] and [(a.what, a.reason) for a in s.tune(now + 1)] == [("CREATE", "sustained-benefit")]
    assert list(s.catalog.find("t").cabins) == ["w"] and s.execute("SHOW CABIN_OPTIMIZER").df.first()["state"] == "active"
    assert rows(s, q) == [(1,)] and {1} in engine.values.values.values()
    late = now + 10**9 * engine.options.half_life_s * 40
    assert s.tune(late) == [] and [a.reason for a in s.tune(late + 100)] == ["sustained-decay"]
    assert not s.catalog.find("t").cabins and rows(s, q) == [(1,)]
    s.execute("SET CABIN_OPTIMIZER off")
    assert s.tune() == []


def test_advice_changes_no_row(spark, s):
    q = "SELECT label FROM ferry WHERE hull = 'steel'"
    before = rows(s, q)
    s.execute("CREATE CABIN ON ferry(hull)")
    s.execute("CREATE INDEX by_hull ON ferry(hull)")
    assert rows(s, q) == before
    assert "FilterScan" in s.reply("SHOW ACCESS")


def test_positions_are_bytes():
    with pytest.raises(E.Unsupported) as e:
        parse("SELECT id FROM t WHERE v = 'é' OR id = 1")
    assert e.value.byte == 32


def joins_of(s, q):
    return [x for x in s.execute("ANALYZE " + q).message.splitlines() if "BroadcastNestedLoopJoin" in x or "CartesianProduct" in x]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "!="])
def test_linked_by_an_order(spark, op):
    """Subqueries linked by an order, with NULLs on both sides, against DuckDB; NOT IN joins by its value, not by pairs."""
    import duckdb

    s, db = Engine(spark).session(), duckdb.connect()
    left = [(1, 1, 1), (2, 1, None), (3, 2, 5), (4, None, 3), (5, 3, 9), (6, 3, None), (7, 2, 2)]
    right = [(1, 1, 1), (2, 1, 4), (3, 2, None), (4, None, 2), (5, 3, 9), (6, 2, 5), (7, 4, 3)]
    for name, data in (("l", left), ("r", right)):
        db.execute(f"CREATE TABLE {name} (id bigint, g bigint, v bigint)")
        s.execute(f"CREATE TABLE {name} (id int64, g int64 NULL, v int64 NULL) BTREE EXPLICIT")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", data)
        s.execute(f"INSERT INTO {name} VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in r) + ")" for r in data))
    deep = f"(SELECT b.id FROM r AS b WHERE b.g = a.g AND b.id NOT IN (SELECT d.v FROM l AS d WHERE d.id {op} a.id))"
    for q in (
        f"EXISTS (SELECT b.id FROM r AS b WHERE b.v {op} a.v)",
        f"NOT EXISTS (SELECT b.id FROM r AS b WHERE b.v {op} a.v)",
        f"NOT EXISTS (SELECT b.id FROM r AS b WHERE b.g = a.g AND a.id {op} b.v)",
        f"EXISTS (SELECT b.id FROM r AS b WHERE b.v {op} a.v AND b.id > a.g)",
        f"a.v IN (SELECT b.v FROM r AS b WHERE b.id {op} a.id)",
        f"a.v NOT IN (SELECT b.v FROM r AS b WHERE b.id {op} a.id)",
        f"a.v NOT IN (SELECT b.v FROM r AS b WHERE b.g = a.g AND b.id {op} a.id)",
        f"a.id NOT IN (SELECT b.id FROM r AS b WHERE b.v {op} a.v)",
        f"EXISTS {deep}",
        f"NOT EXISTS {deep}",
        f"a.v NOT IN {deep}",
        f"a.id IN {deep}",
        f"a.v NOT IN (SELECT b.v FROM r AS b WHERE b.g = 77 AND b.id {op} a.id)",
    ):
        q = f"SELECT a.id FROM l AS a WHERE {q}"
        want = sorted(db.execute(q).fetchall())
        assert rows(s, q) == want, q
    assert len(joins_of(s, f"SELECT a.id FROM l AS a WHERE a.id NOT IN (SELECT b.id FROM r AS b WHERE b.id {op} a.g)")) == 0


def test_changes_write_only_what_they_change(spark):
    """An update or delete leaves the files of the other rows as they are; snapshots keep theirs; many files become one."""
    s = Engine(spark).session()
    s.execute("CREATE TABLE g (id int64, v int64) BTREE EXPLICIT")
    s.execute("INSERT INTO g VALUES (1, 1), (2, 2), (3, 3), (4, 4)")
    rel = s.catalog.find("g")
    first = rel.versions[-1][0].path
    other = s.engine.session()
    other.execute("SET ISOLATION LEVEL REPEATABLE READ")
    other.execute("BEGIN")
    s.execute("UPDATE g SET v = 9 WHERE id = 2")
    s.execute("DELETE FROM g WHERE id = 3")
    s.execute("UPDATE g SET v = 8 WHERE v = 9")
    assert [p.path for p in rel.versions[-1]][0] == first and len(rel.versions[-1][0].gone) == 3
    assert rows(s, "SELECT id, v FROM g") == [(1, 1), (2, 8), (4, 4)]
    assert rows(other, "SELECT id, v FROM g") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    for n in range(4):
        s.execute(f"UPDATE g SET v = {n} WHERE id = 1")
    assert first not in [p.path for p in rel.versions[-1]]
    assert rows(s, "SELECT id, v FROM g") == [(1, 3), (2, 8), (4, 4)]
    s.execute("DELETE FROM g WHERE v < 100")
    assert rows(s, "SELECT id, v FROM g") == [] and "duplicate" in s.reply("INSERT INTO g VALUES (3, 1)")


def test_index_is_read(spark):
    """Rows by an index, which follows changes, renames and transactions; what it covers is read from it alone."""
    s = Engine(spark).session()
    s.execute("CREATE TABLE g (id int64, a int64, b varchar, c int64 NULL) BTREE EXPLICIT")
    s.execute("INSERT INTO g VALUES " + ", ".join(f"({n}, {n % 7}, 'b{n % 3}', {n})" for n in range(1, 50)))
    s.execute("CREATE INDEX by_a ON g(a, b)")
    rel = s.catalog.find("g")
    plan = lambda q: s.execute("ANALYZE " + q).message
    sorted_path = rel.sorted_paths["by_a", rel.versions[-1][0].path].rsplit("/", 1)[1]
    covered, rest = "SELECT id, b FROM g WHERE a = 3 AND b = 'b0'", "SELECT id, c FROM g WHERE a = 3 AND b > 'b0'"
    assert s.store.through(rel, "by_a", 1, None).inputFiles()[0].split("/")[-2] == sorted_path
    assert "examined=3 " in plan(covered) and "PushedFilters: [IsNotNull(a), IsNotNull(b), EqualTo(a,3), EqualTo(b,b0)]" in plan(covered) and "c#" not in plan(covered).split("Physical Plan")[1]
    assert rows(s, covered) == [(n, "b0") for n in range(1, 50) if n % 7 == 3 and n % 3 == 0]
    assert rows(s, rest) == [(n, n) for n in range(1, 50) if n % 7 == 3 and n % 3]
    s.execute("UPDATE g SET a = 3 WHERE id = 6")
    s.execute("DELETE FROM g WHERE id = 3")
    s.execute("BEGIN")
    s.execute("INSERT INTO g VALUES (60, 3, 'b0', 1), (61, 4, 'b0', 1)")
    want = [(n, "b0") for n in range(1, 50) if n % 7 == 3 and n % 3 == 0 and n != 3] + [(6, "b0"), (60, "b0")]
    assert rows(s, covered) == sorted(want)
    s.execute("COMMIT")
    s.execute("ALTER TABLE g RENAME COLUMN a TO z")
    covered = covered.replace("a =", "z =")
    assert rows(s, covered) == sorted(want) and {k for k in rel.sorted_paths} >= {("by_a", p.path) for p in rel.versions[-1]}
    assert rows(s, "SELECT h.id FROM g AS h WHERE h.z = 3 AND EXISTS (SELECT k.id FROM g AS k WHERE k.c = h.c AND k.b = 'b0')") == [(6,), (24,), (45,), (60,)]
    s.execute("DROP INDEX by_a")
    s.execute("CREATE INDEX by_a ON g(b)")
    assert len(rows(s, "SELECT id FROM g WHERE b = 'b0'")) == sum(n % 3 == 0 for n in range(1, 50)) - 1 + 2


def joined(spark, folder, left, right, *more):
    """A session over files of (id, k) and the join of the first two on k, no key of either."""
    out = Engine(spark).session()
    for name, df in zip("abc", (left, right, *more)):
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    out.catalog.parquet(str(folder), "a", "b", "c", unique={"c": False})
    return out, "SELECT x.id, y.id FROM a AS x JOIN b AS y ON x.k = y.k"


def largest_share(df):
    made = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(made) / sum(made)


def keyed(spark, n, k):
    return spark.range(n).select("id", F.expr(k).alias("k"))


def test_joins_that_multiply_rows_use_all_tasks(spark, tmp_path):
    s, q = joined(spark, tmp_path, keyed(spark, 4000, "int(id % 5)"), keyed(spark, 9000, "int(id % 5)"))
    df = s.sql(q)
    assert df.count() == 5 * 800 * 1800
    assert largest_share(df) < 0.5  # of 16 tasks; by bytes it was one
    both_ways = s.sql("SELECT x.id, y.id FROM b AS x JOIN a AS y ON x.k = y.k")
    assert both_ways.count() == 5 * 800 * 1800 and largest_share(both_ways) < 0.5
    one_value = s.sql("SELECT x.id, y.id FROM a AS x JOIN a AS z ON x.id = z.id JOIN b AS y ON z.k = y.k WHERE x.id < 500")
    assert one_value.count() == 500 * 1800 and largest_share(one_value) < 0.3


def test_joins_that_multiply_rows_lose_none(spark, tmp_path, monkeypatch):
    from brindle.operators import lower

    # a value of most rows on both sides, values of one side alone, NULL, and 64 against 32 bits
    k = "IF(id % 3 > 0, 7, IF(id % 5 = 0, NULL, id % 40))"
    left, right = keyed(spark, 700, f"int({k})"), keyed(spark, 500, f"bigint({k} + IF(id % 3 = 0, 9, 0))")
    twice = left.where("id < 60").unionAll(left.where("id < 60"))
    s, q = joined(spark, tmp_path, left, right, twice)
    queries = [q, "SELECT x.k, y.id FROM c AS x JOIN b AS y ON x.k = y.k", "SELECT x.id, y.id FROM a AS x JOIN a AS y ON x.k = y.k WHERE x.id < y.id", "SELECT x.id, z.id FROM a AS x JOIN c AS y ON x.k = y.k JOIN b AS z ON y.k = z.k WHERE x.id < 40", "SELECT x.id, y.id FROM a AS x JOIN b AS y ON x.k = y.k WHERE y.id > 90 ORDER BY x.id LIMIT 50"]
    monkeypatch.setattr(lower, "PAIRS", 1 << 60)
    want = [rows(s, x) for x in queries]
    ks, kd = [{r.id: r.k for r in f.collect()} for f in (left, right)]
    assert want[0] == sorted((a, b) for a in ks for b in kd if ks[a] is not None and ks[a] == kd[b])
    monkeypatch.setattr(lower, "PAIRS", 0)
    monkeypatch.setattr(lower, "CELL", 16)
    assert [rows(s, x) for x in queries] == want
    assert "_way_l" in s.sql(q)._jdf.queryExecution().toString()
    assert largest_share(s.sql(q)) < 0.25
    monkeypatch.setattr(lower, "BROADCAST_BYTES", 0)
    assert rows(s, queries[3]) == want[3]
