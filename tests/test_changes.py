"""INSERT, UPDATE, DELETE, schema statements, constraints and transactions."""

import sqlite3

import pytest

from granary.errors import Code, DatabaseError, GranaryError


def all_of(db, table, order="id"):
    return [tuple(r) for r in db.query(f"SELECT * FROM {table} ORDER BY {order}").collect()]


def test_insert_forms(db):
    db.execute("CREATE TABLE t (id INTEGER, name TEXT DEFAULT 'none', v REAL)")
    assert db.execute("INSERT INTO t VALUES (1, 'a', 1 + 0.5), (-2, NULL, -3)") == 2
    assert db.execute("INSERT INTO t (v, id) VALUES (?, ?)", 2.5, 7) == 1
    assert db.execute("INSERT INTO t SELECT id + 100, name, v FROM t WHERE id > 0") == 2
    assert all_of(db, "t") == [(-2, None, -3.0), (1, "a", 1.5), (7, "none", 2.5), (101, "a", 1.5), (107, "none", 2.5)]
    assert (db.changes(), db.total_changes(), db.last_insert_rowid()) == (2, 5, 5)
    with pytest.raises(GranaryError):
        db.execute("INSERT INTO t (id) VALUES (1, 2)")
    with pytest.raises(GranaryError):
        db.execute("INSERT INTO t (nothing) VALUES (1)")


def test_update_sees_old_rows(db):
    db.exec("CREATE TABLE t (id INTEGER, a INTEGER, b INTEGER); INSERT INTO t VALUES (1, 10, 20), (2, NULL, 5), (3, 7, NULL)")
    assert db.execute("UPDATE t SET b = a, a = b + ? WHERE id < ?", 1, 3) == 2
    assert all_of(db, "t") == [(1, 21, 10), (2, 6, None), (3, 7, None)]
    assert db.execute("UPDATE t SET a = 0 WHERE b > 0") == 1  # null is not true
    assert db.execute("UPDATE t SET a = 0 WHERE id = 99") == 0
    assert db.execute("UPDATE t SET b = CAST(b AS INTEGER) + 1") == 3
    with pytest.raises(GranaryError):
        db.execute("UPDATE t SET zz = 1")
    with pytest.raises(GranaryError):
        db.execute("UPDATE t SET a = 1, A = 2")


def test_delete(db):
    db.exec("CREATE TABLE t (id INTEGER, a INTEGER); INSERT INTO t VALUES (1, 1), (2, NULL), (3, 3)")
    assert db.execute("DELETE FROM t WHERE a < 2") == 1
    assert all_of(db, "t") == [(2, None), (3, 3)]
    db.execute("CREATE INDEX i ON t (id)")
    assert db.execute("DELETE FROM t WHERE 1 = 1") == 2
    db.execute("INSERT INTO t VALUES (1, 2)")
    assert db.execute("DELETE FROM t WHERE 1 = 0") == 0
    assert db.execute("DELETE FROM t") == 1
    assert db.execute("DELETE FROM t") == 0
    assert all_of(db, "t") == []


def test_earlier_frames_keep_their_version(db):
    db.exec("CREATE TABLE t (id INTEGER); INSERT INTO t VALUES (1), (2)")
    before = db.table("t")
    db.exec("UPDATE t SET id = id + 10; DELETE FROM t WHERE id = 11; INSERT INTO t VALUES (5)")
    assert sorted(r[0] for r in before.collect()) == [1, 2]
    assert all_of(db, "t") == [(5,), (12,)]


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO u VALUES (1, 'x', 'new')",  # primary key twice
        "INSERT INTO u VALUES (8, 'x', 'e'), (8, 'y', 'f')",
        "INSERT INTO u VALUES (NULL, 'x', 'e')",
        "INSERT INTO u VALUES (9, NULL, 'e')",
        "INSERT INTO u VALUES (9, 'x', 'a@b')",  # unique twice
        "UPDATE u SET id = 1",
        "UPDATE u SET name = NULL WHERE id = 2",
    ],
)
def test_constraints(db, sql):
    db.exec("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE); INSERT INTO u VALUES (1, 'a', 'a@b'), (2, 'b', NULL), (3, 'c', NULL)")
    before = all_of(db, "u")
    with pytest.raises(DatabaseError) as caught:
        db.execute(sql)
    assert caught.value.code == Code.CONSTRAINT
    assert all_of(db, "u") == before


def test_tables_and_indexes(db):
    db.exec("CREATE TABLE t (id INTEGER, v TEXT); INSERT INTO t VALUES (2, 'b'), (1, 'a'), (1, 'c')")
    with pytest.raises(DatabaseError):
        db.execute("CREATE TABLE T (id INTEGER)")
    db.execute("CREATE TABLE IF NOT EXISTS t (id INTEGER)")
    with pytest.raises(DatabaseError) as caught:
        db.execute("CREATE UNIQUE INDEX one ON t (id)")
    assert caught.value.code == Code.CONSTRAINT
    before = all_of(db, "t", "id, v")
    db.execute("CREATE INDEX by_id ON t (id)")
    db.execute("CREATE UNIQUE INDEX both ON t (id, v DESC)")
    assert all_of(db, "t", "id, v") == before
    assert [tuple(r) for r in db.query("SELECT v FROM t WHERE id = 2").collect()] == [("b",)]
    with pytest.raises(DatabaseError):
        db.execute("INSERT INTO t VALUES (2, 'b')")
    with pytest.raises(DatabaseError):
        db.execute("CREATE INDEX by_id ON t (v)")
    with pytest.raises(DatabaseError):
        db.execute("CREATE INDEX other ON t (nothing)")
    db.execute("DROP INDEX both")
    db.execute("INSERT INTO t VALUES (2, 'b')")
    db.execute("DROP TABLE t")
    with pytest.raises(DatabaseError) as caught:
        db.execute("DROP INDEX by_id")  # went with its table
    assert caught.value.code == Code.NOTFOUND
    with pytest.raises(DatabaseError):
        db.execute("DROP TABLE t")
    db.execute("DROP TABLE IF EXISTS t")
    with pytest.raises(GranaryError):
        db.query("SELECT * FROM t")


def test_transactions(db):
    db.exec("CREATE TABLE t (id INTEGER); INSERT INTO t VALUES (1)")
    with pytest.raises(RuntimeError):
        with db.transaction():
            db.execute("UPDATE t SET id = 100")
            raise RuntimeError
    assert all_of(db, "t") == [(1,)]
    with db.transaction():
        db.execute("INSERT INTO t VALUES (2)")
    assert db.run_transaction(lambda d: d.execute("INSERT INTO t VALUES (3)")) == 1
    assert all_of(db, "t") == [(1,), (2,), (3,)]
    db.commit()  # none is open: nothing happens
    db.rollback()
    db.begin()
    with pytest.raises(DatabaseError) as caught:
        db.begin()
    assert caught.value.code == Code.MISUSE
    db.execute("DROP TABLE t")
    db.rollback()
    assert db.tables() == ["t"]


def test_savepoints(db):
    db.execute("CREATE TABLE t (id INTEGER)")
    for call in (db.savepoint, db.release, db.rollback_to):
        with pytest.raises(DatabaseError) as caught:
            call("a")
        assert caught.value.code == Code.MISUSE
    db.exec("BEGIN; INSERT INTO t VALUES (1); SAVEPOINT a; INSERT INTO t VALUES (2); SAVEPOINT b; INSERT INTO t VALUES (3)")
    assert db.total_changes() == 3
    with pytest.raises(DatabaseError) as caught:
        db.savepoint("a")
    assert caught.value.code == Code.CONSTRAINT
    db.rollback_to("b")
    assert all_of(db, "t") == [(1,), (2,)] and db.total_changes() == 2
    db.exec("ROLLBACK TO SAVEPOINT a")
    with pytest.raises(DatabaseError) as caught:
        db.rollback_to("b")
    assert caught.value.code == Code.NOTFOUND
    db.exec("INSERT INTO t VALUES (9); RELEASE a; COMMIT")
    assert all_of(db, "t") == [(1,), (9,)]
    db.begin()
    for k in range(32):
        db.savepoint(f"s{k}")
    with pytest.raises(DatabaseError) as caught:
        db.savepoint("more")
    assert caught.value.code == Code.FULL


SCRIPT = """
CREATE TABLE acc (id INTEGER PRIMARY KEY, name TEXT, bal REAL);
INSERT INTO acc VALUES (1, 'Checking', 1000.0), (2, 'Savings', 5000.0), (3, NULL, NULL);
BEGIN;
UPDATE acc SET bal = bal - 500 WHERE name = 'Checking';
UPDATE acc SET bal = bal + 500 WHERE name = 'Savings';
COMMIT;
BEGIN;
DELETE FROM acc WHERE bal > 0;
SAVEPOINT a;
INSERT INTO acc VALUES (9, 'nine', 9);
ROLLBACK TO a;
INSERT INTO acc VALUES (8, 'eight', 8);
ROLLBACK;
UPDATE acc SET bal = bal * 1.05, name = 'S' WHERE id = 2;
DELETE FROM acc WHERE name IS NULL AND id = 3;
INSERT INTO acc (bal, id) VALUES (-1.5, 4)
"""


def test_script_against_sqlite(db):
    other = sqlite3.connect(":memory:", isolation_level=None)
    other.executescript(SCRIPT)
    db.exec(SCRIPT)
    assert all_of(db, "acc") == other.execute("SELECT * FROM acc ORDER BY id").fetchall()


def test_many_small_inserts_are_merged(db):
    from granary.api import MOST_SEGMENTS

    db.execute("CREATE TABLE t (id INTEGER)")
    for k in range(MOST_SEGMENTS + 2):
        db.execute("INSERT INTO t VALUES (?)", k)
    assert len(db._version("t").segments) < MOST_SEGMENTS
    assert all_of(db, "t") == [(k,) for k in range(MOST_SEGMENTS + 2)]


def test_bulk_insert(db):
    """A hundred thousand rows of literals in one statement; a few hundred of expressions."""
    db.execute("CREATE TABLE t (id INTEGER, x REAL, s TEXT)")
    made = [f"({k}, {k}.5, 'it''s {k}')" for k in range(100_000)]
    assert db.execute("INSERT INTO t VALUES " + ", ".join(made)) == 100_000
    assert tuple(db.query_single("SELECT COUNT(*), SUM(id), MAX(x), MIN(s) FROM t")) == (100_000, 4_999_950_000, 99_999.5, "it's 0")
    db.execute("DELETE FROM t")
    assert db.execute("INSERT INTO t VALUES " + ", ".join(f"({k} + ?, NULL, upper('a'))" for k in range(300)), *[1] * 300) == 300
    assert tuple(db.query_single("SELECT SUM(id), COUNT(x), MAX(s) FROM t")) == (sum(range(300)) + 300, 0, "A")


def test_insert_of_mixed_literals(db):
    db.execute("CREATE TABLE t (i INTEGER, r REAL, s TEXT, d TEXT, b BLOB)")
    db.execute("INSERT INTO t (i, r, s, d) VALUES (1, 2, 3, '2024-02-29'), ('7', -2.5e1, 1.5, NULL), (NULL, '4', 'a\\b''c', ?), (?, ?, ?, NULL)", "2020-01-01", 9, 0.5, "q")
    found = [tuple(r) for r in db.query("SELECT i, r, s, d FROM t ORDER BY i").collect()]
    assert found == [(None, 4.0, "a\\b'c", "2020-01-01"), (1, 2.0, "3", "2024-02-29"), (7, -25.0, "1.5", None), (9, 0.5, "q", None)]
    db.execute("INSERT INTO t (b) VALUES (X'00ff'), (NULL)")
    assert db.query_single("SELECT COUNT(b) FROM t")[0] == 1
    with pytest.raises(GranaryError):
        db.execute("INSERT INTO t (i, r) VALUES (1, 2), (3)")


def test_update_writes_the_files_it_hits(db):
    """Of four segments an UPDATE of one row replaces one; the others stay, also in a table that was attached."""
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT)")
    for k in range(4):
        db.execute("INSERT INTO t VALUES " + ", ".join(f"({100 * k + j}, 'old')" for j in range(50)))
    before = db._tables["t"].segments
    assert db.execute("UPDATE t SET s = 'new' WHERE id = ?", 205) == 1
    after = db._tables["t"].segments
    assert set(before) - set(after) == {before[2]} and len(after) == 4
    assert db.execute("DELETE FROM t WHERE id IN (SELECT MAX(id) FROM t) OR id = 0") == 2
    assert set(after) - set(db._tables["t"].segments) == {before[0], before[3]}
    assert tuple(db.query_single("SELECT COUNT(*), SUM(id), COUNT(NULLIF(s, 'old')) FROM t")) == (198, sum(100 * k + j for k in range(4) for j in range(50)) - 349, 1)
    now = db._tables["t"].segments
    assert db.execute("UPDATE t SET s = 'x' WHERE id = 7000") == 0 and db._tables["t"].segments == now
    with pytest.raises(GranaryError):
        db.execute("UPDATE t SET id = 101 WHERE id = 205")  # the key is in a file that was not hit
    assert db._tables["t"].segments == now
    for wanted in (6, 0):  # the replaced segments, and then no more
        gone = db.vacuum()
        assert gone == 0 or wanted
    assert db.query_single("SELECT COUNT(*) FROM t")[0] == 198


def test_update_inside_a_segment(db, tmp_path, spark):
    """One file of a folder of many is replaced."""
    path = f"{tmp_path}/many"
    spark.range(100).selectExpr("id", "id % 7 AS v").repartitionByRange(5, "id").write.parquet(path)
    db.attach("t", path)
    assert db.execute("UPDATE t SET v = 70 WHERE id = 42") == 1
    assert len(db._tables["t"].segments) == 5
    assert tuple(db.query_single("SELECT COUNT(*), SUM(v) FROM t")) == (100, sum(k % 7 for k in range(100)) + 70 - 42 % 7)
    db.vacuum()  # attached files are not the database's own
    assert spark.read.parquet(path).count() == 100
