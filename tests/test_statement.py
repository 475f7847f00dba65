"""Prepared statements, rows, columns, callbacks."""

import pytest

from granary.errors import Code, GranaryError, StatementError


@pytest.fixture
def scores(db):
    db.exec("CREATE TABLE scores (name TEXT, score INTEGER, f REAL, b BLOB, v VECTOR)")
    db.exec("INSERT INTO scores VALUES ('Alice', 85, 1.5, X'0001', array(1.0, 2.0)), ('Bob', 92, NULL, NULL, NULL), ('12.5x', 78, 0.0, X'', NULL)")
    return db


def test_step_and_columns(scores):
    with scores.prepare("SELECT name, score, f, b, v FROM scores WHERE score > ? ORDER BY score DESC; SELECT 1") as s:
        assert s.tail == "SELECT 1" and s.column_count() == 5 and s.column_name(1) == "score"
        s.bind_int(1, 80)
        assert s.step() == Code.ROW
        assert (s.column_text(0), s.column_int(1), s.column_type(2), s.column_blob(3)) == ("Bob", 92, "null", None)
        assert s.get(2, "none") == "none"
        with pytest.raises(StatementError):
            s.bind_int(1, 0)  # not before a reset
        assert s.step() == Code.ROW
        assert (s.column_double(2), s.column_blob(3), s.column_bytes(3), s.column_vector(4)) == (1.5, b"\x00\x01", 2, [1.0, 2.0])
        assert [s.column_type(k) for k in range(5)] == ["text", "int", "float", "blob", "vector"]
        assert s.step() == Code.DONE and s.step() == Code.DONE
        s.reset()
        assert len(list(s.bind(1, 0))) == 3
        s.reset()
        with pytest.raises(StatementError) as caught:
            s.bind(2, 1)
        assert caught.value.code == Code.RANGE
    with pytest.raises(StatementError):
        s.step()


def test_coercions(scores):
    with scores.prepare("SELECT name, score FROM scores WHERE score = 78") as s:
        s.step()
        assert (s.column_int(0), s.column_double(0), s.column_text(1)) == (12, 12.5, "78")
        with pytest.raises(StatementError) as caught:
            s.column_int(2)
        assert caught.value.code == Code.RANGE


def test_bind_every_kind(db):
    db.execute("CREATE TABLE t (a INTEGER, b REAL, c TEXT, d BLOB, e VECTOR, f JSON, g TEXT)")
    s = db.prepare("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)")
    s.bind_int64(1, 1 << 40).bind_double(2, 0.5).bind_text(3, "it's").bind_blob(4, b"\xff").bind_vector(5, [1, 2]).bind_json(6, '{"k": 1}').bind_null(7)
    assert s.execute() == 1
    assert tuple(db.query_single("SELECT * FROM t")) == (1 << 40, 0.5, "it's", b"\xff", [1.0, 2.0], '{"k": 1}', None)


def test_exec_callback(scores):
    seen = []
    scores.exec("SELECT name, score n FROM scores ORDER BY score; SELECT 1 AS one", lambda n, texts, names: seen.append((n, texts, names)) and False)
    assert seen[0] == (2, ["12.5x", "78"], ["name", "n"]) and seen[-1] == (1, ["1"], ["one"])
    with pytest.raises(GranaryError):
        scores.exec("SELECT name FROM scores", lambda *_: True)


def test_queries(scores):
    assert scores.query_single("SELECT name FROM scores WHERE score = ?", 92)[0] == "Bob"
    assert scores.query_single("SELECT name FROM scores WHERE score = 0") is None
    assert sorted(scores.query_column("SELECT score FROM scores")) == [78, 85, 92]
    with pytest.raises(StatementError):
        scores.execute("SELECT 1")
    with pytest.raises(StatementError):
        scores.query("DELETE FROM scores")


def test_search(scores):
    scores.exec("CREATE TABLE d (id INTEGER, t TEXT); INSERT INTO d VALUES (1, 'Éa b, b'), (2, 'a B'), (3, 'éA!'), (4, ''), (5, NULL)")
    assert [r["id"] for r in scores.fts_search("d", "b").collect()] == [1, 2]
    assert [r["id"] for r in scores.fts_search("d", "ÉA").collect()] == [1, 3]
    assert [r["id"] for r in scores.fts_search("d", "éa B").collect()] == [1]
    assert scores.fts_search("d", " ,").collect() == []
    scores.exec("CREATE TABLE x (id INTEGER, v VECTOR); INSERT INTO x VALUES (1, array(1.0, 0.0)), (2, array(2.0, 0.1)), (3, array(0.0, 1.0)), (4, array(0.0, 0.0)), (5, NULL), (6, array(3.0, 0.0))")
    found = scores.vector_search("x", "v", [1.0, 0.0], 3).collect()
    assert [r["id"] for r in found] == [1, 6, 2] and abs(found[0]["similarity"] - 1) < 1e-12
    with pytest.raises(Exception, match="MISMATCH"):
        scores.vector_search("x", "v", [1.0], 3).collect()
    assert scores.json_extract('{"a": {"b": [1, 2]}}', "$.a.b[1]") == "2"
    assert scores.json_extract("{", "$.a") is None and scores.json_extract(None, "$.a") is None
