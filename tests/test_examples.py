"""End-to-end scripts of the kind that applications run."""

import pytest

from granary.api import Database
from granary.errors import Code, DatabaseError


def test_users(db):
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE, age INTEGER)")
    assert db.execute("INSERT INTO users (id, name, email, age) VALUES (1, 'Alice', 'a@x', 30), (2, 'Bob', 'b@x', 25), (3, 'Carol', 'c@x', 35)") == 3
    with db.prepare("SELECT id, name, age FROM users WHERE age > ? ORDER BY id") as s:
        assert [tuple(r) for r in s.bind_int(1, 26)] == [(1, "Alice", 30), (3, "Carol", 35)]
    with db.transaction():
        db.execute("UPDATE users SET age = age + 1 WHERE name = 'Alice'")
    assert db.query_single("SELECT age FROM users WHERE name = ?", "Alice")[0] == 31


def test_accounts(db):
    db.exec("CREATE TABLE accounts (id INTEGER PRIMARY KEY, name TEXT, balance REAL); INSERT INTO accounts VALUES (1, 'Checking', 1000.0), (2, 'Savings', 5000.0)")
    with db.transaction():
        db.execute("UPDATE accounts SET balance = balance - ? WHERE id = 1", 500.0)
        db.execute("UPDATE accounts SET balance = balance + ? WHERE id = 2", 500.0)
    db.run_transaction(lambda d: d.execute("UPDATE accounts SET balance = balance * 1.05 WHERE id = 2"))
    assert [tuple(r) for r in db.query("SELECT id, balance FROM accounts ORDER BY id").collect()] == [(1, 500.0), (2, pytest.approx(5775.0))]


def test_products(db):
    db.exec("CREATE TABLE products (id INTEGER, name TEXT, price REAL); INSERT INTO products VALUES (1, 'Laptop', 999.99), (2, 'Mouse', 29.99), (3, 'Keyboard', 79.99), (4, 'Monitor', 299.99)")
    assert db.query_column("SELECT name FROM products ORDER BY price DESC") == ["Laptop", "Monitor", "Keyboard", "Mouse"]
    assert db.query_column("SELECT name FROM products WHERE price < 100 ORDER BY name") == ["Keyboard", "Mouse"]
    assert db.query_single("SELECT COUNT(*), MAX(price) FROM products")[0] == 4


def test_scores_sales_and_numbers(db):
    db.exec(
        """CREATE TABLE scores (name TEXT, score INTEGER); INSERT INTO scores VALUES ('Alice', 85), ('Bob', 92), ('Charlie', 78);
           CREATE TABLE nums (n INTEGER); INSERT INTO nums VALUES (1), (2), (3);
           CREATE TABLE sales (amount INTEGER); INSERT INTO sales VALUES (100), (200);
           CREATE TABLE a (id INTEGER); CREATE TABLE b (id INTEGER); INSERT INTO a VALUES (1); INSERT INTO b VALUES (1)"""
    )
    assert db.query_column("SELECT score FROM scores ORDER BY score DESC") == [92, 85, 78]
    assert len(db.query_column("SELECT n FROM nums LIMIT 2")) == 2
    assert db.query_column("SELECT COUNT(*) FROM sales") == [2]
    assert [tuple(r) for r in db.query("SELECT a.id, b.id FROM a JOIN b ON a.id = b.id").collect()] == [(1, 1)]


def test_errors_and_safety(db):
    db.exec("CREATE TABLE test (id INTEGER PRIMARY KEY); INSERT INTO test VALUES (1)")
    with pytest.raises(DatabaseError) as caught:
        db.execute("INSERT INTO test VALUES (1)")
    assert caught.value.code == Code.CONSTRAINT
    db.exec("CREATE TABLE safe (id INTEGER, value INTEGER); INSERT INTO safe VALUES (1, 100)")
    with pytest.raises(ZeroDivisionError), db.transaction():
        db.execute("UPDATE safe SET value = 200")
        1 / 0  # noqa: B018
    assert db.query_column("SELECT value FROM safe") == [100]


def test_encrypted_store(spark, tmp_path):
    path = f"{tmp_path}/vault"
    with Database(spark, path) as db:
        db.key("my secret")
        db.exec("CREATE TABLE files (id INTEGER PRIMARY KEY, name TEXT, content BLOB)")
        db.execute("INSERT INTO files VALUES (?, ?, ?)", 1, "key.bin", bytearray(range(16)))
    with Database(spark, path) as db:
        db.key("my secret")
        assert tuple(db.query_single("SELECT name, content FROM files WHERE id = 1")) == ("key.bin", bytes(range(16)))
