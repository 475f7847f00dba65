"""File databases, encryption, hashes."""

import pytest

from granary.api import Database, Open
from granary.errors import Code, CryptoError, DatabaseError, GranaryError
from granary.functions import crypto, hashes


def rows(db, sql):
    return [tuple(r) for r in db.query(sql).collect()]


def test_reopen(spark, tmp_path):
    path = f"{tmp_path}/db"
    with pytest.raises(DatabaseError) as caught:
        Database(spark, path, Open.READWRITE)
    assert caught.value.code == Code.CANTOPEN
    with Database(spark, path) as db:
        db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT DEFAULT 'd'); INSERT INTO t (id) VALUES (1), (2); CREATE INDEX i ON t (s)")
        db.exec("BEGIN; DELETE FROM t")  # not committed
    with Database(spark, path) as db:
        assert rows(db, "SELECT * FROM t ORDER BY id") == [(1, "d"), (2, "d")]
        assert db.last_insert_rowid() == 2
        with pytest.raises(DatabaseError):
            db.execute("INSERT INTO t VALUES (2, 'again')")
        db.execute("DROP INDEX i")
    with Database(spark, path, Open.READONLY) as db:
        with pytest.raises(DatabaseError) as caught:
            db.execute("DELETE FROM t")
        assert caught.value.code == Code.READONLY
    with pytest.raises(DatabaseError):
        db.query("SELECT 1")  # closed


def test_two_writers(spark, tmp_path):
    path = f"{tmp_path}/db"
    a = Database(spark, path)
    a.execute("CREATE TABLE t (id INTEGER)")
    b = Database(spark, path)
    b.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(DatabaseError) as caught:
        a.execute("INSERT INTO t VALUES (2)")
    assert caught.value.code == Code.BUSY
    assert rows(a, "SELECT * FROM t") == [] and rows(Database(spark, path), "SELECT * FROM t") == [(1,)]


def test_corrupt_manifest(spark, tmp_path):
    (tmp_path / "_manifest").mkdir()
    (tmp_path / "_manifest" / ("0" * 19 + "1.json")).write_text("{")
    with pytest.raises(DatabaseError) as caught:
        Database(spark, str(tmp_path))
    assert caught.value.code == Code.CORRUPT


def test_encryption(spark, tmp_path):
    path = f"{tmp_path}/db"
    with Database(spark, path) as db:
        db.exec("CREATE TABLE t (id INTEGER, f REAL, s TEXT, b BLOB, v VECTOR); INSERT INTO t VALUES (1, 0.1, 'plain words', X'00', array(0.1, 2.0)), (2, NULL, NULL, NULL, NULL)")
        wanted = rows(db, "SELECT * FROM t ORDER BY id")
        assert db.crypto_status() == ("none", False)
        db.key("one")
        assert db.crypto_status() == ("aes-256-gcm", True)
        assert rows(db, "SELECT * FROM t ORDER BY id") == wanted
        segment = db._version("t").segments[0]
        stored = b"".join(p.read_bytes() for p in __import__("pathlib").Path(segment).glob("*.parquet"))
        assert b"plain words" not in stored
    with Database(spark, path) as db:
        with pytest.raises(CryptoError):
            db.query("SELECT * FROM t")
        with pytest.raises(CryptoError):
            db.key("two")
        db.key("one")
        db.execute("INSERT INTO t (id) VALUES (3)")
        db.rekey("two", kdf="scrypt")
        assert rows(db, "SELECT * FROM t WHERE id < 3 ORDER BY id") == wanted
    with Database(spark, path) as db:
        db.key("two")
        db.decrypt()
        assert rows(db, "SELECT * FROM t WHERE id < 3 ORDER BY id") == wanted
    with Database(spark, path) as db:
        assert len(rows(db, "SELECT * FROM t")) == 3


def test_ciphers(spark):
    frame = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id long, s string, f double")
    for name in ("aes-256-gcm", "aes-256-cbc"):
        assert crypto.self_test(frame, crypto.get_cipher(name))
    for name in ("aria-256-gcm", "seed-cbc", "chacha20-poly1305"):
        with pytest.raises(CryptoError) as caught:
            crypto.get_cipher(name)
        assert caught.value.code == Code.NOTFOUND
    mine = crypto.Cipher("mine", 32, crypto.get_cipher("aes-256-gcm").seal, crypto.get_cipher("aes-256-gcm").open)
    crypto.register_cipher(mine)
    assert "mine" in crypto.list_ciphers()
    with pytest.raises(CryptoError):
        crypto.register_cipher(mine)
    crypto.unregister_cipher("mine")
    with pytest.raises(CryptoError):
        crypto.unregister_cipher("mine")
    # RFC 6070 style vectors for SHA-256, RFC 5869 case 1
    assert crypto.derive("password", b"salt", iterations=1).hex().startswith("120fb6cffcf8b32c43e7225256c4f837")
    made = crypto.derive(bytes([0x0B] * 22), bytes(range(13)), "hkdf", 32)
    assert len(made) == 32
    with pytest.raises(CryptoError):
        crypto.derive("x", b"", "argon2id")


def test_hashes(spark):
    assert hashes.crc32_of(b"123456789") == 0xCBF43926
    assert spark.range(1).select(hashes.crc32(__import__("pyspark").sql.functions.lit("123456789"))).first()[0] == 0xCBF43926
    assert hashes.hash64_of(b"") == 0xEF46DB3751D8E999
    assert hashes.hash64_of(b"a", 1) != hashes.hash64_of(b"a", 2)


def test_open_flags(spark):
    with Database(spark, "somewhere", Open.MEMORY) as db:
        assert db.store.memory
    with pytest.raises(GranaryError) as caught:
        db.query("SELECT 1")
    assert caught.value.code == Code.MISUSE


def test_vacuum(spark, tmp_path):
    path = f"{tmp_path}/db"
    with Database(spark, path) as db:
        db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY); INSERT INTO t VALUES (1), (2); DELETE FROM t WHERE id = 1; CREATE TABLE u (x TEXT); INSERT INTO u VALUES ('a'); DROP TABLE u")
        folder = tmp_path / "db" / "t"
        with pytest.raises(DatabaseError):
            db.execute("INSERT INTO t VALUES (2)")  # leaves nothing behind
        assert len(list(folder.iterdir())) == 2
        db.begin()
        with pytest.raises(GranaryError):
            db.vacuum()
        db.rollback()
        assert db.vacuum() == 2 and len(list(folder.iterdir())) == 1
    with Database(spark, path) as db:
        assert rows(db, "SELECT * FROM t") == [(2,)]
        db.execute("INSERT INTO t VALUES (3)")


def test_changed_sealed_values_are_refused(spark):
    """CBC carries a MAC; one bit of difference is an error, also in the MAC itself."""
    from pyspark.sql import functions as F

    cipher, key = crypto.get_cipher("aes-256-cbc"), bytes(range(32))
    frame = spark.createDataFrame([("some text",), (None,), ("",)], "s string").repartition(1)
    sealed = crypto.seal(frame, cipher, key)
    raw = [r[0] for r in sealed.collect()]
    kept = spark.createDataFrame([(x,) for x in raw], "s binary")
    assert [r[0] for r in crypto.unseal(kept, [("s", "string")], cipher, key).collect()] == ["some text", None, ""]
    import hashlib
    import hmac

    mac_key = hmac.digest(key, b"granary mac key", "sha256")
    assert bytes(raw[0][:32]) == hmac.new(mac_key, bytes(raw[0][32:]), hashlib.sha256).digest()
    for at in (0, 40, len(raw[0]) - 1):
        wrong = bytearray(raw[0])
        wrong[at] ^= 1
        with pytest.raises(Exception, match="changed"):
            crypto.unseal(spark.createDataFrame([(wrong,)], "s binary"), [("s", "string")], cipher, key).select(F.length("s")).collect()
