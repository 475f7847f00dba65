"""Database, Statement and Transaction: the statement API over Spark.

A query is rewritten by the dialect, planned by Spark over the tables' current snapshots and stays a lazy DataFrame; a
change makes a new table version, checks its constraints and publishes it. One Database has one writer; DataFrames that it
handed out keep reading the version they were made from.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from enum import IntFlag
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from granary.errors import Code, CryptoError, DatabaseError, GranaryError, StatementError, from_spark
from granary.functions import crypto, search
from granary.operators import change
from granary.operators.transactions import Snapshot, Transactions
from granary.plans import dialect
from granary.plans.statements import (
    Column,
    CreateIndex,
    CreateTable,
    Delete,
    DropIndex,
    DropTable,
    Insert,
    Transaction,
    Update,
    parse,
)
from granary.sources.store import Index, Store, TableVersion

#: Segments of a table from which it is rewritten as one.
MOST_SEGMENTS = 32


class Open(IntFlag):
    """Flags of `open`."""

    READONLY = 1
    READWRITE = 2
    CREATE = 4
    MEMORY = 8
    NOMUTEX = 16
    FULLMUTEX = 32
    WAL = 64


def version() -> str:
    from granary import __version__

    return __version__


class Database:
    """A catalog of named snapshots in memory or in a directory."""

    def __init__(self, spark: SparkSession, path: str = ":memory:", flags: int = Open.READWRITE | Open.CREATE):
        self.spark = spark.newSession()  # own views; the context is shared
        memory = path in (":memory:", "") or bool(flags & Open.MEMORY)
        self.readonly = bool(flags & Open.READONLY)
        self.store = Store(self.spark, None if memory else path)
        if not memory and not self.store.exists(path) and not flags & Open.CREATE:
            raise DatabaseError(f"{path} does not exist", Code.CANTOPEN)
        tables, self._extra = ({}, {}) if memory else self.store.load()
        self._txn = Transactions(Snapshot(tables, self._extra.get("last_rowid", 0)))
        self._key: bytes | None = None
        self._views: dict[str, TableVersion] = {}
        self._open = True
        self.last_error, self.last_code = "", Code.OK

    # ------------------------------------------------------------ life

    def close(self) -> None:
        if self._open:
            self._txn.rollback()
            for name in self._views:
                self.spark.catalog.dropTempView(name)
            if self.store.memory:
                self.store.drop()
            self._open = False

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _fail(self, error: Exception) -> GranaryError:
        found = from_spark(error)
        self.last_error, self.last_code = str(found), found.code
        return found

    @contextmanager
    def _guarded(self) -> Iterator[None]:
        if not self._open:
            raise DatabaseError("the database is closed", Code.MISUSE)
        try:
            yield
        except (GranaryError, PySparkException) as error:
            raise self._fail(error) from error

    def errmsg(self) -> str:
        return self.last_error

    def errcode(self) -> Code:
        return self.last_code

    # ------------------------------------------------------------ tables

    @property
    def _tables(self) -> dict[str, TableVersion]:
        return self._txn.now.tables

    def tables(self) -> list[str]:
        return sorted(t.name for t in self._tables.values())

    def _version(self, name: str) -> TableVersion:
        try:
            return self._tables[name.lower()]
        except KeyError:
            raise DatabaseError(f"no table {name}", Code.NOTFOUND) from None

    def _frame(self, table: TableVersion) -> DataFrame:
        if not table.sealed:
            return self.store.read(table)
        sealed = ", ".join(f"`{c.name}` binary" for c in table.columns)
        cipher, key = self._cipher()
        return crypto.unseal(self.store.read(table, sealed), [(c.name, c.type) for c in table.columns], cipher, key)

    def table(self, name: str) -> DataFrame:
        """The table's current snapshot."""
        return self._frame(self._version(name))

    def attach(self, name: str, paths: str | Sequence[str]) -> None:
        """Take existing Parquet files as a table, as they are: its first segments, never written to."""
        paths = [paths] if isinstance(paths, str) else list(paths)
        schema = self.spark.read.parquet(*paths).schema
        columns = tuple(Column(f.name, f.dataType.simpleString()) for f in schema.fields)
        with self._guarded():
            if name.lower() in self._tables:
                raise DatabaseError(f"table {name} exists", Code.ERROR)
            self._put(TableVersion(name, columns, tuple(paths)))

    def _show(self, sql: str) -> None:
        """Views for the tables that the text names, at their current version."""
        for word in {t.text.strip("`").lower() for t in dialect.solid(sql) if t.kind in ("word", "quoted")}:
            table = self._tables.get(word)
            if table is not None and self._views.get(word) is not table:
                self._frame(table).createOrReplaceTempView(f"`{word}`")
                self._views[word] = table
            elif table is None and word in self._views:
                self.spark.catalog.dropTempView(word)
                del self._views[word]

    # ------------------------------------------------------------ queries

    def query(self, sql: str, *args: Any) -> DataFrame:
        """The lazy result of a query; `?` take the arguments in order. Truth values come as 1 and 0."""
        with self._guarded():
            if dialect.classify(sql) != "select":
                raise StatementError("not a query", Code.MISUSE)
            if dialect.count_parameters(sql) != len(args):
                raise StatementError(f"{dialect.count_parameters(sql)} parameters, {len(args)} arguments", Code.RANGE)
            self._show(sql)
            text, named = dialect.bound(dialect.rewrite(sql), list(args))
            frame = self.spark.sql(text, args=named)
            if any(t == "boolean" for _, t in frame.dtypes):
                plain = [f"c{k}" for k in range(len(frame.columns))]
                kinds = [t for _, t in frame.dtypes]
                names = frame.columns
                frame = frame.toDF(*plain).select(*(F.col(p).cast("bigint") if t == "boolean" else F.col(p) for p, t in zip(plain, kinds, strict=True))).toDF(*names)
            return frame.toDF(*dialect.output_names(sql, frame.columns))

    def query_single(self, sql: str, *args: Any) -> Row | None:
        return next(iter(self.query(sql, *args).take(1)), None)

    def query_column(self, sql: str, *args: Any) -> list:
        """First column of all rows."""
        frame = self.query(sql, *args)
        return [r[0] for r in frame.toLocalIterator()]

    def execute(self, sql: str, *args: Any) -> int:
        """Run one statement that is not a query; the number of rows it changed."""
        with self._guarded():
            return self._run(sql, list(args))

    def exec(self, script: str, callback: Callable[[int, list[str | None], list[str]], Any] | None = None) -> None:
        """Run a script; each row of its queries goes to the callback as (columns, texts, names); a true answer stops it."""
        for sql in dialect.split_script(script):
            with self._guarded():
                kind = dialect.classify(sql)
            if kind != "select":
                self.execute(sql)
                continue
            frame = self.query(sql)
            with self._guarded():
                if callback is None:
                    frame.write.format("noop").mode("overwrite").save()
                    continue
                for row in frame.toLocalIterator():
                    texts = [None if v is None else v if isinstance(v, str) else str(v) for v in row]
                    if callback(len(row), texts, frame.columns):
                        raise StatementError("stopped by the callback", Code.ERROR)

    def prepare(self, sql: str) -> Statement:
        """The first statement of the text; the rest is its `tail`."""
        with self._guarded():
            parts = dialect.split_script(sql)
            if not parts:
                raise StatementError("empty statement", Code.ERROR)
            dialect.classify(parts[0])
            return Statement(self, parts[0], "; ".join(parts[1:]))

    # ------------------------------------------------------------ changes

    def changes(self) -> int:
        return self._txn.now.changes

    def total_changes(self) -> int:
        return self._txn.now.total

    def last_insert_rowid(self) -> int:
        return self._txn.now.last_rowid

    def _publish(self) -> None:
        self._extra["last_rowid"] = self._txn.now.last_rowid
        self.store.publish(self._tables, self._extra)

    def _writable(self) -> None:
        if self.readonly:
            raise DatabaseError("the database is read-only", Code.READONLY)

    def _put(self, table: TableVersion | None, drop: str | None = None) -> None:
        """Make a table version current, or drop one; publish at once outside a transaction."""
        self._writable()
        before = dict(self._tables)
        if drop is not None:
            del self._tables[drop.lower()]
        if table is not None:
            self._tables[table.name.lower()] = table
        if not self._txn.active:
            try:
                self._publish()
            except GranaryError:
                self._txn.now.tables = before
                raise

    def _write(self, frame: DataFrame, table: TableVersion) -> str:
        if self._key is not None:
            cipher, key = self._cipher()
            frame = crypto.seal(frame, cipher, key)
        return self.store.write(frame, table)

    def _target(self, table: TableVersion) -> TableVersion:
        return table.with_(sealed=self._key is not None)

    def _count(self, changed: int) -> int:
        now = self._txn.now
        now.changes = changed
        now.total += changed
        return changed

    def _run(self, sql: str, args: list) -> int:
        kind = dialect.classify(sql)
        if kind == "select":
            raise StatementError("use query for a query", Code.MISUSE)
        if dialect.count_parameters(sql) != len(args):
            raise StatementError(f"{dialect.count_parameters(sql)} parameters, {len(args)} arguments", Code.RANGE)
        statement = parse(sql)
        if isinstance(statement, Transaction):
            return self._transact(statement)
        self._writable()
        self._show(sql)
        if isinstance(statement, CreateTable):
            return self._create_table(statement)
        if isinstance(statement, DropTable):
            if statement.if_exists and statement.name.lower() not in self._tables:
                return 0
            self._version(statement.name)
            self._put(None, statement.name)
            return 0
        if isinstance(statement, CreateIndex):
            return self._create_index(statement)
        if isinstance(statement, DropIndex):
            table = self._index_owner(statement.name)
            if table is None:
                raise DatabaseError(f"no index {statement.name}", Code.NOTFOUND)
            rest = {k: v for k, v in table.indexes.items() if k.lower() != statement.name.lower()}
            self._put(table.with_(indexes=rest))
            return 0
        table = self._version(statement.table)
        if isinstance(statement, Insert):
            return self._insert(table, statement, args)
        return self._rewrite(table, statement, args)

    def _create_table(self, statement: CreateTable) -> int:
        if statement.name.lower() in self._tables:
            if statement.if_not_exists:
                return 0
            raise DatabaseError(f"table {statement.name} exists", Code.ERROR)
        if statement.query is not None:
            frame = self.spark.sql(statement.query)
            table = self._target(TableVersion(statement.name, tuple(Column(n, t) for n, t in frame.dtypes)))
            self._put(table.with_(segments=(self._write(frame, table),)))
            return 0
        names = [c.name.lower() for c in statement.columns]
        if not names or len(set(names)) != len(names):
            raise StatementError("a table needs columns of different names", Code.ERROR)
        self._put(TableVersion(statement.name, tuple(statement.columns), sealed=self._key is not None))
        return 0

    def _index_owner(self, name: str) -> TableVersion | None:
        return next((t for t in self._tables.values() if any(k.lower() == name.lower() for k in t.indexes)), None)

    def _create_index(self, statement: CreateIndex) -> int:
        if self._index_owner(statement.name) is not None:
            raise DatabaseError(f"index {statement.name} exists", Code.ERROR)
        table = self._version(statement.table)
        names = tuple(table.column(c).name for c in statement.columns)
        made = table.with_(indexes={statement.name: Index(names, statement.unique), **table.indexes})
        rows = self._frame(table)
        if statement.unique:
            change.check_unique(table.with_(columns=tuple(Column(c.name, c.type) for c in table.columns), indexes={statement.name: Index(names, True)}), rows)
        if table.segments:  # lay the rows out for it: range-clustered, with bloom filters
            made = self._target(made)
            made = made.with_(segments=(self._write(rows, made),))
        self._put(made)
        return 0

    def _insert(self, table: TableVersion, statement: Insert, args: list) -> int:
        rows = change.new_rows(self.spark, table, statement, args)
        target = self._target(table)
        if target.sealed != table.sealed and table.segments:
            raise CryptoError("the table is stored under another key", Code.MISUSE)
        # written once, then checked and counted from what was written
        segment = self._write(rows, target)
        try:
            written = self._frame(target.with_(segments=(segment,)))
            change.check_not_null(table, written)
            change.check_unique(table, written, self._frame(table) if table.segments else None)
            n = written.count()
            self._put(self._merged(target.with_(segments=(*table.segments, segment))))
        except (GranaryError, PySparkException):
            self.store.remove(segment)
            raise
        self._txn.now.last_rowid += n
        return self._count(n)

    def _merged(self, table: TableVersion) -> TableVersion:
        """More than MOST_SEGMENTS segments: the smaller half of them becomes one, so a row is written again only as often as the
        logarithm of the number of inserts."""
        if len(table.segments) <= MOST_SEGMENTS:
            return table
        by_size = sorted(table.segments, key=self.store.size)
        small = by_size[: len(by_size) - MOST_SEGMENTS // 2]
        merged = self._write(self._frame(table.with_(segments=tuple(small))), table)
        return table.with_(segments=(*(s for s in table.segments if s not in small), merged))

    def _touched(self, table: TableVersion, statement: Update | Delete, args: list) -> tuple[list[str], list[str]]:
        """(segments or files that the condition may change, those that stay as they are)."""
        every = list(table.segments)
        if table.sealed or statement.where is None:
            return every, []
        view = f"granary_files_{uuid.uuid4().hex}"
        self._frame(table).select("*", F.col("_metadata.file_path").alias(change.FILE)).createOrReplaceTempView(view)
        try:
            own = args[len(args) - dialect.count_parameters(statement.where) :]
            hit = change.files(self.spark, table, view, statement.where, own)
        finally:
            self.spark.catalog.dropTempView(view)
        if any(re.search(r"[%\[\]{}*?\\]", f) for f in hit):  # a name that a path doesn't give as it is
            return every, []
        plain = lambda path: re.sub(r"^file:/+", "/", path)
        wanted, touched, stay = {plain(f) for f in hit}, [], []
        for segment in every:
            files = self.store.files(segment)
            found = [f for f in files if plain(f) in wanted]
            if not found:
                stay.append(segment)
            elif len(found) == len(files):
                touched.append(segment)
            else:
                touched += found
                stay += [f for f in files if plain(f) not in wanted]
        return touched, stay

    def _rewrite(self, table: TableVersion, statement: Update | Delete, args: list) -> int:
        """UPDATE and DELETE: a new segment in place of the old ones, counted while it is written."""
        update = isinstance(statement, Update)
        if not table.segments:
            for name, _ in statement.changes if update else ():
                table.column(name)
            return self._count(0)
        if not update and statement.where is None:
            n = self._frame(table).count()
            self._put(table.with_(segments=()))
            return self._count(n)
        touched, stay = self._touched(table, statement, args)
        if not touched:
            return self._count(0)
        make = change.updated if update else change.marked
        view = f"granary_rows_{uuid.uuid4().hex}"
        self._frame(table.with_(segments=tuple(touched))).createOrReplaceTempView(view)
        try:
            marked = make(self.spark, table, f"`{view}`", statement, args)
            seen = Observation()
            watched = marked.observe(seen, F.count_if(change.HIT).alias("n"))
            rows = (watched if update else watched.filter(f"NOT {change.HIT}")).drop(change.HIT)
            target = self._target(table)
            segment = self._write(rows, target)
            try:
                n = seen.get["n"]
            except Py4JError:  # a condition that folds to a constant leaves nothing to observe
                n = marked.filter(change.HIT).count()
        finally:
            self.spark.catalog.dropTempView(view)
        try:
            if n and update:
                named = {table.column(c).name for c, _ in statement.changes}
                after = self._frame(target.with_(segments=(segment,)))
                change.check_not_null(table.with_(columns=tuple(c for c in table.columns if c.name in named)), after)
                if any(set(k) & named for k in table.keys()):
                    change.check_unique(table, after, self._frame(table.with_(segments=tuple(stay))) if stay else None)
            if n:
                self._put(self._merged(target.with_(segments=(*stay, segment))))
            else:
                self.store.remove(segment)
        except GranaryError:
            self.store.remove(segment)
            raise
        return self._count(n)

    def vacuum(self) -> int:
        """Delete the segments that the current version doesn't name; DataFrames of older versions end with them. Not in a transaction."""
        with self._guarded():
            self._writable()
            if self._txn.active:
                raise StatementError("not inside a transaction", Code.MISUSE)
            return self.store.vacuum(self._tables)

    # ------------------------------------------------------------ transactions

    def _transact(self, statement: Transaction) -> int:
        txn = self._txn
        if statement.kind == "begin":
            txn.begin()
        elif statement.kind == "commit":
            if txn.active:
                if txn.now.tables != txn.base.tables:
                    self._writable()
                    self._publish()
                txn.commit()
        elif statement.kind == "rollback":
            txn.rollback()
        else:
            getattr(txn, statement.kind)(statement.name)
        return 0

    def begin(self) -> None:
        self.execute("BEGIN")

    def commit(self) -> None:
        self.execute("COMMIT")

    def rollback(self) -> None:
        self.execute("ROLLBACK")

    def savepoint(self, name: str) -> None:
        with self._guarded():
            self._txn.savepoint(name)

    def release(self, name: str) -> None:
        with self._guarded():
            self._txn.release(name)

    def rollback_to(self, name: str) -> None:
        with self._guarded():
            self._txn.rollback_to(name)

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """Commit at the end, roll back on an exception."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        else:
            self.commit()

    def run_transaction(self, work: Callable[[Database], Any]) -> Any:
        with self.transaction():
            return work(self)

    # ------------------------------------------------------------ search

    def json_extract(self, document: str | None, path: str) -> str | None:
        row = self.spark.range(1).select(search.json_extract(F.lit(document).cast("string"), path).alias("v")).first()
        return row["v"]

    def vector_search(self, table: str, column: str, query: Sequence[float], top_k: int, key: str | None = None) -> DataFrame:
        version = self._version(table)
        return search.vector_search(self._frame(version), version.column(column).name, query, top_k, key or version.columns[0].name)

    def fts_search(self, table: str, query: str, column: str | None = None, key: str | None = None) -> DataFrame:
        """Rows with all terms, by tf-idf; the column is the table's first text column unless it is named."""
        version = self._version(table)
        texts = [c.name for c in version.columns if c.type == "string"]
        if column is None and not texts:
            raise DatabaseError(f"{table} has no text column", Code.MISMATCH)
        name = version.column(column).name if column else texts[0]
        return search.fts_search(self._frame(version), name, query, key or version.columns[0].name)

    # ------------------------------------------------------------ encryption

    def _cipher(self) -> tuple[crypto.Cipher, bytes]:
        if self._key is None:
            raise CryptoError("the database is encrypted: give the key first", Code.MISUSE)
        return crypto.get_cipher(self._extra["cipher"]), self._key

    def key(self, password: str | bytes, cipher: str = "aes-256-gcm", kdf: str = "pbkdf2") -> None:
        """Open an encrypted database, or encrypt a clear one."""
        with self._guarded():
            if self._txn.active:
                raise CryptoError("not inside a transaction", Code.MISUSE)
            if "cipher" in self._extra:
                found = crypto.derive(password, base64.b64decode(self._extra["salt"]), self._extra["kdf"])
                if crypto.verifier(found) != self._extra["check"]:
                    raise CryptoError("wrong key", Code.MISUSE)
                self._key = found
                return
            self._seal_with(password, cipher, kdf)

    def _seal_with(self, password: str | bytes | None, cipher: str | None, kdf: str) -> None:
        """Rewrite every table under a new key, or in clear (password None), and publish."""
        self._writable()
        frames = {k: self._frame(t) for k, t in self._tables.items()}
        extra = {k: v for k, v in self._extra.items() if k not in ("cipher", "kdf", "salt", "check")}
        key = None
        if password is not None:
            made = crypto.get_cipher(cipher)
            salt = crypto.random_bytes(16)
            key = crypto.derive(password, salt, kdf, made.key_size)
            extra |= {"cipher": made.name, "kdf": kdf, "salt": base64.b64encode(salt).decode(), "check": crypto.verifier(key)}
        old_key, old_extra, old_tables = self._key, self._extra, dict(self._tables)
        self._key, self._extra = key, extra
        try:
            for k, table in old_tables.items():
                target = self._target(table)
                if table.segments:
                    target = target.with_(segments=(self._write(frames[k], target),))
                self._tables[k] = target
            self._publish()
        except BaseException:
            self._key, self._extra, self._txn.now.tables = old_key, old_extra, old_tables
            raise

    def rekey(self, password: str | bytes, cipher: str | None = None, kdf: str = "pbkdf2") -> None:
        with self._guarded():
            current, _ = self._cipher()
            self._seal_with(password, cipher or current.name, kdf)

    def decrypt(self) -> None:
        with self._guarded():
            self._cipher()
            self._seal_with(None, None, "")

    def crypto_status(self) -> tuple[str, bool]:
        """(cipher, whether the database is encrypted)."""
        return self._extra.get("cipher", "none"), "cipher" in self._extra


class Statement:
    """One prepared statement: bind, step, read columns; also an iterator over rows and a context manager."""

    def __init__(self, db: Database, sql: str, tail: str = ""):
        self.db, self.sql, self.tail = db, sql, tail
        self.kind = dialect.classify(sql)
        self.parameters: list[Any] = [None] * dialect.count_parameters(sql)
        self.names: list[str] = []
        self._rows: Iterator[Row] | None = None
        self.row: Row | None = None
        self._done = self._closed = False

    # binding: places count from 1

    def _bind(self, place: int, value: Any) -> Statement:
        if self._closed:
            raise StatementError("the statement is finalized", Code.MISUSE)
        if self._rows is not None:
            raise StatementError("reset the statement before binding", Code.MISUSE)
        if not 1 <= place <= len(self.parameters):
            raise StatementError(f"no parameter {place}", Code.RANGE)
        self.parameters[place - 1] = value
        return self

    def bind(self, place: int, value: Any) -> Statement:
        return self._bind(place, value)

    def bind_null(self, place: int) -> Statement:
        return self._bind(place, None)

    def bind_int(self, place: int, value: int) -> Statement:
        return self._bind(place, int(value))

    bind_int64 = bind_int

    def bind_double(self, place: int, value: float) -> Statement:
        return self._bind(place, float(value))

    def bind_text(self, place: int, value: str) -> Statement:
        return self._bind(place, str(value))

    def bind_blob(self, place: int, value: bytes) -> Statement:
        return self._bind(place, bytearray(value))

    bind_json = bind_text

    def bind_vector(self, place: int, value: Sequence[float]) -> Statement:
        return self._bind(place, F.array(*(F.lit(float(x)) for x in value)))

    def bind_all(self, *values: Any) -> Statement:
        for k, v in enumerate(values, 1):
            self._bind(k, v)
        return self

    # running

    def step(self) -> Code:
        """ROW with `row` set, or DONE."""
        if self._closed:
            raise StatementError("the statement is finalized", Code.MISUSE)
        if self._done:
            return Code.DONE
        if self.kind != "select":
            self.db.execute(self.sql, *self.parameters)
            self._done = True
            return Code.DONE
        with self.db._guarded():
            if self._rows is None:
                frame = self.db.query(self.sql, *self.parameters)
                self.names, self._rows = frame.columns, iter(frame.toLocalIterator())
            self.row = next(self._rows, None)
        if self.row is None:
            self._done = True
            return Code.DONE
        return Code.ROW

    def execute(self) -> int:
        """Run to the end; the number of changed rows."""
        while self.step() == Code.ROW:
            pass
        return self.db.changes()

    def reset(self) -> None:
        """Start anew at the next step; bindings stay."""
        self._rows, self.row, self._done = None, None, False

    def clear_bindings(self) -> None:
        self.parameters = [None] * len(self.parameters)

    def finalize(self) -> None:
        self.reset()
        self._closed = True

    def __enter__(self) -> Statement:
        return self

    def __exit__(self, *_: object) -> None:
        self.finalize()

    def __iter__(self) -> Iterator[Row]:
        while self.step() == Code.ROW:
            yield self.row

    # columns: places count from 0

    def _value(self, place: int) -> Any:
        if self.row is None:
            raise StatementError("there is no row", Code.MISUSE)
        if not 0 <= place < len(self.row):
            raise StatementError(f"no column {place}", Code.RANGE)
        return self.row[place]

    def column_count(self) -> int:
        if self.kind != "select":
            return 0
        if not self.names:
            self.names = self.db.query(self.sql, *self.parameters).columns
        return len(self.names)

    def column_name(self, place: int) -> str:
        if not 0 <= place < self.column_count():
            raise StatementError(f"no column {place}", Code.RANGE)
        return self.names[place]

    def column_type(self, place: int) -> str:
        """null, int, float, text, blob or vector; other Spark values are text."""
        value = self._value(place)
        if value is None:
            return "null"
        for kind, name in ((bool, "int"), (int, "int"), (float, "float"), ((bytes, bytearray), "blob"), (list, "vector")):
            if isinstance(value, kind):
                return name
        return "text"

    def column_double(self, place: int) -> float:
        """Numbers as they are, texts by their leading number, anything else 0."""
        value = self._value(place)
        if isinstance(value, int | float):
            return float(value)
        return _leading_number(value) if isinstance(value, str) else 0.0

    def column_int(self, place: int) -> int:
        value = self._value(place)
        return int(value) if isinstance(value, int) else int(self.column_double(place))

    column_int64 = column_int

    def column_text(self, place: int) -> str | None:
        value = self._value(place)
        if value is None or isinstance(value, str):
            return value
        return bytes(value).decode("utf-8", "replace") if isinstance(value, bytes | bytearray) else str(value)

    def column_blob(self, place: int) -> bytes | None:
        value = self._value(place)
        return value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, bytes | bytearray) else None

    def column_bytes(self, place: int) -> int:
        return len(self.column_blob(place) or b"")

    column_json = column_text

    def column_vector(self, place: int) -> list[float] | None:
        value = self._value(place)
        return list(value) if isinstance(value, list) else None

    def get(self, place: int, default: Any = None) -> Any:
        value = self._value(place)
        return default if value is None else value

    get_optional = get


def _leading_number(text: str) -> float:
    import re

    found = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text)
    return float(found.group()) if found else 0.0


def open_database(spark: SparkSession, path: str = ":memory:", flags: int = Open.READWRITE | Open.CREATE) -> Database:
    return Database(spark, path, flags)
