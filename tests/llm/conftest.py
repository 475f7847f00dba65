import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, **more):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        found = spark.createDataFrame(rows, "doc_id long, text string, source string")
        for name in ("size", "kept", "score", "spans", "node", "key", "n_words", "ids"):
            found = found.selectExpr("*", f"'x' AS {name}")
        return found

    return make


@pytest.fixture(scope="session")
def by_id():
    def read(found, key="doc_id"):
        return {r[key]: r for r in found.collect()}

    return read
