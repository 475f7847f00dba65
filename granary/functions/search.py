"""JSON paths, vector similarity and full-text search as ordinary column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import Code, StatementError


def json_extract(document: Column | str, path: str) -> Column:
    """The value at a path like `$.a.b[0]` as text; null where it is missing or the text isn't JSON."""
    return F.get_json_object(document, path)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles; null if one has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def vector_search(frame: DataFrame, column: str, query: Sequence[float], top_k: int, key: str) -> DataFrame:
    """The `top_k` rows whose vector is nearest to `query` by cosine, with `similarity`; ties by `key`.

    The query is a literal, so each executor scores its rows and keeps its own top k; only those are merged.
    A vector of another length is an error; null and zero vectors are left out.
    """
    if not len(query):
        raise StatementError("the query vector is empty", Code.MISMATCH)
    wanted = F.array(*(F.lit(float(x)) for x in query))
    vector = F.col(column)
    checked = F.when(F.size(vector) == len(query), vector).otherwise(F.raise_error(F.lit(f"MISMATCH: vectors of {len(query)} numbers are wanted")))
    return (
        frame.filter(vector.isNotNull())
        .withColumn("similarity", cosine(checked, wanted))
        .filter(F.col("similarity").isNotNull())
        .orderBy(F.col("similarity").desc(), F.col(key))
        .limit(top_k)
    )


def terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits: what text search takes for terms."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _query_terms(query: str) -> list[str]:
    import regex

    return sorted(set(regex.findall(r"[\p{L}\p{N}]+", query.lower())))


def _whole(term: str) -> str:
    """Pattern of the term as a whole run of letters and digits (a term has no other characters)."""
    return rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"


def _holds(low: Column, term: str) -> Column:
    """Whether lower-case text holds the term: a plain search first, the pattern only where it succeeds."""
    return low.contains(term) & low.rlike(_whole(term))


def fts_match(frame: DataFrame, column: str, query: str) -> DataFrame:
    """Rows that hold every term of the query."""
    wanted = _query_terms(query)
    if not wanted:
        return frame.limit(0)
    low = F.lower(column)
    for term in wanted:
        frame = frame.filter(_holds(low, term))
    return frame


def fts_search(frame: DataFrame, column: str, query: str, key: str) -> DataFrame:
    """Rows that hold every term, with `score`: the sum over the query's terms of tf * ln(N / df), best first, ties by `key`.

    tf, df and N count over the whole frame: one aggregate row of as many numbers as the query has terms.
    """
    wanted = _query_terms(query)
    if not wanted:
        return frame.withColumn("score", F.lit(0.0)).limit(0)
    low = F.lower(column)
    row = frame.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(_holds(low, t)).alias(f"df{k}") for k, t in enumerate(wanted))).first()
    score = F.lit(0.0)
    for k, term in enumerate(wanted):
        weight = F.log(F.lit(float(row["n"])) / F.lit(float(max(1, row[f"df{k}"]))))
        score = score + F.regexp_count(low, F.lit(_whole(term))) * weight
    return fts_match(frame, column, query).withColumn("score", score).orderBy(F.col("score").desc(), F.col(key))
