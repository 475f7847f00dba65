"""Quality rules on repetition inside a document, from a suffix array of its words.

Words are symbols. Prefix doubling sorts the suffixes of many documents at once (a symbol carries its document,
so suffixes of different documents never mix), each round only those that are still tied. Two suffixes that are
neighbours in the array share a prefix; its length comes from the ranks of the rounds, longest power first.
LCP intervals of `least` words or more are the repeated substrings; those that cannot be extended to the left
are maximal. The union of their occurrences gives the covered fraction, and the largest LCP the longest repeat.

A document is rejected by the method if repeats cover more than `most_covered` of its word characters or if its
longest repeat has more than `longest` words. The base rules come first: fewer than 20 words, or more than 30%
of the words in 8-word windows that occur twice.

Defined cases: null and empty texts have no word and fail the base rules; null or repeated ids are kept, one row
each; an empty table gives an empty result; extra columns are ignored. Whole texts are taken; memory is that of
one slice of texts (1 MB) or of one longer text, times about 150.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import Words, mix64, span_hashes, word_slices

WINDOW, LEAST_WORDS, MOST_REPEAT_PERCENT = 8, 20, 30
MOST_COVERED, LONGEST = 0.3, 200
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def suffix_ranks(symbols: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ.

    symbols: dense integers from 0; last: for each place the end of its document. Equal rank: equal prefixes.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    new = np.ones(n, bool)
    new[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    ranks = [rank]
    size = np.diff(np.append(first, n))
    tied = order[np.repeat(size > 1, size)]
    step = 1
    while len(tied):
        ahead = tied + step
        second = np.where(ahead < last[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        own = rank[tied]
        by = np.lexsort((second, own))
        tied, own, second = tied[by], own[by], second[by]
        bucket = np.ones(len(tied), bool)
        bucket[1:] = own[1:] != own[:-1]
        new = bucket.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(tied))
        bucket_at = np.maximum.accumulate(np.where(bucket, at, 0))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(tied)))
        new_at = np.repeat(first, size)
        rank = rank.copy()
        rank[tied] = own + new_at - bucket_at
        ranks.append(rank)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return ranks


def shared(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Length of the common prefix of suffixes i and j (never equal ones)."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i + out, j + out
        fits = (a < n) & (b < n)
        same = fits & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        out += np.where(same, 1 << k, 0)
    return out


def longest_repeats(symbols: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """For each place the length of the longest prefix of its suffix that occurs elsewhere in its document too;
    0 where that is below `least` (at least 1)."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    ranks = suffix_ranks(symbols, last)
    level = min(int(np.log2(least)), len(ranks) - 1)
    final = ranks[-1]
    array = np.empty(n, np.int64)
    array[final] = np.arange(n)
    near = ranks[level][array]
    pair = np.flatnonzero(near[1:] == near[:-1])
    if not len(pair):
        return out
    lcp = shared(ranks, array[pair], array[pair + 1], n)
    lcp[lcp < least] = 0
    np.maximum.at(out, array[pair], lcp)
    np.maximum.at(out, array[pair + 1], lcp)
    return out


def maximal_repeats(symbols: np.ndarray, least: int = WINDOW) -> list[tuple[int, list[int]]]:
    """(length, starts) of every maximal repeated substring of one sequence, by LCP intervals.

    The general interface for one document; `quality` needs only the spans' union and lengths.
    """
    symbols = np.unique(np.asarray(symbols), return_inverse=True)[1].astype(np.int64)
    n = len(symbols)
    if n < 2:
        return []
    ranks = suffix_ranks(symbols, np.full(n, n))
    array = np.empty(n, np.int64)
    array[ranks[-1]] = np.arange(n)
    lcp = shared(ranks, array[:-1], array[1:], n)
    found, stack = [], []  # open intervals: (length, first place in the array)
    for k, length in enumerate([*lcp.tolist(), 0]):
        left = k
        while stack and stack[-1][0] > length:
            size, left = stack.pop()
            starts = sorted(array[left : k + 1].tolist())
            before = {symbols[s - 1] if s else -1 - s for s in starts}
            if size >= least and (len(before) > 1 or 0 in starts):
                found.append((size, starts))
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, left))
    return sorted(found)


def _union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def _lines(words: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    if not len(starts):
        return np.zeros(len(words.counts), np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    closed = np.zeros(len(data) + 1, bool)
    closed[breaks] = True
    ends = ends - closed[ends - 1]
    held = np.append(0, np.cumsum(words.inside))
    some = held[np.maximum(ends, starts)] > held[starts]
    starts, ends, doc = starts[some], ends[some], doc[some]
    keys = mix64(span_hashes(data, starts, ends) ^ mix64(doc.astype(np.uint64), 7))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=len(words.counts))


def measure(words: Words, least: int = WINDOW) -> dict[str, np.ndarray]:
    """Per text of the slice: the base counts, covered (fraction of word characters) and longest (words)."""
    data, count = words.data, len(words.counts)
    lead = (data & 0xC0) != 0x80
    chars = np.append(0, np.cumsum(words.inside & lead))
    signs = np.append(0, np.cumsum(_IS_SYMBOL[data]))
    offsets = words.offsets
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
        "n_dup_lines": _lines(words),
    }
    n = len(words.starts)
    doc = words.doc
    keys = mix64(words.hashes() ^ mix64(doc.astype(np.uint64), 11))
    symbols = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    longest = longest_repeats(symbols, np.repeat(words.first[1:], words.counts), min(least, WINDOW))
    windows = np.flatnonzero(longest >= WINDOW)
    in_window = _union(windows, np.full(len(windows), WINDOW), n)
    repeats = np.flatnonzero(longest >= least)
    covered = _union(repeats, longest[repeats], n)
    size = chars[words.ends] - chars[words.starts]
    inside = np.bincount(doc[covered], weights=size[covered], minlength=count)
    top = np.zeros(count, np.int64)
    np.maximum.at(top, doc, longest)
    out["n_repeat_words"] = np.bincount(doc[in_window], minlength=count)
    out["covered"] = inside / np.maximum(out["word_chars"], 1)
    out["longest"] = top
    return out


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered double, longest_repeat long"
)


def verdicts(m: dict[str, np.ndarray], most_covered: float, longest: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"])
    return failed, ~failed & (m["covered"] <= most_covered) & (m["longest"] <= longest)


def quality(docs: DataFrame, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """One row for each document, in a single pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in word_slices(batch.column(1)):
                m = measure(words)
                failed, kept = verdicts(m, most_covered, longest)
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b]]
                    + [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                    + [pa.array(failed), pa.array(kept), pa.array(m["covered"], pa.float64()), pa.array(m["longest"], pa.int64())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep: a filter inside the same pass, no join."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_slices(batch.column(place)):
                _, kept = verdicts(measure(words), most_covered, longest)
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
