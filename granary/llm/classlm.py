"""Brown class-based bigram model: exchange clustering, class transitions, word emissions, smoothed perplexity.

Counts cover every training document, and every training token gets its class from its own neighbours:

1. The `UNITS` most frequent tokens, and a stand-in for each shape of the others (length, last character, digits, letters beyond
   ASCII), are clustered by exchange: units move between classes while the mutual information of adjacent classes grows, until
   nothing moves. That works on the unit-by-unit counts, whose size does not depend on the corpus.
2. Every other token of the vocabulary moves by exchange too, however many there are: its counts of the classes before and after it
   are summed over the corpus on the executors, and it takes the class under which its own bigrams are likeliest, given
   the table of step 1 (as in distributed exchange clustering). Its class is a row of a table that grows with the corpus.
3. The classes of all tokens give the class transitions, counted anew over all training texts, and the class totals.

P(text) = product of P(class | class before) * P(token | its class): transitions are smoothed by `DELTA` for each
class, emissions by 1/2 for each known token and one unseen one, so both sum to 1. A token that training never saw has the class
of its shape.

The vocabulary is never broadcast. Documents are dealt into chunks; each chunk asks for its distinct rarer tokens once, the
requests are joined to the table of step 2, and the answers meet the chunk's documents again in a cogroup, which leaves a byte
for each token: its class. Transitions and scores come from these bytes. Tokens are 64-bit hashes.

Defined cases: null text is the empty text (its one token is the end); null ids are never held out; repeated ids are
kept, one row each; without training documents N and V are 0 and every token has base log10(0.5 / 0.5) = 0;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, binary_buffers, even_labels, held_out, parts, scratch, slices, span_hashes, text_buffers

UNITS, CLASSES, DELTA = 1000, 64, 0.1
#: Tokens that one chunk of documents holds, about.
CHUNK_TOKENS = 2_500_000
#: The end token's hash; no word has it but by chance.
END = np.uint64(0xE4D00E4D00E4D001)
SHAPES = 49  # 3 lengths x 4 last characters x digits x letters beyond ASCII, and the end

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST = np.zeros(256, np.int64)
_LAST[list(b"aeiouy")] = 1
_LAST[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_LAST[128:] = 3


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, text) of all tokens of the texts, each text's words and then its end."""
    data = _LOWER[data]
    words = Words(data, offsets)
    size = words.ends - words.starts
    digit = np.append(0, np.cumsum((data >= 48) & (data < 58)))
    high = np.append(0, np.cumsum(data >= 128))
    shape = (
        ((size > 4).astype(np.int64) + (size > 9)) * 16
        + (_LAST[data[words.ends - 1]] if len(size) else size) * 4
        + (digit[words.ends] > digit[words.starts]) * 2
        + (high[words.ends] > high[words.starts])
    )
    hashes = span_hashes(data, words.starts, words.ends)
    n = len(words.counts)
    at = np.arange(len(hashes)) + words.doc
    ends = np.cumsum(words.counts + 1) - 1
    out_hash, out_shape = np.empty(len(hashes) + n, np.uint64), np.empty(len(hashes) + n, np.int64)
    out_hash[at], out_shape[at] = hashes, shape
    out_hash[ends], out_shape[ends] = END, SHAPES - 1
    return out_hash, out_shape, np.repeat(np.arange(n), words.counts + 1)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        for a, b in slices(offsets):
            yield batch, a, b, *token_stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sum of weights, a place of each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights, order[first]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, shape, count, summed inside the partition, some millions of tokens at a time."""

    def flush(held: list) -> pa.RecordBatch:
        hashes, shapes = (np.concatenate([h[k] for h in held]) for k in range(2))
        weights = np.concatenate([h[2] for h in held])
        keys, n, at = _summed(hashes, weights)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(shapes[at].astype(np.int32)), pa.array(n)], names=["token", "shape", "n"]
        )

    held, size = [], 0
    for _, _, _, hashes, shapes, _ in _pieces(batches, 0):
        keys, n, at = _summed(hashes, np.ones(len(hashes), np.int64))
        held.append((keys, shapes[at], n))
        size += len(keys)
        if size > 3_000_000:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def token_counts(train: DataFrame) -> DataFrame:
    """token, shape, n over all training texts."""
    counted = train.select("text").mapInArrow(_counted, "token long, shape int, n long")
    return counted.groupBy("token").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


class Units:
    """Frequent tokens by hash, shapes for the rest."""

    def __init__(self, frequent: np.ndarray):
        self.hashes = np.sort(frequent.view(np.uint64)) if len(frequent) else np.zeros(0, np.uint64)
        self.size = len(self.hashes) + SHAPES

    def of(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return shapes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes) + shapes)


def bigrams(train: DataFrame, units: Units) -> np.ndarray:
    """Unit-by-unit counts of adjacent tokens; before a text's first token stands an end."""
    end = units.size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a dense table of all pairs: its size is fixed by UNITS
        total = np.zeros(units.size * units.size, np.int64)
        for _, _, _, hashes, shapes, doc in _pieces(batches, 0):
            u = units.of(hashes, shapes)
            before = np.append(end, u[:-1])
            before[np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))] = end
            total += np.bincount(before * units.size + u, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    rows = train.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units.size * units.size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(units.size, units.size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit: start by rank of frequency, then move each unit to the class that raises
    sum N(c,d) log N(c,d) - sum N(c.) log N(c.) - sum N(.c) log N(.c) the most, until nothing moves."""
    size = len(pairs)
    classes = min(classes, size)
    weight = pairs.sum(0) + pairs.sum(1)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), -weight))] = np.arange(size)
    of = rank % classes
    one = np.zeros((size, classes))
    one[np.arange(size), of] = 1
    table = one.T @ pairs @ one
    moved = 1
    while moved:  # each move raises the same sum, so this ends
        moved = 0
        for w in np.lexsort((np.arange(size), -weight)):
            if weight[w] == 0:
                continue
            out_row = np.bincount(of, weights=pairs[w], minlength=classes)
            in_row = np.bincount(of, weights=pairs[:, w], minlength=classes)
            own, self_n = of[w], pairs[w, w]
            out_row[own] -= self_n
            in_row[own] -= self_n
            # take w out
            table[own] -= out_row
            table[:, own] -= in_row
            table[own, own] -= self_n
            # pairs between w and a class count in that class's sums wherever w goes
            left, right = table.sum(1) + in_row, table.sum(0) + out_row
            row_new, col_new = table + out_row, table + in_row[:, None]
            cross = table.diagonal()
            gain = (_xlogx(row_new) - _xlogx(table)).sum(1) + (_xlogx(col_new) - _xlogx(table)).sum(0)
            corner = cross + out_row + in_row + self_n
            gain += _xlogx(corner) - _xlogx(cross + out_row) - _xlogx(cross + in_row) + _xlogx(cross)
            out_n, in_n = out_row.sum() + self_n, in_row.sum() + self_n
            gain -= _xlogx(left + out_n) - _xlogx(left) + _xlogx(right + in_n) - _xlogx(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            moved += best != own
            of[w] = best
            table[best] += out_row
            table[:, best] += in_row
            table[best, best] += self_n
    return of


def _log_transition(table: np.ndarray) -> np.ndarray:
    return np.log10((table + DELTA) / (table.sum(1, keepdims=True) + DELTA * len(table)))


class Core:
    """The units, their classes and counts: the part of the model whose size is fixed by UNITS and CLASSES."""

    def __init__(self, units: Units, pairs: np.ndarray, counts: np.ndarray, n: int, v: int, classes: int = CLASSES):
        self.units, self.counts, self.n, self.v = units, counts, n, v
        self.of = exchange(pairs, classes)
        self.classes = int(self.of.max()) + 1
        one = np.zeros((len(self.of), self.classes))
        one[np.arange(len(self.of)), self.of] = 1
        table = one.T @ pairs @ one
        self.transition, self.mass = _log_transition(table), table.sum(0)
        self.base = np.log10(n + 0.5 * (v + 1))

    def rare(self, unit: np.ndarray) -> np.ndarray:
        """Which units are stand-ins for tokens; the end is none."""
        return (unit >= len(self.units.hashes)) & (unit < self.units.size - 1)


def fit(docs: DataFrame, modulus: int, remainder: int, units: int = UNITS, classes: int = CLASSES) -> tuple[Core, DataFrame]:
    """(core, table of the other training tokens: token, n, class)."""
    train = docs.filter(~held_out("doc_id", modulus, remainder))
    counts = scratch(token_counts(train), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(END.view(np.int64))
    top = counts.orderBy(F.col("n").desc(), "token").limit(units + 1).collect()
    ends = sum(r["n"] for r in counts.filter(F.col("token") == end).collect())
    top = [r for r in top if r["token"] != end][:units]
    found = Units(np.array([r["token"] for r in top], np.int64))
    known = np.zeros(found.size, np.int64)
    known[-1] = ends
    for r in top:
        known[np.searchsorted(found.hashes, np.array([r["token"]], np.int64).view(np.uint64))[0]] = r["n"]
    core = Core(found, bigrams(train, found), known, n, v, classes)
    return core, scratch(rare_classes(train, core), "classes")


def _contexts(shared) -> Callable:
    """Texts -> token, side and class of a neighbour of it (side * classes + class), n: of rare tokens, summed in the task as far as
    some millions of tokens go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, context, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((context, token))
            token, context = token[order], context[order]
            first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (context[1:] != context[:-1])))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(token[first].view(np.int64)), pa.array(context[first].astype(np.int32)), pa.array(np.add.reduceat(n[order], first))],
                names=["token", "context", "n"],
            )

        for _, _, _, hashes, shapes, doc in _pieces(batches, 0):
            unit = core.units.of(hashes, shapes)
            of = core.of[unit]
            rare = np.flatnonzero(core.rare(unit))
            before = np.where(np.append(True, doc[1:] != doc[:-1])[rare], core.of[-1], of[rare - 1])
            after = of[rare + 1]  # an end follows every word
            token = np.concatenate([hashes[rare], hashes[rare]])
            context = np.concatenate([before, after + core.classes]).astype(np.int16)
            held.append((token, context, np.ones(len(token), np.int64)))
            size += len(token)
            if size > 3_000_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _chosen(shared) -> Callable:
    """Rows of token, context, n, sorted by token -> token, n, class: the class under which the token's bigrams are likeliest."""

    def best(token: np.ndarray, context: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        core = shared.value
        new = np.append(True, token[1:] != token[:-1])
        row, first = np.cumsum(new) - 1, np.flatnonzero(new)
        counts = np.zeros((len(first), 2 * core.classes))
        np.add.at(counts, (row, context), n)
        before, after = counts[:, : core.classes], counts[:, core.classes :]
        total = before.sum(1)
        score = before @ core.transition + after @ core.transition.T - total[:, None] * np.log10(core.mass[None, :] + total[:, None])
        return pa.RecordBatch.from_arrays(
            [pa.array(token[first]), pa.array(total.astype(np.int64)), pa.array(np.argmax(np.round(score, 9), axis=1).astype(np.int32))],
            names=["token", "n", "class"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64)] * 3  # the last token's rows: more may follow
        for batch in batches:
            token, context, n = (np.concatenate([a, batch.column(k).to_numpy(zero_copy_only=False)]) for k, a in enumerate(left))
            if not len(token):
                continue
            cut = int(np.flatnonzero(np.append(True, token[1:] != token[:-1]))[-1])
            if cut:
                yield best(token[:cut], context[:cut], n[:cut])
            left = [token[cut:], context[cut:], n[cut:]]
        if len(left[0]):
            yield best(*left)

    return run


def rare_classes(train: DataFrame, core: Core) -> DataFrame:
    """token, n, class of every training token that is no unit."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(core)
    found = train.select("text").mapInArrow(_contexts(shared), "token long, context int, n long")
    return (
        found.repartition(parts(spark), "token").sortWithinPartitions("token").mapInArrow(_chosen(shared), "token long, n long, class int")
    )


CODED = "doc_id long, n_tokens long, n_known long, tops double, classes binary"


def coded(docs: DataFrame, core: Core, table: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, tops (sum of log10 (count + 0.5)), classes (a byte for each token) of each whole text."""
    spark = docs.sparkSession
    chunks = max(parts(spark), int(core.n * 1.3) // CHUNK_TOKENS + 1)
    partitions = max(parts(spark), min(chunks, 100_000))
    shared = spark.sparkContext.broadcast(core)
    # rows alike in id and text go to as many chunks as there are partitions that read them
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")
    labels = even_labels(spark, chunks, partitions)
    if labels is not None:
        chunk = F.element_at(F.lit(labels).cast("array<int>"), chunk + 1)
    # both uses below take the same columns, so that one exchange serves them
    dealt = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("chunk", chunk).repartition(partitions, "chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """chunk, token: the distinct tokens of each chunk's documents that are not units."""
        core = shared.value
        held: dict[int, list[np.ndarray]] = {}
        for batch, a, b, hashes, shapes, doc in _pieces(batches, 1):
            rare = core.rare(core.units.of(hashes, shapes))
            chunk = batch.column(2)[a:b].to_numpy(zero_copy_only=False)[doc[rare]]
            rest = hashes[rare]
            for c in np.unique(chunk):
                held.setdefault(int(c), []).append(np.unique(rest[chunk == c]))
                if sum(map(len, held[int(c)])) > 2_000_000:
                    held[int(c)] = [np.unique(np.concatenate(held[int(c)]))]
        for c, found in held.items():
            tokens = np.unique(np.concatenate(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), c, np.int32)), pa.array(tokens)], names=["chunk", "token"])

    asked = dealt.mapInArrow(ask, "chunk int, token long")
    answers = asked.join(table, "token").select("chunk", "token", "n", "class")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        core = shared.value
        size = len(core.units.hashes)
        tokens = right.column("token").to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        tokens, n, of_token = tokens[order], right.column("n").to_numpy()[order], right.column("class").to_numpy()[order]
        out = []
        for batch, a, b, hashes, shapes, doc in _pieces(iter(left.to_batches()), 1):
            unit = core.units.of(hashes, shapes)
            rare = np.flatnonzero(core.rare(unit))
            count, of = np.where(core.rare(unit), 0, core.counts[unit]), core.of[unit]
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, hashes[rare]), len(tokens) - 1)
                known = tokens[at] == hashes[rare]
                count[rare] = np.where(known, n[at], 0)
                of[rare] = np.where(known, of_token[at], of[rare])
            rows = b - a
            ends = np.cumsum(np.bincount(doc, minlength=rows)).astype(np.int32)
            out.append(
                pa.table(
                    {
                        "doc_id": batch.column(0)[a:b],
                        "n_tokens": pa.array(np.bincount(doc, minlength=rows).astype(np.int64)),
                        "n_known": pa.array(np.bincount(doc, weights=count > 0, minlength=rows).astype(np.int64)),
                        "tops": pa.array(np.bincount(doc, weights=np.log10(count + 0.5), minlength=rows)),
                        "classes": pa.Array.from_buffers(
                            pa.binary(), rows, [None, pa.py_buffer(np.append(np.int32(0), ends).astype(np.int32)), pa.py_buffer(of.astype(np.uint8))]
                        ),
                    }
                )
            )
        empty = {c.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]]) for c in CODED.split(", ")}
        return pa.concat_tables(out) if out else pa.table(empty)

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, CODED)


def _adjacent(column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, class before, class, text) of the tokens of some rows at a time."""
    data, offsets = binary_buffers(column)
    for a, b in slices(offsets):
        of = data[offsets[a] : offsets[b]].astype(np.int64)
        doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        before = np.append(end, of[:-1])
        before[np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))] = end
        yield a, b, before, of, doc


class Model:
    """Transitions between all tokens' classes, and class totals for the emissions."""

    def __init__(self, core: Core, table: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        self.core, self.end = core, int(core.of[-1])
        self.transition = _log_transition(table)
        self.emission = np.log10(tokens + 0.5 * (types + 1))


def complete(core: Core, table: DataFrame, texts: DataFrame) -> Model:
    """texts: the coded training documents."""
    k, end = core.classes, int(core.of[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for _, _, before, of, _ in _adjacent(batch.column(0), end):
                total += np.bincount(before * k + of, minlength=k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    # k * k rows at most
    rows = texts.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(k * k)
    pairs[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    some = core.counts > 0
    tokens = np.bincount(core.of, weights=core.counts, minlength=k)
    types = np.bincount(core.of[some], minlength=k).astype(float)
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        tokens[r["class"]] += r["n"]
        types[r["class"]] += r["types"]
    return Model(core, pairs.reshape(k, k), tokens, types)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(texts: DataFrame, model: Model) -> DataFrame:
    """Coded texts -> doc_id, n_tokens, n_known, base_score, score: sums over the tokens of each whole text."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            tops = batch.column(3).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            total = np.zeros(batch.num_rows)
            for a, b, before, of, doc in _adjacent(batch.column(4), model.end):
                total[a:b] = np.bincount(doc, weights=model.transition[before, of] - model.emission[of], minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(tops - n * model.core.base), pa.array(tops + total)],
                names=[c.split()[0] for c in SCORES.split(", ")],
            )

    return texts.mapInArrow(run, SCORES)


def digest(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """The contract's columns, and perplexity (of the model, per token)."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    core, table = fit(docs, modulus, remainder)
    texts = scratch(coded(docs, core, table), "coded")
    model = complete(core, table, texts.filter(~held_out("doc_id", modulus, remainder)))
    return score(texts, model).select(
        "doc_id",
        held_out("doc_id", modulus, remainder).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(core.n)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
