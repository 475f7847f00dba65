"""Near-duplicates by ProbMinHash: weighted 5-word shingles, banding, exact verification, components.

A document is the multiset of its 5-word shingles (one of 1 to 4 words is one shingle), weighted by their
counts; likeness is the probability Jaccard of those weights. Each shingle is a Poisson process whose rate is its
weight: arrivals fall into random registers, each register keeps the shingle of its first arrival. A process ends as
soon as its next arrival is later than the latest register of its document (early termination). Two documents agree
in a register with a probability equal to their probability Jaccard.

1. Documents with equal words are one node at once, whatever their ids; copies are never compared nor expanded into pairs.
2. `BANDS` bands of `ROWS` registers give bucket keys. In each bucket the members are paired with one hub, the
   member that meets the most others over all bands: pairs grow with the members, not with their square.
3. Pairs that the registers don't rule out (agreement below `DOUBT` is over four standard deviations from 0.8)
   are verified on the whole shingle multisets, and links become components.
4. Buckets that still hold more than one component are searched in full, block against block: first registers alone are
   compared, each pair in the first bucket that it shares. Only members of promising pairs of different components bring their
   shingles, and are verified unless they got connected meanwhile; only the links that connect something come out.
   No bucket is capped, no pair of different components is left out.

A pair at 0.8 shares a bucket with a probability of 0.9994, one at 0.85 with 0.999997.

Rows are named by a 64-bit hash of id and text, a node by the least name of its rows, so rows of one id with unlike texts are
nodes of their own, and rows without an id are compared like all others. (Of ten billion rows about three pairs share a name.)

Defined cases: texts without a word (null, empty) have no shingle, and each such row is a class of its own; copies and
repeated rows share a class; rows of one id with unlike texts belong to the class of their text each; a class without any id is
null; an empty table gives an empty result; extra columns are ignored. Whole texts are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, drop_scratch, mix64, parts, scratch, shingles, slices, text_buffers
from granary.llm.components import components

WIDTH, LEAST, BANDS, ROWS, DOUBT = 5, 0.8, 40, 8, 0.70
REGISTERS = BANDS * ROWS
#: Members of a bucket that one task compares with as many others, and bytes of a shingle's hash that verification keeps.
BLOCK, HASH_BYTES = 256, 6
#: The filter that picks the texts to verify has FILTER_EACH bits for each of them; where that is more than FILTER_MOST (16 MB),
#: the texts are shuffled to a join in its place.
FILTER_EACH, FILTER_MOST = 16, 1 << 27
#: Rows that go (copies, and for `deduplicate` all but one of a class), up to which their names are broadcast (16 bytes each); beyond
#: it the rows are shuffled to a join.
BROADCAST_ROWS = 1 << 21


# ---------------------------------------------------------------- sketches


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text: (text, hash, count), in order of text and hash."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return doc[first], hashes[first], np.diff(np.append(first, len(doc)))


def prob_min_hash(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) hashes of the shingles that arrived first; texts without shingle: 0."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(doc))
    rate = weights.astype(np.float64)
    step = 0
    while len(doc):
        noise = mix64(hashes, 1000 + step)
        time = time - np.log(((noise >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        cell = doc * registers + (mix64(noise, 77) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(time < first[cell])
        at, when = cell[better], time[better]
        np.minimum.at(first, at, when)
        won = first[at] == when
        winner[at[won]] = hashes[better[won]]
        latest = first.reshape(texts, registers).max(axis=1)
        alive = time < latest[doc]
        doc, hashes, rate, time = doc[alive], hashes[alive], rate[alive], time[alive]
        step += 1
    return winner.reshape(texts, registers)


def band_keys(winners: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) bucket keys; the band is part of the key."""
    rows = winners.shape[1] // bands
    parts = winners.reshape(len(winners), bands, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        total += mix64(parts[:, :, k], k + 1)
    return mix64(total + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); a, b: sorted distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = b[at] == a
    n = int(common.sum())
    if not n:
        return 0.0
    if x.max() == x.min() and y.max() == y.min():  # plain sets
        return n / (len(a) + len(b) - n)
    x, y = x.astype(np.float64), y.astype(np.float64)
    only_x, only_y = x[~common].sum(), y.sum() - y[at[common]].sum()
    x, y = x[common], y[at[common]]
    # x_j / x_i >= y_j / y_i exactly if the ratio x_j / y_j is at least that of i
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    low = np.searchsorted(ratio, ratio, "left")
    sum_x, sum_y = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(y))
    total = (sum_x[-1] - sum_x[low] + only_x) / x + (sum_y[low] + only_y) / y
    return float((1 / total).sum())


def _pack_shingles(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Low bytes of sorted hashes, then the counts unless all are alike."""
    low = np.sort(hashes & np.uint64((1 << (8 * HASH_BYTES)) - 1), kind="stable")
    if counts.max() == counts.min():
        return bytes([0]) + low.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
    order = np.argsort(hashes & np.uint64((1 << (8 * HASH_BYTES)) - 1), kind="stable")
    return bytes([1]) + low.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes() + counts[order].astype("<u4").tobytes()


def _unpack_shingles(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = len(raw) - 1
    n = size // (HASH_BYTES + 4) if raw[0] else size // HASH_BYTES
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8, n * HASH_BYTES, 1).reshape(n, HASH_BYTES)
    counts = np.frombuffer(raw, "<u4", n, 1 + n * HASH_BYTES) if raw[0] else np.ones(n, np.uint32)
    return wide.reshape(-1).view(np.uint64), counts


def likeness(a: bytes, b: bytes) -> float:
    """Probability Jaccard of two packed multisets."""
    return probability_jaccard(*_unpack_shingles(a), *_unpack_shingles(b))


def _text_slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


SKETCH = "row long, doc_id long, same_1 long, same_2 long, keys array<long>, registers binary"


def row_name() -> Column:
    """The name of a row: a hash of its id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce("text", F.lit(""))).alias("row")


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, text -> row, doc_id, a 128-bit hash of its words in order, band keys, and the low byte of each register
    (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _text_slices(batch.column(2)):
                rows = b - a
                hashes = words.hashes()
                doc = words.doc
                place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
                same = []
                for seed in (21, 22):
                    total = np.zeros(rows, np.uint64)
                    np.add.at(total, doc, mix64(hashes ^ mix64(place, seed), seed))
                    same.append(pa.array(mix64(total + words.counts.astype(np.uint64), seed).view(np.int64)))
                winners = prob_min_hash(*weighted(*shingles(words, hashes, WIDTH)), rows)
                keys = band_keys(winners).view(np.int64)
                none = words.counts == 0
                offsets = np.arange(rows + 1, dtype=np.int32) * BANDS
                listed = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(none))
                low = (winners & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], *same, listed, pa.array([None if x else r.tobytes() for x, r in zip(none, low, strict=True)], pa.binary())],
                    names=["row", "doc_id", "same_1", "same_2", "keys", "registers"],
                )

    return rows.select("row", "doc_id", "text").mapInArrow(run, SKETCH)


def _places(nodes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of a node in a filter of that many bits."""
    return [(mix64(nodes.astype(np.int64).view(np.uint64), seed) & np.uint64(bits - 1)).astype(np.int64) for seed in (31, 32)]


def node_filter(wanted: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of `size` bits: they are joined on the executors, so the driver gets its words alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits[word].view(np.int64))], names=["word", "bits"])

    rows = wanted.select("node").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def multisets(rows: DataFrame, wanted: DataFrame, most: int = FILTER_MOST) -> DataFrame:
    """row, text -> node, shingles (packed) of the wanted nodes, and of a few others that a filter lets through; a node comes
    once from each task that holds rows of it.

    Texts are not shuffled: each task keeps those of its own that the filter knows, up to a filter of `most` bits.
    """
    wanted = scratch(wanted.select("node"), "wanted", narrow=True)
    size = 1 << max(20, (FILTER_EACH * wanted.count() - 1).bit_length())
    if size > most:
        shared, size = None, 64
        rows = rows.join(wanted.withColumnRenamed("node", "row"), "row", "left_semi")
    else:
        shared = rows.sparkSession.sparkContext.broadcast(node_filter(wanted, size))  # `most` bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)  # of the wanted nodes that this task holds
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            known = np.ones(len(nodes), bool)
            if shared is not None:
                bits = shared.value
                for at in _places(nodes, size):
                    known &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            first = np.zeros(len(nodes), bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            known &= first & ~np.isin(nodes, seen)
            seen = np.append(seen, nodes[known])
            batch = batch.filter(pa.array(known))
            for a, b, words in _text_slices(batch.column(1)):
                doc, hashes, counts = weighted(*shingles(words, words.hashes(), WIDTH))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                made = [_pack_shingles(hashes[i:j], counts[i:j]) if j > i else None for i, j in zip(cut[:-1], cut[1:], strict=True)]
                made = pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(made, pa.binary())], names=["node", "shingles"])
                yield made.filter(made.column(1).is_valid())

    return rows.select("row", "text").mapInArrow(run, "node long, shingles binary")


# ---------------------------------------------------------------- links


def _agreeing(pairs: DataFrame, registers: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers don't rule out the likeness."""
    left = registers.select(F.col("node").alias("a"), F.col("registers").alias("ra"))
    right = registers.select(F.col("node").alias("b"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= DOUBT)
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """The pairs (a, b) whose likeness is at least LEAST."""
    left = shingled.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingled.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(x.as_py(), y.as_py()) >= LEAST for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class _Forest:
    """Union-find of the labels that one task sees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _compared(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """One block of a bucket against another (or itself): each row, its promising partners of other labels, and their agreement;
    a pair counts in the first bucket that it shares."""
    side = rows.column("side").to_numpy()
    label = rows.column("label").to_numpy()
    low = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    own = rows.column("key")[0].as_py() if rows.num_rows else 0
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for i in left:
        others = right[(label[right] != label[i]) & ((side[right] == 1) | (right > i))]
        if len(others):
            same = keys[others] == keys[i]
            others = others[keys[i][same.argmax(axis=1)] == own]
            score = (low[others] == low[i]).mean(axis=1)
            yield int(i), others[score >= DOUBT], score[score >= DOUBT]


def _promising(rows: pa.Table) -> pa.Table:
    """The rows that take part in a promising pair."""
    part = np.zeros(rows.num_rows, bool)
    for i, others, _ in _compared(rows):
        part[others] = True
        part[i] |= len(others) > 0
    return rows.select(["key", "i", "j", "side", "node", "label"]).filter(pa.array(part))


def _search(rows: pa.Table) -> pa.Table:
    """The promising pairs, best first: links between labels that connect something."""
    label = rows.column("label").to_numpy()
    shingled = rows.column("shingles")
    found = []
    for i, others, score in _compared(rows):
        found += zip(score.tolist(), [i] * len(others), others.tolist(), strict=True)
    forest, out, opened = _Forest(), [], {}
    for _, i, j in sorted(found, reverse=True):
        x, y = int(label[i]), int(label[j])
        if forest.root(x) == forest.root(y):
            continue
        for k in (i, j):
            if k not in opened:
                opened[k] = _unpack_shingles(shingled[k].as_py())
        if probability_jaccard(*opened[i], *opened[j]) >= LEAST:
            forest.join(x, y)
            out.append((x, y))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _distinct_rows(rows: DataFrame, gone: DataFrame, again: DataFrame, most: int) -> DataFrame:
    """The rows but those named in `gone`; of the rows that share a name of `again` one stays.

    Rows stay where they are as long as there are no more than `most` names; beyond that they are shuffled to a join."""
    special = scratch(gone.union(again), "gone", narrow=True)
    hint = F.broadcast if special.count() <= most else (lambda frame: frame)
    kept = rows.join(hint(special), "row", "left_anti")
    if again.count():
        kept = kept.union(rows.join(hint(again), "row", "left_semi").dropDuplicates(["row"]))
    return kept


def _named_rows(docs: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """row, doc_id, root (node that stands for the class; null without a word), class_id: one row for each row of `docs`."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").select(row_name(), "doc_id", "text")
    sketched = scratch(sketches(rows), "sketches")
    worded = sketched.filter("keys IS NOT NULL")
    same = ["same_1", "same_2"]
    # equal words: one node, named by its least row
    copies = scratch(
        worded.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("node"), F.min("doc_id").alias("first")).filter("n > 1").drop("n"),
        "copies",
        narrow=True,
    )
    members = scratch(
        worded.select("row", "doc_id", *same)
        .join(copies, same, "left")
        .select("row", "doc_id", F.coalesce("node", "row").alias("node"), F.coalesce("first", "doc_id").alias("first"), F.col("node").isNotNull().alias("copied")),
        "members",
        narrow=True,
    )
    alone = scratch(sketched.filter("keys IS NULL").select("row", "doc_id"), "alone", narrow=True)
    # sketches are wide: those of rows that stand for a node stay where they are, names alone tell which these are
    again = members.filter("copied AND row = node").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    again = scratch(again, "again", narrow=True)
    gone = members.filter("row <> node").select("row").distinct()
    nodes = _distinct_rows(worded.select("row", "keys", "registers"), gone, again, most).withColumnRenamed("row", "node")
    nodes = scratch(nodes, "nodes")
    drop_scratch(sketched, copies)

    # buckets of two or more, and the hub of each: the member that meets the most. One exchange serves the count and the join
    # (the count takes the node, or its exchange would carry other columns and be one of its own).
    keyed = nodes.select("node", F.explode("keys").alias("key")).repartition("key")
    full = keyed.groupBy("key").agg(F.count("node").alias("n")).filter("n > 1")
    # few of the keys are shared, so few files hold what all partitions of the join leave
    met = scratch(keyed.join(full, "key").select("key", "node", "n").repartition(max(1, parts(docs.sparkSession) // 4)), "met")
    degree = scratch(met.groupBy("node").agg(F.sum("n").alias("degree")), "degree", narrow=True)
    ranked = met.join(degree, "node").select("key", "node", "degree")
    hubs = scratch(ranked.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")), "hubs", narrow=True)
    pairs = met.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    registers = scratch(nodes.select("node", "keys", "registers").join(degree.select("node"), "node", "left_semi"), "registers")
    drop_scratch(nodes)  # what meets no other one is a class by itself
    likely = scratch(_agreeing(pairs, registers), "likely")

    def shingled(wanted: DataFrame, name: str) -> DataFrame:
        made = scratch(multisets(rows, wanted), name)
        # repeated rows of a node come from several tasks
        many, distinct = made.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
        return made if many == distinct else scratch(made.dropDuplicates(["node"]), name)

    wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    roots = components(_verified(likely, shingled(wanted, "shingles")))

    # buckets that still hold several components, searched in full
    labelled = scratch(met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")), "labelled")
    mixed = scratch(
        labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "n"),
        "mixed",
        narrow=True,
    )
    spread = (
        labelled.join(mixed, "key")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "key",
            "node",
            "label",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.expr("CASE WHEN own = other THEN 2 WHEN own < other THEN 0 ELSE 1 END").alias("side"),
        )
    )
    columns = ["key", "i", "j", "side", "node", "label", "keys", "registers"]
    part = "key long, i int, j int, side int, node long, label long"
    promising = scratch(spread.join(registers, "node").select(columns).groupBy("key", "i", "j").applyInArrow(_promising, part), "promising")
    details = registers.join(shingled(promising.select("node").distinct(), "open_shingles"), "node")
    more = promising.join(details, "node").select(*columns, "shingles").groupBy("key", "i", "j").applyInArrow(_search, "a long, b long")
    merged = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    linked = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(
        merged.join(roots, merged["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    )
    linked = linked.join(members.groupBy("node").agg(F.min("first").alias("first")), "node")
    linked = scratch(linked, "linked", narrow=True)
    least = linked.groupBy("root").agg(F.min("first").alias("class_id"))
    final = scratch(linked.join(least, "root").select("node", "root", "class_id"), "roots", narrow=True)
    named = members.join(final, "node", "left").select(
        "row", "doc_id", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "first").alias("class_id")
    )
    return named.union(alone.select("row", "doc_id", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of the class): one row for each row of `docs`."""
    return _named_rows(docs).select("doc_id", "class_id")


def deduplicate(docs: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of one row for each class: the one of its least id (a class without ids: the one of least name). Rows without a
    word stay.

    Texts stay where they are as long as there are no more than `most` names of rows that go.
    """
    named = scratch(_named_rows(docs, most).filter("root IS NOT NULL").select("row", "doc_id", "root"), "classes")
    names = named.groupBy("root", "row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keepers = scratch(named.groupBy("root").agg(F.min(first)["row"].alias("row")), "keepers", narrow=True)
    again = scratch(names.filter("n > 1").select("row").join(keepers, "row", "left_semi"), "again", narrow=True)
    gone = names.select("row").join(keepers.select("row"), "row", "left_anti")
    rows = docs.select(row_name(), F.struct(*docs.columns).alias("whole"))
    return _distinct_rows(rows, gone, again, most).select("whole.*")
