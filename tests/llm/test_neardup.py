import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import neardup
from granary.llm.components import components
from granary.llm.common import documents, mix64


def multiset(text):
    words = (text or "").split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def exact(a, b):
    """Probability Jaccard by definition."""
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def brute(rows):
    """Class of each row: components of all pairs at 0.8 or more."""
    sets = [multiset(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (rows[i][1].split() == rows[j][1].split() or exact(sets[i], sets[j]) >= 0.8):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return {doc_id: least[root(k)] for k, (doc_id, _) in enumerate(rows)}


def hashed(counter):
    items = sorted((hash(k) & ((1 << 64) - 1), n) for k, n in counter.items())
    return np.array([k for k, _ in items], np.uint64), np.array([n for _, n in items])


def test_probability_jaccard():
    r = random.Random(1)
    for _ in range(100):
        a, b = Counter(r.choices(range(12), k=20)), Counter(r.choices(range(14), k=r.randint(1, 30)))
        assert neardup.probability_jaccard(*hashed(a), *hashed(b)) == pytest.approx(exact(a, b))
    a, b = Counter(range(80)), Counter(range(100))
    assert neardup.probability_jaccard(*hashed(a), *hashed(b)) == pytest.approx(0.8)
    for c in (a, Counter({1: 3, 2: 1})):
        h, n = hashed(c)
        back, counts = neardup._unpack_shingles(neardup._pack_shingles(mix64(h), n))
        assert len(back) == len(c) and sorted(counts.tolist()) == sorted(n.tolist() if len(set(n)) > 1 else [1] * len(c))


def test_registers_estimate_it():
    r = random.Random(2)
    for _ in range(3):
        a = Counter({k: r.randint(1, 5) for k in range(100)})
        b = Counter({k: r.randint(1, 5) for k in range(20, 120)})
        docs = [hashed(a), hashed(b)]
        doc = np.repeat([0, 1], [len(d[0]) for d in docs])
        sketch = neardup.prob_min_hash(doc, mix64(np.concatenate([d[0] for d in docs])), np.concatenate([d[1] for d in docs]), 2, 4000)
        assert np.mean(sketch[0] == sketch[1]) == pytest.approx(exact(a, b), abs=0.035)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(1, 40)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return " ".join(words)


def test_classes(spark, frame):
    r = random.Random(4)
    base = [[f"b{g}w{r.randrange(10**6)}" for _ in range(150)] for g in range(4)]
    rows = [(1000 + k, edited(base[k % 3], r, r.randint(0, 5))) for k in range(90)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(2000 + k, " ".join(f"own{k}x{j}" for j in range(100)) + " " + passage) for k in range(40)]  # share a passage: apart
    rows += [(3000 + k, " ".join(base[3])) for k in range(50)]  # equal copies
    rows += [(4000, "a b"), (4001, "a  b"), (4002, "a b c"), (4003, None), (4004, ""), (4005, " \n")]
    rows += [(5000, "again " * 400), (5001, "again " * 390)]
    wanted = brute([(i, t or "") for i, t in rows])
    got = neardup.classes(frame(rows))
    assert got.columns == ["doc_id", "class_id"]
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == wanted
    assert wanted[4001] == 4000 and wanted[4004] == 4004 and wanted[5001] == 5000
    kept = neardup.deduplicate(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values()))


def test_odd_rows(spark, frame):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, "only null " * 9), (None, None), (8, "else " * 9)]
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(frame(rows)).collect()), key=str)
    assert got == sorted([(7, 3), (7, 3), (3, 3), (None, 3), (None, None), (None, None), (8, 8)], key=str)
    assert neardup.classes(frame([])).collect() == []
    kept = neardup.deduplicate(frame([(1, text), (1, text), (2, text), (None, text), (5, ""), (None, "x y"), (None, "x y")])).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "5", "None"]


def test_repeated_and_null_ids(spark, frame):
    """Each text of a repeated id keeps its own links; rows without an id are compared like others."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a + " more"), (5, a), (5, b), (9, b + " more"), (None, a + " other"), (None, c), (None, c + " more")]
    docs = frame(rows).repartition(3)
    texts = {t: d for d, t in rows}
    found = neardup._named_rows(docs).join(docs.select(neardup.row_name(), "text"), "row").collect()
    roots = {r["text"]: r["root"] for r in found}
    by_root = {}
    for text, root in roots.items():
        by_root.setdefault(root, set()).add(text)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, ({a, a + " more", a + " other"}, {b, b + " more"}, {c, c + " more"})))
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (5, 5), (9, 5), (None, 3), (None, None), (None, None)], key=str)
    # shuffled; the other tests broadcast
    kept = {r["text"] for r in neardup.deduplicate(docs, 0).collect()}
    assert len(kept) == 3 and {a + " more", b} <= kept and kept & {c, c + " more"}
    assert texts[a] == 5


def test_filter_or_join(spark, frame):
    """Texts to verify are the same through the filter and through the join that stands in for a large one."""
    rows = frame([(k % 40, f"w{k % 40} " * 3 + "tail") for k in range(200)]).select(neardup.row_name(), "text").repartition(5)
    wanted = rows.select(rows["row"].alias("node")).distinct().orderBy("node").limit(20)
    nodes = {r["node"] for r in wanted.collect()}
    read = lambda most: {r["node"]: bytes(r["shingles"]) for r in neardup.multisets(rows, wanted, most).collect() if r["node"] in nodes}
    found = read(neardup.FILTER_MOST)
    assert found == read(0) and found.keys() == nodes


def test_full_search_of_a_bucket():
    """Links that only a search of the whole bucket finds, and none between equal labels."""
    import pyarrow as pa

    r = random.Random(6)
    base = list(range(200))
    sets = [sorted(set(base[k * 5 :]) | {10**6 + k * 7 + j for j in range(k * 5)}) for k in range(9)]
    docs = [mix64(np.array(s, np.uint64)) for s in sets]
    doc = np.repeat(np.arange(9), [len(d) for d in docs])
    winners = neardup.prob_min_hash(doc, np.concatenate(docs), np.ones(len(doc)), 9)
    registers, keys = (winners & np.uint64(255)).astype(np.uint8), neardup.band_keys(winners).view(np.int64)
    keys[:, 0] = 77  # the bucket that all share
    table = pa.table(
        {
            "side": pa.array([2] * 9, pa.int32()),
            "label": pa.array(range(9), pa.int64()),
            "node": pa.array(range(9), pa.int64()),
            "key": pa.array([77] * 9, pa.int64()),
            "i": pa.array([0] * 9, pa.int32()),
            "j": pa.array([0] * 9, pa.int32()),
            "keys": pa.array(list(keys), pa.list_(pa.int64())),
            "registers": [x.tobytes() for x in registers],
            "shingles": [neardup._pack_shingles(d, np.ones(len(d), int)) for d in docs],
        }
    )
    found = neardup._search(table)
    linked = {frozenset((a, b)) for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)}
    up = list(range(9))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(i, j) for i in range(9) for j in range(i) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8]
    assert linked <= {frozenset(p) for p in pairs}
    for i, j in linked:
        up[max(root(i), root(j))] = min(root(i), root(j))
    assert all(root(i) == root(j) for i, j in pairs)
    assert r
    assert {x for p in pairs for x in p} <= set(neardup._promising(table)["node"].to_pylist())
    assert neardup._search(table.set_column(3, "key", pa.array([78] * 9, pa.int64()))).num_rows == 0  # found in an earlier bucket


def test_wide_rows_stay(spark, frame, monkeypatch):
    """Sketches of unlike texts are not shuffled, bucket keys once, and neither table outlasts its use, whatever the join threshold."""
    text = [" ".join(f"t{g}w{k}" for k in range(40)) for g in range(30)]
    rows = [(k, text[k % 25]) for k in range(60)] + [(k, text[25] + " more" * (k % 2)) for k in (70, 70, 70, 71)] + [(80, ""), (80, ""), (None, text[3])]
    docs = frame(rows).repartition(3)
    plans, write, kept = {}, neardup.scratch, {}

    def watched(df, name, narrow=False):
        if name in ("nodes", "met"):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        kept[name] = write(df, name, narrow)
        return kept[name]

    monkeypatch.setattr(neardup, "scratch", watched)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [sorted(((r["doc_id"], r["class_id"]) for r in neardup._named_rows(docs, most).collect()), key=str) for most in (0, neardup.BROADCAST_ROWS)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    wanted = [(k, k % 25) for k in range(60)] + [(70, 70)] * 3 + [(71, 70), (80, 80), (80, 80), (None, 3)]
    assert found[0] == found[1] == sorted(wanted, key=str)
    shuffles = {name: sum("- Exchange hashpartitioning(" in line for line in plan.splitlines()) for name, plan in plans.items()}
    assert shuffles == {"nodes": 1, "met": 1}, plans  # nodes: the one that takes one row of those alike in id and text
    assert "Exchange hashpartitioning(row" in plans["nodes"] and "LeftAnti, BuildRight" in plans["nodes"]
    for name in ("sketches", "nodes"):
        with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|NOT_EXIST"):
            spark.read.parquet(kept[name]._scratch_path)


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == brute(rows)


def test_recall(spark):
    """Every pair at 0.8 or more among the thousand documents is linked, and nothing else is."""
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    nodes = {}
    for doc_id, text in rows:
        nodes.setdefault(tuple(text.split()), []).append(doc_id)
    sets = [multiset(" ".join(words)) for words in nodes]
    holders = {}
    for k, found in enumerate(sets):
        for x in found:
            holders.setdefault(x, []).append(k)
    near = Counter()
    for held in holders.values():
        near.update((i, j) for n, i in enumerate(held) for j in held[:n])
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    likeness, hashes = [], [hashed(x) for x in sets]  # `exact` takes the square of a text's size
    for (i, j), common in near.items():
        if common >= 0.2 * max(len(sets[i]), len(sets[j])):
            likeness.append((neardup.probability_jaccard(*hashes[i], *hashes[j]), i, j))
            if likeness[-1][0] >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, ids in enumerate(nodes.values()):
        least[root(k)] = min(least.get(root(k), ids[0]), *ids)
    wanted = {doc_id: least[root(k)] if words else doc_id for k, (words, ids) in enumerate(nodes.items()) for doc_id in ids}
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == wanted
    assert sum(x >= 0.8 for x, _, _ in likeness) >= 4
