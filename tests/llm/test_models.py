import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from granary.llm import classifier, classlm
from granary.llm.common import documents, held_out, mix64, span_hashes, table

DATA = "/root/testdata/sf0.01"


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# ---------------------------------------------------------------- classifier


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark, DATA), table(spark, DATA, "labels")
    got = classifier.digest(docs, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (crc(k, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) for k, r in rows.items())
    right = [rows[r["doc_id"]]["predicted"] == r["quality"] for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(right) > 80 and np.mean(right) > 0.95
    again = {r["doc_id"]: r["score"] for r in classifier.digest(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-6 for k, r in rows.items())


def test_held_out_labels_are_not_seen(spark):
    docs, labels = documents(spark, DATA), table(spark, DATA, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert classifier.sample(docs, labels, 3, 1) == classifier.sample(docs, flipped, 3, 1)
    assert len(classifier.sample(docs, labels, 3, 1, most=50)) == 50


def test_ftrl_is_the_textbook_update():
    model = classifier.Ftrl(3, alpha=0.2, beta=1.0, l1=0.1, l2=0.5)
    z, n, w = np.zeros(4), np.zeros(4), np.zeros(4)
    r = np.random.default_rng(0)
    for _ in range(50):
        x, y = np.append(r.normal(size=3), 1.0), float(r.integers(0, 2))
        for i in range(4):
            w[i] = 0 if abs(z[i]) <= 0.1 else -(z[i] - math.copysign(0.1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.2 + 0.5)
        p = 1 / (1 + math.exp(-w @ x))
        for i in range(4):
            g = (p - y) * x[i]
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.2
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.learn(np.arange(4), x, y)
        assert model.z == pytest.approx(z)


def test_classifier_odd_rows(spark, frame):
    docs = frame([(1, "good words here"), (2, None), (2, ""), (None, "x"), (3, "BAD!! BAD!!")])
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (3, 0, 1), (3, 0, 1), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = classifier.digest(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = classifier.digest(docs, labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 5
    assert classifier.digest(frame([]), labels).collect() == []
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]


def test_score_and_training_by_definition(spark, frame):
    """Features, updates and scores of `digest` in plain Python."""
    r = random.Random(12)
    words = ["good", "fine", "Prose,", "it's", "x1", "2024", "é", "##", "bad!", "spam"]
    rows = [(k, " ".join(r.choices(words[:7] if k % 2 else words[4:], k=r.randrange(1, 30)))) for k in range(60)] + [(100, None), (101, " ")]
    labels = [(k, int(k % 2)) for k in range(50)] + [(3, 0), (3, 1), (4, None), (100, 1)]
    bits = classifier.BITS

    def mixed(x, seed):
        return int(mix64(np.array([x], np.uint64), seed)[0])

    def buckets(text):
        raw = (text or "").encode()
        found = [m[0] for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+", raw)]
        hashes = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in found]
        both = [mixed(h, 1) for h in hashes] + [mixed((mixed(a, 2) + b) % (1 << 64), 3) for a, b in zip(hashes, hashes[1:])]
        return Counter(x >> (64 - bits) for x in both)

    known = {}
    for k, y in labels:
        if y is not None:
            known.setdefault(k, []).append(y)
    ids = [k for k in known if k in dict(rows) and crc(k, 3) != 1]
    place = {x["i"]: x["p"] for x in spark.createDataFrame([(k,) for k in ids], "i long").selectExpr("i", f"xxhash64({classifier.SEED}, i) p").collect()}
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(classifier.L1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)

    for _ in range(classifier.EPOCHS):
        for k in sorted(ids, key=lambda k: place[k]):
            found = buckets(dict(rows)[k])
            x = {i: c / math.sqrt(max(1, sum(found.values()))) for i, c in found.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i, v in x.items():
                g = (p - (sum(known[k]) / len(known[k]) >= 0.5)) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = {x["doc_id"]: x for x in classifier.digest(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for k, text in rows:
        found = buckets(text)
        total = sum(weight(i) * c for i, c in found.items()) / math.sqrt(max(1, sum(found.values()))) + weight("bias")
        score = 1 / (1 + math.exp(-total))
        assert got[k]["score"] == pytest.approx(score, abs=1e-5)
        assert got[k]["held_out"] == (crc(k, 3) == 1) and got[k]["predicted"] == int(got[k]["score"] >= 0.5)


def test_sample_is_bounded(spark, frame):
    """One text of each id, however often it stands, and no more bytes than said."""
    rows = [(0, f"one of many {k}") for k in range(50)] + [(k, "some text of thirty characters") for k in range(1, 40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert len(classifier.sample(frame(rows), labels, 3, 5, most=10)) == 10
    assert len(classifier.sample(frame(rows), labels, 3, 5)) == 40
    assert len(classifier.sample(frame(rows), labels, 3, 5, most_bytes=200)) in (6, 7)
    assert len(classifier.sample(frame(rows), labels, 3, 5, most_bytes=1)) == 1


# ---------------------------------------------------------------- language model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def check_base(rows, got):
    counts = Counter()
    for doc_id, text in rows:
        if doc_id is None or crc(doc_id, 5) != 1:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)

    def row(doc_id, text):
        t = tokens(text)
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        return str(doc_id), doc_id is not None and crc(doc_id, 5) == 1, len(t), sum(counts[w] > 0 for w in t), n, round(score, 4)

    seen = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    for a, b in zip(seen, sorted(row(*r) for r in rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-3)


def test_language_model_on_documents(spark):
    docs = documents(spark, DATA)
    got = classlm.digest(docs).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], got)
    held = [r for r in got if r["held_out"]]
    mean = lambda key: sum(r[key] for r in held) / sum(r["n_tokens"] for r in held)
    assert mean("score") > mean("base_score") + 0.1  # the classes tell more than single words do
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in held)


def test_language_model_odd_rows(spark, frame):
    rows = [(1, "the cat The CAT ÀB àB"), (2, None), (2, "the dog"), (None, "the the"), (3, ""), (6, "x " * 5000), (7, "the dog\x0bsat\x1c")]
    check_base(rows, classlm.digest(frame(rows)).collect())
    assert classlm.digest(frame([])).collect() == []
    held = next(k for k in range(100) if crc(k, 5) == 1)
    only = classlm.digest(frame([(held, "no training text")])).collect()[0]
    assert (only["train_tokens"], only["n_known"], only["base_score"]) == (0, 0, 0.0)


def brute_model(rows, units, classes):
    """The whole model in plain Python but for the exchange of the units: log10 probability of each text."""
    keep = [tokens(t) for d, t in rows if d is None or crc(d, 5) != 1]
    counts = Counter(w for t in keep for w in t)

    def hashed(word):
        if word is None:
            return int(classlm.END)
        data = np.frombuffer(word.encode(), np.uint8)
        return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])

    def shape(w):
        if w is None:
            return "end"
        raw = w.encode()
        last = "aeiouy".find(chr(raw[-1])) >= 0 if raw[-1] < 128 else None
        kind = "high" if raw[-1] >= 128 else "vowel" if last else "sign" if not chr(raw[-1]).isalnum() and 33 <= raw[-1] < 127 else "other"
        return (len(raw) > 4) + (len(raw) > 9), kind, any(48 <= x < 58 for x in raw), any(x >= 128 for x in raw)

    signed = lambda w: hashed(w) - (1 << 64) * (hashed(w) >> 63)
    frequent = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], signed(w)))[:units]
    unit = lambda w: ("word", w) if w in frequent else ("shape", shape(w))
    # places of units as the library numbers them
    place = {("word", w): k for k, w in enumerate(sorted(frequent, key=hashed))}
    vowel = {"other": 0, "vowel": 1, "sign": 2, "high": 3}
    number = lambda u: place[u] if u[0] == "word" else len(frequent) + (classlm.SHAPES - 1 if u[1] == "end" else u[1][0] * 16 + vowel[u[1][1]] * 4 + u[1][2] * 2 + u[1][3])
    pairs = np.zeros((len(frequent) + classlm.SHAPES,) * 2)
    for t in keep:
        for x, y in zip([None, *t], t):
            pairs[number(unit(x)), number(unit(y))] += 1
    of = classlm.exchange(pairs, classes)
    k = of.max() + 1
    table = np.zeros((k, k))
    for x, y in zip(*np.nonzero(pairs)):
        table[of[x], of[y]] += pairs[x, y]
    delta = classlm.DELTA
    first = np.log10((table + delta) / (table.sum(1, keepdims=True) + delta * k))
    group = {}
    for w in counts:
        if w in frequent or w is None:
            group[w] = of[number(unit(w))]
            continue
        before, after = Counter(), Counter()
        for t in keep:
            for x, y, z in zip([None, *t], t, [*t[1:], None]):
                if y == w:
                    before[of[number(unit(x))]] += 1
                    after[of[number(unit(z))]] += 1
        value = lambda c: sum(n * first[b, c] for b, n in before.items()) + sum(n * first[c, a] for a, n in after.items()) - counts[w] * math.log10(table[:, c].sum() + counts[w])  # noqa: B023, E731
        group[w] = max(range(k), key=lambda c: (round(value(c), 9), -c))  # noqa: B023
    moved, total, types = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in keep:
        for x, y in zip([None, *t], t):
            moved[group[x], group[y]] += 1
    for w, n in counts.items():
        total[group[w]] += n
        types[group[w]] += 1
    final = np.log10((moved + delta) / (moved.sum(1, keepdims=True) + delta * k))
    of_any = lambda w: group.get(w, of[number(unit(w))])
    out = []
    for _, text in rows:
        t = tokens(text)
        out.append(sum(final[of_any(x), of_any(y)] + math.log10((counts[y] + 0.5) / (total[of_any(y)] + 0.5 * (types[of_any(y)] + 1))) for x, y in zip([None, *t], t)))
    return out, final, group


def test_score_by_definition(spark, frame):
    r = random.Random(8)
    nouns, verbs, rest = [f"noun{k}" for k in range(12)], [f"verb{k}s" for k in range(8)], ["the", "A", "é", "x1", "on.", "MIT"]
    rows = [(k, " ".join(w for _ in range(r.randrange(0, 9)) for w in (r.choice(rest), r.choice(nouns), r.choice(verbs)))) for k in range(70)]
    rows += [(None, "the noun1"), (200, None), (201, "never-seen words ÀB"), (202, "the noun1 verb1s " * 700), (7, "the noun2"), (7, "the noun2")]
    docs = frame(rows).selectExpr("cast(doc_id as long) doc_id", "text").repartition(3)
    core, table = classlm.fit(docs, 5, 1, units=9, classes=4)
    texts = classlm.coded(docs, core, table)
    model = classlm.complete(core, table, texts.filter(held_out("doc_id", 5, 1) == False))  # noqa: E712
    wanted, transition, group = brute_model(rows, 9, 4)
    assert model.transition == pytest.approx(transition)
    assert np.power(10.0, model.transition).sum(axis=1) == pytest.approx(1)
    got = sorted((str(x["doc_id"]), x["score"]) for x in classlm.score(texts, model).collect())
    for (a, x), (b, y) in zip(got, sorted((str(d), w) for (d, _), w in zip(rows, wanted)), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-6)
    # every training word that is no unit has a class of its own bigrams' choice
    assert table.count() == sum(w is not None for w in group) - 9


def test_one_shuffle_of_texts(spark, frame):
    docs = frame([(k, "a b c") for k in range(20)]).selectExpr("doc_id", "text")
    core, table = classlm.fit(docs, 5, 1, units=1)
    found = classlm.coded(docs, core, table)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().treeString()


def information(pairs, of):
    classes = of.max() + 1
    one = np.zeros((len(of), classes))
    one[np.arange(len(of)), of] = 1
    t = one.T @ pairs @ one
    f = lambda x: classlm._xlogx(np.asarray(x, float)).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_reaches_a_local_optimum():
    r = np.random.default_rng(5)
    pairs = r.poisson(1.0, (14, 14)).astype(float)
    pairs[:7, 7:] += 20  # two kinds of units that follow each other
    pairs[7:, :7] += 20
    of = classlm.exchange(pairs, classes=2)
    assert len(set(of[:7])) == 1 and len(set(of[7:])) == 1 and of[0] != of[7]
    pairs = r.poisson(2.0, (12, 12)).astype(float)
    of = classlm.exchange(pairs, classes=3)
    best = information(pairs, of)
    for w in range(12):
        for k in range(3):
            moved = of.copy()
            moved[w] = k
            if moved.max() == 2:
                assert information(pairs, moved) <= best + 1e-6
