"""The pipeline against its brute-force version: every stage by definition, in plain Python."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import bpe, queries
from granary.llm.common import documents

from .test_mixing import sainte_lague, water_fill
from .test_neardup import brute as classes
from .test_repetition import brute as measures
from .test_secrets import base, final

DATA = "/root/testdata/sf0.001"


def long_measures(text):
    """What the rules need of a text of any length: repeats of 8 words or more cover what repeated windows of 8 words cover, and if
    a run of some length repeats, then all shorter ones do."""
    words = text.split()
    covered, size = [False] * len(words), sum(map(len, words))

    def again(length):
        seen = Counter(tuple(words[k : k + length]) for k in range(len(words) - length + 1))
        return [k for k in range(len(words) - length + 1) if seen[tuple(words[k : k + length])] > 1]

    for k in again(8):
        covered[k : k + 8] = [True] * 8
    low, high = 0, len(words)  # a run of `low` words repeats
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if again(middle) else (low, middle - 1)
    inside = sum(len(w) for w, c in zip(words, covered, strict=True) if c)
    return {"n_words": len(words), "n_repeat_words": sum(covered), "covered": inside / max(1, size), "longest": low if low >= 8 else 0}


def test_long_measures():
    for k in range(60):
        text = " ".join(f"w{(j * j) % (5 + k)}" for j in range(30 + k))
        wanted, got = measures(text), long_measures(text)
        assert all(got[x] == pytest.approx(wanted[x]) for x in got)


def test_stages(spark):
    docs = documents(spark, DATA)
    start = {r["doc_id"]: r for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        frames[name] = docs.collect()
        if name != "bpe_encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(frames[name], docs.schema)
    ids = {name: sorted(r["doc_id"] for r in rows) for name, rows in frames.items()}

    kept = []
    for doc_id, row in start.items():
        m = measures(row["text"]) if row["n_chars"] < 1000 else long_measures(row["text"])
        if m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"] and m["covered"] <= 0.3 and m["longest"] <= 200:
            kept.append(doc_id)
    assert ids["quality_rules"] == sorted(kept)

    assert ids["near_dedup"] == sorted(set(classes([(k, start[k]["text"]) for k in sorted(kept)]).values()))

    assert ids["secret_scan"] == ids["near_dedup"]
    before = sorted((r["doc_id"], r["text"]) for r in frames["near_dedup"])
    masked = {r["doc_id"]: r["text"] for r in frames["secret_scan"]}
    for (doc_id, text), spans in zip(before, final([t for _, t in before]), strict=True):
        places = sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x)
        out, at = "", 0
        for a, b in places:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert masked[doc_id] == out + text[at:] and not base(masked[doc_id])

    sizes = {}
    for row in frames["secret_scan"]:
        sizes.setdefault(row["source"], []).append(len(row["text"].split()))
    names = sorted(sizes)
    targets = water_fill([sum(sizes[s]) for s in names], [k % 3 + 1 for k in range(len(names))])
    blocks = sainte_lague(targets, round(sum(targets) / 64))
    for name, target, n in zip(names, targets, blocks, strict=True):
        took = sum(len(r["text"].split()) for r in frames["source_mix"] if r["source"] == name)
        assert abs(n * 64 - target) <= 64 and abs(took - target) <= 64 + max(sizes[name])

    library = Tokenizer.from_file(bpe.default_vocabulary())
    mixed = {r["doc_id"]: r["text"] for r in frames["source_mix"]}
    assert ids["bpe_encode"] == ids["source_mix"]
    for row in frames["bpe_encode"]:
        assert row["ids"] == library.encode(mixed[row["doc_id"]], add_special_tokens=False).ids and row["n_tokens"] == len(row["ids"])
        assert row["decoded_chars"] == len(library.decode(row["ids"], skip_special_tokens=False))

    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == ids["bpe_encode"]


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(queries.queries()) <= set(found)
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in found if n.startswith("op")}
    assert "pipeline" in found and set(entry.oracle_sql()) <= set(found)
