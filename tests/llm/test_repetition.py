import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import repetition
from granary.llm.common import documents, word_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """Base counts, longest repeat and covered fraction by definition."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    twice = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    longest, covered = 0, set()
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= 8:
                longest = max(longest, k)
                covered.update(range(i, i + k), range(j, j + k))
    chars = sum(map(len, words))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": again,
        "n_repeat_words": len(twice), "longest": longest, "covered": sum(len(words[i]) for i in covered) / max(1, chars),
    }


rng = random.Random(5)
TEXTS = [
    None, "", " \n\t ", "one", "a b c\n\na b c\n a b c", "é è\n" * 12, "a " * 90, "x\x0by\x1cz w  ",
    "# * $ % & | < > #", " ".join(rng.choices("ab", k=150)), " ".join(f"w{k}" for k in range(60)) * 2,
    *(" ".join(rng.choices("abcdefgh", k=rng.randint(1, 120))) for _ in range(60)),
    *("\n".join(rng.choices(["a b", "b a c", "c", ""], k=30)) for _ in range(20)),
]


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_measures(most):
    for a, b, words in word_slices(pa.array(TEXTS), most):
        found = repetition.measure(words)
        for i in range(a, b):
            wanted = brute(TEXTS[i])
            assert {k: pytest.approx(float(found[k][i - a])) for k in wanted} == wanted, TEXTS[i]


def test_maximal_repeats():
    symbols = [1, 2, 3, 9, 1, 2, 3, 8, 2, 3]
    assert repetition.maximal_repeats(np.array(symbols), 2) == [(2, [1, 5, 8]), (3, [0, 4])]
    assert repetition.maximal_repeats(np.array([7] * 5), 1) == [(1, [0, 1, 2, 3, 4]), (2, [0, 1, 2, 3]), (3, [0, 1, 2]), (4, [0, 1])]
    for seed in range(30):
        r = random.Random(seed)
        s = r.choices(range(3), k=40)
        wanted = {}
        for n in range(1, 40):
            for i in range(41 - n):
                wanted.setdefault((n, tuple(s[i : i + n])), []).append(i)

        def maximal(n, at):
            left = {s[i - 1] if i else ("start", i) for i in at}
            right = {s[i + n] if i + n < 40 else ("end", i) for i in at}
            return len(at) > 1 and len(left) > 1 and len(right) > 1

        assert repetition.maximal_repeats(np.array(s), 2) == sorted((n, at) for (n, _), at in wanted.items() if n >= 2 and maximal(n, at))


def test_verdicts(spark, frame, by_id):
    clean = " ".join(f"word{k}" for k in range(400))
    passage = " ".join(f"again{k}" for k in range(250))
    rows = [(1, clean), (2, "too short"), (3, "a b c d e f g h i j " * 5), (4, f"{clean} {passage} {clean.upper()} {passage}"), (5, None), (5, None), (None, clean)]
    found = repetition.quality(frame(rows))
    assert found.count() == 7
    kept = by_id(found)
    assert kept[1]["kept"] and kept[None]["kept"] and not kept[1]["base_failed"]
    assert kept[2]["base_failed"] and kept[3]["base_failed"] and kept[5]["base_failed"]
    assert not kept[4]["kept"] and kept[4]["longest_repeat"] == 250
    stay = repetition.keep(frame(rows))
    assert stay.columns == frame(rows).columns and sorted(r["doc_id"] or 0 for r in stay.collect()) == [0, 1]
    assert repetition.quality(frame([])).collect() == [] and repetition.keep(frame([])).collect() == []


def test_documents(spark, by_id):
    docs = documents(spark, "/root/testdata/sf0.001")
    found = by_id(repetition.quality(docs))
    for row in docs.select("doc_id", "text").collect():
        text = row["text"]
        if len(text) > 4000:
            continue
        wanted = brute(text)
        assert all(found[row["doc_id"]][k] == wanted[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
